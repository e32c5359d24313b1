"""What a chat model looks like to the library, and stand-ins for tests.

A client is any callable from :class:`Request` to :class:`Reply`. The stand-ins
are deterministic and need no network; what they answer says nothing about any
real model.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Request:
    messages: list[dict]
    endpoint: str | None = None
    max_tokens: int | None = None
    temperature: float | None = None
    tools: list[dict] | None = None

    @property
    def user_text(self) -> str:
        return next(m["content"] for m in reversed(self.messages) if m["role"] == "user")


@dataclass(frozen=True)
class Reply:
    text: str | None = None
    # Each entry is ``{"function": {"name": ..., "arguments": "<json>"}}``.
    tool_calls: list[dict] = field(default_factory=list)


Client = Callable[[Request], Reply]


@dataclass(frozen=True)
class ExtractiveStub:
    """Answers with the first words of the question; fails where told to.

    When tools are offered it calls the first one with each word that follows
    ``in``, and answers nothing when there is none.
    """

    n_words: int = 12
    fail_on: str | None = None

    def __call__(self, request: Request) -> Reply:
        text = request.user_text
        if self.fail_on is not None and self.fail_on in text:
            raise RuntimeError("stub told to fail")
        if request.tools:
            name = request.tools[0]["function"]["name"]
            cities = re.findall(r"\bin ([A-Z]\w+)", text)
            return Reply(
                tool_calls=[
                    {"function": {"name": name, "arguments": json.dumps({"city": c}, ensure_ascii=False)}}
                    for c in cities
                ]
            )
        return Reply(text=" ".join(text.split()[: self.n_words]))


@dataclass(frozen=True)
class EchoStub(ExtractiveStub):
    """Answers with all words of the request, their number and the checksum of its text."""

    def __call__(self, request: Request) -> Reply:
        reply = super().__call__(request)
        if reply.tool_calls or request.tools:
            return reply
        text = request.user_text
        words = text.split()
        checksum = hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()
        return Reply(text=f"{' '.join(words)} ({len(words)} words, {checksum})")


@dataclass(frozen=True)
class LengthJudgeStub:
    """Scores by the length of the request, in the form a judge is told to use."""

    def __call__(self, request: Request) -> Reply:
        score = len(request.user_text) % 5 + 1
        return Reply(text=f"**Score:** {score}\n**Explanation:** request of {len(request.user_text)} characters")
