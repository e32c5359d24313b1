"""What a Python worker remembers from task to task, of one operator at a time.

Workers outlive the stage that filled them and serve the stages of other
operators, so what the one before remembered would only add to their memory.
"""

from __future__ import annotations

from collections.abc import Callable

_held: dict[str, Callable[[], None]] = {}


def only(operator: str, forget: Callable[[], None]) -> None:
    """From now on this worker remembers for ``operator``; what it remembered for others is forgotten."""
    for other in [name for name in _held if name != operator]:
        _held.pop(other)()
    _held[operator] = forget
