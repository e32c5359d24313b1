"""Calling a chat model for every row."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from askmill.operators.clients import Client, Request

# Replies are handed on after this many calls, so that slow models stream.
_ROWS_PER_YIELD = 64

_ADDED = T.StructType(
    [
        T.StructField("ai_output", T.StringType()),
        T.StructField("tool_calls", T.StringType()),
        T.StructField("time_s", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


class _Caller:
    """Runs in a task: one client per partition, one call per row."""

    def __init__(self, client_factory: Callable[[], Client], pause: float) -> None:
        self.client_factory = client_factory
        self.pause = pause

    def _call(self, client: Client, row: dict) -> tuple:
        params = row.get("params") or {}
        begun = time.perf_counter()
        try:
            reply = client(
                Request(
                    messages=json.loads(row["request"])["messages"],
                    endpoint=row.get("endpoint"),
                    max_tokens=params.get("max_tokens"),
                    temperature=params.get("temperature"),
                    tools=json.loads(row["tools"]) if row.get("tools") else None,
                )
            )
            calls = json.dumps(reply.tool_calls, ensure_ascii=False) if reply.tool_calls else None
            text, error = reply.text, None
        except Exception as failure:  # noqa: BLE001 - a failed call is a result of its own
            text, calls, error = None, None, type(failure).__name__
        return text, calls, round(time.perf_counter() - begun, 2), error

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        due = 0.0
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS_PER_YIELD):
                part = whole.slice(at, _ROWS_PER_YIELD)
                used = [c for c in ("request", "params", "tools", "endpoint") if c in part.schema.names]
                replies = []
                for row in part.select(used).to_pylist():
                    if client is None:
                        client = self.client_factory()
                    if self.pause:
                        time.sleep(max(0.0, due - time.monotonic()))
                        due = time.monotonic() + self.pause
                    replies.append(self._call(client, row))
                columns = list(zip(*replies))
                types = [pa.string(), pa.string(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    part.columns + [pa.array(c, type=t) for c, t in zip(columns, types)],
                    names=part.schema.names + _ADDED.names,
                )


def generate(
    requests: DataFrame,
    client_factory: Callable[[], Client],
    parallelism: int | None = None,
    requests_per_second: float | None = None,
) -> DataFrame:
    """Add ``ai_output``, ``tool_calls`` (JSON), ``time_s`` and ``error``.

    ``request`` holds the messages as JSON; ``params``, ``tools`` and
    ``endpoint`` are used when present. A call that raises gives a NULL answer
    and the name of the exception. The rows are spread evenly over ``parallelism``
    tasks, by default as many as the cluster has cores. ``requests_per_second``
    is a ceiling over all tasks: each paces itself at its share. Calls are side
    effects: write the result before reading it more than once.
    """
    parallelism = parallelism or requests.sparkSession.sparkContext.defaultParallelism
    spread = requests.repartition(parallelism)
    pause = parallelism / requests_per_second if requests_per_second else 0.0
    return spread.mapInArrow(_Caller(client_factory, pause), T.StructType(requests.schema.fields + _ADDED.fields))
