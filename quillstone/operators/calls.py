"""Calls to slow outside services, such as models, from Spark tasks: several in flight, answers in source order, failures as rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillstone.sources.boundary import Progress, written

#: Calls that one task has under way at most.
IN_FLIGHT = 5
#: What counts as a failed call; anything else is a mistake in the code and fails the task.
FAILURES = (RuntimeError, ValueError, OSError)


def _in_order(call: Callable[[dict], object], rows: Iterator[dict], in_flight: int) -> Iterator[tuple[object, str | None]]:
    """(answer, error) of each row, in order; the next row is only taken when there is room."""

    def one(row: dict) -> tuple[object, str | None]:
        try:
            return call(row), None
        except FAILURES as e:
            return None, f"{type(e).__name__}: {e}"

    under_way = deque()
    with ThreadPoolExecutor(in_flight) as pool:
        for row in rows:
            under_way.append(pool.submit(one, row))
            if len(under_way) == in_flight:
                yield under_way.popleft().result()
        while under_way:
            yield under_way.popleft().result()


def _task(call: Callable[[dict], object], in_flight: int, schema: pa.Schema, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def rows() -> Iterator[dict]:
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    yield from batch.to_pylist()

        answers, errors = [], []
        for answer, error in _in_order(call, rows(), in_flight):
            answers.append(answer)
            errors.append(error)
            if len(answers) == waiting[0].num_rows:
                batch = waiting.popleft()
                columns = [*(batch[c] for c in keep), pa.array(answers, schema.field("answer").type), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                answers, errors = [], []

    return run


def ask(rows: DataFrame, call: Callable[[dict], object], answer: str | T.DataType, in_flight: int = IN_FLIGHT, tasks: int | None = None, name: str = "answers", keep: list[str] | None = None, progress: Progress | None = None) -> DataFrame:
    """rows with `answer` (of the given type) and `error`, written once: what reads them asks nobody again.

    call gets a row as a dict and returns what the type of `answer` takes; of the row, the columns `keep` (by default all) are written. A task has `in_flight` calls under way and keeps the order of its rows; with
    `tasks` the rows are dealt into so many tasks, and in_flight * tasks bounds the calls under way at once. A call that raises one of FAILURES
    gives a null answer and its reason in `error`; the others go on. A task that is lost asks for its own rows again, as nothing of it was written.
    Rows that repeat are asked for each. No rows, no calls. `progress` hears how many were asked for, and how many failed.
    """
    if in_flight < 1:
        raise ValueError("at least one call must be under way")
    kind = T.DataType.fromDDL(answer) if isinstance(answer, str) else answer
    keep = rows.columns if keep is None else keep
    out = T.StructType([*(rows.schema[c] for c in keep), T.StructField("answer", kind), T.StructField("error", T.StringType())])
    dealt = rows.repartition(tasks) if tasks else rows
    return written(dealt.mapInArrow(_task(call, in_flight, to_arrow_schema(out), keep), out), name, progress, asked=F.count(F.lit(1)), failed=F.count("error"))
