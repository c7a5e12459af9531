"""Calls to services that may fail: retries with growing pauses, time limits and votes."""

from __future__ import annotations

import random
import time
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def retried(call: Callable, attempts: int = 3, pause: float = 1.0, longest: float = 60.0, spread: float = 0.0, seconds: float | None = None, on: tuple = (Exception,), sleep: Callable[[float], None] = time.sleep):
    """The result of call(), tried up to `attempts` times; the pause doubles from one to the next up to `longest`, and varies
    by the share `spread`. An attempt that takes more than `seconds` has failed. The last failure is raised."""
    for k in range(attempts):
        try:
            return call() if seconds is None else _within(call, seconds)
        except on:
            if k + 1 == attempts:
                raise
            sleep(min(pause * 2**k, longest) * (1 + spread * random.random()))


def _within(call: Callable, seconds: float):
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(timeout=seconds)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def voted(judge: Callable[[], tuple[str, str]], votes: int, order: list[str], **options) -> tuple[str, str]:
    """(label, rationale) that most of several calls give; of several labels the middle one in `order`, of two the upper. The
    rationale is the first that came with that label."""
    verdicts = [retried(judge, **options) for _ in range(max(1, votes))]
    tally = Counter(label for label, _ in verdicts)
    winners = sorted((label for label, n in tally.items() if n == max(tally.values())), key=order.index)
    return next(v for v in verdicts if v[0] == winners[len(winners) // 2])


def called(rows: DataFrame, column: str, call: Callable[[str], str], out: str, error: str = "error", **options) -> DataFrame:
    """rows with out, call() of a column, and error, why there is none after all attempts. A row's failure doesn't end the
    others; a null isn't called."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, errors = [], []
            for v in batch.column(batch.schema.names.index(column)).to_pylist():
                try:
                    results.append(None if v is None else retried(lambda v=v: call(v), **options))
                    errors.append(None)
                except Exception as e:
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, out, error])

    rows = rows.drop(out, error)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())]))
