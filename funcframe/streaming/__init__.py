"""Operators on streams. Those that look at one sample at a time run unchanged; bins become windowed groups, and series
operators keep state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from funcframe import operators as ops
from funcframe.model import ModelError, Type, col

STATELESS = (ops.Filter, ops.Projection, ops.Rename, ops.ConvertTime, ops.FormatTime, ops.TimeTupleToTime, ops.ConvertBinary, ops.Uncurry, ops.Pivot, ops.MapSamples, ops.Composition, ops.Substitution, ops.Evaluation, ops.RemoveVariables)


def apply(stream: DataFrame, model: Type, operations: list[ops.Operator]) -> tuple[DataFrame, Type]:
    """Stateless operators on a stream."""
    for op in operations:
        if not isinstance(op, STATELESS):
            raise ModelError(f"Not for streams: {op}")
        stream, model = op.apply(stream, model), op.apply_model(model)
    return stream, model


def binned(stream: DataFrame, time: str, width: str, late: str, value: str) -> DataFrame:
    """Count, mean, min and max of a variable in time bins; a bin ends when the watermark passes it."""
    w = F.window(col(time), width)
    x = col(value).cast("double")
    out = stream.withWatermark(time, late).groupBy(w).agg(F.count(F.lit(1)).alias("count"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select(F.col("window.start").alias(time), "mean", "min", "max", "count")


def _stateful(stream: DataFrame, key: str, order: str, value: str, keep) -> DataFrame:
    schema = stream.select(key, order, value).schema

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, last = (True, state.get[0]) if state.exists else (False, None)
        rows = pd.concat(list(frames)).sort_values(order)
        kept = []
        for v in rows[value]:
            ok, last = keep(known, last, v)
            known = True
            kept.append(ok)
        state.update((last,))
        yield rows[kept]

    kind = stream.schema[value].dataType.simpleString()
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(run, schema, f"last {kind}", "append", GroupStateTimeout.NoTimeout)


def max_delta(stream: DataFrame, key: str, order: str, value: str, delta: float) -> DataFrame:
    """For each key, the first sample and those that differ from the last kept one by no more than ``delta``."""

    def keep(known: bool, last: object, v: object) -> tuple[bool, object]:
        ok = not known or not abs(v - last) > delta
        return ok, v if ok else last

    return _stateful(stream, key, order, value, keep)


def on_change(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """For each key, samples that differ from the one before. A stream has no last sample, so that one is not added."""
    return _stateful(stream, key, order, value, lambda known, last, v: (not known or v != last, v))
