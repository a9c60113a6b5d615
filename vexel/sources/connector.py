"""Tables in and out of a collection with the options of a Spark source: the batch counterpart of the streams."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.plans.collection import Collection, Engine
from vexel.types import InvalidArgument, Metric, NotFound

Out = TypeVar("Out")


def load(engine: Engine, name: str, columns: list[str] | None = None, as_of: int | None = None) -> DataFrame:
    """The live rows of a collection; filters and columns asked of it reach the Parquet scan."""
    rows = engine.collection(name).live(as_of)
    return rows.select(*columns) if columns else rows


def save(df: DataFrame, engine: Engine, name: str, mode: str = "upsert", id: str = "id", vector: str = "vector", truncate: bool = False, dimension: int | None = None, metric: Metric | str = Metric.L2, num_shards: int = 1, seq: str | None = None) -> Collection:
    """Writes rows into a collection: ``upsert`` (by id) or ``stream_insert`` (appended).

    A collection that isn't there is created if ``dimension`` is given; ``truncate`` begins it anew with its old settings.
    """
    if mode not in ("upsert", "stream_insert"):
        raise InvalidArgument(f"unknown mode: {mode}")
    try:
        c = engine.collection(name)
        if truncate:
            old = c.describe()
            engine.drop_collection(name)
            c = engine.create_collection(name, old["dimension"], old["metric"], old["index_type"], old["num_shards"])
    except NotFound:
        if not dimension:
            raise InvalidArgument(f"{name} isn't there; to create it, a dimension is needed") from None
        c = engine.create_collection(name, dimension, metric, num_shards=num_shards)
    rows = df.select(F.col(id).alias("id"), F.col(vector).alias("vector"), *(F.col(f"`{x}`") for x in df.columns if x not in (id, vector)))
    if mode == "upsert":
        c.upsert(rows, seq)
    else:
        c.insert(rows)
    return c


def retried(call: Callable[[], Out], attempts: int = 4, base: float = 0.5, fatal: tuple[type[BaseException], ...] = (InvalidArgument, NotFound), sleep: Callable[[float], object] = time.sleep) -> Out:
    """The result of ``call``, tried again after base, 2 base, 4 base, ... seconds; errors of kind ``fatal`` are not tried again.

    For upserts, which may be repeated; an append may not.
    """
    for n in range(attempts):
        try:
            return call()
        except fatal:
            raise
        except Exception:
            if n + 1 == attempts:
                raise
            sleep(base * 2**n)
    raise InvalidArgument("attempts must be positive")
