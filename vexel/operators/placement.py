"""Where rows go: hash, range and ring placement, plans to even out nodes, and moving averages of their load."""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.types import InvalidArgument

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VIRTUAL = 150
SLACK = 0.2
#: Share of the old value in the moving average of a load.
KEPT = 0.7


def point(key: str) -> int:
    """60 bits of the MD5 of a key."""
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def ring(nodes: Sequence[str], virtual: int = VIRTUAL) -> list[tuple[int, str]]:
    """(point, node) rising: each node at ``virtual`` points, so that one more or less moves few keys."""
    if not nodes:
        raise InvalidArgument("nodes are needed")
    return sorted((point(f"{n}#{v}"), n) for n in nodes for v in range(virtual))


def ring_owner(df: DataFrame, nodes: Sequence[str], key: str = "id", column: str = "node", virtual: int = VIRTUAL) -> DataFrame:
    """With the node of each row: that of the first point of the ring at or after the key's, or the first of all. Null keys count as empty."""
    points = ring(nodes, virtual)
    at, names = np.array([p for p, _ in points], dtype=np.int64), pa.array([n for _, n in points])
    keyed = df.withColumn("__point", F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            own = np.searchsorted(at, batch.column(batch.num_columns - 1).to_numpy(), side="left") % len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], names.take(pa.array(own))], names=[*batch.schema.names[:-1], column])

    return keyed.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.StringType())]))


def ring_node(key: str, points: Sequence[tuple[int, str]]) -> str:
    return points[bisect_left(points, (point(key), "")) % len(points)][1]


def range_shard(key: str | Column, bounds: Sequence[int]) -> Column:
    """The number of bounds that a key has reached: shard 0 below the first, one more from each on."""
    c = F.col(key) if isinstance(key, str) else key
    out = F.lit(0)
    for b in sorted(bounds):
        out = out + F.when(c >= b, 1).otherwise(0)
    return out.cast("int")


def rebalance(shards: Mapping[int, tuple[str, int]], nodes: Sequence[str], slack: float = SLACK) -> list[tuple[int, str, str]]:
    """(shard, from, to) from the sizes of shards on nodes: nodes above the mean by more than ``slack`` give their largest
    shards, as far as these fit, to the emptiest nodes."""
    load = {n: 0 for n in nodes}
    for n, size in shards.values():
        load[n] = load.get(n, 0) + size
    mean, moves = sum(load.values()) / max(1, len(load)), []
    for s, (home, size) in sorted(shards.items(), key=lambda x: (-x[1][1], x[0])):
        to = min(load, key=lambda n: (load[n], n))
        if load[home] > mean * (1 + slack) and to != home and load[to] + size <= mean * (1 + slack):
            moves.append((s, home, to))
            load[home], load[to] = load[home] - size, load[to] + size
    return moves


def latest_average(df: DataFrame, key: str, order: Sequence[str], value: str, kept: float = KEPT) -> DataFrame:
    """(key, average): kept * old + (1 - kept) * new through a key's values in order, from the first one on; nulls are left out.

    A value counts by its age alone, so the sum is one aggregation over ranks.
    """
    rows = df.filter(F.col(value).isNotNull())
    age = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))) - 1
    aged = rows.select(key, F.col(value).cast("double").alias("__v"), age.alias("__age"))
    share = F.pow(F.lit(kept), F.col("__age"))
    first = F.max_by("__v", "__age") * F.pow(F.lit(kept), F.max("__age")) * kept
    return aged.groupBy(key).agg((F.sum(F.col("__v") * share) * (1 - kept) + first).alias("average"))
