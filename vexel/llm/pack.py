"""Best-fit-decreasing packing of documents into training sequences of a fixed number of tokens."""

from __future__ import annotations

from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import by_value, need, settled, word_count

by_value(__name__)

CAPACITY = 2048
#: Pieces that are packed together; more shards, not larger ones, as the corpus grows.
SHARD = 20_000


class OpenBins:
    """A segment tree whose leaves are the capacities 0 to c: a node is true if a bin below it is open."""

    def __init__(self, c: int):
        self.half = 1 << c.bit_length()
        self.any = bytearray(2 * self.half)
        self.bins: list[list[int]] = [[] for _ in range(c + 1)]

    def put(self, left: int, number: int) -> None:
        heappush(self.bins[left], number)
        i = left + self.half
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (capacity left, number) of the tightest bin with room for ``size``; the lowest number of equals."""
        tree, i = self.any, size + self.half
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.half:
                i *= 2
                if not tree[i]:
                    i += 1
        left = i - self.half
        number = heappop(self.bins[left])
        if not self.bins[left]:
            tree[i] = 0
            while i > 1 and not tree[i ^ 1]:
                i >>= 1
                tree[i] = 0
        return left, number


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, sizes taken in the order given (descending, for best-fit decreasing)."""
    open_bins, out, made = OpenBins(capacity), [], 0
    for size in sizes:
        if found := open_bins.take(size):
            left, number = found
        else:
            left, number = capacity, made
            made += 1
        out.append(number)
        if left > size:
            open_bins.put(left - size, number)
    return out


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, tokens: str | None = None, shard: int = SHARD) -> DataFrame:
    """(shard, bin, n_tokens, doc_ids, starts, lengths): bins of at most ``capacity`` tokens; the three lists are parallel.

    A document longer than a bin is cut into pieces of ``capacity`` tokens and a rest, so whole texts are packed;
    a piece is tokens [start, start + length) of its document. The pieces are dealt at random to shards of about
    ``shard``, each packed by best-fit decreasing: the longest first, ties by id, then start. Tokens are runs of
    characters that aren't white space, or the whole number in column ``tokens``. A null or empty text, or a count
    that is null or not above 0, has nothing to pack and is in no bin. A null id is packed last of its length, as
    null. A repeated row is packed each time. An empty table gives no bins. Extra columns are not read.
    """
    need(docs, doc_id, tokens or text)
    count = F.col(tokens).cast("long") if tokens else word_count(text)
    kind = docs.schema[doc_id].dataType
    sized = docs.select(F.col(doc_id).alias("id"), count.alias("n")).filter("n > 0")
    pieces = sized.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}"))).alias("k"))
    pieces = settled(pieces.select("id", (F.col("k") * capacity).alias("start"), F.least(F.col("n") - F.col("k") * capacity, F.lit(capacity)).cast("int").alias("size")))
    shards = max(1, -(-pieces.count() // shard))
    # Copies of a row, or rows without an id, would all hash alike, so a settled row's own number goes into its shard.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "start", F.monotonically_increasing_id()), F.lit(shards)))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("id", "ascending"), ("start", "ascending")])
        bins = best_fit(table.column("size").to_pylist(), capacity)
        table = table.append_column("bin", pa.array(bins, pa.int64()))
        number = table.column("shard")[0].as_py()
        out = table.group_by("bin", use_threads=False).aggregate([("size", "sum"), ("id", "list"), ("start", "list"), ("size", "list")])
        return pa.table({"shard": pa.array([number] * len(out), pa.int64()), "bin": out["bin"], "n_tokens": out["size_sum"].cast(pa.int64()), "doc_ids": out["id_list"], "starts": out["start_list"], "lengths": out["size_list"]})

    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.IntegerType()))])
    return dealt.groupBy("shard").applyInArrow(packed, schema)
