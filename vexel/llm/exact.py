"""Exact deduplication by distributed most-significant-byte-first radix partitioning.

Documents are split by their leading bytes; a part that is still too large for a
task is split again by the bytes that follow, as often as it takes. What is left
is finished inside the tasks by the same recursion over successive bytes, until a
group is a single document or its documents have ended. Only bytes are compared:
no digest decides that two texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import batches_of, by_value, fresh, need, octets

by_value(__name__, "vexel.llm.common")

#: Bytes by which documents are first split, and the factor for each further split.
FIRST_BYTES, WIDEN = 64, 4
#: A part of more bytes than this is split again before a task takes it.
PART_BYTES = 64 << 20


def radix_groups(texts: list[bytes], width: int = 16) -> list[list[int]]:
    """The groups of equal texts, of two members at least, by recursion over successive bytes."""
    out = []
    todo = [(list(range(len(texts))), 0, width)]
    while todo:
        members, at, w = todo.pop()
        parts: dict[bytes, list[int]] = {}
        for i in members:
            parts.setdefault(texts[i][at : at + w], []).append(i)
        for piece, same in parts.items():
            if len(same) == 1:
                continue
            if len(piece) < w:  # they ended here, all with the same bytes
                out.append(same)
            else:
                todo.append((same, at + w, w * 2))
    return out


def _split(docs: DataFrame, text: str, first: int, part_bytes: int) -> tuple[DataFrame, str, str]:
    """``docs`` with the leading bytes that place each row, and how many bytes that rule takes at most."""
    key, width, hot = fresh(docs, "key", "width", "hot")
    keyed = docs.withColumns({width: F.lit(first), key: F.substring(octets(text), 1, first)})
    level = first
    while True:
        sizes = keyed.filter((F.col(width) == level) & (F.octet_length(text) >= level)).groupBy(key).agg(F.sum(F.octet_length(text) + 64).alias(hot))
        large = sizes.filter(F.col(hot) > part_bytes).select(key, F.lit(True).alias(hot))
        if large.isEmpty():
            return keyed, key, width
        level *= WIDEN
        again = F.coalesce(F.col(hot), F.lit(False))
        keyed = keyed.join(large, key, "left").withColumns({key: F.when(again, F.substring(octets(text), 1, level)).otherwise(F.col(key)), width: F.when(again, level).otherwise(F.col(width))}).drop(hot)


def _order(doc_id: str):
    return F.struct(F.col(doc_id).isNull(), F.col(doc_id))


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first_bytes: int = FIRST_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Pairs (keep_id, copy_id): every document whose text equals, byte for byte, that of a document with a smaller id.

    keep_id is the smallest id of the group. Null texts equal nothing; empty texts equal each other. A row without
    an id is in no pair. Rows that repeat an id with the same text are one document, so give no pair. Very long
    texts are compared to their end. An empty table gives an empty result; extra columns are not read.
    """
    need(docs, text, doc_id)
    kind = docs.schema[doc_id].dataType
    rows = docs.filter(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("body"))
    keyed, key, width = _split(rows, "body", first_bytes, part_bytes)
    ended = keyed.filter(F.octet_length("body") < F.col(width)).select("id", key)
    keep = ended.groupBy(key).agg(F.min("id").alias("keep_id"), F.max("id").alias("most")).filter("keep_id < most").drop("most")
    short = ended.join(keep, key).filter(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id")).distinct()
    long = keyed.filter(F.octet_length("body") >= F.col(width)).select(F.col(key), "id", octets("body").alias("body")).repartition(key).sortWithinPartitions(key)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("keep_id", kind), T.StructField("copy_id", kind)])

    def pairs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(stream, key):
            ids = table.column("id").to_pylist()
            left, right = [], []
            for group in radix_groups(table.column("body").to_pylist()):
                own = sorted({ids[i] for i in group})
                left += [own[0]] * (len(own) - 1)
                right += own[1:]
            if left:
                t = table.schema.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(left, t), pa.array(right, t)], names=["keep_id", "copy_id"])

    return long.mapInArrow(pairs, schema).unionByName(short)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first_bytes: int = FIRST_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with one row of each text, that with the smallest id; all columns are returned.

    Null texts equal nothing, so all their rows stay; of the empty texts one stays. A null id comes after every
    other; among rows of the same id and text any one stays. Extra columns play no part, whatever their names.
    """
    need(docs, text, doc_id)
    keyed, key, width = _split(docs, text, first_bytes, part_bytes)
    size = F.octet_length(text)
    null = docs.filter(F.col(text).isNull())
    row = fresh(keyed, "row")[0]
    ended = keyed.filter(size < F.col(width)).groupBy(key).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), _order(doc_id)).alias(row)).select(f"{row}.*")
    long = keyed.filter(size >= F.col(width)).drop(width).repartition(key).sortWithinPartitions(key)
    names = docs.columns

    def kept(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(stream, key):
            texts = table.column(text).cast(pa.large_binary()).to_pylist()
            ids = table.column(doc_id).to_pylist()
            gone = [False] * len(ids)
            for group in radix_groups(texts):
                best = min(group, key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, i))
                for i in group:
                    gone[i] = i != best
            yield from table.select(names).filter(pa.array([not g for g in gone])).combine_chunks().to_batches()

    return long.mapInArrow(kept, docs.schema).unionByName(ended).unionByName(null)
