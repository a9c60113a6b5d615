"""Passages that documents share, from suffix arrays of content-chosen shards.

Every window of ``words`` words has an anchor: its word 8-gram of the least hash.
Equal windows have equal anchors, so windows are dealt to shards by anchor, and all
occurrences of a passage meet in one shard whichever documents they are in. Only
windows whose anchor occurs in two documents go anywhere. A shard's suffix array is
made by external induced sorting, and its common-prefix values show the windows
that occur in several documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import by_value, need, settled, slices
from vexel.llm.sais import LONGEST, suffix_array
from vexel.llm.textnum import ngrams, words

by_value(__name__, "vexel.llm.common", "vexel.llm.textnum", "vexel.llm.sais")

WORDS = 50
GRAM = 8
#: Anchors of a shard, so that its text is some hundred thousand words; more shards, not larger ones, as the corpus grows.
SHARD = 6_000
#: Rows and bytes of text that are read in one go, to bound a task's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def owners(grams: np.ndarray, at: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows, place of the anchor of each), as places in the words of all texts; the leftmost of equal hashes is the anchor."""
    span = window - gram + 1
    count = np.diff(first)
    windows = np.maximum(0, count - window + 1)
    if not windows.sum():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(count)), windows)
    offset = np.arange(len(text)) - np.concatenate(([0], np.cumsum(windows)[:-1]))[text]
    start = first[:-1][text] + offset
    # Places of grams run over all texts, so that the low bits name the gram.
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.concatenate((np.minimum(low[:-width], low[width:]), low[-width:]))
        width *= 2
    g = at[:-1][text] + offset
    least = np.minimum(low[g], low[g + span - width])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return start, place - g + start


def _anchors(window: int, gram: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in slices(whole, "body", BATCH_BYTES, BATCH_ROWS):
                h, owner, first, *_ = words(batch.column("body"))
                grams, at = ngrams(h, first, gram)
                start, anchor = owners(grams, at, first, window, gram)
                if not len(start):
                    continue
                place = np.unique(anchor)
                text = owner[place]
                value = grams[at[:-1][text] + place - first[:-1][text]].view(np.int64)
                # One row a document for an anchor.
                pair = np.unique(np.rec.fromarrays([text, value], names="t,v"))
                took = pa.array(pair["t"])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(took), batch.column("h").take(took), pa.array(pair["v"])], names=["id", "h", "anchor"])

    return run


def _extracts(window: int, gram: int):
    """From documents with their shared anchors: (anchor, id, h, start, starts, body) for each run of windows of one such anchor."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in slices(whole, "body", BATCH_BYTES, BATCH_ROWS):
                h, owner, first, s, e, data, _ = words(batch.column("body"))
                grams, at = ngrams(h, first, gram)
                start, anchor = owners(grams, at, first, window, gram)
                if not len(start):
                    continue
                cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]), [True])))
                a, b = start[cut[:-1]], start[cut[1:] - 1]
                place = anchor[cut[:-1]]
                text = owner[place]
                value = grams[at[:-1][text] + place - first[:-1][text]].view(np.int64)
                listed = batch.column("anchors")
                flat, lists = listed.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(listed.offsets))
                known = np.unique(np.rec.fromarrays([np.repeat(np.arange(batch.num_rows), lists), flat], names="t,v"))
                asked = np.rec.fromarrays([text, value], names="t,v")
                pos = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                some = np.flatnonzero(known[pos] == asked)
                if not len(some):
                    continue
                a, b, text, value = a[some], b[some], text[some], value[some]
                lo, hi = s[a], e[b + window - 1]
                raw = data.tobytes()
                bodies = pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()).cast(pa.string())
                took = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(value), batch.column("id").take(took), batch.column("h").take(took), pa.array(a - first[:-1][text]), pa.array((b - a + 1).astype(np.int32)), bodies], names=["anchor", "id", "h", "start", "starts", "body"])

    return run


def repeated_starts(bodies: list[str], starts: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(extract, offset, smallest id) of each of an extract's first ``starts`` windows that occurs under two ids; ids are whole numbers."""
    # Equal extracts are one text with several ids.
    same: dict[tuple[str, int], int] = {}
    of = np.array([same.setdefault((b, int(n)), len(same)) for b, n in zip(bodies, starts, strict=True)], dtype=np.int64)
    texts, count = [k[0] for k in same], np.array([k[1] for k in same], dtype=np.int64)
    low = np.full(len(texts), np.iinfo(np.int64).max)
    high = np.full(len(texts), np.iinfo(np.int64).min)
    np.minimum.at(low, of, ids)
    np.maximum.at(high, of, ids)
    h, _, first, *_ = words(texts)
    _, rank = np.unique(h, return_inverse=True)
    size = np.diff(first)
    # A letter of its own ends each text; these are smaller than all words.
    t = np.empty(len(h) + len(texts), dtype=np.int64)
    at = first[:-1] + np.arange(len(texts))
    t[np.arange(len(h)) + np.repeat(np.arange(len(texts)), size)] = rank + len(texts)
    t[at + size] = np.arange(len(texts))
    order, lcp = suffix_array(t, window)
    group = np.cumsum(lcp < window)
    where = np.empty(len(t), dtype=np.int64)
    where[order] = group
    own = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(own)) - np.concatenate(([0], np.cumsum(count)[:-1]))[own]
    g = where[at[own] + offset]
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    most = np.full(group[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(least, g, low[own])
    np.maximum.at(most, g, high[own])
    # Back to all extracts.
    begin = np.concatenate(([0], np.cumsum(count)))
    mine = np.repeat(np.arange(len(of)), count[of])
    off = np.arange(len(mine)) - np.concatenate(([0], np.cumsum(count[of])[:-1]))[mine]
    gg = g[begin[of[mine]] + off]
    hit = least[gg] < most[gg]
    return mine[hit], off[hit], least[gg][hit]


def _shared(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kind = table.schema.field("id").type
        codes = pa.array(sorted(table.column("id").unique().to_pylist()), kind)
        ids = pc.index_in(table.column("id"), value_set=codes).combine_chunks().to_numpy().astype(np.int64)
        extract, offset, least = repeated_starts(table.column("body").to_pylist(), table.column("starts").to_numpy(), ids, window)
        start = table.column("start").to_numpy()[extract] + offset
        # Runs of adjoining windows with the same first document.
        new = np.ones(len(extract), dtype=bool)
        new[1:] = (extract[1:] != extract[:-1]) | (start[1:] != start[:-1] + 1) | (least[1:] != least[:-1])
        cut = np.flatnonzero(new)
        end = np.append(cut[1:], len(extract)) - 1
        end = end[: len(cut)]
        took = pa.array(extract[cut])
        return pa.table({"id": table.column("id").take(took), "h": table.column("h").take(took), "a": pa.array(start[cut]), "b": pa.array(start[end] + window if len(cut) else start[:0]), "first": codes.take(pa.array(least[cut]))})

    return run


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, shard: int = SHARD) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id): each stretch of a document made up of passages of ``words`` words or more that another document has too.

    Words are lower-cased runs of letters and digits, counted from 0 over the whole text; stretches are as long as they
    can be, so they don't overlap or touch. first_doc_id is the smallest id of the documents that have any window of the
    stretch, the document itself included. Null texts, shorter texts and rows without an id have none. Rows that repeat an
    id are one document: they don't make each other repeated, and one row is given for rows of the same id and text. An
    empty table gives no rows; extra columns are not read. ``words`` may be from 1 to 4,000,000,000.
    """
    need(docs, text, doc_id)
    if not 1 <= words <= LONGEST:
        raise ValueError(f"words must be from 1 to {LONGEST}, not {words}")
    gram = min(GRAM, words)
    kind = docs.schema[doc_id].dataType
    rows = docs.filter(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("body"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("h", T.LongType()), T.StructField("anchor", T.LongType())])
    # Settled, since both the count and the join read them.
    anchors = settled(rows.mapInArrow(_anchors(words, gram), schema))
    wanted = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("anchor")
    lists = settled(anchors.join(wanted, "anchor").groupBy("id", "h").agg(F.collect_set("anchor").alias("anchors")))
    found = rows.join(lists, ["id", "h"]).dropDuplicates(["id", "h"])
    number = lists.agg(F.sum(F.size("anchors"))).first()[0] or 0
    shards = max(1, -(-number // shard))
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("id", kind), T.StructField("h", T.LongType()), T.StructField("start", T.LongType()), T.StructField("starts", T.IntegerType()), T.StructField("body", T.StringType())])
    extracts = found.select("id", "h", "body", "anchors").mapInArrow(_extracts(words, gram), schema)
    dealt = extracts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).drop("anchor")
    schema = T.StructType([T.StructField("id", kind), T.StructField("h", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("first", kind)])
    runs = dealt.groupBy("shard").applyInArrow(_shared(words), schema)
    # Stretches of a document: runs that overlap or touch, put together.
    w = Window.partitionBy("id", "h").orderBy("a", "b")
    gap = F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = runs.withColumn("new", F.coalesce(gap.cast("int"), F.lit(1)))
    cut = cut.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = cut.groupBy("id", "h", "part").agg(F.min("a").alias("start_word"), F.max("b").alias("end"), F.min("first").alias("first_doc_id"))
    return out.select(F.col("id").alias("doc_id"), "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "first_doc_id")
