"""Set-similarity self-join of documents on the Jaccard coefficient of their word n-grams.

MinHash bands propose pairs. Each pair is then compared a few MinHash values at a
time and dropped once the posterior probability that it reaches the threshold is
below a tolerance; what survives is verified on the whole n-gram sets.

Documents with the same n-gram set are one node throughout, so thousands of copies
cost as much as one. A bucket of many nodes is cut into tiles of node blocks, so no
task takes more than two blocks of it, and every pair falls into exactly one tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import batches_of, by_value, fresh, need, settled, slices
from vexel.llm.components import components
from vexel.llm.textnum import mix, ngrams, words

by_value(__name__, "vexel.llm.common", "vexel.llm.textnum")

N, THRESHOLD, TOLERANCE = 3, 0.5, 1e-3
#: Rows of a band and bands: a pair at the threshold of 0.5 is proposed with probability 1 - (1 - 0.5 ** 3) ** 42 = 0.996.
ROWS, BANDS = 3, 42
STEP = 18
BLOCK = 1024
VERIFY_ROWS = 400
#: Rows and bytes of text that are hashed in one go, to bound a task's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def minhash_seeds(k: int = ROWS * BANDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def gram_sets(texts, n: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    h, _, first, *_ = words(texts)
    g, at = ngrams(h, first, n)
    return [np.unique(g[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of 16 bits each."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(low, (a[:, None] * x[None, i : i + 4096] + b[:, None]).min(axis=1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band: its number, then its MinHash values; the values can be read back from the keys."""
    v = sig.reshape(-1, rows).astype(np.int64)
    return (np.arange(len(v), dtype=np.int64) << 48) | (v[:, 0] << 32) | (v[:, 1] << 16) | v[:, 2]


def least_matches(step: int, total: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(compared, fewest matches to go on): fewer leave P(J >= threshold) below the tolerance, from a uniform prior.

    With s of m values equal the posterior is Beta(s + 1, m - s + 1), so P(J >= t) = P(Binomial(m + 1, t) <= s).
    """
    out = []
    for m in range(step, total + 1, step):
        below, s = 0.0, -1
        while below < tolerance:
            s += 1
            below += math.comb(m + 1, s) * threshold**s * (1 - threshold) ** (m + 1 - s)
        out.append((m, s))
    return out


def _signed(n: int):
    a, b = minhash_seeds()

    def signed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch, "body", BATCH_BYTES, BATCH_ROWS):
                sets = gram_sets(part.column("body"), n)
                some = [i for i, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                node, keys = [], np.empty((len(some), BANDS), dtype=np.int64)
                for j, i in enumerate(some):
                    s = sets[i]
                    node.append(np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)]).tobytes())
                    keys[j] = band_keys(signature(s, a, b))
                took = part.take(pa.array(some))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([took.column("id"), took.column("h"), pa.array(node, pa.binary()), listed], names=["id", "h", "node", "keys"])

    return signed


def _pruned(threshold: float, tolerance: float):
    rule = least_matches(STEP, ROWS * BANDS, threshold, tolerance)

    def pruned(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(stream, "tile"):
            table = table.combine_chunks()
            tile = table.column("tile").to_numpy()
            key = table.column("key").to_numpy()
            nid = table.column("nid").to_numpy()
            block, alone = table.column("block").to_numpy(), table.column("alone").to_numpy()
            keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            sig = np.stack([(keys >> 32) & 0xFFFF, (keys >> 16) & 0xFFFF, keys & 0xFFFF], axis=2).reshape(len(keys), -1).astype(np.uint16)
            end = np.searchsorted(tile, tile, side="right")
            count = end - np.arange(len(tile)) - 1
            at = np.concatenate(([0], np.cumsum(count)))
            i = 0
            while i < len(tile):
                upto = max(i + 1, int(np.searchsorted(at, at[i] + 100_000, side="right")) - 1)
                rows = np.arange(i, upto)
                left = np.repeat(rows, count[i:upto])
                right = left + 1 + np.arange(len(left)) - (at[left] - at[i])
                i = upto
                ok = (key[left] == key[right]) & (alone[left] | (block[left] != block[right]))
                left, right = left[ok], right[ok]
                if not len(left):
                    continue
                # A pair is handled in the first band in which it meets.
                ok = np.argmax(keys[left] == keys[right], axis=1) == key[left] >> 48
                left, right = left[ok], right[ok]
                done, match = 0, np.zeros(len(left), dtype=np.int32)
                for m, least in rule:
                    match += (sig[left, done:m] == sig[right, done:m]).sum(axis=1, dtype=np.int32)
                    done = m
                    ok = match >= least
                    left, right, match = left[ok], right[ok], match[ok]
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(nid[left], nid[right])), pa.array(np.maximum(nid[left], nid[right])), pa.array(tile[left])], names=["a", "b", "tile"])

    return pruned


def _verified(n: int, threshold: float):
    def verified(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        ids = texts.column("nid").to_pylist()
        sets = dict(zip(ids, gram_sets(texts.column("body"), n), strict=True))
        a, b, out = pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), []
        for x, y in zip(a, b, strict=True):
            s, t = sets[x], sets[y]
            if min(len(s), len(t)) < threshold * max(len(s), len(t)):
                out.append(0.0)
                continue
            if len(s) > len(t):
                s, t = t, s
            pos = np.minimum(np.searchsorted(t, s), len(t) - 1)
            both = int((t[pos] == s).sum())
            out.append(both / (len(s) + len(t) - both))
        j = np.array(out, dtype=np.float64)
        ok = np.flatnonzero(j >= threshold)
        return pa.table({"a": pairs.column("a").take(ok), "b": pairs.column("b").take(ok), "jaccard": pa.array(j[ok])})

    return verified


def _nodes(docs: DataFrame, text: str, doc_id: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(nid, id, h, keys) for each distinct n-gram set, and (nid, id, h) for each document, both settled."""
    kind = docs.schema[doc_id].dataType
    rows = docs.filter(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("body"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("h", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    signed = settled(rows.mapInArrow(_signed(n), schema))
    nodes = signed.groupBy("node").agg(F.min(F.struct("id", "h")).alias("rep"), F.first("keys").alias("keys"))
    nodes = settled(nodes.select(F.monotonically_increasing_id().alias("nid"), "node", "rep.id", "rep.h", "keys"))
    members = signed.select("id", "h", "node").distinct().join(nodes.select("nid", "node"), "node").select("nid", "id", "h")
    return nodes.drop("node"), settled(members)


def _node_pairs(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, n: int, threshold: float, tolerance: float, block: int) -> DataFrame:
    """(a, b, jaccard) for pairs of nodes, settled."""
    spark = docs.sparkSession
    band = nodes.select("nid", F.explode("keys").alias("key"))
    # The size of a bucket is counted map-side; nodes are dealt to its blocks by hash, so no task holds a bucket.
    counts = band.groupBy("key").agg(F.count("*").alias("cnt")).filter("cnt > 1").select("key", F.expr(f"cast((cnt - 1) div {block} as int)").alias("last"))
    met = band.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("last") + 1).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    met = met.select("key", "nid", "block", (lo == hi).alias("alone"), F.when(F.col("last") == 0, F.col("key")).otherwise(F.xxhash64("key", lo, hi)).alias("tile"))
    tiles = met.join(nodes.select("nid", "keys"), "nid").repartition("tile").sortWithinPartitions("tile", "nid")
    near = settled(tiles.mapInArrow(_pruned(threshold, tolerance), "a long, b long, tile long"))
    rows = near.count()
    if not rows:
        return spark.createDataFrame([], "a long, b long, jaccard double")
    # Tiles are gathered into bins of a few hundred pairs, each one call in Python.
    bins = max(1, rows // VERIFY_ROWS)
    near = near.withColumn("bin", F.pmod(F.xxhash64("tile"), F.lit(bins)))
    asked = near.select("bin", F.explode(F.array("a", "b")).alias("nid")).distinct().join(nodes.select("nid", "id", "h"), "nid")
    body = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("body"))
    # A document that is asked for in many bins is looked up once.
    once = asked.groupBy("id", "h").agg(F.collect_set(F.struct("bin", "nid")).alias("to"))
    found = body.join(once, ["id", "h"]).dropDuplicates(["id", "h"]).select(F.explode("to").alias("to"), "body").select("to.bin", "to.nid", "body")
    return settled(near.groupBy("bin").cogroup(found.groupBy("bin")).applyInArrow(_verified(n, threshold), "a long, b long, jaccard double"))


def ngram_jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: every pair of documents whose n-gram sets have a Jaccard coefficient of ``threshold`` or more.

    n-grams are of lower-cased words, over the whole text; a text of fewer than n words has one, of all its words.
    Null texts, texts without a word and rows without an id are in no pair. Rows that repeat an id and text are one
    document; if an id has several texts, a pair gets the largest of their coefficients and no document pairs with
    itself. Ties need no rule, since all pairs are given. An empty table gives none; extra columns are not read.
    """
    need(docs, text, doc_id)
    nodes, members = _nodes(docs, text, doc_id, n)
    near = _node_pairs(docs, nodes, text, doc_id, n, threshold, tolerance, block)
    a, b = members.select(F.col("nid").alias("a"), F.col("id").alias("x")), members.select(F.col("nid").alias("b"), F.col("id").alias("y"))
    across = near.join(a, "a").join(b, "b").select("x", "y", "jaccard")
    shared = members.groupBy("nid").count().filter("count > 1").select(F.col("nid").alias("b"))
    within = a.join(members.join(shared, members["nid"] == shared["b"], "left_semi").select(F.col("nid").alias("a"), F.col("id").alias("y")), "a").filter("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    both = across.unionByName(within).filter("x <> y")
    return both.groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))


def ngram_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, links): one row for each document that reaches ``threshold`` with another one.

    links is the number of documents it does so with, class_id the smallest id of all that can be reached by links. It
    tells what ``ngram_jaccard_join`` finds without a row for each pair: copies are counted, not paired.

    A document is an id with a text: rows that repeat both are one, and texts of one id are several, each with a row.
    Null texts, texts without a word and rows without an id have no links, so no row. Ties need no rule. An empty table
    gives none; extra columns are not read.
    """
    need(docs, text, doc_id)
    nodes, members = _nodes(docs, text, doc_id, n)
    near = _node_pairs(docs, nodes, text, doc_id, n, threshold, tolerance, block)
    labels = components(near)
    own = members.groupBy("nid").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    ends = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = ends.join(own.select(F.col("nid").alias("b"), "copies"), "b").groupBy(F.col("a").alias("nid")).agg(F.sum("copies").alias("far"))
    named = own.join(labels, own["nid"] == labels["node"], "left").select("nid", "copies", "least", F.coalesce("label", "nid").alias("label"))
    named = settled(named.join(far, "nid", "left").withColumn("links", F.col("copies") - 1 + F.coalesce("far", F.lit(0))).filter("links > 0").select("nid", "label", "least", "links"))
    classes = named.groupBy("label").agg(F.min("least").alias("class_id"))
    linked = named.join(classes, "label").select("nid", "class_id", "links")
    return members.join(linked, "nid").select(F.col("id").alias("doc_id"), "class_id", "links")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest id.

    A group is a connected component of the pairs of ``ngram_jaccard_join``, documents with equal n-gram sets included.
    Documents in no pair stay, so do null texts, texts without a word and rows without an id. Rows that repeat an id
    and text stand or fall together. All columns are returned; extra ones play no part, whatever their names.
    """
    need(docs, text, doc_id)
    nodes, members = _nodes(docs, text, doc_id, n)
    near = _node_pairs(docs, nodes, text, doc_id, n, threshold, tolerance, block)
    labels = components(near)
    own = members.join(labels, members["nid"] == labels["node"], "left").select(F.coalesce("label", "nid").alias("label"), "id", "h")
    keep = own.groupBy("label").agg(F.min("id").alias("keep"), F.count("*").alias("of")).filter("of > 1")
    gone = own.join(keep, "label").filter("id <> keep").select("id", "h").distinct()
    i, h = fresh(docs, "id", "h")
    gone = gone.select(F.col("id").alias(i), F.col("h").alias(h))
    return docs.join(gone, (F.col(doc_id) == F.col(i)) & (F.xxhash64(text) == F.col(h)), "left_anti")
