"""BM25 full-text search and sparse dot-product search."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.operators.search import DIGITS, select_rows
from vexel.plans.filters import Node
from vexel.sources.scratch import settled
from vexel.types import DEFAULT_TOP_K, check_sparse, check_top_k

# Workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

K1, B = 1.2, 0.75


#: Runs of ASCII letters and digits, lower-cased after they are cut, so that no other letter can turn into one.
TOKEN = "[0-9A-Za-z]+"
_TOKEN = re.compile(b"[0-9a-z]+")


def _text(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def tokens(text: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(_text(text), F.lit(TOKEN), F.lit(0)), F.lower)


def token_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(_text(text), F.lit(TOKEN)), F.lit(0))


def query_terms(text: str) -> list[str]:
    out, word = [], ""
    for ch in text + " ":
        if ch.isascii() and ch.isalnum():
            word += ch.lower()
        elif word:
            out.append(word)
            word = ""
    return list(dict.fromkeys(out))


#: How a term's postings are kept: those of one part of the documents as lists side by side, in the order of the ids.
PACKED = "term string, ids array<{id}>, dls array<long>, tfs array<long>"
#: Documents, and bytes of their texts, whose postings are packed together.
PACK_ROWS, PACK_BYTES = 4096, 8 << 20


@dataclass
class TextIndex:
    """Derived tables of a corpus: postings (id, dl, term, tf), terms (term, df), and one row of totals (n, avgdl).

    Postings come from ``packed``, a row for each term and part of the documents.
    """

    packed: DataFrame
    terms: DataFrame
    totals: DataFrame

    @property
    def postings(self) -> DataFrame:
        each = self.packed.select("term", F.explode(F.arrays_zip("ids", "dls", "tfs")).alias("__p"))
        return each.select(F.col("__p.ids").alias("id"), F.col("__p.dls").alias("dl"), "term", F.col("__p.tfs").alias("tf"))

    def write(self, path: str) -> None:
        """As Parquet; postings are clustered by term, so that a search reads few row groups."""
        self.packed.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        # What is counted from here on is read from the sorted table, where a term's rows lie together.
        stored = TextIndex(self.packed.sparkSession.read.parquet(f"{path}/postings"), self.terms, self.totals)
        _terms(stored.packed).sort("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def read(cls, spark, path: str) -> TextIndex:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "totals")))


def _terms(packed: DataFrame) -> DataFrame:
    return packed.groupBy("term").agg(F.sum(F.size("ids").cast("long")).alias("df"))


def pack(ids: pa.Array, texts: Sequence[str | None]) -> pa.Table:
    """The postings of some documents, a row a term."""
    docs: list[int] = []
    words: list[bytes] = []
    tfs: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        # Bytes: letters other than ASCII ones neither match nor turn into one that does.
        found = _TOKEN.findall(text.encode().lower()) if text else []
        if found:
            count = Counter(found)
            lengths[i] = len(found)
            words += count
            tfs += count.values()
            docs += [i] * len(count)
    doc, tf, coded = np.array(docs, np.int64), np.array(tfs, np.int64), pa.array(words, pa.binary()).dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, v) for v in (ids.take(pa.array(doc[order])), pa.array(lengths[doc[order]]), pa.array(tf[order]))]
    return pa.table([coded.dictionary.cast(pa.string()), *lists], names=["term", "ids", "dls", "tfs"])


def text_index(df: DataFrame, id: str = "id", text: str = "text") -> TextIndex:
    """Documents without a token are not counted. Packed postings are settled, since terms and every search read them.

    A text is cut and counted where it is read: what is shuffled are lists, and only by ``write``. Where ids are repeated,
    the words of equally long rows of an id are counted together, which takes a shuffle of all words.
    """
    docs = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    totals = df.select(token_count(text).alias("dl")).filter("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    if docs.agg(F.count("*") > F.count_distinct(F.struct("id"))).first()[0]:
        cut = docs.select("id", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tk"))
        words = cut.select("id", F.size("tk").cast("long").alias("dl"), F.explode("tk").alias("word"))
        counts = words.groupBy("id", "dl", F.lower("word").alias("term")).agg(F.count("*").alias("tf"))
        packed = settled(counts.select("term", F.array("id").alias("ids"), F.array("dl").alias("dls"), F.array("tf").alias("tfs")))
        return TextIndex(packed, _terms(packed), totals)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = pack(pa.array(ids, kind), texts)
            ids.clear()
            texts.clear()
            yield from out.to_batches(max_chunksize=8192)

        for batch in stream:
            kind = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t or "")
                if len(ids) >= PACK_ROWS or held >= PACK_BYTES:
                    yield from flush()
                    held = 0
        if ids:
            yield from flush()

    packed = settled(docs.mapInArrow(run, PACKED.format(id=docs.schema["id"].dataType.simpleString())))
    return TextIndex(packed, _terms(packed), totals)


def _score(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def search_index(index: TextIndex, query: str, k: int = DEFAULT_TOP_K) -> DataFrame:
    """(id, score) from a built index, best first, ties by id; only documents with a term of the query."""
    terms = query_terms(query)
    hit = index.postings.filter(F.col("term").isin(terms) if terms else F.lit(False))
    df = index.terms.filter(F.col("term").isin(terms) if terms else F.lit(False))
    rows = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(index.totals))
    scored = rows.groupBy("id").agg(F.round(F.sum(_score(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"))), DIGITS).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(check_top_k(k))


def counted(rows: DataFrame, text: str, terms: list[str], keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` of every row and what BM25 needs of its text: dl, its tokens, and tf0, tf1, ..., how often it has each term.

    A text is cut into tokens once; they are counted where they are cut, and only counts are shuffled.
    """
    word = F.explode_outer(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("__word")
    cut = rows.select(*(c.alias(n) for n, c in keep.items()), F.monotonically_increasing_id().alias("__row"), F.col(text)).select("__row", *keep, word)
    have = (F.count_if(F.lower("__word") == t).alias(f"tf{i}") for i, t in enumerate(terms))
    return settled(cut.groupBy("__row", *keep).agg(F.count("__word").alias("dl"), *have).drop("__row"))


def score_counted(counts: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(id, score), best first, ties by id, from a table of ``counted``."""
    docs, n = counts.filter("dl > 0"), len(terms)
    totals = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n)))
    rows = docs.filter(" or ".join(f"tf{i} > 0" for i in range(n)) or "false").crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(n):
        score = score + F.when(F.col(f"tf{i}") > 0, _score(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("dl"), F.col("n"), F.col("avgdl"))).otherwise(0.0)
    return rows.select("id", F.round(score, DIGITS).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def bm25(df: DataFrame, query: str, k: int = DEFAULT_TOP_K, filter: str | Node | None = None, as_of: int | None = None, id: str = "id", text: str = "text") -> DataFrame:
    """(id, score) straight from the texts, which are read once: a narrow table of counts has the statistics and the scores.

    Statistics are of the rows that are searched, filter and expiry applied.
    """
    terms = query_terms(query)
    return score_counted(counted(select_rows(df, filter, as_of), text, terms, {"id": F.col(id)}), terms, check_top_k(k))


def sparse_columns(sparse: str, query: Mapping[int, float]) -> tuple[Column, Column]:
    """(dot product with a sparse query, do they share an index); a row's few entries are summed in place, nothing is exploded."""
    pairs = check_sparse(sorted((int(i), float(v)) for i, v in query.items()))
    if not pairs:
        return F.lit(0.0), F.lit(False)
    weight = F.create_map(*(c for i, v in pairs for c in (F.lit(i).cast("long"), F.lit(v))))
    wanted = F.array(*(F.lit(i).cast("long") for i, _ in pairs))
    shared = F.filter(sparse, lambda e: F.array_contains(wanted, e["idx"].cast("long")))
    score = F.aggregate(shared, F.lit(0.0), lambda s, e: s + e["val"].cast("double") * weight[e["idx"].cast("long")])
    return F.round(score, DIGITS), F.exists(sparse, lambda e: F.array_contains(wanted, e["idx"].cast("long")))


def sparse_search(df: DataFrame, query: Mapping[int, float], k: int = DEFAULT_TOP_K, filter: str | Node | None = None, as_of: int | None = None, id: str = "id", sparse: str = "sparse") -> DataFrame:
    """(id, score): the largest dot products with a sparse query, among rows that share an index with it; ties by id."""
    score, meets = sparse_columns(sparse, query)
    rows = select_rows(df, filter, as_of).filter(meets)
    return rows.select(F.col(id).alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(check_top_k(k))
