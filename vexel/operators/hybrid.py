"""Weighted reciprocal-rank fusion of dense, text and sparse search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.operators.search import DIGITS, measured, select_rows
from vexel.operators.text import counted, query_terms, score_counted, sparse_columns
from vexel.plans.filters import Node
from vexel.sources.scratch import settled
from vexel.types import DEFAULT_TOP_K, InvalidArgument, Metric, check_top_k

RANK_CONSTANT = 60
DEEPER = 3


def fuse(legs: Sequence[tuple[DataFrame, float]], k: int) -> DataFrame:
    """(id, score): the sum over legs (id, rank) of weight / (60 + rank), best first, ties by id."""
    parts = [d.select("id", (F.lit(float(w)) / (RANK_CONSTANT + F.col("rank"))).alias("part")) for d, w in legs]
    total = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    return total.orderBy(F.desc("score"), "id").limit(k)


def with_rank(limited: DataFrame, *order: Column | str) -> DataFrame:
    """Ranks from 1 on a table that is limited already, so that one task holding it is no burden."""
    return limited.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def hybrid(df: DataFrame, vector: Sequence[float] | None = None, text: str | None = None, sparse: Mapping[int, float] | None = None, k: int = DEFAULT_TOP_K, metric: Metric | str = Metric.L2, vector_weight: float | None = None, text_weight: float | None = None, sparse_weight: float | None = None, filter: str | Node | None = None, as_of: int | None = None, id: str = "id", vector_column: str = "vector", text_column: str = "text", sparse_column: str = "sparse") -> DataFrame:
    """(id, score) of the k best by fused ranks; each leg gives its 3k best.

    Weights default to 0.5, 0.5 and, for the sparse leg, 0.5 where it is asked for; 0 or less turns a leg off. At least
    one leg is needed. The filter applies before any ranking. The rows are read once, for a narrow table of distances,
    counts and products that all legs rank.
    """
    check_top_k(k)
    weights = [0.5 if w is None else float(w) for w in (vector_weight, text_weight, sparse_weight)]
    rows = select_rows(df, filter, as_of)
    columns, terms = {"id": F.col(id)}, query_terms(text or "")
    dense, lexical, sparsely = vector is not None and weights[0] > 0, text is not None and weights[1] > 0, sparse is not None and weights[2] > 0
    if not (dense or lexical or sparsely):
        raise InvalidArgument("a vector, a text or a sparse vector with a positive weight is needed")
    if dense:
        columns["distance"] = measured(vector, metric, vector_column)
    if sparsely:
        columns["product"], columns["meets"] = sparse_columns(sparse_column, sparse)
    narrow = counted(rows, text_column, terms, columns) if lexical else settled(rows.select(*(c.alias(n) for n, c in columns.items())))
    legs: list[tuple[DataFrame, float]] = []
    if dense:
        legs.append((with_rank(narrow.select("id", "distance").orderBy("distance", "id").limit(DEEPER * k), "distance", "id"), weights[0]))
    if lexical:
        legs.append((with_rank(score_counted(narrow, terms, DEEPER * k), F.desc("score"), "id"), weights[1]))
    if sparsely:
        best = narrow.filter("meets").select("id", F.col("product").alias("score")).orderBy(F.desc("score"), "id").limit(DEEPER * k)
        legs.append((with_rank(best, F.desc("score"), "id"), weights[2]))
    return fuse(legs, k)
