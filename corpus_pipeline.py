"""The training-data pipeline: from the documents table to packed training sequences.

STAGES lists its stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is to be written as
Parquet and read again as the docs of the next. The scratch tables of a stage are deleted when the next one begins.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from vexel.llm.common import delete, shared_dir, written
from vexel.llm.crf import quality_filter
from vexel.llm.exact import exact_dedup as _exact_dedup
from vexel.llm.mix import mix_documents
from vexel.llm.ngramjoin import near_dedup as _near_dedup
from vexel.llm.pack import pack

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_SCRATCH: list[str] = []


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _SCRATCH)
        before = set(written())
        out = f(spark, docs, sf_dir)
        _SCRATCH[:] = [] if f is _LAST else [p for p in written() if p not in before]
        return out

    return run_stage


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null, empty and blank texts have quality 0 and go, unless no labels of both kinds are there, when the cut is 0.5 of a
    model that says good: then texts with a line stay. Very long texts are scored whole. Equal texts, so repeated rows,
    stand or fall together. Null ids play no part; extra columns are kept. No rows give none.
    """
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays, that of the smallest id.

    Null texts all stay; a row without an id comes after all that have one. Empty texts are equal to each other, as are
    very long ones if they are to the last byte. Of rows that repeat an id and text one stays. Extra columns are kept. No
    rows give none.
    """
    return _exact_dedup(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that of the smallest id.

    Null texts, texts without a word and rows without an id all stay. Whole texts are compared, however long. Rows that
    repeat an id and text stand or fall together. Extra columns are kept. No rows give none.
    """
    return _near_dedup(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources are repeated until the sources have their target weights; none is lost.

    A null source is a source of its own. Null and empty texts go with the block at their place, very long ones with the
    block that they begin in. Ties of the shuffle go by id, then length; repeated rows each have a place. Extra columns
    are kept. No rows give none.
    """
    return mix_documents(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of training sequences, with the documents in each.

    Null and empty texts are in no bin; long ones are cut into pieces that fill bins. Pieces of a length go by id, then
    start, null ids last; repeated rows are packed each. Extra columns are not read. No rows give no bins.
    """
    return pack(docs)


_LAST = _pack

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", _stage(_quality)),
    ("exact_dedup", _stage(_exact)),
    ("ngram_jaccard_join", _stage(_near)),
    ("mix_sources", _stage(_mix)),
    ("best_fit_packing", _stage(_pack)),
]

#: A trained classifier, MinHash and packing can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
