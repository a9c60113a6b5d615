"""Changes of a table of rows as plans: insert, upsert, get, delete, metadata, expiry, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.operators.search import live
from vexel.types import MAX_IDS, InvalidArgument, check_id


def latest(batch: DataFrame, seq: Column | str | None, id: str = "id") -> DataFrame:
    """One row an id: that with the greatest ``seq`` (any one of equals); without it the last one in the order of the batch."""
    order = F.monotonically_increasing_id() if seq is None else seq if isinstance(seq, Column) else F.col(seq)
    row = F.max_by(F.struct(*(F.col(f"`{c}`") for c in batch.columns)), F.col("__order"))
    return batch.withColumn("__order", order).groupBy(F.col(id).alias("__id")).agg(row.alias("__row")).select("__row.*")


def upsert(existing: DataFrame, batch: DataFrame, seq: Column | str | None = None, id: str = "id") -> DataFrame:
    """Whole rows replaced by id, others added; a column that one side lacks is null there."""
    new = latest(batch, seq, id)
    return existing.join(new.select(id), id, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_counts(existing: DataFrame, batch: DataFrame, id: str = "id") -> DataFrame:
    """One row (inserted, updated), by distinct ids of the batch."""
    known = existing.select(id).distinct().withColumn("__known", F.lit(True))
    flags = batch.select(id).distinct().join(known, id, "left")
    return flags.agg(F.count_if(F.col("__known").isNull()).alias("inserted"), F.count_if(F.col("__known").isNotNull()).alias("updated"))


def _ids(df: DataFrame, ids: Sequence[int]) -> DataFrame:
    if not 1 <= len(ids) <= MAX_IDS:
        raise InvalidArgument(f"from 1 to {MAX_IDS} ids, not {len(ids)}")
    return df.sparkSession.createDataFrame([(k, check_id(int(i))) for k, i in enumerate(ids)], "ordinal int, id long")


def get(df: DataFrame, ids: Sequence[int], as_of: int | None = None, id: str = "id") -> DataFrame:
    """The rows of the ids, in the order asked; expired ones are not there. Of several rows of an id one is given."""
    wanted = _ids(df, ids)
    rows = live(df, as_of).filter(F.col(id).isin([int(i) for i in set(ids)])).dropDuplicates([id])
    return wanted.join(rows.withColumn("__id", F.col(id)).drop(*([id] if id == "id" else [])), wanted["id"] == F.col("__id")).orderBy("ordinal").drop("ordinal", "__id")


def not_found(df: DataFrame, ids: Sequence[int], as_of: int | None = None, id: str = "id") -> DataFrame:
    """(id) of those asked that aren't there, in the order asked."""
    there = live(df, as_of).filter(F.col(id).isin([int(i) for i in set(ids)])).select(F.col(id).cast("long").alias("id"))
    return _ids(df, ids).join(there, "id", "left_anti").orderBy("ordinal").select("id")


def delete(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return df.join(ids.select(id), id, "left_anti")


def update_metadata(df: DataFrame, changes: DataFrame, merge: bool = True, id: str = "id", fixed: Sequence[str] = ("vector", "sparse", "expires_at")) -> DataFrame:
    """New values of metadata columns by id. Merging keeps the old value where the new one is null; else it is replaced by null."""
    given = [c for c in changes.columns if c != id]
    if not given:
        raise InvalidArgument("no metadata given")
    meta = [c for c in df.columns if c != id and c not in fixed]
    new = latest(changes, None, id).select(F.col(id), *(F.col(f"`{c}`").alias(f"__new_{c}") for c in given), F.lit(True).alias("__hit"))
    both = df.join(new, id, "left")
    out = []
    for c in dict.fromkeys([*df.columns, *given]):
        if c in given:
            old = F.col(f"`{c}`") if c in df.columns else F.lit(None)
            fresh = F.col(f"`__new_{c}`")
            out.append(F.when(F.col("__hit"), F.coalesce(fresh, old) if merge else fresh).otherwise(old).alias(c))
        elif c in meta and not merge:
            out.append(F.when(F.col("__hit").isNull(), F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return both.select(*out)


def sweep(df: DataFrame, as_of: int) -> DataFrame:
    """Without the rows that have expired."""
    return live(df, as_of)


def expired_count(df: DataFrame, as_of: int) -> DataFrame:
    return df.agg(F.count_if(F.col("expires_at") <= as_of).alias("expired"))


def page(df: DataFrame, limit: int = 20, offset: int = 0, as_of: int | None = None, id: str = "id") -> DataFrame:
    """Rows in the order of their ids."""
    if limit < 1 or offset < 0:
        raise InvalidArgument("limit must be positive and offset not negative")
    return live(df, as_of).orderBy(id).offset(offset).limit(limit)


def shard_of(id: str | Column, shards: int) -> Column:
    return F.pmod(F.col(id) if isinstance(id, str) else id, F.lit(shards)).cast("int")


def shard_counts(df: DataFrame, shards: int, id: str = "id") -> DataFrame:
    return df.groupBy(shard_of(id, shards).alias("shard")).agg(F.count("*").alias("rows"))


def divergence(a: DataFrame, b: DataFrame, shards: int, id: str = "id") -> DataFrame:
    """(shard, rows_a, rows_b) of the shards whose counts differ between two copies."""
    left, right = shard_counts(a, shards, id).withColumnRenamed("rows", "rows_a"), shard_counts(b, shards, id).withColumnRenamed("rows", "rows_b")
    both = left.join(right, "shard", "full_outer").select("shard", F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"))
    return both.filter("rows_a <> rows_b")


def rank_latest(df: DataFrame, id: str, seq: str) -> DataFrame:
    """The latest version of each id by a window, where all columns are wanted in order."""
    w = Window.partitionBy(id).orderBy(F.desc(seq))
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
