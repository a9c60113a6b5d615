"""Who may do what, and a record of what was done."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.types import EngineError, InvalidArgument


class PermissionDenied(EngineError):
    pass


class Permission(str, Enum):
    CREATE_COLLECTION = "create_collection"
    DROP_COLLECTION = "drop_collection"
    LIST_COLLECTIONS = "list_collections"
    INSERT = "insert"
    STREAM_INSERT = "stream_insert"
    UPSERT = "upsert"
    DELETE = "delete"
    UPDATE_METADATA = "update_metadata"
    SEARCH = "search"
    RANGE_SEARCH = "range_search"
    HYBRID_SEARCH = "hybrid_search"
    GET = "get"
    LIST_ROWS = "list_rows"


_DEFINE = frozenset({Permission.CREATE_COLLECTION, Permission.DROP_COLLECTION})
_CHANGE = frozenset({Permission.INSERT, Permission.STREAM_INSERT, Permission.UPSERT, Permission.DELETE, Permission.UPDATE_METADATA})
ROLES: Mapping[str, frozenset[Permission]] = {
    "admin": frozenset(Permission),
    "readwrite": frozenset(Permission) - _DEFINE,
    "collection_admin": frozenset(Permission) - _DEFINE,
    "readonly": frozenset(Permission) - _DEFINE - _CHANGE,
}


@dataclass(frozen=True)
class Grant:
    """A role on some collections; "*" stands for all, and an admin has all in any case."""

    user: str
    role: str
    collections: frozenset[str] = frozenset({"*"})


class Policy:
    def __init__(self, grants: Sequence[Grant]):
        for g in grants:
            if g.role not in ROLES:
                raise InvalidArgument(f"unknown role: {g.role}")
            if not g.user:
                raise InvalidArgument("a user is needed")
        self.grants = list(grants)

    def allows(self, user: str, permission: Permission | str, collection: str | None = None) -> bool:
        wanted = Permission(permission)
        return any(g.user == user and wanted in ROLES[g.role] and (g.role == "admin" or not collection or bool({"*", collection} & g.collections)) for g in self.grants)


def audit_line(user: str, action: str, collection: str, ok: bool, millis: float, at: float | None = None) -> str:
    return json.dumps({"ts": time.time() if at is None else at, "user": user, "action": action, "collection": collection, "ok": ok, "millis": millis})


def append_audit(spark: SparkSession, lines: Sequence[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").write.mode("append").text(path)


def audit_stats(spark: SparkSession, path: str) -> DataFrame:
    """(action, calls, failures, mean_ms, p95_ms) of a record of calls."""
    rows = spark.read.schema("ts double, user string, action string, collection string, ok boolean, millis double").json(path)
    return rows.groupBy("action").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.avg("millis").alias("mean_ms"), F.percentile_approx("millis", 0.95).alias("p95_ms"))
