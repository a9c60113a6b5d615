"""Collections: rows in Parquet folders by shard, and a manifest that says which folders count.

A change writes new folders and then a new manifest; nothing that a reader may have
open is overwritten. Only the shards that a change meets are rewritten. Manifests
are numbered, and the one of the greatest number counts: a writer creates the next
number or is told that another has been faster.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.operators import hybrid as _hybrid
from vexel.operators import mutations, search
from vexel.operators.index import ClusteredIndex, IndexConfig, build_clustered, resolve
from vexel.plans.filters import Node
from vexel.plans.policy import Permission, PermissionDenied, Policy, append_audit, audit_line
from vexel.sources import storage
from vexel.sources.importers import read_csv, read_npy, read_parquet
from vexel.types import BASE_SCHEMA, MAX_BATCH, DEFAULT_RANGE_RESULTS, DEFAULT_TOP_K, AlreadyExists, EngineError, IndexType, InvalidArgument, Metric, NotFound, check_dimension, check_metadata, check_metadata_schema, check_name, family

_MANIFEST = re.compile(r"manifest-(\d+)\.json\Z")
#: Imports that may run at a time in one collection, and results that the cache of searches holds.
MAX_JOBS, CACHED = 4, 10_000


class Engine:
    """The collections below a folder.

    With a ``policy`` every call is checked for ``user``. Calls are timed; with ``audit``, a folder, they are also recorded
    there, ``flush_audit`` writing what has come up since the last time.
    """

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time, policy: Policy | None = None, user: str = "", audit: str | None = None):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.policy, self.user, self.audit = policy, user, audit
        self.lines: list[str] = []
        self.queries, self.query_ms = 0, 0.0
        self.cache: OrderedDict[str, pa.Table] = OrderedDict()
        self.hits = 0

    @contextmanager
    def call(self, permission: Permission, collection: str) -> Iterator[None]:
        """Checks, times and records a call."""
        began, ok = time.perf_counter(), False
        try:
            if self.policy and not self.policy.allows(self.user, permission, collection):
                raise PermissionDenied(f"{self.user or 'nobody'} may not {permission.value} {collection}")
            yield
            ok = True
        finally:
            millis = (time.perf_counter() - began) * 1000
            if ok and permission in (Permission.SEARCH, Permission.RANGE_SEARCH, Permission.HYBRID_SEARCH):
                self.queries, self.query_ms = self.queries + 1, self.query_ms + millis
            if self.audit:
                self.lines.append(audit_line(self.user, permission.value, collection, ok, millis, self.clock()))

    def flush_audit(self) -> None:
        if self.audit and self.lines:
            append_audit(self.spark, self.lines, self.audit)
            self.lines.clear()

    def create_collection(self, name: str, dimension: int, metric: Metric | str = Metric.L2, index_type: IndexType | str = IndexType.FLAT, num_shards: int = 1) -> Collection:
        with self.call(Permission.CREATE_COLLECTION, check_name(name)):
            manifest = {"name": name, "dimension": check_dimension(dimension), "metric": Metric.of(metric).value, "index_type": IndexType.of(index_type).value, "num_shards": max(1, num_shards), "version": 0, "shards": {}, "schema": BASE_SCHEMA.jsonValue()}
            if self._there(name) or not storage.create_json(self.spark, f"{self.root}/{name}/manifest-0.json", manifest):
                raise AlreadyExists(name)
            return Collection(self, name)

    def _there(self, name: str) -> bool:
        return any(map(_MANIFEST.match, storage.children(self.spark, f"{self.root}/{name}")))

    def collection(self, name: str) -> Collection:
        if not self._there(check_name(name)):
            raise NotFound(name)
        return Collection(self, name)

    def drop_collection(self, name: str) -> None:
        with self.call(Permission.DROP_COLLECTION, check_name(name)):
            self.collection(name)
            storage.remove(self.spark, f"{self.root}/{name}")

    def list_collections(self) -> list[dict]:
        with self.call(Permission.LIST_COLLECTIONS, ""):
            return [self.collection(n).describe() for n in storage.children(self.spark, self.root) if self._there(n)]

    def stats(self) -> dict[str, float]:
        """Collections, their rows, and the searches so far with the mean time that planning them took."""
        found = self.list_collections()
        return {"collections": len(found), "rows": sum(c["rows"] for c in found), "queries": self.queries, "mean_query_ms": self.query_ms / self.queries if self.queries else 0.0}


def guarded(permission: Permission) -> Callable[[Callable], Callable]:
    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def call(self: Collection, *args, **named):
            with self.engine.call(permission, self.name):
                return f(self, *args, **named)

        return call

    return wrap


class Collection:
    def __init__(self, engine: Engine, name: str):
        self.engine, self.spark, self.name = engine, engine.spark, name
        self.path = f"{engine.root}/{name}"

    def _versions(self) -> list[int]:
        return sorted((int(m[1]) for c in storage.children(self.spark, self.path) if (m := _MANIFEST.match(c))), reverse=True)

    @property
    def manifest(self) -> dict:
        """That of the greatest number which is whole: a writer that died has left half a file at most."""
        for n in self._versions():
            try:
                return storage.read_json(self.spark, f"{self.path}/manifest-{n}.json")
            except json.JSONDecodeError:
                continue
        raise NotFound(self.name)

    def recover(self) -> int:
        """Takes away manifests that dead writers have left unfinished, so that changes can go on; how many. Not while others write."""
        whole = self.manifest["version"]
        return sum(storage.remove(self.spark, f"{self.path}/manifest-{n}.json") for n in self._versions() if n > whole)

    def _read(self, manifest: dict, shards: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [p for s, ps in manifest["shards"].items() if shards is None or int(s) in shards for p in ps]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """All rows, those expired too."""
        return self._read(self.manifest)

    def live(self, as_of: int | None = None) -> DataFrame:
        return search.live(self.rows(), self._now(as_of))

    def _now(self, as_of: int | None) -> int:
        return int(self.engine.clock()) if as_of is None else as_of

    def describe(self) -> dict:
        m = self.manifest
        return {k: m[k] for k in ("name", "dimension", "metric", "index_type", "num_shards", "version")} | {"rows": self.rows().count()}

    # --- changes

    def _ready(self, batch: DataFrame, dimension: int, ttl: int | None) -> DataFrame:
        check_metadata_schema(batch.schema)
        if "id" not in batch.columns or "vector" not in batch.columns:
            raise InvalidArgument("columns id and vector are needed")
        meta = [c for c in batch.columns if c not in ("id", "vector", "sparse", "expires_at", "ttl_seconds")]
        kinds = {"int": "long", "double": "double", "string": "string", "bool": "boolean"}
        good = (F.size("vector") == dimension) & F.col("id").isNotNull() & (F.col("id") >= 0)
        checked = F.when(good, F.col("id").cast("long")).otherwise(F.raise_error(F.concat(F.lit("bad row, id "), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(f": ids from 0 and vectors of dimension {dimension} are needed"))).cast("long"))
        now = int(self.engine.clock())
        expires: Column = F.col("expires_at").cast("long") if "expires_at" in batch.columns else F.lit(None).cast("long")
        if "ttl_seconds" in batch.columns:
            expires = F.coalesce(expires, F.when(F.col("ttl_seconds") > 0, F.col("ttl_seconds").cast("long") + now))
        if ttl:
            expires = F.coalesce(expires, F.lit(now + ttl))
        sparse = F.col("sparse").cast(BASE_SCHEMA["sparse"].dataType) if "sparse" in batch.columns else F.lit(None).cast(BASE_SCHEMA["sparse"].dataType)
        return batch.select(checked.alias("id"), F.col("vector").cast("array<float>").alias("vector"), sparse.alias("sparse"), expires.alias("expires_at"), *(F.col(f"`{c}`").cast(kinds[family(batch.schema[c].dataType) or "string"]).alias(c) for c in meta))

    def _merged(self, manifest: dict, new: T.StructType) -> T.StructType:
        old = T.StructType.fromJson(manifest["schema"])
        for f in new:
            if f.name in old.names:
                if old[f.name].dataType != f.dataType:
                    raise InvalidArgument(f"{f.name} is {old[f.name].dataType.simpleString()} here, not {f.dataType.simpleString()}")
            else:
                old = old.add(f.name, f.dataType, True)
        return old

    def _write(self, df: DataFrame, manifest: dict) -> dict[int, str]:
        """Writes rows by shard; the folder of each shard that got any."""
        at = f"{self.path}/data/v{manifest['version'] + 1}-{uuid.uuid4().hex[:8]}"
        n = manifest["num_shards"]
        df.withColumn("__shard", mutations.shard_of("id", n)).repartition(n, "__shard").write.option("maxRecordsPerFile", 5_000_000).partitionBy("__shard").parquet(at)
        return {int(c.split("=")[1]): f"{at}/{c}" for c in storage.children(self.spark, at) if c.startswith("__shard=")}

    def _commit(self, manifest: dict, schema: T.StructType, shards: Mapping[str, list[str]], mark: tuple[str, int] | None = None) -> None:
        """The next version; with ``mark``, a stream and the number of its batch, which the manifest then holds as applied."""
        new = manifest | {"version": manifest["version"] + 1, "schema": schema.jsonValue(), "shards": {str(k): v for k, v in shards.items()}}
        if mark:
            new["applied"] = manifest.get("applied", {}) | {mark[0]: mark[1]}
        if not storage.create_json(self.spark, f"{self.path}/manifest-{new['version']}.json", new):
            raise EngineError("changed by another writer; try again")

    @contextmanager
    def _staged(self, df: DataFrame) -> Iterator[DataFrame]:
        """Rows written once, so that counts and changes are of the same rows; deleted afterwards."""
        at = f"{self.path}/staged-{uuid.uuid4().hex}"
        try:
            df.write.parquet(at)
            yield self.spark.read.schema(df.schema).parquet(at)
        finally:
            storage.remove(self.spark, at)

    @guarded(Permission.INSERT)
    def insert(self, batch: DataFrame, ttl: int | None = None, mark: tuple[str, int] | None = None) -> None:
        """Appends; ids aren't checked for being there."""
        m = self.manifest
        ready = self._ready(batch, m["dimension"], ttl)
        schema = self._merged(m, ready.schema)
        shards = {k: list(v) for k, v in m["shards"].items()}
        for s, path in self._write(ready, m).items():
            shards.setdefault(str(s), []).append(path)
        self._commit(m, schema, shards, mark)

    stream_insert = insert

    def insert_rows(self, rows: Sequence[Mapping], ttl: int | None = None) -> None:
        """Rows of the caller's own, at most MAX_BATCH at a time."""
        if not 1 <= len(rows) <= MAX_BATCH:
            raise InvalidArgument(f"from 1 to {MAX_BATCH} rows, not {len(rows)}")
        self.insert(self.spark.createDataFrame(pa.Table.from_pylist([dict(r) for r in rows])), ttl)

    def _rewrite(self, m: dict, touched: Sequence[int], change: Callable[[DataFrame], DataFrame], schema: T.StructType, mark: tuple[str, int] | None = None) -> None:
        shards = {k: v for k, v in m["shards"].items() if int(k) not in touched}
        old = self._read(m | {"schema": schema.jsonValue()}, touched)
        shards |= {str(s): [p] for s, p in self._write(change(old), m).items()}
        self._commit(m, schema, shards, mark)

    def _touched(self, df: DataFrame, m: dict) -> list[int]:
        return [r[0] for r in df.select(mutations.shard_of("id", m["num_shards"])).distinct().collect()]

    @guarded(Permission.UPSERT)
    def upsert(self, batch: DataFrame, seq: str | None = None, ttl: int | None = None, mark: tuple[str, int] | None = None) -> dict[str, int]:
        """Whole rows replaced by id. ``seq`` names a column of the batch that orders rows of one id; it isn't kept. Without it the last one counts."""
        m = self.manifest
        one = mutations.latest(batch, seq)
        with self._staged(self._ready(one.drop(seq) if seq else one, m["dimension"], ttl)) as ready:
            schema = self._merged(m, ready.schema)
            touched = self._touched(ready, m)
            counts = mutations.upsert_counts(self._read(m, touched).select("id"), ready.select("id")).first()
            self._rewrite(m, touched, lambda old: mutations.upsert(old, ready), schema, mark)
        return {"inserted": counts["inserted"], "updated": counts["updated"]}

    @guarded(Permission.GET)
    def get(self, ids: Sequence[int], as_of: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows in the order asked, ids not found)."""
        m = self.manifest
        near = self._read(m, {int(i) % m["num_shards"] for i in ids})
        return mutations.get(near, ids, self._now(as_of)), mutations.not_found(near, ids, self._now(as_of))

    @guarded(Permission.DELETE)
    def delete(self, ids: Sequence[int]) -> dict:
        m = self.manifest
        touched = sorted({int(i) % m["num_shards"] for i in ids})
        missing = [r[0] for r in mutations.not_found(self._read(m, touched), ids).collect()]
        gone = self.spark.createDataFrame([(int(i),) for i in set(ids)], "id long")
        self._rewrite(m, touched, lambda old: mutations.delete(old, gone), T.StructType.fromJson(m["schema"]))
        return {"deleted": len(set(ids)) - len(missing), "not_found": missing}

    @guarded(Permission.UPDATE_METADATA)
    def update_metadata(self, id: int, values: Mapping[str, bool | int | float | str], merge: bool = True) -> None:
        if id == 0 or not values:
            raise InvalidArgument("an id other than 0 and some metadata are needed")
        check_metadata(dict(values))
        m = self.manifest
        touched = [id % m["num_shards"]]
        if self._read(m, touched).filter(F.col("id") == id).isEmpty():
            raise NotFound(str(id))
        kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
        change = self.spark.range(1).select(F.lit(id).cast("long").alias("id"), *(F.lit(v).cast(kinds[type(v)]).alias(k) for k, v in values.items()))
        schema = self._merged(m, T.StructType([f for f in change.schema if f.name != "id"]))
        self._rewrite(m, touched, lambda old: mutations.update_metadata(old, change, merge), schema)

    def vacuum(self, as_of: int | None = None) -> int:
        """Takes out expired rows; how many there were."""
        m, now = self.manifest, self._now(as_of)
        lost = self._read(m).filter(F.col("expires_at") <= now).groupBy(mutations.shard_of("id", m["num_shards"]).alias("s")).count().collect()
        if lost:
            self._rewrite(m, [r["s"] for r in lost], lambda old: mutations.sweep(old, now), T.StructType.fromJson(m["schema"]))
        return sum(r["count"] for r in lost)

    def compact(self, as_of: int | None = None) -> int:
        """One folder for each shard, and no expired rows; how many shards were rewritten: those with several folders or with expired rows."""
        m, now = self.manifest, self._now(as_of)
        many = [int(s) for s, ps in m["shards"].items() if len(ps) > 1]
        single = [int(s) for s, ps in m["shards"].items() if len(ps) == 1]
        if single:
            many += self._touched(self._read(m, single).filter(F.col("expires_at") <= now), m)
        if many:
            self._rewrite(m, many, lambda old: mutations.sweep(old, now), T.StructType.fromJson(m["schema"]))
        return len(many)

    def clean(self) -> int:
        """Deletes folders that the manifest no longer names; only when no reader of an older version is left."""
        m = self.manifest
        used = {p for ps in m["shards"].values() for p in ps}
        for v in self._versions():
            if v < m["version"]:
                storage.remove(self.spark, f"{self.path}/manifest-{v}.json")
        n = 0
        for v in storage.children(self.spark, f"{self.path}/data"):
            for s in storage.children(self.spark, f"{self.path}/data/{v}"):
                path = f"{self.path}/data/{v}/{s}"
                if s.startswith("__shard=") and path not in used:
                    n += storage.remove(self.spark, path)
        return n

    # --- queries

    def _query(self, vector: Sequence[float]) -> Metric:
        m = self.manifest
        if len(vector) != m["dimension"]:
            raise InvalidArgument(f"query of dimension {m['dimension']} expected, not {len(vector)}")
        return Metric(m["metric"])

    @guarded(Permission.SEARCH)
    def search(self, vector: Sequence[float], top_k: int = DEFAULT_TOP_K, filter: str | Node | None = None, as_of: int | None = None, return_metadata: bool = True) -> DataFrame:
        out = search.knn(self.rows(), vector, top_k, self._query(vector), filter, self._now(as_of))
        return out if return_metadata else out.select("id", "distance")

    def search_cached(self, vector: Sequence[float], top_k: int = DEFAULT_TOP_K, filter: str | Node | None = None, as_of: int | None = None) -> DataFrame:
        """As ``search``, whose results, at most ``top_k`` rows each, the driver keeps until the collection changes or CACHED later ones have come."""
        cache = self.engine.cache
        key = json.dumps([self.name, self.manifest["version"], [float(x) for x in vector], top_k, repr(filter), self._now(as_of)])
        if key in cache:
            self.engine.hits += 1
            cache.move_to_end(key)
        else:
            cache[key] = self.search(vector, top_k, filter, as_of).toArrow()
            while len(cache) > CACHED:
                cache.popitem(last=False)
        return self.spark.createDataFrame(cache[key])

    @guarded(Permission.SEARCH)
    def search_shard(self, shard: int, vector: Sequence[float], top_k: int = DEFAULT_TOP_K, filter: str | Node | None = None, as_of: int | None = None) -> tuple[DataFrame, int]:
        """(the nearest rows of one shard, the number of its rows, all of which were measured)."""
        rows = self._read(self.manifest, [shard])
        return search.knn(rows, vector, top_k, self._query(vector), filter, self._now(as_of)), rows.count()

    @guarded(Permission.RANGE_SEARCH)
    def range_search(self, vector: Sequence[float], radius: float, max_results: int = DEFAULT_RANGE_RESULTS, filter: str | Node | None = None, as_of: int | None = None) -> DataFrame:
        return search.range_search(self.rows(), vector, radius, self._query(vector), max_results, filter, self._now(as_of))

    @guarded(Permission.SEARCH)
    def search_batch(self, queries: DataFrame, top_k: int = DEFAULT_TOP_K, filter: str | Node | None = None, as_of: int | None = None) -> DataFrame:
        return search.knn_join(self.rows(), queries, top_k, self.manifest["metric"], filter, self._now(as_of))

    @guarded(Permission.HYBRID_SEARCH)
    def hybrid_search(self, vector: Sequence[float] | None = None, text: str | None = None, sparse: Mapping[int, float] | None = None, top_k: int = DEFAULT_TOP_K, text_field: str = "text", as_of: int | None = None, **rest) -> DataFrame:
        metric = self._query(vector) if vector is not None else self.manifest["metric"]
        return _hybrid.hybrid(self.rows(), vector, text, sparse, top_k, metric, text_column=text_field, as_of=self._now(as_of), **rest)

    @guarded(Permission.LIST_ROWS)
    def list(self, limit: int = 20, offset: int = 0, as_of: int | None = None) -> tuple[DataFrame, int, bool]:
        """(page, live rows in all, are there more)."""
        rows = self.live(as_of)
        total = rows.count()
        return mutations.page(rows, limit, offset), total, offset + limit < total

    def build_index(self, config: IndexConfig | None = None, path: str | None = None, name: str = "default") -> ClusteredIndex | IndexConfig:
        """A derived table for the clustered kinds, entered in the registry; the exact kinds need none and give their resolved configuration back."""
        m = self.manifest
        rows = self.rows()
        config = config or resolve(m["index_type"], rows.count(), m["dimension"], m["metric"])
        if not config.type.value.startswith("ivf"):
            return config.check()
        at = path or f"{self.path}/index/v{m['version']}-{uuid.uuid4().hex[:8]}"
        built = build_clustered(rows, config).write(at)
        storage.write_json(self.spark, f"{self.path}/indexes/{check_name(name)}.json", {"path": at, "version": m["version"], "type": config.type.value, "model": built.model()})
        return built

    def indexes(self) -> dict[str, dict]:
        """The registry: (path, version of the rows, type) by name."""
        at = f"{self.path}/indexes"
        found = {n[:-5]: storage.read_json(self.spark, f"{at}/{n}") for n in storage.children(self.spark, at) if n.endswith(".json")}
        return {n: {k: v for k, v in x.items() if k != "model"} for n, x in found.items()}

    def index(self, name: str = "default") -> ClusteredIndex:
        at = f"{self.path}/indexes/{check_name(name)}.json"
        if not storage.exists(self.spark, at):
            raise NotFound(name)
        entry = storage.read_json(self.spark, at)
        return ClusteredIndex.read(self.spark, entry["path"], entry["model"])

    def drop_index(self, name: str = "default") -> None:
        entry = self.indexes().get(name)
        if not entry:
            raise NotFound(name)
        storage.remove(self.spark, f"{self.path}/indexes/{name}.json")
        storage.remove(self.spark, entry["path"])

    # --- import

    def bulk_import(self, uri: str, format: str = "parquet", mode: str = "upsert") -> dict:
        """Reads a file set and adds it as one change. The same uri is imported once; a failed job leaves no rows."""
        readers = {"parquet": read_parquet, "npy": read_npy, "csv": read_csv}
        if format not in readers:
            raise InvalidArgument(f"unknown format: {format}")
        key = re.sub(r"[^A-Za-z0-9]+", "-", uri)[-80:] + "-" + uuid.uuid5(uuid.NAMESPACE_URL, f"{uri}|{self.name}").hex[:12]
        record = f"{self.path}/jobs/{key}.json"
        if storage.exists(self.spark, record):
            done = storage.read_json(self.spark, record)
            if done["state"] == "COMPLETED":
                return done
        if sum(j["state"] == "RUNNING" and j["job_group"] != key for j in self.jobs()) >= MAX_JOBS:
            raise EngineError(f"{MAX_JOBS} imports are running; try again")
        job = {"uri": uri, "collection": self.name, "state": "RUNNING", "job_group": key, "rows_read": 0}
        storage.write_json(self.spark, record, job)
        sc = self.spark.sparkContext
        sc.setJobGroup(key, f"import of {uri}", interruptOnCancel=True)
        try:
            with self._staged(readers[format](self.spark, uri)) as batch:
                job["rows_read"] = batch.count()
                storage.write_json(self.spark, record, job)
                if mode == "upsert":
                    counts = self.upsert(batch)
                else:
                    self.insert(batch)
                    counts = {"inserted": job["rows_read"], "updated": 0}
            job |= {"state": "COMPLETED"} | counts
        except Exception as e:
            job |= {"state": "CANCELLED" if "cancel" in str(e).lower() else "FAILED", "error": str(e)[:500]}
            raise
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
            storage.write_json(self.spark, record, job)
        return job

    def jobs(self) -> list[dict]:
        at = f"{self.path}/jobs"
        return [storage.read_json(self.spark, f"{at}/{n}") for n in storage.children(self.spark, at) if n.endswith(".json")]

    def cancel(self, job_group: str) -> None:
        self.spark.sparkContext.cancelJobGroup(job_group)


def union(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several tables as one; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
