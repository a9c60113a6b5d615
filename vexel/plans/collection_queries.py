"""More queries of the engine, by name, with their SQL: collections, imports, streams, indexes, placement and policy."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions import distance
from vexel.operators import index, mutations, placement, search
from vexel.plans import filters, policy
from vexel.plans.builds import BuildQueue
from vexel.plans.collection import Collection, Engine
from vexel.plans.queries import _EXPIRING, _LOG, _Q, AS_OF, _joined, _knn, expiring, log, orders_sparse, parts, query, table, vectors, zero_query
from vexel.sources import connector, importers, storage
from vexel.sources.scratch import scratch
from vexel.streaming import sink
from vexel.types import IndexType, InvalidArgument, Metric, check_top_k


def no_vector() -> Column:
    return F.array(F.lit(0.0).cast("float")).alias("vector")



def fresh(spark: SparkSession, dimension: int, metric: str = "l2", shards: int = 4, **rest) -> Collection:
    return Engine(spark, scratch(spark, "collections"), **rest).create_collection("rows", dimension, metric, num_shards=shards)


def filled(spark: SparkSession, sf_dir: str, **rest) -> Collection:
    c = fresh(spark, 64, **rest)
    c.insert(vectors(spark, sf_dir))
    return c


# --- collections


@query("select vec_id id, label::bigint label, (select count(*) from embeddings) total, 60 < (select count(*) from embeddings) has_more from embeddings order by vec_id limit 20 offset 40")
def listing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, total, more = filled(spark, sf_dir).list(20, 40)
    return page.select("id", "label", F.lit(total).cast("long").alias("total"), F.lit(more).alias("has_more"))


@query("select 'b' name, 64 dimension, 'cosine' metric, count(*) \"rows\" from embeddings union all select 'c', 2, 'l2', 0")
def collections_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three collections are made, one of them is dropped."""
    e = Engine(spark, scratch(spark, "collections"))
    e.create_collection("a", 8)
    e.create_collection("b", 64, "cosine").insert(vectors(spark, sf_dir))
    e.create_collection("c", 2)
    e.drop_collection("a")
    return spark.createDataFrame([(x["name"], x["dimension"], x["metric"], x["rows"]) for x in e.list_collections()], "name string, dimension int, metric string, rows long")


@query("select 1::bigint collections, count(*) \"rows\", 3::bigint queries, true timed from embeddings")
def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = filled(spark, sf_dir)
    for k in (1, 2, 3):
        c.search([0.0] * 64, k)
    s = c.engine.stats()
    return spark.createDataFrame([(s["collections"], s["rows"], s["queries"], s["mean_query_ms"] > 0)], "collections long, rows long, queries long, timed boolean")


@query(_knn("l2").replace("label,", "label::bigint label,"))
def search_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search from the cache: before a change of the collection, after it, and again."""
    c = filled(spark, sf_dir, clock=lambda: 1000)
    q = zero_query(vectors(spark, sf_dir))
    c.search_cached(q, 10)
    c.delete([2, 3])
    c.insert(vectors(spark, sf_dir).filter("id in (2, 3)"))
    c.search_cached(q, 10)
    out = c.search_cached(q, 10)
    if c.engine.hits != 1:
        raise AssertionError("one hit expected")
    return out.select("id", "label", "distance")


@query(f"with d as (select vec_id id, round(list_distance(embedding::double[], {_Q}), 6) distance, (vec_id % 4)::int shard from embeddings) select shard, id, distance, (select count(*) from d x where x.shard = y.shard) scanned from (select *, row_number() over (partition by shard order by distance, id) rn from d) y where rn <= 5")
def shard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = filled(spark, sf_dir)
    q = zero_query(vectors(spark, sf_dir))
    found = [(s, *c.search_shard(s, q, 5)) for s in range(4)]
    out = [rows.select(F.lit(s).alias("shard"), "id", "distance", F.lit(n).cast("long").alias("scanned")) for s, rows, n in found]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"with {_LOG} select id, event_type, value, count(*) over () total from (select *, row_number() over (partition by id order by seq desc) rn from log) where rn = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with many rows of an id and no column that orders them: the last one stays."""
    c = fresh(spark, 1)
    rows = log(spark, sf_dir).orderBy("seq").select("id", no_vector(), "event_type", "value")
    n = c.upsert(rows)
    return c.rows().select("id", "event_type", "value", F.lit(n["inserted"] + n["updated"]).cast("long").alias("total"))


@query(f"with {_EXPIRING} select seq, id, 1::bigint folders from (select *, row_number() over (partition by seq) r from x) where expires_at is null or expires_at > {AS_OF}")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inserts, then compaction: one folder a shard and no expired rows."""
    c = fresh(spark, 1, clock=lambda: AS_OF)
    rows = expiring(spark, sf_dir).select(F.col("seq").alias("id"), no_vector(), F.col("id").alias("user"), "expires_at")
    c.insert(rows.filter("id % 3 = 0"))
    c.insert(rows.filter("id % 3 <> 0"))
    c.compact()
    most = max((len(p) for p in c.manifest["shards"].values()), default=0)
    c.clean()
    return c.rows().select(F.col("id").alias("seq"), F.col("user").alias("id"), F.lit(most).cast("long").alias("folders"))


@query("select vec_id id, label::bigint label from embeddings")
def manifest_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer dies and leaves half a manifest: reads go on, and after recovery so do changes."""
    c = fresh(spark, 64)
    rows = vectors(spark, sf_dir)
    c.insert(rows.filter("id % 2 = 0"))
    storage.write_bytes(spark, f"{c.path}/manifest-2.json", b'{"name": "rows", "ver')
    if c.rows().count() != rows.filter("id % 2 = 0").count() or c.recover() != 1:
        raise AssertionError("one unfinished manifest expected")
    c.insert(rows.filter("id % 2 = 1"))
    return c.rows().select("id", "label")


@query(f"with {_LOG} select seq, id, event_type, value from (select *, row_number() over (partition by id order by seq desc) rn from log) where rn = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.rank_latest(log(spark, sf_dir), "id", "seq").select("seq", "id", "event_type", "value")


# --- imports, connector, streams


@query("select vec_id id, embedding \"vector\", label::bigint label from embeddings")
def pandas_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of the driver's own; its vectors as JSON text, as they come out of a CSV file."""
    frame = vectors(spark, sf_dir).toPandas()
    frame["vector"] = [json.dumps([float(x) for x in v]) for v in frame["vector"]]
    return importers.from_pandas(spark, frame).select("id", "vector", F.col("label").cast("long").alias("label"))


@query("select vec_id id, embedding \"vector\", label::bigint label from embeddings")
def array_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).orderBy("id").toPandas()
    out = importers.from_array(spark, np.stack(rows["vector"].to_list()), rows["id"].tolist(), {"label": rows["label"].tolist()})
    return out.select("id", "vector", F.col("label").cast("long").alias("label"))


@query("select 'COMPLETED' state, count(*) inserted, 0::bigint updated, count(*) rows_read, 1::bigint jobs, count(*) \"rows\" from embeddings")
def bulk_import_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import that is asked for twice runs once."""
    c = fresh(spark, 64)
    at = scratch(spark, "import")
    vectors(spark, sf_dir).write.parquet(at)
    c.bulk_import(at)
    j = c.bulk_import(at)
    return spark.createDataFrame([(j["state"], j["inserted"], j["updated"], j["rows_read"], len(c.jobs()), c.rows().count())], "state string, inserted long, updated long, rows_read long, jobs long, rows long")


@query("select vec_id id, embedding \"vector\", case when vec_id % 3 = 0 then 'second' else 'first' end origin from embeddings union all select vec_id, embedding, 'third' from embeddings where vec_id < 50")
def connector_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created by the first write, truncated and written again, upserted, then appended to."""
    e = Engine(spark, scratch(spark, "collections"))
    rows = vectors(spark, sf_dir).select(F.col("id").alias("key"), F.col("vector").alias("v"))
    named = lambda part, origin: rows.filter(part).withColumn("origin", F.lit(origin))
    options = {"id": "key", "vector": "v"}
    connector.save(named("true", "none"), e, "rows", dimension=64, num_shards=3, **options)
    connector.save(named("true", "first"), e, "rows", truncate=True, **options)
    connector.save(named("key % 3 = 0", "second"), e, "rows", **options)
    connector.save(named("key < 50", "third"), e, "rows", mode="stream_insert", **options)
    return connector.load(e, "rows", ["id", "vector", "origin"])


@query("select p_partkey id, p_brand brand from part where p_size > 20 and p_brand = 'Brand#13'")
def filter_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter language over a collection reaches the Parquet scan, which reads two metadata columns."""
    e = Engine(spark, scratch(spark, "collections"))
    p = parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), no_vector(), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))
    connector.save(p, e, "parts", mode="stream_insert", dimension=1)
    rows = connector.load(e, "parts", as_of=0)
    out = rows.filter(filters.to_column("size > 20 AND brand = 'Brand#13'", rows.schema)).select("id", "brand")
    plan = out._jdf.queryExecution().executedPlan().toString()
    pushed, _, read = plan.partition("PushedFilters")[2].partition("ReadSchema")
    if "IsNotNull(size), IsNotNull(brand)" not in pushed or "kind" in read or "vector" in read:
        raise AssertionError(plan)
    return out


def _stream(spark: SparkSession, sf_dir: str, parts: int, where: str = "true") -> tuple[DataFrame, DataFrame]:
    """(the log, a stream of it in so many files, the older ones first)."""
    rows = log(spark, sf_dir).filter(where).select("id", no_vector(), "event_type", "value", "seq")
    at = scratch(spark, "log")
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    step = (high - low) // parts + 1
    for k in range(parts):
        rows.filter((F.col("seq") >= low + k * step) & (F.col("seq") < low + (k + 1) * step)).coalesce(1).write.mode("append").parquet(at)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)


@query(f"with {_LOG} select id, event_type, value from (select *, row_number() over (partition by id order by seq desc) rn from log) where rn = 1")
def stream_two_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams under one name, each with a checkpoint of its own; the second also runs again, over nothing new."""
    c = fresh(spark, 1)
    half = log(spark, sf_dir).agg(F.max("seq")).first()[0] // 2
    for where in (f"seq <= {half}", f"seq > {half}"):
        _, stream = _stream(spark, sf_dir, 2, where)
        at = scratch(spark, "checkpoint")
        for _ in range(2):
            sink.upsert_stream(stream, c, at, seq="seq").awaitTermination()
    return c.rows().select("id", "event_type", "value")


@query(f"with {_LOG} select seq, id, event_type, value from log")
def stream_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended once each, although the last batch is applied a second time, as after a crash before the checkpoint is written."""
    c = fresh(spark, 1)
    _, stream = _stream(spark, sf_dir, 2)
    at = scratch(spark, "checkpoint")
    sink.insert_stream(stream, c, at).awaitTermination()
    commits = f"{at}/commits"
    last = max(int(x) for x in storage.children(spark, commits) if x.isdigit())
    storage.remove(spark, f"{commits}/{last}")
    sink.insert_stream(stream, c, at).awaitTermination()
    return c.rows().select("seq", "id", "event_type", "value")


# --- filters, types, limits, policy


@query("select p_partkey, p_size, p_brand from part where (p_size < 10 and p_brand like 'Brand#1%') or not (p_retailprice < 1500.0 or p_size in (3, 4))")
def filter_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed, written out, parsed again and applied."""
    p = parts(spark, sf_dir)
    text = filters.to_text(filters.parse("(p_size < 10 AND p_brand LIKE 'Brand#1%') OR NOT (p_retailprice < 1500.0 OR p_size IN (3, 4))"))
    return p.filter(filters.to_column(text, p.schema)).select("p_partkey", "p_size", "p_brand")


@query("select n_nationkey, n_name, n_name like '%A' or n_nationkey in (3, 7) keep from nation")
def filter_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter language in Python, row by row, over a small table."""
    tree = filters.parse("n_name LIKE '%A' OR n_nationkey IN (3, 7)")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()
    return spark.createDataFrame([(r[0], r[1], filters.evaluate(tree, r.asDict())) for r in rows], "n_nationkey int, n_name string, keep boolean")


@query("select * from (values ('L2', 'l2'), ('ip', 'inner_product'), ('dot', 'inner_product'), ('cosine', 'cosine'), ('IVF_PQ', 'ivf_pq'), ('hamming', 'refused'), ('btree', 'refused')) t(given, \"name\")")
def names_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    def name(kind, x: str) -> str:
        try:
            return kind.of(x).value
        except InvalidArgument:
            return "refused"

    asked = [(Metric, x) for x in ("L2", "ip", "dot", "cosine")] + [(IndexType, "IVF_PQ"), (Metric, "hamming"), (IndexType, "btree")]
    return spark.createDataFrame([(x, name(k, x)) for k, x in asked], "given string, name string")


@query("select k::bigint k, k between 1 and 1000 fine from (values (-1), (0), (1), (10), (1000), (1001)) t(k)")
def top_k_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fine(k: int) -> bool:
        try:
            return check_top_k(k) == k
        except InvalidArgument:
            return False

    return spark.createDataFrame([(k, fine(k)) for k in (-1, 0, 1, 10, 1000, 1001)], "k long, fine boolean")


@query("""
    select r role, p permission, case when r = 'admin' then true when p in ('create_collection', 'drop_collection') then false
           when r = 'readonly' then p not in ('insert', 'stream_insert', 'upsert', 'delete', 'update_metadata') else true end on_own,
           r = 'admin' on_other
    from (values ('admin'), ('readwrite'), ('collection_admin'), ('readonly')) a(r),
         (values ('create_collection'), ('drop_collection'), ('list_collections'), ('insert'), ('stream_insert'), ('upsert'), ('delete'), ('update_metadata'), ('search'), ('range_search'), ('hybrid_search'), ('get'), ('list_rows')) b(p)
""")
def role_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user of each role may do in their own collection and in another."""
    rules = policy.Policy([policy.Grant(r, r, frozenset({"own"})) for r in policy.ROLES])
    rows = [(r, p.value, rules.allows(r, p, "own"), rules.allows(r, p, "other")) for r in policy.ROLES for p in policy.Permission]
    return spark.createDataFrame(rows, "role string, permission string, on_own boolean, on_other boolean")


@query("select * from (values ('create_collection', 1::bigint, 0::bigint), ('insert', 1, 0), ('search', 2, 0), ('delete', 1, 1), ('get', 1, 1)) t(\"action\", calls, failures)")
def audit_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a reader's and a writer's calls: a refused one and one that fails count as failures."""
    at = scratch(spark, "audit")
    rules = policy.Policy([policy.Grant("ann", "admin"), policy.Grant("bob", "readonly")])
    c = filled(spark, sf_dir, policy=rules, user="ann", audit=at)
    q = [0.0] * 64
    c.search(q, 3)
    c.engine.user = "bob"
    c.search(q, 3)
    for call in (lambda: c.delete([1]), lambda: c.get([])):
        try:
            call()
        except (policy.PermissionDenied, InvalidArgument):
            pass
    c.engine.flush_audit()
    return policy.audit_stats(spark, at).select("action", "calls", "failures")


@query("select event_type \"action\", count(*) calls, count(*) filter (user_id % 7 = 0) failures, round(avg(value), 4) mean_ms from events group by 1")
def audit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "audit")
    lines = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.lit(0.0).alias("ts"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("action"), F.lit("c").alias("collection"), (F.col("user_id") % 7 != 0).alias("ok"), F.col("value").alias("millis"))).alias("value"))
    lines.write.text(at)
    return policy.audit_stats(spark, at).select("action", "calls", "failures", F.round("mean_ms", 4).alias("mean_ms"))


# --- sparse vectors

_W = "(values (7, 1.0::double), (13, 0.5), (21, 2.0), (40, -1.0)) q(idx, w)"


@query(f"""
    with v as (select l_orderkey, l_partkey, sum(l_quantity)::float::double val from lineitem group by all),
    n as (select l_orderkey, sqrt(sum(val * val)) norm from v group by 1),
    d as (select l_orderkey, sum(val * w) dot from v join {_W} on l_partkey = idx group by 1)
    select l_orderkey id, round(coalesce(dot, 0), 6) dot, round(norm, 6) norm, round(coalesce(dot, 0) / (norm * sqrt(6.25)), 6) cosine from n left join d using (l_orderkey)
""")
def sparse_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*(F.struct(F.lit(i).cast("long").alias("idx"), F.lit(v).cast("float").alias("val")) for i, v in ((7, 1.0), (13, 0.5), (21, 2.0), (40, -1.0))))
    s = F.col("sparse")
    return orders_sparse(spark, sf_dir).select("id", F.round(distance.sparse_dot(s, q), 6).alias("dot"), F.round(distance.sparse_norm(s), 6).alias("norm"), F.round(distance.sparse_cosine(s, q), 6).alias("cosine"))


# --- indexes


@query("""
    select n::bigint n, d dimension, case when n < 10000 then 'flat' when n < 500000 then 'hnsw' when n < 1000000 then 'ivf_sq' else 'ivf_turboquant' end kind,
           case when n between 10000 and 499999 then case when d > 512 then 20 when n < 100000 then 12 else 16 end end m,
           case when n between 10000 and 499999 then case when n < 100000 then 64 else 100 end end ef_search,
           case when n >= 500000 then floor(sqrt(n))::int end nlist, case when n >= 500000 then floor(sqrt(floor(sqrt(n))))::int end nprobe,
           case when n >= 100000000 then 2 when n >= 1000000 then 4 end bits
    from (values (0), (9999), (10000), (99999), (100000), (499999), (500000), (999999), (1000000), (99999999), (100000000)) a(n), (values (128), (513)) b(d)
""")
def index_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for n in (0, 9999, 10_000, 99_999, 100_000, 499_999, 500_000, 999_999, 1_000_000, 99_999_999, 100_000_000):
        for d in (128, 513):
            c = index.resolve("auto", n, d)
            graph, lists = c.type is IndexType.HNSW, c.type.value.startswith("ivf")
            rows.append((n, d, c.type.value, c.m if graph else None, c.ef_search if graph else None, c.nlist if lists else None, c.nprobe if lists else None, c.bits if c.type is IndexType.IVF_TURBOQUANT else None))
    return spark.createDataFrame(rows, "n long, dimension int, kind string, m int, ef_search int, nlist int, nprobe int, bits int")


_CONFIGS = {
    "good": (IndexType.IVF_PQ, {}), "auto": (IndexType.AUTO, {}), "gpu": (IndexType.FLAT, {"use_gpu": True}), "no dimension": (IndexType.FLAT, {"dimension": 0}), "wide": (IndexType.FLAT, {"dimension": 8193}),
    "no links": (IndexType.HNSW, {"m": 0}), "many links": (IndexType.HNSW, {"m": 65}), "ef": (IndexType.HNSW, {"ef_construction": 0}), "no lists": (IndexType.IVF_FLAT, {"nlist": 0}), "no probes": (IndexType.IVF_FLAT, {"nprobe": 0}),
    "parts": (IndexType.IVF_PQ, {"pq_m": 7}), "part bits": (IndexType.IVF_PQ, {"pq_bits": 9}), "bits": (IndexType.TURBOQUANT, {"bits": 3}),
}


@query("select \"name\", \"name\" = 'good' fine from (values " + ", ".join(f"('{n}')" for n in _CONFIGS) + ") t(\"name\")")
def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fine(kind: IndexType, rest: dict) -> bool:
        try:
            return bool(index.IndexConfig(kind, **({"dimension": 64} | rest)).check())
        except InvalidArgument:
            return False

    return spark.createDataFrame([(n, fine(*c)) for n, c in _CONFIGS.items()], "name string, fine boolean")


@query("""
    with x as (select vec_id, unnest(embedding)::double v, unnest(range(64)) pos from embeddings), e as (select pos, min(v) lo, max(v) hi from x group by pos),
    c as (select vec_id id, pos, least(255, greatest(0, floor((v - lo) / case when hi > lo then hi - lo else 1 end * 255 + 0.5)))::int code from x join e using (pos))
    select id, list(code order by pos) codes from c group by id
""")
def scalar_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8-bit codes that a scalar quantiser gives every vector."""
    rows = vectors(spark, sf_dir)
    codec = index.fit_codec(rows, index.IndexConfig(IndexType.IVF_SQ, 64))
    coded = index.encode(rows.select("id", "vector"), codec, 64)
    codes = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.hex(F.substring(F.col("code"), i, F.lit(1))), 16, 10).cast("int"))
    return coded.select("id", codes.alias("codes"))


def _whole(spark: SparkSession, sf_dir: str, kind: IndexType, **rest) -> DataFrame:
    """Every row's neighbours by an index that probes all its clusters and measures exactly what it finds; it is stored and read again."""
    rows = vectors(spark, sf_dir)
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    c = filled(spark, sf_dir)
    c.build_index(index.IndexConfig(kind, 64, nlist=4, nprobe=4, **rest))
    found = c.index().join(asked, 10, rescore=200, sure=True)
    return found.select("query_id", "id", "distance", "rank")


@query(_joined("l2"))
def ivf_flat_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir, IndexType.IVF_FLAT)


@query(_joined("l2"))
def ivf_sq_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir, IndexType.IVF_SQ)


@query(_joined("l2"))
def ivf_pq_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir, IndexType.IVF_PQ, pq_bits=4)


@query(_joined("l2"))
def ivf_turboquant_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir, IndexType.IVF_TURBOQUANT)


@query("select 'second' \"name\", 'ivf_flat' kind, 1 version, count(*) \"rows\" from embeddings")
def index_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes are built, one is dropped; the other is read again."""
    c = filled(spark, sf_dir)
    config = index.IndexConfig(IndexType.IVF_FLAT, 64, nlist=2, nprobe=1)
    for name in ("first", "second"):
        c.build_index(config, name=name)
    c.drop_index("first")
    return spark.createDataFrame([(n, x["type"], x["version"], c.index(n).rows.count()) for n, x in c.indexes().items()], "name string, kind string, version int, rows long")


@query("select * from (values (1, 'urgent', true), (2, 'late', false), (3, 'early', true), (4, 'idle', true)) t(turn, \"name\", fine)")
def build_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = BuildQueue()
    q.add("early", lambda: None, 1)
    q.add("idle", lambda: None)
    q.add("urgent", lambda: None, 5)
    q.add("late", lambda: 1 / 0, 1)
    q.add("late", lambda: 1 / 0, 2)
    q.add("urgent", lambda: None, 3)
    return spark.createDataFrame([(i + 1, n, n not in q.failed) for i, n in enumerate(q.run())], "turn int, name string, fine boolean")


# --- placement


@query("select o_orderkey id, (case when o_orderkey >= 100 then 1 else 0 end + case when o_orderkey >= 1000 then 1 else 0 end + case when o_orderkey >= 30000 then 1 else 0 end)::int shard from orders")
def range_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), placement.range_shard("o_orderkey", [1000, 100, 30_000]).alias("shard"))


@query("""
    with p as (select ('0x' || substr(md5(n || '#' || v), 1, 15))::bigint pos, n from (values ('n1'), ('n2'), ('n3'), ('n4')) a(n), range(150) b(v)),
    k as (select o_orderkey id, ('0x' || substr(md5(o_orderkey::varchar), 1, 15))::bigint h from orders)
    select id, coalesce(p.n, (select n from p order by pos limit 1)) node from k asof left join p on k.h <= p.pos
""")
def ring_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.ring_owner(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), ["n1", "n2", "n3", "n4"])


@query("select * from (values (5, 'a', 'c'), (1, 'a', 'b')) t(shard, home, goal)")
def rebalance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a node with 90 of 120 rows the largest shards that fit go to the emptiest ones."""
    sizes = {0: ("a", 25), 1: ("a", 15), 2: ("a", 20), 5: ("a", 30), 7: ("b", 30)}
    return spark.createDataFrame(placement.rebalance(sizes, ["a", "b", "c"]), "shard int, home string, goal string")


@query("""
    with recursive o as (select user_id, value, row_number() over (partition by user_id order by event_id) rn from events where value is not null),
    s as (select user_id, rn, value::double avg from o where rn = 1 union all select o.user_id, o.rn, 0.7 * s.avg + 0.3 * o.value from s join o on o.user_id = s.user_id and o.rn = s.rn + 1)
    select user_id, round(arg_max(avg, rn), 6) average from s group by user_id
""")
def load_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.latest_average(table(spark, sf_dir, "events"), "user_id", ["event_id"], "value").select("user_id", F.round("average", 6).alias("average"))


@query("select 3 tries, 1.5::double waited, count(*) \"rows\" from embeddings")
def retried_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert that fails twice goes through at the third try."""
    c = fresh(spark, 64)
    tries: list[int] = []
    waits: list[float] = []

    def write() -> None:
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not now")
        c.upsert(vectors(spark, sf_dir))

    connector.retried(write, sleep=waits.append)
    return spark.createDataFrame([(len(tries), sum(waits), c.rows().count())], "tries int, waited double, rows long")
