"""Derived indexes: automatic choice, clustered (IVF) tables, and scalar, product and rotation quantisers.

An index is a table derived from the rows, plus a small model. HNSW has no counterpart in Spark: it is answered
exactly, its parameters are checked and kept as hints.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.functions.distance import exact, pairwise
from vexel.operators.search import DIGITS, Rough, _matrix, _round, _values, closest, exact_levels, few_copies, knn, levels_of, select_rows, tiled
from vexel.plans.filters import Node
from vexel.types import DEFAULT_TOP_K, ZERO_NORM, IndexType, InvalidArgument, Metric, check_dimension, check_top_k

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Row counts from which the automatic choice goes on to the next kind.
FLAT_BELOW, SMALL_GRAPH_BELOW, GRAPH_BELOW, SCALAR_BELOW, FOUR_BIT_BELOW = 10_000, 100_000, 500_000, 1_000_000, 100_000_000
WIDE = 512
#: Rows that train codebooks and centroids; a bound on the sample, not on what is indexed.
TRAIN_ROWS = 100_000


@dataclass(frozen=True)
class IndexConfig:
    type: IndexType
    dimension: int
    metric: Metric = Metric.L2
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 100
    nlist: int = 100
    nprobe: int = 10
    pq_m: int = 8
    pq_bits: int = 8
    bits: int = 4
    qjl: bool = False
    use_gpu: bool = False

    def check(self) -> IndexConfig:
        check_dimension(self.dimension)
        kind = self.type

        def wrong(what: str) -> InvalidArgument:
            return InvalidArgument(f"{kind.value}: {what}")

        if kind is IndexType.AUTO:
            raise wrong("must be resolved first")
        if self.use_gpu:
            raise wrong("no GPU here")
        if kind is IndexType.HNSW and not (1 <= self.m <= 64 and self.ef_construction > 0 and self.ef_search > 0):
            raise wrong("m from 1 to 64, positive ef")
        if kind.value.startswith("ivf") and not (self.nlist >= 1 and 1 <= self.nprobe):
            raise wrong("positive nlist and nprobe")
        if kind is IndexType.IVF_PQ and (self.pq_m < 1 or self.dimension % self.pq_m or not 1 <= self.pq_bits <= 8):
            raise wrong("pq_m must divide the dimension, pq_bits from 1 to 8")
        if kind in (IndexType.TURBOQUANT, IndexType.IVF_TURBOQUANT) and self.bits not in (1, 2, 4, 8):
            raise wrong("bits 1, 2, 4 or 8")
        return self


def ivf_sizes(rows: int) -> tuple[int, int]:
    """(nlist, nprobe): the roots of the row count and of nlist, 1 at least."""
    nlist = max(1, min(math.isqrt(max(0, rows)), (1 << 31) - 1))
    return nlist, max(1, math.isqrt(nlist))


def resolve(type: IndexType | str, rows: int, dimension: int, metric: Metric | str = Metric.L2) -> IndexConfig:
    """What AUTO stands for at a number of rows; any other type as it is."""
    kind, metric = IndexType.of(type), Metric.of(metric)
    if kind is not IndexType.AUTO:
        return IndexConfig(kind, dimension, metric)
    if rows < FLAT_BELOW:
        return IndexConfig(IndexType.FLAT, dimension, metric)
    if rows < GRAPH_BELOW:
        m, build, search = (12, 128, 64) if rows < SMALL_GRAPH_BELOW else (16, 200, 100)
        return IndexConfig(IndexType.HNSW, dimension, metric, m=20 if dimension > WIDE else m, ef_construction=build, ef_search=search)
    nlist, nprobe = ivf_sizes(rows)
    if rows < SCALAR_BELOW:
        return IndexConfig(IndexType.IVF_SQ, dimension, metric, nlist=nlist, nprobe=nprobe)
    return IndexConfig(IndexType.IVF_TURBOQUANT, dimension, metric, nlist=nlist, nprobe=nprobe, bits=4 if rows < FOUR_BIT_BELOW else 2)


# --- codecs: encode a matrix to bytes a row, decode them to vectors


@dataclass
class ScalarCodec:
    """8 bits a dimension, between the least and the greatest value of each."""

    low: np.ndarray
    high: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        span = np.where(self.high > self.low, self.high - self.low, 1.0)
        return np.clip(np.floor((x - self.low) / span * 255 + 0.5), 0, 255).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes.astype(np.float64) / 255 * (self.high - self.low)

    @property
    def width(self) -> int:
        return len(self.low)


def nearest_centre(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The number of the row of c that is nearest to each row of x, in parts so that few products are held at a time."""
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, axis=1) for i in range(0, max(1, len(x)), 8192)])


def lloyd(x: np.ndarray, k: int, rounds: int = 20, seed: int = 42) -> np.ndarray:
    """k centroids of a sample by Lloyd's iteration; fewer rows than k are repeated."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest_centre(c, x)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, i], k) for i in range(x.shape[1])], axis=1)
        c[count > 0] = sums[count > 0] / count[count > 0][:, None]
    return c


@dataclass
class ProductCodec:
    """A byte for each of m parts of the vector: the nearest of up to 256 centroids of that part."""

    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, m: int = 8, bits: int = 8, seed: int = 42) -> ProductCodec:
        return cls(np.stack([lloyd(part, 1 << bits, seed=seed + i) for i, part in enumerate(np.split(x, m, axis=1))]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts = np.split(x, len(self.books), axis=1)
        return np.stack([nearest_centre(b, p) for b, p in zip(self.books, parts, strict=True)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    @property
    def width(self) -> int:
        return len(self.books)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of rows whose length is a power of two; its own inverse."""
    n = x.shape[1]
    y, h = x.astype(np.float64).copy(), 1
    while h < n:
        y = y.reshape(len(x), -1, 2, h)
        y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2)
        h *= 2
    return y.reshape(len(x), n) / math.sqrt(n)


@cache
def gaussian_levels(bits: int) -> np.ndarray:
    """The 2**bits values that lose least of a standard normal variable; for 8 bits, the middles of 256 cells up to 3.5."""
    if bits == 8:
        return (np.arange(256) + 0.5) * (7 / 256) - 3.5
    x = np.linspace(-6, 6, 60_001)
    p = np.exp(-x * x / 2)
    levels = np.linspace(-2, 2, 1 << bits)
    for _ in range(300):
        own = np.searchsorted((levels[1:] + levels[:-1]) / 2, x)
        levels = np.bincount(own, p * x, len(levels)) / np.bincount(own, p, len(levels))
    return levels


@dataclass
class RotationCodec:
    """The direction of a vector, randomly rotated so that its coordinates are nearly normal, at 1, 2, 4 or 8 bits each.

    Kept with the length in single precision and, with ``qjl``, the signs of random projections of what is lost.
    """

    dimension: int
    bits: int = 4
    qjl: bool = False
    seed: int = 42
    padded: int = field(init=False)

    def __post_init__(self):
        self.padded = 1 << max(0, (self.dimension - 1).bit_length())
        rng = np.random.default_rng(self.seed)
        self.signs = rng.choice([-1.0, 1.0], self.padded)
        self.levels = gaussian_levels(self.bits)
        self.projections = max(8, self.padded // 4 // 8 * 8) if self.qjl else 0
        self.matrix = rng.standard_normal((self.projections, self.padded))

    @property
    def width(self) -> int:
        return 4 + self.padded * self.bits // 8 + (0 if self.padded * self.bits % 8 == 0 else 1) + (4 + self.projections // 8 if self.qjl else 0)

    def rotate(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.padded))
        wide[:, : self.dimension] = x
        return hadamard(wide * self.signs)

    def encode(self, x: np.ndarray) -> np.ndarray:
        length = np.sqrt((x * x).sum(axis=1))
        y = self.rotate(x / np.where(length > 1e-8, length, 1)[:, None]) * math.sqrt(self.padded)
        code = np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, y).astype(np.uint8)
        bit = np.unpackbits(code[:, :, None], axis=2)[:, :, 8 - self.bits :].reshape(len(x), -1)
        parts = [length.astype("<f4").view(np.uint8).reshape(len(x), 4), np.packbits(bit, axis=1)]
        if self.qjl:
            rest = (y - self.levels[code]) / math.sqrt(self.padded)
            parts += [np.sqrt((rest * rest).sum(axis=1)).astype("<f4").view(np.uint8).reshape(len(x), 4), np.packbits(rest @ self.matrix.T > 0, axis=1)]
        return np.concatenate(parts, axis=1)

    def _read(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = (self.padded * self.bits + 7) // 8
        length = np.ascontiguousarray(codes[:, :4]).view("<f4").ravel().astype(np.float64)
        # The values that each byte stands for.
        bit = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, -1, self.bits)
        values = self.levels[bit @ (1 << np.arange(self.bits - 1, -1, -1))] / math.sqrt(self.padded)
        return length, values[codes[:, 4 : 4 + n]].reshape(len(codes), -1)[:, : self.padded], codes[:, 4 + n :]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        length, y, _ = self._read(codes)
        return (hadamard(y) * self.signs)[:, : self.dimension] * length[:, None]

    def inner(self, codes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner product with q, length) of each row; the query isn't quantised."""
        g, length = self.inners(codes, q[None])
        return g[0], length

    def inners(self, codes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of q x rows of codes, length of each row)."""
        length, y, rest = self._read(codes)
        turned = self.rotate(q)
        g = turned @ y.T
        if self.qjl:
            size = np.ascontiguousarray(rest[:, :4]).view("<f4").ravel().astype(np.float64)
            sign = np.unpackbits(rest[:, 4:], axis=1)[:, : self.projections] * 2.0 - 1
            g = g + math.sqrt(math.pi / 2) / self.projections * size * (turned @ self.matrix.T @ sign.T)
        return g * length, length


    def forms(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows whose products with ``turned`` queries are the estimates, squared lengths)."""
        length, y, rest = self._read(codes)
        y = y * length[:, None]
        if self.qjl:
            size = np.ascontiguousarray(rest[:, :4]).view("<f4").ravel().astype(np.float64)
            sign = np.unpackbits(rest[:, 4:], axis=1)[:, : self.projections] * 2.0 - 1
            y = np.concatenate([y, (math.sqrt(math.pi / 2) / self.projections * size * length)[:, None] * sign], axis=1)
        return y, length * length

    def turned(self, q: np.ndarray) -> np.ndarray:
        q = self.rotate(q)
        return np.concatenate([q, q @ self.matrix.T], axis=1) if self.qjl else q


Codec = ScalarCodec | ProductCodec | RotationCodec


def estimates(codec: Codec, codes: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """rows of q x rows of codes: distances from codes, under the same contract as exact ones."""
    if not isinstance(codec, RotationCodec):
        return pairwise(codec.decode(codes), q, metric)
    g, length = codec.inners(codes, q)
    nq = np.sqrt((q * q).sum(axis=1))[:, None]
    if metric == "inner_product":
        return -g
    if metric == "l2":
        return np.sqrt(np.maximum(length * length + nq * nq - 2 * g, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = 1 - np.clip(g / (length * nq), -1, 1)
    return np.where((length < 1e-8) | (nq < 1e-8), 2.0, cos)


def estimate(codec: Codec, codes: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    return estimates(codec, codes, q[None], metric)[0]


def _sample(df: DataFrame, vector: str, n: int, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, those of the least hash, the same whatever the partitions."""
    got = df.select(F.col(vector).alias("v")).orderBy(F.xxhash64("v")).limit(rows).toArrow()
    if not len(got):
        raise InvalidArgument("no rows to train on")
    return _matrix(got.column("v"), n)


def fit_codec(df: DataFrame, config: IndexConfig, vector: str = "vector") -> Codec | None:
    kind = config.check().type
    if kind is IndexType.IVF_SQ:
        ends = df.select(F.posexplode(vector)).groupBy("pos").agg(F.min("col"), F.max("col")).orderBy("pos").collect()
        return ScalarCodec(np.array([r[1] for r in ends], dtype=np.float64), np.array([r[2] for r in ends], dtype=np.float64))
    if kind is IndexType.IVF_PQ:
        return ProductCodec.fit(_sample(df, vector, config.dimension, TRAIN_ROWS), config.pq_m, config.pq_bits)
    if kind in (IndexType.TURBOQUANT, IndexType.IVF_TURBOQUANT):
        return RotationCodec(config.dimension, config.bits, config.qjl)
    return None


def encode(df: DataFrame, codec: Codec, dimension: int, vector: str = "vector") -> DataFrame:
    """With a binary column ``code``."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at = batch.schema.get_field_index(vector)
            codes = codec.encode(_matrix(batch.column(at), dimension)) if batch.num_rows else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "code"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("code", T.BinaryType())]))


def quantised_knn(df: DataFrame, codec: Codec, query: Sequence[float], k: int = DEFAULT_TOP_K, metric: Metric | str = Metric.L2, rescore: int = 0, filter: str | Node | None = None, as_of: int | None = None, id: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest by estimated distance; with ``rescore`` the exact nearest of the rescore * k best estimates."""
    metric = Metric.of(metric)
    q, name = np.asarray(query, dtype=np.float64), metric.value
    rows = select_rows(df, filter, as_of)
    want = check_top_k(k) if not rescore else k * rescore

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                d = np.round(estimate(codec, codes, q, name), DIGITS)
                ids = batch.column(0).to_numpy()
                best = np.lexsort((ids, d))[:want]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(best)), pa.array(d[best])], names=["id", "distance"])

    found = rows.select(F.col(id).cast("long").alias("id"), "code").mapInArrow(run, "id long, distance double").orderBy("distance", "id").limit(want)
    if not rescore:
        return found
    chosen = rows.join(F.broadcast(found.select(F.col("id").alias("__near"))), F.col(id) == F.col("__near"), "left_semi")
    return knn(chosen, query, k, metric, id=id, vector=vector)


def _estimated(codec: Codec, codes: np.ndarray, q: np.ndarray, metric: str) -> tuple[list[Rough], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """What ``closest`` needs to rank rows by the estimates from their codes."""
    if isinstance(codec, RotationCodec):
        (y, square), turned = codec.forms(codes), codec.turned(q)
    else:
        y, turned = codec.decode(codes), q
        square = (y * y).sum(axis=1)
    qq = (q * q).sum(axis=1)
    length, nq = np.sqrt(square), np.sqrt(qq)

    def measure(c: np.ndarray, r: np.ndarray) -> np.ndarray:
        g = (y[c] * turned[r]).sum(axis=1)
        if metric == "inner_product":
            return -g
        if metric == "l2":
            return np.sqrt(np.maximum(square[c] + qq[r] - 2 * g, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            cos = 1 - np.clip(g / (length[c] * nq[r]), -1, 1)
        return np.where((length[c] < ZERO_NORM) | (nq[r] < ZERO_NORM), 2.0, cos)

    good = np.isfinite(square).all() and np.isfinite(qq).all() and len(y) and len(q)
    return levels_of(y, square, turned, qq, metric) if good else [], measure


def _join(rows: DataFrame, asked: DataFrame, codec: Codec | None, n: int, k: int, metric: Metric, rescore: int, centroids: np.ndarray | None = None, nprobe: int = 0, sure: bool = False) -> DataFrame:
    """(query_id, id, distance, rank) of rows (id, vector and, where they are used, code and cluster) and queries (query_id, query_vector).

    With centroids a query meets the rows of the ``nprobe`` nearest clusters. Estimates of the codes choose the
    rescore * k rows that are then measured, or with ``sure`` codes only leave out what can't be among the k nearest.
    """
    want, name = k * rescore if codec is not None and rescore and not sure else k, metric.value

    def near(x: pa.Table, q: pa.Table) -> tuple[np.ndarray, ...]:
        v, ids, asked = _values(x.column("vector"), n), x.column("id").to_numpy(), _matrix(q.column("query_vector"), n)
        kept = few_copies(v, ids, want)
        cluster = None if centroids is None else x.column("cluster").to_numpy()[kept]
        if cluster is not None:
            kept = kept[np.argsort(cluster, kind="stable")]
            cluster = np.sort(cluster)
        v, ids = v[kept], ids[kept]
        if cluster is None:
            cuts, turns = [(0, len(v), 0)], None
        else:
            begins = np.flatnonzero(np.diff(cluster, prepend=-1))
            cuts = list(zip(begins.tolist(), np.append(begins[1:], len(v)).tolist(), cluster[begins].tolist(), strict=True))
            turns = np.full((len(asked), len(centroids)), -1, np.int32)
            np.put_along_axis(turns, _probes(centroids, asked, nprobe, metric), np.arange(nprobe, dtype=np.int32)[None], axis=1)
        true = lambda c, r: exact(v[c].astype(np.float64), asked[r], name)
        codes = None if codec is None else np.frombuffer(b"".join(x.column("code").take(pa.array(kept)).to_pylist()), np.uint8).reshape(len(v), -1)
        if codes is None or sure:
            levels = exact_levels(v, asked, name)
            if codes is not None and levels and metric is Metric.L2:
                y = codec.decode(codes)
                lost = np.sqrt(((v - y) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
                levels = [Rough(y, (y * y).sum(axis=1), asked, (asked * asked).sum(axis=1), name, np.float32, lost), *levels]
            row, place, d = closest(ids, len(asked), k, levels, true, cuts, turns)
            return row, ids[place], d, d
        row, place, d = closest(ids, len(asked), want, *_estimated(codec, codes, asked, name), cuts, turns)
        return row, ids[place], d, _round(true(place, row)) if rescore else d

    held = rows.select("id", "vector", *(["code"] if codec is not None else []), *(["cluster"] if centroids is not None else []))
    return tiled(held, asked, n, k, want, near)


def quantised_join(df: DataFrame, codec: Codec, queries: DataFrame, dimension: int, k: int = DEFAULT_TOP_K, metric: Metric | str = Metric.L2, rescore: int = 0) -> DataFrame:
    """``quantised_knn`` for every row of (query_id, query_vector), in tiles of coded rows and queries."""
    rows = df.select(F.col("id").cast("long").alias("id"), "vector", "code")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "query_vector")
    return _join(rows, asked, codec, dimension, check_top_k(k), Metric.of(metric), rescore)


def _probes(centroids: np.ndarray, q: np.ndarray, n: int, metric: Metric) -> np.ndarray:
    """The n nearest clusters of each query, nearest first."""
    if metric is not Metric.L2:
        q = q / np.maximum(1e-12, np.sqrt((q * q).sum(axis=1)))[:, None]
    return np.argsort(pairwise(centroids, q, "l2"), axis=1, kind="stable")[:, :n]


@dataclass
class ClusteredIndex:
    """Rows with a ``cluster`` column (and ``code``, if the kind has codes), and the clusters' centroids."""

    config: IndexConfig
    rows: DataFrame
    centroids: np.ndarray
    codec: Codec | None

    def probes(self, query: Sequence[float], nprobe: int | None = None) -> list[int]:
        return _probes(self.centroids, np.asarray(query, dtype=np.float64)[None], self._n(nprobe), self.config.metric)[0].tolist()

    def _n(self, nprobe: int | None) -> int:
        return min(nprobe or self.config.nprobe, len(self.centroids))

    def search(self, query: Sequence[float], k: int = DEFAULT_TOP_K, nprobe: int | None = None, rescore: int = 4, filter: str | Node | None = None, as_of: int | None = None, id: str = "id", vector: str = "vector") -> DataFrame:
        """Only the partitions of the nearest clusters are read."""
        near = self.rows.filter(F.col("cluster").isin(self.probes(query, nprobe)))
        if self.codec is None:
            return knn(near, query, k, self.config.metric, filter, as_of, id, vector)
        return quantised_knn(near, self.codec, query, k, self.config.metric, rescore, filter, as_of, id, vector)

    def join(self, queries: DataFrame, k: int = DEFAULT_TOP_K, nprobe: int | None = None, rescore: int = 4, sure: bool = False) -> DataFrame:
        """``search`` for every row of (query_id, query_vector): each query meets the rows of the clusters it probes.

        With ``sure`` every row of these clusters is measured that its code doesn't rule out, so that none of the k nearest is missed.
        """
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "query_vector")
        rows = self.rows.withColumn("id", F.col("id").cast("long")).withColumn("cluster", F.col("cluster").cast("int"))
        return _join(rows, asked, self.codec, self.config.dimension, check_top_k(k), self.config.metric, rescore, self.centroids, self._n(nprobe), sure)

    def model(self) -> dict:
        """What a stored index needs besides its table, as values that JSON can hold."""
        c = {k: v.value if isinstance(v, (IndexType, Metric)) else v for k, v in self.config.__dict__.items()}
        codec = self.codec
        kept = None if codec is None else {"low": codec.low.tolist(), "high": codec.high.tolist()} if isinstance(codec, ScalarCodec) else {"books": codec.books.tolist()} if isinstance(codec, ProductCodec) else {"seed": codec.seed}
        return {"config": c, "centroids": self.centroids.tolist(), "codec": kept}

    @classmethod
    def read(cls, spark, path: str, model: dict) -> ClusteredIndex:
        """A stored index again, from its table and its model."""
        c = model["config"]
        config = IndexConfig(**(c | {"type": IndexType(c["type"]), "metric": Metric(c["metric"])}))
        k = model["codec"]
        codec = None if k is None else ScalarCodec(np.array(k["low"]), np.array(k["high"])) if "low" in k else ProductCodec(np.array(k["books"])) if "books" in k else RotationCodec(config.dimension, config.bits, config.qjl, k["seed"])
        return cls(config, spark.read.parquet(path), np.array(model["centroids"]), codec)

    def write(self, path: str) -> ClusteredIndex:
        """As Parquet partitioned by cluster, so that a search prunes to the clusters it probes."""
        # Rows of a cluster go to several tasks, so that a large one isn't one task's work.
        self.rows.repartition(F.col("cluster"), F.pmod(F.xxhash64("id"), F.lit(8))).write.option("maxRecordsPerFile", 5_000_000).mode("overwrite").partitionBy("cluster").parquet(path)
        return ClusteredIndex(self.config, self.rows.sparkSession.read.parquet(path), self.centroids, self.codec)


def build_clustered(df: DataFrame, config: IndexConfig, vector: str = "vector", seed: int = 42, rounds: int = 20) -> ClusteredIndex:
    """Clusters by k-means on at most TRAIN_ROWS rows; under cosine and inner product of directions."""
    config.check()
    v = F.col(vector)
    if config.metric is not Metric.L2:
        n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        v = F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-12)))
    ready = df.withColumn("__features", array_to_vector(F.transform(v, lambda x: x.cast("double"))))
    sample = ready.orderBy(F.xxhash64(vector)).limit(TRAIN_ROWS)
    model = KMeans(k=config.nlist, seed=seed, maxIter=rounds, featuresCol="__features", predictionCol="cluster", initSteps=2).fit(sample)
    rows = model.transform(ready).drop("__features")
    codec = fit_codec(df, config, vector)
    if codec is not None:
        rows = encode(rows, codec, config.dimension, vector)
    return ClusteredIndex(config, rows, np.array(model.clusterCenters()), codec)


def recall(found: DataFrame, truth: DataFrame, id: str = "id") -> float:
    """The share of the true rows that were found."""
    want = truth.select(id).distinct()
    n = want.count()
    return want.join(found.select(id).distinct(), id, "left_semi").count() / n if n else 1.0
