"""Distances between vectors, as columns and as array kernels; sums are in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vexel.types import ZERO_NORM, InvalidArgument, Metric


def literal(vector: Sequence[float]) -> Column:
    """A vector as a constant, of the values that it has in single precision."""
    return F.lit(np.asarray(vector, dtype=np.float32).astype(np.float64).tolist()).cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalized(a: Column) -> Column:
    """The vector at length 1; null for one of length 0."""
    n = norm(a)
    return F.when(n >= ZERO_NORM, F.transform(a, lambda x: x.cast("double") / n))


def distance(a: Column, b: Column, metric: Metric | str) -> Column:
    """Smaller is nearer: root of squared differences, negated inner product, or 1 - cosine (2 if a vector has length 0)."""
    metric = Metric.of(metric)
    if metric is Metric.L2:
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    if metric is Metric.INNER_PRODUCT:
        return -dot(a, b)
    na, nb = norm(a), norm(b)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))
    return F.when((na < ZERO_NORM) | (nb < ZERO_NORM), F.lit(2.0)).otherwise(1.0 - cos)


def same_size(a: Column, n: int) -> Column:
    """True, or an error for a vector of another dimension (a shorter one would be padded without a word)."""
    return F.when(F.size(a) == n, True).otherwise(F.raise_error(F.concat(F.lit(f"vector of dimension {n} expected, not "), F.size(a).cast("string"))).cast("boolean"))


def pairwise(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """rows of q x rows of x, by matrix products; ``exact`` gives the contract's digits."""
    g = q @ x.T
    if metric == "inner_product":
        return -g
    xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
    if metric == "l2":
        return np.sqrt(np.maximum(qq[:, None] - 2 * g + xx[None], 0))
    nx, nq = np.sqrt(xx), np.sqrt(qq)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 1 - np.clip(g / (nq[:, None] * nx[None]), -1, 1)
    out[(nq < ZERO_NORM)[:, None] | (nx < ZERO_NORM)[None]] = 2.0
    return out


def exact(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Row by row, from differences and not from products."""
    if metric == "l2":
        return np.sqrt(((x - q) ** 2).sum(axis=-1))
    g = (x * q).sum(axis=-1)
    if metric == "inner_product":
        return -g
    nx, nq = np.sqrt((x * x).sum(axis=-1)), np.sqrt((q * q).sum(axis=-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 1 - np.clip(g / (nx * nq), -1, 1)
    return np.where((nx < ZERO_NORM) | (nq < ZERO_NORM), 2.0, out)


def sparse_dot(a: Column, b: Column) -> Column:
    """Of two arrays of (idx, val); 0 if they share no index."""
    other = F.map_from_entries(b)
    return F.coalesce(_sum(F.transform(a, lambda e: e["val"].cast("double") * F.coalesce(other[e["idx"]].cast("double"), F.lit(0.0)))), F.lit(0.0))


def sparse_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda e: e["val"].cast("double") * e["val"].cast("double"))))


def sparse_cosine(a: Column, b: Column) -> Column:
    n = sparse_norm(a) * sparse_norm(b)
    return F.when((sparse_norm(a) < ZERO_NORM) | (sparse_norm(b) < ZERO_NORM), F.lit(0.0)).otherwise(sparse_dot(a, b) / n)


def zero_vector(n: int) -> list[float]:
    return [0.0] * n


def random_vector(n: int, seed: int = 0) -> list[float]:
    return np.random.default_rng(seed).uniform(-1, 1, n).astype(np.float32).tolist()


def check_same_dimension(a: Sequence[float], b: Sequence[float]) -> None:
    if len(a) != len(b):
        raise InvalidArgument(f"dimensions {len(a)} and {len(b)} differ")


def register(spark: SparkSession) -> None:
    """SQL functions vec_l2, vec_ip and vec_cosine of two arrays, as temporary SQL functions that the optimiser sees through."""
    fold = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, x) -> s + x)"
    own = "aggregate(transform({0}, x -> cast(x as double) * cast(x as double)), 0D, (s, x) -> s + x)"
    product = fold.format("cast(x as double) * cast(y as double)")
    bodies = {
        "vec_l2": f"sqrt({fold.format('(cast(x as double) - cast(y as double)) * (cast(x as double) - cast(y as double))')})",
        "vec_ip": f"-({product})",
        "vec_cosine": f"case when {own.format('a')} < 1e-16 or {own.format('b')} < 1e-16 then 2D else 1D - greatest(-1D, least(1D, {product} / sqrt({own.format('a')} * {own.format('b')}))) end",
    }
    for name, body in bodies.items():
        spark.sql(f"create or replace temporary function {name}(a array<double>, b array<double>) returns double return {body}")
