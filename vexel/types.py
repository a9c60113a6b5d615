"""Metrics, index kinds, limits and the checks of rows and names."""

from __future__ import annotations

import math
import re
from enum import Enum

from pyspark.sql import types as T

MAX_DIMENSION = 8192
MAX_BATCH = 50_000
MAX_IDS = 10_000
MAX_FIELDS = 100
MAX_KEY = 255
MAX_STRING = 65_536
DEFAULT_TOP_K, MAX_TOP_K = 10, 1000
DEFAULT_RANGE_RESULTS = 1000
ZERO_NORM = 1e-8
RESERVED = ("id", "vector", "sparse", "expires_at")
_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


class EngineError(ValueError):
    """Base of the errors that a caller can act on."""


class InvalidArgument(EngineError):
    pass


class NotFound(EngineError):
    pass


class AlreadyExists(EngineError):
    pass


class Metric(str, Enum):
    L2 = "l2"
    INNER_PRODUCT = "inner_product"
    COSINE = "cosine"

    @classmethod
    def of(cls, value: Metric | str) -> Metric:
        name = value.value if isinstance(value, Metric) else str(value).lower()
        if name in ("ip", "dot"):
            return cls.INNER_PRODUCT
        try:
            return cls(name)
        except ValueError:
            raise InvalidArgument(f"unknown metric: {value}") from None


class IndexType(str, Enum):
    FLAT = "flat"
    HNSW = "hnsw"
    IVF_FLAT = "ivf_flat"
    IVF_PQ = "ivf_pq"
    IVF_SQ = "ivf_sq"
    TURBOQUANT = "turboquant"
    IVF_TURBOQUANT = "ivf_turboquant"
    AUTO = "auto"

    @classmethod
    def of(cls, value: IndexType | str) -> IndexType:
        try:
            return value if isinstance(value, IndexType) else cls(str(value).lower())
        except ValueError:
            raise InvalidArgument(f"unknown index type: {value}") from None


SPARSE = T.ArrayType(T.StructType([T.StructField("idx", T.LongType()), T.StructField("val", T.FloatType())]))
BASE_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("sparse", SPARSE), T.StructField("expires_at", T.LongType())])


def family(kind: T.DataType) -> str | None:
    """int, double, string or bool: the four kinds of metadata; None for anything else."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(kind, T.StringType):
        return "string"
    return "bool" if isinstance(kind, T.BooleanType) else None


def check_name(name: str) -> str:
    """Names become folders, so separators and dots alone are refused besides the empty name."""
    if not name or not name.strip() or "/" in name or "\\" in name or "\0" in name or name in (".", ".."):
        raise InvalidArgument(f"bad collection name: {name!r}")
    return name


def check_dimension(n: int) -> int:
    if not 1 <= n <= MAX_DIMENSION:
        raise InvalidArgument(f"dimension must be from 1 to {MAX_DIMENSION}, not {n}")
    return n


def check_top_k(k: int) -> int:
    if not 1 <= k <= MAX_TOP_K:
        raise InvalidArgument(f"top_k must be from 1 to {MAX_TOP_K}, not {k}")
    return k


def check_id(value: int) -> int:
    if not 0 <= value < 1 << 63:
        raise InvalidArgument(f"id out of range: {value}")
    return value


def check_metadata(values: dict) -> dict:
    """A metadata map: at most 100 fields, keys like identifiers, finite doubles, strings of at most 65536 bytes."""
    if len(values) > MAX_FIELDS:
        raise InvalidArgument(f"more than {MAX_FIELDS} metadata fields")
    for key, value in values.items():
        if not isinstance(key, str) or len(key) > MAX_KEY or not _KEY.match(key):
            raise InvalidArgument(f"bad metadata key: {key!r}")
        if isinstance(value, float) and not math.isfinite(value):
            raise InvalidArgument(f"{key}: not a finite number")
        if isinstance(value, str) and len(value.encode()) > MAX_STRING:
            raise InvalidArgument(f"{key}: string too long")
        if not isinstance(value, (bool, int, float, str)):
            raise InvalidArgument(f"{key}: {type(value).__name__} can't be metadata")
    return values


def check_metadata_schema(schema: T.StructType) -> list[str]:
    """The metadata columns of a schema, checked."""
    names = [f.name for f in schema if f.name not in RESERVED]
    if len(names) > MAX_FIELDS:
        raise InvalidArgument(f"more than {MAX_FIELDS} metadata fields")
    for f in schema:
        if f.name in RESERVED:
            continue
        if len(f.name) > MAX_KEY or not _KEY.match(f.name):
            raise InvalidArgument(f"bad metadata key: {f.name!r}")
        if family(f.dataType) is None:
            raise InvalidArgument(f"{f.name}: {f.dataType.simpleString()} can't be metadata")
    return names


def check_sparse(pairs: list[tuple[int, float]]) -> list[tuple[int, float]]:
    for k, (i, v) in enumerate(pairs):
        if math.isnan(v):
            raise InvalidArgument("sparse value is not a number")
        if not 0 <= i < 1 << 32 or k and pairs[k - 1][0] >= i:
            raise InvalidArgument("sparse indices must ascend")
    return pairs
