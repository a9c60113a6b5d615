"""Readers of vectors with metadata: Parquet, NPY, CSV, pandas frames and arrays, h5ad where its library is there."""

from __future__ import annotations

import ast
import io
import json
import re
import struct
import sys
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.types import InvalidArgument, check_metadata_schema, family

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VECTORS = T.ArrayType(T.FloatType())


def shaped(df: DataFrame, id: Column, vector: Column, drop: Sequence[str] = ()) -> DataFrame:
    """id, vector and the columns that can be metadata, widened to long and double; columns of other types are left out."""
    out = [id.cast("long").alias("id"), vector.cast(VECTORS).alias("vector")]
    for f in df.schema:
        if f.name in drop:
            continue
        if f.name in ("sparse", "expires_at"):
            out.append(F.col(f.name))
        elif kind := family(f.dataType):
            out.append(F.col(f"`{f.name}`").cast({"int": "long", "double": "double", "string": "string", "bool": "boolean"}[kind]).alias(f.name))
    rows = df.select(*out)
    check_metadata_schema(rows.schema)
    return rows


def read_parquet(spark: SparkSession, path: str, id: str = "id", vector: str = "vector") -> DataFrame:
    df = spark.read.parquet(path)
    if id not in df.columns or vector not in df.columns:
        raise InvalidArgument(f"columns {id} and {vector} are needed")
    if family(df.schema[id].dataType) != "int" or not isinstance(df.schema[vector].dataType, T.ArrayType):
        raise InvalidArgument("the id must be a whole number and the vector a list of numbers")
    return shaped(df, F.col(id), F.col(vector), (id, vector))


def npy_header(data: bytes) -> tuple[int, int, int]:
    """(rows, columns, offset of the values) of a little-endian float32 matrix in C order."""
    if data[:6] != b"\x93NUMPY" or len(data) < 10:
        raise InvalidArgument("not an NPY file")
    wide = data[6] >= 2
    size = struct.unpack_from("<I" if wide else "<H", data, 8)[0]
    at = 12 if wide else 10
    head = ast.literal_eval(data[at : at + size].decode("latin1" if data[6] < 3 else "utf-8"))
    if head["descr"] != "<f4" or head["fortran_order"] or len(head["shape"]) != 2 or head["shape"][0] < 1:
        raise InvalidArgument("only two-dimensional float32 in C order with at least a row")
    return head["shape"][0], head["shape"][1], at + size


def npy_bytes(matrix: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(matrix), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def read_npy(spark: SparkSession, path: str, start_id: int = 1, piece: int = 10_000) -> DataFrame:
    """(id, vector) of a matrix; ids from ``start_id`` by row. Tasks read row ranges of the file, each only its own bytes.

    Needs a path that every executor can open, as any input of Spark does.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    stream = fs_path.getFileSystem(conf).open(fs_path)
    try:
        head = bytes(stream.readNBytes(4096))
    finally:
        stream.close()
    rows, columns, offset = npy_header(head)
    if fs_path.getFileSystem(conf).getScheme() != "file":
        return _read_npy_whole(spark, path, start_id)
    local = re.sub(r"^file:(//)?", "", path)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for k in batch.column(0).to_pylist():
                n = min(piece, rows - k * piece)
                with open(local, "rb") as f:
                    f.seek(offset + k * piece * columns * 4)
                    values = np.frombuffer(f.read(n * columns * 4), dtype="<f4")
                if len(values) != n * columns:
                    raise ValueError("file too short")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + k * piece + start_id), pa.ListArray.from_arrays(pa.array(np.arange(0, n * columns + 1, columns, dtype=np.int32)), pa.array(values))], names=["id", "vector"])

    pieces = -(-rows // piece)
    return spark.range(0, pieces, 1, min(pieces, 10_000)).mapInArrow(read, T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", VECTORS)]))


def _read_npy_whole(spark: SparkSession, path: str, start_id: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("content")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for raw in batch.column(0):
                data = raw.as_py()
                rows, columns, offset = npy_header(data)
                values = np.frombuffer(data, "<f4", rows * columns, offset)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows) + start_id), pa.ListArray.from_arrays(pa.array(np.arange(0, rows * columns + 1, columns, dtype=np.int32)), pa.array(values))], names=["id", "vector"])

    return files.mapInArrow(read, T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", VECTORS)]))


def read_csv(spark: SparkSession, path: str, id: str = "id", vector: str = "vector", wide: str = "vector_") -> DataFrame:
    """A JSON list in the vector column, or columns vector_0 to vector_N in the order of their numbers."""
    df = spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(path)
    if vector in df.columns:
        return shaped(df, F.col(id), F.from_json(F.col(vector).cast("string"), VECTORS), (id, vector))
    parts = sorted((c for c in df.columns if re.fullmatch(re.escape(wide) + r"\d+", c)), key=lambda c: int(c[len(wide) :]))
    if not parts:
        raise InvalidArgument("no vector column found")
    return shaped(df, F.col(id), F.array(*(F.col(c).cast("float") for c in parts)), (id, *parts))


def from_array(spark: SparkSession, matrix: np.ndarray, ids: Sequence[int] | None = None, metadata: dict[str, Sequence[Any]] | None = None) -> DataFrame:
    if matrix.ndim != 2:
        raise InvalidArgument("a two-dimensional array is needed")
    if ids is not None and len(ids) != len(matrix):
        raise InvalidArgument("as many ids as rows are needed")
    table = pa.table({"id": pa.array(np.arange(len(matrix)) if ids is None else np.asarray(ids, dtype=np.int64)), "vector": pa.array(list(matrix.astype(np.float32)), pa.list_(pa.float32())), **{k: pa.array(list(v)) for k, v in (metadata or {}).items()}})
    return spark.createDataFrame(table)


def from_pandas(spark: SparkSession, frame: pd.DataFrame, id: str = "id", vector: str = "vector") -> DataFrame:
    """Vectors as lists, arrays or JSON text; missing metadata is null. A frame of another library that has to_pandas will do."""
    frame = frame.to_pandas() if not isinstance(frame, pd.DataFrame) and hasattr(frame, "to_pandas") else frame
    if vector not in frame:
        raise InvalidArgument(f"column {vector} is needed")
    vectors = [json.loads(v) if isinstance(v, str) else [float(x) for x in v] for v in frame[vector]]
    columns: dict[str, Any] = {"id": pa.array(frame[id].astype("int64") if id in frame else np.arange(len(frame))), "vector": pa.array(vectors, pa.list_(pa.float32()))}
    for c in frame.columns:
        if c not in (id, vector):
            columns[str(c)] = pa.array([None if x is None or isinstance(x, float) and np.isnan(x) or x is pd.NA or x is pd.NaT else x.item() if isinstance(x, np.generic) else x for x in frame[c]])
    return spark.createDataFrame(pa.table(columns))


def read_h5ad(spark: SparkSession, path: str, key: str = "X_pca") -> DataFrame:
    """Rows of obsm[key] with the obs columns; needs the anndata library on the driver."""
    try:
        import anndata
    except ImportError as e:
        raise InvalidArgument("anndata isn't installed") from e
    data = anndata.read_h5ad(path)
    matrix = data.obsm[key]
    matrix = matrix.toarray() if hasattr(matrix, "toarray") else np.asarray(matrix)
    return from_pandas(spark, data.obs.assign(vector=list(matrix), id=np.arange(len(matrix))).reset_index(drop=True))
