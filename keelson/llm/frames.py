"""Plumbing between DataFrames and vectorised functions over Arrow tables."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.textvec import sized

#: Bytes of text that one vectorised call works on; some 20 to 60 times as much memory is used meanwhile.
CHUNK_BYTES = 2 << 20

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns of these names, whatever their case."""
    low = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in low]
    return df.select(*[F.col(f"`{c}`") for c in kept])


def append(df: DataFrame, text: str, fields: dict[str, str], fn: Callable[[pa.Table], list], target: int = CHUNK_BYTES, keep: list[str] | None = None, drop_text: bool = False) -> DataFrame:
    """df with further columns that fn makes of a table of its rows; columns of df with these names are replaced.

    fields: name to Spark type. fn returns one array for each field. keep: the columns of df to hand on (all by default).
    """
    low = {n.lower() for n in fields}
    handed = [f for f in df.schema.fields if f.name.lower() not in low and (keep is None or f.name in keep) and not (drop_text and f.name == text)]
    schema = T.StructType(handed + [T.StructField(n, T._parse_datatype_string(k)) for n, k in fields.items()])
    names = [f.name for f in handed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sized(batches, text, target):
            made = [as_array(a, k) for a, k in zip(fn(table), fields.values(), strict=True)]
            out = pa.table([table.column(n) for n in names] + made, names=names + list(fields))
            yield from out.combine_chunks().to_batches()

    return df.mapInArrow(task(run, fn.__module__), schema)


def explode(df: DataFrame, text: str, fields: dict[str, str], fn: Callable[[pa.Table], Iterator[list]], target: int = CHUNK_BYTES) -> DataFrame:
    """The rows that fn makes of tables of df's rows: any number for each, as lists of arrays."""
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sized(batches, text, target):
            for arrays in fn(table):
                yield pa.RecordBatch.from_arrays([as_array(a, k) for a, k in zip(arrays, fields.values(), strict=True)], names=list(fields))

    return df.mapInArrow(task(run, fn.__module__), schema)


#: What a worker keeps between tasks, emptied before it works for another operator.
_kept: list[dict] = []
_owner = [""]


def kept() -> dict:
    """A table that tasks of one operator may keep things in: Python workers outlive their tasks."""
    out: dict = {}
    _kept.append(out)
    return out


def task(run: Callable[[Iterator], Iterator], owner: str) -> Callable[[Iterator], Iterator]:
    """run, as a task of an operator: what others kept goes before, and unused memory after."""

    def own(batches: Iterator) -> Iterator:
        enter(owner)
        yield from run(batches)
        trim()

    return own


def enter(owner: str) -> None:
    if _owner[0] != owner:
        for table in _kept:
            table.clear()
        _owner[0] = owner
        trim()


def trim() -> None:
    """Give memory that a task no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def grouped(df: DataFrame, key: str, tasks: int, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What fn makes of all rows of each value of `key`, numbers from 0 on that `tasks` tasks share evenly: as
    groupBy().applyInArrow(), but no two of the first `tasks` values meet in a task, as they do by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            values = table.column(key).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)) if len(values) else np.zeros(1, np.int64)
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if held and held[0].column(key)[0].as_py() != values[low]:
                    yield from fn(pa.concat_tables(held)).to_batches()
                    held = []
                held.append(table.slice(low, high - low))
        if held:
            yield from fn(pa.concat_tables(held)).to_batches()

    dealt = df.repartitionById(tasks, F.pmod(F.col(key), F.lit(tasks)).cast("int")).sortWithinPartitions(key)
    return dealt.mapInArrow(task(run, fn.__module__), schema)


def as_array(values, kind: str) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    if isinstance(values, np.ndarray) and values.dtype == np.uint64:
        values = values.view(np.int64)
    if isinstance(values, np.ndarray) and values.dtype.kind in "iub" and kind in ("long", "int"):
        values = values.astype(np.int64 if kind == "long" else np.int32)
    return pa.array(values, _ARROW.get(kind))


def packed(pieces: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values, each holding the next counts[i] items of the array."""
    raw = np.ascontiguousarray(pieces)
    offs = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offs[1:])
    offs = (offs * raw.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offs), pa.py_buffer(raw)])


def text_key(text: str = "text") -> Column:
    """16 bytes that stand for a text; a null stands with the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))


def bucket_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the identifier written as text, by a modulus; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, as in tests, a
    folder of this machine, if all of Spark runs on it; else it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/keelson-checkpoints"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str) -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()  # finished jobs' shuffle files go once the JVM notices
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, marked for broadcast if a count says that it has `rows` rows at most; for narrow settled tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slices(spark: SparkSession) -> int:
    """How many parts a shuffle has by the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_path(uri: str) -> str:
    return uri[7:] if uri.startswith("file://") else uri[5:] if uri.startswith("file:") else uri


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for the shared folder's kind of store."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), os.path.normpath(local_path(uri))
    return fs.FileSystem.from_uri(uri)
