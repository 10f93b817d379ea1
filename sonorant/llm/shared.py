"""What the text operators share: shared-folder tables, Arrow scans in bounded slices, labelled samples."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one Arrow slice holds at most (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20
#: Rows that Spark sends a Python worker at once, unless the session asks for fewer: a batch is held whole on both sides.
BATCH_ROWS = 1000
#: Per worker process, what the tasks of the last job that holds something share.
_HELD: dict[str, object] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the cluster shares the folder it lies in, and get batches of BATCH_ROWS."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset, one of our own if the master is local (tests)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="sonorant-checkpoint-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it again: cuts lineage, survives lost executors.

    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def held(token: str, make: Callable[[], object]) -> object:
    """make() once per worker process and token; what another token held is let go."""
    if token not in _HELD:
        let_go()
        _HELD[token] = make()
    return _HELD[token]


def let_go() -> None:
    """Workers outlive their jobs: free what an earlier job held."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice's texts (column number ``text``) take at most ``most`` bytes, or one row."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def scan(df: DataFrame, text: str, schema: str, make: Callable[[], tuple[Callable, Callable | None]], holds: bool = False) -> DataFrame:
    """mapInArrow over bounded slices. make() gives (each, last) per task: each(slice) and last() return lists of arrays.

    holds: make() uses ``held``; other scans begin by freeing what an earlier job held.
    """
    ship(df.sparkSession)
    at = df.columns.index(text)
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            let_go()
        each, last = make()
        for batch in batches:
            for piece in slices(batch, at):
                out = each(piece)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)
        if last is not None:
            out = last()
            if out is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)

    return df.mapInArrow(run, schema)


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def labelled_ids(labels: DataFrame, label: str, most: int, where: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, label 0/1) of at most ``most`` labelled documents, sorted by id; beyond the bound, those of least hash.

    Ids that carry both labels count with the larger; null ids and labels other than 0 and 1 don't count.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = rows.count()
    if n > most:  # first by a bound on the hash, so that no task orders more than about the rows wanted
        share = most / n + 10 * (most**0.5 + 10) / n
        rows = rows.where(F.xxhash64("doc_id") < int(-(2**63) + min(1.0, share) * (2**64 - 2)))
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow()
    ids, y = got["doc_id"].to_numpy(), got["y"].to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], y[order]


def label_of(doc_ids: pa.Array, ids: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Label of each document of a batch, -1 where it has none."""
    out = np.full(len(doc_ids), -1, dtype=np.int64)
    if not len(ids) or not len(doc_ids):
        return out
    known = np.asarray(pc.is_valid(doc_ids))
    got = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.minimum(np.searchsorted(ids, got), len(ids) - 1)
    hit = known & (ids[at] == got)
    out[hit] = y[at[hit]]
    return out


def env_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns_apart(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Only the named columns, so that extra columns, whatever their names, meet none of ours."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def root_path() -> str:
    return os.fspath(Path(__file__).resolve().parents[2])
