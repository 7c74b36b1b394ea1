"""Small helpers around sessions, shared storage and Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a new local one where that is unset and Spark is local (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


_written: dict[int, tuple[DataFrame, str]] = {}


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; lineage ends there. Removed by ``forget``, or when Python exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = out, path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if id(t) in _written:
            drop(t.sparkSession, _written.pop(id(t))[1])


def drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already
        return


def keep_rows(df: DataFrame, column: str, mask: Callable[[pa.RecordBatch, int], np.ndarray]) -> DataFrame:
    """Rows of ``df``, all columns as they are, for which ``mask(batch, index of column)`` is true."""
    at = df.columns.index(column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(mask(b, at)))

    return df.mapInArrow(run, df.schema)


def arrays(schema: T.StructType | pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of NumPy arrays or lists under an Arrow schema."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def runs(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Groups of rows of equal first column, over batch limits; ``columns`` NumPy columns each."""
    parts: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        cut = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        ends = np.append(cut, len(now[0]))
        for a, z in zip(np.append(0, cut), ends):
            if parts and (a or parts[-1][0][-1] != now[0][0]):
                yield [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts)]
                parts = []
            parts.append([c[a:z] for c in now])
    if parts:
        yield [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts)]


def sample_below(rate: float) -> int:
    """Threshold on a hash modulo 2**30 that holds for about ``rate`` of all rows."""
    return int(min(1.0, max(0.0, rate)) * (1 << 30))
