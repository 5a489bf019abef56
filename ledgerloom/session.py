"""What a session needs before Python runs on its executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Rows that Python gets at a time where the session still has Spark's default (10,000): rows with whole texts are long,
#: and worker processes keep the memory that their largest batch took.
BATCH_SETTING, SPARKS_BATCH, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application; they need not have it installed. Also bounds batches."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_SETTING) == SPARKS_BATCH:
        spark.conf.set(BATCH_SETTING, BATCH)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    # Spark's own folder for files of this application, which it removes at the end
    path = Path(SparkFiles.getRootDirectory(), "shipped", f"{root.name}.zip")
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one (a test) gets a temporary folder."""
    ship(spark)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if path is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def lists(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of some columns as Python values, by way of numpy: several times as fast as to_pylist()."""
    columns = [batch.column(n) for n in names]
    exact = lambda c: c.null_count and not (pa.types.is_string(c.type) or pa.types.is_large_string(c.type))  # numpy makes numbers with nulls floats
    return zip(*(c.to_pylist() if exact(c) else c.to_numpy(zero_copy_only=False).tolist() for c in columns), strict=True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
