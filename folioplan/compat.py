"""Session policies that every operator shares: time zone, table access, lineage cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Unicode-aware trim: Spark's own trim() removes U+0020 only.
_EDGE_SPACE = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"


def prepare(spark: SparkSession) -> SparkSession:
    """Sets what results depend on (UTC), and a checkpoint folder of its own in a local session that names none."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not configured and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="folioplan-checkpoint-"))
    # Python workers start in folders of their own: they find this package where the driver found it.
    root, paths = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), sc.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: survives the loss of executors and cuts lineage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """As cut(), in compressed columns: a checkpoint holds rows as they are in memory, several times the size of the input
    where rows are texts.  The files stay until dropped(), or until the session ends."""
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what kept() wrote for these tables, and lets go of the shuffles behind them."""
    spark = tables[0].sparkSession
    for t in tables:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._kept)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    release(spark)


def by_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, most: int = 500) -> DataFrame:
    """mapInPandas() over frames of up to ``most`` rows: of a batch of 10,000 wide rows only a slice becomes Python objects."""
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                yield b.slice(at, most).to_pandas()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(frames(batches)):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=kind, preserve_index=False)

    return df.mapInArrow(go, schema)


def release(spark: SparkSession) -> None:
    """Lets go of what earlier rounds of a loop left: Spark deletes shuffle files, broadcasts and (where it is told to)
    checkpoints when the driver's collector finds that nothing refers to them, and a loop should not wait for that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACE, "")


def blank_to_null(c: Column) -> Column:
    """NULL for null, empty and all-space strings; the trimmed string otherwise."""
    t = js_trim(c)
    return F.when(t != "", t)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    """Shuffle partitions of the session, never below the cores at hand."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
