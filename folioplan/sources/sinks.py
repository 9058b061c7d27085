"""Writes: upsert, insert-if-absent, replace, cascading delete, and versioned tables to write them to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioplan.operators import reconcile


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows replace those of their key; of several incoming rows of a key one stays."""
    new = incoming.dropDuplicates([key])
    return existing.join(new.select(key), key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def insert_missing(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows whose key is not there yet."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(*incoming.columns)


def delete_papers(papers: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers and edges without those of ``gone`` (id), whichever end of an edge they are (K5)."""
    left = papers.join(gone.select("id"), "id", "left_anti")
    rest = edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    return left, rest.select(*edges.columns)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("id"), "id", "left_anti")


def put_papers(papers: DataFrame, edges: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers after an upsert that keeps what is known of their references, and edges after reconciliation (K2, T4).

    References of an incoming paper are merged with those stored; edges are inferred over the library as it will be.
    """
    cells = reconcile.references(papers.join(incoming.select("id"), "id", "left_semi")).withColumn("late", F.lit(0)).unionByName(reconcile.references(incoming).withColumn("late", F.lit(1)))
    merged = reconcile.merged_references(cells.withColumn("ordinal", F.col("late") * 1_000_000 + F.col("ordinal")).drop("late"))
    element = papers.schema["extractedReferences"].dataType.elementType
    names = [f.name for f in element.fields]
    packed = merged.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*names).alias("r")))).alias("x")).select("id", F.transform("x", lambda y: y["r"]).alias("refs"))
    kept = incoming.join(packed, "id", "left").withColumn("extractedReferences", F.coalesce(F.col("refs").cast(papers.schema["extractedReferences"].dataType), F.col("extractedReferences"))).drop("refs")
    after = upsert(papers, kept)
    new = reconcile.inferred_edges(after, edges)
    full = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in edges.columns])
    return after, edges.unionByName(full)


class VersionedTable:
    """A Parquet table that is replaced whole and atomically: each write is a new folder, a pointer names the current one.

    Readers see the old or the new version, never a mixture; a lost executor costs a retry of its tasks, not the table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.root = jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if not self.fs.exists(self.root):
            return 0
        done = [s.getPath().getName() for s in self.fs.listStatus(self.root)]
        done = [int(n[1:]) for n in done if n[:1] == "v" and n[1:].isdigit() and self.fs.exists(p(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=0)

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v{v}") if v else None

    def replace(self, df: DataFrame, keep: int = 2) -> int:
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        old = v - keep
        if old > 0:
            self.fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}"), True)
        return v

    def upsert(self, incoming: DataFrame, key: str = "id") -> int:
        now = self.read()
        return self.replace(incoming.dropDuplicates([key]) if now is None else upsert(now, incoming, key))
