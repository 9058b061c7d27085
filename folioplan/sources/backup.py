"""JSON backups and single papers as JSON, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioplan.schema import EDGE, PAPER, TOPIC, fields

VERSION = 1
_LIBRARY = "struct<schemaVersion:int,papers:array<string>,edges:array<string>,topics:array<string>,meta:map<string,string>>"


def _records(raw: DataFrame, name: str, schema: str) -> DataFrame:
    """Rows of one collection; what the schema does not name is kept as JSON in ``extra``."""
    known = [f for f in fields(schema) if f != "extra"]
    cells = raw.select(F.explode(F.col(f"b.{name}")).alias("j"))
    row = F.from_json("j", schema)
    rest = F.map_filter(F.from_json("j", "map<string,string>"), lambda k, v: ~k.isin(*known, "extra"))
    return cells.select(row.alias("r"), rest.alias("rest")).select(*[F.col(f"r.{f}").alias(f) for f in known], F.coalesce(F.when(F.size("rest") > 0, F.to_json("rest")), F.col("r.extra")).alias("extra"))


def parse(texts: DataFrame, column: str = "value") -> dict[str, DataFrame]:
    """papers, edges, topics and meta of backups; a text that is no backup of this version stops the read with an error."""
    b = F.from_json(column, _LIBRARY)
    raw = texts.select(b.alias("b"))
    wrong = F.col("b").isNull() | F.col("b.schemaVersion").isNull() | (F.col("b.schemaVersion") != VERSION)
    lacking = F.col("b.papers").isNull() | F.col("b.edges").isNull() | F.col("b.topics").isNull()
    checked = raw.select(F.when(wrong, F.raise_error(F.lit("unsupported schema version of a backup"))).when(lacking, F.raise_error(F.lit("a backup lacks papers, edges or topics"))).otherwise(F.col("b")).alias("b"))
    meta = checked.select(F.explode("b.meta").alias("key", "value"))
    return {"papers": _records(checked, "papers", PAPER), "edges": _records(checked, "edges", EDGE), "topics": _records(checked, "topics", TOPIC), "meta": meta}


def read(spark: SparkSession, *paths: str) -> dict[str, DataFrame]:
    return parse(spark.read.text(list(paths), wholetext=True))


def parse_papers(texts: DataFrame, column: str = "value") -> DataFrame:
    """Single papers, bare or wrapped; library collections, blank titles and wrong versions are errors."""
    j = F.from_json(column, "struct<schemaVersion:string,paper:string,papers:string,edges:string,topics:string,title:string,authors:string>")
    cells = texts.select(F.col(column).alias("t"), j.alias("j"))
    wrapped = F.col("j.paper").startswith("{")
    collection = F.col("j.papers").startswith("[") | F.col("j.edges").startswith("[") | F.col("j.topics").startswith("[")
    version = F.col("j.schemaVersion")
    body = F.when(wrapped, F.col("j.paper")).otherwise(F.col("t"))
    paper = F.from_json(body, PAPER)
    shape = F.from_json(body, "struct<title:string,authors:string>")
    problem = (
        F.when(F.col("j").isNull(), "not a JSON object")
        .when(F.coalesce(collection, F.lit(False)), "library collections, not one paper")
        .when(F.coalesce(wrapped, F.lit(False)) & ~F.coalesce(version == "1", F.lit(False)), "a wrapper must use schema version 1")
        .when(version.isNotNull() & (version != "1"), "unsupported schema version")
        .when(F.trim(F.coalesce(shape["title"], F.lit(""))) == "", "a paper needs a title")
        .when(shape["authors"].isNotNull() & ~shape["authors"].startswith("["), "authors must be an array")
    )
    return cells.select(F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(paper).alias("p")).select("p.*")


def kind_of(texts: DataFrame, column: str = "value") -> DataFrame:
    """Adds kind: library, paper or invalid, by what the JSON holds."""
    j = F.from_json(column, "struct<papers:string,edges:string,topics:string,paper:string,title:string>")
    library = j["papers"].startswith("[") | j["edges"].startswith("[") | j["topics"].startswith("[")
    return texts.withColumn("kind", F.when(F.coalesce(library, F.lit(False)), "library").when(j["paper"].isNotNull() | j["title"].isNotNull(), "paper").otherwise("invalid"))


def export_rows(papers: DataFrame, edges: DataFrame, topics: DataFrame) -> DataFrame:
    """store, id, record: every row of the library as JSON; a backup file is these, assembled (K8)."""
    one = lambda df, s: df.select(F.lit(s).alias("store"), F.col("id"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("record"))
    return one(papers, "papers").union(one(edges, "edges")).union(one(topics, "topics"))


def write(papers: DataFrame, edges: DataFrame, topics: DataFrame, path: str, exported_at: str) -> None:
    """One backup file, streamed partition by partition through the driver (a backup is one document by its format)."""
    import json

    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{"schemaVersion":{VERSION},"exportedAt":{json.dumps(exported_at)}')
        for name, df in (("papers", papers), ("edges", edges), ("topics", topics)):
            f.write(f',"{name}":[')
            first = True
            for r in df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("j")).toLocalIterator():
                f.write(("" if first else ",") + r.j)
                first = False
            f.write("]")
        f.write(',"meta":{}}')
