"""Queries over sources and sinks: what goes out comes back, and writes leave the tables as they should."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioplan.compat import prepare, table
from folioplan.functions import normalize as N
from folioplan.operators import reconcile
from folioplan.plans.base import ONCE, clean_sql, doi_sql, edges, papers, plain_sql, slug_sql, squeeze_sql, topics
from folioplan.plans.references import ORACLE as _REFERENCES
from folioplan.sources import archive, backup, bibtex, providers, sinks
from folioplan.streaming import streams


def bibtex_entries(s: SparkSession, d: str) -> DataFrame:
    return bibtex.export(papers(s, d))


def bibtex_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Papers after a journey through BibTeX."""
    return bibtex.parse(bibtex.export(papers(s, d)).select("value")).select("id", "citationKey", "title", F.array_join("authors", "|").alias("authors"), "year", "doi")


def json_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Edges after a journey through JSON."""
    rows = backup.export_rows(papers(s, d), edges(s, d), topics(s, d)).where("store = 'edges'")
    schema = edges(s, d).schema
    return rows.select(F.from_json("record", schema).alias("r")).select("r.id", "r.source", "r.target", "r.kind")


def export_counts(s: SparkSession, d: str) -> DataFrame:
    return backup.export_rows(papers(s, d), edges(s, d), topics(s, d)).groupBy("store").agg(F.count("*").alias("n"), F.count_if(F.col("record").isNotNull()).alias("records"))


def archive_keys(s: SparkSession, d: str) -> DataFrame:
    return archive.assigned_keys(papers(s, d))


def cascade_delete(s: SparkSession, d: str) -> DataFrame:
    """What is left after the deleted papers went, with their edges."""
    gone = table(s, d, "paper_tombstones").select(F.col("paper_id").alias("id")).distinct()
    p, e = sinks.delete_papers(papers(s, d), edges(s, d), gone)
    return p.select(F.lit("papers").alias("store"), "id").union(e.select(F.lit("edges"), "id"))


def upserted_topics(s: SparkSession, d: str) -> DataFrame:
    """Topics after the topics that papers name but nobody defined were put in."""
    t = topics(s, d)
    named = papers(s, d).select(F.explode("topics").alias("id")).where("id <> ''").distinct().withColumn("name", F.regexp_replace("id", "^topic:[^:]+:", ""))
    new = named.select("id", "name", F.lit("derived").alias("source"))
    return t.select("id", "name", "source").unionByName(sinks.insert_missing(t.select("id", "name", "source"), new))


def reconciled_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges of the library with those that its references imply, by provenance."""
    e = edges(s, d)
    new = reconcile.inferred_edges(papers(s, d), e)
    return e.select("id", N.text(F.col("provenance")).alias("provenance")).union(new.select("id", F.lit("inferred"))).groupBy("provenance").agg(F.count("*").alias("n"))


def provider_dialects(s: SparkSession, d: str) -> DataFrame:
    """Provider records written in their services' dialects and read back."""
    w = table(s, d, "provider_works").dropDuplicates(["record_id"])
    people = F.coalesce("authors", F.array().cast("array<string>"))
    a = w.where("provider = 'semantic-scholar'").select(F.to_json(F.struct(F.col("record_id").alias("paperId"), "title", "year", "venue", F.transform(people, lambda x: F.struct(x.alias("name"))).alias("authors"), F.struct(F.col("doi").alias("DOI")).alias("externalIds"), F.col("cited_by").alias("citationCount"))).alias("value"))
    b = w.where("provider = 'openalex'").select(F.to_json(F.struct(F.col("record_id").alias("id"), "title", F.col("year").alias("publication_year"), "doi", F.transform(people, lambda x: F.struct(F.struct(x.alias("display_name")).alias("author"))).alias("authorships"), F.col("cited_by").alias("cited_by_count"))).alias("value"))
    c = w.where("provider = 'crossref'").select(F.to_json(F.struct(F.col("doi").alias("DOI"), F.array("title").alias("title"), F.transform(people, lambda x: F.struct(x.alias("name"))).alias("author"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"), F.array("venue").alias("container-title"), F.col("cited_by").alias("is-referenced-by-count"))).alias("value"))
    read = providers.semantic_scholar(a).unionByName(providers.open_alex(b)).unionByName(providers.crossref(c))
    return read.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doi") != "").alias("with_doi"), F.sum(F.size("authors")).cast("bigint").alias("n_authors"), F.count("year").alias("with_year"), F.sum("citationCount").alias("citations"))


def activity_log(s: SparkSession, d: str) -> DataFrame:
    """The latest 120 events of the log."""
    e = table(s, d, "events")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(streams.RING).select("event_id", "event_type")


def user_rings(s: SparkSession, d: str) -> DataFrame:
    """The latest three events of every user, in batch."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "k", "event_id", "event_type")


def _stream(s: SparkSession, d: str) -> DataFrame:
    batch = table(s, d, "events")
    return s.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(s: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """A stream run to its end into a table of the shared folder."""
    prepare(s)
    base = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return s.read.parquet(out)


def streamed_counts(s: SparkSession, d: str) -> DataFrame:
    """Hourly counts by a stream over the events, run to its end."""
    return _run(s, streams.windowed_counts(_stream(s, d)), "complete")


def streamed_progress(s: SparkSession, d: str) -> DataFrame:
    e = _stream(s, d).select(F.col("event_type").alias("provider"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), F.lit(1).alias("n_results"))
    return _run(s, streams.progress(e), "complete")


def streamed_latest(s: SparkSession, d: str) -> DataFrame:
    """What the newest event of every user says, by a stream."""
    e = _stream(s, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("token"), F.col("event_type").alias("state"))
    return _run(s, streams.latest_by_token(e), "complete")


QUERIES = {
    f.__name__: f
    for f in (bibtex_entries, bibtex_round_trip, json_round_trip, export_counts, archive_keys, cascade_delete, upserted_topics, reconciled_edges, provider_dialects, activity_log, user_rings, streamed_counts, streamed_progress, streamed_latest)
}

INFERRED = _REFERENCES["inferred_edges"]
_W = "WITH w AS (SELECT DISTINCT ON (record_id) * FROM provider_works)"
_KEY = f"regexp_replace(substr(regexp_replace(regexp_replace({plain_sql('{0}')}, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), 1, 80), '[.-]+$', '')"
_EDGES = INFERRED.rsplit("SELECT source_id ||", 1)
_LINE = lambda n, v: f"CASE WHEN {clean_sql(v)} <> '' THEN '  ' || {n} || ' = {{' || {clean_sql(f'regexp_replace({v}, {chr(39)}[{{}}]{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')} || '}}' END"

ORACLE = {
    "archive_keys": f"""{ONCE}, k AS (SELECT id, {_KEY.format(clean_sql('citationKey'))} AS c, {_KEY.format(clean_sql(f"array_to_string(list_filter([coalesce(string_split({squeeze_sql('authors[1]')}, ' ')[-1], ''), coalesce(CAST(year AS VARCHAR), ''), array_to_string(string_split({squeeze_sql('title')}, ' ')[1:4], '-')], lambda x: x <> ''), '-')"))} AS m FROM (SELECT * REPLACE (CASE WHEN len(authors) > 0 THEN authors ELSE ['paper'] END AS authors) FROM p)),
b AS (SELECT id, CASE WHEN c <> '' THEN c WHEN m <> '' THEN m ELSE 'paper-' || sha256(id)[1:8] END AS base FROM k), n AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY id) AS n FROM b)
SELECT id, CASE WHEN n = 1 THEN base ELSE substr(base, 1, 78 - length(CAST(n AS VARCHAR))) || '-' || n END AS key FROM n""",
    "reconciled_edges": f"""{_EDGES[0]}, made AS (SELECT source_id ||{_EDGES[1]}) SELECT provenance, count(*) AS n FROM (SELECT coalesce(provenance, '') AS provenance FROM e UNION ALL SELECT 'inferred' FROM made) GROUP BY 1""",
    "bibtex_entries": f"""{ONCE}, k AS (SELECT *, CASE WHEN coalesce(citationKey, '') <> '' THEN citationKey ELSE {slug_sql("regexp_extract(coalesce(nullif(authors[1], ''), 'paper'), '([^ ]*)$', 1)", 80)} || CASE WHEN year <> 0 THEN CAST(year AS VARCHAR) ELSE '' END || substr({slug_sql('title', 80)}, 1, 20) END AS key,
  array_to_string(list_transform(coalesce(authors, []), lambda x: coalesce(x, '')), ' and ') AS names, array_to_string(list_transform(coalesce(keywords, []) || coalesce(tags, []), lambda x: coalesce(x, '')), ', ') AS words, CASE WHEN contains(lower(coalesce(type, '')), 'conference') THEN 'booktitle' ELSE 'journal' END AS place FROM p)
SELECT id, '@article{{' || key || ',' || chr(10) || array_to_string(list_filter([{_LINE("'title'", 'title')}, {_LINE("'author'", 'names')}, {_LINE("'year'", "coalesce(CAST(year AS VARCHAR), '')")}, {_LINE('place', 'venue')}, {_LINE("'doi'", 'doi')}, {_LINE("'url'", 'url')}, {_LINE("'abstract'", 'abstract')}, {_LINE("'keywords'", 'words')}], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' || chr(10) AS value FROM k""",
    "json_round_trip": f"{ONCE} SELECT id, source, target, kind FROM e",
    "export_counts": f"{ONCE} SELECT 'papers' AS store, count(*) AS n, count(*) AS records FROM p UNION ALL SELECT 'edges', count(*), count(*) FROM e UNION ALL SELECT 'topics', count(*), count(*) FROM t",
    "cascade_delete": f"""{ONCE}, g AS (SELECT DISTINCT paper_id FROM paper_tombstones) SELECT 'papers' AS store, id FROM p WHERE id NOT IN (SELECT paper_id FROM g)
UNION ALL SELECT 'edges', id FROM e WHERE source NOT IN (SELECT paper_id FROM g) AND target NOT IN (SELECT paper_id FROM g)""",
    "upserted_topics": f"""{ONCE}, n AS (SELECT DISTINCT unnest(topics) AS id FROM p) SELECT id, name, source FROM t UNION ALL SELECT id, regexp_replace(id, '^topic:[^:]+:', ''), 'derived' FROM n WHERE coalesce(id, '') <> '' AND id NOT IN (SELECT id FROM t)""",
    "provider_dialects": f"""{_W} SELECT provider AS source, count(*) AS n, count(*) FILTER ({doi_sql('doi')} <> '') AS with_doi, CAST(sum(len(list_filter(coalesce(authors, []), lambda x: {clean_sql('x')} <> ''))) AS BIGINT) AS n_authors,
  count(year) AS with_year, CAST(sum(cited_by) AS BIGINT) AS citations FROM w GROUP BY ALL""",
    "activity_log": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 120",
    "user_rings": "SELECT user_id, k, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3",
    "streamed_counts": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "streamed_progress": "SELECT event_type AS provider, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, count(*) AS n, count(*) AS results FROM events GROUP BY ALL",
    "streamed_latest": "SELECT user_id AS key, max(event_id) AS token, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id",
}
