"""Provider payloads: three dialects to papers, saved pages as a data source, and local PDFs."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioplan.functions import normalize as N

SEMANTIC = "struct<paperId:string,title:string,abstract:string,year:int,venue:string,publicationTypes:array<string>,authors:array<struct<name:string>>,externalIds:struct<DOI:string,ArXiv:string>,url:string,openAccessPdf:struct<url:string>,citationCount:bigint,fieldsOfStudy:array<string>>"
_LOCATION = "struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string>>"
OPENALEX = (
    "struct<id:string,doi:string,ids:struct<doi:string,openalex:string>,title:string,display_name:string,publication_year:int,type:string,type_crossref:string,cited_by_count:bigint,authorships:array<struct<author:struct<display_name:string>>>,"
    f"primary_location:{_LOCATION},best_oa_location:{_LOCATION},locations:array<{_LOCATION}>,abstract_inverted_index:map<string,array<int>>,topics:array<struct<display_name:string>>,"
    "concepts:array<struct<display_name:string,score:double>>,keywords:array<struct<display_name:string,keyword:string>>,referenced_works:array<string>>"
)
_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = (
    "struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string,name:string>>,`published-print`:" + _DATE + ",`published-online`:" + _DATE + ",published:" + _DATE + ",issued:" + _DATE + ",created:" + _DATE + ","
    "`container-title`:array<string>,type:string,URL:string,subject:array<string>,abstract:string,publisher:string,`is-referenced-by-count`:bigint,"
    "reference:array<struct<key:string,DOI:string,author:string,year:string,`article-title`:string,`series-title`:string,`journal-title`:string,unstructured:string>>>"
)


def _some(*cs: Column) -> Column:
    return F.coalesce(*[F.when(N.clean(c) != "", N.clean(c)) for c in cs], F.lit(""))


def _doi_url(doi: Column) -> Column:
    return F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")


_COLUMNS = ("id", "semanticScholarId", "openAlexId", "doi", "arxivId", "title", "authors", "year", "venue", "type", "url", "pdfUrl", "abstract", "keywords", "topicNames", "citationCount", "publisher", "source")


def _paper(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.select(*[(F.coalesce(values[c], empty) if c in ("authors", "keywords", "topicNames") else values.get(c, F.lit(""))).alias(c) for c in _COLUMNS])


def semantic_scholar(payloads: DataFrame, column: str = "value") -> DataFrame:
    df = payloads.select(F.from_json(column, SEMANTIC).alias("v")).where("v IS NOT NULL AND v.paperId IS NOT NULL")
    doi, arxiv = N.normalize_doi(F.col("v.externalIds.DOI")), N.text(F.col("v.externalIds.ArXiv"))
    ids = F.when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("s2:"), "v.paperId"))
    return _paper(df, {
        "id": ids, "semanticScholarId": F.col("v.paperId"), "doi": doi, "arxivId": arxiv, "title": _some(F.col("v.title"), F.lit("Untitled paper")), "authors": F.filter("v.authors.name", lambda x: N.text(x) != ""), "year": F.col("v.year"),
        "venue": N.text(F.col("v.venue")), "type": N.text(F.get("v.publicationTypes", F.lit(0))), "url": _some(F.col("v.url"), _doi_url(doi)), "pdfUrl": N.text(F.col("v.openAccessPdf.url")), "abstract": N.text(F.col("v.abstract")),
        "keywords": F.array().cast("array<string>"), "topicNames": F.array_distinct("v.fieldsOfStudy"), "citationCount": F.col("v.citationCount"), "source": F.lit("semantic-scholar"),
    })


def open_alex(payloads: DataFrame, column: str = "value") -> DataFrame:
    df = payloads.select(F.from_json(column, OPENALEX).alias("v")).where("v IS NOT NULL")
    places = F.filter(F.concat(F.array("v.primary_location", "v.best_oa_location"), F.coalesce("v.locations", F.array().cast(f"array<{_LOCATION}>"))), lambda x: x.isNotNull())
    linked = F.filter(F.transform(places, lambda x: N.text(x["landing_page_url"])), lambda u: u.rlike("(?i)doi\\.org/"))
    doi = N.normalize_doi(_some(F.col("v.doi"), F.col("v.ids.doi"), N.text(F.get(linked, F.lit(0)))))
    arxiv = N.arxiv_from_locations(F.transform(F.coalesce("v.locations", F.array().cast(f"array<{_LOCATION}>")), lambda x: _some(x["landing_page_url"], x["pdf_url"])))
    work = N.open_alex_id(_some(F.col("v.id"), F.col("v.ids.openalex")))
    key = F.coalesce(F.when(doi != "", F.concat(F.lit("doi:"), doi)), F.when(arxiv != "", F.concat(F.lit("arxiv:"), F.lower(arxiv))), F.when(work != "", F.concat(F.lit("openalex:"), work)), F.concat(F.lit("title:"), N.normalized_title(F.col("v.title")), F.lit(":"), F.coalesce(F.col("v.publication_year").cast("string"), F.lit(""))))
    venues = F.filter(F.transform(places, lambda x: N.clean(x["source"]["display_name"])), lambda x: x != "")
    return _paper(df, {
        "id": key, "openAlexId": work, "doi": doi, "arxivId": arxiv, "title": _some(F.col("v.title"), F.col("v.display_name"), F.lit("Untitled paper")), "authors": F.filter(F.transform("v.authorships", lambda a: N.clean(a["author"]["display_name"])), lambda x: x != ""),
        "year": F.col("v.publication_year"), "venue": N.text(F.get(venues, F.lit(0))), "type": _some(F.col("v.type_crossref"), F.col("v.type")), "url": _some(F.col("v.primary_location.landing_page_url"), F.col("v.best_oa_location.landing_page_url"), F.col("v.id"), _doi_url(doi)),
        "pdfUrl": _some(F.col("v.best_oa_location.pdf_url"), F.col("v.primary_location.pdf_url")), "abstract": F.coalesce(N.abstract_from_inverted_index(F.col("v.abstract_inverted_index")), F.lit("")), "keywords": F.filter(F.transform("v.keywords", lambda k: _some(k["display_name"], k["keyword"])), lambda x: x != ""),
        "topicNames": N.open_alex_topics(F.col("v.topics.display_name"), F.col("v.concepts")), "citationCount": F.col("v.cited_by_count"), "source": F.lit("openalex"),
    })


def crossref(payloads: DataFrame, column: str = "value") -> DataFrame:
    df = payloads.select(F.from_json(column, CROSSREF).alias("v")).where("v IS NOT NULL")
    doi, title = N.normalize_doi(F.col("v.DOI")), N.clean(F.get("v.title", F.lit(0)))
    year = N.first_date_year(*[F.col(f"v.`{k}`.`date-parts`") for k in ("published-print", "published-online", "published", "issued", "created")])
    key = F.when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("title:"), N.normalized_title(title), F.lit(":"), F.coalesce(year.cast("string"), F.lit(""))))
    people = F.transform("v.author", lambda a: F.when(N.clean(a["name"]) != "", N.clean(a["name"])).otherwise(N.clean(F.concat_ws(" ", a["given"], a["family"]))))
    return _paper(df, {
        "id": key, "doi": doi, "title": _some(title, F.lit("Untitled paper")), "authors": F.filter(people, lambda x: x != ""), "year": year, "venue": N.clean(F.get(F.col("v.`container-title`"), F.lit(0))),
        "type": N.clean(F.col("v.type")), "url": _some(F.col("v.URL"), _doi_url(doi)), "abstract": N.plain_abstract(F.col("v.abstract")), "keywords": F.array().cast("array<string>"), "topicNames": F.array_distinct(F.filter(F.transform("v.subject", N.clean), lambda x: x != "")),
        "citationCount": F.col("v.`is-referenced-by-count`"), "publisher": N.clean(F.col("v.publisher")), "source": F.lit("crossref"),
    })


def crossref_references(payloads: DataFrame, column: str = "value") -> DataFrame:
    """source_doi, index, label, rawText, title, year, doi, confidence of the references in Crossref works."""
    df = payloads.select(F.from_json(column, CROSSREF).alias("v"))
    r = df.select(N.normalize_doi(F.col("v.DOI")).alias("source_doi"), F.posexplode("v.reference").alias("k", "r"))
    doi, title, venue = N.normalize_doi(F.col("r.DOI")), _some(F.col("r.`article-title`"), F.col("r.`series-title`")), _some(F.col("r.`journal-title`"), F.col("r.`series-title`"))
    year = N.normalized_year(F.col("r.year").try_cast("double"))
    person = N.clean(F.col("r.author"))
    parts = F.filter(F.array(person, F.when(year.isNotNull(), F.format_string("(%d)", year)).otherwise(""), title, venue, _doi_url(doi)), lambda x: x != "")
    raw = _some(F.col("r.unstructured"), F.regexp_replace(F.array_join(parts, ". "), r"\.\s*\.", "."))
    out = r.select("source_doi", (F.col("k") + 1).alias("index"), _some(F.col("r.key"), (F.col("k") + 1).cast("string")).alias("label"), raw.alias("rawText"), title.alias("title"), year.alias("year"), doi.alias("doi"))
    return out.withColumn("confidence", N.crossref_confidence(F.col("doi"), F.col("title"), F.col("rawText"))).where("confidence IS NOT NULL")


class SavedPages(DataSource):
    """Saved pages of a provider's answers as a table (page, value): one partition a page, pages cut by ``limit`` rows.

    Options: path (a folder of JSON files, each an array or an object with data, results or items), limit.
    """

    @classmethod
    def name(cls) -> str:
        return "provider_pages"

    def schema(self) -> str:
        return "page int, value string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.limit = options["path"], int(options.get("limit", 100))

    def partitions(self):
        return [InputPartition((k, f)) for k, f in enumerate(sorted(glob.glob(os.path.join(self.path, "*.json"))))]

    def read(self, partition):
        page, name = partition.value
        with open(name, encoding="utf-8") as f:
            body = json.load(f)
        if isinstance(body, dict):
            inner = body.get("message", body)
            body = next((inner[k] for k in ("data", "results", "items") if isinstance(inner.get(k), list)), [inner])
        for item in body[: self.limit]:
            yield page, json.dumps(item, ensure_ascii=False)


def saved_pages(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    spark.dataSource.register(SavedPages)
    return spark.read.format("provider_pages").option("path", path).option("limit", str(limit)).load()


def model_ids(payloads: DataFrame, column: str = "value") -> DataFrame:
    """id: models a service lists, under data or models, without repetitions, numbers in numeric order."""
    j = F.from_json(column, "struct<data:array<struct<id:string,name:string,model:string>>,models:array<struct<id:string,name:string,model:string>>>")
    ids = payloads.select(F.explode(F.coalesce(j["data"], j["models"])).alias("m")).select(_some(F.col("m.id"), F.col("m.name"), F.col("m.model")).alias("id")).where("id <> ''").distinct()
    padded = F.array_join(F.transform(F.regexp_extract_all(F.lower("id"), F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 12, "0")).otherwise(x)), "")
    return ids.orderBy(padded, "id")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, size, valid of PDF files: the bytes stay where they are.

    Reading the text of a PDF needs a library that turns its bytes into pages; everything downstream takes pages.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), (F.substring(F.col("content"), 1, 4) == F.unhex(F.lit("25504446"))).alias("valid"))
