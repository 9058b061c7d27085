"""Queries of the training-data operators, and SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioplan.compat import table
from folioplan.llm import encoding, leaks, linkage, mixing, names, scans, survivors, visual


#: The public vocabulary that sizes are counted in.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.changed(table(spark, d, "papers")).select("paper_id", "field", "pos").distinct()


def p1_plain(spark: SparkSession, d: str) -> DataFrame:
    """Every title and author name with its plain form."""
    rows = visual.paper_strings(table(spark, d, "papers")).distinct()
    return visual.plain_form(rows, "value").select("paper_id", "field", "pos", "value", "plain")


def _scan_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "pdf_pages"), table(spark, d, "reference_drafts"), table(spark, d, "papers")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(*_scan_tables(spark, d)).select("src", "doc_id", "item_no", "line_no", "kind")


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Continuous readable paragraphs of every page and bibliography entry."""
    return scans.paragraphs(*_scan_tables(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.resolve(table(spark, d, "papers")))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every author string with the person or organisation it names."""
    return names.resolve(table(spark, d, "papers"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(table(spark, d, "papers"), table(spark, d, "provider_works"), least=linkage.MATCH)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("paper_id", "record_id")


def p6_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The matching pairs with their confidence."""
    return _links(spark, d).select("paper_id", "record_id", F.round("confidence", 6).alias("confidence"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_records(spark, d).select("group_id", "field", "paper_id")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group, field by field, with the surviving value."""
    return survivors.survivors(table(spark, d, "papers"), table(spark, d, "source_trust"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """The leaked passages, as offsets in the original text."""
    one = _leaks(spark, d).select("doc_id", "item_id", F.round("share", 6).alias("share"), F.explode("passages").alias("p"))
    return one.select("doc_id", "item_id", "share", F.col("p.start").alias("start"), F.col("p.stop").alias("stop"), F.col("p.words").alias("words"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation item with the number of documents that carry it."""
    return leaks.report(_leaks(spark, d), table(spark, d, "eval_items")).withColumn("max_share", F.round("max_share", 6))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the targets: budget, what the mixture holds, and its actual share."""
    return mixing.shares(*mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), TOKENIZER)).withColumn("fitted_weight", F.round("fitted_weight", 8))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is repeated."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), TOKENIZER)[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(spark, d, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with their restored texts, the chains undone, and whether something stays lost."""
    return encoding.garbled(table(spark, d, "documents")).select("doc_id", "restored", F.array_join("chains", "; ").alias("chains"), "lost")


QUERIES = {
    "p1_found": p1_found,
    "p1_plain": p1_plain,
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p3_found": p3_found,
    "p3_paragraphs": p3_paragraphs,
    "p4_found": p4_found,
    "p4_entities": p4_entities,
    "p6_found": p6_found,
    "p6_confidence": p6_confidence,
    "p7_found": p7_found,
    "p7_passages": p7_passages,
    "p7_items": p7_items,
    "p8_shares": p8_shares,
    "p8_mixture": p8_mixture,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}
ORACLE: dict[str, str] = {}
