"""Merging records: into the library in order, across providers, across review sources.

Merges of a pair are Column expressions.  The ordered merge of a batch into the library is a fold in which later rows
see earlier ones; it runs inside connected components of every key a merged row could ever show, so components are
independent and the fold stays exact and parallel.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioplan.compat import cut
from folioplan.functions import normalize as N
from folioplan.functions import rows as R
from folioplan.operators.components import components

#: Incoming wins where it has a value.
CHOSEN = ("title", "year", "venue", "type", "semanticScholarId", "arxivId", "url", "pdfUrl", "abstract", "citationCount")
#: Both sides' values, existing first.
UNITED = ("keywords", "topics", "tags")
#: Existing wins where it has a value.
KEPT = ("notes", "status", "relevance", "starred")


def _empty(c: Column, kind: str) -> Column:
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def merge_pair(columns: list[tuple[str, str]], old: str, new: str) -> list[Column]:
    """The merged record of two joined ones, columns prefixed ``old`` and ``new``.

    Fields in no rule take the incoming value even if it is "": only a missing (NULL) value leaves the existing one.
    """
    out = []
    for c, kind in columns:
        e, i = F.col(f"{old}{c}"), F.col(f"{new}{c}")
        if c == "id":
            v = e
        elif c == "doi":
            v = N.normalize_doi(F.when(_empty(i, "string"), e).otherwise(i))
        elif c == "authors":
            v = F.when(F.size(i) > 0, i).otherwise(F.coalesce(e, F.array().cast("array<string>")))
        elif c in UNITED:
            v = F.array_union(F.coalesce(e, F.array().cast("array<string>")), F.coalesce(i, F.array().cast("array<string>")))
        elif c in CHOSEN:
            v = F.when(_empty(i, kind), e).otherwise(i)
        elif c in ("notes", "status"):
            v = F.coalesce(F.when(~_empty(e, kind), e), F.when(~_empty(i, kind), i), F.lit("unread" if c == "status" else ""))
        elif c == "relevance":
            v = F.coalesce(e, i, F.lit(3))
        elif c == "starred":
            v = F.coalesce(e, i, F.lit(False))
        elif c in ("source", "libraryEntry"):
            v = F.coalesce(e, i)
        else:
            v = F.coalesce(i, e)
        out.append(v.alias(c))
    return out


def preview(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming_id, existing_id, matched_by: where each record alone would go - identity first, then title and year.

    Of several existing records with one key the last by id answers (J4 without the order of a batch).
    """
    p = {k: F.col(k) for k in ("title", "year", "doi", "semanticScholarId", "arxivId")}
    ident, ty = N.paper_identity_key(p), N.title_year_key(p["title"], p["year"])
    by_id = existing.groupBy(ident.alias("identity")).agg(F.max("id").alias("by_identity"))
    by_ty = existing.groupBy(ty.alias("ty")).agg(F.max("id").alias("by_title"))
    rows = incoming.select(F.col("id").alias("incoming_id"), ident.alias("identity"), ty.alias("ty"))
    j = rows.join(by_id, "identity", "left").join(by_ty, "ty", "left")
    how = F.when(F.col("by_identity").isNotNull(), "identity").when(F.col("by_title").isNotNull(), "title-year").otherwise("new")
    return j.select("incoming_id", F.coalesce("by_identity", "by_title").alias("existing_id"), how.alias("matched_by"))


def _merge_rows(e: dict, i: dict) -> dict:
    """``merge_pair`` on dictionaries; a key that is absent differs from one that is ""."""
    out = e | i | {"id": e["id"]}
    for c in CHOSEN:
        out[c] = i.get(c) if i.get(c) not in (None, "") else e.get(c)
    out["doi"] = R.doi(i.get("doi") if i.get("doi") not in (None, "") else e.get("doi"))
    out["authors"] = i.get("authors") or e.get("authors") or []
    for c in UNITED:
        out[c] = list(dict.fromkeys([*(e.get(c) or []), *(i.get(c) or [])]))
    out["notes"] = e.get("notes") or i.get("notes") or ""
    out["status"] = e.get("status") or i.get("status") or "unread"
    out["relevance"] = next((x for x in (e.get("relevance"), i.get("relevance")) if x is not None), 3)
    out["starred"] = bool(next((x for x in (e.get("starred"), i.get("starred")) if x is not None), False))
    out["source"] = e.get("source") or i.get("source")
    if e.get("libraryEntry") or i.get("libraryEntry"):
        out["libraryEntry"] = e.get("libraryEntry") or i.get("libraryEntry")

    def sources(p: dict) -> list:
        return p.get("metadataSources") or [x for x in [p.get("providerPrimary") or p.get("source")] if x]

    out["metadataSources"] = list(dict.fromkeys([*sources(e), *sources(i)]))
    return out


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Existing rows in order of id, then incoming rows in their order; one component."""
    records: dict[str, dict] = {}
    by_identity: dict[str, str] = {}
    by_title: dict[str, str] = {}
    fate, origin = [], {}
    for x in pdf.sort_values(["incoming", "ordinal", "id"]).itertuples(index=False):
        p = {k: v for k, v in json.loads(x.record).items() if v is not None}
        if not x.incoming:
            target = p["id"]
            records[target] = p
            origin[target] = 0
        else:
            target = by_identity.get(R.identity(p)) or by_title.get(R.title_year(p))
            if target:
                records[target] = _merge_rows(records[target], p)
                origin[target] += 1
            else:
                target = p.get("id") or f"local:{x.ordinal}"
                while target in records:
                    target = f"local:{R.slug(p.get('id'))}:{x.ordinal}" if not target.startswith("local:") else target + "'"
                records[target] = p | {"id": target}
                origin[target] = 1
            fate.append((p.get("id"), target))
        by_identity[R.identity(records[target])] = target
        by_title[R.title_year(records[target])] = target
    came: dict[str, list] = {}
    for a, b in fate:
        came.setdefault(b, []).append(a)
    rows = [(t, json.dumps(p), origin[t], came.get(t, [])) for t, p in records.items()]
    return pd.DataFrame(rows, columns=["id", "record", "merged", "incoming_ids"])


def merge_library(existing: DataFrame, incoming: DataFrame, strict: bool = True) -> DataFrame:
    """id, record (the merged paper as in ``existing``), merged, incoming_ids: a batch merged into the library.

    Records are folded where they could ever meet: those of one identifier, and those of one title and year that any
    record joined with them has, for a merge may bring another title or year.  A title alone ties nothing, so that an
    editorial of every year is no component.

    ``incoming`` has the columns of papers and ``ordinal``, its order.  In ``strict`` mode an empty title ties nothing
    together; otherwise all records without identifiers and with empty titles are one component, as in the legacy rule.
    """
    columns = [c for c in existing.columns if c in incoming.columns]
    e = existing.select(*columns, F.lit(0).cast("bigint").alias("ordinal"), F.lit(False).alias("incoming"))
    i = incoming.select(*columns, F.col("ordinal").cast("bigint"), F.lit(True).alias("incoming"))
    both = e.unionByName(i).withColumn("item", F.concat_ws("\x00", F.col("incoming").cast("string"), "ordinal", "id"))
    t = N.normalized_title(F.col("title"))
    keys = F.array_compact(
        F.array(
            F.concat(F.lit("id:"), "id"),
            F.when(N.normalize_doi(F.col("doi")) != "", F.concat(F.lit("doi:"), N.normalize_doi(F.col("doi")))),
            F.when(N.text(F.col("semanticScholarId")) != "", F.concat(F.lit("s2:"), "semanticScholarId")),
            F.when(N.text(F.col("arxivId")) != "", F.concat(F.lit("arxiv:"), F.lower("arxivId"))),
        )
    )
    facts = cut(both.select("item", keys.alias("keys"), t.alias("title"), F.coalesce(F.when(F.col("year") != 0, F.col("year").cast("string")), F.lit("")).alias("year")))
    parts = components(facts.select("item", F.explode(F.concat(F.array(F.concat(F.lit("item:"), "item")), "keys")).alias("key")))
    while True:
        seen = facts.join(parts, "item")
        titles = seen.where((F.col("title") != "") | F.lit(not strict)).select("component", "title").distinct()
        met = titles.join(seen.select("component", "year").distinct(), "component").select(F.col("component").alias("item"), F.concat_ws(":", "title", "year").alias("key"))
        wider = cut(components(met).select(F.col("item").alias("component"), F.col("component").alias("wider")).where("component <> wider"))
        if wider.isEmpty():
            break
        parts = cut(parts.join(wider, "component", "left").select("item", F.coalesce("wider", "component").alias("component")))
    rows = both.join(parts, "item").select("component", "incoming", "ordinal", F.coalesce("id", F.lit("")).alias("id"), F.to_json(F.struct(*columns)).alias("record"))
    schema = existing.select(*columns).schema
    folded = rows.groupBy("component").applyInPandas(lambda pdf: _fold(pdf), "id string, record string, merged int, incoming_ids array<string>")
    return folded.select("id", F.from_json("record", schema).alias("record"), "merged", "incoming_ids")


def remapped_edges(edges: DataFrame, id_map: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming edges on the ids their papers got; self-edges, blank ends and known edges dropped.

    id_map: old, new.
    """
    s, t = id_map.select(F.col("old").alias("source"), F.col("new").alias("s")), id_map.select(F.col("old").alias("target"), F.col("new").alias("t"))
    j = edges.join(s, "source", "left").join(t, "target", "left").withColumn("source", F.coalesce("s", "source")).withColumn("target", F.coalesce("t", "target"))
    j = j.where("source <> '' AND target <> '' AND source <> target")
    research = N.is_research_relation(F.col("kind"), F.col("relation"))
    made = F.when(research, N.relation_edge_id(F.col("source"), F.col("target"), F.col("relation"))).otherwise(N.edge_id(F.col("source"), F.col("target")))
    kind = F.when(research, "research-relation").otherwise(F.coalesce(F.when(F.col("kind") != "", F.col("kind")), F.lit("citation")))
    one = j.withColumn("id", made).withColumn("kind", kind).drop("s", "t").dropDuplicates(["id"])
    return one.join(existing.select("id"), "id", "left_anti").select(*edges.columns)


# ---- providers (J20, A10) -----------------------------------------------------------------------------------------


def _longer(a, b):
    a, b = R.clean(a), R.clean(b)
    return b if not a or (b and len(b) > len(a)) else a


def merge_provider_rows(records: list[dict]) -> dict | None:
    """Records folded into the first, each only if it is the same work as what has been merged so far."""
    if not records:
        return None
    m = dict(records[0])
    for p in records[1:]:
        if not R.same_work(m, p):
            continue
        for c in ("semanticScholarId", "openAlexId", "arxivId", "type", "url", "pdfUrl", "publisher"):
            m[c] = m.get(c) or p.get(c) or ""
        m["doi"] = R.doi(m.get("doi") or p.get("doi"))
        for c in ("title", "venue", "abstract"):
            m[c] = _longer(m.get(c), p.get(c))
        a, b = [x for x in m.get("authors") or [] if x], [x for x in p.get("authors") or [] if x]
        m["authors"] = b if len(b) > len(a) else a
        m["year"] = m.get("year") or p.get("year")
        # A provider without a count leaves the other's; 0 is a count.
        m["citationCount"] = m.get("citationCount") if m.get("citationCount") is not None else p.get("citationCount")
        for c in ("keywords", "topics"):
            m[c] = list(dict.fromkeys(x for x in [*(m.get(c) or []), *(p.get(c) or [])] if x))
        m["metadataSources"] = list(dict.fromkeys([*(m.get("metadataSources") or []), *(p.get("metadataSources") or [])]))
    return m


def merge_providers(records: DataFrame) -> DataFrame:
    """Provider records merged work by work: each record joins the first merged work that it is the same as.

    records: the columns of papers that are there, ``ordinal`` and ``provider``.  Order matters within a component of
    shared identifiers or titles, and nowhere else.
    """
    t = N.normalized_title(F.col("title"))
    keys = F.array_compact(F.array(F.concat(F.lit("id:"), F.col("ordinal").cast("string")), F.when(N.normalize_doi(F.col("doi")) != "", F.concat(F.lit("doi:"), N.normalize_doi(F.col("doi")))), F.when((t != "") & (F.col("year") > 0), F.concat(F.lit("t:"), t, F.lit(":"), F.col("year").cast("string")))))
    parts = components(records.select(F.col("ordinal").alias("item"), F.explode(keys).alias("key")))
    cells = records.select("ordinal", F.to_json(F.struct(*[c for c in records.columns if c != "ordinal"])).alias("record")).join(parts.withColumnRenamed("item", "ordinal"), "ordinal")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        merged: list[tuple[dict, list[int]]] = []
        for x in pdf.sort_values("ordinal").itertuples(index=False):
            p = json.loads(x.record)
            p["metadataSources"] = [p.get("provider")]
            for k, (m, members) in enumerate(merged):
                if R.same_work(m, p):
                    merged[k] = (merge_provider_rows([m, p]), [*members, x.ordinal])
                    break
            else:
                merged.append((p, [x.ordinal]))
        rows = [(min(o), len(o), m.get("title") or "", m.get("authors") or [], m.get("year"), m.get("venue") or "", R.doi(m.get("doi")), m.get("citationCount"), m["metadataSources"]) for m, o in merged]
        out = pd.DataFrame(rows, columns=["ordinal", "n_records", "title", "authors", "year", "venue", "doi", "citationCount", "metadataSources"])
        return out.astype({"year": "Int32", "citationCount": "Int64"})

    return cells.groupBy("component").applyInPandas(run, "ordinal bigint, n_records int, title string, authors array<string>, year int, venue string, doi string, citationCount bigint, metadataSources array<string>")


# ---- review sources (A11, A12), candidates (W9), provenance (N46, N47) --------------------------------------------


def merge_review(local: dict[str, Column], ai: dict[str, Column], online: dict[str, Column]) -> dict[str, Column]:
    """Field by field the first present of online, AI and local metadata; keywords of all in that order."""
    order = (online, ai, local)

    def first(f: str) -> Column:
        return F.coalesce(*[F.when(N.clean(s[f]) != "", N.clean(s[f])) for s in order], F.lit(""))

    names = [N.unique_strings(s["authors"]) for s in order]
    return {
        **{f: first(f) for f in ("title", "venue", "semanticScholarId", "openAlexId", "arxivId", "url", "abstract")},
        "doi": F.coalesce(*[F.when(N.normalize_doi(s["doi"]) != "", N.normalize_doi(s["doi"])) for s in order], F.lit("")),
        "type": F.when(first("type") != "", first("type")).otherwise("article"),
        "authors": F.coalesce(*[F.when(F.size(a) > 0, a) for a in names], F.array().cast("array<string>")),
        "year": F.coalesce(*[N.normalized_year(s["year"]) for s in order]),
        "citationCount": F.coalesce(*[F.when(s["citationCount"] >= 0, s["citationCount"]) for s in order]),
        "keywords": N.unique_strings(F.concat(*[F.coalesce(s["keywords"], F.array().cast("array<string>")) for s in order])),
    }


def apply_to_draft(draft: dict[str, Column], merged: dict[str, Column], dirty: Column) -> dict[str, Column]:
    """Merged values where the reviewer has not touched the field."""
    return {f: F.when(F.array_contains(dirty, f), draft[f]).otherwise(v) for f, v in merged.items() if f in draft}


def ranked_candidates(candidates: DataFrame, query: str | Column) -> DataFrame:
    """Per query: candidates without repetitions, exact titles first, then the provider's order.

    candidates: query_id, index (the provider's order), title, year, doi, arxivId, openAlexId.
    """
    from pyspark.sql import Window

    wanted = N.normalized_title(F.lit(query) if isinstance(query, str) else query)
    key = N.candidate_key({k: F.col(k) for k in ("title", "year", "doi", "arxivId", "openAlexId")}, F.col("index"))
    kept = candidates.where(N.clean(F.col("title")) != "").withColumn("key", key).withColumn("exact", (wanted != "") & (N.normalized_title(F.col("title")) == wanted))
    first = kept.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("index"))).where("k = 1").drop("k")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "index")))


def united_candidates(queries: DataFrame, records: DataFrame, limit: int = 8) -> DataFrame:
    """Per query the first ``limit`` (1 to 20) records that each provider gives, united without looking across providers.

    queries: query_id, k; records: provider, ordinal, k (what a query and its answers share).  What a provider answers is
    cut before the join, so that a title of any number of records meets each query with at most ``limit`` a provider.
    """
    from pyspark.sql import Window

    most = max(1, min(20, limit))
    place = F.row_number().over(Window.partitionBy("provider", "k").orderBy("ordinal"))
    answers = records.where("k <> ''").withColumn("place", place).where(F.col("place") <= most)
    return queries.where("k <> ''").join(answers, "k")


def with_provider_topics(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers whose ``topicNames`` became topic ids, and the rows of those topics."""
    ids = F.filter(F.transform(F.coalesce("topicNames", F.array().cast("array<string>")), lambda n: F.struct(F.concat(F.lit("topic:provider:"), N.slug(n, 70)).alias("id"), n.alias("name"))), lambda x: ~x["id"].endswith(":"))
    source = F.coalesce(F.when(N.text(F.col("providerPrimary")) != "", F.col("providerPrimary")), F.when(N.text(F.col("source")) != "", F.col("source")), F.lit("provider"))
    cells = papers.withColumn("_t", ids)
    topics = cells.select(F.explode("_t").alias("t"), source.alias("source")).select("t.id", "t.name", "source")
    done = cells.withColumn("topics", F.array_distinct(F.concat(F.coalesce("topics", F.array().cast("array<string>")), F.transform("_t", lambda x: x["id"]))))
    return done.drop("_t", "topicNames"), topics.groupBy("id").agg(F.max("name").alias("name"), F.max("source").alias("source"))


def library_entry(method: str = "", file_name: str = "", detail: str = "", parent: str = "") -> Column:
    """How a paper came in, where it does not say so itself."""
    default = F.struct(
        F.coalesce(F.lit(method or None), F.when(N.text(F.col("source")) != "", F.col("source")), F.lit("unknown")).alias("method"),
        F.coalesce("importedAt", "createdAt").alias("addedAt"),
        F.coalesce(F.lit(file_name or None), F.col("sourceFileName"), F.lit("")).alias("fileName"),
        F.lit(detail).alias("detail"),
        F.lit(parent).alias("parentPaperId"),
    )
    return F.coalesce(F.col("libraryEntry"), default)
