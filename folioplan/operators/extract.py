"""From the text of pages to bibliography entries.

What is relational stays so: where the bibliography starts, page summaries, assembled text.  Where an entry ends
depends on what the entry already holds, so segmentation is a small state machine per document.
"""

from __future__ import annotations

import itertools
import re

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioplan.functions import normalize as N
from folioplan.operators.library import latest

#: Headings that open a bibliography, and those that close it.
HEADINGS = {"references": "References", "bibliography": "Bibliography", "works cited": "Works Cited", "literature cited": "Literature Cited", "references and notes": "References and Notes"}
CLOSING = ("appendix", "appendices", "supplementary material", "supplemental material", "acknowledgements", "acknowledgments")
#: The patterns of years, numbered entries, DOIs and arXiv identifiers.
YEAR = re.compile(r"\b((?:19|20)\d{2})[a-z]?\b")
NUMBERED = re.compile(r"^\s*(?:\[(\d{1,4})\]|(\d{1,3})[.)])\s*(.*)$")
DOI = re.compile(r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b", re.A)
ARXIV = re.compile(r"(?i)(?:arxiv\s*:\s*)?(\d{4}\.\d{4,5}(?:v\d+)?)")
ARXIV_OLD = re.compile(r"(?i)(?:arxiv\s*:\s*)?([a-z][a-z0-9.\-]+/\d{7}(?:v\d+)?)")
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽА-ЯЁΑ-Ω"
AUTHOR_YEAR = re.compile(rf"^\s*[{_UPPER}][^\W\d_'’-]?[\w'’\-]*(?:,|\s).{{0,150}}\b(?:19|20)\d{{2}}[a-z]?\b")


def _bare(line: str) -> str:
    return line.strip().strip(":.—-").strip().lower()


# ---- relational part (X1, X2, X11, X12) ---------------------------------------------------------------------------


def pages_once(pages: DataFrame) -> DataFrame:
    """One row per page of a document (the largest text of repeated rows)."""
    return latest(pages.withColumn("_k", F.concat_ws("\x00", "doc_id", "page")), "_k", F.col("text"), F.col("citation_text")).drop("_k")


def page_lines(pages: DataFrame, column: str = "citation_text") -> DataFrame:
    """doc_id, page, line, text; a last empty line after a final line break is none."""
    body = F.regexp_replace(N.text(F.col(column)), r"\r?\n\z", "")
    rows = pages.where(N.text(F.col(column)) != "").select("doc_id", "page", F.posexplode(F.split(body, r"\r?\n", -1)).alias("line", "text"))
    return rows


def heading_of(line: Column) -> Column:
    bare = F.lower(N.js_trim(F.regexp_replace(N.js_trim(line), r"^[:.—-]+|[:.—-]+$", "")))
    table = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])
    return F.try_element_at(table, bare)


def is_signal(line: Column) -> Column:
    """A line that looks like part of a bibliography."""
    return (N.js_trim(line) != "") & (line.rlike(N.NUMBERED_PATTERN) | line.rlike(N.AUTHOR_YEAR_PATTERN) | N.extract_doi(line).isNotNull() | N.extract_arxiv(line).isNotNull())


def bibliography_start(pages: DataFrame) -> DataFrame:
    """doc_id, page, line (the first line of the region), heading, inferred.

    The last exact heading wins; without one, the first page of the last two fifths with three signal lines.
    """
    lines = page_lines(pages)
    exact = lines.withColumn("heading", heading_of(F.col("text"))).where("heading IS NOT NULL").groupBy("doc_id").agg(F.max_by(F.struct("page", (F.col("line") + 1).alias("line"), "heading"), F.struct("page", "line")).alias("e"))
    order = pages.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("order"))
    signals = lines.where(is_signal(F.col("text"))).groupBy("doc_id", "page").agg(F.count("*").alias("n")).where("n >= 3")
    late = signals.join(order, "doc_id").where(F.array_position("order", F.col("page")) - 1 >= F.floor(F.size("order") * 3 / 5)).groupBy("doc_id").agg(F.min("page").alias("p"))
    j = pages.select("doc_id").distinct().join(exact, "doc_id", "left").join(late, "doc_id", "left").where("e IS NOT NULL OR p IS NOT NULL")
    return j.select("doc_id", F.coalesce("e.page", "p").alias("page"), F.coalesce("e.line", F.lit(0)).alias("line"), F.col("e.heading").alias("heading"), F.col("e").isNull().alias("inferred"))


def document_text(pages: DataFrame) -> DataFrame:
    """doc_id, text: pages in order, each under its marker (X11)."""
    body = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), N.clean(F.col("text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", body.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))


def pages_from_text(documents: DataFrame) -> DataFrame:
    """doc_id, page, text out of assembled text; a text without markers is page 1."""
    parts = F.split("text", r"(?m)^--- Page \d+ ---\s*$", -1)
    numbers = F.regexp_extract_all("text", F.lit(r"(?m)^--- Page (\d+) ---\s*$"), F.lit(1))
    cells = F.when(F.size(numbers) == 0, F.array(F.struct(F.lit("1").alias("page"), F.col("text").alias("t")))).otherwise(F.arrays_zip(numbers.alias("page"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("t")))
    clean = F.rtrim(F.regexp_replace(F.col("x.t"), r"^\s*\n", ""))
    return documents.select("doc_id", F.explode(cells).alias("x")).select("doc_id", F.col("x.page").cast("int").alias("page"), F.regexp_replace(clean, r"\s+\z", "").alias("text"))


def page_summaries(pages: DataFrame) -> DataFrame:
    """doc_id, page, width, height, line_count, text_length."""
    t = N.text(F.col("text"))
    return pages.select("doc_id", "page", "width", "height", F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, r"\r?\n\z", ""), r"\r?\n", -1))).alias("line_count"), F.length(t).alias("text_length"))


# ---- segmentation (X3 to X10) -------------------------------------------------------------------------------------


@dataclass
class Draft:
    label: str | None = None
    numbered: bool = False
    lines: list[tuple[int, str]] = field(default_factory=list)

    def dated(self) -> bool:
        return any(YEAR.search(t) for _, t in self.lines)


def looks_author_year(line: str) -> bool:
    return bool(AUTHOR_YEAR.match(line))


def looks_author_list(line: str) -> bool:
    """Up to 220 bytes without a year, beginning with a name of two to four capitalised words before "," or " and "."""
    t = line.strip()
    if not t or len(t.encode()) > 220 or YEAR.search(t):
        return False
    cuts = [k for k in (t.find(","), t.find(" and ")) if k >= 0]
    if not cuts:
        return False
    words = t[: min(cuts)].split()
    if not 2 <= len(words) <= 4:
        return False
    for w in words:
        w = re.sub(r"^[\W\d_]+|[\W\d_]+$", "", w)
        if not w or not w[0].isupper():
            return False
    return True


def region(pages: list[tuple[int, str]], start: tuple[int, int]) -> list[tuple[int, str] | None]:
    """Lines of the bibliography; None marks a block break.  Ends at a closing heading on a later page."""
    out: list[tuple[int, str] | None] = []

    def pause() -> None:
        if out and out[-1] is not None:
            out.append(None)

    for page, text in pages:
        if page < start[0]:
            continue
        lines = (text or "").splitlines()
        for line in lines[start[1] :] if page == start[0] else lines:
            if page > start[0] and _bare(line) in CLOSING:
                while out and out[-1] is None:
                    out.pop()
                return out
            if line.strip():
                out.append((page, line.rstrip()))
            else:
                pause()
        pause()
    while out and out[-1] is None:
        out.pop()
    return out


def segment_numbered(lines: list[tuple[int, str] | None]) -> list[Draft]:
    last = max((k for k, x in enumerate(lines) if x and NUMBERED.match(x[1])), default=-1)
    drafts: list[Draft] = []
    paused = False
    for k, x in enumerate(lines):
        if x is None:
            paused = True
            continue
        m = NUMBERED.match(x[1])
        if m:
            drafts.append(Draft(m[1] or m[2], True, [(x[0], m[3].strip())]))
        elif drafts:
            if paused and k > last and drafts[-1].dated():
                break  # prose after the last entry
            drafts[-1].lines.append(x)
        paused = False
    return [d for d in drafts if any(t.strip() for _, t in d.lines)]


def segment_author_year(lines: list[tuple[int, str] | None]) -> list[Draft]:
    drafts: list[Draft] = []
    fresh = True
    for x in lines:
        if x is None:
            fresh = True
            continue
        if not fresh and drafts[-1].dated() and (looks_author_year(x[1]) or looks_author_list(x[1])):
            fresh = True
        if fresh:
            drafts.append(Draft())
            fresh = False
        drafts[-1].lines.append(x)
    return drafts


def joined(lines: list[tuple[int, str]]) -> str:
    out = ""
    for _, t in lines:
        t = " ".join(t.split())
        if not t:
            continue
        if out.endswith("-") and t[0].islower():
            out = out[:-1] + t
        else:
            out += (" " if out else "") + t
    return out.strip()


def identifiers(text: str) -> tuple[str | None, str | None, int | None]:
    m = DOI.search(text)
    doi = None
    if m:
        doi = m[0].lower().rstrip(".,;:")
        while doi.endswith(")") and doi.count(")") > doi.count("("):
            doi = doi[:-1]
    a = ARXIV.search(text)
    old = None if a else ARXIV_OLD.search(text)
    y = YEAR.search(text)
    return doi, a[1] if a else old[1].lower() if old else None, int(y[1]) if y else None


def materialized(drafts: list[Draft], two_column: bool = False) -> list[tuple]:
    """(index, label, rawText, doi, arxivId, year, pageStart, pageEnd, confidence); too short ones leave a gap in the index."""
    out = []
    for k, d in enumerate(drafts, 1):
        raw = joined(d.lines)
        if (len(raw) if two_column else len(raw.encode())) < 8:
            continue
        doi, arxiv, year = identifiers(raw)
        dated = year is not None and (two_column or looks_author_year(raw))
        sure = 0.99 if doi else 0.97 if arxiv else 0.82 if d.numbered else 0.72 if dated else 0.48
        said = [p for p, t in d.lines if t.strip()] if two_column else [p for p, _ in d.lines]
        out.append((k, d.label, raw, doi, arxiv, year, said[0], said[-1], sure))
    return out


def primary(pages: list[tuple[int, str]], start: tuple[int, int]) -> list[tuple]:
    lines = region(pages, start)
    numbered = sum(bool(x and NUMBERED.match(x[1])) for x in lines)
    return materialized(segment_numbered(lines) if numbered >= 2 else segment_author_year(lines))


# ---- two columns (X4, X13, X14) -----------------------------------------------------------------------------------


def gutter(lines: list[str]) -> int | None:
    """Where the right column begins: the place that most long runs of spaces end at, within three characters."""
    full = [x for x in lines if x.strip()]
    width = max(map(len, full), default=0)
    if width < 80 or len(full) < 8:
        return None
    ends = sorted(m.end() for x in full for m in re.finditer(r" {6,}", x) if x[: m.start()].strip(" ") and x[m.end() :].strip(" ") and 0.35 * width <= m.end() <= 0.7 * width)
    if not ends:
        return None
    order = [m.end() for x in full for m in re.finditer(r" {6,}", x) if m.end() in set(ends)]
    support = {e: sum(abs(o - e) <= 3 for o in ends) for e in set(ends)}
    best = max(order, key=lambda e: (support[e], -order.index(e)))
    if support[best] < max(4, -(-len(full) * 15 // 100)):
        return None
    return min(e for e in ends if abs(e - best) <= 3)


def reading_order(text: str) -> tuple[list[str], bool]:
    lines = re.split(r"\r?\n", text or "")
    cut = gutter(lines)
    if cut is None:
        return [x.rstrip() for x in lines], False
    return [x[:cut].rstrip() for x in lines] + [x[cut:].rstrip() for x in lines], True


def islands(lines: list[tuple[int, str]], opens) -> list[list[tuple[int, str]]]:
    """Lines in runs; ``opens(text, run)`` says whether a line begins a new one after the run so far (None at first)."""
    runs: list[list[tuple[int, str]]] = []
    for line in lines:
        if opens(line[1], runs[-1] if runs else None):
            runs.append([])
        if runs:
            runs[-1].append(line)
    return runs


def _opens_after_columns(text: str) -> bool:
    """May begin an entry where columns were told apart: at the left edge, a capital, and a year, a comma or an "and"."""
    bare = text.strip()
    return bare[:1].isupper() and text[:2].strip() != "" and len(bare) <= 220 and ("," in bare or " and " in bare.lower() or YEAR.search(bare) is not None)


def _closes(text: str) -> bool:
    """A closing heading, an appendix, or a heading numbered by a letter."""
    return _bare(text) in CLOSING or text.strip().lower().startswith("appendix") or re.match(rf"\s*[A-Z]\s{{2,}}[{_UPPER}]", text) is not None


def two_column(pages: list[tuple[int, str]]) -> list[tuple]:
    """Entries by reading each page's left column before its right one; the first heading opens, any closing one ends."""
    lines = [(page, text) for page, body in pages for text in reading_order(body)[0]]
    lines = itertools.dropwhile(lambda x: _bare(x[1]) not in HEADINGS, lines)
    lines = list(itertools.takewhile(lambda x: not _closes(x[1]), itertools.islice(lines, 1, None)))
    by_number = islands(lines, lambda text, run: NUMBERED.match(text))
    starts = sum(_opens_after_columns(text) for _, text in lines)
    if len(by_number) >= 2 and len(by_number) > starts:
        heads = [(NUMBERED.match(run[0][1]), run) for run in by_number]
        return materialized([Draft(m[1] or m[2], True, [(run[0][0], m[3]), *run[1:]]) for m, run in heads], True)
    printed = [x for x in lines if x[1].strip()]
    by_author = islands(printed, lambda text, run: run is None or (_opens_after_columns(text) and YEAR.search(joined(run)) is not None))
    return materialized([Draft(lines=run) for run in by_author], True)


REFERENCES = "doc_id string, index int, label string, rawText string, doi string, arxivId string, year int, pageStart int, pageEnd int, confidence double, engine string"


def references(pages: DataFrame) -> DataFrame:
    """Bibliography entries of every document, with their confidence.

    Recovery by columns is tried where fewer than 20 entries were found, and used where it finds strictly more (X14).
    Pages may be missing, empty or repeated; a document without a bibliography has no entries.
    """
    once = pages_once(pages)
    start = bibliography_start(once)
    cells = once.join(start.select("doc_id", F.col("page").alias("start_page"), F.col("line").alias("start_line")), "doc_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page")
        doc = pdf["doc_id"].iloc[0]
        cited = list(zip(pdf["page"], pdf["citation_text"].fillna("")))
        first = pdf["start_page"].iloc[0]
        found, engine = ([] if pd.isna(first) else primary(cited, (int(first), int(pdf["start_line"].iloc[0])))), "primary"
        if len(found) < 20:
            again = two_column(list(zip(pdf["page"], pdf["text"].fillna(""))))
            if len(again) > len(found):
                found, engine = again, "two_column"
        out = pd.DataFrame([(doc, *r, engine) for r in found], columns=[c.split()[0] for c in REFERENCES.split(", ")])
        return out.astype({"year": "Int32"})

    return cells.select("doc_id", "page", "text", "citation_text", "start_page", "start_line").groupBy("doc_id").applyInPandas(run, REFERENCES)


def warnings(pages: DataFrame, refs: DataFrame, start: DataFrame) -> DataFrame:
    """doc_id, n_references, warnings: what a reviewer should know."""
    n = refs.groupBy("doc_id").agg(F.count("*").alias("n"))
    j = pages.select("doc_id").distinct().join(start, "doc_id", "left").join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rules = F.array_compact(
        F.array(
            F.when(F.col("inferred"), "start-inferred"),
            F.when(F.col("inferred").isNull(), "no-bibliography"),
            F.when(F.col("inferred").isNotNull() & (F.col("n") == 0), "no-entries"),
            F.when(F.col("n").between(1, 2), "few-entries"),
        )
    )
    return j.select("doc_id", F.col("n").alias("n_references"), rules.alias("warnings"))


