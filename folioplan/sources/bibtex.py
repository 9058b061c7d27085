"""BibTeX in and out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioplan.functions import normalize as N
from folioplan.functions import rows as R


def _balanced(text: str, at: int) -> int:
    """Index of the brace that closes the one at ``at``; -1 if none does.  Quotes hide braces, backslashes hide both."""
    depth, quoted = 0, False
    for m in re.compile(r'\\.|["{}]', re.S).finditer(text, at):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif not quoted and c == "{":
            depth += 1
        elif not quoted and c == "}":
            depth -= 1
            if depth == 0:
                return m.start()
    return -1


def _fields(body: str) -> dict[str, str]:
    out, k = {}, 0
    name = re.compile(r"[\s,]*([A-Za-z0-9_-]*)\s*(=?)\s*")
    while k < len(body):
        m = name.match(body, k)
        k = m.end()
        if not m[1] or not m[2]:
            k = body.find(",", k)
            if k < 0:
                break
            continue
        if body[k : k + 1] == "{":
            end = _balanced(body, k)
            if end < 0:
                break
            raw, k = body[k : end + 1], end + 1
        elif body[k : k + 1] == '"':
            q = re.compile(r'"(?:\\.|[^"\\])*"?', re.S).match(body, k)
            raw, k = q[0], q.end()
        else:
            end = body.find(",", k)
            end = len(body) if end < 0 else end
            raw, k = body[k:end], end
        raw = raw.strip()
        if len(raw) > 1 and raw[0] + raw[-1] in ("{}", '""'):
            raw = raw[1:-1]
        out[m[1].lower()] = re.sub("[{}]", "", raw).strip()
        k = body.find(",", k)
        if k < 0:
            break
        k += 1
    return out


def author_list(value: str) -> list[str]:
    """"Last, First and Last, First" as names in reading order."""
    out = []
    for a in re.split(r"(?i)\s+and\s+", value or ""):
        a = a.strip()
        if not a:
            continue
        last, *rest = [p.strip() for p in a.split(",")]
        out.append(f"{' '.join(rest)} {last}".strip() if rest else a)
    return out


def entries(text: str) -> Iterator[dict]:
    """Papers of a BibTeX text; an entry that never ends stops the scan, one without a key is skipped."""
    k = 0
    while (at := text.find("@", k)) >= 0 and (start := text.find("{", at)) >= 0 and (end := _balanced(text, start)) >= 0:
        kind, content = text[at + 1 : start].strip(), text[start + 1 : end]
        k = end + 1
        comma = content.find(",")
        if comma <= 0:
            continue
        key, f = content[:comma].strip(), _fields(content[comma + 1 :])
        y = re.match(r"\s*([+-]?\d+)", f.get("year", ""))
        doi = R.doi(f.get("doi"))
        title = f.get("title") or key
        yield {
            "id": f"doi:{doi}" if doi else f"bib:{R.slug(key or title)}:{int(y[1]) if y else 'unknown'}",
            "citationKey": key, "title": title, "authors": author_list(f.get("author", "")), "year": int(y[1]) if y else None, "venue": f.get("journal") or f.get("booktitle") or f.get("publisher") or "",
            "type": kind or "article", "doi": doi, "url": f.get("url") or (f"https://doi.org/{doi}" if doi else ""), "abstract": f.get("abstract", ""),
            "keywords": [w.strip() for w in re.split("[,;]", f.get("keywords", "")) if w.strip()], "notes": f.get("note", ""),
        }


SCHEMA = "id string, citationKey string, title string, authors array<string>, year int, venue string, type string, doi string, url string, abstract string, keywords array<string>, notes string"


def parse(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row per entry of each text; the library's defaults for an import are added."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = [[e[n] for n in names] for t in b[column] if t for e in entries(t)]
            yield pd.DataFrame(rows, columns=names).astype({"year": "Int32"})

    parsed = texts.select(column).mapInPandas(run, SCHEMA)
    return parsed.withColumns({"topics": F.array().cast("array<string>"), "tags": F.array().cast("array<string>"), "status": F.lit("unread"), "relevance": F.lit(3), "starred": F.lit(False), "citationCount": F.lit(None).cast("bigint"), "source": F.lit("bibtex")})


def read(spark, path: str) -> DataFrame:
    return parse(spark.read.text(path, wholetext=True))


def entry_text(p: dict[str, Column]) -> Column:
    """A paper as one @article entry; blank fields are left out, braces dropped."""
    none = F.array().cast("array<string>")
    authors = F.coalesce(p["authors"], none)
    first = F.element_at(F.split(F.coalesce(F.when(N.text(F.get(authors, F.lit(0))) != "", F.get(authors, F.lit(0))), F.lit("paper")), r"\s+"), -1)
    year = F.coalesce(p["year"].cast("string"), F.lit(""))
    made = F.concat(N.slug(first), F.when(p["year"] != 0, year).otherwise(""), F.substring(N.slug(p["title"]), 1, 20))
    key = F.when(N.text(p["citationKey"]) != "", p["citationKey"]).otherwise(made)
    venue = F.when(F.lower(N.text(p["type"])).contains("conference"), "booktitle").otherwise("journal")
    words = F.array_join(F.concat(F.coalesce(p["keywords"], none), F.coalesce(p["tags"], none)), ", ", "")
    pairs = [(F.lit("title"), p["title"]), (F.lit("author"), F.array_join(authors, " and ", "")), (F.lit("year"), year), (venue, p["venue"]), (F.lit("doi"), p["doi"]), (F.lit("url"), p["url"]), (F.lit("abstract"), p["abstract"]), (F.lit("keywords"), words)]
    lines = F.filter(F.array(*[F.when(N.clean(v) != "", F.concat(F.lit("  "), n, F.lit(" = {"), N.js_trim(F.regexp_replace(N.text(v), "[{}]", "")), F.lit("}"))) for n, v in pairs]), lambda x: x.isNotNull())
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def export(papers: DataFrame) -> DataFrame:
    """id, value: one entry per paper; written as text, entries end with a blank line (K9)."""
    return papers.select("id", F.concat(entry_text({c: F.col(c) for c in ("citationKey", "title", "authors", "year", "venue", "type", "doi", "url", "abstract", "keywords", "tags")}), F.lit("\n")).alias("value"))


def write(papers: DataFrame, path: str) -> None:
    export(papers).select("value").write.mode("overwrite").text(path)
