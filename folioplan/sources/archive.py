"""ZIP archives of a library: keys, reader with its checks, writer."""

from __future__ import annotations

import base64
import io
import json
import re
import zipfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioplan.compat import cut
from folioplan.functions import normalize as N
from folioplan.operators.ranking import numbered
from folioplan.sources.bibtex import entries

VERSION, PREVIOUS, LEGACY = 3, 2, 1
MAX_FILES, MAX_BYTES = 65_535, 2**32 - 1


def assigned_keys(papers: DataFrame, rounds: int = 50) -> DataFrame:
    """id, key: unique without regard to case; the first of a name keeps it, later ones get -2, -3 ....

    Numbers within a name come from one window; where a made key equals another name, that paper tries its next number
    in the next round.  Rounds end when all keys differ, which a few do.
    """
    base = N.archive_key(F.col("citationKey"))
    made = N.default_archive_key(F.col("title"), F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.array(F.lit("paper"))), F.col("year"))
    rows = papers.select("id", F.when(base != "", base).when(made != "", made).otherwise(F.concat(F.lit("paper-"), F.substring(F.sha2("id", 256), 1, 8))).alias("base"))
    rows = numbered(rows.withColumn("_l", F.lower("base")), ["_l"], [F.col("id")], "n").drop("_l")
    for _ in range(rounds):
        key = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat(F.substring(F.col("base"), F.lit(1), 78 - F.length(F.col("n").cast("string"))), F.lit("-"), F.col("n").cast("string")))
        keyed = cut(rows.withColumn("key", key).withColumn("place", F.row_number().over(Window.partitionBy(F.lower("key")).orderBy("n", "id"))))  # few share a made key
        if not keyed.where("place > 1").limit(1).count():
            return keyed.select("id", "key")
        top = keyed.groupBy(F.lower("base").alias("_b")).agg(F.max("n").alias("top"))
        rows = keyed.join(top, F.lower("base") == F.col("_b")).select("id", "base", F.when(F.col("place") > 1, F.col("top") + F.col("place") - 1).otherwise(F.col("n")).cast("int").alias("n"))
    raise RuntimeError("archive keys did not settle")


def write(path: str, papers: list[tuple[str, dict]], edges: list[dict], topics: list[dict], meta: dict, pdfs: dict[str, bytes] | None = None, exported_at: str = "") -> None:
    """A version 3 archive; papers are (key, record).  Entries are stored, names are UTF-8, sizes stay within ZIP32."""
    pdfs = pdfs or {}
    if 1 + len(papers) + len(pdfs) > MAX_FILES:
        raise ValueError("too many files for an archive")
    payload = {
        "archiveVersion": VERSION, "schemaVersion": 1, "exportedAt": exported_at, "papers": [{"key": k, "paper": p} for k, p in papers], "edges": edges, "topics": topics, "meta": meta,
        "attachments": [{"key": k, "paperId": p.get("id"), "fileName": f"{k}.pdf"} for k, p in papers if p.get("id") in pdfs],
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=False) as z:
        z.writestr("metadata.json", json.dumps(payload, ensure_ascii=False, indent=2) + "\n")
        for k, p in papers:
            z.writestr(f"papers/{k}.json", json.dumps({"schemaVersion": 1, "paper": p}, ensure_ascii=False, indent=2) + "\n")
        for k, p in papers:
            if p.get("id") in pdfs:
                z.writestr(f"{k}.pdf", pdfs[p["id"]])


def write_library(path: str, papers: DataFrame, edges: DataFrame, topics: DataFrame, exported_at: str = "") -> None:
    """The tables as one archive, streamed through the driver: an archive is one file of at most 65,535 entries."""
    keys = assigned_keys(papers)
    row = lambda df: F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    keyed = papers.select("id", row(papers).alias("j")).join(keys, "id").orderBy("key").select("key", "j")
    write(path, [(r.key, json.loads(r.j)) for r in keyed.toLocalIterator()], [json.loads(r.j) for r in edges.select(row(edges).alias("j")).toLocalIterator()], [json.loads(r.j) for r in topics.select(row(topics).alias("j")).toLocalIterator()], {}, exported_at=exported_at)


def _checked(payload: dict, bib: str | None, version: int) -> dict:
    if payload.get("archiveVersion") != version or not isinstance(payload.get("papers"), list):
        raise ValueError("archive metadata has an unsupported structure")
    if not isinstance(payload.get("edges"), list) or not isinstance(payload.get("topics"), list) or not isinstance(payload.get("meta"), dict):
        raise ValueError("archive metadata lacks collections")
    seen = set()
    for item in payload["papers"]:
        key = item.get("key") or ""
        if not re.fullmatch(r"(?![.-])[A-Za-z0-9._-]{1,80}(?<![.-])", key) or not isinstance(item.get("paper"), dict):
            raise ValueError(f"invalid key in archive: {key!r}")
        if key.lower() in seen:
            raise ValueError(f"duplicate key in archive: {key}")
        seen.add(key.lower())
    if bib is not None:
        visible = {e["citationKey"] for e in entries(bib)}
        for item in payload["papers"]:
            if item["key"] not in visible:
                raise ValueError(f"archive metadata does not match its BibTeX: {item['key']}")
    return payload


def parse(data: bytes, marker: str = r"[A-Za-z-]*Archive-Version", chunk: str = r"[A-Za-z-]*Metadata") -> dict:
    """papers (key, record), edges, topics, meta and pdfs of an archive of version 3, 2 or 1, with every check of the format."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError(f"not a ZIP archive: {e}") from e
    files: dict[str, bytes] = {}
    for info in z.infolist():
        if info.flag_bits & 1:
            raise ValueError("encrypted entries are not supported")
        if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"unsupported compression of {info.filename}")
        if not info.filename or info.filename in files:
            raise ValueError("invalid or duplicate file name")
        try:
            files[info.filename] = z.read(info)  # checks size and CRC
        except zipfile.BadZipFile as e:
            raise ValueError(str(e)) from e
    named = {n.lower(): n for n in files}
    bib = files[named["library.bib"]].decode() if "library.bib" in named else None
    if "metadata.json" in named:
        payload = json.loads(files[named["metadata.json"]])
        version = payload.get("archiveVersion")
        if version not in (VERSION, PREVIOUS):
            raise ValueError(f"unsupported archive version {version}")
        if version == PREVIOUS and bib is None:
            raise ValueError("a version 2 archive needs library.bib")
        payload = _checked(payload, bib, version)
    elif bib is not None:
        m = re.search(rf"(?im)^%\s*{marker}:\s*(\d+)\s*$", bib)
        if not m or int(m[1]) != LEGACY:
            raise ValueError("archive without metadata.json")
        parts = re.findall(rf"(?m)^%\s*{chunk}:\s*([A-Za-z0-9_-]+)\s*$", bib)
        raw = "".join(parts)
        payload = _checked(json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4))), bib, LEGACY)
    else:
        raise ValueError("archive without metadata.json")
    known = {f"{i['key']}.pdf": i for i in payload["papers"]}
    pdfs = {}
    for n, content in files.items():
        if n.lower().endswith(".pdf"):
            if n not in known:
                raise ValueError(f"PDF of no paper: {n}")
            if content[:4] != b"%PDF":
                raise ValueError(f"{n} is no PDF")
            pdfs[known[n]["paper"].get("id")] = content
    return {"papers": [(i["key"], i["paper"]) for i in payload["papers"]], "edges": payload["edges"], "topics": payload["topics"], "meta": payload["meta"], "pdfs": pdfs}


def read(spark, path: str) -> DataFrame:
    """path, store, id, record (JSON) of every archive under a path: archives are parsed in parallel, one task each."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"]):
                a = parse(bytes(data))
                rows += [(p, "papers", r.get("id"), json.dumps(r, ensure_ascii=False)) for _, r in a["papers"]]
                rows += [(p, s, r.get("id"), json.dumps(r, ensure_ascii=False)) for s in ("edges", "topics") for r in a[s]]
            yield pd.DataFrame(rows, columns=["path", "store", "id", "record"])

    return files.mapInPandas(run, "path string, store string, id string, record string")
