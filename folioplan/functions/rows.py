"""The identity rules on single values, for folds that are sequential by definition."""

from __future__ import annotations

import re
import unicodedata


def clean(v) -> str:
    return re.sub(r"^[\s﻿]+|[\s﻿]+$", "", "" if v is None else str(v))


def doi(v) -> str:
    return re.sub(r"(?i)^doi:\s*", "", re.sub(r"(?i)^https?://(dx\.)?doi\.org/", "", clean(v))).lower()


def title(v) -> str:
    t = unicodedata.normalize("NFKD", ("" if v is None else str(v)).lower())
    return re.sub(r"[^a-z0-9]+", " ", re.sub("[̀-ͯ]", "", t)).strip()


def slug(v, size: int = 80) -> str:
    t = unicodedata.normalize("NFKD", ("" if v is None else str(v)).lower())
    return re.sub("^-|-$", "", re.sub(r"[^a-z0-9]+", "-", re.sub("[̀-ͯ]", "", t)))[:size]


def year(v) -> int | None:
    try:
        y = float(v)
    except (TypeError, ValueError):
        return None
    return int(y) if y > 0 and y == int(y) else None


def arxiv(v) -> str:
    return re.sub(r"(?i)^arxiv:\s*", "", clean(v)).lower()


def identity(p: dict) -> str:
    if d := doi(p.get("doi")):
        return f"doi:{d}"
    if p.get("semanticScholarId"):
        return f"s2:{p['semanticScholarId']}"
    if p.get("arxivId"):
        return f"arxiv:{str(p['arxivId']).lower()}"
    return f"title:{title_year(p)}"


def title_year(p: dict) -> str:
    return f"{title(p.get('title'))}:{p.get('year') or ''}"


def same_work(a: dict, b: dict) -> bool:
    """The first identifier that both have decides; title and year need all four."""
    for f in (lambda p: doi(p.get("doi")), lambda p: clean(p.get("semanticScholarId")).lower(), lambda p: arxiv(p.get("arxivId"))):
        x, y = f(a), f(b)
        if x and y:
            return x == y
    ta, tb, ya, yb = title(a.get("title")), title(b.get("title")), year(a.get("year")), year(b.get("year"))
    return bool(ta and tb and ya and yb and ta == tb and ya == yb)
