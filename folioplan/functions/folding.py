"""Compatibility decomposition and accent stripping without leaving the JVM.

Characters that decompose to one letter go through ``translate``; the few that decompose to several are looked up only
in strings that hold one.  Hangul syllables stay whole: nothing here compares them with their parts.
"""

from __future__ import annotations

import json
import sys
import unicodedata as ud
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=2)
def _tables(all_marks: bool) -> tuple[str, str, str, dict[str, str]]:
    """(from, to, dropped, several) of NFKD followed by dropping marks: all of them, or U+0300 to U+036F only."""
    src, dst, drop, several = [], [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
            continue
        c = chr(cp)
        d = ud.normalize("NFKD", c)
        r = "".join(x for x in d if not (ud.category(x)[0] == "M" if all_marks else "̀" <= x <= "ͯ"))
        if r == c:
            continue
        if not r:
            drop.append(c)
        elif len(r) == 1:
            src.append(c)
            dst.append(r)
        elif all_marks or any(x.isascii() and x.isalnum() for x in r):
            several[c] = r
    return "".join(src), "".join(dst), "".join(drop), several


def _ranges(chars) -> str:
    """The characters as ranges of a regular-expression class."""
    runs: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


def _fold(c: Column, all_marks: bool) -> Column:
    src, dst, drop, several = _tables(all_marks)
    single = F.translate(c, src + drop, dst)  # characters beyond the end of ``dst`` are removed
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # folded to a constant
    spelled = F.array_join(F.transform(F.regexp_extract_all(single, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    # ASCII first: most strings go no further, and the class of the rare characters is slow to test.
    return F.when(~c.rlike(r"[^\x00-\x7f]"), c).when(c.rlike(f"[{_ranges(several)}]"), spelled).otherwise(single)


def nfkd_plain(c: Column) -> Column:
    """NFKD without the combining diacritical marks U+0300 to U+036F.

    For keys of ASCII letters and digits: a character that decomposes to several and to none of those stays as it is.
    """
    return _fold(c, False)


def nfkd_no_marks(c: Column) -> Column:
    """NFKD without any mark."""
    return _fold(c, True)
