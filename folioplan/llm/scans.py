"""Repair of text from scanned pages: furniture, words broken over lines, misread characters and word gaps.

Plan
----
1. A lexicon (word, count) is counted over clean text.  Confusable words share a skeleton, a spelling in which
   characters and pairs that scanners confuse are written alike.  The most frequent words are broadcast (``common``, a
   fixed number of entries); of all other words each page gets just those that its own unknown pieces could mean, by
   an equi-join on the skeleton - nothing that grows with the data is ever held whole.
2. Lines near the edges of pages meet their repetitions (an aggregate per document and skeleton, and one over
   documents), which with the form of the line decides what is furniture.
3. Each page is decoded by itself: lines without furniture become one stream of pieces in which runs around unknown
   pieces and hyphens at line ends are decoded jointly (keep, confusion, split, merge, hyphen left out, hyphen of a
   compound, hyphen that stands for a word to come), on the next page where need be.  Paragraph boundaries are chosen by
   dynamic programming over the lines, with costs of whole paragraphs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioplan.compat import by_slices, dropped, kept, release

#: Letters as the strokes that scanners confuse - i, l, t, f and 1 are one stroke, h, b, u (and ii, li, fi,
#: ti, the last also read as ü) two, n is r and a stroke, m is r and n, d is c and a stroke, c and e are one.
_STROKES = str.maketrans(
    {"i": "l", "1": "l", "|": "l", "!": "l", "t": "l", "f": "l", "j": "l", "h": "ll", "b": "ll", "u": "ll", "6": "ll", "8": "ll", "n": "rl", "m": "rrl", "d": "el", "c": "e", "¢": "e", "w": "vv", "0": "o", "5": "s", "$": "s", "9": "g", "q": "g", "2": "z"}
)
_DIGITS = str.maketrans({"l": "1", "i": "1", "I": "1", "|": "1", "o": "0", "O": "0", "s": "5", "S": "5", "g": "9", "B": "8", "Z": "2", "z": "2"})
PIECE = re.compile(r"[^\s\-‐‑–—­¬,.;:()\[\]{}/\"“”„«»'’‘`´&?!%+=<>*·…¿¡#@~^\\]+")
DOI = re.compile(r"10\.\d{4,9}/[^\s,;]*[^\s,;.\])]")
HYPHEN = re.compile(r"[-‐‑­¬]\s*$")
SECOND = re.compile(r"(?<=[^\W\d_][-‐‑])[^\W\d_]+")
ROMAN = re.compile(r"[ivxlcdm1]+", re.I)


@lru_cache(maxsize=65_536)
def skeleton(word: str) -> str:
    if word.isascii():
        return word.lower().translate(_STROKES)
    w = unicodedata.normalize("NFKD", word.lower())
    return "".join(c for c in w if not unicodedata.combining(c)).translate(_STROKES)


def line_key(line: str) -> str:
    """Skeleton of a line without spaces, marks and numbers."""
    return skeleton.__wrapped__(re.sub(r"[\W_]+", "", re.sub(r"\b\d+\b", "", line)))  # lines hardly come again: no cache


# ---- lexicon ------------------------------------------------------------------------------------------------------


def lexicon(texts: DataFrame) -> DataFrame:
    """word, n, skel over a column ``text``: lower-case pieces, DOIs, and with a "-" second parts of compounds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for t in b["text"]:
                if t:
                    t = t.lower()
                    c.update(PIECE.findall(t))
                    c.update("doi:" + x for x in DOI.findall(t))
                    c.update("-" + x for x in SECOND.findall(t))
            yield pd.DataFrame({"word": list(c.keys()), "n": list(c.values())})

    def skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(skel=[skeleton(w) for w in b["word"]])

    counted = texts.select("text").mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return kept(counted.mapInPandas(skeletons, "word string, n bigint, skel string"))


def clean_texts(papers: DataFrame) -> DataFrame:
    """Titles, abstracts, venues, names, keywords and DOIs of papers as one column."""
    once = papers.select("id", "title", "abstract", "venue", "publisher", "doi", "authors", "keywords").dropDuplicates(["id"])
    return once.select(F.concat_ws(" \n ", "title", "abstract", "venue", "publisher", "doi", F.array_join("authors", " \n "), F.array_join("keywords", " \n ")).alias("text"))


class Lexicon:
    """Counts of the common words, and of the words that the page at hand may need."""

    def __init__(self, common: list[tuple[str, int, str]], total: int, compounds: int):
        self.count = {w: n for w, n, _ in common}
        self.best: dict[str, tuple[int, str]] = {}
        for w, n, s in common:
            if s not in self.best or (n, w) > self.best[s]:
                self.best[s] = (n, w)
        self.total, self.compounds = max(total, 1), max(compounds, 1)
        self.more: dict[str, int] = {}
        self.more_best: dict[str, tuple[int, str]] = {}

    def page(self, words: list[tuple[str, int, str]]) -> None:
        self.more, self.more_best = {}, {}
        for w, n, s in words:
            self.more[w] = n
            if s not in self.more_best or (n, w) > self.more_best[s]:
                self.more_best[s] = (n, w)

    def n(self, w: str) -> int:
        return self.count.get(w) or self.more.get(w, 0)

    def alike(self, w: str) -> tuple[int, str]:
        """The most frequent word of the same skeleton; a slip of accents or look-alikes is in the skeleton too."""
        s = skeleton(w)
        return max(self.best.get(s, (0, "")), self.more_best.get(s, (0, "")))

    def lp(self, w: str) -> float:
        # A word never seen is the less likely one word the longer it is.
        n = self.n(w)
        return math.log(n / self.total) if n else math.log(0.02 / self.total) - max(0, len(w) - 3)


    def open(self, w: str) -> bool:
        """Hardly in clean text, or a word that it holds far more often looks alike."""
        n = self.n(w)
        return n <= RARE or self.alike(w)[0] > FAR * n

    def stands_alone(self, t: str) -> bool:
        """After a hyphen at a line's end, the word is not its second part: it is far more often a word than that."""
        return self.n(t) / self.total > 5 * (self.n("-" + t) + 0.5) / self.compounds


RARE = 3  # pieces seen no more often than this in clean text are open to other readings,
FAR = 400  # and more frequent ones beside words that are so many times as frequent


def unknown_pieces(lines: list[str], common: set[str], cuts: bool = True) -> set[str]:
    """Skeletons that the decoding of these lines may ask for beyond the common words.

    ``cuts``: also those of both parts of a piece; not needed where all words that a part may be are common.
    """
    out = set()
    for line in lines:
        pieces = PIECE.findall(line.lower())
        if pieces:
            out.add(skeleton("-" + pieces[0]))
        for k, w in enumerate(pieces):
            if w in common or w.isdigit():
                continue
            out.add(skeleton(w))
            if cuts:  # two words whose gap was lost
                out.update(skeleton(x) for c in range(1, len(w)) for x in (w[:c], w[c:]))
            for other in (pieces[k - 1] if k else "", pieces[k + 1] if k + 1 < len(pieces) else ""):
                if other:
                    out.add(skeleton(w + other))
                    out.add(skeleton(other + w))
        out.update(skeleton("doi:" + d) for d in DOI.findall(line.lower()))
    return out


# ---- decoding -----------------------------------------------------------------------------------------------------

CONFUSED, GAP, COMPOUND = 4.0, 3.0, 1.0
PART = 5  # how often both parts of a piece must be seen for it to be two words without their gap
#: What a piece's last hyphen is: none, one at a line's end, one that cannot be a compound's (a soft one, or after a space).
PLAIN, HYPHENED, SOFT = 0, 1, 2


def readings(pieces: list[str], tied: list[bool], hyphens: list[int], lex: Lexicon) -> list[tuple[int, int, list[str], str]]:
    """Joint decoding of pieces (lower case): the changes (first, one past last piece, words read instead, kind).

    ``tied[k]``: piece k and the next stand on one line with one space between them, so that the gap may be false.
    ``hyphens[k]``: the hyphen at the end of a line that piece k ends.  Kinds: "read" for another reading, "word" for two
    pieces that are one word broken by a hyphen, "compound" for two that keep it.
    """
    n = len(pieces)
    odd = [not w.isdigit() and lex.open(w) for w in pieces]
    need = [odd[k] or hyphens[k] > 0 or k > 0 and hyphens[k - 1] > 0 for k in range(n)]
    changes: list[tuple[int, int, list[str], str]] = []
    k = 0
    while k < n:
        if not need[k]:
            k += 1
            continue
        a = max(0, k - 1)
        z = k
        while z < n and (need[z] or z + 1 < n and need[z + 1]):
            z += 1
        z = min(n, z + 1)
        score = [0.0] + [-math.inf] * (z - a)
        step: list[tuple[int, list[str] | None, str]] = [(0, None, "")] * (z - a + 1)
        for i in range(a, z):
            here = score[i - a]
            if here == -math.inf:
                continue
            for j, words, cost, kind in _options(pieces, i, z, tied, hyphens, odd, lex):
                v = here - cost + (sum(lex.lp(x) for x in words) if words else _keep(pieces[i], lex))
                if v > score[j - a]:
                    score[j - a], step[j - a] = v, (i, words, kind)
        path, j = [], z
        while j > a:
            i, words, kind = step[j - a]
            if kind:
                path.append((i, j, words, kind))
            j = i
        changes += path[::-1]
        k = z
    return changes


def _keep(w: str, lex: Lexicon) -> float:
    return math.log(1 / lex.total) if w.isdigit() else lex.lp(w)


def _likely(w: str, n: int) -> bool:
    """A word seen so often may be meant by a piece of that length."""
    return n >= (20 if len(w) <= 3 else 5 if len(w) == 4 else 1)


def _options(pieces: list[str], i: int, z: int, tied: list[bool], hyphens: list[int], odd: list[bool], lex: Lexicon):
    w = pieces[i]
    if hyphens[i]:
        t = pieces[i + 1]
        both = w + t
        n, best = lex.alike(both)
        yield i + 2, [both], 0.0 if lex.n(both) or n or not lex.stands_alone(t) else CONFUSED, "word"
        if not lex.n(both) and best and _likely(both, n):
            yield i + 2, [best], CONFUSED, "word"
        if not lex.n(both) and not n:
            if hyphens[i] == HYPHENED and lex.n(w) > RARE and lex.n(t) > RARE:
                yield i + 2, [w, t], COMPOUND, "compound"
            if hyphens[i] == HYPHENED and lex.stands_alone(t):
                yield i + 1, None, 0.0, ""
        return
    yield i + 1, None, 0.0, ""
    if odd[i]:
        n, best = lex.alike(w)
        have = lex.n(w)
        if best and best != w and _likely(w, n) and n > 8 * have:
            yield i + 1, [best], CONFUSED, "read"
        if have == 0 and len(w) >= 5:
            for c in range(1, len(w)):
                x, y = w[:c], w[c:]
                nx = lex.n(x)
                if nx < PART:
                    continue
                ny = lex.n(y)
                if ny >= PART and (min(len(x), len(y)) >= 3 or (min(nx, ny) >= 100 and max(len(x), len(y)) >= 4 and min(len(x), len(y)) == 2) or (x == "a" and nx >= 100)):
                    yield i + 1, [x, y], GAP, "read"
    if i + 1 < z and tied[i] and (odd[i] or odd[i + 1]) and not w.isdigit() and not pieces[i + 1].isdigit() and not hyphens[i + 1]:
        both = w + pieces[i + 1]
        n = lex.n(both)
        few = min(lex.n(w), lex.n(pieces[i + 1]))
        if n > max(0, 50 * few) and len(both) >= 4:
            yield i + 2, [both], GAP, "read"
        elif not n and few == 0:
            m, best = lex.alike(both)
            if m >= 5 and len(both) >= 6:
                yield i + 2, [best], GAP + CONFUSED, "read"


def number_misread(word: str, lex: Lexicon) -> bool:
    """A number in which digits were read as letters."""
    digits = sum(c.isdigit() for c in word)
    if not digits or word.isdigit() or lex.n(word.lower()) > 0:
        return False
    letters = [c for c in word if not c.isdigit()]
    easy = all(c in "lIiOo|" for c in letters)
    return word.translate(_DIGITS).isdigit() and (easy or digits >= 2 and len(letters) == 1)


class Page:
    """Lines of a page (or of a bibliography entry) with their furniture, decoded against a lexicon."""

    def __init__(self, lines: list[str], furniture: list[bool], follow: str | None, lex: Lexicon):
        self.lines, self.furniture, self.lex = lines, furniture, lex
        self.text_lines = [k for k, line in enumerate(lines) if line.strip() and not furniture[k]]
        self.follow = follow
        self.joint: dict[int, str] = {}  # lines whose last word goes on: "word" without its hyphen, "compound" with it
        self.misread: set[int] = set()
        self.repaired: dict[int, str] = {}

    def decode(self) -> None:
        pieces, where, tied, hyphens = [], [], [], []
        fixes: dict[int, list[tuple[int, int, str]]] = {}
        for order, k in enumerate(self.text_lines):
            line = self.lines[k]
            dois = [m.span() for m in DOI.finditer(line)]
            for a, b in dois:
                d = "doi:" + line[a:b].lower()
                if not self.lex.n(d):
                    n, best = self.lex.alike(d)
                    if n and best.startswith("doi:"):
                        self.misread.add(k)
                        fixes.setdefault(k, []).append((a, b, best[4:]))
            found = [m for m in PIECE.finditer(line) if not any(a <= m.start() < b for a, b in dois)]
            if hyphens and hyphens[-1] and (not found or found[0].start() > len(line) - len(line.lstrip())):
                hyphens[-1] = PLAIN  # the next line begins with no piece
            for j, m in enumerate(found):
                w, last = m[0].lower(), j == len(found) - 1
                if number_misread(m[0], self.lex):
                    self.misread.add(k)
                    fixes.setdefault(k, []).append((m.start(), m.end(), m[0].translate(_DIGITS)))
                    w = "0"
                pieces.append(w)
                where.append((k, m.start(), m.end()))
                tied.append(not last and found[j + 1].start() - m.end() == 1 and line[m.end()] == " ")
                hyphens.append(self._hyphen(line, m) if last else PLAIN)
        if hyphens and hyphens[-1]:
            m = PIECE.match(self.follow.strip()) if self.follow else None
            if m and where[-1][0] == self.text_lines[-1]:
                pieces.append(m[0].lower())
                where.append((-1, 0, 0))
                tied.append(False)
                hyphens.append(PLAIN)
            else:
                hyphens[-1] = PLAIN
        for i, j, words, kind in readings(pieces, tied, hyphens, self.lex):
            k, a, b = where[i]
            if k < 0:
                continue
            if kind == "compound":
                self.joint[k] = kind
            elif kind == "word":
                self.joint[k] = kind
                self._broken_misread("".join(words), where[i], where[i + 1])
            else:
                b = where[j - 1][2]
                self.misread.add(k)
                fixes.setdefault(k, []).append((a, b, self._cased(self.lines[k][a:b], words)))
        for k in self.text_lines:
            line = self.lines[k]
            for a, b, new in sorted(fixes.get(k, ()), reverse=True):
                line = line[:a] + new + line[b:]
            self.repaired[k] = line

    @staticmethod
    def _hyphen(line: str, m: re.Match) -> int:
        """What stands after the last piece of a line."""
        rest = line[m.end() :].strip()
        if len(rest) != 1 or not HYPHEN.match(rest) or not re.search(r"[^\W\d_]$", m[0]):
            return PLAIN
        return SOFT if rest in "­¬" or line[m.end() :][0] == " " else HYPHENED

    @property
    def broken(self) -> set[int]:
        return set(self.joint)

    def _broken_misread(self, whole: str, head: tuple[int, int, int], tail: tuple[int, int, int]) -> None:
        """Which of the lines that share a broken word holds a misread character."""
        k, a, b = head
        if not whole.startswith(self.lines[k][a:b].lower()):
            self.misread.add(k)
        k, a, b = tail
        if k >= 0 and not whole.endswith(self.lines[k][a:b].lower()):
            self.misread.add(k)

    @staticmethod
    def _cased(old: str, words: list[str]) -> str:
        new = " ".join(words)
        if old.isupper() and len(old) > 1:
            return new.upper()
        return new[:1].upper() + new[1:] if old[:1].isupper() else new

    def paragraphs(self) -> list[str]:
        """Repaired paragraphs; their boundaries minimise the cost of breaks, of joins and of the shapes they leave.

        The shape of a paragraph depends on all its lines: those before the last should reach its own longest line,
        those after the first share one left edge.  A paragraph may have any number of lines.
        """
        rows = self.text_lines
        if not rows:
            return []
        n, width = len(rows), self._width()
        long = [len(self.lines[k]) for k in rows]
        edge = [len(self.lines[k]) - len(self.lines[k].lstrip()) for k in rows]
        signs = [0.0] + [self._signs(rows, x, width) for x in range(1, n)]
        best, back = [math.inf] * (n + 1), [0] * (n + 1)  # of the first so many lines
        best[0] = 0.0
        for j in range(n):  # a paragraph of lines i..j
            joins, ragged, widest, inner = 0.0, 0, long[j], []
            for i in range(j, -1, -1):
                if i < j:
                    joins += max(0.0, signs[i + 1])
                    if i + 2 <= j and abs(edge[i + 1] - edge[i + 2]) > 1:
                        ragged += 1
                    widest = max(widest, long[i])
                    insort(inner, long[i])
                if joins + RAGGED * ragged >= best[j + 1]:
                    break  # more lines only cost more
                cost = best[i] + (1.0 - min(0.0, signs[i]) if i else 0.0) + joins + RAGGED * ragged + SHORT * bisect_left(inner, 0.6 * widest)
                if cost < best[j + 1]:
                    best[j + 1], back[j + 1] = cost, i
        spans, j = [], n
        while j > 0:
            spans.append((back[j], j))
            j = back[j]
        return [self._text(rows[i:j]) for i, j in reversed(spans)]

    def runs_on(self) -> str | None:
        """What joins the last paragraph to the next page (a space, "", or the hyphen of a compound); None where it ends here."""
        if not self.text_lines or self.follow is None:
            return None
        last, width = self.text_lines[-1], self._width()
        signs = self._evidence(last, self.follow, width)
        if 1.0 - min(0.0, signs) < max(0.0, signs):
            return None
        return {"word": "", "compound": "-"}.get(self.joint.get(last, ""), " ")

    def _width(self) -> int:
        return sorted(len(self.lines[k]) for k in self.text_lines)[int(0.9 * (len(self.text_lines) - 1))]

    def _signs(self, rows: list[int], x: int, width: int) -> float:
        """Evidence for a paragraph to start with text line x: positive for, negative against."""
        k, before = rows[x], rows[x - 1]
        blank = any(not self.lines[y].strip() for y in range(before + 1, k)) and not any(self.furniture[y] for y in range(before + 1, k))
        return (2.0 if blank else 0.0) + self._evidence(before, self.lines[k], width)

    def _evidence(self, before: int, line: str, width: int) -> float:
        """What the words of a line and of the text line before it say, on one page or over two."""
        signs, above = 0.0, self.lines[before]
        if INDENTED.match(line) and not INDENTED.match(above):
            signs += 1.5
        ended = bool(ENDED.search(above))
        signs += 0.4 if ended else -2.0
        if len(above) < 0.75 * width:
            signs += 0.8
        if NUMBER.match(line):
            signs += 1.5
        if not ended and len(above) < 0.7 * width and HEADING.match(above):
            signs += 4.0  # a numbered heading stands alone
        if before in self.joint or LOWER.match(line):
            signs -= 3.0
        return signs

    def _text(self, rows: list[int]) -> str:
        out = []
        for at, k in enumerate(rows):
            line = re.sub(r"\s+", " ", self.repaired.get(k, self.lines[k]).strip())
            if k in self.joint and at + 1 < len(rows):
                out.append(HYPHEN.sub("", line) + ("-" if self.joint[k] == "compound" else ""))
            else:
                out.append(line + " ")
        return "".join(out).rstrip()


#: What a line short of its paragraph's measure costs before the last, and a change of the left edge after the first.
SHORT, RAGGED = 0.3, 0.5
INDENTED, ENDED, LOWER = re.compile(r"\s{2,}\S"), re.compile(r"[.!?:]\s*$"), re.compile(r"\s*[a-zß-ÿ]")
NUMBER, HEADING = re.compile(r"\s*(\[\d+\]|\d{1,3}[.)]?)\s+\S"), re.compile(r"\s*\d{1,2}(\.\d+)*\s+[^\W\d_]")


# ---- furniture ----------------------------------------------------------------------------------------------------

#: Phrases of stamps and notices on copies.
NOTICES = ("notforresale", "notforsale", "notfordistribution", "allrightsreserved", "personaluseonly", "downloadedfrom", "scannedfrom", "scannedby", "readingroomcopy", "licensedto", "interlibraryloan", "copyright", "unauthorizedcopying", "donotcopy")
_NOTICES = tuple(skeleton(n) for n in NOTICES)


def page_number(line: str) -> bool:
    """A line of nothing but a page number, in whatever dress."""
    t = line.strip()
    m = re.fullmatch(r"(?:[-–—\[(|]\s*)?(?:page|pag[ea]?\.?|p\.|seite|s\.|стр\.)?\s*([0-9A-Za-z]{1,5})(?:\s*(?:of|/|von|de)\s*[0-9A-Za-z]{1,5})?(?:\s*[-–—\])|])?", t, re.I)
    if not m:
        return False
    core = m[1]
    if re.match(r"\W*(?:page|p\.|seite|стр)", t, re.I) and re.search(r"\d", t):
        return True
    return core.isdigit() or core.translate(_DIGITS).isdigit() and (any(c.isdigit() for c in core) or core in ("l", "I", "O")) or bool(ROMAN.fullmatch(core)) and core in (core.lower(), core.upper()) and len(core) <= 5


def head_form(line: str) -> str:
    """What a line looks like: "number", "notice", "caps" (a running head in capitals), "source", "head", or ""."""
    t = line.strip()
    if page_number(line):
        return "number"
    if noticed(t):
        return "notice"
    letters = [c for c in t if c.isalpha()]
    upper = sum(c.isupper() for c in letters) / max(1, len(letters))
    if len(letters) >= 6 and upper > 0.9:
        if re.match(r"^\S{1,5}\s{2,}\S", t) or re.search(r"\S\s{2,}\S{1,5}$", t) or re.search(r"\bET\s*AL\.?$", t):
            return "caps"
        return "capital" if re.fullmatch(r"\W*\w+\W*", t) or len(t.split()) < 3 else "capitals"
    if re.search(r"\s\S{1,4}\s*\(\S{4}\)\s*\S{1,5}[–-]\S{1,5}$", t) and not t.endswith("."):
        return "source"
    words = [w for w in re.findall(r"[^\W\d_]+", t) if len(w) > 3]
    if len(words) >= 2 and t[:1].isupper() and not re.search(r"[.;]$", t) and not re.match(r"^\S{1,3}\s[A-Z]", t) and sum(w[0].isupper() for w in words) >= 0.7 * len(words):
        return "head"
    return ""


#: ASCII characters as in a line's key: strokes, and nothing for spaces and marks.
_AS_KEY = {c: chr(c).lower().translate(_STROKES) if chr(c).isalnum() else "" for c in range(128)}
_EXACT = re.compile(r"[0-9]|[^\x00-\x7f]")
_NOTICED = re.compile("|".join(map(re.escape, _NOTICES)))


def noticed(line: str) -> bool:
    """A phrase of a notice stands in the line; its exact key is built only where numbers or other letters may matter."""
    if not _EXACT.search(line):
        return _NOTICED.search(line.translate(_AS_KEY)) is not None
    return _NOTICED.search(line_key(line)) is not None


def _edges(lines: list[str]) -> list[tuple[int, str, str]]:
    """(line, key, form) of the lines that may be furniture: the outermost ones, and notices wherever they stand."""
    full = [k for k, line in enumerate(lines) if line.strip()]
    out = []
    for at, k in enumerate(full):
        below = len(full) - 1 - at
        edge = at < 3 or below < 3
        form = head_form(lines[k]) if edge else "notice" if noticed(lines[k]) else ""
        if form:
            out.append((k, line_key(lines[k]), f"{form}:{min(at, below) if edge else 9}:{'t' if at <= below else 'b'}"))
    return out


def _page_rows(pages: DataFrame) -> DataFrame:
    """One row per page with its lines; repeated rows of a page count once (the largest text)."""
    once = pages.where("doc_id IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL").groupBy("doc_id", "page").agg(F.max("text").alias("text"))
    return once.select("doc_id", "page", F.split("text", "\n", -1).alias("lines"))


def furniture(page_rows: DataFrame) -> DataFrame:
    """doc_id, page, furniture: the numbers of the lines that belong to the page or the copy."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, p, k, key, *form.split(":")) for d, p, lines in zip(b["doc_id"], b["page"], b["lines"]) for k, key, form in _edges(list(lines))]
            out = pd.DataFrame(rows, columns=["doc_id", "page", "line", "key", "form", "depth", "edge"])
            out["depth"] = out["depth"].astype(int)
            yield out

    cand = kept(by_slices(page_rows, edges, "doc_id string, page int, line int, key string, form string, depth int, edge string"))
    repeated = cand.where("form IN ('capital', 'capitals', 'head', 'caps', 'source') AND length(key) >= 6").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("n"))
    first = cand.groupBy("doc_id").agg(F.min("page").alias("first"))
    j = cand.join(repeated, ["doc_id", "key"], "left").join(first, "doc_id").withColumn("n", F.coalesce("n", F.lit(1)))
    sure = F.col("form").isin("notice", "caps") | (F.col("form") == "source") & (F.col("edge") == "b") | (F.col("form") == "number") & (F.col("depth") <= 1)
    sure = sure | (F.col("form") == "capitals") & (F.col("depth") == 0) & ((F.col("page") > F.col("first")) | (F.col("n") >= 2))
    again = (F.col("n") >= 2) & (F.col("depth") <= 2) & F.col("form").isin("capital", "capitals", "head")
    picked = j.where(sure | again | F.col("form").isin("capital", "capitals", "head") & (F.col("depth") <= 1)).select(
        "doc_id", "page", F.struct("line", (sure | again & (F.col("page") > F.col("first"))).alias("sure"), again.alias("again"), "form", "depth", "edge").alias("c")
    )
    per_page = picked.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("c")).alias("c"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, p, lines, c in zip(b["doc_id"], b["page"], b["lines"], b["c"]):
                lines, got = list(lines), []
                full = [k for k, x in enumerate(lines) if x.strip()]
                for x in c:
                    k = x["line"]
                    if x["sure"]:
                        got.append(k)
                    elif x["edge"] == "t" and len(key := line_key(lines[k])) >= 8:
                        # A running head on the page of the title: the whole line follows.
                        after = full[bisect_right(full, k) :][:3]
                        if any(line_key(lines[y]).startswith(key) for y in after) and (x["again"] or len(key) >= 14):
                            got.append(k)
                    elif x["edge"] == "b" and x["again"]:
                        got.append(k)
                rows.append((d, p, got))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "furniture"])

    judged = kept(by_slices(page_rows.join(per_page, ["doc_id", "page"]), judge, "doc_id string, page int, furniture array<int>"))
    dropped(cand)
    return judged


# ---- the whole ----------------------------------------------------------------------------------------------------


def _items(pages: DataFrame, drafts: DataFrame) -> DataFrame:
    """no, src, doc_id, item_no, lines, furniture, follow (the first text line of the next page); no is the item's number.

    Every step is kept before the next one begins, and what only it needed is let go.
    """
    rows = kept(_page_rows(pages))
    release(rows.sparkSession)
    found = furniture(rows)
    marked = rows.join(found, ["doc_id", "page"], "left").withColumn("furniture", F.coalesce("furniture", F.array().cast("array<int>")))
    texts = F.filter("lines", lambda x, i: (F.trim(x) != "") & ~F.array_contains("furniture", i))
    marked = kept(marked.withColumn("first", F.try_element_at(texts, F.lit(1))))
    dropped(rows, found)
    following = marked.select("doc_id", (F.col("page") - 1).alias("page"), F.col("first").alias("follow"))
    out = marked.join(following, ["doc_id", "page"], "left").select(F.lit("pdf_pages").alias("src"), "doc_id", F.col("page").alias("item_no"), "lines", "furniture", "follow")
    # Lines of bibliography entries are lines of pages: what is furniture there is furniture here.
    gone = marked.select("doc_id", "page", F.explode("furniture").alias("k"), "lines").select("doc_id", "page", F.trim(F.get("lines", F.col("k"))).alias("t")).distinct()
    once = drafts.where("doc_id IS NOT NULL AND draft_no IS NOT NULL AND lines IS NOT NULL").dropDuplicates(["doc_id", "draft_no"])
    cells = once.select("doc_id", "draft_no", F.posexplode("lines").alias("k", "x")).select("doc_id", "draft_no", "k", F.col("x.page").alias("page"), F.coalesce("x.text", F.lit("")).alias("text"))
    flagged = cells.join(gone.withColumn("f", F.lit(True)), (cells["doc_id"] == gone["doc_id"]) & (cells["page"] == gone["page"]) & (F.trim(cells["text"]) == gone["t"]), "left").select(cells["doc_id"], "draft_no", "k", "text", F.coalesce("f", F.lit(False)).alias("f"))
    entries = flagged.groupBy("doc_id", "draft_no").agg(F.array_sort(F.collect_list(F.struct("k", "text", "f"))).alias("c"))
    made = entries.select(
        F.lit("reference_drafts").alias("src"), "doc_id", F.col("draft_no").alias("item_no"), F.transform("c", lambda x: x["text"]).alias("lines"),
        F.transform(F.filter("c", lambda x: x["f"]), lambda x: x["k"]).alias("furniture"), F.lit(None).cast("string").alias("follow"),
    )
    # Numbers that Spark gives are fixed once they are written.
    items = kept(out.unionByName(made).select(F.monotonically_increasing_id().alias("no"), "*"))
    dropped(marked)
    return items


FOUND = "src string, doc_id string, item_no int, line_no int, kind string, repaired string"


def _decoded(pages: DataFrame, drafts: DataFrame, papers: DataFrame, common: int, schema: str, rows_of) -> DataFrame:
    spark = pages.sparkSession
    words = lexicon(clean_texts(papers))
    top = [(r.word, r.n, r.skel) for r in words.orderBy(F.desc("n"), "word").limit(common).collect()]
    second = F.col("word").startswith("-")
    total = words.agg(F.sum(F.when(~second, F.col("n"))), F.sum(F.when(second, F.col("n")))).first()
    shared = spark.sparkContext.broadcast((top, total[0] or 1, total[1] or 1))
    items = _items(pages, drafts)

    # Words beyond the common ones are no more frequent than the last of those.
    cuts = bool(top) and top[-1][1] >= PART

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {w for w, _, _ in shared.value[0]}
        for b in batches:
            rows = []
            for no, lines, follow in zip(b["no"], b["lines"], b["follow"]):
                need = unknown_pieces([*lines, follow or ""], known, cuts)
                ends = [x for x in (*lines, follow or "") if x.strip()]
                for x, y in zip(ends, ends[1:]):
                    if HYPHEN.search(x):
                        h, t = re.search(r"[^\W\d_]+$", HYPHEN.sub("", x)), re.match(r"\s*([^\W_]+)", y)
                        if h and t:
                            need.add(skeleton(h[0] + t[1]))
                rows += [(no, k) for k in need]
            yield pd.DataFrame(rows, columns=["no", "skel"])

    # Words beyond the common ones, for the pages that may need them.
    if len(top) >= common:
        asked = by_slices(items.select("no", "lines", "follow"), asks, "no bigint, skel string")
        more = asked.join(words, "skel").groupBy("no").agg(F.collect_list(F.struct("word", "n")).alias("more"))
        items = items.join(more, "no", "left")
    else:
        items = items.withColumn("more", F.lit(None).cast("array<struct<word:string,n:bigint>>"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(*shared.value)
        for b in batches:
            rows = []
            for s, d, i, lines, gone, follow, more in zip(b["src"], b["doc_id"], b["item_no"], b["lines"], b["furniture"], b["follow"], b["more"]):
                lex.page([(x["word"], x["n"], skeleton(x["word"])) for x in more] if more is not None else [])
                lines, marks = list(lines), set(gone)
                page = Page(lines, [k in marks for k in range(len(lines))], follow, lex)
                page.decode()
                rows += rows_of(s, d, i, page)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return by_slices(items.select("src", "doc_id", "item_no", "lines", "furniture", "follow", "more"), decode, schema)


def noise(pages: DataFrame, drafts: DataFrame, papers: DataFrame, common: int = 100_000) -> DataFrame:
    """Every line of furniture, every text line whose last word goes on, every text line with a misreading.

    Null texts, lines or keys give no lines; blank lines are no furniture.  Repeated rows of a page or an entry count
    once.  Works without a single clean paper too: then only forms of lines and numbers speak.
    """

    def rows(s: str, d: str, i: int, page: Page) -> list[tuple]:
        out = [(s, d, i, k, "furniture", None) for k, f in enumerate(page.furniture) if f and page.lines[k].strip()]
        out += [(s, d, i, k, "broken", page.repaired.get(k)) for k in sorted(page.broken)]
        return out + [(s, d, i, k, "misread", page.repaired.get(k)) for k in sorted(page.misread)]

    return _decoded(pages, drafts, papers, common, FOUND, rows)


def paragraphs(pages: DataFrame, drafts: DataFrame, papers: DataFrame, common: int = 100_000) -> DataFrame:
    """src, doc_id, item_no, para_no, text: continuous repaired paragraphs of every document and bibliography entry.

    A paragraph that runs over pages is one, under the page on which it begins.
    """

    def rows(s: str, d: str, i: int, page: Page) -> list[tuple]:
        made, on = page.paragraphs(), page.runs_on()
        if made and on is not None:
            made[-1] = (HYPHEN.sub("", made[-1]) if on != " " else made[-1]) + on
        return [(s, d, i, k, t, on is not None and k == len(made) - 1) for k, t in enumerate(made)]

    parts = _decoded(pages, drafts, papers, common, "src string, doc_id string, item_no int, para_no int, text string, runs_on boolean", rows)
    order = Window.partitionBy("src", "doc_id").orderBy("item_no", "para_no")
    starts = ~(F.lag("runs_on", 1, False).over(order) & (F.lag("item_no").over(order) == F.col("item_no") - 1))
    numbered = parts.withColumn("starts", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("n", F.sum("starts").over(order))
    whole = numbered.groupBy("src", "doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("item_no", "para_no", "text"))).alias("c"))
    whole = whole.select("src", "doc_id", "n", F.col("c")[0]["item_no"].alias("item_no"), F.array_join(F.transform("c", lambda x: x["text"]), "").alias("text"))
    place = F.row_number().over(Window.partitionBy("src", "doc_id", "item_no").orderBy("n")) - 1
    return whole.select("src", "doc_id", "item_no", place.alias("para_no"), F.trim("text").alias("text"))
