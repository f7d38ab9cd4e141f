"""Oversized texts cut into pieces at natural boundaries: structure-tree packing.

A text is parsed into a tree of sections (a heading and what follows it, down to the next of its level), elements of
markup, blocks (paragraphs and lists), list items with the items below them, lines and sentences. Sibling subtrees are merged bottom-up while they fit, only oversized nodes are opened, and a sentence that is
itself oversized is cut after clauses, else at blanks, else between characters. Each piece but the first begins with up
to `overlap` characters of the one before, from a word's start. No piece is longer than `limit`.

Offsets and lengths are code points of the stored value. A value that fits once blanks at its ends are away gives no
rows; so do null and empty values. Rows delivered twice count once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivaq.llm import normalize as N
from rivaq.session import shipped

LIMIT, OVERLAP = 800, 80
#: Characters looked at before a full stop: more than any abbreviation or line number has. Levels of the tree; what is deeper counts as siblings.
LOOK, LEVELS = 24, 64

# Abbreviations that a capital or a number follows within a sentence.
BEFORE_NAMES = frozenset("dr prof doç av sn hz bay mr mrs ms st sr fr hr mme mlle m op alb gen kpt ing dipl no nr num vol vols p pp c s sf ss cf bkz bk krş bd hd fig şek md art par böl ch sec ed eds haz çev nu a.g.e der".split())
# Abbreviations that may also end a sentence.
BEFORE_ANY = frozenset("etc vb vs vd usw bzw ca jr inc ltd a.ş a.s m.ö m.s mö ms i.e e.g z.b d.h p.m a.m yy".split())
ENDS, CLOSERS, OPENERS = ".?!…。؟۔．！？", "»”\"'’)]}›“」）］", "«“\"'‘‹([{„-–—•*「（［»¿¡"
_END = re.compile(rf"([{re.escape(ENDS)}]+)(?:[{re.escape(CLOSERS)}]|</[A-Za-z][^<>]*>)*")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*>")
_ITEM = re.compile(r"(?:[-–—•*+]|\d{1,4}[.)]|[a-zçğıöşü][.)])\s+")
# Elements of markup that hold blocks or are blocks.
ELEMENTS = frozenset("article aside blockquote body dd div dl dt figure footer h1 h2 h3 h4 h5 h6 header html li main ol p pre section table tbody td th thead tr ul".split())
_LINE = re.compile(r"[^\n\r\v\f\x85\u2028\u2029]+")
_LIKE = {ord(c): k for c, k in zip(N.CYRILLIC + N.GREEK, N.CYRILLIC_AS + N.GREEK_AS, strict=True)}


def _token(text: str, at: int, start: int) -> str:
    """The word before at, as it is meant: no brackets, look-alikes or invisible characters."""
    i = at
    while i > start and not text[i - 1].isspace() and at - i < LOOK:
        i -= 1
    w = text[i:at]
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKC", w).translate(_LIKE) if unicodedata.category(c) != "Cf")
    return w.lstrip(OPENERS + ".")


def _stop_end(text: str, m: re.Match, start: int, end: int) -> int:
    """Where the stop m ends: a quotation mark right before a letter opens what follows, unless one is open."""
    i = m.end()
    if i < end and i - 1 >= m.end(1) and text[i].isalnum():
        mark = text[i - 1]
        if mark == "“" and text.count("„", start, i) <= text.count("“", start, i - 1) or mark in "\"'" and text.count(mark, start, i - 1) % 2 == 0:
            return i - 1
    return i


def _breaks(text: str, m: re.Match, at: int, start: int, end: int) -> bool:
    """Whether a sentence ends with the stop m, which ends at `at`, of the line text[start:end]."""
    i = at
    while i < end and (text[i].isspace() or unicodedata.category(text[i]) == "Cf"):
        i += 1
    if i >= end:
        return False
    blank, j = i > at, i
    while j < end and (text[j] in OPENERS or text[j].isspace() or text[j] == "<"):
        tag = _TAG.match(text, j, end) if text[j] == "<" else None
        if text[j] == "<" and not tag:
            break
        j = tag.end() if tag else j + 1
    if j >= end or not (text[j].isalnum() or unicodedata.category(text[j])[0] == "S"):
        return False
    if text[j].islower() and j == i:
        return False
    stop = m.group(1)
    w = _token(text, m.start(), start)
    if not blank and j == i and stop in (".", "．"):
        word = text[j].isupper() and text[j + 1 : j + 2].islower()
        if text[j].isdigit() or not (word and w.isdigit()) and (len(w) < 2 or not w[-1].isalpha() and w[-1] not in CLOSERS or w[-1].isupper()):
            return False
    if text[j].islower():
        return blank and text[i] not in "([{（［-–—"
    if stop in (".", "．"):
        if len(w) == 1 and w.isalpha() and (w.isupper() or w.lower() in BEFORE_NAMES):
            return False
        if w.lower() in BEFORE_NAMES or w.lower() in BEFORE_ANY and not text[j].isupper():
            return False
        if w.isdigit() and m.start() - start <= LOOK and text[start : m.start()].strip(" \t" + OPENERS) == w:
            return False
    return True


def line_spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each line that is not blank, without the blanks at its ends."""
    for m in _LINE.finditer(text):
        line = m.group()
        a = len(line) - len(line.lstrip())
        if line.strip():
            yield m.start() + a, m.start() + len(line.rstrip())


def sentence_spans(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence of one line."""
    at = start
    for m in _END.finditer(text, start, end):
        stop = _stop_end(text, m, start, end)
        if m.start() >= at and _breaks(text, m, stop, start, end):
            yield at, stop
            at = stop
            while at < end and text[at].isspace():
                at += 1
    if at < end:
        yield at, end


def sentences(text: str) -> list[tuple[int, int]]:
    return [s for a, b in line_spans(text) for s in sentence_spans(text, a, b)]


def oversized(text: str | None, limit: int = LIMIT) -> bool:
    return text is not None and len(text) > limit and len(text.strip()) > limit


def _level(line: str, more: bool) -> int:
    """Of a heading its level, 1 the highest; 0 for other lines. A short line without end of a sentence, before another line, is one of the lowest level."""
    marked = re.match(r"(#{1,6})\s|<[hH]([1-6])\b", line)
    if marked:
        return len(marked[1]) if marked[1] else int(marked[2])
    return 7 if more and (line[0] == "#" or len(line) <= 60 and line[0] not in "-–—•*<" and line[-1] not in ENDS + CLOSERS + ",;:>") else 0


def leaves(text: str) -> Iterator[tuple[tuple[int, ...], tuple[int, int]]]:
    """Each sentence with its path in the tree: a number for each section, element, block, item and line it is in."""
    lines = list(line_spans(text))
    sections: list[tuple[int, int]] = []
    elements: list[tuple[str, int]] = []
    items: list[tuple[int, int]] = []
    block, end = 0, 0
    for n, (a, b) in enumerate(lines, 1):
        gap = n == 1 or text.count("\n", end, a) > 1
        level, begin = _level(text[a:b], n < len(lines)), text.rfind("\n", 0, a) + 1
        if level:
            while sections and sections[-1][0] >= level:
                sections.pop()
            sections.append((level, n))
        if gap or level:
            block = n
        indent = a - begin
        if level or gap and not (items and indent > items[-1][0]):
            items.clear()
        if _ITEM.match(text, a, b):
            while items and items[-1][0] >= indent:
                items.pop()
            items.append((indent, n))
        at = end = a
        for x, y in sentence_spans(text, a, b):
            inner = None
            for tag in _TAG.finditer(text, at, y):
                if tag.start() > x and inner is None and text[x : tag.start()].strip() and not _TAG.match(text, x):
                    inner = tuple(k for _, k in elements)
                name = tag[2].lower()
                if name in ELEMENTS and not tag[1]:
                    elements.append((name, tag.start() + len(text)))  # numbers of elements and lines differ
                elif tag[1] and any(e == name for e, _ in elements):
                    if inner is None:
                        inner = tuple(k for _, k in elements)
                    while elements.pop()[0] != name:
                        pass
            path = (*(k for _, k in sections), *(tuple(k for _, k in elements) if inner is None else inner), -block, *(k for _, k in items), n)
            yield path[:LEVELS], (x, y)
            at = y
        end = b


def _nested(rows: list, depth: int = 0) -> list:
    out: list = []
    for key, own in groupby(rows, lambda r: r[0][depth] if depth < len(r[0]) else None):
        out.extend([leaf for _, leaf in own] if key is None else [_nested(list(own), depth + 1)])
    return out


def tree(text: str) -> list:
    """Nested lists; the leaves are the sentences' (start, end)."""
    return _nested(list(leaves(text)))


def _span(node) -> tuple[int, int]:
    a = b = node
    while isinstance(a, list):
        a = a[0]
    while isinstance(b, list):
        b = b[-1]
    return a[0], b[1]


def _cut(text: str, a: int, b: int, limit: int) -> Iterator[tuple[int, int]]:
    """An oversized sentence: after a clause in the second half, else at a blank, else between characters."""
    while b - a > limit:
        window = text[a : a + limit]
        at = max((m.end() for m in re.finditer(r"[,;:،؛](?=\s)", window) if m.end() * 2 > limit), default=0)
        at = at or max((m.end() for m in re.finditer(r"\s", window) if m.end() * 2 > limit), default=0) or limit
        while at > 1 and unicodedata.combining(text[a + at]):
            at -= 1
        yield a, a + at
        a += at
        while a < b and text[a].isspace():
            a += 1
    if a < b:
        yield a, b


def packed(text: str, node, limit: int) -> list[tuple[int, int]]:
    """Spans of at most limit that cover the node: siblings merged while they fit, oversized ones opened."""
    a, b = _span(node)
    if b - a <= limit:
        return [(a, b)]
    if not isinstance(node, list):
        return list(_cut(text, a, b, limit))
    out: list[tuple[int, int]] = []
    for child in node:
        for x, y in packed(text, child, limit):
            if out and y - out[-1][0] <= limit:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of at most limit; each but the first goes up to overlap into the one before."""
    if not text.strip():
        return []
    spans, out = packed(text, tree(text), limit - overlap), []
    for n, (a, b) in enumerate(spans):
        if n and overlap:
            low = max(spans[n - 1][0], spans[n - 1][1] - overlap, b - limit)
            starts = [m.start() for m in re.finditer(r"(?<=\s)\S", text[low - 1 : spans[n - 1][1]] if low else text[: spans[n - 1][1]])]
            a = (low - 1 if low else 0) + starts[0] if starts else a
        out.append((a, b))
    return out


def _values(df: DataFrame, key: str, columns: list[str], limit: int) -> DataFrame:
    """key, alan, metin of each value that may be oversized, once."""
    rows = df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(c).alias("alan"), F.when(F.length(c) > limit, F.col(c)).alias("metin")) for c in columns])).alias("v"))
    return rows.where("v.metin IS NOT NULL").select(F.col(key).cast("string").alias("anahtar"), "v.alan", "v.metin").where(F.length(F.btrim("metin")) > limit).dropDuplicates(["anahtar", "alan"])


def cut(df: DataFrame, key: str, columns: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, alan, sira (from 0), bas, son, parca: the pieces of each oversized value; and cumleler: where sentences start that begin in the piece's own part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, c, text in zip(batch.anahtar, batch.alan, batch.metin, strict=True):
                if oversized(text, limit):
                    starts, done = [a for a, _ in sentences(text)], 0
                    for n, (a, b) in enumerate(pieces(text, limit, overlap)):
                        to = bisect_left(starts, b, done)
                        out.append((k, c, n, a, b, text[a:b], starts[done:to]))
                        done = to
            yield pd.DataFrame(out, columns=["anahtar", "alan", "sira", "bas", "son", "parca", "cumleler"])

    shipped(df.sparkSession)
    out = _values(df, key, columns, limit).mapInPandas(run, "anahtar string, alan string, sira int, bas int, son int, parca string, cumleler array<int>")
    return out.withColumnRenamed("anahtar", key)


def coverage(df: DataFrame, key: str, columns: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, alan, bas, son (what the pieces of a value span), sigar (whether none is longer than limit), bitisik (whether only blanks lie between neighbours, and no more than overlap is shared)."""
    rows = cut(df, key, columns, limit, overlap).groupBy(key, "alan").agg(F.min("bas").alias("bas"), F.max("son").alias("son"), F.max(F.length("parca")).alias("uzun"), F.array_sort(F.collect_list(F.struct("sira", "bas", "son"))).alias("p"))
    step = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda x, y: (y["sira"] == x["sira"] + 1) & (y["bas"] > x["bas"]) & (x["son"] - y["bas"] <= overlap) & (y["son"] > x["son"]))
    text = df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(c).alias("alan"), F.col(c).alias("metin")) for c in columns])).alias("v")).select(F.col(key).cast("string").alias(key), "v.alan", "v.metin").where(F.length("metin") > limit).dropDuplicates([key, "alan"])
    gaps = F.forall(F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda x, y: F.substring("metin", x["son"] + 1, F.greatest(F.lit(0), y["bas"] - x["son"])).rlike(r"^[\s\p{Z}\x85]*$")), lambda b: b)
    return rows.join(text, [key, "alan"]).select(key, "alan", "bas", "son", (F.col("uzun") <= limit).alias("sigar"), (F.forall(step, lambda b: b) & gaps).alias("bitisik"))


def found(corpus: DataFrame) -> DataFrame:
    """(id, alan, konum): where each sentence of each oversized value of tr and en starts."""
    return cut(corpus, "id", ["tr", "en"]).select("id", "alan", F.explode("cumleler").alias("konum"))
