"""Languages of documents and of the stretches of mixed ones, by cross-parsing entropy.

For each language a suffix automaton over labelled text finds, from any place of a sentence, the longest match with that
text; the sentence is parsed greedily into such phrases, and the language that needs the fewest for its letters wins.
Neighbouring sentences are decided together: a change of language must save at least SWITCH phrases.

The automata are fitted on a bounded sample of labelled documents (SAMPLE documents of at most LONGEST characters and
CHARS different characters of text for each language). Labels may be wrong: only
sentences stay whose words, for the number of documents, occur most under their own label. Everything else covers whole documents.

Null and blank texts, and texts without a letter of a known script, have no language and give no rows. Of languages that
need equally many phrases the first in LANGUAGES wins. A table without labelled text gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivaq.llm import pieces as P
from rivaq.session import shipped, spread

LANGUAGES = ("tr", "en", "ar", "de", "fr", "id", "az", "fa")
SAMPLE, LONGEST, CHARS, SWITCH = 400, 4000, 24_000, 3.0
#: Rounds of cleaning the sample, and the share of a sentence's word pairs that must be new for it to be learnt.
CLEAN, FRESH = 2, 0.4

# How labels name the languages besides the two-letter code.
NAMES = {
    "tr": "tur türkçe turkce turkish türkisch turc türk",
    "en": "eng english ingilizce englisch anglais",
    "ar": "ara arb arabic arapça arapca العربية عربي arabisch arabe",
    "de": "deu ger german almanca deutsch allemand",
    "fr": "fra fre french fransızca fransizca français francais französisch",
    "id": "ind in indonesian endonezce bahasa indonesia indonesisch indonésien",
    "az": "aze azj azb azerbaijani azerice azeri azərbaycanca azərbaycan aserbaidschanisch",
    "fa": "fas per pes prs persian farsi farsça farsca فارسی persisch persan",
}
_ARABIC = re.compile(r"[ء-يٮ-ۓ]+")
_LATIN = re.compile(r"[a-zɐ-ʯœæøßđłŋ]+")
_NOISE = re.compile(r"https?://\S+|\[\d+\]|[0-9٠-٩۰-۹]+")
_OTHER = re.compile(r"[^\w]+|_+")
_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0xFFFF)) if unicodedata.combining(c)) + "]+")
_MARK = re.compile(r"\s*\[\d+\]")


def label_code(lang: Column) -> Column:
    """The two-letter code a label means, or null: code, code with region, three-letter code or name."""
    low = F.lower(F.translate(F.btrim(lang), "İI", "ii"))
    head = F.regexp_extract(low, r"^([\p{L}]+)", 1)
    out = F.when(head.isin(*LANGUAGES) & low.rlike(r"^[a-z]{2}([-_].*)?$"), head)
    for code, names in NAMES.items():
        out = out.when(head.isin(*names.replace("ı", "i").split(), *names.split()), F.lit(code))
    return out


def folded(text: str) -> str:
    """Small letters without accents, everything between words one blank."""
    low = _NOISE.sub(" ", text.replace("İ", "i").lower())
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFD", low.replace("ı", "i")))
    return f" {_OTHER.sub(' ', low).strip()} "


#: A letter that no text here has: stands between sentences folded together. Characters folded at once, documents decided at once.
_BETWEEN, AT_ONCE, DOCUMENTS = "\U00013000", 1_000_000, 1000


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point of the first planes: 0 between words, 1 a letter or digit, 2 a mark that folding drops; the last entry is for those beyond."""
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    kind = np.zeros(0x20001, np.uint8)
    kind[[ord(c) for c in re.findall(r"[^\W_]", "".join(map(chr, points)))]] = 1
    kind[[ord(c) for c in map(chr, range(0x300, 0xFFFF)) if unicodedata.combining(c)]] = 2
    kind[-1] = 1
    return kind


def folded_all(texts: list[str]) -> list[str]:
    """folded() of each text, many at once: code points are looked up in a table instead of being searched sentence by sentence."""
    out: list[str] = []
    for a, b in _spans(np.array([len(t) for t in texts], np.int64), AT_ONCE):
        low = _NOISE.sub(" ", f"\n{_BETWEEN}\n".join(texts[a:b]).replace("İ", "i").lower())
        if not low.isascii():
            low = unicodedata.normalize("NFD", low.replace("ı", "i"))
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[np.minimum(points, 0x20000)]
        points = np.where(kind == 1, points, np.uint32(32))[kind != 2]
        blank = points == 32
        points = points[~(blank & np.r_[True, blank[:-1]])]
        done = points.tobytes().decode("utf-32-le").split(_BETWEEN)
        out += [f" {x.strip()} " for x in done] if len(done) == b - a else map(folded, texts[a:b])
    return out


def arabic(text: str) -> bool | None:
    """Whether most letters are Arabic; null for a text without letters of a known script."""
    a = 0 if text.isascii() else len("".join(_ARABIC.findall(text)))
    b = len("".join(_LATIN.findall(text)))
    return None if not a + b else a > b


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences; a reference mark belongs to the sentence before it."""
    out: list[tuple[int, int]] = []
    for a, b in P.sentences(text):
        while out and (m := _MARK.match(text, a)) and m.end() <= b:
            out[-1] = (out[-1][0], m.end())
            a = m.end()
            while a < b and text[a].isspace():
                a += 1
        if a < b:
            out.append((a, b))
    return out


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of text; state 0 is the root."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def _spans(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to about `most`."""
    done, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _by_script(texts: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the Arabic and of the Latin script in each folded text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    kind = np.zeros(int(points.max(initial=0)) + 1, np.int8)
    for c in np.flatnonzero(np.bincount(points)) if len(points) else ():
        kind[c] = 1 if _ARABIC.match(chr(c)) else 2 if _LATIN.match(chr(c)) else 0
    row, own = np.repeat(np.arange(len(texts)), size), kind[points]
    return np.bincount(row[own == 1], minlength=len(texts)), np.bincount(row[own == 2], minlength=len(texts))


class Parser:
    """Greedy parsing by one automaton as a table: for state and letter the next state, and whether a phrase began."""

    def __init__(self, text: str):
        step = automaton(text)
        letters = sorted(step[0])
        self.letter = {c: i + 1 for i, c in enumerate(letters)}
        self.width = len(letters) + 1
        root = np.zeros(self.width, np.int64)
        for c, s in step[0].items():
            root[self.letter[c]] = s
        table = np.tile((root * self.width) << 1 | 1, (len(step), 1))
        for s, row in enumerate(step):
            for c, t in row.items():
                table[s, self.letter[c]] = (t * self.width) << 1
        table[0] |= 1
        self.table = table.astype(np.int32).ravel()

    @classmethod
    def of(cls, letter: dict[str, int], width: int, table: np.ndarray) -> Parser:
        self = cls.__new__(cls)
        self.letter, self.width, self.table = letter, width, table
        return self

    def phrases(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """codes: a column for each text, longest first; letters as given by `letter`."""
        state, count = np.zeros(codes.shape[1], np.int32), np.zeros(codes.shape[1], np.int32)
        live = np.searchsorted(-lengths, -np.arange(codes.shape[0]), side="left")
        for t in range(codes.shape[0]):
            n = live[t]
            v = self.table[state[:n] + codes[t, :n]]
            count[:n] += v & 1
            state[:n] = v >> 1
        return count


class Model:
    """A parser for each language, and which of them read Arabic script."""

    def __init__(self, texts: dict[str, str]):
        self._set({k: Parser(v) for k, v in texts.items() if v.strip()}, {k: bool(arabic(v)) for k, v in texts.items()})

    def state(self) -> tuple[dict, dict]:
        """Plain data, for a broadcast."""
        return {k: (p.letter, p.width, p.table) for k, p in self.parser.items()}, self.right

    @classmethod
    def of(cls, parsers: dict, right: dict) -> Model:
        self = cls.__new__(cls)
        self._set({k: Parser.of(*v) for k, v in parsers.items()}, right)
        return self

    def _set(self, parser: dict[str, Parser], right: dict[str, bool]) -> None:
        self.parser, self.right = parser, right
        size = {k: np.log2(len(p.table) / p.width + 1) for k, p in self.parser.items()}
        #: A phrase points into the text: in a larger one it needs more bits.
        self.bits = {k: v / (sum(size.values()) / len(size)) for k, v in size.items()}
        self.order = [k for k in LANGUAGES if k in self.parser] + sorted(set(self.parser) - set(LANGUAGES))

    def costs(self, texts: list[str]) -> np.ndarray:
        """Phrases each language needs for each folded text; infinite for languages of another script."""
        out = np.full((len(texts), len(self.order)), np.inf)
        every = np.array([len(t) for t in texts], np.int64)
        letters = [_by_script(texts[a:b], every[a:b]) for a, b in _spans(every, AT_ONCE)]
        right, left = (np.concatenate([x[i] for x in letters]) if letters else np.zeros(0, np.int64) for i in (0, 1))
        for script in (False, True):
            mine = np.flatnonzero((right + left > 0) & ((right > left) == script))
            if len(mine):
                size = every[mine]
                order = np.argsort(-size, kind="stable")
                mine, size, a = mine[order], size[order], 0
                while a < len(mine):
                    b = min(len(mine), a + max(1, 2_000_000 // int(size[a])))
                    self._some(texts, mine[a:b], size[a:b], script, out)
                    a = b
        return out

    def _some(self, texts: list[str], rows: np.ndarray, size: np.ndarray, script: bool, out: np.ndarray) -> None:
        joined = np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le"), np.uint32)
        points = np.flatnonzero(np.bincount(joined))
        place = np.zeros(int(points[-1]) + 1, np.int16)
        place[points] = np.arange(len(points))
        at = place[joined]
        matrix = np.zeros((int(size[0]), len(rows)), np.int16)
        column = np.repeat(np.arange(len(rows)), size)
        start = np.repeat(np.cumsum(size) - size, size)
        matrix[np.arange(len(joined)) - start, column] = at
        for j, k in enumerate(self.order):
            if self.right[k] is script:
                p = self.parser[k]
                local = np.array([p.letter.get(chr(c), 0) for c in points], np.int16)
                out[rows, j] = p.phrases(local[matrix], size) * self.bits[k]

    def decide(self, costs: np.ndarray, switch: float = SWITCH) -> list[int]:
        """The language of each sentence of one document: least phrases plus `switch` for each change; -1 for sentences without letters."""
        known = np.flatnonzero(np.isfinite(costs).any(axis=1))
        if not len(known):
            return [-1] * len(costs)
        best, back = np.zeros(costs.shape[1]), []
        for i in known:
            stay = best.min() + switch
            back.append(np.where(best <= stay, np.arange(len(best)), best.argmin()))
            best = np.minimum(best, stay) + costs[i]
        at, found = int(best.argmin()), [-1] * len(costs)
        for i, b in zip(known[::-1], back[::-1], strict=True):
            found[i] = at
            at = int(b[at])
        for i in range(len(found)):
            if found[i] < 0:
                found[i] = found[i - 1] if i and found[i - 1] >= 0 else found[known[0]]
        return found


def _learn(pairs: list[tuple[str, str]], chars: int) -> Model:
    """pairs: language and folded sentence. Up to chars for each language, of sentences with enough word pairs not seen before."""
    texts: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    seen: dict[str, set] = {}
    for k, s in dict.fromkeys(pairs):
        words = s.split()
        own = set(zip([""] + words, words + [""], strict=True))
        if size.get(k, 0) < chars and len(own - seen.setdefault(k, set())) >= FRESH * len(own):
            seen[k] |= own
            texts.setdefault(k, []).append(s)
            size[k] = size.get(k, 0) + len(s)
    return Model({k: "".join(v) for k, v in texts.items()})


def fitted(documents: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, chars: int = CHARS) -> Model:
    """Automata of the languages that labelled documents have; the sample collected is bounded by its parameters."""
    rows = documents.select("doc_id", "text", label_code(F.col("lang")).alias("kod"), F.xxhash64("doc_id").alias("h")).where(f"kod IS NOT NULL AND text IS NOT NULL AND length(text) <= {longest}")
    share = {r.kod: min(1.0, 2.0 * sample / r.n) for r in rows.groupBy("kod").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model({})
    limit = F.element_at(F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int((v - 0.5) * (2**64 - 2)) if v < 1 else 2**63 - 1))]), F.col("kod"))
    taken = sorted(rows.where(F.col("h") <= limit).select("kod", "h", "text").collect(), key=lambda r: (r.kod, r.h))
    docs, count = [], {}
    for r in taken:
        n = count[r.kod] = count.get(r.kod, 0) + 1
        if n <= sample:
            docs.append((r.kod, [folded(r.text[a:b]) for a, b in sentences(r.text)]))
    for _ in range(CLEAN):
        docs = _agreed(docs)
    return _learn([(k, s) for k, texts in docs for s in texts], chars)


def _agreed(docs: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """The documents' sentences whose words occur, for their number of documents, most under the documents' own label."""
    size: dict[str, int] = {}
    seen: dict[str, dict[str, int]] = {}
    for k, texts in docs:
        size[k] = size.get(k, 0) + 1
        for w in {w for s in texts for w in s.split()}:
            mine = seen.setdefault(w, {})
            mine[k] = mine.get(k, 0) + 1
    share = {}
    for w, mine in seen.items():
        if sum(mine.values()) > 1:
            rate = {k: n / size[k] for k, n in mine.items()}
            share[w] = {k: x / sum(rate.values()) for k, x in rate.items()}
    out = []
    for k, texts in docs:
        kept = []
        for s in texts:
            votes: dict[str, float] = {}
            for w in s.split():
                for lang, x in share.get(w, {}).items():
                    votes[lang] = votes.get(lang, 0.0) + x
            if votes and max(votes, key=lambda x: (votes[x], x == k)) == k:
                kept.append(s)
        if kept:
            out.append((k, kept))
    return out


def assigned(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, etiket (code its label means, or null), ana (main language), guven, parca_sayisi, sira, konum, lang, parca_guven: a row for each stretch of consecutive sentences in one language; confidence is the share of phrases saved against the next best language."""
    shipped(documents.sparkSession)
    model = model or fitted(documents)
    held = documents.sparkSession.sparkContext.broadcast(model.state())

    def certainty(costs: np.ndarray, j: int) -> float:
        rest = np.delete(costs, j)
        second = rest.min() if len(rest) else np.inf
        return float(np.clip(1 - costs[j] / second, 0, 1)) if np.isfinite(second) and second > 0 else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model.of(*held.value)
        for whole in batches:
            for at in range(0, len(whole), DOCUMENTS):
                batch, out = whole.iloc[at : at + DOCUMENTS], []
                spans = [sentences(text) for text in batch.text]
                texts = folded_all([text[a:b] for text, own in zip(batch.text, spans, strict=True) for a, b in own])
                if not m.order or not texts:
                    continue
                costs, size = m.costs(texts), np.array([len(t) for t in texts], dtype=float)
                count = np.array([len(own) for own in spans])
                docs = np.flatnonzero(count)
                start = (np.cumsum(count) - count)[docs]
                known, best = np.isfinite(costs).any(axis=1), costs.argmin(axis=1)
                low = np.minimum.reduceat(np.where(known, best, len(m.order)), start)
                high = np.maximum.reduceat(np.where(known, best, -1), start)
                total = np.add.reduceat(np.where(known[:, None], costs, 0.0), start, axis=0)
                ids, labels = batch.doc_id.to_numpy(), batch.etiket.to_numpy()
                for n, doc in enumerate(docs.tolist()):
                    if high[n] < 0:
                        continue
                    if low[n] == high[n]:  # one language is the best for every sentence
                        j = int(low[n])
                        sure = certainty(total[n], j)
                        out.append((ids[doc], labels[doc], m.order[j], sure, 1, 0, 0, m.order[j], sure))
                        continue
                    mine, a = spans[doc], int(start[n])
                    own, weights = costs[a : a + len(mine)], size[a : a + len(mine)]
                    langs = m.decide(own)
                    main = int(np.bincount(langs, weights=weights, minlength=len(m.order)).argmax())
                    inside = (np.array(langs) == main) & known[a : a + len(mine)]
                    sure = certainty(own[inside].sum(axis=0), main)
                    first, k, many = 0, 0, 1 + int(np.count_nonzero(np.diff(langs)))
                    while first < len(langs):
                        last = first
                        while last < len(langs) and langs[last] == langs[first]:
                            last += 1
                        part = own[first:last][known[a + first : a + last]]
                        out.append((ids[doc], labels[doc], m.order[main], sure, many, k, mine[first][0] if k else 0, m.order[langs[first]], certainty(part.sum(axis=0), langs[first]) if len(part) else 0.0))
                        first, k = last, k + 1
                yield pd.DataFrame(out, columns=["doc_id", "etiket", "ana", "guven", "parca_sayisi", "sira", "konum", "lang", "parca_guven"])

    rows = documents.select("doc_id", "text", label_code(F.col("lang")).alias("etiket")).where(r"text RLIKE '\\S'")
    return spread(rows).mapInPandas(run, "doc_id long, etiket string, ana string, guven double, parca_sayisi int, sira int, konum int, lang string, parca_guven double")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, konum, lang): the stretches of documents whose label is missing or wrong, or whose text changes language."""
    return assigned(documents).where("parca_sayisi > 1 OR etiket IS NULL OR etiket <> ana").select("doc_id", "konum", "lang")
