"""Visually identical text with different characters, brought to one form by DuckDB inside Arrow partitions.

The form: marks composed and in canonical order (NFC), no dot above a letter that has one, plain blanks, nothing
invisible, letters and digits of ordinary width and shape, Arabic words in the Arabic alphabet, one script per word (an apostrophe is within a word).
A word that mixes scripts takes its Latin form, unless letters without a Latin look-alike and more letters than Latin ones speak for another script.

Null stays null, the empty text stays empty, texts of any length are taken whole. Vowel signs, brackets, symbols,
runs of blanks, line breaks and words wholly in another script stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rivaq.session import shipped, spread

# Letters of other scripts that look like Latin ones, capital and small, in the order of the alphabets.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјкмнорстухԁԛԝһӏгп"
CYRILLIC_AS = "ABESIJKMHOPCTYXaesijkmhopctyxdqwhlrn"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαβεικνορτυχηγωϲ"
GREEK_AS = "ABEZHIKMNOPTYXabeikvoptuxnywc"
# Letters of scripts that do not occur as words here, and the Latin letters they look like.
RARE = "օոսհցզքՕՍՏԼᎠᎡᎢᎪᏴᏟᎬᏀᎻᎫᏦᏞᎷᏢᏚᏙᏔᏃ"
RARE_AS = "onuhgqfOUSLDRTABCEGHJKLMPSVWZ"
# Letters of other Arabic-script alphabets and the letters of the Arabic alphabet written for them.
ARABIC = {
    "ٱ": "ا", "ک": "ك", "ڪ": "ك", "ګ": "ك", "گ": "ك", "ڭ": "ك", "ی": "ي", "ې": "ي", "ے": "ي", "ێ": "ي", "ۍ": "ي",
    "ہ": "ه", "ھ": "ه", "ە": "ه", "ۀ": "ه", "ۂ": "ه", "ۃ": "ة", "پ": "ب", "ٮ": "ب", "چ": "ج", "ژ": "ز", "ڤ": "ف",
    "ٯ": "ق", "ں": "ن", "ڼ": "ن", "ټ": "ت", "ډ": "د", "ړ": "ر", "ښ": "س", "ۆ": "و", "ۇ": "و", "ۈ": "و", "ۊ": "و", "ۋ": "و",
}
ARABIC_OTHER, ARABIC_AS = "".join(ARABIC), "".join(ARABIC.values())
# What does not show, and blanks that are not the plain one.
INVISIBLE = r"\x{AD}\x{34F}\x{61C}\x{640}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{E0000}-\x{E0FFF}"
BLANKS = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
# Ranges whose compatibility forms are letters or digits of another width or shape.
SHAPES = ((0xFF01, 0xFF5E), (0xFF61, 0xFFDC), (0xFB00, 0xFB1C), (0xFB50, 0xFBB1), (0xFBD3, 0xFD3D), (0xFD50, 0xFDFB), (0xFE70, 0xFEFC), (0x1D400, 0x1D7FF), (0xB2, 0xB3), (0xB9, 0xB9), (0x2070, 0x2079), (0x207F, 0x2089), (0x2460, 0x2468), (0x24B6, 0x24E9))
# Characters of texts that need no closer look; Arabic-script letters outside the alphabet; scripts that no word mixes.
USUAL = r"\x{9}\x{A}\x{D}\x{20}-\x{7E}«»À-žЀ-ӿ\x{621}-\x{63A}\x{641}-\x{652}\x{660}-\x{669}،؛؟\x{2010}-\x{2027}\x{FD3E}\x{FD3F}"
FOREIGN = r"\x{620}\x{63B}-\x{63F}\x{66E}\x{66F}\x{671}-\x{6D3}\x{6D5}\x{6EE}\x{6EF}\x{6FA}-\x{6FC}\x{6FF}\x{750}-\x{77F}\x{870}-\x{887}\x{889}-\x{88E}\x{8A0}-\x{8C9}"
SCRIPTS = [r"[\p{Latin}]", r"[\p{Cyrillic}]", r"[\p{Greek}]", r"[\p{Arabic}]", r"[\p{Hebrew}]", r"[\p{Armenian}]", r"[\p{Georgian}]", r"[\p{Devanagari}]", r"[\p{Syriac}]", r"[\p{Thaana}]", r"[\p{Ethiopic}]", r"[\p{Coptic}]", r"[\p{Cherokee}]", r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}]"]
#: Bytes of a partition given to DuckDB at once.
GATHERED = 16 << 20
MARKS = "̧̨̣̀́̂̃̄̆̇̈̊̋̌"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(1)
def maps() -> tuple[str, str, list[tuple[str, str]], str, str]:
    """Single forms and what they stand for, forms of several letters, look-alikes with their marks and what they stand for."""
    one, to, several = [], [], []
    for a, b in SHAPES:
        for c in map(chr, range(a, b + 1)):
            k = unicodedata.normalize("NFKC", c).lstrip(" ")
            if k != c and k and unicodedata.category(c) != "Cn":
                if len(k) == 1:
                    one.append(c), to.append(k)
                else:
                    several.append((c, k))
    like = _marked(dict(zip(CYRILLIC + GREEK + RARE, CYRILLIC_AS + GREEK_AS + RARE_AS, strict=True)))
    return "".join(one), "".join(to), several, "".join(like), "".join(like.values())


def _marked(like: dict[str, str]) -> dict[str, str]:
    """like, and the same letters with a mark."""
    both = dict(like)
    for c, k in like.items():
        for m in MARKS:
            x, y = (unicodedata.normalize("NFC", z + m) for z in (c, k))
            if len(x) == len(y) == 1:
                both[x] = y
    return both


@lru_cache(1)
def backwards() -> list[tuple[str, str, str, str]]:
    """For Cyrillic and Greek: a class of the script's letters, its look-alikes, and Latin letters and what they stand for in words of the script."""
    out = []
    for name, letters, latin in (("Cyrillic", CYRILLIC, CYRILLIC_AS), ("Greek", GREEK, GREEK_AS)):
        to = _marked({k: c for c, k in reversed(list(zip(letters, latin, strict=True)))})
        out.append((rf"\p{{{name}}}", "".join(_marked(dict(zip(letters, latin, strict=True)))), "".join(to), "".join(to.values())))
    return out


def form_sql(col: str) -> str:
    """The consistent form of a text column, as a DuckDB expression."""
    one, to, several, like, latin = maps()
    s = _shaped_sql(col, one, to, several)
    s = f"regexp_replace(regexp_replace({s}, '[{INVISIBLE}]', '', 'g'), '[{BLANKS}]', ' ', 'g')"
    s = f"translate({s}, {_quoted(ARABIC_OTHER)}, {_quoted(ARABIC_AS)})"
    s = rf"regexp_replace(nfc_normalize({s}), '[iı]\x{{307}}', 'i', 'g')"
    return s


def _shaped_sql(col: str, one: str, to: str, several: list[tuple[str, str]]) -> str:
    """col with the single forms and those of several letters put in; translate reads its map anew for each text, so only where a character of the map is there."""
    s = f"translate({col}, {_quoted(one)}, {_quoted(to)})"
    spelled = f"MAP {{{', '.join(f'{_quoted(c)}: {_quoted(k)}' for c, k in several)}}}"
    spelled = f"array_to_string(list_transform(regexp_extract_all({s}, '(?s).'), lambda c: coalesce({spelled}[c], c)), '')"
    return f"CASE WHEN regexp_matches({col}, '[{_ranges(''.join(c for c, _ in several))}]') THEN {spelled} WHEN regexp_matches({col}, '[{_ranges(one)}]') THEN {s} ELSE {col} END"


def suspect_sql(col: str) -> str:
    """Whether a text can differ from its form at all: most texts do not, and are left as they are after one scan."""
    one, _, several, _, _ = maps()
    spread = _ranges(one + "".join(c for c, _ in several) + ARABIC_OTHER)
    return rf"regexp_matches({col}, '[{spread}{INVISIBLE}{BLANKS}\x{{300}}-\x{{36F}}\x{{653}}-\x{{655}}\x{{370}}-\x{{52F}}\x{{530}}-\x{{58F}}\x{{13A0}}-\x{{13FF}}\x{{1C80}}-\x{{1C8F}}\x{{1DC0}}-\x{{1DFF}}\x{{1F00}}-\x{{1FFF}}\x{{2DE0}}-\x{{2DFF}}\x{{A640}}-\x{{A69F}}]|[A-Za-zÀ-ɏ][\x{{620}}-\x{{64A}}]|[\x{{620}}-\x{{65F}}][A-Za-zÀ-ɏ]')"


def _ranges(chars: str) -> str:
    """The characters as the inside of a bracket expression."""
    out, points = [], sorted(set(map(ord, chars)))
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)


def forms_sql(source: str, keep: str, col: str = "metin") -> str:
    """All columns named in keep, with bicim, the form of col, and karisik: whether a word still mixes scripts."""
    _, _, _, like, latin = maps()
    other = r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]"
    words = r"regexp_extract_all(b, '[\p{L}\p{M}''’ʼ]+|[^\p{L}\p{M}''’ʼ]+')"
    mixed = rf"regexp_matches(w, '\p{{Latin}}') AND regexp_matches(w, '{other}')"
    theirs = [rf"WHEN length(regexp_replace(w, '[^{script}]', '', 'g')) > length(regexp_replace(w, '[^\p{{Latin}}]', '', 'g')) AND regexp_matches(translate(w, {_quoted(own)}, ''), '{script}') THEN translate(w, {_quoted(a)}, {_quoted(b)})" for script, own, a, b in backwards()]
    fixed = f"nfc_normalize(array_to_string(list_transform({words}, lambda w: CASE WHEN NOT ({mixed}) THEN w {' '.join(theirs)} ELSE translate(w, {_quoted(like)}, {_quoted(latin)}) END), ''))"
    scripts = [r"\p{Latin}", r"\p{Cyrillic}", r"\p{Greek}", r"\p{Arabic}"]
    pairs = [rf"{x}[\p{{M}}''’ʼ]*[{''.join(y for y in scripts if y != x)}]" for x in scripts]
    ordered = rf"CASE WHEN regexp_matches({col}, '[\x{{64B}}-\x{{65F}}]{{2}}') THEN nfc_normalize({col}) ELSE {col} END"
    return f"""
        SELECT {keep}, CASE WHEN supheli THEN bicim ELSE {ordered} END AS bicim, coalesce(supheli AND regexp_matches(bicim, '{"|".join(pairs)}'), false) AS karisik FROM (
            SELECT *, CASE WHEN regexp_matches(b, '{other}') AND regexp_matches(b, '\\p{{Latin}}') THEN {fixed} ELSE b END AS bicim
            FROM (SELECT *, CASE WHEN supheli THEN {form_sql(col)} END AS b FROM (SELECT *, {suspect_sql(col)} AS supheli FROM {source})))"""


@lru_cache(1)
def rest() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters and digits of another shape outside SHAPES: single ones and what they stand for, and those that stand for several."""
    known, one, to, several = {ord(c) for c in maps()[0]}, [], [], []
    for c in map(chr, range(0x17F, 0x20000)):
        k = unicodedata.normalize("NFKC", c)
        if ord(c) in known or not unicodedata.decomposition(c).startswith("<") or unicodedata.category(c)[0] not in "LN" or 0x3131 <= ord(c) <= 0x318E:
            continue
        if len(k) == 1 and unicodedata.category(k)[0] in "LN":
            one.append(c), to.append(k)
        elif len(k) > 1 and k.isascii() and k.isalnum():
            several.append((c, k))
    for c in "ªº":  # below 0x17F only these: other forms there are letters of living alphabets
        one.append(c), to.append(unicodedata.normalize("NFKC", c))
    return "".join(one), "".join(to), several


def whole_sql(source: str, keep: str, col: str = "metin") -> str:
    """As forms_sql, with asil, the text itself: texts with a character outside USUAL are brought to NFC and to plain shapes before, and searched afterwards for foreign letters and mixed words."""
    one, to, several = rest()
    shaped = _shaped_sql("asil", one, to, several)
    beside = r"[\x{64B}-\x{652}''’ʼ]+"
    unusual = rf"regexp_matches({col}, '[^{USUAL}]|[A-Za-zÀ-ɏ]{beside}[\x{{620}}-\x{{64A}}]|[\x{{620}}-\x{{64A}}]{beside}[A-Za-zÀ-ɏ]')"
    pairs = [rf"{x}[\p{{M}}''’ʼ]*[{''.join(y[1:-1] for y in SCRIPTS if y != x)}]" for x in SCRIPTS]
    first = f"SELECT *, CASE WHEN _u THEN nfc_normalize({shaped}) ELSE asil END AS {col} FROM (SELECT * RENAME ({col} AS asil), {unusual} AS _u FROM {source})"
    return f"SELECT {keep}, asil, bicim, karisik OR (_u AND regexp_matches(bicim, '[{FOREIGN}]|{'|'.join(pairs)}')) AS karisik FROM ({forms_sql(f'({first})', f'{keep}, asil, _u', col)})"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together up to GATHERED bytes: planning the expressions takes as long as thousands of texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def run_duckdb(sql: str, schema: pa.Schema):
    """A function for mapInArrow that runs sql over each batch, named t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": "1", "memory_limit": "400MB"})
        for table in _gathered(batches):
            con.register("t", table)
            yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
            con.unregister("t")

    return run


def normalized(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each row and text column: key, alan (the column), metin, bicim (its consistent form), degisti (whether metin is not in it).

    Null texts give no row. Columns of df other than those named are not read. Rows delivered twice stay twice.
    """
    shipped(df.sparkSession)
    src = spread(df.select(df[key].cast("string").alias("k"), *[df[c].cast("string").alias(f"c{i}") for i, c in enumerate(columns)]))
    parts = " UNION ALL ".join(f"SELECT k, {_quoted(c)} AS alan, c{i} AS metin FROM t WHERE c{i} IS NOT NULL" for i, c in enumerate(columns))
    sql = f"SELECT k, alan, asil AS metin, bicim, (bicim <> asil OR karisik) AS degisti FROM ({whole_sql(f'({parts})', 'k, alan')})"
    schema = pa.schema([("k", pa.string()), ("alan", pa.string()), ("metin", pa.string()), ("bicim", pa.string()), ("degisti", pa.bool_())])
    out = src.mapInArrow(run_duckdb(sql, schema), T.StructType([T.StructField("k", T.StringType()), T.StructField("alan", T.StringType()), T.StructField("metin", T.StringType()), T.StructField("bicim", T.StringType()), T.StructField("degisti", T.BooleanType())]))
    return out.withColumnRenamed("k", key)


def changed(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, alan) of each value that is not in the consistent form; the texts do not leave the Arrow partition."""
    shipped(df.sparkSession)
    src = spread(df.select(df[key].cast("string").alias("k"), *[df[c].cast("string").alias(f"c{i}") for i, c in enumerate(columns)]))
    parts = " UNION ALL ".join(f"SELECT k, {_quoted(c)} AS alan, c{i} AS metin FROM t WHERE c{i} IS NOT NULL" for i, c in enumerate(columns))
    sql = f"SELECT DISTINCT k, alan FROM ({whole_sql(f'({parts})', 'k, alan')}) WHERE bicim <> asil OR karisik"
    schema = pa.schema([("k", pa.string()), ("alan", pa.string())])
    return src.mapInArrow(run_duckdb(sql, schema), "k string, alan string").withColumnRenamed("k", key).distinct()
