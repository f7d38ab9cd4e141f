"""The queries of the llm operators, over whole tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivaq.llm import consensus, langid, mixing, neardup, normalize, packing, pieces, terms
from rivaq.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.found(table(spark, d, "corpus"), table(spark, d, "derece_terimleri"))


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "corpus"), table(spark, d, "derece_terimleri"))


def p1_graders(spark: SparkSession, d: str) -> DataFrame:
    return consensus.graders(table(spark, d, "corpus"), table(spark, d, "derece_terimleri"))


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(table(spark, d, "corpus"), table(spark, d, "derece_terimleri"))


def p1_votes(spark: SparkSession, d: str) -> DataFrame:
    """What of p1_consensus follows from the opinions alone: their number and agreement."""
    return p1_consensus(spark, d).select("id", "n", "uyum")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.found(table(spark, d, "corpus"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.cut(table(spark, d, "corpus"), "id", ["tr", "en"]).drop("cumleler")


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of each oversized value cover it within the limits."""
    return pieces.coverage(table(spark, d, "corpus"), "id", ["tr", "en"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.found(table(spark, d, "corpus"), table(spark, d, "derece_terimleri"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """alan, deger and the number of sayings of each entry that means no term."""
    corpus = table(spark, d, "corpus").select("id", "dereceRaw", "derece").distinct()
    rows = corpus.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("alan"), F.col(c).alias("deger")) for c in ("dereceRaw", "derece")])).alias("v")).select("v.*")
    counts = rows.where(r"deger RLIKE '[^\\s\\p{Z}\\p{Cf}]'").groupBy("alan", "deger").agg(F.count("*").alias("n"))
    return counts.join(terms.mapped(counts, table(spark, d, "derece_terimleri")).where("eslesmeyen").select("alan", "deger"), ["alan", "deger"], "left_semi")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "corpus"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.grouped(table(spark, d, "corpus"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return normalize.changed(table(spark, d, "corpus"), "id", ["tr", "ar"]).union(normalize.changed(table(spark, d, "ayat"), "id", ["okunus"]))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    both = normalize.normalized(table(spark, d, "corpus"), "id", ["tr", "ar"]).unionByName(normalize.normalized(table(spark, d, "ayat"), "id", ["okunus"]))
    return both.where("degisti").select("id", "alan", "bicim").distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p6_containers(spark, d), table(spark, d, "containers"))


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """container, metin (texts it holds), sigar (whether no container holds more than its capacity), bolunmez (whether only texts above the capacity are split)."""
    rows, kinds = p6_containers(spark, d), table(spark, d, "containers").select("container", "capacity_tokens")
    fits = rows.groupBy("container", "kutu").agg(F.sum("adet").alias("dolu")).join(kinds, "container").groupBy("container").agg(F.bool_and(F.col("dolu") <= F.col("capacity_tokens")).alias("sigar"))
    texts = rows.groupBy("container", "doc_id").agg(F.count("*").alias("parca"), F.sum("adet").alias("adet"), F.min("bas").alias("bas"), F.max(F.col("bas") + F.col("adet")).alias("son")).join(kinds, "container")
    whole = (F.col("parca") == F.ceil(F.col("adet") / F.col("capacity_tokens"))) & (F.col("bas") == 0) & (F.col("son") == F.col("adet"))
    return texts.groupBy("container").agg(F.count("*").alias("metin"), F.bool_and(whole).alias("bolunmez")).join(fits, "container")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_reached(spark: SparkSession, d: str) -> DataFrame:
    """source, hedef, max_repeat, var (whether it has texts), tuttu (whether its share is within a hundredth of the target's among sources with texts), sinirda (whether it is used no more than max_repeat times)."""
    rows = p7_shares(spark, d)
    due = F.col("hedef") / rows.where("mevcut > 0").agg(F.sum("hedef")).scalar()
    return rows.select("source", "hedef", "max_repeat", (F.col("mevcut") > 0).alias("var"), F.when(F.col("mevcut") > 0, F.abs(F.col("ulasilan") - due) < 0.01).otherwise(F.col("belirtec") == 0).alias("tuttu"), (F.coalesce("kullanim", F.lit(0.0)) <= F.col("max_repeat")).alias("sinirda"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.found(table(spark, d, "documents"))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every document with its language and confidence, and the document's."""
    return langid.assigned(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_consensus, p1_graders, p1_agreement, p1_votes, p2_found, p2_pieces, p2_coverage, p3_found, p3_unmatched, p4_found, p4_groups, p5_found, p5_forms, p6_containers, p6_usage, p6_coverage, p7_mixture, p7_shares, p7_reached, p8_found, p8_languages)}


def _duck(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _folded_sql(c: str) -> str:
    plain, plain_as = terms.plain_letters()
    x = f"translate(lower(translate({c}, 'İI', 'ii')), {_duck(plain)}, {_duck(plain_as)})"
    return rf"trim(regexp_replace(regexp_replace({x}, '[\p{{Mn}}\p{{Cf}}ـ]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


ENTRIES = "SELECT id, 'dereceRaw' AS alan, dereceRaw AS deger FROM corpus UNION ALL SELECT id, 'derece', derece FROM corpus"


def _entries_sql(entries: str = ENTRIES) -> str:
    """bulunan (alan, deger, terim_id) by comparing each entry with every name."""

    def bare(c: str) -> str:
        x = _folded_sql(c)
        labels = "|".join(terms.LABELS)
        x = rf"regexp_replace({x}, '^[(\[]?\d+\s*[).:\]]\s*', '')"
        x = rf"regexp_replace({x}, '^(?:(?:{labels})\s*[-–:=]?\s+|[^:]{{1,20}}:\s+)', '')"
        x = rf"regexp_replace({x}, '(\S)\s*(?:\([^()]*\)|\[[^\[\]]*\])$', '\1')"
        x = rf"regexp_replace({x}, '\s+(?:/.*|[-–,;]\s*[^\s\d]{{0,4}}\s*\d[\d.\s]*)$', '')"
        x = f"translate({x}, {_duck(terms.SCANNED)}, {_duck(terms.SCANNED_AS)})"
        # DuckDB counts bytes: Arabic letters become single ones, which folded entries do not hold.
        return rf"translate(regexp_replace({x}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'), 'ابتثجحخدذرزسشصضطظعغفقكلمنهويةء', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ{{|}}~')"

    return rf"""
    girdi AS (SELECT DISTINCT id, alan, deger FROM ({entries}) WHERE regexp_matches(deger, '[^\s\p{{Z}}\p{{Cf}}]')),
    liste AS (SELECT terim_id, alan, {bare("ad")} AS ad FROM (SELECT terim_id, alan, unnest(list_append(coalesce(diger_adlar, []), terim)) AS ad FROM derece_terimleri)),
    deger AS (SELECT DISTINCT alan, deger, {bare("deger")} AS q FROM girdi),
    uzak AS (SELECT d.alan, d.deger, l.terim_id, damerau_levenshtein(d.q, l.ad) AS u FROM deger d JOIN liste l ON d.alan = l.alan AND abs(length(d.q) - length(l.ad)) <= 2 WHERE damerau_levenshtein(d.q, l.ad) <= CASE WHEN length(l.ad) < 5 THEN 0 WHEN length(l.ad) < 8 THEN 1 ELSE 2 END),
    bulunan AS (SELECT alan, deger, arg_min(terim_id, (u, terim_id)) AS terim_id FROM uzak GROUP BY ALL)"""


def _votes_sql() -> str:
    """oy (id, g, k): the first usable opinion of each grader on each saying; say (id, n, v0..v3): opinions of each saying."""
    given = "SELECT id, 'dereceRaw' AS alan, u.derece AS deger FROM (SELECT id, unnest(alimler) AS u FROM corpus)"
    votes = ", ".join(f"count(*) FILTER (k = '{c}') AS v{i}" for i, c in enumerate(consensus.CLASSES))
    return rf"""{_entries_sql(given)},
    gorus AS (SELECT id, sira, regexp_replace({_folded_sql("u.alim")}, '[\s\p{{Z}}\p{{Pd}}]+', '', 'g') AS g, u.derece AS deger FROM (SELECT id, unnest(alimler) AS u, generate_subscripts(alimler, 1) AS sira FROM corpus)),
    oy AS (SELECT id, g, arg_min(sinif, sira) AS k FROM gorus JOIN bulunan USING (deger) JOIN derece_terimleri t USING (terim_id) WHERE bulunan.alan = 'dereceRaw' AND t.alan = 'dereceRaw' AND g <> '' AND sinif IN {consensus.CLASSES} GROUP BY ALL),
    say AS (SELECT id, count(*) AS n, {votes} FROM oy GROUP BY id)"""


def _changed_characters() -> str:
    """Characters that the consistent form holds in another way, and that way, from the character database; and the letters written for foreign Arabic ones."""
    rows = dict(normalize.ARABIC)
    for c in map(chr, [*range(0x7F, 0xD800), *range(0xF900, 0x20000), *range(0xE0000, 0xE1000)]):
        kind, whole, tag = unicodedata.category(c), unicodedata.normalize("NFKC", c).strip(), unicodedata.decomposition(c)
        if kind in ("Cc", "Cf") or c in "\u0640\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\u180b\u180c\u180d" or "\ufe00" <= c <= "\ufe0f":
            rows[c] = ""
        elif kind == "Zs":
            rows[c] = " "
        elif tag.startswith("<") and not ("\u3131" <= c <= "\u318e" or c in "ĲĳĿŀŉµ"):
            letters = whole and all(unicodedata.category(x)[0] in "LNM" for x in whole)
            if kind[0] in "LNM" and letters or "<circle>" in tag and kind == "So" and whole.isascii() or "\uff01" <= c <= "\uffdc":
                rows[c] = whole
    return ", ".join(f"({_duck(a)}, {_duck(b)})" for a, b in rows.items() if "\0" not in a)


def _forms_sql(what: str) -> str:
    """what of metin, bicim and bozuk (a word of two scripts or a foreign Arabic letter is left), character by character instead of by whole-text expressions."""
    alphabet = "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي"
    scripts = " ".join(rf"WHEN regexp_matches(c, '\p{{{x}}}') THEN '{x}'" for x in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Armenian", "Cherokee", "Georgian"))
    base = dict(zip(normalize.CYRILLIC + normalize.GREEK, normalize.CYRILLIC_AS + normalize.GREEK_AS, strict=True))
    with_mark = {unicodedata.normalize("NFC", a + m): unicodedata.normalize("NFC", b + m) for a, b in base.items() for m in map(chr, range(0x300, 0x340))}
    like = ", ".join(f"({_duck(a)}, {_duck(b)})" for a, b in (base | {a: b for a, b in with_mark.items() if len(a) == 1}).items())
    split = "SELECT id, alan, metin, generate_subscripts(h, 1) AS yer, unnest(h) AS c FROM (SELECT *, regexp_extract_all({}, '(?s).') AS h FROM {})"
    return rf"""
    WITH degisen(c, olan) AS (VALUES {_changed_characters()}), benzer(c, latin) AS (VALUES {like}),
    girdi AS (SELECT DISTINCT * FROM (SELECT id, 'tr' AS alan, tr AS metin FROM corpus UNION ALL SELECT id, 'ar', ar FROM corpus UNION ALL SELECT id, 'okunus', okunus FROM ayat) WHERE metin IS NOT NULL),
    bir AS (SELECT id, alan, metin, nfc_normalize(coalesce(string_agg(coalesce(olan, c), '' ORDER BY yer), '')) AS b FROM ({split.format("metin", "girdi")}) LEFT JOIN degisen USING (c) GROUP BY ALL),
    iki AS (SELECT * REPLACE (replace(replace(b, 'i̇', 'i'), 'ı̇', 'i') AS b) FROM bir),
    harf AS ({split.format("b", "iki")}),
    tur AS (SELECT c, regexp_matches(c, '[\p{{L}}\p{{M}}''’ʼ]') AS ic, CASE {scripts} END AS yazi, (regexp_matches(c, '^\p{{Arabic}}$') AND regexp_matches(c, '\p{{Lo}}') AND NOT contains('{alphabet}', c)) AS yabanci FROM (SELECT DISTINCT c FROM harf)),
    sozcuk AS (SELECT *, sum(CASE WHEN ic THEN 0 ELSE 1 END) OVER (PARTITION BY id, alan ORDER BY yer) + CASE WHEN ic THEN 0 ELSE 0.5 END AS s FROM harf JOIN tur USING (c)),
    yaz AS (SELECT id, alan, s, count(DISTINCT yazi) AS n, count(DISTINCT yazi) FILTER (yazi IN ('Latin', 'Cyrillic', 'Greek')) AS m FROM sozcuk GROUP BY ALL HAVING n > 1),
    son AS (SELECT w.id, w.alan, w.metin, w.yer, w.yabanci, y.n, CASE WHEN y.m > 1 AND w.yazi IN ('Cyrillic', 'Greek') THEN coalesce(b.latin, w.c) ELSE w.c END AS c, CASE WHEN y.m > 1 AND w.yazi IN ('Cyrillic', 'Greek') AND b.latin IS NULL OR y.n > greatest(y.m, 1) THEN true ELSE w.yabanci END AS bozuk FROM sozcuk w LEFT JOIN yaz y USING (id, alan, s) LEFT JOIN benzer b ON w.c = b.c),
    butun AS (SELECT id, alan, metin, nfc_normalize(string_agg(c, '' ORDER BY yer)) AS bicim, bool_or(bozuk) AS bozuk FROM son GROUP BY ALL UNION ALL SELECT id, alan, metin, b, false FROM iki WHERE b = '')
    {what}"""


def _pairs_sql(what: str) -> str:
    """what of ciftler (x < y): all pairs of sayings that share a word, counted word by word."""
    signs = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ((0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6DC), (0x6DF, 0x6E8), (0x6EA, 0x6ED), (0x8D3, 0x8FF))) + "]"
    return _forms_sql(rf"""
    , kelime AS (SELECT id, alan, unnest(regexp_extract_all(regexp_replace(replace(lower(replace(replace(bicim, 'İ', 'i'), 'I', 'i')), 'ı', 'i'), '{signs}', '', 'g'), '[\p{{L}}\p{{N}}]+')) AS w FROM butun WHERE alan <> 'okunus'),
    kacinci AS (SELECT id, alan, w, row_number() OVER (PARTITION BY id, alan, w) AS k FROM kelime),
    boy AS (SELECT id, alan, count(*) AS n FROM kelime GROUP BY ALL),
    ortak AS (SELECT a.id AS x, b.id AS y, alan, count(*) AS o FROM kacinci a JOIN kacinci b USING (alan, w, k) WHERE a.id < b.id GROUP BY ALL),
    ciftler AS (SELECT DISTINCT x, y FROM ortak JOIN boy p ON p.id = x AND p.alan = ortak.alan JOIN boy q ON q.id = y AND q.alan = ortak.alan WHERE o >= 0.7 * greatest(p.n, q.n) - 1e-9)
    {what}""")


def oracle_sql() -> dict[str, str]:
    blank = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]"
    sizes = f"SELECT id, alan, length(regexp_extract(metin, '^{blank}*')) AS bas, length(regexp_replace(metin, '{blank}*$', '')) AS son FROM (SELECT DISTINCT id, 'tr' AS alan, tr AS metin FROM corpus UNION ALL SELECT DISTINCT id, 'en', en FROM corpus)"
    squares = "v0 * v0 + v1 * v1 + v2 * v2 + v3 * v3"
    with_text = "(SELECT DISTINCT source FROM documents WHERE text <> '' AND source IS NOT NULL)"
    return {
        "p1_votes": f"WITH {_votes_sql()} SELECT id, CAST(n AS INT) AS n, CASE WHEN n > 1 THEN ({squares} - n) / (n * (n - 1)) END AS uyum FROM say",
        "p1_agreement": f"""WITH {_votes_sql()}, cok AS (SELECT * FROM say WHERE n > 1),
            top AS (SELECT count(*) AS deger, sum(n) AS gorus, sum((n * n - ({squares})) / (n - 1)) AS d, sum(v0) AS v0, sum(v1) AS v1, sum(v2) AS v2, sum(v3) AS v3 FROM cok)
            SELECT CAST(deger AS BIGINT) AS deger, CAST(gorus AS BIGINT) AS gorus, 1 - d / ((gorus * gorus - ({squares})) / (gorus - 1)) AS alfa FROM top""",
        "p2_coverage": f"SELECT id, alan, CAST(bas AS INT) AS bas, CAST(son AS INT) AS son, true AS sigar, true AS bitisik FROM ({sizes}) WHERE son - bas > {pieces.LIMIT}",
        "p6_coverage": "SELECT container, (SELECT count(*) FROM documents WHERE text <> '') AS metin, true AS sigar, true AS bolunmez FROM containers",
        "p7_reached": f"SELECT source, target_share AS hedef, max_repeat, coalesce(source IN {with_text}, false) AS var, true AS tuttu, true AS sinirda FROM mix_targets",
        "p3_found": f"WITH {_entries_sql()} SELECT DISTINCT id, g.alan, CAST(coalesce(terim_id, 0) AS INT) AS terim_id FROM girdi g LEFT JOIN bulunan b ON g.alan = b.alan AND g.deger = b.deger WHERE NOT EXISTS (SELECT 1 FROM derece_terimleri t WHERE t.alan = g.alan AND t.terim = g.deger)",
        "p3_unmatched": f"WITH {_entries_sql()} SELECT g.alan, g.deger, count(*) AS n FROM girdi g LEFT JOIN bulunan b ON g.alan = b.alan AND g.deger = b.deger WHERE b.terim_id IS NULL GROUP BY ALL",
        "p4_found": _pairs_sql("SELECT x AS id_a, y AS id_b FROM ciftler"),
        "p4_groups": "WITH RECURSIVE " + _pairs_sql("""
            , yol AS (SELECT x AS id, y AS uc FROM ciftler UNION SELECT y, x FROM ciftler UNION SELECT yol.id, c.b FROM yol JOIN (SELECT x AS a, y AS b FROM ciftler UNION SELECT y, x FROM ciftler) c ON yol.uc = c.a)
            SELECT id, coalesce(g, id) AS grup, g IS NOT NULL AS benzer FROM (SELECT DISTINCT id FROM corpus) LEFT JOIN (SELECT id, min(least(id, uc)) AS g FROM yol GROUP BY id) USING (id)""").lstrip().removeprefix("WITH "),
        "p5_found": _forms_sql("SELECT id, alan FROM butun WHERE bicim <> metin OR bozuk"),
        "p5_forms": _forms_sql("SELECT id, alan, bicim FROM butun WHERE bicim <> metin OR bozuk"),
    }
