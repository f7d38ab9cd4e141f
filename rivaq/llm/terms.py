"""Free entries mapped to the entry of a reference list they mean: a pigeonhole join, in SQL only.

An entry is folded (case, accents, blanks, characters that scanners confuse), bared of enumeration, label, page note
and quotes, and compared with every name of the list. A name of 5 to 7 characters may hold one slip, a longer one two;
a slip is a character put in, left out, changed, or two neighbours exchanged, which is two for levenshtein. A name that
may hold k slips, so 2k edits, is cut into 2k+1 segments, of which at least one is whole in any such entry, at most k
places from its own. Those are joined by equality, then levenshtein decides. What matches no name gets terim_id 0.

Null and blank entries are no entries. Of names equally near the one with the smaller terim_id wins. Repeated entries
give one row for each alan and deger. Empty tables give no rows; with an empty list every entry gets 0.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivaq.session import saved

SALTS = 16

# Characters that scanners confuse, and what is compared instead.
SCANNED, SCANNED_AS = "@01l$", "aoiis"
# Words that introduce a grade, folded.
LABELS = ("grade", "grading", "ruling", "hukum", "hukmu", "derece", "derecesi", "rutbe", "درجة", "الحكم", "حكم")


@lru_cache(1)
def plain_letters() -> tuple[str, str]:
    """Small letters with accents, and the letters without: by canonical decomposition, plus dotless i."""
    pairs = {"ı": "i", "ʿ": "'", "ʾ": "'", "‘": "'", "’": "'", "`": "'", "´": "'", "ى": "ي"}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x620, 0x650)]):
        base = unicodedata.normalize("NFD", c)[0]
        if c == c.lower() and base != c:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fold_sql(col: str) -> str:
    """Case, accents, vowel signs and runs of blanks away."""
    a, b = plain_letters()
    s = f"translate(lower(translate({col}, 'İI', 'ii')), {_sql(a)}, {_sql(b)})"
    return f"btrim(regexp_replace(regexp_replace({s}, {_sql(r'[\p{Mn}\p{Cf}ـ]')}, ''), {_sql(r'[\s\p{Z}]+')}, ' '))"


def bare_sql(col: str) -> str:
    """A folded entry without enumeration, label, note and quotes, scanner slips evened out."""
    s = f"regexp_replace({col}, {_sql(r'^[(\[]?\d+\s*[).:\]]\s*')}, '')"
    s = f"regexp_replace({s}, {_sql(r'^(?:(?:' + '|'.join(LABELS) + r')\s*[-–:=]?\s+|[^:]{1,20}:\s+)')}, '')"
    s = f"regexp_replace({s}, {_sql(r'(?<=\S)\s*(?:\([^()]*\)|\[[^\[\]]*\])$')}, '')"
    s = f"regexp_replace({s}, {_sql(r'\s+(?:/.*|[-–,;]\s*[^\s\d]{0,4}\s*\d[\d.\s]*)$')}, '')"
    s = f"translate({s}, {_sql(SCANNED)}, {_sql(SCANNED_AS)})"
    return f"regexp_replace({s}, {_sql(r'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$')}, '')"


def _swapped(s: str, j: str) -> str:
    return f"concat(substring({s}, 1, {j} - 1), substring({s}, {j} + 1, 1), substring({s}, {j}, 1), substring({s}, {j} + 2))"


#: Slips between q and ad, or null if more than k: plain edits first, then with one, then with two exchanges undone.
SLIPS = f"""CASE
    WHEN levenshtein(q, ad, k) >= 0 AND levenshtein(q, ad, k) < 2 THEN levenshtein(q, ad, k)
    WHEN k >= 1 AND exists(sequence(1, greatest(length(q) - 1, 1)), j -> {_swapped("q", "j")} = ad) THEN 1
    WHEN levenshtein(q, ad, k) >= 0 THEN levenshtein(q, ad, k)
    WHEN k >= 2 AND exists(sequence(1, greatest(length(q) - 1, 1)), j -> levenshtein({_swapped("q", "j")}, ad, 1) >= 0) THEN 2
    WHEN k >= 2 AND exists(transform(sequence(1, greatest(length(q) - 1, 1)), j -> {_swapped("q", "j")}), r -> exists(sequence(1, greatest(length(q) - 1, 1)), j -> {_swapped("r", "j")} = ad)) THEN 2
    END"""

MATCH = f"""
WITH adlar AS (
    SELECT CAST(terim_id AS INT) AS terim_id, alan, explode(array_append(coalesce(diger_adlar, array()), terim)) AS ad FROM %terms% WHERE terim_id IS NOT NULL AND alan IS NOT NULL),
liste AS (
    SELECT alan, ad, min(terim_id) AS terim_id, length(ad) AS n, CASE WHEN length(ad) < 5 THEN 0 WHEN length(ad) < 8 THEN 1 ELSE 2 END AS k
    FROM (SELECT terim_id, alan, {bare_sql(fold_sql("ad"))} AS ad FROM adlar WHERE ad IS NOT NULL) WHERE ad <> '' GROUP BY alan, ad),
girdi AS (SELECT alan, deger, {bare_sql(fold_sql("deger"))} AS q FROM %entries%),
esit AS (SELECT g.alan, g.deger, g.q, l.terim_id FROM girdi g LEFT JOIN liste l ON g.alan = l.alan AND g.q = l.ad),
kalan AS (SELECT DISTINCT alan, q, length(q) AS m FROM esit WHERE terim_id IS NULL AND length(q) >= 4),
parca AS (
    SELECT alan, ad, terim_id, n, k, i, bas, substring(ad, bas + 1, son - bas) AS parca FROM (
        SELECT *, CAST(floor(i * n / (2 * k + 1)) AS INT) AS bas, CAST(floor((i + 1) * n / (2 * k + 1)) AS INT) AS son
        FROM (SELECT *, explode(sequence(0, 2 * k)) AS i FROM liste WHERE k > 0))),
duzen AS (SELECT DISTINCT alan, n, k, i, bas, length(parca) AS boy FROM parca),
yakin AS (SELECT alan, q, m, m + fark AS n, abs(fark) AS f FROM (SELECT *, explode(sequence(-2, 2)) AS fark FROM kalan)),
pencere AS (
    SELECT alan, q, n, i, substring(q, bas + kay + 1, boy) AS parca FROM (
        SELECT y.alan, y.q, y.n, d.i, d.bas, d.boy, explode(sequence(-d.k, d.k)) AS kay
        FROM yakin y JOIN duzen d ON y.alan = d.alan AND y.n = d.n AND y.f <= d.k) WHERE bas + kay >= 0),
aday AS (
    SELECT DISTINCT w.alan, w.q, p.ad, p.k, p.terim_id FROM pencere w JOIN parca p ON w.alan = p.alan AND w.n = p.n AND w.i = p.i AND w.parca = p.parca),
olcu AS (SELECT alan, q, terim_id, {SLIPS} AS slips FROM aday),
bulunan AS (SELECT alan, q, min(struct(slips, terim_id)).terim_id AS terim_id FROM olcu WHERE slips IS NOT NULL GROUP BY alan, q),
eksik AS (SELECT e.alan, e.q FROM kalan e LEFT ANTI JOIN bulunan b ON e.alan = b.alan AND e.q = b.q)
SELECT e.alan, e.deger, coalesce(e.terim_id, b.terim_id, 0) AS terim_id, x.q IS NOT NULL OR (e.terim_id IS NULL AND b.terim_id IS NULL) AS eslesmeyen
FROM esit e LEFT JOIN bulunan b ON e.alan = b.alan AND e.q = b.q LEFT JOIN eksik x ON e.alan = x.alan AND e.q = x.q
"""


def mapped(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """entries: alan, deger. A row for each different entry: alan, deger, terim_id (0: none), eslesmeyen (whether it matches none)."""
    spark = entries.sparkSession
    wanted = saved(entries.select("alan", "deger").where("deger IS NOT NULL AND alan IS NOT NULL").distinct(), "entries")  # read several times
    query = MATCH.replace("{", "{{").replace("}", "}}").replace("%entries%", "{entries}").replace("%terms%", "{terms}")
    return spark.sql(query, entries=wanted, terms=terms.select("terim_id", "alan", "terim", "diger_adlar"))


def joined(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows (alan, deger and more) with the terim_id of each entry. An entry may hold a third of all rows: rows are salted by their key."""
    salted = rows.withColumn("tuz", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    copies = found.select("alan", "deger", "terim_id").withColumn("tuz", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["alan", "deger", "tuz"]).drop("tuz")


def found(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, alan, terim_id) of each value of dereceRaw and derece that is not null, blank or literally an entry of its list."""
    rows = corpus.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("alan"), F.col(c).alias("deger")) for c in ("dereceRaw", "derece")])).alias("v")).select("id", "v.alan", "v.deger")
    rows = rows.where(rf"deger IS NOT NULL AND deger RLIKE '[^\\s\\p{{Z}}\\p{{Cf}}]'")
    literal = terms.select("alan", F.col("terim").alias("deger")).where("terim IS NOT NULL").distinct()
    rows = rows.join(literal, ["alan", "deger"], "left_anti")
    return joined(rows, mapped(rows, terms), "id").select("id", "alan", F.col("terim_id").cast("int").alias("terim_id")).distinct()
