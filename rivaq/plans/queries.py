"""The queries of the core operators over whole tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivaq.functions import geo
from rivaq.functions import text as X
from rivaq.operators import admission, daily, editions, encoders, grading, lexical, ranks, vector, verify
from rivaq.session import fresh_path
from rivaq.sources.readers import answers, float_matrix, json_records, optional_float_matrix, request_body, write_float_matrix, write_records
from rivaq.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUESTION = "kuraklık yılında yetimin tarlasını karşılıksız süren çömlekçi"

_q: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _q[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Pieces of SQL that several queries share.
def n_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(translate(coalesce({c}, ''), {_lit(X.FOLD)}, {_lit(X.FOLD_TO)})), '[^a-z0-9]+', ' ', 'g'))"


STOP = "(" + ", ".join(_lit(w) for w in sorted({X.fold_word(w) for w in X.STOP_WORDS})) + ")"
B = X.BLANKS


def t_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{B}]+|[{B}]+$', '', 'g')"


def g_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(coalesce({c}, {chr(39) * 2})), {_lit(w)})' for w in words)} THEN '{name}'" for name, words in X.GRADE_WORDS) + f" ELSE '{X.UNKNOWN}' END"


ONE = "one AS (SELECT DISTINCT ON (id) * FROM corpus)"
SEEDS = "seeds AS (SELECT 'm' || (row_number() OVER (ORDER BY metin NULLS FIRST, referans NULLS FIRST, aciklama NULLS FIRST) - 1) AS id, * FROM mevzuat)"
RELATION = f"{ONE}, {SEEDS}, rel AS (SELECT id, tr, derece FROM one UNION ALL SELECT id, metin, derece FROM seeds)"
CALLS = "calls AS (SELECT DISTINCT * FROM requests)"


def index_sql(rel: str = "rel", key: str = "id", col: str = "tr") -> str:
    return f"""
    tok AS (SELECT id, term FROM (SELECT {key} AS id, unnest(string_split({n_sql(col)}, ' ')) AS term FROM {rel}) WHERE length(term) > 2 AND term NOT IN {STOP}),
    tf AS (SELECT id, term, count(*) AS f FROM tok GROUP BY ALL),
    dl AS (SELECT {key} AS id, coalesce(n, 0) AS len FROM {rel} LEFT JOIN (SELECT id AS i, count(*) AS n FROM tok GROUP BY ALL) ON i = {key}),
    st AS (SELECT count(*) AS n_docs, sum(len) AS total_len, sum(len) / CAST(count(*) AS DOUBLE) AS avg_len FROM dl),
    df AS (SELECT term, count(*) AS n FROM tf GROUP BY ALL)"""


def search_sql(queries: str, k: int, where: str = "true", rel: str = "rel", key: str = "id", grade: bool = True) -> str:
    """qid, sira, id, skor from CTEs rel and asked (qid, text)."""
    penalty = f"CASE WHEN derece = '{X.UNKNOWN}' THEN 0.92 ELSE 1 END" if grade else "1"
    return f"""
    asked AS ({queries}),
    qt AS (SELECT qid, term, count(*) AS qf FROM (SELECT qid, unnest(string_split({n_sql("text")}, ' ')) AS term FROM asked) WHERE length(term) > 2 AND term NOT IN {STOP} GROUP BY ALL),
    sc AS (SELECT qid, id, sum(qf * ln(1 + (n_docs - n + 0.5) / (n + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / avg_len))) AS s FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), st GROUP BY ALL),
    ok AS (SELECT qid, sc.id, round(s * {penalty}, 9) AS s FROM sc JOIN {rel} r ON r.{key} = sc.id WHERE {where}),
    hits AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS sira, id, round(s, 2) AS skor FROM ok QUALIFY sira <= {k})"""


def _relation(spark: SparkSession, d: str) -> DataFrame:
    return editions.search_relation(table(spark, d, "corpus"), table(spark, d, "mevzuat"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls, those delivered twice once."""
    return table(spark, d, "requests").dropDuplicates(["req_id"])


def _topics(spark: SparkSession, d: str) -> DataFrame:
    """Every different topic that calls ask for, as queries."""
    topics = table(spark, d, "requests").select(request_body(F.col("body"))["konu"].alias("text")).where("length(trim(text)) >= 2").distinct()
    return topics.select(F.col("text").alias("qid"), "text")


TOPICS = "SELECT DISTINCT konu AS qid, konu AS text FROM (SELECT json_extract_string(TRY_CAST(body AS JSON), '$.konu') AS konu FROM requests) WHERE length(trim(konu)) >= 2"


# Text -------------------------------------------------------------------------------------------------------------

@query(f"SELECT doc_id, {n_sql('text')} AS norm FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, CAST(len(list_filter(string_split({n_sql('text')}, ' '), lambda t: length(t) > 2 AND t NOT IN {STOP})) AS INT) AS n FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n"))


@query(f"WITH rel AS (SELECT * FROM documents), {index_sql('rel', 'doc_id', 'text')} SELECT id, term, f FROM tf")
def term_frequency(spark, d):
    return lexical.build(table(spark, d, "documents"), "doc_id", "text", keep=False).postings.select("id", "term", "f")


@query(f"WITH rel AS (SELECT * FROM documents), {index_sql('rel', 'doc_id', 'text')} SELECT term, n FROM df")
def document_frequency(spark, d):
    return lexical.build(table(spark, d, "documents"), "doc_id", "text", keep=False).terms


@query(f"WITH rel AS (SELECT * FROM documents), {index_sql('rel', 'doc_id', 'text')} SELECT n_docs, CAST(total_len AS BIGINT) AS total_len, round(avg_len, 6) AS avg_len FROM st")
def corpus_stats(spark, d):
    return lexical.build(table(spark, d, "documents"), "doc_id", "text", keep=False).stats.withColumn("avg_len", F.round("avg_len", 6))


@query(f"SELECT DISTINCT dereceRaw, {g_sql('dereceRaw')} AS sinif FROM corpus")
def grade_case(spark, d):
    return table(spark, d, "corpus").select("dereceRaw").distinct().select("dereceRaw", X.grade_class(F.col("dereceRaw")).alias("sinif"))


@query(f"SELECT doc_id, {t_sql(rf'''regexp_extract(coalesce(text, ''), '\[([^\]]{{2,40}})\][{B}]*$', 1)''')} AS kaynak FROM documents")
def bracket_source_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", X.bracket_source(F.col("text")).alias("kaynak"))


@query(f"SELECT DISTINCT id, {t_sql('tr')} AS tr FROM corpus WHERE length({t_sql('tr')}) >= 20")
def trimmed_long_texts(spark, d):
    return table(spark, d, "corpus").select("id", X.trim(F.col("tr")).alias("tr")).where(F.length("tr") >= editions.SHORTEST).distinct()


LINKS = r"regexp_extract_all(coalesce(text, ''), '(https?://[^\s)\]]*[^\s)\].,;:!?…])', 1)"


@query(f"SELECT url, substr(sha256(url), 1, 12) || '.bin' AS ad, count(*) AS n FROM (SELECT unnest({LINKS}) AS url FROM documents) GROUP BY ALL")
def url_extract_distinct(spark, d):
    urls = table(spark, d, "documents").select(F.explode(X.links(F.col("text"))).alias("url"))
    return urls.groupBy("url").agg(F.count("*").alias("n")).select("url", X.content_name(F.col("url"), ".bin").alias("ad"), "n")


@query("SELECT DISTINCT id, kisaTr || ' ' || CASE WHEN no = floor(no) THEN CAST(CAST(no AS BIGINT) AS VARCHAR) ELSE CAST(no AS VARCHAR) END AS etiket FROM corpus")
def label_template(spark, d):
    return table(spark, d, "corpus").select("id", F.concat("kisaTr", F.lit(" "), X.number_label(F.col("no"))).alias("etiket")).distinct()


@query("SELECT DISTINCT id, CASE WHEN en <> '' THEN en ELSE tr END AS metin, coalesce(nullif(sureAdEn, ''), sureAd) AS ad FROM ayat")
def falsy_coalesce(spark, d):
    return table(spark, d, "ayat").select("id", X.first_of(F.col("en"), F.col("tr")).alias("metin"), X.first_of(F.col("sureAdEn"), F.col("sureAd")).alias("ad")).distinct()


# Joins, sets and aggregates -----------------------------------------------------------------------------------------

@query("""WITH l AS (SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) AS l_partkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus, l_partkey, l_linenumber FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def edition_left_join_last_wins(spark, d):
    last = ranks.last_wins(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], F.struct("l_linenumber", "l_partkey"))
    return table(spark, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", "l_partkey", "l_linenumber")


@query("""WITH a AS (SELECT DISTINCT id, sure, ayet, tr FROM ayat), e AS (SELECT sure, ayet, en, sayfa FROM ayat QUALIFY row_number() OVER (PARTITION BY sure, ayet ORDER BY id DESC) = 1)
SELECT id, a.sure, a.ayet, coalesce(e.en, '') AS en, e.sayfa, coalesce(nullif(s.ad, ''), 'Sure ' || a.sure) AS ad FROM a LEFT JOIN e ON a.sure = e.sure AND a.ayet = e.ayet LEFT JOIN sure s ON a.sure = s.no""")
def composite_key_join(spark, d):
    verses = table(spark, d, "ayat")
    e = ranks.last_wins(verses.select("sure", "ayet", "en", "sayfa", F.col("id").alias("_o")), ["sure", "ayet"], F.col("_o")).drop("_o")
    names = table(spark, d, "sure").select(F.col("no").alias("sure"), F.col("ad").alias("_ad"))
    rows = verses.select("id", "sure", "ayet").distinct().join(e, ["sure", "ayet"], "left").join(names, "sure", "left")
    return rows.select("id", "sure", "ayet", F.coalesce("en", F.lit("")).alias("en"), "sayfa", X.first_of(F.col("_ad"), F.concat(F.lit("Sure "), F.col("sure"))).alias("ad"))


@query("SELECT 'h' || (row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1) AS id, c_custkey FROM customer")
def dense_id(spark, d):
    rows = ranks.dense_numbers(table(spark, d, "customer").select("c_nationkey", "c_custkey"), [F.col("c_nationkey"), F.col("c_custkey")], "_n")
    return rows.select(F.concat(F.lit("h"), F.col("_n")).alias("id"), "c_custkey")


@query(f"WITH {ONE}, {SEEDS} SELECT id, kitap, derece, en, NULL AS referans, false AS mevzuat FROM one UNION ALL SELECT id, 'mevzuat', derece, NULL, referans, true FROM seeds")
def union_by_name_missing(spark, d):
    return _relation(spark, d).select("id", "kitap", "derece", "en", "referans", "mevzuat")


@query("""SELECT s.no, s.ad, s.ayetSayisi, count(DISTINCT a.id) AS bulunan, CAST(max(a.ayet) AS INT) AS son FROM sure s LEFT JOIN ayat a ON a.sure = s.no GROUP BY ALL""")
def chapter_counts(spark, d):
    verses = table(spark, d, "ayat").select("sure", "id", "ayet").distinct().groupBy("sure").agg(F.count("id").alias("bulunan"), F.max("ayet").alias("son"))
    return table(spark, d, "sure").join(verses, F.col("no") == F.col("sure"), "left").select("no", "ad", "ayetSayisi", F.coalesce("bulunan", F.lit(0)).alias("bulunan"), "son")


@query(f"WITH {ONE} SELECT kitap, count(*) AS n, count(*) FILTER (coalesce(ar, '') = '') AS arapcasiz, count(*) FILTER (coalesce(en, '') = '') AS ingilizcesiz FROM one GROUP BY ALL")
def conditional_missing_count(spark, d):
    rows = table(spark, d, "corpus").select("id", "kitap", (F.coalesce("ar", F.lit("")) == "").alias("a"), (F.coalesce("en", F.lit("")) == "").alias("e")).distinct()
    return rows.groupBy("kitap").agg(F.count("*").alias("n"), F.count_if("a").alias("arapcasiz"), F.count_if("e").alias("ingilizcesiz"))


@query(f"WITH {ONE} SELECT g AS derece, count(id) AS n FROM (SELECT unnest({grading.CLASSES!r}) AS g) LEFT JOIN one ON derece = g GROUP BY ALL")
def grade_histogram(spark, d):
    return editions.histogram(table(spark, d, "corpus").select("id", "derece").distinct(), "derece", grading.CLASSES)


_VALUES = ", ".join("(" + ", ".join(_lit(x) for x in g[:4]) + ")" for g in grading.GRADES)


@query(f"""WITH {RELATION}, info(g, renk, tr_, en_) AS (VALUES {_VALUES})
SELECT id, coalesce(i.tr_, u.tr_) AS "dereceEtiket", coalesce(i.renk, u.renk) AS "dereceRenk" FROM rel LEFT JOIN info i ON i.g = derece JOIN info u ON u.g = '{X.UNKNOWN}'""")
def grade_dimension_join(spark, d):
    return grading.graded_view(_relation(spark, d)).select("id", "dereceEtiket", "dereceRenk")


_RANK = "CASE " + " ".join(f"WHEN contains(lower(alim), '{p}') THEN {i}" for i, p in enumerate(editions.PRIORITY)) + f" ELSE {len(editions.PRIORITY)} END"


@query(f"""WITH {ONE}, u AS (SELECT id, i, alimler[i] AS a FROM (SELECT id, alimler, unnest(range(1, len(alimler) + 1)) AS i FROM one)),
v AS (SELECT id, i, {t_sql("coalesce(nullif(a.alim, ''), 'Kaynak')")} AS alim, {t_sql("a.derece")} AS derece, {g_sql("a.derece")} AS sinif FROM u WHERE a IS NOT NULL AND a.derece <> '')
SELECT id, alim, derece, sinif FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_RANK}, i) = 1""")
def grader_priority(spark, d):
    given = F.transform("alimler", lambda a: F.struct(a["alim"].alias("name"), a["derece"].alias("grade")))
    rows = table(spark, d, "corpus").select("id", "alimler").withColumn("c", editions.chosen(editions.graders(given))).where("c IS NOT NULL")
    return rows.select("id", "c.alim", "c.derece", F.col("c.norm").alias("sinif")).distinct()


# Corpora ----------------------------------------------------------------------------------------------------------

_ALIMLER = "array_to_string(list_transform(alimler, lambda x: x.alim || '|' || x.derece || '|' || x.norm), '; ')"
_NO = "CASE WHEN no = floor(no) THEN CAST(CAST(no AS BIGINT) AS VARCHAR) ELSE CAST(no AS VARCHAR) END"


@query(rf"""WITH {ONE}, shelf AS (SELECT kitap, max(kisaTr) AS kisaTr, row_number() OVER (ORDER BY kitap) - 1 AS sira FROM one WHERE kitap IS NOT NULL GROUP BY kitap),
last AS (SELECT kitap, no, ar, en, alimler FROM one QUALIFY row_number() OVER (PARTITION BY kitap, no ORDER BY id DESC) = 1),
base AS (SELECT sira, o.id AS pos, kitap, s.kisaTr, o.no, {t_sql("coalesce(o.tr, '')")} AS tr, {t_sql("coalesce(l.en, '')")} AS en, coalesce(l.ar, '') AS ar,
    list_transform(list_filter(coalesce(l.alimler, []), lambda x: x IS NOT NULL AND x.derece <> ''), lambda x: {{'alim': {t_sql("coalesce(nullif(x.alim, ''), 'Kaynak')")}, 'derece': {t_sql("x.derece")}, 'norm': {g_sql("x.derece")}}}) AS own
    FROM one o JOIN shelf s USING (kitap) LEFT JOIN last l USING (kitap, no) WHERE length({t_sql("coalesce(o.tr, '')")}) >= 20),
b AS (SELECT *, {t_sql(rf"regexp_extract(tr, '\[([^\]]{{2,40}})\][{B}]*$', 1)")} AS src FROM base),
c AS (SELECT *, regexp_matches(lower(src), 'buhari|müslim|muslim') AS sound, own[list_position(list_transform(own, lambda x: {"CASE " + " ".join(f"WHEN contains(lower(x.alim), '{p}') THEN {i}" for i, p in enumerate(editions.PRIORITY)) + f" ELSE {len(editions.PRIORITY)} END"}), list_min(list_transform(own, lambda x: {"CASE " + " ".join(f"WHEN contains(lower(x.alim), '{p}') THEN {i}" for i, p in enumerate(editions.PRIORITY)) + f" ELSE {len(editions.PRIORITY)} END"})))] AS best FROM b),
e AS (SELECT *, CASE WHEN sira < 2 THEN [{{'alim': kisaTr || ' ittifakı', 'derece': 'Sahih', 'norm': 'sahih'}}] WHEN sira < 4 AND src <> '' AND sound THEN [{{'alim': src || ' — Nevevî derlemesi', 'derece': 'Sahih', 'norm': 'sahih'}}] WHEN sira < 4 AND src <> '' THEN [{{'alim': 'Kaynak: ' || src, 'derece': '—', 'norm': 'bilinmiyor'}}] WHEN sira < 4 THEN [] ELSE own END AS alimler FROM c)
SELECT 'h' || (row_number() OVER (ORDER BY sira, pos) - 1) AS id, kitap, no, tr, en, ar, {_ALIMLER} AS alimler, kisaTr || ' ' || {_NO} AS kaynak,
CASE WHEN sira < 2 OR sira < 4 AND src <> '' AND sound THEN 'sahih' WHEN sira < 4 THEN 'bilinmiyor' ELSE coalesce(best.norm, 'bilinmiyor') END AS derece,
CASE WHEN sira < 2 THEN 'Sahih (koleksiyon şartı)' WHEN sira < 4 AND src <> '' AND sound THEN 'Sahih (' || src || ')' WHEN sira < 4 AND src <> '' THEN 'Kaynak: ' || src WHEN sira < 4 THEN '' ELSE coalesce(best.derece, '') END AS "dereceRaw" FROM e""")
def graded_corpus(spark, d):
    """The corpus built from its own columns as three editions: of the books in order, the first two are sound throughout and the next two name their source in brackets."""
    one = table(spark, d, "corpus").dropDuplicates(["id"])
    shelf = ranks.dense_numbers(one.where("kitap IS NOT NULL").groupBy("kitap").agg(F.max("kitapTr").alias("kitapTr"), F.max("kisaTr").alias("kisaTr")), [F.col("kitap")], "sira")
    shelf = shelf.select("sira", "kitap", "kitapTr", "kisaTr", (F.col("sira") < 2).alias("hepSahih"), F.col("sira").between(2, 3).alias("parantez"))
    edition = lambda c, *more: one.select("kitap", F.col("id").alias("pos"), F.col("no").alias("hadithnumber"), F.col(c).alias("text"), *more)
    grades = F.transform("alimler", lambda a: F.when(a.isNotNull(), F.struct(a["alim"].alias("name"), a["derece"].alias("grade")))).alias("grades")
    rows = editions.joined_editions(shelf, edition("tr"), edition("ar"), edition("en", grades))
    return rows.select("id", "kitap", "no", "tr", "en", "ar", F.array_join(F.transform("alimler", lambda a: F.concat_ws("|", a["alim"], a["derece"], a["norm"])), "; ").alias("alimler"), "kaynak", "derece", "dereceRaw")


NAMES = ("Bir", "İki", "Üç", "Dört", "Beş")


@query(f"""WITH one AS (SELECT DISTINCT ON (id) * FROM ayat), half AS (SELECT sure, (ayet + 1) // 2 AS ayet, en FROM one QUALIFY row_number() OVER (PARTITION BY sure, (ayet + 1) // 2 ORDER BY id DESC) = 1),
title AS (SELECT no, regexp_replace(coalesce(ad, ''), '^al-', 'Al-', 'i') AS ad_en FROM sure),
x AS (SELECT o.*, h.en AS half_en, coalesce((['{"', '".join(NAMES)}'])[o.sure], 'Sure ' || o.sure) AS ad, coalesce(nullif(ad_en, ''), 'Surah ' || o.sure) AS ad_en FROM one o LEFT JOIN half h ON o.sure = h.sure AND o.ayet = h.ayet LEFT JOIN title t ON t.no = o.sure)
SELECT 'k' || (row_number() OVER (ORDER BY id) - 1) AS id, sure, ad AS "sureAd", ad_en AS "sureAdEn", ayet, nullif(sayfa, 0) AS sayfa, nullif(cuz, 0) AS cuz, coalesce(ar, '') AS ar, coalesce(okunus, '') AS okunus, tr, coalesce(half_en, '') AS en, ad || ' ' || ayet AS kaynak, ad_en || ' ' || ayet AS "kaynakEn" FROM x""")
def verse_corpus(spark, d):
    """The verses built from their own columns as editions; the English one gives two verses one place, of which the last counts."""
    one = table(spark, d, "ayat").dropDuplicates(["id"])
    edition = lambda c, verse=F.col("ayet"): one.select(F.col("id").alias("pos"), F.col("sure").alias("chapter"), verse.alias("verse"), F.col(c).alias("text"))
    pages = one.select(F.col("id").alias("pos"), F.col("sure").alias("chapter"), F.col("ayet").alias("verse"), F.col("sayfa").alias("page"), F.col("cuz").alias("juz"))
    titles = table(spark, d, "sure").select(F.col("no").alias("pos"), F.col("no").alias("chapter"), F.col("ad").alias("name"))
    return editions.joined_verses(edition("tr"), edition("en", F.expr("(ayet + 1) div 2").cast("int")), edition("ar"), edition("okunus"), pages, titles, list(NAMES))


@query(f"""WITH n AS (SELECT sure, count(DISTINCT id) AS n FROM ayat GROUP BY sure)
SELECT no, coalesce((['{"', '".join(NAMES)}'])[no], ad) AS ad, coalesce("adAr", '') AS "adAr", CASE WHEN regexp_matches(coalesce(inis, ''), '(?i)mec|mek') THEN 'Mekke' ELSE 'Medine' END AS inis, CAST(coalesce(n, 0) AS INT) AS "ayetSayisi" FROM sure LEFT JOIN n ON n.sure = sure.no""")
def chapters(spark, d):
    """The chapter table from chapter metadata and the verses there are."""
    n = table(spark, d, "ayat").groupBy("sure").agg(F.countDistinct("id").cast("int").alias("n"))
    given = F.get(F.array(*map(F.lit, NAMES)), F.col("no") - 1)
    rows = table(spark, d, "sure").join(n, F.col("no") == F.col("sure"), "left")
    return rows.select("no", X.first_of(given, F.col("ad")).alias("ad"), F.coalesce("adAr", F.lit("")).alias("adAr"), X.revelation_place(F.col("inis")).alias("inis"), F.coalesce("n", F.lit(0)).alias("ayetSayisi"))


_MEANINGS = ", ".join("(" + ", ".join(_lit(x) for x in g) + ")" for g in grading.GRADES)


def _view_sql(lang: str, text: str) -> str:
    return f"""SELECT id, '{lang}' AS dil, {text} AS metin, kaynak, coalesce(i.e_{lang}, u.e_{lang}) AS etiket, coalesce(i.renk, u.renk) AS renk, coalesce(nullif(aciklama, ''), i.a_{lang}, u.a_{lang}) AS anlam, "dereceRaw", nullif(referans, '') AS referans, mevzuat, coalesce(len(alimler), -1) AS alim
    FROM rel LEFT JOIN info i ON i.g = derece JOIN info u ON u.g = '{X.UNKNOWN}'"""


@query(f"""WITH {ONE}, {SEEDS}, info(g, renk, e_tr, e_en, a_tr, a_en) AS (VALUES {_MEANINGS}),
rel AS (SELECT id, tr, en, kaynak, derece, "dereceRaw", alimler, NULL AS referans, NULL AS aciklama, false AS mevzuat FROM one UNION ALL SELECT id, metin, NULL, 'Halk arasında yaygın söz', derece, referans, [], referans, aciklama, true FROM seeds)
{_view_sql("tr", "tr")} UNION ALL {_view_sql("en", "coalesce(nullif(en, ''), tr)")}""")
def graded_view(spark, d):
    """The relation searched, as it is shown in each language."""
    rel = _relation(spark, d)
    shown = lambda dil: grading.graded_view(rel, dil).select("id", F.lit(dil).alias("dil"), "metin", "kaynak", F.col("dereceEtiket").alias("etiket"), F.col("dereceRenk").alias("renk"), F.col("dereceAnlam").alias("anlam"), "dereceRaw", "referans", "mevzuat", F.coalesce(F.size("alimler"), F.lit(-1)).alias("alim"))
    return shown("tr").unionByName(shown("en"))


# Search -----------------------------------------------------------------------------------------------------------

@query(f"WITH {RELATION}, {index_sql()}, {search_sql(f'SELECT 0 AS qid, {_lit(QUESTION)} AS text', 8)} SELECT qid, sira, id, skor FROM hits")
def bm25_topk(spark, d):
    rel = _relation(spark, d)
    return lexical.search(lexical.build(rel, "id", "tr"), rel, spark.createDataFrame([(0, QUESTION)], "qid int, text string"), 8)


@query(f"WITH {RELATION}, {index_sql()}, {search_sql(TOPICS, 10, chr(39).join(['derece IN (', 'sahih', ', ', 'hasen', ')']))} SELECT qid, sira, id, skor FROM hits")
def bm25_topic_search(spark, d):
    """Every topic that calls ask for, over the sound and good sayings."""
    rel = _relation(spark, d)
    return lexical.search(lexical.build(rel, "id", "tr"), rel, _topics(spark, d), 10, F.col("derece").isin("sahih", "hasen"))


@query(f"WITH rel AS (SELECT DISTINCT ON (id) id, tr, '' AS derece FROM ayat), {index_sql()}, {search_sql(TOPICS, 10, grade=False)} SELECT qid, sira, id, skor FROM hits")
def bm25_verse_search(spark, d):
    verses = table(spark, d, "ayat").select("id", "tr").dropDuplicates(["id"])
    return lexical.search(lexical.build(verses, "id", "tr"), verses, _topics(spark, d), 10, grade=None)


MORE, LONGEST_TOPIC = "emanet komşu sabır", 300


@query(f"WITH {RELATION}, {index_sql()}, {search_sql(f'SELECT qid, substr(text || {_lit(chr(32) + MORE)}, 1, {LONGEST_TOPIC}) AS text FROM ({TOPICS})', 10, chr(39).join(['derece IN (', 'sahih', ', ', 'hasen', ')']))} SELECT qid, sira, id, skor FROM hits")
def topic_search_degraded(spark, d):
    """Topic search where the file of vectors is missing: by words, each topic widened."""
    rel = _relation(spark, d)
    vectors = optional_float_matrix(spark, f"{d}/no-such-file.f32", 64)
    wider = lambda q: q.withColumn("text", F.substring(F.concat("text", F.lit(" " + MORE)), 1, LONGEST_TOPIC))
    return lexical.topics(lexical.build(rel, "id", "tr"), rel, _topics(spark, d), 10, vectors, predicate=F.col("derece").isin("sahih", "hasen"), expand=wider)


PASSAGES = f"SELECT DISTINCT metin AS qid, metin AS text FROM (SELECT json_extract_string(TRY_CAST(body AS JSON), '$.metin') AS metin FROM requests) WHERE length({t_sql('metin')}) >= 8"


@query(f"""WITH {RELATION}, {index_sql()}, {search_sql(PASSAGES, 8)},
top AS (SELECT qid, id, least(1.0, skor / 40) AS guven FROM hits WHERE sira = 1 AND skor > 12 AND skor / 40 >= 0.45)
SELECT h.qid, any_value(t.id) IS NOT NULL AS bulundu, any_value(t.id) AS id, round(any_value(t.guven), 6) AS guven,
CASE WHEN any_value(t.id) IS NOT NULL THEN array_to_string(list_slice(list(h.id ORDER BY sira) FILTER (h.id <> t.id), 1, 3), ' ') END AS benzerler
FROM hits h LEFT JOIN top t ON h.qid = t.qid GROUP BY h.qid""")
def verify_passage(spark, d):
    """Every different passage that calls ask to verify."""
    rel = _relation(spark, d)
    texts = table(spark, d, "requests").select(request_body(F.col("body"))["metin"].alias("text")).where(F.length(X.trim(F.col("text"))) >= 8).distinct()
    out = verify.verify(lexical.build(rel, "id", "tr"), rel, texts.select(F.col("text").alias("qid"), "text"))
    return out.withColumn("guven", F.round("guven", 6)).withColumn("benzerler", F.array_join("benzerler", " "))


def _vector_sql(k: int, where: str = "true") -> str:
    return f"""WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND {where})
SELECT qid, sira, id, round(s, 6) AS skor FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS sira FROM s) WHERE sira <= {k}"""


def _vectors(spark, d, predicate=None):
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return vector.search(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), 10, predicate=predicate)


@query(_vector_sql(10))
def vector_topk(spark, d):
    """Every vector whose id is divisible by 50, against all."""
    return _vectors(spark, d)


@query(_vector_sql(10, "v.label IN (0, 1)"))
def vector_topk_filtered(spark, d):
    return _vectors(spark, d, F.col("label").isin(0, 1))


def _verse_hits_sql(lang: str) -> str:
    name, source, text = ("sureAdEn", "kaynakEn", "coalesce(nullif(en, ''), tr)") if lang == "en" else ("sureAd", "kaynak", "tr")
    return f"""SELECT qid, sira, '{lang}' AS dil, a.id, sure, "{name}" AS "sureAd", ayet, sayfa, cuz, "{source}" AS kaynak, ar, okunus, {text} AS tr, round(s, 3) AS skor FROM hits h JOIN a ON a.id = h.id"""


@query(f"""WITH a AS (SELECT * , row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT DISTINCT ON (id) * FROM ayat)),
s AS (SELECT q.vec_id AS qid, a.id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS s, a.n FROM embeddings q, a JOIN embeddings v ON v.vec_id = a.n WHERE q.vec_id % 50 = 0),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, n) AS sira FROM s QUALIFY sira <= 10)
{_verse_hits_sql("tr")} UNION ALL {_verse_hits_sql("en")}""")
def verse_hits(spark, d):
    """Topic search over verses by vectors, which belong to the verses in their order, shown in each language. Every vector whose id is divisible by 50 is a topic."""
    verses, vectors = table(spark, d, "ayat").dropDuplicates(["id"]), table(spark, d, "embeddings")
    rows = vector.aligned(verses.select("id"), "id", vectors, "vec_id", "embedding", strict=False)
    rows = ranks.dense_numbers(rows, [F.col("id")], "_n")
    hits = vector.search(rows, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), 10, key="_n", column="v")
    full = hits.withColumnRenamed("id", "_n").join(rows.select("_n", "id"), "_n").join(verses, "id")
    shown = lambda dil: grading.verse_view(full, dil).withColumn("dil", F.lit(dil))
    return shown("tr").unionByName(shown("en"))


# Days, places and callers -------------------------------------------------------------------------------------------

_TURNS = ", ".join(f"({i}, {s}, {a})" for i, (s, a) in enumerate(daily.VERSES))


@query(f"""WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS gun FROM requests WHERE ts IS NOT NULL), turn(i, s, a) AS (VALUES {_TURNS}),
pool AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT DISTINCT id FROM corpus WHERE derece = 'sahih' AND length(tr) > 40 AND length(tr) < 340)),
verse AS (SELECT sure, ayet, min(id) AS ayet_id FROM ayat GROUP BY ALL)
SELECT gun, ayet_id, pool.id AS hadis_id FROM days JOIN turn ON i = dayofyear(gun) % 20 LEFT JOIN verse ON sure = s AND ayet = a LEFT JOIN pool ON n = (dayofyear(gun) * 7) % (SELECT count(*) FROM pool)""")
def daily_pick(spark, d):
    days = table(spark, d, "requests").where("ts IS NOT NULL").select(F.col("ts").cast("date").alias("gun")).distinct()
    return daily.picks(days, table(spark, d, "ayat"), table(spark, d, "corpus"))


def _daily_sql(lang: str, source: str, text: str, label: str) -> str:
    return f"""SELECT gun, '{lang}' AS dil, a.{source} AS ayet_kaynak, a.okunus AS ayet_okunus, {text.replace("x.", "a.")} AS ayet_tr, h.kaynak AS hadis_kaynak, {text.replace("x.", "h.")} AS hadis_tr, CASE WHEN h.id IS NOT NULL THEN '{label}' END AS etiket
    FROM pick LEFT JOIN va a ON a.id = ayet_id LEFT JOIN one h ON h.id = hadis_id"""


@query(f"""WITH {ONE}, va AS (SELECT DISTINCT ON (id) * FROM ayat), days AS (SELECT DISTINCT CAST(ts AS DATE) AS gun FROM requests WHERE ts IS NOT NULL), turn(i, s, a) AS (VALUES {_TURNS}),
pool AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM one WHERE derece = 'sahih' AND length(tr) > 40 AND length(tr) < 340),
verse AS (SELECT sure, ayet, min(id) AS ayet_id FROM va GROUP BY ALL),
pick AS (SELECT gun, ayet_id, pool.id AS hadis_id FROM days JOIN turn ON i = dayofyear(gun) % 20 LEFT JOIN verse ON sure = s AND ayet = a LEFT JOIN pool ON n = (dayofyear(gun) * 7) % (SELECT count(*) FROM pool))
{_daily_sql("tr", "kaynak", "x.tr", "Sahih")} UNION ALL {_daily_sql("en", '"kaynakEn"', "coalesce(nullif(x.en, ''), x.tr)", "Sahih (Authentic)")}""")
def daily_view(spark, d):
    """The picks of each day on which calls came, as shown in each language."""
    days = table(spark, d, "requests").where("ts IS NOT NULL").select(F.col("ts").cast("date").alias("gun")).distinct()
    verses, corpus = table(spark, d, "ayat").dropDuplicates(["id"]), table(spark, d, "corpus").dropDuplicates(["id"])
    shown = lambda dil: daily.view(days, verses, corpus, dil).select("gun", F.lit(dil).alias("dil"), F.col("ayet.kaynak").alias("ayet_kaynak"), F.col("ayet.okunus").alias("ayet_okunus"), F.col("ayet.tr").alias("ayet_tr"), F.col("hadis.kaynak").alias("hadis_kaynak"), F.col("hadis.tr").alias("hadis_tr"), F.col("hadis.dereceEtiket").alias("etiket"))
    return shown("tr").unionByName(shown("en"))


_BODY = "TRY_CAST(body AS JSON)"
_PLACES = f"places AS (SELECT req_id, ts, TRY_CAST(json_extract_string({_BODY}, '$.lat') AS DOUBLE) AS lat, TRY_CAST(json_extract_string({_BODY}, '$.lng') AS DOUBLE) AS lng FROM calls)"


def _places(spark, d):
    b = request_body(F.col("body"))
    return _calls(spark, d).select("req_id", "ts", F.expr("1").alias("_"), b["lat"].try_cast("double").alias("lat"), b["lng"].try_cast("double").alias("lng")).drop("_").where("abs(lat) <= 90 AND abs(lng) <= 180")


@query(f"""WITH {CALLS}, {_PLACES} SELECT req_id, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS aci FROM (
SELECT req_id, degrees(atan2(sin(radians({geo.TARGET[1]} - lng)), cos(radians(lat)) * tan(radians({geo.TARGET[0]})) - sin(radians(lat)) * cos(radians({geo.TARGET[1]} - lng)))) AS a FROM places WHERE abs(lat) <= 90 AND abs(lng) <= 180)""")
def qibla_bearing(spark, d):
    return _places(spark, d).select("req_id", F.round(geo.bearing(F.col("lat"), F.col("lng")), 6).alias("aci"))


def _arc_sql(sine: str) -> str:
    x = f"(({sine}) - sin(radians(lat)) * sin(dec)) / (cos(radians(lat)) * cos(dec))"
    return f"CASE WHEN abs({x}) <= 1 THEN 4 * degrees(acos(greatest(-1, least(1, {x})))) END"


def _sun_sql(day: str) -> str:
    """req_id, lat, lng, dec (declination), noon (minutes) of places on a day."""
    mod = lambda x: f"(({x}) - 360.0 * floor(({x}) / 360.0))"
    return f"""(SELECT *, asin(sin(tilt) * sin(lon)) AS dec, 720.0 - 4.0 * lng - 4 * ({mod("q - degrees(atan2(cos(tilt) * sin(lon), cos(lon))) + 180.0")} - 180.0) AS noon FROM (
    SELECT *, radians({mod("q + 1.915 * sin(g) + 0.020 * sin(2 * g)")}) AS lon, radians(23.439 - 0.00000036 * n) AS tilt FROM (
    SELECT *, radians({mod("357.529 + 0.98560028 * n")}) AS g, {mod("280.459 + 0.98564736 * n")} AS q FROM (
    SELECT *, CAST(date_diff('day', DATE '2000-01-01', {day}) AS DOUBLE) AS n FROM places WHERE ts IS NOT NULL AND abs(lat) <= 90 AND abs(lng) <= 180))))"""


@query(f"""WITH {CALLS}, {_PLACES}, bugun AS {_sun_sql("CAST(ts AS DATE)")}, yarin AS {_sun_sql("CAST(ts AS DATE) + 1")}
SELECT b.req_id, round(b.imsak, 3) AS imsak, round(b.gunes, 3) AS gunes, round(b.ogle, 3) AS ogle, round(b.ikindi, 3) AS ikindi, round(b.aksam, 3) AS aksam, round(b.yatsi, 3) AS yatsi, round(y.imsak + 1440, 3) AS "yarinImsak"
FROM (SELECT req_id, noon - {_arc_sql("sin(radians(-18.0))")} AS imsak, noon - {_arc_sql("sin(radians(-0.833))")} - 7 AS gunes, noon + 5 AS ogle, noon + {_arc_sql("sin(atan(1 / (1 + tan(abs(radians(lat) - dec)))))")} + 4 AS ikindi, noon + {_arc_sql("sin(radians(-0.833))")} + 7 AS aksam, noon + {_arc_sql("sin(radians(-17.0))")} AS yatsi FROM bugun) b
JOIN (SELECT req_id, noon - {_arc_sql("sin(radians(-18.0))")} AS imsak FROM yarin) y ON y.req_id = b.req_id""")
def prayer_times(spark, d):
    """Times of the day of each call with a place, and the dawn after, in minutes from midnight UTC."""
    day = F.col("ts").cast("date")
    rows = _places(spark, d).where("ts IS NOT NULL").withColumn("v", geo.prayer_minutes(F.col("lat"), F.col("lng"), day)).withColumn("yarinImsak", F.round(geo.next_dawn(F.col("lat"), F.col("lng"), day), 3))
    return rows.select("req_id", *[F.round(f"v.{c}", 3).alias(c) for c in ("imsak", "gunes", "ogle", "ikindi", "aksam", "yatsi")], "yarinImsak")


@query(f"""WITH {CALLS} SELECT req_id, CASE WHEN json_extract_string({_BODY}, '$.dil') = 'en' THEN 'en' ELSE 'tr' END AS dil,
coalesce(nullif(substr(coalesce(json_extract_string({_BODY}, '$.cihaz'), ''), 1, 64), ''), 'anon') AS cihaz, coalesce(json_extract_string({_BODY}, '$.yerli') = 'true', false) AS yerli FROM calls""")
def request_defaults(spark, d):
    b = request_body(F.col("body"))
    return _calls(spark, d).select("req_id", F.when(b["dil"] == "en", "en").otherwise("tr").alias("dil"), X.first_of(F.substring(F.coalesce(b["cihaz"], F.lit("")), 1, 64), F.lit("anon")).alias("cihaz"), F.coalesce(b["yerli"], F.lit(False)).alias("yerli"))


@query(f"""WITH RECURSIVE {CALLS}, r AS (SELECT coalesce(ip, 'x') AS anahtar, epoch_us(geldi) AS t, req_id, row_number() OVER (PARTITION BY coalesce(ip, 'x') ORDER BY geldi, req_id) AS i FROM calls WHERE geldi IS NOT NULL),
w AS (SELECT anahtar, t, req_id, i, t AS bas, 1 AS sayi FROM r WHERE i = 1
UNION ALL SELECT r.anahtar, r.t, r.req_id, r.i, CASE WHEN r.t > w.bas + 3600000000 THEN r.t ELSE w.bas END, CASE WHEN r.t > w.bas + 3600000000 THEN 1 ELSE w.sayi + 1 END FROM w JOIN r ON r.anahtar = w.anahtar AND r.i = w.i + 1)
SELECT anahtar, req_id, bas, CAST(sayi AS INT) AS sayi, sayi > 20 AS asildi FROM w""")
def anchored_rate_limit(spark, d):
    return admission.anchored(_calls(spark, d), "ip", "geldi", "req_id", limit=20).select("anahtar", F.col("sira").alias("req_id"), "bas", "sayi", "asildi")


@query(f"""WITH {CALLS}, r AS (SELECT req_id, ts, coalesce(nullif(substr(coalesce(json_extract_string({_BODY}, '$.cihaz'), ''), 1, 64), ''), 'anon') AS cihaz FROM calls WHERE ts IS NOT NULL)
SELECT req_id, cihaz, CAST(ts AS DATE) AS gun, CAST(sayi AS INT) AS sayi, CAST(greatest(0, 5 - sayi) AS INT) AS kalan FROM (SELECT *, row_number() OVER (PARTITION BY cihaz, CAST(ts AS DATE) ORDER BY ts, req_id) AS sayi FROM r)""")
def daily_counters(spark, d):
    b = request_body(F.col("body"))
    rows = _calls(spark, d).where("ts IS NOT NULL").select("req_id", "ts", X.first_of(F.substring(F.coalesce(b["cihaz"], F.lit("")), 1, 64), F.lit("anon")).alias("cihaz"))
    return admission.daily_numbers(rows, "cihaz", "ts", "req_id").select("req_id", "cihaz", "gun", "sayi", "kalan")


@query(f"WITH {CALLS} SELECT date_trunc('hour', ts) AS bas, path, count(*) AS n FROM calls WHERE ts IS NOT NULL GROUP BY ALL")
def hourly_calls(spark, d):
    rows = _calls(spark, d).where("ts IS NOT NULL")
    return rows.groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("bas"), "path").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(DISTINCT id) FROM corpus) AS hadis, (SELECT count(DISTINCT id) FROM ayat) AS ayet, (SELECT count(*) FROM sure) AS sure")
def table_counts(spark, d):
    one = table(spark, d, "sure").agg(F.count("*").alias("sure"))
    return one.select(table(spark, d, "corpus").agg(F.countDistinct("id")).scalar().alias("hadis"), table(spark, d, "ayat").agg(F.countDistinct("id")).scalar().alias("ayet"), "sure")


@query("SELECT CAST(to_json({'ok': true, 'hadis': (SELECT count(DISTINCT id) FROM corpus), 'ayet': (SELECT count(DISTINCT id) FROM ayat), 'llm': NULL}) AS VARCHAR) AS yanit")
def health_json(spark, d):
    """The service's state as a JSON answer."""
    one = table(spark, d, "corpus").agg(F.countDistinct("id").alias("hadis"))
    return answers(one.select(F.lit(True).alias("ok"), "hadis", table(spark, d, "ayat").agg(F.countDistinct("id")).scalar().alias("ayet"), F.lit(None).cast("string").alias("llm")))


_SERVED = "(hadis.html|gizlilik.html|kullanim.html|fonts.css|fonts/[a-zA-Z0-9_.-]+.woff2)".replace(".html", r"\.html").replace(".css", r"\.css").replace("+.woff2", r"+\.woff2")


@query(rf"""WITH {CALLS}, p AS (SELECT req_id, path, CASE path WHEN '/' THEN '/hadis.html' WHEN '/gizlilik' THEN '/gizlilik.html' WHEN '/kullanim' THEN '/kullanim.html' ELSE path END AS f FROM calls)
SELECT req_id, CASE WHEN regexp_matches(f, '^/{_SERVED}$') THEN f END AS dosya, CASE WHEN regexp_matches(f, '^/{_SERVED}$') THEN CASE WHEN f LIKE '%.html' THEN 'text/html; charset=utf-8' WHEN f LIKE '%.css' THEN 'text/css; charset=utf-8' ELSE 'font/woff2' END END AS tur, coalesce(path IN {X.CALLS}, false) AS cagri FROM p""")
def allowed_paths(spark, d):
    """Of each call the file it may get, its media type, and whether it is a call of the service."""
    rows = _calls(spark, d).select("req_id", "path", X.served(F.col("path")).alias("dosya"))
    return rows.select("req_id", "dosya", F.when(F.col("dosya").isNotNull(), X.media_type(F.col("dosya"))).alias("tur"), F.coalesce(F.col("path").isin(*X.CALLS), F.lit(False)).alias("cagri"))


@query(f"WITH {CALLS} SELECT req_id, coalesce(nullif({t_sql("split_part(ip, ',', 1)")}, ''), 'x') AS adres FROM calls")
def caller_address(spark, d):
    """The address each call counts for: the first hop, or one for all calls without."""
    return _calls(spark, d).select("req_id", X.first_hop(F.col("ip"), F.lit(None).cast("string")).alias("adres"))


@query("SELECT DISTINCT id, kitap, no, tr, derece, len(alimler) AS gorus, alimler[1].alim AS ilk FROM corpus")
def json_round_trip(spark, d):
    """The corpus written as JSON records and read again with a schema."""
    rows = table(spark, d, "corpus").dropDuplicates(["id"])
    path = fresh_path(spark, "json")
    write_records(rows, path, as_json=True)
    back = json_records(spark, path, "id STRING, kitap STRING, no DOUBLE, tr STRING, derece STRING, alimler ARRAY<STRUCT<alim: STRING, derece: STRING, norm: STRING>>", lines=True)
    return back.select("id", "kitap", "no", "tr", "derece", F.when(F.col("alimler").isNotNull(), F.size("alimler")).cast("long").alias("gorus"), F.get("alimler", F.lit(0))["alim"].alias("ilk"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS ilk, CAST(embedding[len(embedding)] AS DOUBLE) AS son FROM embeddings")
def float_matrix_round_trip(spark, d):
    """The vectors written as one file of floats and read again in splits."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    path = fresh_path(spark, "matrix")
    write_float_matrix(rows, "embedding", path, order="vec_id")
    width = rows.select(F.size("embedding")).head()[0]
    return float_matrix(spark, path, width).select("pos", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0)).cast("double").alias("ilk"), F.element_at("v", -1).cast("double").alias("son"))


@query()
def encode_texts(spark, d):
    """id, dil, v: each saying's Turkish and English text, the Turkish one where there is no English."""
    rows = table(spark, d, "corpus").select("id", "tr", "en").dropDuplicates(["id"])
    texts = F.array(*[F.struct(F.lit(c).alias("dil"), X.first_of(F.col(c), F.col("tr")).alias("metin")) for c in ("tr", "en")])
    return encoders.encoded(rows.select("id", F.explode(texts).alias("m")).select("id", "m.*"), ["id", "dil"], F.col("metin"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey IN (SELECT o_custkey FROM orders) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < -900 AND s_nationkey IS NOT NULL)")
def membership_joins(spark, d):
    """Customers with orders (semi), of nations without a supplier far in debt (anti), with their dimensions."""
    rows = table(spark, d, "customer").join(table(spark, d, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    rows = rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    bad = table(spark, d, "supplier").where("s_acctbal < -900").select("s_nationkey")
    return rows.join(bad, F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("c_custkey", "n_name", "r_name")


def queries() -> dict[str, Query]:
    return dict(_q)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

