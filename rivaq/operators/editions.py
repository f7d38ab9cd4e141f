"""Editions of texts joined into graded corpora, verse corpora and chapter tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rivaq.functions import text as X
from rivaq.operators.ranks import dense_numbers, last_wins

# Graders whose word comes first, by part of their name.
PRIORITY = ("albani", "shakir", "shuayb", "arna", "darussalam", "zubair")
SHORTEST = 20


def graders(grades: Column) -> Column:
    """The opinions of a list of (name, grade) that have a grade, with the class each means."""
    given = F.filter(grades, lambda g: g.isNotNull() & (g["grade"] != ""))
    return F.transform(given, lambda g: F.struct(X.trim(X.first_of(g["name"], F.lit("Kaynak"))).alias("alim"), X.trim(g["grade"]).alias("derece"), X.grade_class(g["grade"]).alias("norm")))


def chosen(opinions: Column) -> Column:
    """The opinion of the grader first in PRIORITY, else the first; null if there is none."""

    def rank(a: Column) -> Column:
        low, out = F.lower(F.coalesce(a["alim"], F.lit(""))), F.lit(len(PRIORITY))
        for i in range(len(PRIORITY) - 1, -1, -1):
            out = F.when(low.contains(PRIORITY[i]), F.lit(i)).otherwise(out)
        return out

    best = F.array_min(F.transform(opinions, lambda a, i: F.struct(rank(a).alias("p"), i.alias("i"))))
    return F.get(opinions, best["i"])


def graded_corpus(books: list[dict], read) -> DataFrame:
    """The corpus of a list of books: id, tr, kisaTr and, where so, hepSahih (all is sound) or parantez (the source stands in brackets) of each. read(edition) gives an edition's rows (pos, hadithnumber, text, grades) or None; a book without Turkish text is left out."""
    parts: dict[str, list[DataFrame]] = {"tur": [], "ara": [], "eng": []}
    for book in books:
        for kind, own in parts.items():
            rows = read(f"{kind}-{book['id']}")
            if rows is not None:
                own.append(rows.withColumn("kitap", F.lit(book["id"])))
    tr, ar, en = (reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), v) if v else None for v in parts.values())
    spark = tr.sparkSession
    shelf = spark.createDataFrame([(n, b["id"], b["tr"], b["kisaTr"], bool(b.get("hepSahih")), bool(b.get("parantez"))) for n, b in enumerate(books)], "sira int, kitap string, kitapTr string, kisaTr string, hepSahih boolean, parantez boolean")
    return joined_editions(shelf, tr, ar, en)


def joined_editions(books: DataFrame, tr: DataFrame, ar: DataFrame | None, en: DataFrame | None) -> DataFrame:
    """All books' sayings with text, Arabic, English, grade and dense ids h0, h1, ... in the order of books (sira) and positions.

    books: sira, kitap, kitapTr, kisaTr, hepSahih, parantez, a row for each book. Editions: kitap, pos, hadithnumber, text
    and, in the English one, grades. Texts shorter than SHORTEST are left out. Of rows with one number the last counts.
    """
    rows = tr.select("kitap", F.col("pos").alias("_pos"), F.col("hadithnumber").alias("no"), X.trim(F.coalesce("text", F.lit(""))).alias("tr")).where(F.length("tr") >= SHORTEST)
    rows = rows.join(books, "kitap")
    key = ["kitap", "no"]
    if ar is not None:
        rows = rows.join(last_wins(ar.select("kitap", F.col("hadithnumber").alias("no"), F.col("text").alias("ar"), F.col("pos").alias("_o")), key, F.col("_o")).drop("_o"), key, "left")
    else:
        rows = rows.withColumn("ar", F.lit(None).cast("string"))
    if en is not None:
        rows = rows.join(last_wins(en.select("kitap", F.col("hadithnumber").alias("no"), F.col("text").alias("en"), F.col("grades").alias("_g"), F.col("pos").alias("_o")), key, F.col("_o")).drop("_o"), key, "left")
    else:
        rows = rows.withColumn("en", F.lit(None).cast("string")).withColumn("_g", F.lit(None).cast("array<struct<name:string,grade:string>>"))
    source = X.bracket_source(F.col("tr"))
    sound = F.lower(source).rlike("buhari|müslim|muslim")
    own = F.coalesce(graders(F.col("_g")), graders(F.expr("array_repeat(named_struct('name', '', 'grade', ''), 0)")))
    rows = rows.withColumn("_src", source).withColumn("_own", own).withColumn("_best", chosen(F.col("_own"))).withColumn("_sound", sound)
    # How a grade that follows from the book, or from the source in brackets, is worded.
    one = lambda alim, derece, norm: F.array(F.struct(alim.alias("alim"), derece.alias("derece"), norm.alias("norm")))
    by_book = one(F.concat("kisaTr", F.lit(" ittifakı")), F.lit("Sahih"), F.lit("sahih"))
    by_source = one(F.concat("_src", F.lit(" — Nevevî derlemesi")), F.lit("Sahih"), F.lit("sahih"))
    unsure = one(F.concat(F.lit("Kaynak: "), "_src"), F.lit("—"), F.lit(X.UNKNOWN))
    bracket, none = F.col("parantez") & (F.col("_src") != ""), F.filter("_own", lambda _: F.lit(False))
    opinions = F.when(F.col("hepSahih"), by_book).when(bracket & F.col("_sound"), by_source).when(bracket, unsure).when(F.col("parantez"), none).otherwise(F.col("_own"))
    grade = F.when(F.col("hepSahih") | bracket & F.col("_sound"), F.lit("sahih")).when(F.col("parantez"), F.lit(X.UNKNOWN)).otherwise(F.coalesce("_best.norm", F.lit(X.UNKNOWN)))
    raw = F.when(F.col("hepSahih"), F.lit("Sahih (koleksiyon şartı)")).when(bracket & F.col("_sound"), F.concat(F.lit("Sahih ("), "_src", F.lit(")"))).when(bracket, F.concat(F.lit("Kaynak: "), "_src")).when(F.col("parantez"), F.lit("")).otherwise(F.coalesce("_best.derece", F.lit("")))
    rows = rows.select("sira", "_pos", "kitap", "kitapTr", "kisaTr", "no", "tr", X.trim(F.coalesce("en", F.lit(""))).alias("en"), F.coalesce("ar", F.lit("")).alias("ar"), grade.alias("derece"), raw.alias("dereceRaw"), opinions.alias("alimler"), F.concat("kisaTr", F.lit(" "), X.number_label(F.col("no"))).alias("kaynak"))
    rows = dense_numbers(rows, [F.col("sira"), F.col("_pos")], "_n")
    return rows.select(F.concat(F.lit("h"), F.col("_n")).alias("id"), "kitap", "kitapTr", "kisaTr", "no", "tr", "en", "ar", "derece", "dereceRaw", "alimler", "kaynak")


def chapters(info: DataFrame, names: list[str]) -> DataFrame:
    """no, ad, adAr, inis, ayetSayisi of each chapter; names go by position, a chapter beyond them keeps its own."""
    rows = info.select(F.posexplode("chapters").alias("i", "c"))
    given = F.get(F.array(*[F.lit(x) for x in names]).cast("array<string>"), F.col("i"))
    return rows.select(F.col("c.chapter").alias("no"), X.first_of(given, F.col("c.name")).alias("ad"), F.coalesce("c.arabicname", F.lit("")).alias("adAr"), X.revelation_place(F.col("c.revelation")).alias("inis"), F.coalesce(F.size("c.verses"), F.lit(0)).alias("ayetSayisi"))


def verse_corpus(tr: DataFrame, en: DataFrame, ar: DataFrame, latin: DataFrame | None, info: DataFrame, names: list[str]) -> DataFrame:
    """joined_verses() with pages and chapter names from one file of chapters."""
    own = info.select(F.posexplode("chapters").alias("i", "c"))
    pages = own.select(F.col("c.chapter").alias("chapter"), "i", F.posexplode("c.verses").alias("j", "v")).select("chapter", "v.verse", "v.page", "v.juz", F.struct("i", "j").alias("pos"))
    return joined_verses(tr, en, ar, latin, pages, own.select(F.col("c.chapter").alias("chapter"), F.col("c.name").alias("name"), F.col("i").alias("pos")), names)


def joined_verses(tr: DataFrame, en: DataFrame, ar: DataFrame, latin: DataFrame | None, pages: DataFrame, titles: DataFrame, names: list[str]) -> DataFrame:
    """All verses of the first edition with the other editions (pos, chapter, verse, text), page and part (pages: pos, chapter, verse, page, juz), and chapter names (titles: pos, chapter, name; names: Turkish ones from the first chapter on). Of rows with one place the last counts."""
    place = ["chapter", "verse"]
    rows = tr.select("pos", "chapter", "verse", F.col("text").alias("tr"))
    for name, edition in (("en", en), ("ar", ar), ("okunus", latin)):
        if edition is None:
            rows = rows.withColumn(name, F.lit(""))
        else:
            rows = rows.join(last_wins(edition.select("chapter", "verse", F.col("text").alias(name), F.col("pos").alias("_o")), place, F.col("_o")).drop("_o"), place, "left").withColumn(name, F.coalesce(name, F.lit("")))
    pages = last_wins(pages.select("chapter", "verse", F.col("page").alias("sayfa"), F.col("juz").alias("cuz"), F.col("pos").alias("_o")), place, F.col("_o")).drop("_o")
    english = last_wins(titles.select("chapter", X.article_case(F.coalesce("name", F.lit(""))).alias("adEn"), F.col("pos").alias("_o")), ["chapter"], F.col("_o")).drop("_o")
    rows = rows.join(pages, place, "left").join(english, "chapter", "left")
    ad = X.first_of(F.get(F.array(*[F.lit(x) for x in names]).cast("array<string>"), F.col("chapter") - 1), F.concat(F.lit("Sure "), F.col("chapter")))
    ad_en = X.first_of(F.col("adEn"), F.concat(F.lit("Surah "), F.col("chapter")))
    rows = dense_numbers(rows, [F.col("pos")], "_n")
    return rows.select(F.concat(F.lit("k"), F.col("_n")).alias("id"), F.col("chapter").alias("sure"), ad.alias("sureAd"), ad_en.alias("sureAdEn"), F.col("verse").alias("ayet"), F.nullif("sayfa", F.lit(0)).alias("sayfa"), F.nullif("cuz", F.lit(0)).alias("cuz"), "ar", "okunus", "tr", "en", F.concat_ws(" ", ad, "verse").alias("kaynak"), F.concat_ws(" ", ad_en, "verse").alias("kaynakEn"))


def widened(seeds: DataFrame) -> DataFrame:
    """The seed list in the shape of the corpus, with ids m0, m1, ... in the order of text and reference."""
    rows = dense_numbers(seeds, [F.col("metin"), F.col("referans"), F.col("aciklama")], "_n")
    # Name of the list, long, short and as a source.
    long, short = "Halk arasında yaygın söz", "Yaygın söz"
    none = F.expr("CAST(array() AS array<struct<alim:string,derece:string,norm:string>>)")
    return rows.select(F.concat(F.lit("m"), F.col("_n")).alias("id"), F.lit("mevzuat").alias("kitap"), F.lit(long).alias("kitapTr"), F.lit(short).alias("kisaTr"), F.col("metin").alias("tr"), F.lit("").alias("ar"), "derece", F.col("referans").alias("dereceRaw"), none.alias("alimler"), F.lit(long).alias("kaynak"), "referans", "aciklama", F.lit(True).alias("mevzuat"))


def search_relation(corpus: DataFrame, seeds: DataFrame) -> DataFrame:
    """Corpus rows, each id once, and the seed list; columns that one side lacks are null."""
    one = corpus.dropDuplicates(["id"])
    return one.unionByName(widened(seeds), allowMissingColumns=True).withColumn("mevzuat", F.coalesce("mevzuat", F.lit(False)))


def histogram(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows of each value of a fixed domain, zeros included."""
    spark = df.sparkSession
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(x,) for x in domain], f"{column} string").join(F.broadcast(counts.where(F.col(column).isin(*domain))), column, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def observed(corpus: DataFrame, name: str = "corpus") -> tuple[DataFrame, Observation]:
    """corpus as it is, and figures that fill in when it is written: rows, rows without Arabic, without English, of unknown grade."""
    seen = Observation(name)
    none = lambda c: F.count_if(F.coalesce(c, F.lit("")) == "")
    return corpus.observe(seen, F.count(F.lit(1)).alias("n"), none("ar").alias("arapcasiz"), none("en").alias("ingilizcesiz"), F.count_if(F.col("derece") == X.UNKNOWN).alias("belirsiz")), seen
