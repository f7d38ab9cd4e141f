"""Graded views of search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivaq.functions import text as X

# Class, colour, label in Turkish and in English, meaning in Turkish and in English.
GRADES = (
    ("sahih", "yesil", "Sahih", "Sahih (Authentic)", "Sened yönünden sağlam, güvenilir. Dinî bir delil olarak kullanılabilir.", "Sound and reliable in its chain. Can be used as religious evidence."),
    ("hasen", "yesil", "Hasen", "Hasan (Good)", "İyi derecede sağlam. Delil olarak kabul edilir; sahihe göre bir alt basamaktır.", "Good and acceptable as evidence; one level below sahih."),
    ("zayif", "turuncu", "Zayıf", "Weak (Da'if)", "Kaynakta geçiyor ama senedinde zayıflık var. Güçlü/kesin bir hadis sayılmaz; tek başına hüküm dayanağı olmaz. Faziletlerde ihtiyatla anılabilir.", "Found in the source but weak in its chain. Not a strong/decisive report; cannot alone be a basis for a ruling."),
    ("mevzu", "kirmizi", "Aslı sabit değil", "Not authentically established", "Âlimler bu sözü Peygamber'e ait güvenilir bir hadis olarak kabul etmiyor; sağlam bir dayanağı yok. Hadis diye aktarmamak daha doğru olur.", "Scholars do not accept this as a reliable saying of the Prophet; it has no sound basis. Better not to relay it as a hadith."),
    ("bilinmiyor", "gri", "Derece belirsiz", "Grade unclear", "Bu nüsha için elimizde net bir derecelendirme kaydı yok; kesinliği hakkında hüküm vermek doğru olmaz.", "We have no clear grading record for this narration; its reliability cannot be stated with certainty."),
)
CLASSES = [g[0] for g in GRADES]


def graded_view(rows: DataFrame, lang: str = "tr") -> DataFrame:
    """Rows with the text of the language (Turkish where it is missing), and label, colour and meaning of the grade; an unknown grade gets those of bilinmiyor. A row's own explanation (aciklama) stands for the meaning; mevzuat and referans are there in any case."""
    en = lang == "en"
    named = lambda at: F.element_at(F.create_map(*[F.lit(x) for g in GRADES for x in (g[0], g[at])]), known)
    known = F.when(F.col("derece").isin(*CLASSES), F.col("derece")).otherwise(F.lit(X.UNKNOWN))
    text = X.first_of(F.col("en"), F.col("tr")) if en else F.col("tr")
    has = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    return rows.withColumns({
        "metin": text, "dereceEtiket": named(3 if en else 2), "dereceRenk": named(1), "dereceAnlam": X.first_of(has("aciklama", "string"), named(5 if en else 4)),
        "mevzuat": F.coalesce(has("mevzuat", "boolean"), F.lit(False)), "referans": X.first_of(has("referans", "string"), F.lit(None).cast("string")),
    })


def verse_view(rows: DataFrame, lang: str = "tr") -> DataFrame:
    """id, sure, sureAd, ayet, sayfa, cuz, kaynak, ar, okunus, tr of verses in the language, Turkish where it is missing; and skor with three places, if rows have one."""
    en = lang == "en"
    score = [F.round("skor", 3).alias("skor")] if "skor" in rows.columns else []
    rest = [c for c in ("qid", "sira") if c in rows.columns]
    return rows.select(*rest, "id", "sure", F.col("sureAdEn" if en else "sureAd").alias("sureAd"), "ayet", "sayfa", "cuz", F.col("kaynakEn" if en else "kaynak").alias("kaynak"), "ar", "okunus", (X.first_of(F.col("en"), F.col("tr")) if en else F.col("tr")).alias("tr"), *score)
