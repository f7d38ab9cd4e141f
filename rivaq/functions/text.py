"""Text functions as Columns: normalising, tokens, grades, labels, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters folded before lower-casing, and what they become.
FOLD, FOLD_TO = "ıİIşŞçÇğĞüÜöÖâîûé", "iiissccgguuooaiue"
# Words that carry no content in the default language.
STOP_WORDS = (
    "ve bir bu da de o ki ile için gibi ama fakat çok daha en her hiç ne ya mi mı mu mü ise diye olan olarak sonra göre kadar ancak yani şu şey ben sen biz siz onlar "
    "dedi buyurdu resulullah peygamber sallallahu aleyhi vesellem allah anlatiyor rivayet nakleder bize haber verdi"
).split()
# Blanks that trimming removes besides the ASCII ones.
BLANKS = r"\t\n\x0B\f\r\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# What a raw grade must contain to mean a class; the first that holds counts.
GRADE_WORDS = (("mevzu", ("mawdu", "fabricat", "mevzu", "maudu")), ("sahih", ("sahih", "authentic")), ("hasen", ("hasan",)), ("zayif", ("da'if", "daif", "weak", "zaif", "munkar")))
UNKNOWN = "bilinmiyor"
# Media types by extension.
MEDIA = {".html": "text/html; charset=utf-8", ".css": "text/css; charset=utf-8", ".woff2": "font/woff2", ".svg": "image/svg+xml"}


def fold_word(word: str) -> str:
    """normalize() for one literal word."""
    low = word.translate(str.maketrans(FOLD, FOLD_TO)).lower()
    return "".join(c for c in low if c.isascii() and c.isalnum())


def normalize(c: Column) -> Column:
    """Small ASCII letters and digits with single blanks between words; null becomes empty."""
    low = F.lower(F.translate(F.coalesce(c, F.lit("")), FOLD, FOLD_TO))
    return F.btrim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def tokens(c: Column, stop_words: list[str] | tuple[str, ...] = tuple(STOP_WORDS)) -> Column:
    """Words of more than two characters that are no stop words, repeats kept."""
    stop = sorted({fold_word(w) for w in stop_words})
    return F.filter(F.split(normalize(c), " "), lambda t: (F.length(t) > 2) & (~t.isin(*stop) if stop else F.lit(True)))


def trim(c: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def first_of(*cs: Column) -> Column:
    """The first that is neither null nor empty; the last as it is."""
    return F.coalesce(*[F.when(c != "", c) for c in cs[:-1]], cs[-1])


def grade_class(raw: Column) -> Column:
    """The class a raw grade means."""
    low, out = F.lower(F.coalesce(raw, F.lit(""))), None
    for name, words in GRADE_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(UNKNOWN))


def bracket_source(c: Column) -> Column:
    """The source named in brackets at the end of a text, or empty."""
    return trim(F.regexp_extract(F.coalesce(c, F.lit("")), rf"\[([^\]]{{2,40}})\][{BLANKS}]*$", 1))


def number_label(c: Column) -> Column:
    """A number as written: whole ones without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))


def first_hop(forwarded: Column, remote: Column) -> Column:
    """The caller's address: first of the forwarded ones, else the peer's, else x."""
    return first_of(trim(F.coalesce(F.get(F.split(forwarded, ","), F.lit(0)), F.lit(""))), F.coalesce(remote, F.lit("")), F.lit("x"))


def links(c: Column, pattern: str = r"(https?://[^\s)\]]*[^\s)\].,;:!?…])") -> Column:
    """All links of a text, in order, repeats kept."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1))


def content_name(content: Column, extension: str) -> Column:
    """A file name by content: twelve digits of its SHA-256."""
    return F.concat(F.substring(F.sha2(content, 256), 1, 12), F.lit(extension))


def media_type(path: Column) -> Column:
    ext = F.concat(F.lit("."), F.element_at(F.split(path, r"\."), -1))
    table = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def revelation_place(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")).rlike("(?i)mec|mek"), F.lit("Mekke")).otherwise(F.lit("Medine"))


def article_case(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)^al-", "Al-")


# Short names of pages, what may be served, and media types by extension.
PAGES = {"/": "/hadis.html", "/gizlilik": "/gizlilik.html", "/kullanim": "/kullanim.html"}
SERVED = r"^/(hadis\.html|gizlilik\.html|kullanim\.html|fonts\.css|fonts/[\w.-]+\.woff2)$"
CALLS = ("/api/dogrula", "/api/konu", "/api/kuran-konu", "/api/namaz", "/api/gunun")


def served(path: Column) -> Column:
    """The file a path stands for, or null if it is not on the list."""
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PAGES.items() for x in kv]), path), path)
    return F.when(known.rlike(SERVED), known)
