import unicodedata

import pytest

from rivaq.llm import normalize as N

SAME = ["λόγος мир", "(Arapçası: صبر)", "[نسخة ٢]", "☕ çay", "İstanbul", "﴾حاشية﴿", "çift  blank", "satır\nsatır", "كَتَبَ", "", "x" * 100_000]
OTHER = {
    "i̇yi": "iyi", "Remνοnken": "Remvonken", "ѕӧуlеdі": "söyledi", "sa'а̂ş": "sa'âş", "a b": "a b", "AB​C": "ABC", "［４2］": "[42]", "ﻟﻴﻠﺔ": "ليلة", "ﻻ": "لا", "یوم": "يوم", "کتاب": "كتاب",
    "karşı": "karşı", "Ｎusｋisｒub，": "Nuskisrub,", "أرض": "أرض", "كَّ": "كَّ", "ab\xadc": "abc", "ﬁn": "fin",
}


def forms(spark, *texts):
    df = spark.createDataFrame([(str(i), t, "başka") for i, t in enumerate(texts)], "id string, tr string, bicim string")
    return {int(r.id): r for r in N.normalized(df, "id", ["tr"]).collect()}


def test_consistent_texts_stay(spark):
    got = forms(spark, *SAME)
    assert [(got[i].bicim, got[i].degisti) for i in range(len(SAME))] == [(t, False) for t in SAME]


def test_other_texts_change(spark):
    texts = list(OTHER)
    got = forms(spark, *texts)
    assert [got[i].bicim for i in range(len(texts))] == list(OTHER.values())
    assert all(got[i].degisti == (texts[i] != OTHER[texts[i]]) for i in got)
    assert all(r.bicim == unicodedata.normalize("NFC", r.bicim) for r in got.values())


def test_form_is_stable(spark):
    first = [r.bicim for _, r in sorted(forms(spark, *OTHER).items())]
    again = forms(spark, *first)
    assert not any(r.degisti for r in again.values())


def test_mixed_word_without_look_alike_is_reported(spark):
    got = forms(spark, "abжd")
    assert got[0].degisti


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([("a", None, "x​"), ("a", None, "x​"), ("b", "﻿", None)], "id string, tr string, ar string")
    assert {tuple(r) for r in N.changed(df, "id", ["tr", "ar"]).collect()} == {("a", "ar"), ("b", "tr")}
    assert N.changed(df.limit(0), "id", ["tr"]).count() == 0


def test_every_rule_is_a_pair():
    one, to, several, like, latin = N.maps()
    assert len(one) == len(to) == len(set(one)) and len(like) == len(latin) and all(len(k) > 1 for _, k in several)


@pytest.mark.parametrize("c", "ﻙﮎﯽ")
def test_presentation_forms_reach_the_alphabet(spark, c):
    got = forms(spark, c)
    assert got[0].bicim in "كي"


def test_rare_characters_are_seen(spark):
    rare = {"5 \u212a": "5 K", "\u212b": "Å", "\u2126": "Ω", "\u0628\u0670\u0651": "\u0628\u0651\u0670", "\u304b\u3099": "が", "mi\u017f": "mis", "1\u00aa": "1a", "\u210b": "H"}
    foreign = ["\u0628\u0679", "\u0688", "\u06d3", "\u06a1", "ab\u05d0", "\u1e25\u0628", "a\u064e\u0628"]
    plain = ["شَيْءٌ", "שלום su", "x™", "№ 5", "日本かな", "\u0628\u0651\u0670", "½"]
    got = forms(spark, *rare, *foreign, *plain)
    assert [got[i].bicim for i in range(len(rare))] == list(rare.values())
    assert [r.degisti for _, r in sorted(got.items())] == [True] * len(rare) + [True] * len(foreign) + [False] * len(plain)
    assert {i: r.metin for i, r in got.items()} == dict(enumerate([*rare, *foreign, *plain]))


def test_all_of_unicode():
    """Every character alone, after a Latin letter and after an Arabic one, decomposed and not: the form is NFC and stays as it is."""
    import duckdb
    import pyarrow as pa

    def forms_of(texts):
        con = duckdb.connect()
        con.register("t", pa.table({"k": range(len(texts)), "metin": texts}))
        return [r[0] for r in con.sql(f"SELECT bicim FROM ({N.whole_sql('t', 'k')}) ORDER BY k").fetchall()]

    every = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    first = forms_of([*every, *("a" + c for c in every), *("ب" + c for c in every), *(unicodedata.normalize("NFD", "x" + c) for c in every)])
    assert all(unicodedata.is_normalized("NFC", f) for f in first)
    assert forms_of(first) == first


def test_script_by_majority(spark):
    want = {"максимaльный": "максимальный", "οna": "ona", "φιλοσoφία": "φιλοσοφία", "vоlո": "voln", "Ꭺli": "Ali", "Ⅳ": "IV", "ве": "ве"}
    got = forms(spark, *want)
    assert [got[i].bicim for i in range(len(want))] == list(want.values())
