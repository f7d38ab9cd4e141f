import os

import pytest
from pyspark.sql import functions as F

from rivaq.llm import langid as L

SCHEMA = "doc_id long, text string, lang string, ana string, konum int"


def test_automaton_knows_all_substrings():
    text = "abracadabra"
    step = L.automaton(text)

    def known(s):
        at = 0
        for c in s:
            if c not in step[at]:
                return False
            at = step[at][c]
        return True

    assert all(known(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1))
    assert not known("abc") and not known("z")


def test_phrases_against_plain_search():
    text, asked = "bir iki üç dört beş", ["iki bir dört", "zzz", "bir iki üç", "b", "üç dört bir iki xbeş"]
    p = L.Parser(text)

    def plain(s):
        n = i = 0
        while i < len(s):
            j = i
            while j < len(s) and s[i : j + 1] in text:
                j += 1
            i, n = max(j, i + 1), n + 1
        return n

    m = L.Model.__new__(L.Model)
    m.parser, m.right, m.order, m.bits = {"tr": p}, {"tr": False}, ["tr"], {"tr": 1.0}
    assert m.costs(asked)[:, 0].tolist() == [plain(s) for s in asked]


def test_labels(spark):
    want = {"tr": "tr", "TR": "tr", "tr-TR": "tr", "tur": "tr", "Türkçe": "tr", " English ": "en", "en_GB": "en", "deu": "de", "Deutsch": "de", "fas": "fa", "فارسی": "fa", "xx": None, "": None, "??": None, "es": None, "und": None, "IND": "id", None: None, "trabzon": None}
    df = spark.createDataFrame([(k,) for k in want], "l string").select("l", L.label_code(F.col("l")).alias("c"))
    assert {r.l: r.c for r in df.collect()} == want


def test_marks_belong_to_the_sentence_before():
    t = "Bir söz. [12] İki söz [3]. Üç."
    assert [t[a:b] for a, b in L.sentences(t)] == ["Bir söz. [12]", "İki söz [3].", "Üç."]


TR = ["Bahçıvan {} bahçede ağaçları suladı ve akşama kadar çalıştı.", "Komşular {} için uzun bir mektup yazdılar.", "Ertesi gün {} pazara gidip ekmek aldı.", "Yağmurlu bir gecede {} kapıyı açık bıraktı."]
EN = ["The gardener {} watered the trees and worked until the evening.", "The neighbours wrote a long letter for {} in the morning.", "On the next day {} went to the market and bought bread.", "On a rainy night {} left the door open."]
AR = ["ذهب {} إلى السوق في الصباح واشترى الخبز.", "كتب الجيران رسالة طويلة إلى {} في المساء.", "ترك {} الباب مفتوحا في ليلة ممطرة."]
NAMES = ["Kenmar", "Lundok", "Sapvel", "Turgal", "Birhas", "Doklam", "Rubfes", "Zerkis"]


def corpus(spark):
    rows, i = [], 0
    for label, texts in (("tr", TR), ("en", EN), ("ar", AR)):
        for n in NAMES:
            rows.append((i, " ".join(t.format(n) for t in texts), label, "x", 1))
            i += 1
    rows[3] = (3, rows[3][1], "en", "x", 1)  # a wrong label
    tr, en, ar = TR[0].format("Melnus"), EN[1].format("Melnus"), AR[0].format("Melnus")
    extra = [(f"{tr} [7] {en}\n{ar}", "tr"), (tr, None), (en, "English"), (en, "es"), (None, "tr"), (" \n", None), ("12345 ...", None), ((tr + " ") * 300, "tr-TR")]
    return spark.createDataFrame(rows + [(100 + j, t, k, "x", 1) for j, (t, k) in enumerate(extra)], SCHEMA), len(tr) + 5, len(tr) + 5 + len(en) + 1


def test_found(spark):
    df, second, third = corpus(spark)
    got = sorted(tuple(r) for r in L.found(df).collect())
    assert got == [(3, 0, "tr"), (100, 0, "tr"), (100, second, "en"), (100, third, "ar"), (101, 0, "tr"), (103, 0, "en")]
    assert all(0 <= r.guven <= 1 and 0 <= r.parca_guven <= 1 for r in L.assigned(df).collect())
    assert L.found(df.limit(0)).count() == 0 and L.found(df.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_held_out_accuracy(spark, data):
    """Fitted on documents with odd ids, held against the labels of the others: most labels are right, and most texts get them."""
    folder = data.replace("sf0.001", "sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("no larger test data here")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    rows = L.assigned(df.where("doc_id % 2 = 0"), L.fitted(df.where("doc_id % 2 = 1"))).where("parca_sayisi = 1 AND etiket IS NOT NULL").select("etiket", "ana").collect()
    assert sum(r.etiket == r.ana for r in rows) / len(rows) > 0.85


def test_folding_many_is_folding_each():
    texts = ["Kitab-ı  OKUDU, İstanbul'da [3] 12.5!", "", "مُحَمَّدٌ كَتَبَ", "Straße à Bâle https://x.y/z_1", "__a_b__", "İı", "𓀀 hiyeroglif", "日本 ٣٤", "́x", "a" * 50]
    assert L.folded_all(texts) == [L.folded(t) for t in texts]
    assert L.folded_all(texts[:6] + texts[7:]) == [L.folded(t) for t in texts[:6] + texts[7:]] and L.folded_all([]) == []
