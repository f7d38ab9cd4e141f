import random

import pytest
from pyspark.sql import functions as F

from rivaq.llm import consensus as C

TERMS = [(6, "dereceRaw", "Sahih", "sahih"), (11, "dereceRaw", "Hasan", "hasen"), (16, "dereceRaw", "Weakly", "zayif"), (23, "dereceRaw", "Forged", "mevzu"), (27, "dereceRaw", "Mursal", "bilinmiyor")]
WORD = {"sahih": "Sahih", "hasen": "Hasan", "zayif": "Weakly", "mevzu": "Forged"}
SCHEMA = "id string, alimler array<struct<alim:string,derece:string,norm:string>>, g string, n int"


def terms(spark):
    return spark.createDataFrame(TERMS, "terim_id int, alan string, terim string, sinif string").withColumn("diger_adlar", F.array().cast("array<string>"))


def sample(n=1500, seed=1):
    """Items with graders of known quality: two experts, four of middling quality, and one who copies the poorest."""
    r = random.Random(seed)
    quality = {"Ali One": 0.95, "Veli Two": 0.9, "Orta Three": 0.7, "Orta Four": 0.7, "Kötü Five": 0.4, "Kötü Six": 0.4}
    rows, truth = [], {}
    for i in range(n):
        t = truth[f"h{i}"] = r.choice(C.CLASSES)
        given = {}
        for g in r.sample(list(quality), r.randrange(2, 5)):
            given[g] = t if r.random() < quality[g] else r.choice([c for c in C.CLASSES if c != t])
        if "Kötü Five" in given and r.random() < 0.95:
            given["Kopya Seven"] = given["Kötü Five"] if r.random() < 0.95 else r.choice(C.CLASSES)
        rows.append((f"h{i}", [(g, WORD[c], None) for g, c in given.items()], "x", 1))
    return rows, truth, {f"h{i}": 0 for i in range(n)}


@pytest.fixture(scope="module")
def fit(spark):
    rows, truth, _ = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    return df, truth, {r.id: r for r in C.consensus(df, terms(spark)).collect()}, {r.alim: r for r in C.graders(df, terms(spark)).collect()}


def test_better_than_majority(fit):
    df, truth, got, _ = fit
    plain = right = 0
    for row in df.collect():
        votes = [a.derece for a in row.alimler]
        top = max(sorted(set(votes)), key=votes.count)
        plain += top == WORD[truth[row.id]]
        right += got[row.id].derece == truth[row.id]
    assert right > plain and right / len(truth) > 0.8


def test_reliability_and_copies(fit):
    _, _, _, g = fit
    assert g["alione"].guvenilirlik > g["ortathree"].guvenilirlik > g["kotusix"].guvenilirlik
    assert all(r.alt <= r.guvenilirlik <= r.ust for r in g.values())
    assert g["kopyaseven"].asil == "kotufive" and all(r.asil is None for k, r in g.items() if k != "kopyaseven")


@pytest.mark.parametrize("source, often", [("Kötü Six", 0.95), ("Orta Three", 0.35)])
def test_copiers_of_unequal_shares(spark, source, often):
    """The second copies less than the first; where both copy the same, they do not copy each other."""
    first = {"Kötü Six": "Kötü Five", "Orta Three": "Orta Three"}[source]
    r = random.Random(3)
    quality = {"Ali One": 0.95, "Veli Two": 0.9, "Orta Three": 0.7, "Orta Four": 0.7, "Kötü Five": 0.4, "Kötü Six": 0.4}
    rows = []
    for i in range(1500):
        t, given = r.choice(C.CLASSES), {}
        for g in r.sample(list(quality), r.randrange(2, 5)):
            given[g] = t if r.random() < quality[g] else r.choice([c for c in C.CLASSES if c != t])
        for name, whom, share in (("Kopya Seven", first, 0.95), ("Kopya Eight", source, 0.7)):
            if whom in given and r.random() < often:
                given[name] = given[whom] if r.random() < share else (t if r.random() < 0.5 else r.choice(C.CLASSES))
        rows.append((f"h{i}", [(g, WORD[c], None) for g, c in given.items()], "x", 1))
    copies = C.fitted(spark.createDataFrame(rows, SCHEMA), terms(spark))[2]
    folded = {"Kötü Six": "kotusix", "Kötü Five": "kotufive", "Orta Three": "ortathree"}
    assert {(c.kopya, c.asil) for c in copies.collect()} == {("kopyaseven", folded[first]), ("kopyaeight", folded[source])}


def test_joins_give_the_same(spark, fit, monkeypatch):
    df, _, got, _ = fit
    monkeypatch.setattr(C, "GRADERS", 0)
    monkeypatch.setattr(C, "ROUNDS", 1)
    monkeypatch.setattr(C, "EARLY", 1)
    monkeypatch.setattr(C, "AT_ONCE", 50)
    a = {r.id: (r.derece, round(r.guven, 6)) for r in C.consensus(df, terms(spark)).collect()}
    monkeypatch.setattr(C, "GRADERS", 100)
    monkeypatch.setattr(C, "HELD", 3)
    assert a == {r.id: (r.derece, round(r.guven, 6)) for r in C.consensus(df, terms(spark)).collect()}


def test_dirty_opinions(spark):
    o = lambda *x: [(a, b, "bilinmiyor") for a, b in x]
    rows = [
        ("a", o(("Al-Bir", "Sahih"), ("AL BIR ", "Forged"), ("İki", "sahih."), ("Üç", "12) Sahih")), "x", 1),
        ("a", o(("Al-Bir", "Sahih"), ("AL BIR ", "Forged"), ("İki", "sahih."), ("Üç", "12) Sahih")), "x", 1),
        ("b", o(("Al-Bir", "Sahih"), ("albir", "Sahih"), ("İki", "Mursal"), ("Üç", "")), "x", 1),
        ("c", [None, (None, "Sahih", None), ("Dört", None, None)], "x", 1),
        ("d", None, "x", 1),
        ("e", [], "x", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in C.found(df, terms(spark)).collect()] == [("a", "sahih")]
    assert {(r.id, r.n) for r in C.consensus(df, terms(spark)).collect()} == {("a", 3), ("b", 1)}
    assert C.found(df.limit(0), terms(spark)).count() == 0
    assert C.agreement(df.limit(0), terms(spark)).head().alfa is None


def test_alpha_by_hand(spark):
    rows = [("a", [("x", "Sahih", None), ("y", "Sahih", None)], "", 1), ("b", [("x", "Forged", None), ("y", "Sahih", None)], "", 1), ("c", [("x", "Forged", None), ("y", "Forged", None)], "", 1)]
    r = C.agreement(spark.createDataFrame(rows, SCHEMA), terms(spark)).head()
    # coincidences: sahih-sahih 2, forged-forged 2, mixed 2; each class 3 of 6
    assert (r.deger, r.gorus) == (3, 6) and abs(r.alfa - (1 - 2 / ((36 - 18) / 5))) < 1e-9


def test_digamma(spark):
    x = [0.5, 1.0, 2.5, 10.0, 1e6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(C.digamma(F.col("x"))).collect()]
    want = [-1.9635100260214235, -0.5772156649015329, 0.7031566406452432, 2.251752589066721, 13.815510057964191]
    assert all(abs(a - b) < 1e-8 for a, b in zip(got, want, strict=True))
