import random

from rivaq.llm import terms as T

LIST = [(1, "derece", "sahih", ["sağlam", "صحيح"]), (2, "derece", "hasen", None), (6, "dereceRaw", "Sahih", []), (9, "dereceRaw", "Isnad Sahih", ["Chain authentic"]), (16, "dereceRaw", "Da'if", ["Good"]), (23, "dereceRaw", "Mawdu", [])]


def terms(spark):
    return spark.createDataFrame(LIST, "terim_id int, alan string, terim string, diger_adlar array<string>").withColumnRenamed("x", "x")


def mapped(spark, *values, alan="dereceRaw"):
    df = spark.createDataFrame([(alan, v) for v in values], "alan string, deger string")
    return {r.deger: r.terim_id for r in T.mapped(df, terms(spark)).collect()}


def test_entries(spark):
    want = {"SAHIH": 6, " Sahih\n": 6, "12) Sahih": 6, "Hüküm: Ṣāḥīḥ": 6, "Grade - Sahih": 6, "Sahih / c.12": 6, "Sahih (bk. s. 3)": 6, "Sahih - 19": 6, "[Sahih]": 6, "S@hih": 6, "Sa1ih": 6, "Shaih": 6, "Sahi": 6, "Chian authentic": 9, "Chai nauthentcc": 9, "derecesi Isnad Sahih": 9, "Good": 16, "Gold": 0, "hood": 0, "daif": 16, "Hasat defteri": 0, "bkz. Sahil baskısı": 0, "175": 0, "-": 0, "?": 0, "(boş)": 0, "x" * 50_000: 0, "Shiah": 0}
    assert mapped(spark, *want) == want


def test_each_column_has_its_list(spark):
    assert mapped(spark, "sağlam", "saglma", "Isnad Sahih", "صحيح", alan="derece") == {"sağlam": 1, "saglma": 1, "Isnad Sahih": 0, "صحيح": 1}


def osa(a, b):
    d = {(i, j): max(i, j) if not i or not j else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_join_loses_no_slip(spark):
    """Entries with random slips against a comparison with every name."""
    r = random.Random(5)
    names = {"isnad sahih": 9, "chain authentic": 9, "mawdu": 23, "sahih": 6}
    made = set()
    for _ in range(400):
        s = list(r.choice(list(names)))
        for _ in range(r.randrange(0, 4)):
            i = r.randrange(len(s))
            op = r.randrange(4)
            if op == 0 and len(s) > 3:
                del s[i]
            elif op == 1:
                s.insert(i, r.choice("bcemn"))
            elif op == 2:
                s[i] = r.choice("bcemn")
            elif i + 1 < len(s):
                s[i], s[i + 1] = s[i + 1], s[i]
        w = "".join(s)
        if w.strip() == w and "  " not in w:
            made.add(w)
    even = lambda x: x.replace("l", "i")
    got = mapped(spark, *made)
    for w in made:
        near = {t for n, t in names.items() if osa(even(w), even(n)) <= (1 if len(n) < 8 else 2)}
        assert (got[w] in near) if near else got[w] == 0, w


def test_found(spark):
    df = spark.createDataFrame([("h1", "Sahih", "sahih", 1), ("h2", "sahih", None, 1), ("h2", "sahih", None, 1), ("h3", " ", "n/a", 1), ("h4", None, "", 1)], "id string, dereceRaw string, derece string, tuz int")
    got = sorted(tuple(r) for r in T.found(df, terms(spark)).collect())
    assert got == [("h2", "dereceRaw", 6), ("h3", "derece", 0)]
    assert T.found(df.limit(0), terms(spark)).count() == 0
    assert {r.terim_id for r in T.found(df, terms(spark).limit(0)).collect()} == {0}
