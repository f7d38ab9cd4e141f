import random
import re
from collections import Counter

import pytest

from rivaq.llm import neardup as D

SCHEMA = "id string, tr string, ar string, h string, n int"


def share(a, b):
    x, y = Counter(re.findall(r"\w+", a.lower())), Counter(re.findall(r"\w+", b.lower()))
    return sum((x & y).values()) / max(sum(x.values()), sum(y.values())) if x and y else 0


def made(seed, n=120):
    r = random.Random(seed)
    common = [f"ortak{i}" for i in range(30)]
    name = lambda: "ad" + "".join(r.choice("bcdfgk") + r.choice("aeiou") for _ in range(4))
    texts = []
    for _ in range(n):
        words = [r.choice(common) if r.random() < 0.7 else name() for _ in range(r.randrange(30, 60))]
        texts.append(words)
        for _ in range(r.randrange(0, 4)):
            copy = list(words)
            for _ in range(r.randrange(0, max(1, len(copy) // 12))):
                i, op = r.randrange(len(copy)), r.randrange(3)
                if op == 0:
                    del copy[i]
                elif op == 1:
                    copy.insert(i, name())
                else:
                    copy[i] = name()
            if r.random() < 0.4:
                r.shuffle(copy)
            texts.append(copy)
    return [" ".join(t) for t in texts]


def test_against_all_pairs(spark):
    texts = made(2)
    df = spark.createDataFrame([(f"h{i:04}", t, None, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {tuple(r) for r in D.found(df).collect()}
    want = {(f"h{i:04}", f"h{j:04}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if share(texts[i], texts[j]) >= 0.7}
    assert want and got == want


def test_shuffled_sides(spark, monkeypatch):
    """The way beyond the broadcast bound gives the same."""
    texts = made(3, 40)
    df = spark.createDataFrame([(f"h{i:04}", t, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    a = {tuple(r) for r in D.found(df).collect()}
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    assert a == {tuple(r) for r in D.found(df).collect()}


def test_forms_nulls_and_repeats(spark):
    rows = [
        ("a", "Bir iki üç dört beş altı yedi", None, "x", 1), ("a", "Bir iki üç dört beş altı yedi", None, "x", 1), ("b", "BİR  iki, üç dört​ beş: altı «yedi»", None, "x", 1), ("c", "tek", "", "x", 1), ("d", "Tek!", "كَتَبَ", "x", 1), ("e", None, "كتب", "x", 1), ("f", "", None, "x", 1), ("g", "...", None, "x", 1),
        ("i", "aynı aynı aynı söz", None, "x", 1), ("j", "aynı söz söz söz", None, "x", 1), ("k", "bambaşka " * 20_000, None, "x", 1), ("l", "bambaşka " * 19_000, None, "x", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in D.found(df).collect()} == {("a", "b"), ("c", "d"), ("d", "e"), ("k", "l")}
    assert D.found(df.limit(0)).count() == 0


def test_hot_group_of_copies(spark):
    """A third of the rows are one text; all their pairs are wanted, and others are not lost."""
    texts = made(4, 40)
    rows = [(f"h{i:04}", t, None, "x", 1) for i, t in enumerate(texts)] + [(f"k{i:03}", "hep aynı söz burada durur", None, "x", 1) for i in range(40)]
    got = {tuple(r) for r in D.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(a[0] == b[0] == "k" for a, b in got) == 40 * 39 // 2
    want = {(f"h{i:04}", f"h{j:04}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if share(texts[i], texts[j]) >= 0.7}
    assert {x for x in got if x[0][0] == "h" and x[1][0] == "h"} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(300)}", f"n{r.randrange(300)}") for _ in range(200)] + [(f"n{i}", f"n{i + 1}") for i in range(400, 440)] + [("hub", f"s{i}") for i in range(100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: min(y for y in root if find(y) == find(x)) for x in list(root)}
    assert {r.u: r.grup for r in D.components(spark.createDataFrame(edges, "u string, v string")).collect()} == want
    assert D.components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_groups(spark):
    long = " ".join(f"kelime{i}" for i in range(40))
    rows = [("c", long, None, 1), ("a", long.replace("kelime3 ", "başka "), None, 1), ("b", long, "", 1), ("b", long, "", 1), ("d", "tek", "x y", 1), ("e", None, "x y", 1), ("f", None, None, 1), ("g", long.upper(), "z", 1), (None, long, "z", 1)]
    df = spark.createDataFrame(rows, "id string, tr string, ar string, grup int")
    got = {r.id: (r.grup, r.benzer) for r in D.groups(df, "id", ["tr", "ar"]).collect()}
    assert got == {"a": ("a", True), "b": ("a", True), "c": ("a", True), "g": ("a", True), "d": ("d", True), "e": ("d", True), "f": ("f", False)}
    assert D.groups(df.limit(0), "id", ["tr", "ar"]).count() == 0


def test_large_blocks_lose_nothing(spark, monkeypatch):
    """One block of 3,000 classes, cut into parts: the same candidates, whatever the parts, and those of sizes too far apart left out."""
    rows = [(0, 7, i, 10 + i % 200) for i in range(3000)]
    member = spark.createDataFrame(rows, "alan byte, b long, h long, n int")
    want = D._candidates(member, 0.7).count()
    assert want == sum(1 for i, a in enumerate(rows) for b in rows[i + 1 :] if min(a[3], b[3]) >= 0.7 * max(a[3], b[3]))
    for split, most in ((100, 10**6), (100, -1)):
        monkeypatch.setattr(D, "SPLIT", split)
        monkeypatch.setattr(D, "BROADCAST_ROWS", most)
        got = D._candidates(member, 0.7)
        assert got.count() == want == got.distinct().count()
