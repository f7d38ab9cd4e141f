import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rivaq.llm import mixing as X
from rivaq.llm import packing as P
from rivaq.llm import tokens as K

needs = pytest.mark.skipif(not os.path.exists(os.path.join(K.FOLDER, K.VOCABULARY)), reason="no vocabulary files here")
DOCS = "doc_id long, text string, source string, n int, boy int"


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 200), max_size=12))))
def test_plan_packs_everything(case):
    capacity, counts = case
    patterns = P.plan(counts, capacity)
    left = dict.fromkeys(counts, 0)
    for m, content in patterns:
        assert m > 0 and 0 < sum(s * n for s, n in content.items()) <= capacity
        assert sum(n for s, n in content.items() if s > capacity / 3) <= 2
        for s, n in content.items():
            left[s] += m * n
    assert left == counts
    total = sum(s * n for s, n in counts.items())
    # two containers at most half full would have been one
    assert sum(m for m, _ in patterns) <= 2 * total / capacity + 1


def rows(spark, seed=1, n=200):
    r = random.Random(seed)
    texts = [" ".join(r.choice(["su", "taş", "kitap", "güneş", "yol"]) for _ in range(r.choice([3, 40, 200, 900]))) for _ in range(n)]
    texts += [None, "", texts[0], "uzun " * 5000]
    return spark.createDataFrame([(i, t, r.choice("aaaabbc"), 7, 7) for i, t in enumerate(texts)], DOCS)


@needs
def test_packed(spark):
    df = rows(spark)
    kinds = spark.createDataFrame([("k", 64), ("b", 1000), ("b", 1000), ("yok", 0), (None, 5)], "container string, capacity_tokens int")
    sizes = {r.doc_id: r.n for r in K.sized(df, ["doc_id"]).collect()}
    assert len(sizes) == df.count() - 2
    got = P.packed(df, kinds).collect()
    for c, cap in (("k", 64), ("b", 1000)):
        mine = [r for r in got if r.container == c]
        assert {r.kutu for r in mine} == set(range(max(r.kutu for r in mine) + 1))
        fill, parts = {}, {}
        for r in mine:
            fill[r.kutu] = fill.get(r.kutu, 0) + r.adet
            parts.setdefault(r.doc_id, []).append((r.bas, r.adet))
        assert max(fill.values()) <= cap
        for d, n in sizes.items():
            spans = sorted(parts[d])
            assert sum(a for _, a in spans) == n and all(x[0] + x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
            assert len(spans) == max(1, -(-n // cap))
    u = {r.container: r for r in P.usage(P.packed(df, kinds), kinds).collect()}
    assert u["b"].doluluk > 0.95 and u["b"].belirtec == sum(sizes.values())
    assert P.packed(df.limit(0), kinds).count() == 0 and P.packed(df, kinds.limit(0)).count() == 0


@needs
def test_round_trip_of_tokens():
    e = K.encoding(os.path.join(K.FOLDER, K.VOCABULARY))
    for t in ("İyi günler!  iki", "صبر جميل", "a\n\n b", "<|endoftext|>"):
        assert e.decode(e.encode_ordinary(t)) == t


@needs
def test_running_sums(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "a" if i % 3 else "b", i % 5) for i in range(300)], "i long, g string, v int")
    got = K.running(df, ["g"], F.xxhash64("i"), "i", F.col("v"), "once").withColumn("h", F.xxhash64("i")).collect()
    for g in "ab":
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.h, r.i)):
            assert r.once == total
            total += r.v


@needs
def test_mixture(spark):
    df = rows(spark, 2, 400)
    goals = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.19, 3), ("yok", 0.01, 2), ("a", 0.1, 1), (None, 0.5, 1), ("d", None, 1)], "source string, target_share double, max_repeat int")
    mix = X.mixed(df, goals).collect()
    size = {}
    for r in mix:
        size[r.yer] = size.get(r.yer, 0) + r.adet
    assert set(size) == set(range(len(size))) and len(set(size.values())) == 1
    rep = {r.source: r for r in X.report(df, goals).collect()}
    for s, p in (("a", 0.5), ("b", 0.3), ("c", 0.19)):
        assert abs(rep[s].ulasilan - p / 0.99) < 0.01 and rep[s].kullanim <= rep[s].max_repeat
    assert rep["yok"].belirtec == 0
    whole = {r.doc_id: r.n for r in K.sized(df, ["doc_id"]).collect()}
    use = {}
    for r in mix:
        use.setdefault((r.source, r.tekrar), {}).setdefault(r.doc_id, []).append((r.bas, r.adet))
    for (s, t), docs in use.items():
        for d, spans in docs.items():
            spans.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][0] + spans[-1][1] <= whole[d]
        if (s, t + 1) in use:  # a repetition begins only when all texts of the source are used
            assert sum(n for v in docs.values() for _, n in v) == rep[s].mevcut
    big = {r.source: r for r in X.report(df, goals, total=10**6).collect()}
    assert all(r.kullanim is None or r.kullanim <= r.max_repeat for r in big.values())
    assert X.mixed(df.limit(0), goals).count() == 0 and X.mixed(df, goals.limit(0)).count() == 0


@pytest.mark.parametrize("have", [[("a", 0.9, 1, 1000), ("b", 0.1, 1, 3)], [("a", 0.5, 2, 40_000), ("b", 0.3, 1, 90_000), ("c", 0.2, 3, 7_000), ("yok", 0.1, 1, 0)], [("a", 1.0, 2, 5)]])
def test_the_total_is_the_largest(have):
    block, n, able = X._slots(have, None)

    def fits(n):
        used = dict.fromkeys((g[0] for g in able), 0)
        for i in range(n):
            x, edge, at = i * X.GOLDEN - int(i * X.GOLDEN), 0.0, able[-1][0]
            for s, w, _, _ in able[:-1]:
                edge += w
                if x < edge:
                    at = s
                    break
            used[at] += 1
        return all(used[s] <= most for s, _, _, most in able)

    assert n > 0 and fits(n) and not fits(n + 1)
