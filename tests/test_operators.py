import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivaq.operators import admission, daily, editions, encoders, grading, lexical, ranks, vector, verify
from rivaq.sources import readers


def test_dense_numbers(spark):
    df = spark.range(1000).withColumn("x", F.xxhash64("id")).repartition(7)
    rows = ranks.dense_numbers(df, [F.col("x")], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1000)) and [r.x for r in rows] == sorted(r.x for r in rows)


def test_last_wins(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 5, "c")], "k int, pos int, v string")
    assert {(r.k, r.v) for r in ranks.last_wins(df, ["k"], F.col("pos")).collect()} == {(1, None), (2, "c")}


def brute_windows(calls, length, limit):
    out, state = {}, {}
    for t, i, ip in sorted(calls):
        begin, n = state.get(ip, (None, 0))
        if begin is None or t > begin + length:
            begin, n = t, 0
        state[ip] = begin, n + 1
        out[i] = begin, n + 1, n + 1 > limit
    return out


@pytest.mark.parametrize("seed", range(4))
def test_anchored_windows(spark, seed):
    r = random.Random(seed)
    calls = [(r.randrange(0, 5 * 86400) if r.random() < 0.7 else r.choice([0, 3600, 3601, 86400, 86399, 90000]), i, r.choice("abc" if i % 3 else "a")) for i in range(300)]
    df = spark.createDataFrame(calls, "s long, i long, ip string").withColumn("ts", F.timestamp_seconds("s"))
    got = {x.sira: (x.bas // 10**6, x.sayi, x.asildi) for x in admission.anchored(df, "ip", "ts", "i", limit=7).collect()}
    assert got == brute_windows(calls, 3600, 7)


def test_hot_caller_is_many_tasks(spark):
    """One caller makes half of all calls, many in one minute: ranges and minutes divide it, and the numbers are those of one pass."""
    r = random.Random(9)
    calls = [(r.randrange(0, 7 * 86400) if r.random() < 0.8 else 3600 * 30 + r.randrange(60), i, "hot" if i % 2 else f"c{r.randrange(200)}") for i in range(6000)]
    df = spark.createDataFrame(calls, "s long, i long, ip string").withColumn("ts", F.timestamp_seconds("s"))
    got = {x.sira: (x.bas // 10**6, x.sayi, x.asildi) for x in admission.anchored(df, "ip", "ts", "i", limit=7).collect()}
    assert got == brute_windows(calls, 3600, 7)
    ranges = {(ip, s // (admission.RANGE * 3600)) for s, _, ip in calls if ip == "hot"}
    assert len(ranges) > 30  # each a task's work of its own


def test_anchored_boundary_and_nulls(spark):
    df = spark.createDataFrame([(0, 1, None), (3600, 2, None), (3601, 3, None), (None, 4, "a")], "s long, i long, ip string").withColumn("ts", F.timestamp_seconds("s"))
    got = {x.sira: (x.anahtar, x.bas // 10**6, x.sayi) for x in admission.anchored(df, "ip", "ts", "i").collect()}
    assert got == {1: ("x", 0, 1), 2: ("x", 0, 2), 3: ("x", 3601, 1)}
    assert admission.anchored(df.limit(0), "ip", "ts", "i").count() == 0


def test_daily_numbers(spark):
    df = spark.createDataFrame([(1, "c", "2024-01-01 23:59:59"), (2, "c", "2024-01-02 00:00:00"), (3, "c", "2024-01-01 10:00:00")], "i long, c string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert {(r.i, r.sayi, r.kalan) for r in admission.daily_numbers(df, "c", "t", "i", 1).collect()} == {(3, 1, 0), (1, 2, 0), (2, 1, 0)}


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([("a", "elma armut elma", "sahih"), ("b", "elma", "bilinmiyor"), ("c", None, "sahih"), ("d", "elma", "sahih")], "id string, tr string, derece string")
    index = lexical.build(df, "id", "tr")
    hits = lexical.search(index, df, spark.createDataFrame([("q", "elma armut armut"), ("n", "ve")], "qid string, text string"), 8).orderBy("sira").collect()
    n, avg = 4, 5 / 4
    idf = lambda k: np.log(1 + (n - k + 0.5) / (k + 0.5))
    gain = lambda f, size: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * size / avg))
    a, b = idf(3) * gain(2, 3) + 2 * idf(1) * gain(1, 3), idf(3) * gain(1, 1)
    assert [(h.id, h.skor) for h in hits] == [("a", round(a, 2)), ("d", round(b, 2)), ("b", round(b * 0.92, 2))]
    wider = lexical.search(index, df, spark.createDataFrame([("q", "muz")], "qid string, text string"), 1, expand=lambda q: q.withColumn("text", F.concat("text", F.lit(" armut"))))
    assert [h.id for h in wider.collect()] == ["a"]
    few = lexical.scores(index, spark.createDataFrame([("q", "elma armut armut")], "qid string, text string")).collect()
    assert {h.id: round(h.skor, 6) for h in few} == {"a": round(a, 6), "d": round(b, 6), "b": round(b, 6)}
    assert lexical.search(index, df.limit(0), spark.createDataFrame([("q", "elma")], "qid string, text string"), 8).count() == 0


def test_verify(spark):
    docs = [(f"h{i}", " ".join(f"kelime{i}x{j}" for j in range(12)), "sahih") for i in range(30)]
    df = spark.createDataFrame(docs, "id string, tr string, derece string")
    asked = spark.createDataFrame([("var", docs[3][1]), ("az", "kelime5x1"), ("yok", "bambaşka")], "qid string, text string")
    got = {r.qid: (r.bulundu, r.id) for r in verify.verify(lexical.build(df, "id", "tr"), df, asked).collect()}
    assert got == {"var": (True, "h3"), "az": (False, None)}


def test_lexical_blocks_and_slices(spark, monkeypatch):
    """Small blocks and several slices of the query set give what one block gives."""
    r = random.Random(4)
    words = [f"kelime{chr(97 + i)}" for i in range(26)]
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(r.choices(words, k=r.randrange(0, 12))), "sahih") for i in range(200)], "id string, tr string, derece string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(r.choices(words, k=5))) for i in range(30)], "qid string, text string")
    index = lexical.build(docs, "id", "tr")
    want = sorted(map(tuple, lexical.search(index, docs, asked, 6).collect()))
    for name, value in (("ROWS", 7), ("ASKED", 4), ("HELD", 40), ("WORDS", -1)):
        monkeypatch.setattr(lexical, name, value)
    assert sorted(map(tuple, lexical.search(index, docs, asked, 6).collect())) == want and len(want) > 150
    assert lexical.search(index, docs, asked.limit(0), 6).count() == 0


def test_search_scores_few_pairs(monkeypatch):
    """Of queries in common words, only few pairs with documents are scored one by one; the best are those of all pairs, ties to the smaller id."""
    r, k, n_docs, n_terms = random.Random(7), 4, 3000, 60
    docs = [r.choices(range(n_terms), k=r.randrange(1, 20)) + [1000 + i % 300] * (i % 3) for i in range(n_docs)]
    docs[1500:1560] = [docs[3]] * 60
    asked = [r.sample(range(n_terms), r.randrange(1, 7)) + r.choices(range(1000, 1320), k=i % 3) for i in range(200)] + [[5, 9, 5], [1007], [77777], docs[3]]
    n = {t: sum(t in set(d) for d in docs) for t in {t for d in docs for t in d}}
    avg = sum(map(len, docs)) / n_docs
    lists = [sorted({t: q.count(t) for t in q}.items()) for q in asked]
    longs = pa.list_(pa.int64())
    monkeypatch.setattr(lexical, "COMMON", 100)
    table = pa.table({"k": [f"q{i}" for i in range(len(asked))], "t": pa.array([[t for t, _ in x] for x in lists], longs), "f": pa.array([[float(f) for _, f in x] for x in lists], pa.list_(pa.float64()))})
    plan = lexical._plan(table, pa.table({"t": pa.array(n, pa.int64()), "n": pa.array(n.values(), pa.int64())}), n_docs, avg)
    assert plan["common"] >= n_terms and len(plan["rare"][0]) > 0
    rows = pa.record_batch({"id": [f"d{i:04}" for i in range(n_docs)], "len": [len(d) for d in docs], "carpan": [0.92 if i % 5 == 0 else 1.0 for i in range(n_docs)], "t": pa.array(docs, longs)})
    want = {}
    for i, x in enumerate(lists):
        s = [0.0] * n_docs
        for t, f in x:
            for j, d in enumerate(docs):
                if c := d.count(t):
                    s[j] += f * np.log(1 + (n_docs - n[t] + 0.5) / (n[t] + 0.5)) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(d) / avg)) * (0.92 if j % 5 == 0 else 1)
        best = sorted((-round(v, 9), f"d{j:04}") for j, v in enumerate(s) if v > 0)[:k]
        want |= {f"q{i}": best} if best else {}
    scored, plain = [], lexical._common_score
    monkeypatch.setattr(lexical, "_common_score", lambda plan, dense, g, d: scored.append(len(g)) or plain(plan, dense, g, d))
    for how in ({}, {"ROWS": 700, "FIRST": 50, "DEEP": 2, "ASKED": 90, "SENT": 7}):
        for name, value in how.items():
            monkeypatch.setattr(lexical, name, value)
        scored.clear()
        got = {x["qid"]: [(round(y["eksi"], 9), y["id"]) for y in x["v"]] for batch in lexical._searched(plan, k, iter([rows.slice(0, 1100), rows.slice(1100)])) for x in batch.to_pylist()}
        assert got == want
        assert sum(scored) < 0.03 * len(asked) * n_docs


def test_vector_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "ROWS", 17)
    monkeypatch.setattr(vector, "ASKED", 3)
    monkeypatch.setattr(vector, "HELD", 30)  # several slices of the query set
    m = np.random.default_rng(1).normal(size=(100, 8)).astype(np.float32)
    m[7] = m[8]
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(100)], "vec_id long, embedding array<float>")
    got = vector.search(df, df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), 5).collect()
    s = np.round(m.astype(float) @ m.astype(float).T, 9)
    want = {(q, r + 1): int(i) for q in range(0, 100, 10) for r, i in enumerate(np.lexsort((np.arange(100), -s[q]))[:5])}
    assert {(r.qid, r.sira): r.id for r in got} == want


def test_graded_corpus(spark, tmp_path):
    def put(name, rows):
        (tmp_path / f"{name}.json").write_text(json.dumps({"hadiths": rows}))

    long = "Bu söz yeterince uzun bir sözdür "
    put("tur-bir", [{"hadithnumber": 1, "text": f" {long}1 "}, {"hadithnumber": 2, "text": "kısa kısa kısa kısa"}, {"hadithnumber": 2.5, "text": long + "2"}, {"hadithnumber": 3, "text": "x" * 20}])
    put("ara-bir", [{"hadithnumber": 1, "text": "ا"}, {"hadithnumber": 1, "text": "ب"}])
    put("eng-bir", [{"hadithnumber": 1, "text": " one ", "grades": [{"name": "Zubair Ali", "grade": "Da'if"}, {"name": "Al-Albani", "grade": "Hasan Sahih"}, {"name": None, "grade": "x"}]}, {"hadithnumber": 2.5, "text": "two", "grades": [None, {"name": "A", "grade": ""}]}])
    put("tur-iki", [{"hadithnumber": 1, "text": long + "[Buhari]"}, {"hadithnumber": 2, "text": long + "[Tirmizi]"}])
    put("tur-dort", [{"hadithnumber": 9, "text": long}])
    books = [{"id": "bir", "tr": "Birinci", "kisaTr": "Bir"}, {"id": "iki", "tr": "İkinci", "kisaTr": "İki", "parantez": True}, {"id": "uc", "tr": "Üçüncü", "kisaTr": "Üç"}, {"id": "dort", "tr": "Dördüncü", "kisaTr": "Dört", "hepSahih": True}]
    rows = editions.graded_corpus(books, lambda e: readers.sayings_edition(spark, str(tmp_path / f"{e}.json"))).orderBy("id").collect()
    assert [(r.id, r.kaynak, r.derece, r.ar, r.en) for r in rows] == [("h0", "Bir 1", "sahih", "ب", "one"), ("h1", "Bir 2.5", "bilinmiyor", "", "two"), ("h2", "Bir 3", "bilinmiyor", "", ""), ("h3", "İki 1", "sahih", "", ""), ("h4", "İki 2", "bilinmiyor", "", ""), ("h5", "Dört 9", "sahih", "", "")]
    assert rows[0].dereceRaw == "Hasan Sahih" and [a.alim for a in rows[0].alimler] == ["Zubair Ali", "Al-Albani", "Kaynak"] and rows[1].alimler == []
    assert rows[4].dereceRaw == "Kaynak: Tirmizi" and rows[3].dereceRaw == "Sahih (Buhari)"


def test_verse_corpus(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(json.dumps(body))
        return str(tmp_path / name)

    tr = readers.verses_edition(spark, put("tr.json", {"quran": [{"chapter": 1, "verse": 1, "text": "t1"}, {"chapter": 2, "verse": 1, "text": "t2"}]}))
    en = readers.verses_edition(spark, put("en.json", {"quran": [{"chapter": 1, "verse": 1, "text": "e1"}]}))
    info = readers.chapter_info(spark, put("info.json", {"chapters": [{"chapter": 1, "name": "AL-Ilk", "arabicname": "ا", "revelation": "Mecca", "verses": [{"verse": 1, "page": 0, "juz": 1}]}]}))
    assert readers.verses_edition(spark, str(tmp_path / "no.json"), optional=True) is None
    assert readers.sayings_edition(spark, str(tmp_path / "no.json")) is None
    rows = editions.verse_corpus(tr, en, en, None, info, ["Bir"]).orderBy("id").collect()
    assert [(r.id, r.kaynak, r.kaynakEn, r.en, r.sayfa, r.cuz, r.okunus) for r in rows] == [("k0", "Bir 1", "Al-Ilk 1", "e1", None, 1, ""), ("k1", "Sure 2 1", "Surah 2 1", "", None, None, "")]
    assert [tuple(r) for r in editions.chapters(info, []).collect()] == [(1, "AL-Ilk", "ا", "Mekke", 1)]


def test_float_matrix_round_trip(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(50, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(50)], "pos long, v array<float>")
    path = str(tmp_path / "v.f32")
    readers.write_float_matrix(df.repartition(5), "v", path)
    back = readers.float_matrix(spark, path, 6).orderBy("pos").collect()
    assert np.array_equal(np.array([r.v for r in back], np.float32), m)


def test_localized_links(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.woff2").write_bytes(b"x")
    (tmp_path / "s.css").write_text("src: url(https://h/p/a.woff2); again url(https://h/p/a.woff2)")
    names, css = readers.localized_links(spark, str(tmp_path / "s.css"), str(tmp_path / "f"))
    name = names.head().ad
    assert css == f"src: url(fonts/{name}); again url(fonts/{name})" and len(name) == 18
    assert readers.listing(spark, str(tmp_path / "f")).count() == 1


def test_histogram_view_and_picks(spark):
    df = spark.createDataFrame([("h1", "sahih", "x" * 50, None), ("h2", "tuhaf", "kısa", "short")], "id string, derece string, tr string, en string")
    assert {tuple(r) for r in editions.histogram(df, "derece", ["sahih", "mevzu"]).collect()} == {("sahih", 1), ("mevzu", 0)}
    assert [(r.metin, r.dereceEtiket) for r in grading.graded_view(df, "en").orderBy("id").collect()] == [("x" * 50, "Sahih (Authentic)"), ("short", "Grade unclear")]
    days = spark.createDataFrame([("2024-01-01",), ("2024-12-31",)], "g string").select(F.col("g").cast("date").alias("gun"))
    verses = spark.createDataFrame([("k9", 94, 5)], "id string, sure int, ayet int")
    got = {str(r.gun): (r.ayet_id, r.hadis_id) for r in daily.picks(days, verses, df).collect()}
    assert got == {"2024-01-01": ("k9", "h1"), "2024-12-31": (None, "h1")}
    assert daily.picks(days, verses, df.limit(0)).where("hadis_id IS NULL").count() == 2


def test_observed_figures(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", None, "sahih"), ("b", "", "y", "bilinmiyor")], "id string, ar string, en string, derece string")
    out, seen = editions.observed(df)
    readers.write_records(out, str(tmp_path / "o"), as_json=True)
    readers.write_records(df, str(tmp_path / "o"))
    assert seen.get == {"n": 2, "arapcasiz": 1, "ingilizcesiz": 1, "belirsiz": 1} and spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_encoder_batches(spark):
    df = spark.createDataFrame([(f"a{i}", "su taşı" if i % 2 else None) for i in range(10)], "id string, t string")
    rows = encoders.encoded(df, "id", F.col("t")).collect()
    assert len(rows) == 10 and all(abs(np.linalg.norm(r.v) - (int(r.id[1:]) % 2)) < 1e-6 for r in rows)


def test_encoder_takes_whole_texts(spark):
    long = "su taşı " * 100 + "kitap"
    df = spark.createDataFrame([("a", long), ("b", "su"), ("c", "x" * 1200), ("d", None)], "id string, t string")
    texts, encode = {r.id: r.t or "" for r in df.collect()}, encoders.hashing_encoder()
    got = {r.id: r.v for r in encoders.encoded(df, "id", F.col("t")).collect()}
    assert all(np.allclose(got[k], encode([t])[0], atol=1e-6) for k, t in texts.items())
    assert not np.allclose(got["a"], encode([long[:500]])[0], atol=1e-3)
    assert all("".join(encoders.windows(t, 50)) == t and max(map(len, encoders.windows(t, 50))) <= 50 for t in texts.values())
    parts = {r.id: r.v for r in encoders.encoded(df, "id", F.col("t"), longest=50).collect()}
    mean = sum(len(w) * encode([w])[0] for w in encoders.windows(long, 50))
    assert np.allclose(parts["a"], mean / np.linalg.norm(mean), atol=1e-6) and np.allclose(parts["b"], got["b"]) and not np.any(parts["d"])


def test_encode_texts_gives_both_languages(spark, data):
    from rivaq.registry import queries

    got = {(r.id, r.dil): r.v for r in queries()["encode_texts"](spark, data).collect()}
    corpus = {r.id: r for r in spark.read.parquet(f"{data}/corpus.parquet").collect()}
    assert set(got) == {(k, dil) for k in corpus for dil in ("tr", "en")}
    encode = encoders.hashing_encoder()
    assert all(np.allclose(v, encode([corpus[k][dil] or corpus[k].tr or ""])[0], atol=1e-6) for (k, dil), v in got.items())


def test_vectors_belong_to_rows(spark):
    rows, v = spark.createDataFrame([("b",), ("a",)], "id string"), spark.createDataFrame([(0, [1.0]), (1, [2.0])], "pos long, v array<float>")
    assert {(r.id, r.v[0]) for r in vector.aligned(rows, "id", v, "pos", "v").collect()} == {("a", 1.0), ("b", 2.0)}
    with pytest.raises(ValueError, match="2 rows but 1 vectors"):
        vector.aligned(rows, "id", v.where("pos = 0"), "pos", "v")
    assert vector.aligned(rows, "id", v.where("pos = 0"), "pos", "v", strict=False).count() == 1


def test_views_in_full(spark):
    rel = editions.search_relation(
        spark.createDataFrame([("h1", "söz", None, "mevzu", "K 1")], "id string, tr string, en string, derece string, kaynak string"),
        spark.createDataFrame([("yaygın", "mevzu", "Kitap, s. 3", "Kendi açıklaması")], "metin string, derece string, referans string, aciklama string"),
    )
    got = {r.id: r for r in grading.graded_view(rel, "en").collect()}
    assert got["h1"].dereceAnlam == grading.GRADES[3][5] and not got["h1"].mevzuat and got["h1"].referans is None
    assert got["m0"].dereceAnlam == "Kendi açıklaması" and got["m0"].kaynak == "Halk arasında yaygın söz" and got["m0"].referans == got["m0"].dereceRaw == "Kitap, s. 3" and got["m0"].alimler == []
    days = spark.createDataFrame([("2024-01-01",)], "g string").select(F.col("g").cast("date").alias("gun"))
    verses = spark.createDataFrame([("k9", 94, 5, "A 5", "B 5", "ا", "o", "t", "")], "id string, sure int, ayet int, kaynak string, kaynakEn string, ar string, okunus string, tr string, en string")
    corpus = spark.createDataFrame([("h1", "sahih", "x" * 50, "y", "a", "K 1")], "id string, derece string, tr string, en string, ar string, kaynak string")
    one = daily.view(days, verses, corpus, "en").head()
    assert (one.ayet.kaynak, one.ayet.tr, one.hadis.tr, one.hadis.dereceEtiket) == ("B 5", "t", "y", "Sahih (Authentic)")
    none = daily.view(days, verses.limit(0), corpus.limit(0)).head()
    assert none.ayet is None and none.hadis is None


def test_topics_with_and_without_vectors(spark, tmp_path):
    docs = spark.createDataFrame([("a", "elma", "sahih"), ("b", "armut", "sahih")], "id string, tr string, derece string")
    asked, index = spark.createDataFrame([("q", "elma")], "qid string, text string"), lexical.build(docs, "id", "tr")
    assert readers.optional_float_matrix(spark, str(tmp_path / "none.f32"), 4) is None
    assert [r.id for r in lexical.topics(index, docs, asked, 5, None).collect()] == ["a"]
    assert [r.id for r in lexical.topics(index, docs, asked, 5, lambda q, k: q.selectExpr("qid", "1 AS sira", "'b' AS id", "1D AS skor")).collect()] == ["b"]


def test_only_listed_paths(spark):
    from rivaq.functions import text as X

    want = {"/": "/hadis.html", "/gizlilik": "/gizlilik.html", "/fonts/a-1.woff2": "/fonts/a-1.woff2", "/fonts/../x": None, "/api/konu": None, None: None, "/hadis.html": "/hadis.html"}
    df = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r.p: r.f for r in df.select("p", X.served(F.col("p")).alias("f")).collect()} == want
