"""BM25 over an inverted index kept as tables: postings, lengths, term statistics.

The words of each text are cut out once and written, without a shuffle; all searches read that table. A search keeps only
the words it asks for, before anything is counted or shuffled. The statistics cover all documents, empty ones too,
whatever the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rivaq.functions import text as X
from rivaq.session import saved, shipped, spread

K1, B, PENALTY = 1.5, 0.75, 0.92
#: Documents in a block; pairs of query and document scored at once; words of queries that go to every task at once.
ROWS, ASKED, HELD = 32_768, 1_000_000, 2_000_000
#: A word in more than one of COMMON documents is common, of the HEADS that are in most; weights of common words in a block at most (12 bytes each).
COMMON, HEADS, CELLS = 500, 1024, 10_000_000
#: Documents of a block that give a first bound; words whose sums are kept for the next query; queries sent back at once.
FIRST, DEEP, SENT = 1024, 12, 50_000
#: Documents of a task, at least and at most, where cores allow; different words of queries that are looked for in a text one by one.
LEAST, MOST, FEW = 4096, 2_000_000, 200


#: Different words of all queries that are broadcast (some 50 bytes each); more are joined by a shuffle.
WORDS = 1_000_000


@dataclass
class Index:
    words: DataFrame  # id, len, t (the words of a text, repeats kept)

    @property
    def postings(self) -> DataFrame:
        """id, term, f, len"""
        return counted(self.words.select("id", "len", F.explode("t").alias("term")))

    @property
    def terms(self) -> DataFrame:
        """term, n (documents that hold it)"""
        return self.words.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))

    @property
    def stats(self) -> DataFrame:
        """one row: n_docs, total_len, avg_len"""
        sums = self.words.agg(F.count("*").alias("n_docs"), F.sum(F.col("len").cast("long")).alias("total_len"))
        return sums.withColumn("avg_len", F.try_divide(F.col("total_len").cast("double"), F.col("n_docs")))


def counted(words: DataFrame) -> DataFrame:
    return words.groupBy("id", "term", "len").agg(F.count("*").alias("f")).select("id", "term", "f", "len")


def build(df: DataFrame, key: str, column: str, keep: bool = True) -> Index:
    """The index of a text column; the words are written to the shared folder unless keep is false."""
    words = spread(df.select(F.col(key).alias("id"), F.col(column).alias("metin"))).select("id", X.tokens(F.col("metin")).alias("t")).select("id", F.size("t").alias("len"), "t")
    return Index(saved(words, "words") if keep else words)


def _weighed(index: Index, asked: DataFrame) -> DataFrame:
    """id, term, w: the gain of each posting of the words asked for."""
    wanted = asked.select("term").distinct()
    small = wanted.count() <= WORDS
    hits = index.words.select("id", "len", F.explode("t").alias("term")).join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
    hits = saved(counted(hits), "hits")  # read for the documents of each word, and for the gains
    total = index.stats.select(F.struct("n_docs", "avg_len")).scalar()
    idf = hits.groupBy("term").agg(F.count("*").alias("n")).withColumn("s", total).select("term", F.log(1 + (F.col("s.n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf"), F.col("s.avg_len").alias("avg_len"))
    gain = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hits.join(F.broadcast(idf) if small else idf, "term").select("id", "term", (F.col("idf") * gain).alias("w"))


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """qid, id, skor: queries (qid, text) against all documents that share a term. A repeated query word counts again."""
    asked = saved(_asked(queries), "asked")
    return _weighed(index, asked).join(asked, "term").groupBy("qid", "id").agg(F.sum(F.col("qf") * F.col("w")).alias("skor"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qf"))


def _plan(lists: pa.Table, vocab: pa.Table, n_docs: int, avg_len: float | None) -> dict:
    """Queries (k, t: terms, f: their counts) as groups of equal common words and a list of rarer words; vocab: t, n.

    Groups are ordered so that neighbours share their first words, share of them.
    """
    vocab = vocab.sort_by("t")
    terms, n = vocab["t"].to_numpy(), vocab["n"].to_numpy()
    t, f = (np.concatenate([np.empty(0, kind), *(c.flatten().to_numpy() for c in lists[x].chunks)]) for x, kind in (("t", np.int64), ("f", np.float64)))
    lengths = np.concatenate([np.empty(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in lists["t"].chunks)])
    asked, at = np.repeat(np.arange(len(lengths)), lengths), np.searchsorted(terms, t)
    known = at < len(terms)
    known[known] = terms[at[known]] == t[known]
    asked, at, f = asked[known], at[known], f[known]
    uses = np.bincount(at, minlength=len(terms))
    common = np.argsort(-n, kind="stable")[:HEADS]
    common = common[n[common] * COMMON > n_docs]
    common = common[np.argsort(-uses[common], kind="stable")]
    number = np.full(len(terms), -1)
    number[common] = np.arange(len(common))
    heads = number[at] >= 0
    order = np.lexsort((number[at[heads]], asked[heads]))
    q, c, w = asked[heads][order], number[at[heads]][order], f[heads][order]
    cuts = np.searchsorted(q, np.arange(len(lengths) + 1)).tolist()
    words = list(zip(c.tolist(), w.tolist(), strict=True))
    own = [tuple(words[i:j]) for i, j in pairwise(cuts)]
    groups = sorted(set(own) - {()})
    place = {x: i for i, x in enumerate(groups)} | {(): -1}
    share = [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in pairwise([(), *groups])]
    return {
        "qid": lists["k"].combine_chunks(), "term": terms, "number": number, "avg": avg_len, "idf": np.log(1 + (n_docs - n + 0.5) / (n + 0.5)), "common": len(common),
        "c": np.array([c for g in groups for c, _ in g], np.int64), "f": np.array([f for g in groups for _, f in g], np.float64), "start": np.cumsum([0, *map(len, groups)]), "share": share,
        "group": np.array([place[x] for x in own], np.int64), "rare": (asked[~heads], at[~heads], f[~heads]),
    }


def _weights(plan: dict, block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """term (its place), document (its row) and weight of each posting of a block, by terms."""
    lists = block["t"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    row, words = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    at = np.searchsorted(plan["term"], words)
    known = at < len(plan["term"])
    known[known] = plan["term"][at[known]] == words[known]
    pair, f = np.unique(at[known] * len(lists) + row[known], return_counts=True)
    term, row = np.divmod(pair, max(1, len(lists)))
    length = block["len"].to_numpy()[row]
    gain = f * (K1 + 1) / (f + K1 * (1 - B + B * length / plan["avg"])) if len(pair) else np.empty(0)
    return term, row, plan["idf"][term] * gain * block["carpan"].to_numpy()[row]


def _kept(k: int, *found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (number, document, score) of each number; a document counts once, with its highest score; ties to the earlier document."""
    q, d, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-s, d, q))
    q, d, s = q[order], d[order], s[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (d[1:] != d[:-1])
    q, d, s = q[once], d[once], s[once]
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    best = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[best], d[best], s[best]


def _common_score(plan: dict, dense: np.ndarray, g: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Score of documents d by the common words of groups g (-1: none)."""
    s, at, first = np.zeros(len(g)), np.flatnonzero(g >= 0), 0
    while len(at):
        word = plan["start"][g[at]] + first
        inside = word < plan["start"][g[at] + 1]
        at, word, first = at[inside], word[inside], first + 1
        s[at] += plan["f"][word] * dense[plan["c"][word], d[at]]
    return s


def _candidates(plan: dict, dense: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups and documents that may be among the k best by common words; least: what is known of each group's k-th score, raised here.

    Sums are in single precision, so whatever could reach the bound within their error is a candidate.
    """
    rows, n = dense.astype(np.float32), dense.shape[1]
    sums = np.zeros((DEEP + 2, n), np.float32)
    c, f, start, g, d, held = plan["c"].tolist(), plan["f"].tolist(), plan["start"].tolist(), [], [], 0
    for i, shared in enumerate(plan["share"]):
        size = start[i + 1] - start[i]
        for j in range(min(shared, DEEP), size):
            word = start[i] + j
            own = rows[c[word]] if f[word] == 1 else rows[c[word]] * np.float32(f[word])
            np.add(sums[min(j, DEEP + 1)], own, out=sums[min(j, DEEP) + 1])
        s = sums[min(size, DEEP + 1)]
        error = 1 - 4e-7 * (size + 3)
        bound = least[i]
        if bound <= 0 and n > FIRST > k:
            bound = np.partition(s[:FIRST], FIRST - k)[FIRST - k] * error - 2e-9
        found = np.flatnonzero(s >= np.float32(bound)) if bound > 0 else np.flatnonzero(s)
        if len(found) > k:
            v = s[found]
            bound = np.partition(v, len(v) - k)[len(v) - k] * error - 2e-9
            found = found[v >= np.float32(bound)]
            least[i] = max(least[i], bound)
        if len(found):
            g.append(np.full(len(found), i))
            d.append(found)
            held += len(found)
        if held >= ASKED:
            yield np.concatenate(g), np.concatenate(d)
            g, d, held = [], [], 0
    if g:
        yield np.concatenate(g), np.concatenate(d)


def _rarely(plan: dict, dense: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, document and score of all documents that hold one of a query's rarer words."""
    term, row, w = postings
    q, t, f = plan["rare"]
    n = dense.shape[1]
    a, b = np.searchsorted(term, t, side="left"), np.searchsorted(term, t, side="right")
    # pieces end between queries, so that all words of a query meet
    ends = np.flatnonzero(np.diff(q, append=-1)) + 1
    total = np.cumsum(b - a)[ends - 1] if len(q) else np.empty(0, np.int64)
    i = e = 0
    while e < len(ends):
        before = total[e - 1] if e else 0
        e = max(e + 1, int(np.searchsorted(total, before + ASKED, side="right")))
        part, i = slice(i, ends[e - 1]), ends[e - 1]
        count = (b - a)[part]
        own = np.repeat(np.arange(len(count)), count)
        at = np.repeat(a[part] - np.cumsum(count) + count, count) + np.arange(count.sum())
        pair, place = np.unique(q[part][own] * n + row[at], return_inverse=True)
        asked, d = np.divmod(pair, n)
        yield asked, d, _common_score(plan, dense, plan["group"][asked], d) + np.bincount(place, weights=f[part][own] * w[at], minlength=len(pair))


def _blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, n):
            held.append(batch.slice(a, n))
            rows += held[-1].num_rows
            if rows >= n:
                table = pa.Table.from_batches(held)
                yield table.slice(0, n)
                held, rows = table.slice(n).to_batches(), rows - n
    if rows:
        yield pa.Table.from_batches(held)


def _searched(plan: dict, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """qid, v (score, negative, and id) of the k best of a task's documents (id, len, carpan, t), which come by id."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    common, rare, least, ids, first = none, none, np.zeros(len(plan["share"])), [], 0
    for block in _blocks(batches, max(1, min(ROWS, CELLS // max(1, plan["common"])))):
        term, row, w = _weights(plan, block)
        dense, head = np.zeros((plan["common"], block.num_rows)), plan["number"][term] >= 0
        dense[plan["number"][term[head]], row[head]] = w[head]
        for g, d in _candidates(plan, dense, least, k):
            common = _kept(k, common, (g, d + first, np.round(_common_score(plan, dense, g, d), 9)))
        for q, d, s in _rarely(plan, dense, (term[~head], row[~head], w[~head])):
            rare = _kept(k, rare, _kept(k, (q, d + first, np.round(s, 9))))
        ids += block["id"].chunks
        first += block.num_rows
    if not first:
        return
    names, (g, d, s) = pa.chunked_array(ids).combine_chunks(), common
    a, b = (np.searchsorted(g, plan["group"], side=side) for side in ("left", "right"))
    for q0 in range(0, len(a), SENT):
        part = slice(q0, q0 + SENT)
        count = (b - a)[part]
        at = np.repeat(a[part] - np.cumsum(count) + count, count) + np.arange(count.sum())
        r0, r1 = np.searchsorted(rare[0], [q0, q0 + SENT])
        q, own, v = _kept(k, (np.repeat(np.arange(q0, q0 + len(count)), count), d[at], s[at]), tuple(x[r0:r1] for x in rare))
        if len(q):
            asked_for, cuts = np.unique(q, return_index=True)
            pairs = pa.StructArray.from_arrays([pa.array(-v), names.take(pa.array(own))], ["eksi", "id"])
            yield pa.RecordBatch.from_arrays([plan["qid"].take(pa.array(asked_for)), pa.ListArray.from_arrays(pa.array([*cuts.tolist(), len(q)], pa.int32()), pairs)], ["qid", "v"])


def search(index: Index, docs: DataFrame, queries: DataFrame, k: int, predicate: Column | None = None, key: str = "id", grade: str | None = "derece", expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """qid, sira (rank from 1), id, skor (two places): the k best documents of each query. predicate and grade are columns of docs; ties go to the smaller id; expand may add words to the queries.

    The query set, in slices of at most HELD words, goes to all tasks, each of which has a part of the documents and keeps
    the k best of each query. Those are among the documents that hold one of its rarer words, and the k best by its common
    words alone, as no weight is negative. So rare words are followed by their postings, and common ones summed once for all
    queries that share them.
    """
    spark = shipped(docs.sparkSession)
    queries = expand(queries) if expand else queries
    facts = docs.select(F.col(key).alias("id"), F.when(F.col(grade) == X.UNKNOWN, PENALTY).otherwise(1.0).alias("carpan") if grade else F.lit(1.0).alias("carpan"), (predicate if predicate is not None else F.lit(True)).alias("uygun")).where("uygun").drop("uygun")
    schema = f"qid {dict(queries.dtypes)['qid']}, v array<struct<eksi: double, id: {dict(docs.dtypes)[key]}>>"
    asked = saved(_asked(queries), "asked")
    wanted = asked.select("term").distinct()
    few = [r.term for r in wanted.limit(FEW + 1).collect()]
    words = index.words
    if len(few) <= FEW:
        words = words.withColumn("t", F.filter("t", lambda x: x.isin(*few) if few else F.lit(False))).where(F.size("t") > 0)
    own = words.select(F.explode(F.array_distinct("t")).alias("term"))
    if len(few) > FEW:
        own = own.join(F.broadcast(wanted) if wanted.count() <= WORDS else wanted, "term", "left_semi")
    counts = saved(own.groupBy("term").agg(F.count("*").alias("n")), "counts")
    total = index.stats.first()
    slices = -(-asked.count() // HELD)
    # Rows are costly for their bytes, so there are as many parts as cores, which adaptive execution would not make; each has the best of all queries, so there are no more.
    parts = max(1, min(spark.sparkContext.defaultParallelism, total.n_docs // LEAST), -(-total.n_docs // MOST))
    rows = words.select("id", "len", F.transform("t", lambda x: F.xxhash64(x)).alias("t")).repartition(parts, "id").join(facts.repartition(parts, "id"), "id").select("id", "len", "carpan", "t").sortWithinPartitions("id")
    rows = saved(rows, "rows") if slices > 1 else rows
    lists = [_against(rows, asked.where(F.pmod(F.xxhash64("qid"), F.lit(slices)) == i), counts, total, k, schema) for i in range(slices)]
    found = reduce(DataFrame.unionByName, lists) if lists else spark.createDataFrame([], schema)
    best = found.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("v"))), 1, k).alias("v"))
    return best.select("qid", F.posexplode("v").alias("n", "x")).select("qid", (F.col("n") + 1).alias("sira"), F.col("x.id").alias("id"), F.round(-F.col("x.eksi"), 2).alias("skor"))


def _against(rows: DataFrame, asked: DataFrame, counts: DataFrame, total: Row, k: int, schema: str) -> DataFrame:
    """The k best rows of each task, which come by id, for each query of a slice, which is held to HELD words and goes to every task."""
    lists = asked.groupBy("qid").agg(F.collect_list(F.xxhash64("term")).alias("t"), F.collect_list(F.col("qf").cast("double")).alias("f")).withColumnRenamed("qid", "k").toArrow()
    vocab = counts.join(asked.select("term").distinct(), "term", "left_semi").select(F.xxhash64("term").alias("t"), "n").toArrow()
    held = rows.sparkSession.sparkContext.broadcast(_plan(lists, vocab, total.n_docs, total.avg_len))

    return rows.mapInArrow(lambda batches: _searched(held.value, k, batches), schema)


def topics(index: Index, docs: DataFrame, queries: DataFrame, k: int, vectors: Callable[[DataFrame, int], DataFrame] | None, **how) -> DataFrame:
    """qid, sira, id, skor of topic queries: by vectors(queries, k) where there are vectors, else by words, with the expansion and filters in how."""
    return vectors(queries, k) if vectors is not None else search(index, docs, queries, k, **how)
