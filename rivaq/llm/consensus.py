"""Consensus from several graders' opinions: a mean-field variational confusion model with dependence between graders.

Each item has a hidden class; each grader a row of opinion probabilities for each class. Dirichlet priors on the class
shares and on the graders' rows. A round takes the items in Arrow batches: under the current parameters each item's class
weights follow from its own opinions, and what they add to the graders' counts is summed within the task, then by a
group-by over graders, whose digamma expectations are the next parameters. A round is one job: a scan of the items, a
shuffle of one row for each task and grader. Before each search for copies there are EARLY rounds from the items' plain
opinions, no more: graders who copy each other become a truth of their own if left to converge. Once all copies are
known, rounds go on until no opinion probability moves by more than MOVED, at most ROUNDS.

A grader who agrees with another far more often than their rows allow copies from the other: where both opinions agree,
the copy counts with the share of its own judgements only. Pairs of graders are counted within the items' opinions; no
pair leaves the task but as a sum for the two graders.

Up to GRADERS graders the parameters (32 numbers each) travel with the tasks; beyond, they are joined to the opinions,
salted, as a grader may hold a third of them. Both ways give the same counts.

An opinion without grader, without entry, or whose entry is of no class is not usable. A grader's name in other case,
spacing or hyphenation is the same grader; of repeated opinions of one grader on an item the first counts. Items without
usable opinions give no row. Ties of the posterior go to the class that comes first in CLASSES.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivaq.llm import terms as T
from rivaq.session import discard, saved, shipped

CLASSES = ("sahih", "hasen", "zayif", "mevzu")
M = len(CLASSES)
#: Prior counts: of a class, of the right opinion, of each wrong one.
PRIOR_CLASS, PRIOR_RIGHT, PRIOR_WRONG = 2.0, 4.0, 1.0
#: Rounds before looking for copies; most rounds afterwards, and the change of an opinion probability that ends them.
EARLY, ROUNDS, MOVED = 6, 40, 2e-3
#: How far above chance and how sure agreement must be to be copying.
EXCESS, SURE = 0.5, 4.0
#: The pseudo-grader that holds the class shares.
SHARES = ""
#: Graders whose parameters may travel with the tasks (some 300 bytes each), and salts of the join beyond.
GRADERS, SALTS = 25_000, 32
#: Pairs are taken for copies together if their surplus is at least this share of the largest.
PLAIN = 0.95
#: Pairs of opinions compared at once, and pairs of graders held before they are handed on.
AT_ONCE, HELD = 2_000_000, 1_000_000


def digamma(x: Column) -> Column:
    """By recurrence to x + 6, then the asymptotic series."""
    y = x + 6
    shift = sum((1 / (x + i) for i in range(1, 6)), 1 / x)
    z = 1 / (y * y)
    return F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240))) - shift


def opinions(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """Usable opinions: id, g (the grader's folded name), k (the class's number), one row for each id and grader."""
    rows = corpus.select("id", F.posexplode("alimler").alias("sira", "u")).select("id", "sira", F.col("u.alim").alias("alim"), F.col("u.derece").alias("deger"))
    rows = rows.withColumn("g", F.regexp_replace(F.expr(T.fold_sql("alim")), r"[\s\p{Z}\p{Pd}]+", "")).where("g <> '' AND deger IS NOT NULL")
    rows = rows.withColumn("alan", F.lit("dereceRaw"))
    entry = T.mapped(rows, terms.where("alan = 'dereceRaw'"))
    number = terms.where("alan = 'dereceRaw'").select("terim_id", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("sinif")).alias("k")).where("k > 0")
    entry = entry.join(F.broadcast(number), "terim_id").select("alan", "deger", (F.col("k") - 1).cast("int").alias("terim_id"))
    given = T.joined(rows, entry, "id").select("id", "g", F.struct("sira", F.col("terim_id").alias("k")).alias("o"))
    return given.repartition("id").groupBy("id", "g").agg(F.min("o").getField("k").alias("k"))


@dataclass
class Opinions:
    """The opinions of a batch of items: the item, grader (a number within the batch) and class of each, items together."""

    item: np.ndarray
    g: np.ndarray
    k: np.ndarray
    start: np.ndarray
    names: list[str]
    first: np.ndarray  # an opinion of each grader

    @staticmethod
    def of(v: pa.ListArray) -> tuple[Opinions, pa.StructArray]:
        flat, lengths = v.flatten(), pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
        names = pc.struct_field(flat, "g").dictionary_encode()
        g = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        item = np.repeat(np.arange(len(lengths)), lengths)
        k = pc.struct_field(flat, "k").to_numpy(zero_copy_only=False).astype(np.int64)
        return Opinions(item, g, k, np.r_[0, np.cumsum(lengths)], names.dictionary.to_pylist(), np.unique(g, return_index=True)[1]), flat


@dataclass
class Model:
    """Parameters: of the class shares (w: expected log probabilities), and of each grader, [opinion, class], w and p (expected probabilities); whom each copies, and how much.

    Either w, p and copies hold all graders (row: the place of each), or frame does (g, a, w, p), with copies in joined.
    """

    shares: np.ndarray | None = None
    row: dict[str, int] = field(default_factory=dict)
    a: np.ndarray | None = None
    w: np.ndarray | None = None
    p: np.ndarray | None = None
    copies: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    place: dict[str, int] | None = None  # graders by number of opinions: one copies only from a later one
    frame: DataFrame | None = None
    joined: DataFrame | None = None


@dataclass
class Batch:
    """A batch's opinions with the parameters of its graders and, for each opinion, how surely those copied say each class."""

    o: Opinions
    w: np.ndarray | None
    p: np.ndarray | None
    led: np.ndarray

    @staticmethod
    def of(v: pa.ListArray, row: dict[str, int], w: np.ndarray | None, p: np.ndarray | None, copies: dict) -> Batch:
        o, flat = Opinions.of(v)
        if "w" in {f.name for f in flat.type}:  # parameters joined to the opinions
            own = flat.take(pa.array(o.first))
            wide = [np.array(pc.list_flatten(pc.struct_field(own, c)), float).reshape(-1, M, M) for c in ("w", "p")]
            copies = {n: [(e["asil"], e["rho"]) for e in c or ()] for n, c in zip(o.names, pc.struct_field(own, "c").to_pylist(), strict=True)}
            return Batch(o, *(wide if len(wide[0]) else (None, None)), _led(o, copies))
        at = np.array([row[n] for n in o.names], np.int64) if w is not None else None
        return Batch(o, w[at] if w is not None else None, p[at] if w is not None else None, _led(o, copies))


def _led(o: Opinions, copies: dict[str, list[tuple[str, float]]]) -> np.ndarray:
    """How surely each opinion's grader says each class on the item because those copied say it."""
    led, at = np.zeros((len(o.k), M)), {n: i for i, n in enumerate(o.names)}
    known = [(i, at[y], rho) for i, n in enumerate(o.names) for y, rho in copies.get(n, ()) if y in at]
    if not known:
        return led
    copier, source, rho = (np.array(x) for x in zip(*known, strict=True))
    start = np.searchsorted(copier, np.arange(len(o.names) + 1))
    each = np.diff(start)[o.g]
    x = np.repeat(np.arange(len(o.k)), each)
    pair = start[o.g[x]] + np.arange(len(x)) - np.repeat(np.cumsum(each) - each, each)
    place = o.item * len(o.names) + o.g
    order = np.argsort(place)
    wanted = o.item[x] * len(o.names) + source[pair]
    found = order[np.minimum(np.searchsorted(place[order], wanted), len(order) - 1)]
    hit = place[found] == wanted
    np.maximum.at(led, (x[hit], o.k[found[hit]]), rho[pair[hit]])
    return led


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _by_item(o: Opinions, x: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(o.item, x[:, c], len(o.start) - 1) for c in range(M)], axis=1)


def _items(b: Batch, shares: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weights of the items' classes; of each opinion its log likelihood under each class (of a copy only as far as it is the grader's own), and the share that is its own."""
    o, rho = b.o, b.led[np.arange(len(b.o.k)), b.o.k][:, None]
    if b.w is None:  # the first round: from the items' own opinions alone
        own = np.repeat(1 - rho, M, axis=1)
        return np.log(1 / M + _by_item(o, own * (o.k[:, None] == np.arange(M)))), own, own
    w = b.w[o.g, o.k]
    e = (1 - rho) * np.exp(w)
    weight, own = np.where(rho > 0, np.log(rho + e), w), np.where(rho > 0, e / (rho + e), 1.0)
    return shares + _by_item(o, weight), weight, own


def _counted(b: Batch, shares: np.ndarray | None) -> tuple[list[str], np.ndarray]:
    """Names and expected counts [opinion, class] of the batch's graders; of the pseudo-grader the first row holds those of the classes."""
    s, _, own = _items(b, shares)
    q, o = _softmax(s), b.o
    n = np.stack([np.bincount(o.g * M + o.k, q[o.item, c] * own[:, c], len(o.names) * M) for c in range(M)], axis=1)
    top = np.zeros((1, M * M))
    top[0, :M] = q.sum(axis=0)
    return [*o.names, SHARES], np.r_[n.reshape(-1, M * M), top]


def _allowed(names: list[str], place: dict[str, int], copies: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of the batch's graders, who may only copy those in later ones, and the pairs already known, as numbers."""
    local = {n: i for i, n in enumerate(names)}
    known = [i * len(names) + local[y] for i, n in enumerate(names) for y, _ in copies.get(n, ()) if y in local]
    return np.array([place[n] for n in names]), np.array(known, np.int64)


def _paired(b: Batch, shares: np.ndarray, allowed: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Graders g and h of pairs, and n, agree, due: items both judge, how often they say the same, and how often g would by its own rows, given all other opinions on the item and those it is known to copy."""
    s, weight, _ = _items(b, shares)
    o = b.o
    other = _softmax(s[o.item] - weight)
    led = b.led / np.maximum(1.0, b.led.sum(axis=1, keepdims=True))
    due = led + (1 - led.sum(axis=1, keepdims=True)) * np.einsum("xc,xkc->xk", other, b.p[o.g])
    size = np.diff(o.start)[o.item]
    done = np.cumsum(size)
    at, n = 0, len(o.names)
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + AT_ONCE, side="right")))
        x = np.repeat(np.arange(at, to), size[at:to])
        y = o.start[o.item[x]] + np.arange(len(x)) - np.repeat(done[at:to] - size[at:to] - (done[at - 1] if at else 0), size[at:to])
        may = x != y if allowed is None else (allowed[0][o.g[x]] < allowed[0][o.g[y]]) & ~np.isin(o.g[x] * n + o.g[y], allowed[1])
        x, y = x[may], y[may]
        keys, inverse = np.unique(o.g[x] * n + o.g[y], return_inverse=True)
        sums = np.stack([np.bincount(inverse, z, len(keys)) for z in (np.ones(len(x)), o.k[x] == o.k[y], due[x, o.k[y]])], axis=1)
        yield keys // n, keys % n, sums
        at = to


class _Sums:
    """Rows of numbers by key, added up within a task."""

    def __init__(self, width: int):
        self.at, self.rows = {}, np.zeros((64, width))

    def add(self, keys: list, values: np.ndarray) -> None:
        for k in keys:
            self.at.setdefault(k, len(self.at))
        if len(self.at) > len(self.rows):
            self.rows = np.r_[self.rows, np.zeros((max(len(self.at), 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))]
        np.add.at(self.rows, [self.at[k] for k in keys], values)

    def take(self) -> tuple[list, np.ndarray]:
        keys, rows = list(self.at), self.rows[: len(self.at)]
        self.at, self.rows = {}, np.zeros((64, self.rows.shape[1]))
        return keys, rows


def _scan(items: DataFrame, m: Model, what: Callable, schema: str) -> DataFrame:
    """what(the batch of Arrow columns, its opinions with parameters, the class shares' weights) -> batches, over all items."""
    row, w, p, shares, copies, place = m.row, m.w, m.p, m.shares, m.copies, m.place
    shipped(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = ((batch, Batch.of(batch.column("v"), row, w, p, copies)) for batch in batches if batch.num_rows)
        yield from what(given, shares, place, copies) if what is _sum_pairs else what(given, shares)

    return _attached(items, m).mapInArrow(run, schema)


def _attached(items: DataFrame, m: Model) -> DataFrame:
    """items, each opinion with its grader's parameters where these do not travel with the tasks."""
    if m.frame is None and m.joined is None:
        return items
    none = "CAST(NULL AS array<double>) AS w", "CAST(NULL AS array<double>) AS p"
    params = m.joined.selectExpr("g", *none, "c") if m.frame is None else m.frame.select("g", "w", "p")
    if m.frame is not None:
        led = m.joined if m.joined is not None else params.where("false").selectExpr("g", "CAST(NULL AS array<struct<asil:string,rho:double>>) AS c")
        params = params.join(led, "g", "left")
    params = params.withColumn("tuz", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = items.select("id", F.explode("v").alias("o")).select("id", "o.g", "o.k", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("tuz"))
    return rows.join(params, ["g", "tuz"], "left").groupBy("id").agg(F.collect_list(F.struct("g", "k", "w", "p", "c")).alias("v"))


def _sum_counts(batches: Iterator, shares: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    sums = _Sums(M * M)
    for _, b in batches:
        sums.add(*_counted(b, shares))
        if len(sums.at) > HELD // 8:
            yield _wide(*sums.take())
    yield _wide(*sums.take())


def _wide(names: list[str], n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * M * M, pa.int32()), pa.array(n.ravel(), pa.float64()))], names=["g", "n"])


def _sum_pairs(batches: Iterator, shares: np.ndarray, place: dict[str, int] | None, copies: dict) -> Iterator[pa.RecordBatch]:
    sums = _Sums(3)
    for _, b in batches:
        for g, h, n in _paired(b, shares, None if place is None else _allowed(b.o.names, place, copies)):
            sums.add([(b.o.names[i], b.o.names[j]) for i, j in zip(g.tolist(), h.tolist(), strict=True)], n)
            if len(sums.at) > HELD:
                yield _narrow(*sums.take())
    yield _narrow(*sums.take())


def _narrow(pairs: list[tuple[str, str]], n: np.ndarray) -> pa.RecordBatch:
    names = [pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*names, *[pa.array(n[:, i]) for i in range(3)]], names=["g", "h", "n", "agree", "due"])


def _dirichlet(counts: DataFrame) -> DataFrame:
    """g, a (Dirichlet counts), w (expected log probabilities) and p (expected probabilities), each [opinion, class] in one array."""
    n = counts.groupBy("g").agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(M * M)])
    prior = F.when(F.col("g") == SHARES, F.array(*[F.lit(PRIOR_CLASS)] * M * M)).otherwise(F.array(*[F.lit(PRIOR_RIGHT if i % M == i // M else PRIOR_WRONG) for i in range(M * M)]))
    n = n.select("g", F.zip_with(F.array(*[f"n{i}" for i in range(M * M)]), prior, lambda x, y: x + y).alias("a"))
    classes = F.aggregate(F.slice("a", 1, M), F.lit(0.0), lambda s, x: s + x)
    total = F.when(F.col("g") == SHARES, F.array_repeat(classes, M)).otherwise(F.array(*[sum((F.get("a", F.lit(k * M + c)) for k in range(1, M)), F.get("a", F.lit(c))) for c in range(M)]))
    n = n.withColumn("t", total)
    w = F.transform("a", lambda x, i: digamma(x) - digamma(F.get("t", i % M)))
    return n.select("g", "a", w.alias("w"), F.transform("a", lambda x, i: x / F.get("t", i % M)).alias("p"))


def _next(items: DataFrame, m: Model, small: bool) -> tuple[Model, float]:
    """The model after one round, and by how much an opinion probability moved at most."""
    new = _dirichlet(_scan(items, m, _sum_counts, "g string, n array<double>"))
    if small:
        rows = new.collect()  # at most GRADERS + 1
        names = {r.g: i for i, r in enumerate(rows)}
        a, w, p = (np.array([r[c] for r in rows]).reshape(-1, M, M) for c in ("a", "w", "p"))
        old = None if m.p is None else m.p[[m.row[r.g] for r in rows]]
        moved = np.inf if old is None else float(np.abs(p - old)[[r.g != SHARES for r in rows]].max(initial=0.0))
        return Model(w[names[SHARES], 0] if rows else np.zeros(M), names, a, w, p, m.copies, m.place), moved
    new = saved(new, "params")
    top = new.where(F.col("g") == SHARES).head()
    moved = np.inf
    if m.frame is not None:
        both = new.where(F.col("g") != SHARES).select("g", "p").join(m.frame.select("g", F.col("p").alias("o")), "g")
        moved = both.agg(F.max(F.array_max(F.zip_with("p", "o", lambda x, y: F.abs(x - y))))).head()[0] or 0.0
    return Model(np.array(top.w[:M]) if top else np.zeros(M), frame=new, joined=m.joined), moved


def _fit(items: DataFrame, m: Model, small: bool, rounds: int) -> Model:
    for _ in range(rounds):
        old, (m, moved) = m.frame, _next(items, m, small)
        discard(old)
        if moved < MOVED:
            break
    return m


def _copies(items: DataFrame, m: Model, known: DataFrame | None) -> DataFrame:
    """kopya, asil, rho: of graders not yet known to copy the other, one row for each whose surplus of agreement with a more frequent grader is largest, and large and sure enough.

    Only the plainest of these pairs are taken at once: others may owe their surplus to those, and are measured again once they are known.
    """
    both = _scan(items, m, _sum_pairs, "g string, h string, n double, agree double, due double").groupBy("g", "h").agg(*[F.sum(c).alias(c) for c in ("n", "agree", "due")])
    surplus = F.col("agree") - F.col("due")
    both = both.withColumn("rho", F.try_divide(surplus, F.col("n") - F.col("due"))).where((F.col("rho") > EXCESS) & (surplus > SURE * F.sqrt(F.col("due") * F.greatest(F.lit(0.0), 1 - F.col("due") / F.col("n")))))
    if m.place is None:  # else the tasks count only pairs that may be
        judged = items.select(F.explode("v").alias("o")).groupBy("o.g").agg(F.count("*").alias("n"))
        if known is not None:
            both = both.join(known.select(F.col("kopya").alias("g"), F.col("asil").alias("h")), ["g", "h"], "left_anti")
        both = both.join(judged.select("g", F.col("n").alias("all_g")), "g").join(judged.select(F.col("g").alias("h"), F.col("n").alias("all_h")), "h")
        both = both.where((F.col("all_g") < F.col("all_h")) | ((F.col("all_g") == F.col("all_h")) & (F.col("g") > F.col("h"))))
    return both.groupBy("g").agg(F.max(F.struct(F.least("rho", F.lit(0.98)).alias("rho"), "h")).alias("p")).select(F.col("g").alias("kopya"), F.col("p.h").alias("asil"), F.col("p.rho").alias("rho"))


def fitted(corpus: DataFrame, terms: DataFrame) -> tuple[DataFrame, Model, DataFrame]:
    """items (id, v: opinions g, k), the model, and copies (kopya, asil, rho)."""
    spark = corpus.sparkSession
    items = saved(opinions(corpus, terms).groupBy("id").agg(F.collect_list(F.struct("g", "k")).alias("v")), "items")
    judged = items.select(F.explode("v").alias("o")).groupBy("o.g").agg(F.count("*").alias("n")).limit(GRADERS + 1).collect()
    small = len(judged) <= GRADERS
    place = {r.g: i for i, r in enumerate(sorted(sorted(judged, key=lambda r: r.g, reverse=True), key=lambda r: r.n))} if small else None
    copies, held, led, names = None, {}, None, "kopya string, asil string, rho double"
    while True:
        m = _fit(items, Model(copies=held, joined=led, place=place), small, EARLY + 1)
        new = _copies(items, m, copies)
        if small:
            rows = new.collect()  # at most one for each grader
            found = [r for r in rows if r.rho >= PLAIN * max(x.rho for x in rows)]
            for r in found:
                held.setdefault(r.kopya, []).append((r.asil, r.rho))
        else:
            new = saved(new, "pairs")
            new = saved(new.where(F.col("rho") >= PLAIN * new.agg(F.max("rho")).scalar()), "copies")
            found = not new.isEmpty()
            if found:
                copies = new if copies is None else copies.unionByName(new)
                led = saved(copies.groupBy(F.col("kopya").alias("g")).agg(F.collect_list(F.struct("asil", "rho")).alias("c")), "led")
        if not found:
            break
    if small:
        copies = spark.createDataFrame([(g, a, rho) for g, own in held.items() for a, rho in own], names)
    return items, _fit(items, m, small, ROUNDS), spark.createDataFrame([], names) if copies is None else copies


def _judged(batches: Iterator, shares: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, b in batches:
        q = _softmax(_items(b, shares)[0])
        best = q.argmax(axis=1)
        votes = _by_item(b.o, (b.o.k[:, None] == np.arange(M)).astype(float))
        n = votes.sum(axis=1)
        same = np.divide((votes * (votes - 1)).sum(axis=1), n * (n - 1), out=np.full(len(n), np.nan), where=n > 1)
        named = pa.array(CLASSES).take(pa.array(best))
        yield pa.RecordBatch.from_arrays([batch.column("id"), named, pa.array(q[np.arange(len(best)), best]), pa.array(same, from_pandas=True), pa.array(n.astype(np.int32))], names=["id", "derece", "guven", "uyum", "n"])


def consensus(corpus: DataFrame, terms: DataFrame, least: int = 1) -> DataFrame:
    """id, derece (the class best supported), guven (its posterior probability), uyum (share of graders' pairs that agree; null for one grader), n: items with at least `least` graders."""
    items, m, _ = fitted(corpus, terms)
    return _scan(items.where(F.size("v") >= least), m, _judged, "id string, derece string, guven double, uyum double, n int")


def graders(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """alim, n, guvenilirlik (probability of the right opinion over the class shares), alt and ust (its 95 % posterior interval), asil (whom the grader copies, or null), kopya_payi."""
    items, m, copies = fitted(corpus, terms)
    params = m.frame
    if params is None:
        params = corpus.sparkSession.createDataFrame([(g, m.a[i].ravel().tolist()) for g, i in m.row.items()], "g string, a array<double>")
    share = params.where(F.col("g") == SHARES).select(F.slice("a", 1, M).alias("a")).select(F.transform("a", lambda x: x / F.aggregate("a", F.lit(0.0), lambda s, e: s + e)).alias("pay")).scalar()
    rows = params.where(F.col("g") != SHARES).select("g", "a", share.alias("pay"))
    a = lambda k, c: F.get("a", F.lit(k * M + c))
    t = [sum((a(k, c) for k in range(1, M)), a(0, c)) for c in range(M)]
    rows = rows.select("g", "pay", *[(a(c, c) / t[c]).alias(f"p{c}") for c in range(M)], *[t[c].alias(f"t{c}") for c in range(M)])
    mean = sum((F.get("pay", F.lit(c)) * F.col(f"p{c}") for c in range(M)), F.lit(0.0))
    spread = F.sqrt(sum((F.get("pay", F.lit(c)) ** 2 * F.col(f"p{c}") * (1 - F.col(f"p{c}")) / (F.col(f"t{c}") + 1) for c in range(M)), F.lit(0.0)))
    n = items.select(F.explode("v").alias("o")).groupBy("o.g").agg(F.count("*").alias("n"))
    whom = copies.groupBy(F.col("kopya").alias("g")).agg(F.max_by("asil", "rho").alias("asil"), F.max("rho").alias("kopya_payi"))
    return rows.join(n, "g").join(whom, "g", "left").select(F.col("g").alias("alim"), "n", mean.alias("guvenilirlik"), F.greatest(F.lit(0.0), mean - 1.96 * spread).alias("alt"), F.least(F.lit(1.0), mean + 1.96 * spread).alias("ust"), "asil", "kopya_payi")


def agreement(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """Krippendorff's alpha for nominal opinions: one row with deger (items with two or more), gorus (their opinions), alfa."""
    items = opinions(corpus, terms).groupBy("id").agg(F.count("*").alias("n"), *[F.sum((F.col("k") == c).cast("double")).alias(f"v{c}") for c in range(M)]).where("n > 1")
    squares = sum((F.col(f"v{c}") * F.col(f"v{c}") for c in range(M)), F.lit(0.0))
    total = items.agg(F.count("*").alias("deger"), F.coalesce(F.sum("n"), F.lit(0)).alias("gorus"), F.sum((F.col("n") ** 2 - squares) / (F.col("n") - 1)).alias("d"), *[F.sum(f"v{c}").alias(f"v{c}") for c in range(M)])
    due = (F.col("gorus") ** 2 - squares) / (F.col("gorus") - 1)
    return total.select("deger", "gorus", F.when(F.col("gorus") > 1, F.when(due > 0, 1 - F.col("d") / due).otherwise(F.lit(1.0))).alias("alfa"))


def found(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, derece) of each item with usable opinions of at least three graders."""
    return consensus(corpus, terms, least=3).select("id", "derece")
