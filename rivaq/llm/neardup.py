"""Near-duplicate records with small edits: pigeonhole blocks over word fingerprints, then the exact Hamming distance.

A text becomes the set of its words in the consistent form (case, punctuation and vowel signs away; the n-th copy of a
word is a member of its own). Texts with equal sets form a class and are compared once. A class's fingerprint holds its
SKETCH smallest word hashes among words that are rare in the collection, in order. Two fingerprints that differ in few
places still share a block of two members at most REACH places apart: a strange member spoils only the blocks it is in or
that it pushes apart. Classes that share a block and whose sizes allow the share are candidates; the number of words that
differ (the Hamming distance of the two sets) decides exactly. A block of more than SPLIT classes is cut into parts, and
each pair of parts is a task of its own, so no block is one task and none loses a pair.

Groups are the connected components of documents: a document is linked to the first of its class, the first of a class
to that of a linked class. They are found by alternating stars, in rounds whose number grows with the logarithm of the
largest group; links are written to the shared folder in each.

Rare are words seen less than LEAST times, or making up less than FREQUENT of all words; of the others there are at most
1/FREQUENT. A class
with fewer than FILL rare words takes its least frequent other ones, so boilerplate texts have blocks, too.

Null texts and texts without a word give no pairs. Repeated rows (one id delivered twice) count once. Empty tables and
tables without near-duplicates give no rows. Ids compare as plain strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivaq.llm import normalize as N
from rivaq.session import discard, saved, shipped, spread

SHARE, SKETCH, FILL, REACH, FREQUENT = 0.7, 12, 8, 4, 2e-5
#: A word seen less often than this is rare in any collection.
LEAST = 50
#: Classes of a block compared in one task; salts of joins on a document that may be linked to a third of all.
SPLIT, SALTS = 2048, 16
#: Rows of class numbers that may be broadcast (8 bytes each); beyond, the same join shuffles.
BROADCAST_ROWS = 1_000_000

_SIGNS = r"\x{610}-\x{61A}\x{64B}-\x{65F}\x{670}\x{6D6}-\x{6DC}\x{6DF}-\x{6E8}\x{6EA}-\x{6ED}\x{8D3}-\x{8FF}"


def words_sql(col: str) -> str:
    """The words of a text in the consistent form, without case, punctuation and vowel signs, as a DuckDB list."""
    plain = f"replace(lower(replace(replace({col}, 'İ', 'i'), 'I', 'i')), 'ı', 'i')"
    bare = f"CASE WHEN regexp_matches({col}, '[{_SIGNS}]') THEN regexp_replace({plain}, '[{_SIGNS}]', '', 'g') ELSE {plain} END"
    return rf"regexp_extract_all({bare}, '[\p{{L}}\p{{N}}]+')"


def _hashed(words: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and 32-bit hashes of lists of words, the n-th copy of a word with a hash of its own, sorted within each list."""
    lists = words.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.dictionary_encode()
    from xxhash import xxh64_intdigest

    table = np.array([xxh64_intdigest(w) for w in values.dictionary.to_pylist()], dtype=np.uint64)
    flat = table[values.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.uint64)
    flat = flat[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    same = np.zeros(len(flat), np.int64)
    if len(flat):
        first = np.r_[True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])]
        same = np.arange(len(flat)) - np.maximum.accumulate(np.where(first, np.arange(len(flat)), 0))
    mixed = (flat + same.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    mixed = mixed.astype(np.uint32)
    order = np.lexsort((mixed, row))
    return offsets, mixed[order]


def word_sets(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, alan, h (64-bit hash of the set), n (words), w (sorted 32-bit hashes as bytes) of each text with a word."""
    parts = " UNION ALL ".join(f"SELECT k, CAST({i} AS TINYINT) AS alan, c{i} AS metin FROM t WHERE c{i} IS NOT NULL AND c{i} <> ''" for i in range(len(columns)))
    sql = f"SELECT k, alan, {words_sql('bicim')} AS w FROM ({N.whole_sql(f'({parts})', 'k, alan')})"
    schema = pa.schema([("k", pa.string()), ("alan", pa.int8()), ("w", pa.list_(pa.string()))])
    query = N.run_duckdb(sql, schema)
    out = pa.schema([("k", pa.string()), ("alan", pa.int8()), ("h", pa.int64()), ("n", pa.int32()), ("w", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in query(batches):
            offsets, flat = _hashed(pa.chunked_array([batch.column("w")]))
            blobs = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            h = np.array([xxh64_intdigest(b) for b in blobs], dtype=np.uint64).view(np.int64)
            made = pa.RecordBatch.from_arrays([batch.column("k"), batch.column("alan"), pa.array(h, pa.int64()), pa.array(np.diff(offsets), pa.int32()), pa.array(blobs, pa.binary())], schema=out)
            yield made.filter(pa.array(np.diff(offsets) > 0))

    shipped(df.sparkSession)
    src = spread(df.select(df[key].cast("string").alias("k"), *[df[c].cast("string").alias(f"c{i}") for i, c in enumerate(columns)]).where("k IS NOT NULL"))
    return src.mapInArrow(run, "k string, alan byte, h long, n int, w binary")


def frequent_words(sets: DataFrame) -> DataFrame:
    """alan, x (word hash), c (its number) of words that make up at least FREQUENT of all: at most 1/FREQUENT for each column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            alan = batch.column("alan").to_numpy()
            blobs = batch.column("w")
            for a in np.unique(alan):
                flat = np.frombuffer(b"".join(b for b, x in zip(blobs.to_pylist(), alan, strict=True) if x == a), np.uint32)
                x, c = np.unique(flat, return_counts=True)
                if a in seen:
                    x, at = np.unique(np.r_[seen[a][0], x], return_inverse=True)
                    c = np.bincount(at, weights=np.r_[seen[a][1], c]).astype(np.int64)
                seen[a] = [x, c]
                if len(x) > 2_000_000:
                    yield _counted(a, *seen.pop(a))
        for a, (x, c) in seen.items():
            yield _counted(a, x, c)

    counts = sets.select("alan", "w").mapInArrow(count, "alan byte, x long, c long").groupBy("alan", "x").agg(F.sum("c").alias("c"))
    total = sets.groupBy("alan").agg(F.sum("n").alias("hepsi"))
    return counts.join(F.broadcast(total), "alan").where(F.col("c") >= F.greatest(F.col("hepsi") * FREQUENT, F.lit(LEAST))).select("alan", "x", "c")


def _counted(a: int, x: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), a), pa.int8()), pa.array(x.astype(np.int64)), pa.array(c.astype(np.int64))], names=["alan", "x", "c"])


def block_keys(row: np.ndarray, w: np.ndarray, often: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and blocks of word sets given as row numbers and sorted hashes: pairs of fingerprint members up to REACH places apart, as 64-bit numbers."""
    at = np.searchsorted(often, w)
    at[at == len(often)] = 0
    known = often[at] == w if len(often) else np.zeros(len(w), bool)
    nth = _nth(row[~known])
    r, f = row[~known][nth < SKETCH], w[~known][nth < SKETCH]
    if known.any():
        n = int(row[-1]) + 1
        lack = FILL - np.bincount(r, minlength=n)
        wanted = known & (lack[row] > 0)
        ro, wo, co = row[wanted], w[wanted], rank[at[wanted]]
        order = np.lexsort((wo, co, ro))
        ro, wo = ro[order], wo[order]
        few = _nth(ro) < lack[ro]
        r, f = np.r_[r, ro[few]], np.r_[f, wo[few]]
        order = np.lexsort((f, r))
        r, f = r[order], f[order]
    f = f.astype(np.uint64)
    alone = np.bincount(r)[r] == 1 if len(r) else np.zeros(0, bool)
    rows, keys = [r[alone]], [f[alone]]
    for far in range(1, REACH + 1):
        same = r[far:] == r[:-far]
        rows.append(r[:-far][same])
        keys.append(((f[:-far] << np.uint64(32)) | f[far:])[same])
    return np.concatenate(rows), np.concatenate(keys)


def _nth(row: np.ndarray) -> np.ndarray:
    """The place of each element among those of its row; rows are together."""
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    return np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))


def blocks(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """alan, b (block), h, n (words): once for each class within a batch."""
    rows = frequent.collect()  # at most 1/FREQUENT for each column
    often = {}
    for a in {r.alan for r in rows}:
        mine = sorted((r.x, r.c) for r in rows if r.alan == a)
        often[a] = (np.array([x for x, _ in mine], np.uint32), np.array([c for _, c in mine], np.int64))
    held = sets.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        for batch in batches:
            alan, h = batch.column("alan").to_numpy(), batch.column("h").to_numpy()
            blobs = batch.column("w").to_pylist()
            for a in np.unique(alan):
                mine = np.flatnonzero(alan == a)
                mine = mine[np.unique(h[mine], return_index=True)[1]]
                row = np.repeat(np.arange(len(mine)), [len(blobs[i]) // 4 for i in mine])
                r, keys = block_keys(row, np.frombuffer(b"".join(blobs[i] for i in mine), np.uint32), *held.value.get(int(a), none))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), a, np.int8)), pa.array(keys.view(np.int64)), pa.array(h[mine][r]), batch.column("n").take(pa.array(mine[r]))], names=["alan", "b", "h", "n"])

    return sets.select("alan", "h", "n", "w").mapInArrow(run, "alan byte, b long, h long, n int")


def links(sets: DataFrame, share: float = SHARE) -> DataFrame:
    """alan, h1 < h2: classes whose word sets share at least `share` of the longer one's words."""
    every = blocks(sets, frequent_words(sets))
    # A block whose smallest and largest class are one holds a single class; the others are few.
    shared = every.groupBy("alan", "b").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi")
    shared = saved(shared.select("alan", "b"), "blocks")
    member = saved(_members(every, shared), "members")
    pairs = saved(_candidates(member, share).select("alan", "h1", "h2").distinct(), "pairs")
    needed = pairs.select("alan", F.col("h1").alias("h")).union(pairs.select("alan", F.col("h2").alias("h"))).distinct()
    needed = saved(needed, "needed")
    small = needed.count() <= BROADCAST_ROWS
    texts = sets.select("alan", "h", "n", "w").join(F.broadcast(needed) if small else needed, ["alan", "h"], "left_semi").dropDuplicates(["alan", "h"])
    a, b = texts.select("alan", F.col("h").alias("h1"), F.col("n").alias("n1"), F.col("w").alias("w1")), texts.select("alan", F.col("h").alias("h2"), F.col("n").alias("n2"), F.col("w").alias("w2"))
    x = pairs.join(a, ["alan", "h1"]).where("n1 > 0").join(b, ["alan", "h2"]).where(F.least("n1", "n2") >= F.greatest("n1", "n2") * share)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n1, n2, w1, w2 in zip(batch.column("n1").to_pylist(), batch.column("n2").to_pylist(), batch.column("w1").to_pylist(), batch.column("w2").to_pylist(), strict=True):
                distance = len(np.setxor1d(np.frombuffer(w1, np.uint32), np.frombuffer(w2, np.uint32), assume_unique=True))
                keep.append((n1 + n2 - distance) / 2 >= share * max(n1, n2) - 1e-9)
            yield batch.select(["alan", "h1", "h2"]).filter(pa.array(keep, pa.bool_()))

    return x.select("alan", "h1", "h2", "n1", "n2", "w1", "w2").mapInArrow(verify, "alan byte, h1 long, h2 long")


def _members(every: DataFrame, shared: DataFrame) -> DataFrame:
    small = shared.count() <= BROADCAST_ROWS
    return every.join(F.broadcast(shared.select("alan", "b")) if small else shared.select("alan", "b"), ["alan", "b"], "left_semi").distinct()


def _candidates(member: DataFrame, share: float) -> DataFrame:
    """alan, h1 < h2: classes of one block whose sizes allow the share."""
    big = member.groupBy("alan", "b").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")).where("parts > 1")
    big = saved(big, "big")
    rows = member.withColumn("parts", F.lit(1))
    if not big.isEmpty():
        rows = member.join(F.broadcast(big) if big.count() <= BROADCAST_ROWS else big, ["alan", "b"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own, every = F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = rows.select("alan", "b", own.alias("i"), F.col("h").alias("h1"), F.col("n").alias("n1"), every.alias("j"))
    two = rows.select("alan", "b", own.alias("j"), F.col("h").alias("h2"), F.col("n").alias("n2"), every.alias("i"))
    return one.join(two, ["alan", "b", "i", "j"]).where("h1 < h2").where(F.least("n1", "n2") >= F.greatest("n1", "n2") * share)


def _classes(df: DataFrame, key: str, columns: list[str], share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ids (k, alan, h) of texts that have a copy or a link, links (alan, h1, h2) between classes, and copied (alan, h), the classes of several ids."""
    sets = saved(word_sets(df, key, columns), "sets")
    found = saved(links(sets, share), "links")
    ids = sets.select("k", "alan", "h").distinct()
    copied = ids.groupBy("alan", "h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("alan", "h")
    touched = found.select("alan", F.col("h1").alias("h")).union(found.select("alan", F.col("h2").alias("h"))).union(copied).distinct()
    return saved(ids.join(touched, ["alan", "h"], "left_semi"), "ids"), found, copied


def pairs(df: DataFrame, key: str, columns: list[str], share: float = SHARE) -> DataFrame:
    """key_a < key_b: records of which at least one column's texts share at least `share` of the words of the longer."""
    ids, found, copied = _classes(df, key, columns, share)
    both = found.union(copied.select("alan", F.col("h").alias("h1"), F.col("h").alias("h2")))
    x = both.join(ids.select("alan", F.col("h").alias("h1"), F.col("k").alias("x")), ["alan", "h1"]).join(ids.select("alan", F.col("h").alias("h2"), F.col("k").alias("y")), ["alan", "h2"]).where("x <> y")
    return x.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def groups(df: DataFrame, key: str, columns: list[str], share: float = SHARE) -> DataFrame:
    """key, grup, benzer: each record once, with the smallest key of its group (its own if it has no near-duplicate) and whether it has one. Copies are not expanded into pairs."""
    ids, found, _ = _classes(df, key, columns, share)
    first = saved(ids.groupBy("alan", "h").agg(F.min("k").alias("ilk")), "first")
    copies = _salted(ids, first, ["alan", "h"], "k").where("k <> ilk").select(F.col("k").alias("u"), F.col("ilk").alias("v"))
    linked = found.join(first.select("alan", F.col("h").alias("h1"), F.col("ilk").alias("u")), ["alan", "h1"]).join(first.select("alan", F.col("h").alias("h2"), F.col("ilk").alias("v")), ["alan", "h2"])
    group = components(copies.unionByName(linked.select("u", "v")))
    every = df.select(F.col(key).cast("string").alias("u")).where("u IS NOT NULL").distinct()
    out = every.join(group, "u", "left")
    return out.select(F.col("u").alias(key), F.coalesce("grup", "u").alias("grup"), F.col("grup").isNotNull().alias("benzer"))


def _salted(rows: DataFrame, small: DataFrame, on: list[str], by: str) -> DataFrame:
    """rows joined with one row for each key, of which one may hold a third of all rows."""
    copies = small.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_t", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [*on, "_t"]).drop("_t")


def components(edges: DataFrame) -> DataFrame:
    """u, grup: each end of an edge (u, v) and the smallest in its component, by large and small stars in turn."""
    edges = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _salted(both, least, ["u"], "v").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _salted(large, least, ["u"], "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        new = saved(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        done = new.count() == edges.count() and new.exceptAll(edges).isEmpty()
        discard(large, edges)
        edges = new
        if done:
            break
    return edges.select("u", F.col("v").alias("grup")).union(edges.select("v", "v").distinct())


def found(corpus: DataFrame) -> DataFrame:
    """(id_a, id_b): sayings whose tr, or whose ar, share at least 70 % of their words."""
    return pairs(corpus, "id", ["tr", "ar"])


def grouped(corpus: DataFrame) -> DataFrame:
    """(id, grup, benzer) of each saying."""
    return groups(corpus, "id", ["tr", "ar"])
