"""Near-duplicate classes of documents by SetSketch registers.

A text's words are hashed and their k-word shingles form its set.  A sketch holds, for each register,
the smallest exponential variate of the set, rounded to an exponentially spaced integer and
truncated; the register of a union is the larger one, so sketches merge.  Bands of register values
find candidates, the likelihood of the counts of larger, smaller and equal registers estimates the
similarity of a pair, and what may reach the threshold is verified on the full sets.

Cost.  Equal sets are one vertex from the start (an aggregate with map-side combine).  A bucket is not
expanded into pairs: first its smallest member is compared with the others and components follow.
Only buckets that then still hold several components go on, in blocks of bounded size that meet by key:
a block pair estimates all its open pairs at once in arrays, a pair being dealt with in its first common
band only, and keeps the members with a near partner; these bring their full sets and the block pair
verifies open pairs, nearest first, joining components as it goes, so it returns fewer links than it has
members.  No bucket is cut and no pair of colliding sets is left out unless components imply it.
With the default bands a pair at similarity 0.8 collides in none with probability 1.2e-7.

Edge cases: a null or empty text, or one without words, has an empty set, is its own component and is
kept; a null doc_id takes part with a number derived from its set, gets a null ``component_id`` if
nothing of its component has an id, and is kept only then; rows that share a doc_id are one vertex and all get its component;
extra columns are ignored; an empty table gives an empty result.
``text_hash`` tells rows with one id apart; ``root`` is null for rows without words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import texts as X
from corpuscle.llm.graph import components
from corpuscle.session import written

BANDS, ROWS = 40, 5
BASE, RATE, LIMIT = 1.001, 20.0, 65535
#: Members of a bucket in a block, where registers or full sets are compared.
NEAR_BLOCK, SET_BLOCK = 1024, 256
#: A pair is verified if its estimate reaches the threshold less this (four standard errors).
MARGIN = 0.12

_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def registers(shingle_set: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a non-empty set of 64-bit hashes."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        h = x[i : i + 256, None] * _A
        h += _B
        np.minimum(low, h.min(axis=0), out=low)
    return spaced((low.astype(np.float64) + 1) / 2**32)


def spaced(u: np.ndarray) -> np.ndarray:
    """Uniform minima as exponential variates, rounded to exponentially spaced numbers and truncated."""
    e = -np.log1p(-np.minimum(u, 1 - 2.0**-33)) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity for rows of registers with known set sizes."""
    na, nb = na.astype(np.float64), nb.astype(np.float64)
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    top = np.minimum(u / v, v / u)

    def score(j):
        pu, pd = p(u - v * j), p(v - u * j)
        return up * np.log(np.maximum(pu, 1e-12)) + down * np.log(np.maximum(pd, 1e-12)) + same * np.log(np.maximum(1 - pu - pd, 1e-12))

    lo, hi = np.zeros_like(top), top.copy()
    for _ in range(24):  # concave in j: golden sections
        x, y = hi - 0.618 * (hi - lo), lo + 0.618 * (hi - lo)
        left = score(x) > score(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def shingle_sets(col: pa.Array, k: int):
    """The sorted set of shingle hashes of each text of an Arrow column."""
    for _, _, data, offs in X.blocks(col):
        s, e, first = X.words(data, offs)
        h = X.span_hashes(data, s, e, X.LOWER)
        for i in range(len(offs) - 1):
            yield np.unique(X.shingles(h[first[i] : first[i + 1]], k))


def _sketches(k: int):
    def run(batches):
        for b in batches:
            sets, n, f1, f2 = shingle_sets(b.column("text"), k), [], [], []
            regs = []
            for u in sets:
                n.append(len(u))
                f1.append(int(u.sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(X.mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                regs.append(registers(u).tobytes() if len(u) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(regs, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "f1", "f2", "regs"])

    return run


def _matrix(col: pa.Array) -> np.ndarray:
    data, _ = X.column_bytes(col)
    return data.view(np.uint16).reshape(len(col), BANDS * ROWS)


def _keys(regs: np.ndarray) -> np.ndarray:
    """The bucket of each band, for rows of registers."""
    m = regs.astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), m.shape[:2]).copy()
    for r in range(ROWS):
        key = X.mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return key.view(np.int64)


def _banded(batches):
    for b in batches:
        if b.num_rows:
            ids = np.repeat(b.column("id").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(_keys(_matrix(b.column("regs"))).ravel()), pa.array(ids)], ["key", "id"])


def _estimated(batches):
    for b in batches:
        if b.num_rows == 0:
            continue
        est = estimate(_matrix(b.column("ra")), _matrix(b.column("rb")), b.column("na").to_numpy(), b.column("nb").to_numpy())
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(est)], ["a", "b", "est"])


def _full_sets(k: int):
    def run(batches):
        for b in batches:
            sets = [u.view(np.int64) for u in shingle_sets(b.column("text"), k)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    return run


class _Verifier:
    """Links among pairs of vertices, confirmed on full sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, members: DataFrame, k: int, percent: int):
        self.classes, self.percent = classes, percent
        # Only texts of vertices in a bucket with company are read again and shuffled.
        ids = members.select("id").distinct()
        # A class is fetched by the row that stands for it, so rows without an id are found as well.
        one = classes.select("id", "one.at", "one.text_hash").join(ids, "id", "left_semi")
        at = docs.withColumn("at", F.coalesce("doc_id", "text_hash"))
        # Repeated rows go before they are hashed; they lie together already.
        some = at.join(one.hint("shuffle_hash"), ["at", "text_hash"]).dropDuplicates(["at", "text_hash"]).select(F.col("id").alias("doc_id"), "text")
        self.sets = written(some.mapInArrow(_full_sets(k), "id long, set array<long>"), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        c = self.classes
        both = (pairs.join(c.select(F.col("id").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na")), "a")
                .join(c.select(F.col("id").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb")), "b"))
        p = self.percent
        # Sizes alone exclude a pair whose smaller set is under the threshold's share of the larger.
        both = both.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p)
        near = written(both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated, "a long, b long, est double")
                       .filter(F.col("est") >= p / 100 - MARGIN).select("a", "b"), "near")
        full = (near.join(self.sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
                .join(self.sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a"))
        both_n = F.size(F.array_intersect("sa", "sb"))
        ok = both_n * 100 >= (F.size("sa") + F.size("sb") - both_n) * p
        return written(full.filter(ok).select("a", "b").distinct(), "links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, root and text_hash for every row of ``docs`` (doc_id, text).

    Documents are linked if 100 * |intersection| >= percent * |union| of their ``words``-word shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sk = written(docs.mapInArrow(_sketches(words), "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, regs binary"), "sketches")
    key = F.coalesce(F.min("doc_id"), F.first("f1"))
    classes = written(sk.filter("n_shingles > 0").groupBy("f1", "f2", F.col("n_shingles").alias("n"))
                      .agg(key.alias("id"), F.max("regs").alias("regs"), F.min("doc_id").alias("first_id"),
                           F.min(F.struct(F.coalesce("doc_id", "text_hash").alias("at"), "text_hash")).alias("one")), "classes")
    roots = _roots(docs, classes, words, percent)
    full = classes.join(roots, "id", "left").select("f1", "f2", "n", "first_id", F.coalesce("root", "id").alias("root"))
    least = full.groupBy("root").agg(F.min("first_id").alias("component_id"))
    full = full.join(least, "root").select("f1", "f2", F.col("n").alias("n_shingles"), "component_id", "root")
    # Copies of one text meet their class by fingerprint: the class side is small, AQE splits a hot one.
    out = sk.drop("regs").join(full, ["f1", "f2", "n_shingles"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"), "root", "text_hash")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root", "text_hash")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, all columns kept: that with the smallest id.

    Of rows that share this id the one with the smallest text hash stays, and of fully repeated rows
    one.  Rows without words are no group and all stay.
    """
    found = near_duplicates(docs, words, percent).filter("kept")
    alone = found.filter("root IS NULL").select("doc_id", "text_hash", F.lit(0).alias("n")).distinct()
    first = (found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("m"), F.count("*").alias("n"))
             .select("m.doc_id", "m.text_hash", "n"))
    keys = written(alone.unionByName(first), "kept").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "n")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("k_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("k_hash"))
    once = docs.join(keys.filter("n <= 1"), same, "left_semi")
    if keys.filter("n > 1").isEmpty():
        return once
    return once.unionByName(docs.join(keys.filter("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def _roots(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, root) of the classes that have a link."""
    bands = classes.select("id", "regs").mapInArrow(_banded, "key long, id long").distinct()
    sizes = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lead")).filter("size > 1")
    members = written(bands.join(sizes, "key"), "members")
    check = _Verifier(docs, classes, members, words, percent)
    links = check.links(members.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    roots = components(links)
    now = members.join(roots, "id", "left").select("key", "size", "id", F.coalesce("root", "id").alias("root"))
    split = now.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
    regs = classes.select("id", "n", "regs")
    todo = written(now.join(split, "key", "left_semi").join(regs, "id"), "open")
    if todo.isEmpty():
        return roots
    near = written(_block_pairs(todo, NEAR_BLOCK).groupBy("key", "p", "q").applyInArrow(_near_members(percent), "key long, id long").distinct(), "near_members")
    sized = near.join(near.groupBy("key").agg(F.count("*").alias("size")), "key")
    with_sets = sized.join(todo.drop("size"), ["key", "id"]).join(check.sets, "id")
    more = _block_pairs(with_sets, SET_BLOCK).groupBy("key", "p", "q").applyInArrow(_open_links(percent), "a long, b long").distinct()
    return components(links.unionByName(written(more, "more")))


def _block_pairs(rows: DataFrame, block: int) -> DataFrame:
    """Rows of a key, dealt to blocks by a hash of the id and repeated for each pair (p, q) of blocks theirs is in."""
    n = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(11)), n).cast("int")
    other = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return other.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("other", "size")


class _Open:
    """The pairs of a block pair that its components leave open, with their estimates."""

    def __init__(self, t: pa.Table, percent: int):
        order = np.argsort(t.column("id").to_numpy())  # so that a retried task gives the same links
        t = t.take(order)
        self.ids, self.root, self.n, self.own = (t.column(c).to_numpy() for c in ("id", "root", "n", "own"))
        self.t, self.percent = t, percent
        self.regs = _matrix(t.column("regs"))
        self.bands = self.regs.reshape(len(self.ids), BANDS, ROWS)
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        self.left = np.flatnonzero(self.own == p)
        self.right = np.flatnonzero(self.own == q)
        self.same_block = p == q
        # The band of this key is the one whose hash gives it.
        self.key = t.column("key")[0].as_py()
        first = _keys(self.regs[:1])[0]
        self.band = int(np.flatnonzero(first == np.int64(self.key))[0])

    def pairs(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """(other rows, estimates) of the open pairs of a row of the left block."""
        j = self.right[self.right > row] if self.same_block else self.right
        j = j[self.root[j] != self.root[row]]
        lo, hi = np.minimum(self.n[j], self.n[row]), np.maximum(self.n[j], self.n[row])
        j = j[lo * 100 >= hi * self.percent]
        if self.band and len(j):
            early = (self.bands[j, : self.band] == self.bands[row, : self.band]).all(axis=2).any(axis=1)
            j = j[~early]
        if not len(j):
            return j, np.zeros(0)
        # The share of equal registers bounds the estimate closely enough to spare most likelihoods.
        j = j[(self.regs[j] == self.regs[row]).mean(axis=1) >= self.percent / 100 - MARGIN - 0.03]
        est = estimate(np.broadcast_to(self.regs[row], (len(j), self.regs.shape[1])), self.regs[j], np.full(len(j), self.n[row]), self.n[j])
        ok = est >= self.percent / 100 - MARGIN
        return j[ok], est[ok]


def _near_members(percent: int):
    def run(t: pa.Table) -> pa.Table:
        o, hit = _Open(t, percent), set()
        for i in o.left.tolist():
            j, _ = o.pairs(i)
            if len(j):
                hit.add(i)
                hit.update(j.tolist())
        ids = o.ids[sorted(hit)] if hit else np.zeros(0, np.int64)
        return pa.table({"key": pa.array(np.full(len(ids), o.key, np.int64)), "id": pa.array(ids, pa.int64())})

    return run


def _open_links(percent: int):
    def run(t: pa.Table) -> pa.Table:
        o = _Open(t, percent)
        sets = [x.values.to_numpy() for x in o.t.column("set")]
        parent = {r: r for r in set(o.root.tolist())}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        pairs = []
        for i in o.left.tolist():
            j, est = o.pairs(i)
            pairs += zip((-est).tolist(), [i] * len(j), j.tolist())
        a, b = [], []
        for _, i, j in sorted(pairs):
            x, y = find(int(o.root[i])), find(int(o.root[j]))
            if x == y:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[x] = y
                a.append(int(o.ids[i]))
                b.append(int(o.ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run
