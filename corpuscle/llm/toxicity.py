"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are words and beginnings of words.  The vocabulary is counted over all labelled rows: terms that
stand significantly more often in toxic or in other examples, in either direction, and of those the
``VOCABULARY`` most significant (a documented bound of the model).  Document frequencies come from all
documents, and every labelled example with such a term is indexed.

The index is inverted and cut into blocks of documents; each posting list knows its largest weight in a
block, so a block's best possible cosine is a sum over the query's terms.  Blocks are visited from the
highest bound down until no bound can reach the k-th cosine found: the result is exact.  Equal vectors
are searched once.  Shards of the index meet parts of the distinct vectors by key; nothing that grows
with the corpus is broadcast or collected.

The votes of the ``K`` nearest, weighted by cosine and smoothed by the share of toxic examples, are
calibrated by logistic scaling on a bounded draw of at most ``FIT_ROWS`` training rows, an example never
voting for itself.

Edge cases: equal cosines go to the smaller id; an id labelled both ways counts as toxic, one with several
texts is an example by its largest text; very long texts are read whole; a null or empty text, or one without vocabulary terms, has no neighbour and gets the
calibrated share; null labels, labels without document and null ids do not train; rows that share an id
are scored by their own text; without labels of both kinds the vocabulary is empty and every score is
the smoothed share, 0.5 where there is none; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm import texts as X
from corpuscle.session import written

FIT_ROWS, VOCABULARY, BROADCAST_ROWS = 20_000, 65_536, 1_000_000
K, PRIOR_WEIGHT, LIFT = 15, 1.0, 2.0
BLOCK, SHARD, PART = 128, 131_072, 8_192
PREFIXES = (4, 5, 6, 7)
_LETTER = np.ones(256, bool)
_LETTER[0x80:] = False
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def _terms(col: pa.Array):
    """For each block of texts: first row, term hashes, and the row of each term."""
    for a, _, data, offs in X.blocks(col):
        s, e, first = X.words(data, offs, _LETTER)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        h, r = [X.span_hashes(data, s, e, X.LOWER)], [row]
        for p in PREFIXES:
            long = e - s > p
            h.append(X.mix(X.span_hashes(data, s[long], s[long] + p, X.LOWER) + np.uint64(p)))
            r.append(row[long])
        yield a, np.concatenate(h), np.concatenate(r)


def _counted(batches):
    """(term, toxic, other): in how many examples of the batch a term stands."""
    for b in batches:
        y = b.column("y").to_numpy(zero_copy_only=False).astype(bool)
        seen, label = [], []
        for a, h, r in _terms(b.column("text")):
            order = np.lexsort((h, r))
            h, r = h[order], r[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            seen.append(h[new])
            label.append(y[a + r[new]])
        if seen:
            term, at = np.unique(np.concatenate(seen), return_inverse=True)
            label = np.concatenate(label)
            pos = np.bincount(at, label, len(term)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(term)) - pos)], ["term", "toxic", "other"])


def fit_vocabulary(docs: DataFrame, labels: DataFrame, size: int = VOCABULARY, lift: float = LIFT) -> np.ndarray:
    """Sorted hashes of the terms that one kind of examples holds at least ``lift`` times as often as the other, by chi-square."""
    totals = {r.y: r.n for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    # Two numbers a label: broadcast below a checked count, so that the texts are not shuffled.
    rows = docs.join(F.broadcast(labels) if n1 + n0 <= BROADCAST_ROWS else labels, "doc_id").select("text", "y")
    per_term = rows.mapInArrow(_counted, "term long, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    det = a * (n0 - b) - b * (n1 - a)
    chi = (n1 + n0) * det * det / (n1 * n0 * F.greatest(a + b, F.lit(1.0)) * F.greatest(n1 + n0 - a - b, F.lit(1.0)))
    apart = (a / n1 >= lift * b / n0) | (b / n0 >= lift * a / n1)
    best = per_term.filter(apart & (a + b >= 3)).select("term", chi.alias("chi")).filter("chi >= 10.83").orderBy(F.desc("chi"), "term").limit(size)
    return np.sort(np.array([r.term for r in best.collect()], np.int64).view(np.uint64))


def _vectors(vocabulary: np.ndarray):
    hit = np.zeros(1 << 16, bool)
    hit[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def run(batches):
        for b in batches:
            terms: list = [None] * b.num_rows
            tfs: list = [None] * b.num_rows
            if len(vocabulary):
                for a, h, r in _terms(b.column("text")):
                    may = np.flatnonzero(hit[(h & np.uint64(0xFFFF)).astype(np.int64)])
                    h, r = h[may], r[may]
                    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    ok = vocabulary[at] == h
                    cell, n = np.unique(r[ok] * len(vocabulary) + at[ok], return_counts=True)
                    row, term = np.divmod(cell, len(vocabulary))
                    cuts = np.flatnonzero(np.diff(row)) + 1
                    for i, t, c in zip(row[np.concatenate(([0], cuts)).astype(int)] if len(row) else [], np.split(term, cuts), np.split(n, cuts)):
                        terms[a + int(i)], tfs[a + int(i)] = t.astype(np.int32), c.astype(np.int32)
            none = np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), *(pa.array([none if x is None else x for x in v], pa.list_(pa.int32())) for v in (terms, tfs))],
                ["doc_id", "terms", "tf"])

    return run


class Index:
    """Block-max inverted index of unit vectors: postings by (term, block) cell and each cell's largest weight."""

    def __init__(self, ids, labels, terms, weights, size: int):
        """``terms`` and ``weights`` are lists of arrays, one for each document."""
        # Similar documents share blocks if they are ordered by their heaviest term.
        lead = np.array([t[np.argmax(w)] for t, w in zip(terms, weights)])
        order = np.lexsort((ids, lead))
        self.ids, self.labels = np.asarray(ids)[order], np.asarray(labels)[order]
        n = np.array([len(terms[i]) for i in order])
        doc = np.repeat(np.arange(len(order)), n)
        term, weight = np.concatenate([terms[i] for i in order]), np.concatenate([weights[i] for i in order])
        by = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[by], weight[by], term[by]
        self.blocks = -(-len(order) // BLOCK)
        cell = term.astype(np.int64) * self.blocks + self.doc // BLOCK
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        self.cells, self.starts = cell[starts], np.append(starts, len(cell))
        # Rounded up, so that a bound never falls below a cosine.
        self.top = np.nextafter(np.maximum.reduceat(self.weight, starts).astype(np.float32), np.float32(2))
        self.first = np.searchsorted(self.cells, np.arange(size + 1, dtype=np.int64) * self.blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int, int]]:
        """(cosine, id, label) of the ``k`` best documents with a common term, ties to the smaller id."""
        lo, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        cell = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
        bound = np.bincount(self.cells[cell] % self.blocks, self.top[cell] * np.repeat(weights, n), self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        best: list[tuple[float, int, int]] = []
        step, at = 4, 0
        while at < len(order):
            if len(best) >= k and bound[order[at]] < -best[k - 1][0] - 1e-6:
                break
            group = np.sort(order[at : at + step])
            at, step = at + step, step * 2
            cell = (terms.astype(np.int64) * self.blocks)[:, None] + group
            j = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
            i, g = np.nonzero(self.cells[j] == cell)
            j = j[i, g]
            lo, n = self.starts[j], self.starts[j + 1] - self.starts[j]
            ends = np.cumsum(n)
            post = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(lo - ends + n, n)
            slot = np.repeat(g, n) * BLOCK + self.doc[post] % BLOCK
            score = np.bincount(slot, self.weight[post] * np.repeat(weights[i], n), len(group) * BLOCK)
            some = np.flatnonzero(score > 0)
            if len(some) > k:
                # Everything that ties with the k-th stays for the order by id.
                some = some[score[some] >= np.partition(score[some], -k)[-k] - 1e-9]
            rows = group[some // BLOCK] * BLOCK + some % BLOCK
            found = zip(-np.round(score[some], 9), self.ids[rows], self.labels[rows])
            best = sorted(best + [(float(s), int(d), int(y)) for s, d, y in found])[:k]
        return [(-s, d, y) for s, d, y in best]


def _unit(terms: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(tf.astype(np.float64))) * idf[terms]
    return w / np.sqrt((w * w).sum())


def _lists(col) -> list[np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.split(col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()[1:-1] - col.offsets.to_numpy()[0]) if len(col) else []


def _sharded(batches):
    """Rows of a partition, packed into shards of bounded size."""
    from pyspark import TaskContext

    part, made, held, n = TaskContext.get().partitionId() << 20, 0, [], 0

    def shard():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as w:
            for b in held:
                w.write_batch(b)
        return pa.RecordBatch.from_arrays([pa.array([part + made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["shard", "rows"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= SHARD:
            yield shard()
            held, n, made = [], 0, made + 1
    if n:
        yield shard()


def _searched(idf: np.ndarray, k: int):
    def run(shards: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"v1": [], "v2": [], "cosine": [], "id": [], "y": []}
        if queries.num_rows:
            q_terms, q_tf = _lists(queries.column("terms")), _lists(queries.column("tf"))
            v1, v2 = queries.column("v1").to_pylist(), queries.column("v2").to_pylist()
            for rows in shards.column("rows").to_pylist():
                t = pa.ipc.open_stream(rows).read_all()
                terms = _lists(t.column("terms"))
                weights = [_unit(a, b, idf) for a, b in zip(terms, _lists(t.column("tf")))]
                index = Index(t.column("doc_id").to_numpy(), t.column("y").to_numpy(), terms, weights, len(idf))
                for i in range(len(q_terms)):
                    for s, d, y in index.nearest(q_terms[i], _unit(q_terms[i], q_tf[i], idf), k):
                        for c, x in zip(out, (v1[i], v2[i], s, d, y)):
                            out[c].append(x)
        return pa.table({c: pa.array(x, pa.float64() if c == "cosine" else pa.int64()) for c, x in out.items()})

    return run


def _logistic(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic scaling with slightly smoothed targets (Newton steps)."""
    a, b = 1.0, 0.0
    if len(y) == 0 or y.min() == y.max():
        return a, b
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * v + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - t) * v).sum() + 0.01 * (a - 1), (p - t).sum()])
        h = np.array([[(w * v * v).sum() + 0.01, (w * v).sum()], [(w * v).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def scores(docs: DataFrame, labels: DataFrame, k: int = K, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score, neighbours, cosines) for every row of ``docs`` from labels (doc_id, y in 0 and 1)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = written(labels.filter("doc_id IS NOT NULL AND y IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("y").cast("long").alias("y")), "labels")
    total = labels.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    share = (total.t + 1) / (total.n + 2)
    vocabulary = fit_vocabulary(docs, labels)
    vec = docs.mapInArrow(_vectors(vocabulary), "doc_id long, terms array<int>, tf array<int>")
    vec = written(vec.withColumn("v1", F.xxhash64("terms", "tf")).withColumn("v2", F.xxhash64("tf", "terms")), "vectors")
    some = vec.filter(F.size("terms") > 0)
    idf = np.ones(len(vocabulary))
    n = vec.count()
    for r in some.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # at most the vocabulary
        idf[r.t] = np.log((1 + n) / (1 + r.df)) + 1
    examples = some.join(labels, "doc_id").groupBy("doc_id", "y").agg(F.max(F.struct("terms", "tf")).alias("x")).select("doc_id", "y", "x.*")
    shards = written(examples.repartition(max(1, -(-total.n // SHARD))).mapInArrow(_sharded, "shard long, rows binary"), "shards")
    numbers = [r.shard for r in shards.select("shard").collect()]  # one number a shard
    distinct = written(some.select("v1", "v2", "terms", "tf").dropDuplicates(["v1", "v2"]), "queries")
    parts = max(1, -(-distinct.count() // PART))
    left = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = distinct.withColumn("part", F.pmod("v1", F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.array(*map(F.lit, numbers)).cast("array<bigint>")))
    near = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(
        _searched(idf, k + 1), "v1 long, v2 long, cosine double, id long, y long")
    rank = F.row_number().over(Window.partitionBy("v1", "v2").orderBy(F.desc("cosine"), "id"))
    near = near.withColumn("r", rank).filter(F.col("r") <= k + 1)
    near = near.groupBy("v1", "v2").agg(F.array_sort(F.collect_list(F.struct("r", "cosine", "id", "y"))).alias("near"))  # k + 1 at most
    with_near = vec.select("doc_id", "v1", "v2", F.size("terms").alias("n")).join(near, ["v1", "v2"], "left")
    own = F.slice(F.filter(F.coalesce("near", F.array().cast(near.schema["near"].dataType)), lambda x: ~x["id"].eqNullSafe(F.col("doc_id"))), 1, k)
    add = lambda f: F.aggregate("votes", F.lit(0.0), lambda s, x: s + f(x))
    vote = (add(lambda x: x["cosine"] * x["y"]) + PRIOR_WEIGHT * share) / (add(lambda x: x["cosine"]) + PRIOR_WEIGHT)
    voted = written(with_near.select("doc_id", own.alias("votes")).withColumn("vote", F.log(vote / (1 - vote))), "votes")
    drawn = voted.join(labels, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("vote", "y").collect()
    a, b = _logistic(np.array([r.vote for r in drawn], np.float64), np.array([r.y for r in drawn], np.float64))
    score = 1 / (1 + F.exp(-(F.col("vote") * a + b)))
    return voted.select("doc_id", score.alias("score"), F.transform("votes", lambda x: x["id"]).alias("neighbours"), F.transform("votes", lambda x: x["cosine"]).alias("cosines"))
