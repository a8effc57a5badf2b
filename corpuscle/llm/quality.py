"""Document quality by a generalised additive model with pairwise interactions.

Features of a whole text are shares and ratios of its bytes, words and lines.  The model is a sum of
lookup tables: one for each feature's bins and one for each chosen pair of features, learnt by cyclic
boosting of shallow trees on the bins (first all single features in turn, round by round, then the
pairs that explain most of what is left).  Scoring adds table entries by bin, vectorised.

The model is fitted in the driver on at most ``FIT_ROWS`` labelled rows (a documented bound; rows are
drawn by a hash of their id, so the draw does not depend on partitions).  Features and scores cover
every document and are computed in one pass over the texts.

Edge cases: a null text counts as empty and is scored from the features of the empty text; a null
doc_id is scored too and never trains; labels without document, null labels and documents without
label do not train; without labels of both kinds every score is the smoothed share of label 1, 0.5
where there is none; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import texts as X
from corpuscle.session import written

FIT_ROWS = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, LEAVES, RATE, RIDGE = 32, 150, 60, 6, 3, 0.15, 2.0

NAMES = (
    "log_words", "mean_word", "symbols", "bars", "upper", "digits", "stops", "quotes", "non_ascii", "lines_per_word", "distinct_words", "top_word",
    "repeated_lines", "symbol_ends", "short_words", "long_words", "capital_starts", "repeated_triples", "byte_entropy", "controls",
)

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 stop, 5 quote or bracket, 6 bar, 7 other symbol, 8 non-ASCII, 9 control, 0 space
_KIND[0x21:0x7F] = 7
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A] = 1, 2, 3
_KIND[[ord(c) for c in ".,;:!?"]] = 4
_KIND[[ord(c) for c in "\"'()[]-"]] = 5
_KIND[ord("|")] = 6
_KIND[0x80:] = 8
_KIND[:0x20], _KIND[0x7F] = 9, 9
_KIND[[0x20, *range(9, 14)]] = 0


def _shares(values: np.ndarray) -> tuple[float, float]:
    """Distinct values and the most frequent one, as shares."""
    if len(values) == 0:
        return 1.0, 0.0
    s = np.sort(values)
    edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
    return (len(edge) - 1) / len(s), float(np.diff(edge).max()) / len(s)


def features(col: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text of an Arrow column."""
    out = []
    newline = np.zeros(256, bool)
    newline[10] = True
    for _, _, data, offs in X.blocks(col):
        kind = _KIND[data]
        s, e, first = X.words(data, offs)
        h = X.span_hashes(data, s, e, X.LOWER)
        ls, le = X.runs(~newline[data], offs)
        lh = X.span_hashes(data, ls, le, X.LOWER)
        lfirst = np.searchsorted(ls, offs)
        size, last, head = e - s, kind[e - 1], kind[s]
        for i in range(len(offs) - 1):
            k, a, b = kind[offs[i] : offs[i + 1]], first[i], first[i + 1]
            n, w = max(1, len(k)), max(1, b - a)
            c = np.bincount(k, minlength=10) / n
            distinct, top = _shares(h[a:b])
            lines, _ = _shares(lh[lfirst[i] : lfirst[i + 1]])
            triples, _ = _shares(X.shingles(h[a:b], 3))
            p = np.bincount(data[offs[i] : offs[i + 1]] >> 1, minlength=128)
            p = p[p > 0] / n
            z = size[a:b]
            out.append((
                np.log1p(b - a), z.mean() if b > a else 0.0, c[7], c[6], c[1], c[3], c[4], c[5], c[8], (lfirst[i + 1] - lfirst[i]) / w, distinct, top,
                1 - lines, (last[a:b] == 7).sum() / w, (z <= 2).sum() / w, (z >= 16).sum() / w, (head[a:b] == 1).sum() / w, 1 - triples,
                float(-(p * np.log2(p)).sum()), c[9],
            ))
    return np.array(out, np.float64).reshape(len(out), len(NAMES))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values, by bin, of a tree of up to ``LEAVES`` leaves over ordered bins with these sums."""
    parts = [(0, len(g))]
    gain = lambda a, b: a * a / (b + RIDGE)
    while len(parts) < LEAVES:
        best = (1e-9, None, None)
        for i, (lo, hi) in enumerate(parts):
            if hi - lo < 2:
                continue
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            v = gain(cg[:-1], ch[:-1]) + gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain(cg[-1], ch[-1])
            j = int(np.argmax(v))
            if v[j] > best[0]:
                best = (float(v[j]), i, lo + j + 1)
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.grids):
            out += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The additive model for labels ``y`` (0 or 1) of feature rows ``x``."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    flat = Model(float(np.log(share / (1 - share))), [], [], [], [], [])
    if n == 0 or y.min() == y.max():
        return flat
    m = Model(flat.base, [_cuts(c, BINS) for c in x.T], [_cuts(c, 8) for c in x.T], [], [], [])
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, c, side="right") for e, c in zip(m.edges, x.T)]
    few = [np.searchsorted(e, c, side="right") for e, c in zip(m.coarse, x.T)]
    f = np.full(n, m.base)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j, b in enumerate(at):  # in turn, so that correlated features share the effect
            g, h = slopes()
            k = len(m.tables[j])
            step = RATE * _tree(np.bincount(b, g, k), np.bincount(b, h, k))
            m.tables[j] += step
            f += step[b]
    g, h = slopes()
    worth = []
    for i in range(len(at)):
        for j in range(i):
            k, l = len(m.coarse[i]) + 1, len(m.coarse[j]) + 1
            cell = few[i] * l + few[j]
            gs, hs = np.bincount(cell, g, k * l), np.bincount(cell, h, k * l)
            worth.append((float((gs**2 / (hs + 20 * RIDGE)).sum()), i, j))
    m.pairs = [(i, j) for _, i, j in sorted(worth, reverse=True)[:PAIRS]]
    m.grids = [np.zeros((len(m.coarse[i]) + 1, len(m.coarse[j]) + 1)) for i, j in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(m.pairs, m.grids):
            k, l = t.shape
            cell = few[i] * l + few[j]
            g, h = slopes()
            gs, hs = np.bincount(cell, g, k * l).reshape(k, l), np.bincount(cell, h, k * l).reshape(k, l)
            # A shallow tree on either axis inside the halves of the other's best split.
            rows = np.stack([_tree(gs[a:b].sum(axis=0), hs[a:b].sum(axis=0)) for a, b in ((0, k // 2), (k // 2, k)) for _ in range(b - a)]) if k > 1 else _tree(gs[0], hs[0])[None]
            step = RATE * rows
            t += step
            f += step.ravel()[cell]
    return m


def _extract(batches):
    for b in batches:
        x = features(b.column("text"))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def train(labels: DataFrame, feats: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled rows, drawn by a hash of the id."""
    lab = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    drawn = lab.join(feats.select("doc_id", "x"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(fit_rows).collect()
    x = np.array([r.x for r in drawn], np.float64).reshape(len(drawn), len(NAMES))
    return fit(x, np.array([r.y for r in drawn], np.float64))


def train_on(labels: DataFrame, docs: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled rows of ``docs`` without computing the features of all texts."""
    lab = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), label)
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(fit_rows)  # small rows: safe to broadcast
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(lab.select("doc_id").distinct()), "doc_id", "left_semi")
    return train(lab, chosen.mapInArrow(_extract, "doc_id long, x array<double>"), label, fit_rows)


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the features of every row, written once."""
    return written(docs.select("doc_id", "text").mapInArrow(_extract, "doc_id long, x array<double>"), "features")


def scored(feats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of features."""

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return feats.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, all columns kept."""
    names = docs.columns

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(features(b.column("text"))) >= least)).select(names)

    return docs.mapInArrow(run, docs.schema)


def not_held_out(doc_id="doc_id", folds: int = 3, held: int = 1):
    """The id is not in the fold kept for testing: crc32 of the id's digits, modulo the folds."""
    return F.crc32(F.col(doc_id).cast("string")) % folds != held
