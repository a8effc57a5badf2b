"""Exact vector search over cells: a question visits only cells that may hold one of its k best.

Vectors are dealt to the nearest of a bounded number of centres.  A cell knows its centre, its radius (the distance
of its farthest vector), its largest squared length and its size; a crowded cell is dealt to parts of bounded size.  No
vector x of a cell can score more for a question q than

    min(q.c + |q| r,  (|q|^2 + max |x|^2 - max(0, |q - c| - r)^2) / 2),

by the triangle inequality.  A search first visits the cells of the highest bounds until they hold ``AHEAD`` times k
vectors; the k-th best score found is a floor, and in a second step the question visits the cells whose bounds reach
it.  Vectors stay where they are: a question's row is sent to the cells it visits and to no others.  Only the cells'
summary, bounded by their number, reaches the driver and the tasks.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscle.operators.index import broadcast_if_small
from corpuscle.session import written

#: Centres at most, vectors in a part of a cell, vectors that the first step visits as a multiple of k.
CELLS, PART, AHEAD = 256, 16_384, 4
#: Scores are compared at six decimals.
MARGIN = 2e-6

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the plan


@dataclass(frozen=True)
class Cells:
    """``rows`` (key, vector, cell, part, other columns of the source), and per cell centre, radius, max |x|^2, size, parts."""

    rows: DataFrame
    key: str
    col: str
    centres: np.ndarray
    radius: np.ndarray
    largest: np.ndarray
    sizes: np.ndarray
    parts: np.ndarray


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1), 0.0))


def build(vectors: DataFrame, key: str, col: str = "embedding", cells: int = CELLS) -> Cells:
    """Deal vectors (key, col, ...) of one dimension to cells.

    Centres are vectors drawn by the hash of their keys, so the same table gives the same cells; they decide how
    much is visited and never what is found.
    """
    import pyarrow as pa

    drawn = written(vectors.select(F.xxhash64(key).alias("h"), col).orderBy("h", col).limit(cells), "centres")
    centres = np.unique(np.array([r[0] for r in drawn.select(col).collect()], np.float64), axis=0) if not drawn.isEmpty() else np.zeros((0, 0))

    def deal(batches):
        for b in batches:
            x = _matrix(b.column(col))
            d = _distances(x, centres)
            cell = d.argmin(1)
            far = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64()), pa.array((x * x).sum(1), pa.float64())],
                                             names=[*b.schema.names, "cell", "_far", "_sq"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields) + ", cell int, _far double, _sq double"
    dealt = written(vectors.mapInArrow(deal, schema), "dealt") if len(centres) else written(vectors.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("_far"), F.lit(0.0).alias("_sq")), "dealt")
    known = {r.cell: r for r in dealt.groupBy("cell").agg(F.max("_far").alias("far"), F.max("_sq").alias("sq"), F.count("*").alias("n")).collect()}
    radius, largest, sizes = (np.array([getattr(known[c], name) if c in known else 0 for c in range(len(centres))], np.float64) for name in ("far", "sq", "n"))
    parts = np.maximum(-(-sizes.astype(np.int64) // PART), 1)
    of_cell = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("cell") + 1) if len(centres) else F.lit(1)
    rows = dealt.drop("_far", "_sq").withColumn("part", F.pmod(F.xxhash64(key), of_cell).cast("int"))
    return Cells(rows, key, col, centres, radius, largest, sizes, parts)


def bounds(q: np.ndarray, c: Cells) -> np.ndarray:
    """The most that a vector of each cell can score for each question; minus infinity for empty cells."""
    length = np.sqrt((q * q).sum(1))
    by_angle = q @ c.centres.T + length[:, None] * c.radius
    by_distance = ((q * q).sum(1)[:, None] + c.largest - np.maximum(_distances(q, c.centres) - c.radius, 0.0) ** 2) / 2
    return np.where(c.sizes > 0, np.minimum(by_angle, by_distance) + MARGIN, -np.inf)


def visits(questions: DataFrame, c: Cells, k: int, query_key: str, floors: bool = False) -> DataFrame:
    """(query_key, _q, cell, part): the cells a question visits first, or, with ``floors`` and a column ``floor``, all others that reach it."""
    import pyarrow as pa

    summary = Cells(None, c.key, c.col, c.centres, c.radius, c.largest, c.sizes, c.parts)  # without the table
    ahead = AHEAD * k

    def go(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("_q"))
            top = bounds(q, summary)
            order = np.argsort(-top, axis=1, kind="stable")
            held = np.take_along_axis(np.broadcast_to(summary.sizes, top.shape), order, 1)
            first = np.zeros(top.shape, bool)
            np.put_along_axis(first, order, held.cumsum(1) - held < ahead, 1)
            first &= np.isfinite(top)
            if floors:
                floor = b.column("floor").to_numpy(zero_copy_only=False)
                first = ~first & np.isfinite(top) & (top >= np.where(np.isnan(floor), -np.inf, floor)[:, None])
            row, cell = np.nonzero(first)
            n = summary.parts[cell]
            part = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
            rows = pa.array(np.repeat(row, n))
            yield pa.RecordBatch.from_arrays([b.column(query_key).take(rows), b.column("_q").take(rows), pa.array(np.repeat(cell, n), pa.int32()), pa.array(part, pa.int32())],
                                             names=[query_key, "_q", "cell", "part"])

    kinds = {f.name: f.dataType.simpleString() for f in questions.schema.fields}
    return questions.mapInArrow(go, f"{query_key} {kinds[query_key]}, _q {kinds['_q']}, cell int, part int")


def _visited(rows: DataFrame, seen: DataFrame, c: Cells, k: int, query_key: str) -> DataFrame:
    """The k best vectors of each visited part for each question that visits its cell."""
    key, col = c.key, c.col
    q_kind, v_kind = seen.schema[query_key].dataType.simpleString(), rows.schema[key].dataType.simpleString()

    def best(v, q):
        import pyarrow as pa
        import pyarrow.compute

        names, ids = v.column(key).combine_chunks(), q.column(query_key).combine_chunks()
        out = {query_key: [ids[:0]], key: [names[:0]], "score": [pa.array([], pa.float64())]}
        if len(names) and len(ids):
            by_name = pa.compute.sort_indices(names)
            m, names = _matrix(v.column(col))[by_name.to_numpy()], names.take(by_name)
            x = _matrix(q.column("_q"))
            for a in range(0, len(x), 256):
                s = np.round(x[a : a + 256] @ m.T, 6)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                out[query_key].append(ids.take(pa.array(np.repeat(np.arange(a, a + len(s)), top.shape[1]))))
                out[key].append(names.take(pa.array(top.ravel())))
                out["score"].append(pa.array(np.take_along_axis(s, top, 1).ravel()))
        return pa.table({n: pa.concat_arrays(some) for n, some in out.items()})

    return rows.select(key, col, "cell", "part").groupBy("cell", "part").cogroup(seen.groupBy("cell", "part")).applyInArrow(
        best, f"{query_key} {q_kind}, {key} {v_kind}, score double")


def top_k(questions: DataFrame, c: Cells, k: int, query_key: str = "query_id", col: str = "embedding", keep: Column | None = None) -> DataFrame:
    """(query_key, key, score, rank): the k best dot products of each question, ties by key.

    ``keep`` restricts the vectors by columns of the source; bounds of whole cells hold for any part of them.
    """
    rows = c.rows if keep is None else c.rows.where(keep)
    asked = written(questions.select(query_key, F.col(col).alias("_q")), "asked")
    place = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), c.key))
    if not len(c.centres):
        none = rows.select(F.col(c.key), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        return asked.select(query_key).limit(0).join(none, F.lit(True))
    found = written(_visited(rows, visits(asked, c, k, query_key), c, k, query_key).withColumn("rank", place).where(F.col("rank") <= k).drop("rank"), "first_visits")
    floor = found.groupBy(query_key).agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).drop("n")
    again = asked.join(broadcast_if_small(floor, asked), query_key, "left").select(query_key, "_q", "floor")
    more = _visited(rows, visits(again, c, k, query_key, floors=True), c, k, query_key)
    return found.unionByName(more).withColumn("rank", place).where(F.col("rank") <= k)
