"""Vectors as a few bytes: product codes from codebooks trained on all vectors by active-entry Lloyd rounds.

Components become integers, vectors are cut into parts, and each part position has a codebook.  A round assigns
every part to the nearest entry of its codebook and then moves each entry to the floor of its parts' mean.  Each
part carries its entry and the exact distance to it from round to round.  A part whose entry did not move
compares only the entries that moved with the stored distance: all others are no nearer than before.  A part
whose entry moved is compared with the whole codebook.  Equal distances go to the lower entry in both cases, so
the codes are those of full scans.

A round is one pass of Arrow batches over a written table: parts are assigned by matrix products, and each task adds
the sums of its own parts, one row for every entry it used.  Those partial sums meet by (part, entry, component);
only the new codebooks (entries x dimension numbers) reach the driver and travel to the tasks.  Every round's
table lies in the shared folder, so a lost executor costs the tasks of one round.

Products are exact: they are taken in doubles while every sum stays below 2**53 and in Python integers beyond.
A component whose integer, or a distance that, does not fit 64 bits is an error and is never clamped.

Edge cases: vectors that are null or hold null or non-finite components are dropped; a dimension that is no
multiple of the number of parts, and vectors shorter than the longest, count as padded with zeros; null ids come
after all others when the first entries are chosen, and rows that share an id are ordered by their vectors; repeated
rows are coded each; fewer rows than entries make smaller codebooks; null labels are a label of their own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.bitsliced import usable
from corpuscle.operators.index import broadcast_if_small
from corpuscle.session import written

EXACT = 1 << 53
#: Rows assigned at once: bounds the matrix of distances.
BLOCK = 2048


def integers(col: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column, padded with zeros to ``width`` columns."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.diff(col.offsets.to_numpy())
    flat = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if not (np.abs(flat) < 2.0**62).all():
        raise OverflowError("a vector component does not fit 64 bits")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat.astype(np.int64)
    return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the rows of ``c``."""
    far = max((int(np.abs(a).max(initial=0)) for a in (x, c)), default=0)
    if x.shape[1] * (2 * far) ** 2 < EXACT:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    x, c = x.astype(object), c.astype(object)
    out = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2) if x.shape[1] else np.zeros((len(x), len(c)), object)
    if out.size and max(out.ravel().tolist()) >= 1 << 63:
        raise OverflowError("a squared distance does not fit 64 bits")
    return out.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray, moved: np.ndarray | None = None, entry: np.ndarray | None = None,
            stored: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, distance, compared): the nearest entries of ``book``, the lowest where several are.

    With ``moved`` (one flag an entry), the entries and exact distances before the move are used: rows on
    entries that stayed look at moved entries only.  ``compared`` counts the distances taken.
    """
    if moved is None:
        d = distances(x, book)
        e = d.argmin(1)
        return e, d[np.arange(len(x)), e], d.size
    entry, stored, taken = entry.copy(), stored.copy(), 0
    gone = moved[entry]
    full, active = np.flatnonzero(gone), np.flatnonzero(moved)
    if len(full):
        entry[full], stored[full], taken = nearest(x[full], book)
    stay = np.flatnonzero(~gone)
    if len(stay) and len(active):
        d = distances(x[stay], book[active])
        a = d.argmin(1)
        near, e = d[np.arange(len(stay)), a], active[a]
        better = (near < stored[stay]) | ((near == stored[stay]) & (e < entry[stay]))
        at = stay[better]
        entry[at], stored[at] = e[better], near[better]
        taken += d.size
    return entry, stored, taken


_STATE = "vec_id {id}, label {label}, v array<bigint>, entry array<int>, dist array<bigint>, part int, slot int, n bigint, sums array<decimal(38,0)>"


def _assign(books: np.ndarray, moved: np.ndarray | None, scale: int):
    """A pass over rows of (vec_id, label, v, entry, dist), which yields them anew and then the sums of the task's parts."""
    parts, entries, wide = books.shape

    def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))

    def run(batches):
        total, count, ids = np.zeros((parts, entries, wide), object), np.zeros((parts, entries), np.int64), None
        for b in batches:
            ids = b.schema.field("vec_id").type, b.schema.field("label").type
            for a in range(0, b.num_rows, BLOCK):
                some = b.slice(a, BLOCK)
                first = moved is None
                v = integers(some.column("v"), parts * wide, scale if first else 1) if first else _long_matrix(some.column("v"), parts * wide)
                old = None if first else (_long_matrix(some.column("entry"), parts), _long_matrix(some.column("dist"), parts))
                entry, dist = np.zeros((len(v), parts), np.int64), np.zeros((len(v), parts), np.int64)
                for q in range(parts):
                    x = v[:, q * wide : (q + 1) * wide]
                    entry[:, q], dist[:, q], _ = nearest(x, books[q]) if first else nearest(x, books[q], moved[q], old[0][:, q], old[1][:, q])
                    sums = np.zeros((entries, wide), object if int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62 else np.int64)
                    np.add.at(sums, entry[:, q], x)
                    total[q] += sums
                    count[q] += np.bincount(entry[:, q], minlength=entries)
                none = len(v)
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id"), some.column("label"), lists(v, pa.int64()), lists(entry.astype(np.int32), pa.int32()), lists(dist, pa.int64()),
                     pa.nulls(none, pa.int32()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.decimal128(38, 0)))],
                    names=["vec_id", "label", "v", "entry", "dist", "part", "slot", "n", "sums"])
        if ids:
            part, slot = np.nonzero(count)
            none = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(none, ids[0]), pa.nulls(none, ids[1]), pa.nulls(none, pa.list_(pa.int64())), pa.nulls(none, pa.list_(pa.int32())), pa.nulls(none, pa.list_(pa.int64())),
                 pa.array(part, pa.int32()), pa.array(slot, pa.int32()), pa.array(count[part, slot], pa.int64()),
                 pa.array([[int(s) for s in row] for row in total[part, slot]], pa.list_(pa.decimal128(38, 0)))],
                names=["vec_id", "label", "v", "entry", "dist", "part", "slot", "n", "sums"])

    return run


def _long_matrix(col: pa.Array, width: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), width)


def _moved_books(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks after a round, and which entries moved; entries without parts stay."""
    each = state.filter("part IS NOT NULL").select("part", "slot", "n", F.posexplode("sums").alias("at", "s"))
    means = each.groupBy("part", "slot", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # parts x entries x width numbers
    new = books.copy()
    for r in means:
        new[r.part, r.slot, r.at] = int(r.s) // r.n
    return new, (new != books).any(2)


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, vec_id: str = "vec_id",
          embedding: str = "embedding", label: str = "label") -> tuple[DataFrame | None, np.ndarray]:
    """(state, codebooks): every vector's entries and exact distances after the last round, and the final codebooks.

    ``state`` holds vec_id, label, the integers ``v``, ``entry`` and ``dist``; it is None for an empty table.
    """
    kept = vectors.filter(usable(F.col(embedding))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    longest = kept.agg(F.max(F.size("v")).alias("n")).first().n
    if longest is None:
        return None, np.zeros((parts, 0, 0), np.int64)
    wide = -(-longest // parts)
    # Written before it is read: the limit is then taken by the executors, and the driver reads ``entries`` rows.
    first = written(kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries), "first_entries")
    rows = [r.v for r in first.orderBy(F.asc_nulls_last("vec_id"), "v").collect()]
    books = integers(pa.array(rows, pa.list_(pa.float64())), parts * wide, scale).reshape(len(rows), parts, wide).transpose(1, 0, 2).copy()
    types = {"id": kept.schema["vec_id"].dataType.simpleString(), "label": kept.schema["label"].dataType.simpleString()}
    state, moved = kept, None
    for turn in range(rounds + 1):
        state = written(state.mapInArrow(_assign(books, moved, scale), _STATE.format(**types)), "codes")
        if turn < rounds:
            books, moved = _moved_books(state, books)
            state = state.filter("part IS NULL").select("vec_id", "label", "v", "entry", "dist")
    return state.filter("part IS NULL").select("vec_id", "label", "v", "entry", "dist"), books


def books_sha256(books: np.ndarray) -> str:
    """Digest of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, label: str = "label", **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    state, books = train(vectors, parts, entries, label=label, **options)
    digits = max(2, len(f"{entries - 1:x}"))
    if state is None:
        return vectors.limit(0).select(F.col(options.get("vec_id", "vec_id")).alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                       F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    code = F.lower(F.concat(*[F.lpad(F.hex(F.col("entry")[q]), digits, "0") for q in range(parts)]))
    coded = state.select("vec_id", "label", code.alias("code"), F.aggregate("dist", F.lit(0).cast("long"), lambda a, x: a + x).alias("error"))
    # Partial sums per task make a label one row; labels may be as many as vectors, so the size decides the join.
    totals = written(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    out = coded.join(broadcast_if_small(totals), F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
