"""Exact top-k inner products over a bit-sliced index.

Vectors become integers floor(scale * x).  A block of rows keeps, for every component, one bitmap for
each bit of its (shifted, non-negative) values: the slices.  A query adds, weight by weight, the slices
its own bits select, with carry-save adders on whole bitmaps; a negative query component takes the
complement.  The result is a bit-sliced column of scores, from whose most significant slice downward the
rows of the top k are selected by and, or and population counts; rows that tie at the border are resolved
by the smaller id.  Scores are read back from the slices and are exact.

Blocks of rows meet parts of the query set by key, so neither side is broadcast or collected; a block's
k best rows of each query are merged by an aggregate over at most k rows a block.

Edge cases: vectors that are null or hold null or non-finite components take no part, as query or
candidate; shorter vectors count as padded with zeros; a query's candidates exclude all rows with its
id; repeated rows are candidates each, repeated equal queries are answered once and different queries of
one id each; null ids take no part; ties go to the smaller id; components or scores that 64 bits can't
hold end the job with an error instead of a wrong rank; fewer candidates than k are all returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import written

BLOCK_ROWS, QUERY_ROWS = 65_536, 128


def quantised(v: Column, scale: int) -> Column:
    """floor(scale * x) of every component, exact in 64 bits; larger ones are an error."""

    def one(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < 2.0**63, F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("vector component beyond 64 bits after scaling")).cast("long"))

    return F.transform(v, one)


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros to one width."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def slices(a: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(shift, bits, bitmaps[component, bit, word]) of a matrix of integers."""
    low = int(a.min(initial=0))
    bits = max(1, (int(a.max(initial=0)) - low).bit_length())
    up = np.ascontiguousarray((a.astype(np.uint64) - np.uint64(low % 2**64)).T)  # modulo 2**64, so wide ranges fit
    words = -(-a.shape[0] // 64)
    out = np.zeros((up.shape[0], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((up >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return low, bits, out.view(np.uint64)


def _added(planes: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bit slices of the sum of bitmaps given by weight."""
    out, w = [], 0
    while planes:
        col = planes.pop(w, [])
        up = planes.setdefault(w + 1, [])
        while len(col) > 1:
            if len(col) == 2:
                a, b = col
                up.append(a & b)
                col = [a ^ b]
            else:
                a, b, c = col.pop(), col.pop(), col.pop()
                t = a ^ b
                carry = a & b
                carry |= t & c
                t ^= c
                up.append(carry)
                col.insert(0, t)
        if not up:
            del planes[w + 1]
        out.append(col[0] if col else None)
        w += 1
    return out


def _top(total: list[np.ndarray | None], open_: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the rows in the top k among ``open_`` and of all rows that tie at the border."""
    sure, tied = np.zeros_like(open_), open_
    for plane in reversed(total):
        ones = tied & plane if plane is not None else np.zeros_like(tied)
        more = sure | ones
        n = int(np.bitwise_count(more).sum())
        if n >= k:
            tied = ones
            if n == k:
                break
        else:
            sure = more
            tied = tied & ~plane if plane is not None else tied
    return sure | tied


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search(ids: np.ndarray, index: tuple[int, int, np.ndarray], queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query row, id, score) of the k best rows of one block (``ids`` ascending) for each query."""
    low, bits, maps = index
    words = maps.shape[2]
    every = np.zeros(words * 8, np.uint8)
    packed = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
    every[: len(packed)] = packed
    every = every.view(np.uint64)
    inverse = ~maps
    out = []
    for row, (q, own) in enumerate(zip(queries, query_ids)):
        planes: dict[int, list[np.ndarray]] = {}
        base, top = 0, (1 << bits) - 1
        for j, x in enumerate(q[: maps.shape[0]].tolist()):
            # x * a = x * (a' + low); for x < 0 the complement c = top - a' gives |x| * c - |x| * top + x * low.
            base += x * low - (-x * top if x < 0 else 0)
            side, x = (maps, x) if x > 0 else (inverse, -x)
            shift = 0
            while x:
                if x & 1:
                    for b in range(bits):
                        planes.setdefault(b + shift, []).append(side[j, b])
                x >>= 1
                shift += 1
        total = _added(planes)
        a, b = np.searchsorted(ids, [own, own + 1])
        open_ = every
        if b > a:
            open_ = every.copy()
            hide = np.zeros(words * 64, np.uint8)
            hide[a:b] = 1
            open_ &= ~np.packbits(hide, bitorder="little").view(np.uint64)
        best = []
        for r in _rows(_top(total, open_, k)).tolist():
            w, s = r >> 6, np.uint64(r & 63)
            best.append((-(base + sum(int((p[w] >> s) & np.uint64(1)) << i for i, p in enumerate(total) if p is not None)), r))
        out += [(row, int(ids[r]), -s) for s, r in sorted(best)[:k]]
    return out


def _build(batches):
    """One block of slices from all rows of a partition, cut into blocks of bounded size."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId() << 20, 0
    ids, rows, n = [], [], 0

    def block():
        i, m = np.concatenate(ids), np.zeros((n, max(r.shape[1] for r in rows)), np.int64)
        at = 0
        for r in rows:
            m[at : at + len(r), : r.shape[1]] = r
            at += len(r)
        order = np.argsort(i, kind="stable")
        low, bits, maps = slices(m[order])
        return pa.RecordBatch.from_pylist(
            [{"block": part + made, "ids": i[order].astype(np.int64).tobytes(), "low": low, "bits": bits, "maps": maps.tobytes()}],
            pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("low", pa.int64()), ("bits", pa.int32()), ("maps", pa.binary())]))

    for b in batches:
        if not b.num_rows:
            continue
        ids.append(b.column("vec_id").to_numpy())
        rows.append(_matrix(b.column("a")))
        n += b.num_rows
        if n >= BLOCK_ROWS:
            yield block()
            ids, rows, n, made = [], [], 0, made + 1
    if n:
        yield block()


def _searched(k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
        if queries.num_rows:
            q, qi, qr = _matrix(queries.column("a")), queries.column("vec_id").to_numpy(), queries.column("query_row").to_pylist()
            for r in index.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                words = -(-len(ids) // 64)
                maps = np.frombuffer(r["maps"], np.uint64).reshape(-1, r["bits"], words)
                for row, vec, score in search(ids, (r["low"], r["bits"], maps), q, qi, k):
                    for c, v in zip(out, (int(qi[row]), qr[row], vec, score)):
                        out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows for every query row of (vec_id, embedding)."""
    rows = (vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
            .select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("a"), is_query.alias("is_query")))
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    index = written(rows.select("vec_id", "a").repartition(blocks).mapInArrow(_build, "block long, ids binary, low long, bits int, maps binary"), "slices")
    queries = written(rows.filter("is_query").select("vec_id", "a").distinct().withColumn("query_row", F.xxhash64("vec_id", "a")), "queries")
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    numbers = [r.block for r in index.select("block").collect()]  # one number a block of rows
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    part = F.pmod(F.xxhash64("query_row"), F.lit(parts)).cast("int")
    right = queries.select("vec_id", "a", "query_row", part.alias("part"), F.explode(F.array(*map(F.lit, numbers)).cast("array<bigint>")).alias("block"))
    best = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        _searched(k), "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
