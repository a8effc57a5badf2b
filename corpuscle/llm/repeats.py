"""Removal of repeated byte strings by suffix sorting.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else, in its own
text or another.  The strings are found in four steps:

1. *Segments.*  Each start of such a string belongs to an anchor: the leftmost smallest hash among the
   short grams of its string.  Equal strings have equal anchors at equal distance, so the starts of an
   anchor, one run of bytes, need only be compared with those of equal anchors.  A bitmap of fixed size
   tells which anchors occur more than once; the rest is dropped before anything is shuffled.
2. *Contents.*  Segments of one anchor and equal bytes repeat as a whole; they are counted by an aggregate
   and one of them represents the others from then on.
3. *Suffix sorting.*  The different contents of an anchor are cut into cells on a grid that is fixed by
   the anchor, so equal strings have equal cells.  The cells of many anchors' contents, one symbol each,
   are suffix-sorted by linear grouping along Lyndon prefixes.  Neighbours in the order that share enough
   cells form clusters, and all starts that lead into a cluster are compared on their exact strings.
4. Spans return to their texts, which are cut and hashed.

Contents of a frequent anchor (a passage that stands in countless texts) would crowd one task: beyond
``CROWD`` their starts are cut into ranges, ranges are keyed by the bytes that all their strings share, equal
ranges are merged and unique ones drop out, and this is repeated with shorter ranges down to a
single start, where equal keys are equal strings.  So every group is sorted in tasks of bounded size and none
is cut.

Strings are compared by 64-bit hashes of their bytes within an anchor's group.

Edge cases: null and short texts have nothing to remove; repeated rows repeat every string of theirs; rows
that share an id are told apart by their text; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import texts as X
from corpuscle.llm.suffixes import suffix_array
from corpuscle.session import written

LENGTH, GRAM, CELL = 200, 16, 40
#: Contents of one anchor that are sorted in one task, and contents that a task takes in all.
CROWD, TASK = 512, 8_192
#: Lengths of the ranges that crowded contents' starts are cut into, round after round.
RANGES = (48, 12, 3, 1)
BITMAP_BITS, CHUNK_BITS = 27, 14
_WALK = 1 << 19


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Segments of a block of texts: (row, anchor, first start, last start, hash of the anchor's gram).

    Every start of a ``length``-byte string is dealt to the leftmost smallest hash among the grams of its
    string, so equal strings have anchors of equal hash at equal distance.
    """
    w = length - gram + 1
    n = len(data) - gram + 1
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    at = np.arange(n)
    h = X.span_hashes(data, at, at + gram)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    # Minima of all windows of w: blocks of w, running minima from the left and from the right.
    pad = -n % w
    p = np.concatenate([v, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, w)
    left = np.minimum.accumulate(p, axis=1).ravel()
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(data) - length + 1
    low = np.minimum(right[:starts], left[w - 1 : w - 1 + starts])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Starts whose string would leave its text do not count.
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:starts]
    ok = np.arange(starts) + length <= offs[row + 1]
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    return row[s], anchor[s], s, e, h[anchor[s]]


def _segment_batches(col: pa.Array):
    """anchors() of an Arrow column, with rows counted from its start and positions from their text's."""
    for a, _, data, offs in X.blocks(col, _WALK):
        row, anchor, s, e, g = anchors(data, offs)
        if len(row):
            # The distance to the anchor is part of a content's identity.
            c = X.mix(X.span_hashes(data, s, e + LENGTH) + (anchor - s).astype(np.uint64))
            yield row + a, s - offs[row], e - s + 1, anchor - s, g.view(np.int64), c.view(np.int64)


def _anchor_counts(batches):
    for b in batches:
        for _, _, _, _, g, _ in _segment_batches(b.column("text")):
            u, n = np.unique(g, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n.astype(np.int64))], ["g", "n"])


def _chunk(t: pa.Table) -> pa.Table:
    bits = np.zeros(1 << CHUNK_BITS, np.uint8)
    bits[t.column("bit").to_numpy()] = 1
    return pa.table({"chunk": t.column("chunk")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def repeated_anchors(docs: DataFrame) -> np.ndarray:
    """A bitmap, of fixed size, that holds every anchor hash that occurs more than once (and may hold others)."""
    counts = docs.select("text").mapInArrow(_anchor_counts, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1")
    spot = F.shiftrightunsigned(F.col("g"), 64 - BITMAP_BITS)
    bit = F.pmod(spot, F.lit(1 << CHUNK_BITS)).cast("int")
    chunks = counts.select(F.shiftrightunsigned(spot, CHUNK_BITS).cast("int").alias("chunk"), bit.alias("bit")).distinct()
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    step = 1 << (CHUNK_BITS - 3)
    for r in chunks.groupBy("chunk").applyInArrow(_chunk, "chunk int, bits binary").collect():  # 16 MB at most
        out[r.chunk * step : (r.chunk + 1) * step] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _segments(bitmap: np.ndarray):
    def run(batches):
        for b in batches:
            doc, th = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("th").to_numpy()
            for row, pos, n, d, g, c in _segment_batches(b.column("text")):
                spot = (g.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                k = np.flatnonzero((bitmap[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[k]), pa.array(c[k]), pa.array(doc[row[k]]), pa.array(th[row[k]]), *(pa.array(x[k].astype(np.int32)) for x in (pos, n, d))],
                    ["key", "c", "kd", "th", "pos", "n", "d"])

    return run


_ROW = "key long, c long, kd long, th long, pos int, n int, d int"


def _bodies(t) -> tuple[np.ndarray, np.ndarray]:
    col = t.column("body")
    return X.column_bytes(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col)


def _ranges(width: int):
    """Cut the starts of crowded contents into ranges of ``width`` on the grid of their anchor."""

    def run(batches):
        for b in batches:
            data, offs = _bodies(b)
            n, d = b.column("n").to_numpy().astype(np.int64), b.column("d").to_numpy().astype(np.int64)
            pos, key = b.column("pos").to_numpy(), b.column("key").to_numpy().view(np.uint64)
            first, last = np.floor_divide(-d, width), np.floor_divide(n - 1 - d, width)
            many = last - first + 1
            i = np.repeat(np.arange(len(n)), many)
            bin_ = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            lo, hi = np.maximum(0, bin_ * width + d[i]), np.minimum(n[i] - 1, (bin_ + 1) * width - 1 + d[i])
            a = offs[i]
            # All strings of a whole range share the bytes from its last start to the end of its first string.
            shared = X.span_hashes(data, a + (bin_ + 1) * width - 1 + d[i], a + bin_ * width + d[i] + LENGTH)
            new = X.mix(X.mix(key[i] + shared) + bin_.astype(np.uint64))
            c = X.mix(X.span_hashes(data, a + lo, a + hi + LENGTH) + X.mix((lo - d[i]).astype(np.uint64)))
            part = [data[x:y].tobytes() for x, y in zip((a + lo).tolist(), (a + hi + LENGTH).tolist())]
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(new.view(np.int64)), pa.array(c.view(np.int64)), b.column("kd").take(take), b.column("th").take(take),
                 *(pa.array(x.astype(np.int32)) for x in (pos[i] + lo, hi - lo + 1, d[i] - lo)), pa.array(part, pa.binary())],
                ["key", "c", "kd", "th", "pos", "n", "d", "body"])

    return run


def repeated_starts(data: np.ndarray, offs: np.ndarray, key: np.ndarray, n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Flags of the starts (the first n of each content, one content after the other) whose string repeats.

    Contents of one key are different as a whole and aligned by ``d``, the distance to the anchor.
    """
    full = (LENGTH - CELL + 1) // CELL  # cells that lie in a string wherever it starts
    size = np.diff(offs)
    lead = np.mod(d, CELL)  # the first cell border of a content
    cells = (size - lead) // CELL
    i = np.repeat(np.arange(len(n)), cells)
    nth = np.arange(len(i)) - np.repeat(np.cumsum(cells) - cells, cells)
    at = offs[i] + lead[i] + nth * CELL
    # One symbol for each cell; the key and the place on the grid keep apart what cannot match.
    names, symbol = np.unique(X.mix(X.span_hashes(data, at, at + CELL) + X.mix(key[i].view(np.uint64) + (lead[i] + nth * CELL - d[i]).astype(np.uint64))), return_inverse=True)
    # Contents follow each other, each ended by symbol 0.
    text = np.zeros(len(i) + len(n), np.int64)
    where = np.arange(len(i)) + i
    text[where] = symbol + 1
    order = np.array(suffix_array(text.tolist()), np.int64)
    cell_of = np.full(len(text), -1, np.int64)
    cell_of[where] = np.arange(len(i))
    # Suffixes with all the cells of a string, in order; neighbours that share them are a cluster.
    s = cell_of[order]
    s = s[s >= 0]
    s = s[nth[s] + full <= cells[i[s]]]
    same = np.ones(max(0, len(s) - 1), bool)
    for k in range(full):
        same &= symbol[s[1:] + k] == symbol[s[:-1] + k]
    linked = np.zeros(len(s), bool)
    linked[1:] = same
    linked[:-1] |= same
    cluster = np.cumsum(np.concatenate(([True], ~same))) if len(s) else np.zeros(0, np.int64)
    s, cluster = s[linked], cluster[linked]
    # The starts that lead into each border: CELL of them, as far as the content has them.
    first = np.cumsum(n) - n
    content, border = i[s], lead[i[s]] + nth[s] * CELL
    low, high = np.maximum(0, border - CELL + 1), np.minimum(border, n[content] - 1)
    many = np.maximum(0, high - low + 1)
    j = np.repeat(np.arange(len(s)), many)
    x = low[j] + np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many)
    a = offs[content[j]] + x
    h = X.mix(X.span_hashes(data, a, a + LENGTH) + X.mix((cluster[j] * CELL + border[j] - x).astype(np.uint64)))
    by = np.argsort(h, kind="stable")
    eq = h[by][1:] == h[by][:-1]
    hit = np.zeros(len(h), bool)
    hit[by[1:]] = eq
    hit[by[:-1]] |= eq
    out = np.zeros(int(n.sum()), bool)
    out[(first[content[j]] + x)[hit]] = True
    return out


def _sorted(t: pa.Table) -> pa.Table:
    t = t.select(["key", "c", "kd", "th", "pos", "n", "d", "body"])
    seen = np.unique(np.stack([t.column("key").to_numpy(), t.column("c").to_numpy()], 1), axis=0, return_index=True)[1]
    t = t.take(pa.array(np.sort(seen)))
    data, offs = _bodies(t)
    n, d = t.column("n").to_numpy().astype(np.int64), t.column("d").to_numpy().astype(np.int64)
    flags = repeated_starts(data, offs, t.column("key").to_numpy(), n, d)
    ends = np.cumsum(n)
    s, e = X.runs(flags, np.concatenate(([0], ends)))
    row = np.searchsorted(ends, s, side="right")
    base = t.column("pos").to_numpy()[row] - (ends - n)[row]
    take = pa.array(row)
    return pa.table({"kd": t.column("kd").take(take), "th": t.column("th").take(take), "a": pa.array((base + s).astype(np.int32)), "b": pa.array((base + e - 1 + LENGTH).astype(np.int32))})


_SPAN = "kd long, th long, a int, b int"


def _counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans of rows that repeat as a whole, one row of each content of keys that have several)."""
    first = F.min(F.struct("kd", "th", "pos", "n", "d")).alias("rep")
    contents = written(rows.groupBy("key", "c").agg(F.count("*").alias("cnt"), first), "contents")
    whole = rows.join(contents.filter("cnt > 1").select("key", "c"), ["key", "c"])
    spans = whole.select("kd", "th", F.col("pos").alias("a"), (F.col("pos") + F.col("n") + (LENGTH - 1)).alias("b"))
    sizes = contents.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return spans, contents.join(sizes, "key").select("key", "c", "size", "rep.*")


def repeats(docs: DataFrame) -> DataFrame:
    """(kd, th, a, b): byte spans to remove of the text with hash ``th`` and id ``kd``; they may overlap."""
    bitmap = repeated_anchors(docs)
    segs = written(docs.mapInArrow(_segments(bitmap), _ROW), "segments")
    whole, several = _counted(segs)
    found = [whole]
    # The bytes of one representative each: the texts meet the list of wanted places once.
    want = written(several, "wanted")
    body = F.substring(F.col("text").cast("binary"), F.col("pos") + 1, F.col("n") + (LENGTH - 1)).alias("body")
    rows = docs.join(want.hint("shuffle_hash"), ["kd", "th"]).select("key", "c", "size", "kd", "th", "pos", "n", "d", body)
    for width in (*RANGES, 0):
        rows = written(rows, "bodies")
        small = rows.filter(F.col("size") <= CROWD)
        buckets = max(1, -(-small.count() // TASK))
        found.append(small.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(_sorted, _SPAN))
        hot = rows.filter(F.col("size") > CROWD)
        if not width or hot.isEmpty():
            break
        parts = written(hot.drop("size").mapInArrow(_ranges(width), _ROW + ", body binary"), "ranges")
        whole, several = _counted(parts)
        found.append(whole)
        rows = parts.join(several.select("key", "c", "size", "kd", "th", "pos"), ["key", "c", "kd", "th", "pos"])
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _cut(batches):
    for b in batches:
        data, offs = X.column_bytes(b.column("text"))
        spans = b.column("spans").to_pylist()
        removed, runs, digest = [], [], []
        for i, own in enumerate(spans):
            text = data[offs[i] : offs[i + 1]]
            gone = kept = 0
            n_runs, at, h = 0, 0, hashlib.sha256()
            for x in sorted((s["a"], s["b"]) for s in own or ()):
                a, e = x
                if a > at or not n_runs:
                    h.update(text[at:a].tobytes())
                    n_runs += 1
                    gone += e - a
                else:
                    gone += max(0, e - at)
                at = max(at, e)
            h.update(text[at:].tobytes())
            removed.append(gone)
            runs.append(n_runs)
            digest.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs`` (doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))).alias("kd"),
                        F.xxhash64("text").alias("th"), "text")
    spans = repeats(keyed.select("kd", "th", "text").withColumn("doc_id", F.col("kd")))
    per_text = spans.groupBy("kd", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # as long as a text is, not as many as texts
    out = keyed.join(per_text, ["kd", "th"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
