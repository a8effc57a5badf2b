"""Benchmark passages in training texts by spaced seeds, in DataFrame functions only.

Words are the runs of letters and digits of the lower-cased text.  A seed is the hash of the words that a
fixed mask selects; the positions it ignores may differ.  Seeds of the test items are joined with the
seeds of the whole training texts, and around each hit the two texts are compared word by word on the
hit's diagonal: an item leaks if some ``WINDOW`` of its words (all of them, if it has fewer) is found
with at most ``TOLERANCE`` of the words replaced.  No such window is missed: any three replaced positions
of twenty leave one of the masks untouched somewhere, and an item of fewer words for whose length that
does not hold is cut into one piece more than words may be replaced, so that one piece is untouched.

Seeds of the test items are broadcast in parts of about a million rows, so the broadcast is bounded
whatever the benchmark's size; the training texts are never shuffled, only their verified hits are.

Edge cases: null and empty texts have no words and neither leak nor are leaked; items of fewer
than 20 words are sought whole, those under 5 words are no evidence and are ignored; repeated rows and rows sharing an id
are judged by their own text (``text_hash`` tells them apart); null ids are kept as they are; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import let
from corpuscle.session import written

#: Two masks of seven words that together survive any three replacements in twenty.
MASKS = ("11011111", "1111000101001")
WINDOW, TOLERANCE, LEAST_WORDS = 20, 0.15, 5
PART = 1_000_000


def replaceable(n: int) -> int:
    """How many words of an item of ``n`` words may be replaced in a window."""
    return int(min(n, WINDOW) * TOLERANCE + 1e-9)


def complete(n: int) -> bool:
    """Whether any replaceable positions of ``n`` words leave a mask untouched somewhere."""
    held = [{i + p for p, c in enumerate(m) if c == "1"} for m in MASKS for i in range(n - len(m) + 1)]
    return all(any(not at & set(gone) for at in held) for gone in itertools.combinations(range(n), replaceable(n)))


def pieces(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item of ``n`` words, one more than words may be replaced."""
    k = replaceable(n) + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def words(text: Column) -> Column:
    """Hashes of the words of a text."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _windows(h: Column, mask: str, label: int) -> Column:
    at = [i for i, c in enumerate(mask) if c == "1"]
    return F.when(F.size(h) >= len(mask), F.transform(
        F.sequence(F.lit(0), F.size(h) - len(mask)), lambda i: F.xxhash64(F.lit(label), *[F.get(h, i + p if p else i) for p in at]))).otherwise(F.array().cast("array<bigint>"))


def _seeds(h: Column, masks: list[str]) -> Column:
    return F.concat(*[_windows(h, m, k) for k, m in enumerate(masks)])


def _place(masks: list[str]) -> tuple[Column, Column]:
    """(number of the mask, position in the text) of element ``p`` of the seeds of ``n`` words."""
    mask, pos, base = F.lit(0), F.col("p"), F.lit(0)
    for k, m in enumerate(masks):
        here = F.col("p") >= base
        mask, pos = F.when(here, F.lit(k)).otherwise(mask), F.when(here, F.col("p") - base).otherwise(pos)
        base = base + F.greatest(F.lit(0), F.col("n") - (len(m) - 1))
    return mask, pos


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, ih): the word hashes of the test items that count as evidence."""
    return (benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("ih"))
            .filter(F.size("ih") >= LEAST_WORDS))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, window, matched): the best window of each item found in a text."""
    items = written(items_of(benchmark), "items")
    # Lengths under WINDOW for which the masks are not complete go by pieces; a piece is a mask of its own length.
    lengths = [r.n for r in items.filter(F.size("ih") < WINDOW).select(F.size("ih").alias("n")).distinct().orderBy("n").collect()]
    cut = {n: pieces(n) for n in lengths if not complete(n)}
    whole = sorted({length for p in cut.values() for _, length in p})
    masks = [*MASKS, *("1" * n for n in whole)]
    mask, pos = _place(masks)
    seeds = (items.select("item_id", F.size("ih").alias("n"), _seeds(F.col("ih"), masks).alias("seeds"))
             .select("item_id", "n", F.posexplode("seeds").alias("p", "seed"))
             .select("seed", "item_id", F.col("n").alias("item_n"), mask.alias("mask"), pos.alias("item_pos")))
    # Of the runs of words only the pieces of an item are seeds.
    piece = F.lit(False)
    for n, at in cut.items():
        for start, length in at:
            piece |= (F.col("item_n") == n) & (F.col("mask") == len(MASKS) + whole.index(length)) & (F.col("item_pos") == start)
    seeds = seeds.filter((F.col("mask") < len(MASKS)) | piece)
    seeds = written(seeds.select("seed", "item_id", "item_n", "item_pos"), "seeds")
    parts = max(1, -(-seeds.count() // PART))
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("h"))
             .filter(F.size("h") >= LEAST_WORDS)
             .select("doc_id", "text_hash", "h", F.size("h").alias("n"), let(F.col("h"), lambda h: _seeds(h, masks)).alias("seeds"))
             .select("doc_id", "text_hash", "h", "n", F.posexplode("seeds").alias("p", "seed")))
    found = None
    for i in range(parts):
        part = seeds.filter(F.pmod("seed", F.lit(parts)) == i) if parts > 1 else seeds
        hit = texts.join(F.broadcast(part), "seed").withColumn("diag", pos - F.col("item_pos"))
        a = F.greatest(F.lit(0), "diag")  # first word of the text on the diagonal
        b = F.greatest(F.lit(0), -F.col("diag"))  # and of the item
        length = F.least(F.col("n") - a, F.col("item_n") - b)
        hit = hit.select("doc_id", "text_hash", "item_id", "diag", F.slice("h", a + 1, length).alias("th")).distinct()
        found = hit if found is None else found.unionByName(hit)
    found = written(found if parts == 1 else found.distinct(), "hits")
    pair = found.join(items, "item_id")
    b = F.greatest(F.lit(0), -F.col("diag"))
    size = F.size("th")
    same = F.zip_with("th", F.slice("ih", b + 1, size), lambda x, y: (x == y).cast("int"))
    window = F.least(F.lit(WINDOW), F.size("ih"))
    pair = pair.select("doc_id", "text_hash", "item_id", window.alias("window"), same.alias("same")).filter(F.size("same") >= F.col("window"))
    sums = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("window")),
                       lambda s: F.aggregate(F.slice("same", s + 1, F.col("window")), F.lit(0), lambda x, y: x + y))
    pair = pair.withColumn("matched", F.array_max(sums)).filter(F.col("matched") >= F.col("window") - F.floor(F.col("window") * TOLERANCE))
    return pair.groupBy("doc_id", "text_hash", "item_id").agg(F.max("window").alias("window"), F.max("matched").alias("matched"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, all columns kept."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("bad_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("bad_hash"))
    return docs.join(bad, same, "left_anti")
