"""Quality rules whose thresholds come from the corpus: quantile sketches per language and source.

Every document is measured once (words, characters in words, symbols, repeated lines, words in repeated
windows).  The measures become whole-number rates, and each (language, source) keeps a quantile sketch of
every rate: counts of log-linear buckets (``bucket``), 32 to a power of two, so that a quantile read from it is
within 1/32 of the true one.  Such sketches merge by adding counts: Spark adds them on the map side, a hot
source is a few hundred rows a task, and the sketch of a language or of the whole corpus is the sum of the
sketches below it.  Thresholds are outer fences of the quantiles, and documents are filtered by a join with
the thresholds of their language and source.

A sketch of fewer than ``LEAST`` documents says little about its tail: its documents are judged by their
language's merged sketch, or by the whole corpus's where that is small as well.  A corpus of fewer than
``LEAST`` documents is judged by the base rules alone.

Only DataFrame functions are used.  The measures of a text are taken in its row: repeated windows are found by
their hashes first, and only where a hash occurs twice in a text are words compared.

Edge cases: a null text is empty and fails the base rule, as every text of fewer than 20 words does; null
languages and null sources are groups of their own; repeated rows are measured each and each counts in its
sketch; ties at a threshold are kept (only values beyond it are rejected); very long texts are measured whole,
in one row; ids are carried along, null or not, and decide nothing; empty tables give empty results; columns
of ``docs`` that are not needed do not clash with those made here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscle.operators.index import broadcast_if_small
from corpuscle.session import written

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Documents a sketch needs before its own tail is trusted.
LEAST = 200
#: Buckets to a power of two of the quantile sketch.
FINE = 32

#: rate -> (lower fence is used, upper fence is used).  Rates are per 10,000, the word length in hundredths.
RATES = {"symbol_rate": (False, True), "dup_line_rate": (False, True), "repeat_rate": (False, True), "word_length": (True, True)}

#: How far beyond the quartiles the fences lie, in distances of the quartiles.
REACH = 3
#: Least distance of the quartiles that is assumed: most texts have no symbol, repeated line or window at all.
SPREAD = {"symbol_rate": 200, "dup_line_rate": 1500, "repeat_rate": 1000, "word_length": 50}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.btrim(text, F.lit(SEPARATORS)), r"[\x20\x09-\x0D]+"), "")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _window_hashes(ws: Column) -> Column:
    """A hash of every window, from hashes of its halves: three doublings make one of eight words."""
    def doubled(h: Column, k: int) -> Column:
        return _bound(h, lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + k))))

    every = doubled(doubled(doubled(F.transform(ws, lambda w: F.xxhash64(w)), 1), 2), WINDOW // 2)
    return F.slice(every, F.lit(1), F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0)))


def _repeat_words(ws: Column) -> Column:
    """Words inside windows that occur twice or more in the text.

    Windows of unequal hashes differ.  Where a hash occurs twice, the windows' words are compared.
    """
    def neighbours(p: Column, same) -> Column:
        """The elements of a sorted array that are the same as the one before or after."""
        return F.filter(p, lambda x, i: F.coalesce(same(x, F.get(p, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, i + 1)), F.lit(False)))

    def confirmed(found: Column) -> Column:
        spelt = F.sort_array(F.transform(found, lambda x: F.struct(x["h"], F.array_join(F.slice(ws, x["i"] + 1, WINDOW), " ").alias("w"), x["i"])))
        return F.sort_array(F.transform(_bound(spelt, lambda p: neighbours(p, lambda x, y: (x["h"] == y["h"]) & (x["w"] == y["w"]))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    def exact(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _bound(confirmed(_bound(by_hash, lambda p: neighbours(p, lambda x, y: x["h"] == y["h"]))), covered)

    return _bound(_window_hashes(ws), lambda q: F.when(F.size(F.array_distinct(q)) < F.size(q), exact(q)).otherwise(F.lit(0).cast("long")))


def _lines(text: Column) -> Column:
    """Lines that hold a word, and how many of them equal an earlier line."""
    full = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return _bound(full, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def measured(docs: DataFrame, text: str = "text") -> Column:
    """The measures of a document as one struct column."""
    t = F.coalesce(docs[text], F.lit(""))
    ws = _bound(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat")))
    lines = _lines(t)
    return F.struct(
        ws["n"].alias("n_words"), F.length(F.translate(t, SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines["n"].alias("n_lines"), lines["dup"].alias("n_dup_lines"), ws["repeat"].alias("n_repeat_words"))


def rates(m: Column) -> Column:
    """Whole-number rates of the measures; a rate without a base is null."""
    per = lambda a, b, k: F.when(b > 0, F.floor(a * k / b).cast("long"))
    return F.struct(
        per(m["n_symbols"], m["word_chars"], 10_000).alias("symbol_rate"), per(m["n_dup_lines"], m["n_lines"], 10_000).alias("dup_line_rate"),
        per(m["n_repeat_words"], m["n_words"], 10_000).alias("repeat_rate"), per(m["word_chars"], m["n_words"], 100).alias("word_length"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def bucket(v: Column) -> Column:
    """Number of a value's log-linear bucket: exact below ``2 * FINE``, then ``FINE`` buckets to a power of two."""
    shift = F.greatest(F.length(F.bin(v)) - (FINE.bit_length()), F.lit(0))
    # All bits of v >> shift lie in [FINE, 2 * FINE) once shift > 0, so numbers of successive shifts join up.
    return (shift * FINE + F.floor(v / F.pow(F.lit(2.0), shift))).cast("int")


def bucket_top(b: Column) -> Column:
    """Largest value of a bucket."""
    shift = F.greatest(F.floor(b / FINE) - 1, F.lit(0))
    return ((b - shift * FINE + 1) * F.pow(F.lit(2.0), shift)).cast("long") - 1


def bucket_low(b: Column) -> Column:
    """Smallest value of a bucket."""
    shift = F.greatest(F.floor(b / FINE) - 1, F.lit(0))
    return ((b - shift * FINE) * F.pow(F.lit(2.0), shift)).cast("long")


def sketches(rated: DataFrame) -> DataFrame:
    """(level, lang, source, rate, bucket, n) of a table (lang, source, r): the quantile sketches, merged upwards.

    Level 0 holds one sketch a language and source, level 1 one a language, level 2 one for all.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rate"), F.col("r")[name].alias("v")) for name in RATES]))
    own = (rated.select("lang", "source", each.alias("x")).filter("x.v IS NOT NULL")
           .groupBy("lang", "source", F.col("x.rate").alias("rate"), bucket(F.col("x.v")).alias("bucket")).agg(F.count("*").alias("n")))
    return (own.select(F.explode(_scopes()).alias("s"), "rate", "bucket", "n")
            .groupBy("s.level", "s.lang", "s.source", "rate", "bucket").agg(F.sum("n").alias("n")))


def _scopes() -> Column:
    none = F.lit(None).cast("string")
    scope = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"))
    return F.array(scope(0, F.col("lang"), F.col("source")), scope(1, F.col("lang"), none), scope(2, none, none))


def fences(sketched: DataFrame, spread: dict[str, int] | None = None, reach: int = REACH, least: int = LEAST) -> DataFrame:
    """(lang, source, fence): what a language and source allows, a map from rate to (lo, hi).

    The fences lie ``reach`` times the distance of the quartiles, ``spread[rate]`` at least, beyond them.
    """
    scope = ["level", "lang", "source", "rate"]
    order = W.partitionBy(*scope).orderBy("bucket")
    read = sketched.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(W.partitionBy(*scope))})
    quart = read.groupBy(*scope).agg(
        F.max("total").alias("total"), F.min(F.when(4 * F.col("upto") >= F.col("total"), bucket_low(F.col("bucket")))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), bucket_top(F.col("bucket")))).alias("q3"))
    pick = lambda values, other: reduce(lambda c, kv: F.when(F.col("rate") == kv[0], F.lit(kv[1])).otherwise(c), values.items(), F.lit(other))
    wide = F.greatest(F.col("q3") - F.col("q1"), pick(spread or SPREAD, 0)) * reach
    lower, upper = (pick({k: v[i] for k, v in RATES.items()}, False) for i in (0, 1))
    fence = F.struct(F.when(lower, F.col("q1") - wide).alias("lo"), F.when(upper, F.col("q3") + wide).alias("hi"))
    trusted = quart.filter(F.col("total") >= least).select(*scope, fence.alias("fence"))
    groups = sketched.filter("level = 0").select("lang", "source").distinct()
    asked = groups.select("lang", "source", F.explode(_scopes()).alias("s"))
    same = (F.col("s.level") == F.col("t.level")) & F.col("s.lang").eqNullSafe(F.col("t.lang")) & F.col("s.source").eqNullSafe(F.col("t.source"))
    nearest = (asked.join(trusted.alias("t"), same).groupBy(asked["lang"], asked["source"], "t.rate")
               .agg(F.min_by("t.fence", "t.level").alias("fence")))
    return nearest.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rate", "fence"))).alias("fence"))


def _beyond(rated: Column) -> Column:
    """Names of the rates outside their fences."""
    def out(name: str) -> Column:
        f = F.try_element_at(F.col("fence"), F.lit(name))
        return F.when((rated[name] < f["lo"]) | (rated[name] > f["hi"]), F.lit(name))

    return F.array_compact(F.array(*map(out, RATES)))


def _judged(rated: DataFrame, limits: DataFrame) -> DataFrame:
    """``rated`` with ``beyond``; its language and source meet their fences by an equality that holds for nulls."""
    side = broadcast_if_small(written(limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "fence"), "fences"))
    met = rated.join(side, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return met.withColumn("beyond", _beyond(F.col("r"))).drop("_lang", "_source", "fence")


def verdicts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the rates beyond their fences, for every row of ``docs``."""
    # The measures are read twice, for the sketches and for the verdicts: they are written, without the texts.
    m = written(docs.select("doc_id", F.col("lang"), F.col("source"), measured(docs).alias("m")), "measures").withColumn("r", rates(F.col("m")))
    out = _judged(m, fences(sketches(m), **options))
    failed = base_failed(F.col("m"))
    return out.select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.size("beyond") == 0)).alias("kept"), F.array_join("beyond", ",").alias("beyond"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Texts are measured once for the sketches and once as they are filtered, so they are neither written nor joined.
    """
    every = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("d")
    rated = docs.select(every, docs["lang"].alias("lang"), docs["source"].alias("source"), measured(docs).alias("m")).withColumn("r", rates(F.col("m")))
    out = _judged(rated, fences(sketches(rated.select("lang", "source", "r")), **options))
    return out.filter(~base_failed(F.col("m")) & (F.size("beyond") == 0)).select(*[F.col("d")[c].alias(c) for c in docs.columns])
