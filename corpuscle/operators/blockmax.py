"""Top-k over posting blocks, ended as soon as the k-th place can't change.

Chunks get numbers, and ``SHARD`` numbers are a shard.  A row of the index is a term's
list in one shard: chunk numbers in ascending order, for every channel their impacts (what the term adds to a score for
weight one) and the highest impact of each block of ``BLOCK`` postings.  Rows are bucketed by
shard and sorted by term in their files, so the terms of a batch reach the scan as a filter, a question meets its
lists by a join on the term, and lists of a shard need no exchange to come together.

In a shard a question's lists are taken in the order of the most that each can add, and their impacts are summed
by chunk.  The k-th best sum so far is a floor.  Once the lists not yet taken can't lift an unseen chunk to
it, only chunks that they may still lift are looked up in them, and of these only the ones whose blocks reach the
floor: frequent terms, whose impacts are low, are read in a few blocks.  Results are those of full sums.

A shard's lists are bounded by its chunks, a frequent term is one bounded row a shard, and each shard passes on
about k rows a question.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscle.functions import vocab as V
from corpuscle.operators.index import _counted, broadcast_if_small, source_bytes
from corpuscle.operators.scoring import six
from corpuscle.session import written

SHARD, BLOCK = 1 << 13, 128
#: Lists after which the floor is taken anew.
STEP = 4
#: Scores are compared at six decimals; sums in another order differ by far less.
MARGIN = 2e-6
#: Terms of a batch that are pushed to the scan by name.
NAMED_TERMS = 1000

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the plan: workers need no copy of the package


def numbers(ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, no): numbers that rise with the ids, written."""
    return written(ids.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("no", F.monotonically_increasing_id()), "numbers")


def blocks(impacts: DataFrame, no: DataFrame, channels: list[str], source: DataFrame, key: str = "chunk_id", bytes_per_bucket: int = 8 << 20) -> DataFrame:
    """(shard, term, nos, and of every channel: impacts, tops_<channel>) from (key, term, channels), written.

    Buckets are counted by the size of ``source``, the table that the impacts are read from.
    """
    n = max(-(-source_bytes(source) // bytes_per_bucket), impacts.sparkSession.sparkContext.defaultParallelism)
    at = (F.col("no") % SHARD).cast("int").alias("at")
    rows = impacts.join(no, key).select(F.floor(F.col("no") / SHARD).alias("shard"), "term", at, *channels)
    cols = ", ".join(f"{c} array<double>, tops_{c} array<double>" for c in channels)
    lists = rows.repartition(n, "shard").groupBy("shard").applyInArrow(_packed(channels), f"shard long, term string, nos array<int>, {cols}")
    return written(lists, "blocks", bucket_by="shard", buckets=n, already_placed=True, sort_by=["shard", "term"])


def _packed(channels: list[str]):
    """The lists of one shard from its postings (shard, term, at, channels)."""

    def run(rows):
        import pyarrow as pa

        term = rows.column("term").combine_chunks().dictionary_encode()
        code, at = term.indices.to_numpy(), rows.column("at").to_numpy()
        order = np.lexsort((at, code))
        code = code[order]
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        ends = np.append(starts[1:], len(code))
        n = -(-(ends - starts) // BLOCK)
        first = np.cumsum(n) - n
        cuts = np.repeat(starts, n) + BLOCK * (np.arange(n.sum()) - np.repeat(first, n))

        def lists(values, offsets, kind):
            return pa.ListArray.from_arrays(pa.array(np.append(offsets, len(values)), pa.int32()), pa.array(values, kind))

        out = {"shard": pa.array(np.full(len(starts), rows.column("shard")[0].as_py()), pa.int64()), "term": term.dictionary.take(pa.array(code[starts])),
               "nos": lists(at[order], starts, pa.int32())}
        for c in channels:
            values = rows.column(c).to_numpy()[order]
            out[c] = lists(values, starts, pa.float64())
            out[f"tops_{c}"] = lists(np.maximum.reduceat(values, cuts), first, pa.float64())
        return pa.table(out)

    return run


@dataclass(frozen=True)
class Counted:
    """Posting blocks of counts for the channels ``bm25`` and ``dense``.

    ``lists`` are (shard, term, nos, tfs), bucketed by shard.  Impacts follow from the counts, the idf of ``vocab`` (term, df) among
    ``size`` chunks and what ``known`` (shard, below, most, norms) holds of a shard's chunks: what its length adds below
    the line of BM25, its highest count and the norm of its TF-IDF row.
    """

    lists: DataFrame
    known: DataFrame
    vocab: DataFrame
    size: int

    @property
    def columns(self) -> list[str]:
        return self.lists.columns

    def idf(self):
        return F.log((self.size + 1) / (F.col("df") + 1)) + 1


def term_blocks(lists: DataFrame, no: DataFrame, vocab: DataFrame, stats: DataFrame, key: str = "chunk_id", k1: float = 1.5, b: float = 0.75,
                bytes_per_bucket: int = 4 << 20) -> Counted:
    """Posting blocks from (key, len, terms, tfs) of ``index.term_lists``, which move once, by shard."""
    n = max(-(-source_bytes(lists) // bytes_per_bucket), lists.sparkSession.sparkContext.defaultParallelism)
    at = (F.col("no") % SHARD).cast("int").alias("at")
    rows = lists.join(no, key).select(F.floor(F.col("no") / SHARD).alias("shard"), at, "len", "terms", "tfs")
    turned = rows.repartition(n, "shard").groupBy("shard").applyInArrow(lambda r: _turned(r), TURNED)
    return shard_blocks(written(turned, "turned", bucket_by="shard", buckets=n, already_placed=True), vocab, stats, n, k1, b)


TURNED = "shard long, term string, nos array<int>, tfs array<int>, lens array<int>, most array<int>"


def shards(texts: DataFrame, buckets: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Term lists by shard, made where the texts lie: neither text nor postings move.  Written, bucketed by shard.

    Rows are (shard, term, nos, tfs) and, without a term, (shard, lens, most, ids, copies) of a shard's texts, ids in the order of their
    numbers.  Each task numbers its own rows, ``SHARD`` to a shard, so numbers do not rise with the ids.  Only rows whose
    id is repeated are brought together first; those of one id and length count as one text with added counts.
    """
    texts = texts.select(key, F.col(text).alias("_text"))
    again = written(texts.groupBy(F.col(key).alias("_again")).count().where("count > 1").select("_again"), "repeated_ids")
    if not again.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_again"))
        rows = texts.join(again, same, "left_semi").repartition(buckets, key).sortWithinPartitions(key)
        texts = texts.join(again, same, "left_anti").unionByName(rows)
    token, sub_token = V.TOKEN, V.SUB_TOKEN
    made = texts.mapInArrow(lambda batches: _sharded(batches, token, sub_token), f"{TURNED}, ids array<{texts.schema[key].dataType.simpleString()}>, copies array<int>")
    return written(made, "shards", bucket_by="shard", buckets=buckets, already_placed=True)


def about_texts(shards: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, no, len, copies) of the texts of ``shards``; a text whose id has several lengths takes the greatest."""
    each = F.posexplode(F.arrays_zip("ids", "lens", "copies")).alias("at", "x")
    return shards.where("term IS NULL").select("shard", each).select(
        F.col("x.ids").alias(key), (F.col("shard") * SHARD + F.col("at")).alias("no"), F.col("x.lens").alias("len"), F.col("x.copies").cast("long").alias("copies"))


def shard_frequency(shards: DataFrame) -> DataFrame:
    """(term, df) over all texts of ``shards``."""
    return shards.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("nos")).alias("df"))


def shard_blocks(shards: DataFrame, vocab: DataFrame, stats: DataFrame, buckets: int, k1: float = 1.5, b: float = 0.75) -> Counted:
    """Posting blocks from term lists by shard: only a shard's terms meet the vocabulary, and the lists stay as they are written."""
    size, avg = stats.select("n", F.col("avg_len").cast("double")).first()
    blocks = Counted(shards.where("term IS NOT NULL").select("shard", "term", "nos", "tfs"), shards, vocab, size)
    idf = blocks.lists.select("shard", "term").join(broadcast_if_small(vocab), "term")
    idf = idf.select(F.col("shard").alias("of"), F.col("term").alias("word"), blocks.idf().alias("idf"))
    rows = without_null_lists(shards.select("shard", "term", "nos", "tfs", "lens", "most")).groupBy("shard").cogroup(idf.groupBy("of"))
    known = rows.applyInArrow(lambda r, i: _known(r, i, k1, b, avg or 1.0), "shard long, below array<double>, most array<int>, norms array<double>")
    return replace(blocks, known=written(known, "known", bucket_by="shard", buckets=buckets))


def without_null_lists(df: DataFrame) -> DataFrame:
    """Empty lists for null ones, for tables that go to tasks in Arrow: Spark's writer takes time by the square of a run of null lists."""
    empty = lambda f: F.coalesce(F.col(f.name), F.expr(f"cast(array() as {f.dataType.simpleString()})")).alias(f.name)
    return df.select(*[empty(f) if f.dataType.typeName() == "array" else f.name for f in df.schema.fields])


def _lists(values, offsets, kind):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.append(offsets, len(values)), pa.int32()), pa.array(values, kind))


def _flat(column):
    """(starts of the lists and their end, all values) of a list column."""
    col = column.combine_chunks()
    return col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)


def _turned(rows):
    """The lists by term of one shard from those by chunk, and the length and highest count of each of its chunks."""
    import pyarrow as pa
    import pyarrow.compute

    at, lens = rows.column("at").to_numpy(), np.zeros(SHARD, np.int32)
    np.maximum.at(lens, at, rows.column("len").to_numpy())
    terms = rows.column("terms").combine_chunks()
    sizes = np.diff(terms.offsets.to_numpy())
    term = terms.flatten().dictionary_encode()
    in_order = pa.compute.sort_indices(term.dictionary)
    place = np.empty(len(in_order), np.int64)
    place[in_order.to_numpy()] = np.arange(len(in_order))
    code, tf, at = place[term.indices.to_numpy()], rows.column("tfs").combine_chunks().flatten().to_numpy(), np.repeat(at, sizes)
    most = np.zeros(SHARD, np.int32)
    np.maximum.at(most, at, tf)
    order = np.lexsort((at, code))
    code = code[order]
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    n, none = len(starts), pa.nulls(1, pa.list_(pa.int32()))
    more = lambda a: pa.concat_arrays([a, none])
    last = lambda values: pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), _lists(values, [0], pa.int32())])
    return pa.table({
        "shard": pa.array(np.full(n + 1, rows.column("shard")[0].as_py()), pa.int64()),
        "term": pa.concat_arrays([term.dictionary.take(in_order).take(pa.array(code[starts])), pa.nulls(1, pa.string())]),
        "nos": more(_lists(at[order], starts, pa.int32())), "tfs": more(_lists(tf[order], starts, pa.int32())),
        "lens": last(lens), "most": last(most)})


def _impacts(channel: str, tf, at, idf, known):
    """What postings add to a score for weight one; ``known`` is (below, most, norms) by chunk."""
    below, most, norms = known
    if channel == "bm25":
        return tf * (below[0] + 1) / (tf + below[1:][at])
    return (0.5 + 0.5 * tf / most[at]) * idf / norms[at]


def _known(rows, idfs, k1: float, b: float, avg: float):
    """What is known of the chunks of a shard, from its lists and the idf of their terms."""
    import pyarrow as pa
    import pyarrow.compute

    is_list = pa.compute.is_valid(rows.column("term"))
    about, rows = rows.filter(pa.compute.invert(is_list)), rows.filter(is_list).combine_chunks()
    (_, lens), (_, most) = _flat(about.column("lens")), _flat(about.column("most"))
    norms = np.zeros(SHARD)
    if rows.num_rows:
        idf = idfs.column("idf").to_numpy()[pa.compute.index_in(rows.column("term"), idfs.column("word")).to_numpy()]
        nos, tfs = rows.column("nos").combine_chunks(), rows.column("tfs").combine_chunks()
        at, tf = nos.flatten().to_numpy(), tfs.flatten().to_numpy()
        raw = (0.5 + 0.5 * tf / most[at]) * np.repeat(idf, np.diff(nos.offsets.to_numpy()))
        norms = np.sqrt(np.bincount(at, raw * raw, SHARD))
    norms[norms == 0] = 1.0
    filled = np.zeros(SHARD)
    filled[: len(lens)] = lens
    below = np.append(k1, k1 * (1 - b + b * filled / avg))  # the first is k1 itself
    reals = pa.float64()
    return pa.table({"shard": about.column("shard"), "below": _lists(below, [0], reals), "most": _lists(most, [0], pa.int32()), "norms": _lists(norms, [0], reals)})


def _sharded(batches, token: str, sub_token: str):
    """The shards of the texts of one task; rows of one id are neighbours."""
    import pyarrow as pa
    from pyspark import TaskContext

    shard, held = TaskContext.get().partitionId() << 20, None
    for batch in _counted(batches, token, sub_token):
        one = pa.Table.from_batches([batch]).append_column("copies", pa.array(np.ones(batch.num_rows, np.int32)))
        held = one if held is None else pa.concat_tables([held, one])
        starts = _id_starts(held)
        while len(starts) > SHARD:
            yield from _one_shard(held.slice(0, starts[SHARD]), shard)
            held, shard = held.slice(starts[SHARD]), shard + 1
            starts = _id_starts(held)
        if held.num_rows > 2 * SHARD:
            held = _added(held, starts)
    if held is not None and held.num_rows:
        yield from _one_shard(held, shard)


def _id_starts(held):
    """Rows at which another id begins."""
    import pyarrow as pa
    import pyarrow.compute

    if not held.num_rows:
        return np.zeros(0, np.int64)
    code = pa.compute.dictionary_encode(held.column(0).combine_chunks(), null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, code[1:] != code[:-1]))


def _added(held, starts):
    """Rows of one id and length as one, their counts and copies added."""
    import pyarrow as pa

    if len(starts) == held.num_rows:
        return held
    held = held.combine_chunks()
    size, lens = np.diff(np.append(starts, held.num_rows)), held.column("len").to_numpy()
    of = np.repeat(np.arange(len(starts)), size)
    _, first, row = np.unique(np.stack([of, lens]), axis=1, return_index=True, return_inverse=True)
    terms, row = held.column("terms").combine_chunks(), row.reshape(-1)
    term = terms.flatten().dictionary_encode()
    many = max(len(term.dictionary), 1)
    pair, where = np.unique(np.repeat(row, np.diff(terms.offsets.to_numpy())) * many + term.indices.to_numpy(), return_inverse=True)
    tf = np.bincount(where, held.column("tfs").combine_chunks().flatten().to_numpy(), len(pair)).astype(np.int32)
    ends = np.searchsorted(pair, np.arange(len(first) + 1) * many)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    copies = np.bincount(row, held.column("copies").to_numpy(), len(first)).astype(np.int32)
    return pa.table([held.column(0).take(pa.array(first)), pa.array(lens[first], pa.int32()), lists(term.dictionary.take(pa.array(pair % many))),
                     lists(pa.array(tf)), pa.array(copies)], names=held.column_names)


def _one_shard(held, shard: int):
    """Batches of one shard: its lists by term, and a row about its texts."""
    import pyarrow as pa

    held = _added(held, _id_starts(held)).combine_chunks()
    starts = _id_starts(held)
    at = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, held.num_rows)))
    made = _turned(held.append_column("at", pa.array(at)).append_column("shard", pa.array(np.full(held.num_rows, shard))))
    lens = made.column("lens")[-1].values.to_numpy()[: len(starts)]
    copies = np.bincount(at, held.column("copies").to_numpy()).astype(np.int32)
    ids = held.column(0).combine_chunks().take(pa.array(starts))
    last = lambda values: pa.concat_arrays([pa.nulls(made.num_rows - 1, pa.list_(values.type)), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)])
    made = made.set_column(made.schema.get_field_index("lens"), "lens", last(pa.array(lens)))
    yield from made.append_column("ids", last(ids)).append_column("copies", last(pa.array(copies))).combine_chunks().to_batches()


def best_in_shard(lists: list[tuple], k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(chunk numbers, scores, blocks read) of the k best chunks of one shard, and of all that tie with the last.

    ``lists`` holds (weight, nos, impacts, tops) of each term; ``seen`` flags the chunks the question may see.
    """
    lists = sorted(lists, key=lambda x: -x[0] * x[3].max())
    rest = np.append(np.cumsum([w * tops.max() for w, _, _, tops in lists][::-1])[::-1], 0.0)
    total, read, floor, taken = np.zeros(SHARD), 0, 0.0, 0
    for i, (w, nos, impacts, tops) in enumerate(lists):
        total[nos] += w * impacts
        read += len(tops)
        taken = i + 1
        if taken % STEP == 0 and taken < len(lists) and rest[taken] < total.max():
            own = total if seen is None else np.where(seen, total, 0.0)
            floor = np.partition(own, -k)[-k]
            if rest[taken] + MARGIN < floor:
                break
    if seen is not None:
        total = np.where(seen, total, 0.0)
    open_ = np.flatnonzero((total > 0) & (total + rest[taken] + MARGIN >= floor))
    if taken < len(lists):
        at, may = [], total[open_].copy()
        for w, nos, _, tops in lists[taken:]:
            p = np.minimum(np.searchsorted(nos, open_), len(nos) - 1)
            at.append(p)
            may += w * tops[p // BLOCK]
        left = may + MARGIN >= floor
        open_, at = open_[left], [p[left] for p in at]
        for (w, nos, impacts, _), p in zip(lists[taken:], at):
            hit = nos[p] == open_
            total[open_[hit]] += w * impacts[p[hit]]
            read += len(np.unique(p // BLOCK))
    scores = total[open_]
    if len(open_) > k:
        last = np.partition(scores, -k)[-k]
        left = scores + MARGIN >= last
        open_, scores = open_[left], scores[left]
    return open_, scores, read


def _shard_tables(index, channel: str, known=None):
    """{(unit, its pool or None): its lists} of the joined rows of a shard; with ``known``, impacts are made from counts."""
    flat = [_flat(index.column(name)) for name in (("nos", channel, f"tops_{channel}") if known is None else ("nos", "tfs"))]
    idf = None if known is None else index.column("idf").to_numpy()
    out: dict[int, list] = {}
    for r, who in enumerate(index.column("who").to_pylist()):
        one = [v[o[r] : o[r + 1]] for o, v in flat]
        if known is not None:
            one[1] = _impacts(channel, one[1], one[0], idf[r], known)
            one.append(np.maximum.reduceat(one[1], np.arange(0, len(one[1]), BLOCK)))
        for x in who:
            out.setdefault((x["unit"], x.get("pool")), []).append((x["weight"], *one))
    return out


def _scored(channel: str, k: int, pooled: bool = True):
    def run(index, pools=None):
        import pyarrow as pa

        cols = {"unit": [], "no": [], "s": []}
        if index.num_rows:
            shard = index.column("shard")[0].as_py()
            known = None
            if pools is not None and "norms" in pools.column_names:
                import pyarrow.compute

                about = pa.compute.is_null(pools.column("facet")) if pooled else pa.compute.is_valid(pools.column("norms"))
                known = [_flat(pools.filter(about).column(c))[1] for c in ("below", "most", "norms")]
                pools = pools.filter(pa.compute.invert(about)) if pooled else None
            sees = None if pools is None else _seen(pools)
            for (unit, pool), lists in _shard_tables(index, channel, known).items():
                seen = None if sees is None else sees.get(pool)
                if sees is not None and seen is None:
                    continue
                at, s, _ = best_in_shard(lists, k, seen)
                cols["unit"].append(np.full(len(at), unit, np.int64))
                cols["no"].append(at + shard * SHARD)
                cols["s"].append(s)
        kinds = {"unit": np.int64, "no": np.int64, "s": np.float64}
        return pa.table({c: np.concatenate(v).astype(kinds[c]) if v else np.zeros(0, kinds[c]) for c, v in cols.items()})

    return run


def _seen(pools) -> dict:
    """{pool: flags of the chunks of a shard that it sees}, of the pools that see any; rows are (pool, facet) and, without a pool, (facet, nos)."""
    import pyarrow as pa
    import pyarrow.compute

    is_pool = pa.compute.is_valid(pools.column("pool"))
    own, chunks = pools.filter(is_pool), pools.filter(pa.compute.invert(is_pool))
    facets, (starts, at) = np.full(SHARD, -1, np.int64), _flat(chunks.column("nos"))
    facets[at] = np.repeat(chunks.column("facet").to_numpy(), np.diff(starts))
    pool, facet = own.column("pool").to_numpy(), own.column("facet").to_numpy()
    order = np.argsort(pool, kind="stable")
    names, first = np.unique(pool[order], return_index=True)
    flags = [np.isin(facets, one) for one in np.split(facet[order], first[1:])]
    return {name: seen for name, seen in zip(names.tolist(), flags) if seen.any()}


def facet_shards(facet_of: DataFrame, no: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(shard, facet, nos): the chunks of each facet by shard, from (key, facet), written."""
    at = (F.col("no") % SHARD).cast("int")
    return written(facet_of.join(no, key).groupBy(F.floor(F.col("no") / SHARD).alias("shard"), "facet").agg(F.collect_list(at).alias("nos")), "facet_shards")


def top_k(asked: DataFrame, index: DataFrame | Counted, no: DataFrame, channel: str, k: int, keys: tuple[str, ...] = ("query_id", "variant"),
          key: str = "chunk_id", source: DataFrame | None = None, pool: DataFrame | None = None, facets: DataFrame | None = None) -> DataFrame:
    """(keys[0], key, score, rank): the best k chunks of each question over its variants, ties by id.

    ``asked`` is (keys, term, weight).  With ``facets`` (of ``facet_shards``) and ``pool`` (keys[0], facet), a question
    sees only the chunks of its facets; questions of the same facets share a pool.  A chunk among the first k by its best variant is among the first k of
    that variant, so variants are ranked alone.  Questions are broadcast while ``source`` is small; beyond that
    they meet the index by term.
    """
    cols, source = list(keys), asked if source is None else source
    asked = written(asked.select(*cols, "term", "weight"), "asked")
    units = written(asked.select(*cols).distinct().withColumn("unit", F.monotonically_increasing_id()), "units")
    who, which = units, ["unit", "weight"]
    if pool is not None:
        sets = pool.groupBy(cols[0]).agg(F.sort_array(F.collect_set("facet")).alias("_set"))
        pools = written(sets.select("_set").distinct().withColumn("pool", F.monotonically_increasing_id()), "pools")
        own = sets.join(broadcast_if_small(pools, source), "_set").select(cols[0], "pool")
        who, which = units.join(broadcast_if_small(own, source), cols[0]), [*which, "pool"]
    by_term = asked.join(broadcast_if_small(who, source), cols).groupBy("term").agg(F.collect_list(F.struct(*which)).alias("who"))
    names = [r.term for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    counted, about = isinstance(index, Counted), None
    lists, read = index, [channel, f"tops_{channel}"]
    if counted:
        by_term = by_term.join(index.vocab, "term").select("term", "who", index.idf().alias("idf"))
        lists, read, about = index.lists, ["tfs"], index.known.withColumnRenamed("shard", "of")
    lists = lists.where(F.col("term").isin(names)) if len(names) <= NAMED_TERMS else lists
    met = lists.select("shard", "term", "nos", *read).join(broadcast_if_small(by_term, source), "term").drop("term")
    schema = "unit long, no long, s double"
    if pool is None and counted:
        best = met.groupBy("shard").cogroup(about.groupBy("of")).applyInArrow(_scored(channel, k, pooled=False), schema)
    elif pool is None:
        best = met.groupBy("shard").applyInArrow(lambda index: _scored(channel, k)(index), schema)
    else:
        none = F.lit(None)
        each = pools.select("pool", F.explode("_set").alias("facet"))
        side = facets.select("shard", none.cast("long").alias("pool"), "facet", "nos").unionByName(
            facets.select("shard", "facet").join(broadcast_if_small(each, source), "facet").select("shard", "pool", "facet", none.cast("array<int>").alias("nos")))
        side = side.unionByName(about.withColumnRenamed("of", "shard"), allowMissingColumns=True) if counted else side
        best = met.groupBy("shard").cogroup(without_null_lists(side).groupBy("shard")).applyInArrow(_scored(channel, k), schema)
    best = best.join(broadcast_if_small(units, source), "unit").groupBy(cols[0], "no").agg(F.max(six(F.col("s"))).alias("score"))
    # Numbers need not rise with the ids: all that tie with the k-th place meet their ids, which decide.
    few = best.withColumn("rank", F.rank().over(W.partitionBy(cols[0]).orderBy(F.desc("score")))).where(F.col("rank") <= k).drop("rank")
    place = F.row_number().over(W.partitionBy(cols[0]).orderBy(F.desc("score"), key))
    return no.select(key, "no").join(broadcast_if_small(few, source), "no").select(cols[0], key, "score", place.alias("rank")).where(F.col("rank") <= k)
