"""Question-log mining: outcomes, similarity clusters, ranking, promotion, conversation listings."""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscle.functions import text as T
from corpuscle.functions import vocab as V
from corpuscle.operators import index as I
from corpuscle.session import written

#: Tokens of a block of sets: blocks are at least as large, if there are few sets, and at most.
LEAST_TOKENS, BLOCK_TOKENS = 1 << 15, 1 << 21
#: Pairs that a task passes on at once.
BATCH_PAIRS = 1 << 16

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the plan: workers need no copy of the package


def outcome(clarify: Column, abstained: Column, coverage: Column) -> Column:
    return F.when(clarify, "CLARIFY").when(abstained, "ABSTAIN").when(coverage < 1, "PARTIAL").otherwise("ANSWERED")


def log_merge(log: DataFrame, downvoted: DataFrame, newest: int | None = None) -> DataFrame:
    """The log rows (the ``newest`` only, if a number is given) plus down-voted questions whose text is not among them."""
    recent = log if newest is None else log.orderBy(F.desc("created_at"), "id").limit(newest)
    recent = recent.select("id", "query", "outcome", "intent")
    extra = downvoted.join(recent.select("query").distinct(), "query", "left_anti")
    return recent.unionByName(extra.select("id", "query", F.lit("DOWN").alias("outcome"), "intent"))


def token_sets(log: DataFrame, key: str = "id", text: str = "query") -> DataFrame:
    """(key, toks): content-word set, or all words when only stop words remain."""
    content = F.array_distinct(T.content_tokens(F.col(text)))
    every = F.array_distinct(F.transform(T.found(F.col(text), V.WORD), F.lower))
    return log.select(key, F.when(F.size(content) > 0, content).otherwise(every).alias("toks"))


def jaccard_pairs(sets: DataFrame, threshold: float, key: str = "id") -> DataFrame:
    """(a, b, jaccard) of distinct token sets at or above the threshold, a < b; exact.

    Equal sets stand for one representative, so copies of a question never pair with each other.
    """
    reps = representatives(sets, key).select(F.col("rep").alias("id"), "toks", F.size("toks").alias("n")).distinct().where("n > 0")
    return _pairs(written(reps, "token_sets"), threshold)


def representatives(sets: DataFrame, key: str = "id") -> DataFrame:
    """(key, toks, rep): rep is the smallest key with the same token set."""
    keyed = sets.withColumn("sig", F.sha2(F.array_join(F.array_sort("toks"), "\x01"), 256))
    firsts = keyed.groupBy("sig").agg(F.min(key).alias("rep"))
    return keyed.join(firsts, "sig").select(key, F.array_sort("toks").alias("toks"), "rep")


def _pairs(reps: DataFrame, t: float) -> DataFrame:
    """(a, b, jaccard): all pairs that share a token and reach the threshold, a < b; exact."""
    kind = reps.schema["id"].dataType.simpleString()
    return _in_blocks(reps, _alike_pairs, t, f"a {kind}, b {kind}, jaccard double").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard").where("a <> b")


def _links(reps: DataFrame, t: float) -> DataFrame:
    """(a, b): enough true links to connect whatever the threshold connects, few per set.

    Every two blocks pass on a spanning forest of their links, so a set has at most about one link a block.
    """
    kind = reps.schema["id"].dataType.simpleString()
    return _in_blocks(reps, _forest, t, f"a {kind}, b {kind}").where("a <> b")


def _in_blocks(reps: DataFrame, made, t: float, schema: str) -> DataFrame:
    """What ``made`` finds between the sets (id, toks) of every two blocks.

    A block is a share of the sets, chosen by id, and every two blocks meet in one task, which counts common tokens in memory:
    candidate pairs are no rows, and a frequent token is no group.  A set travels once a block.  There are about as many blocks as
    give each core some pairs of them; more only when a block would exceed ``BLOCK_TOKENS``.
    """
    tokens = reps.agg(F.sum(F.size("toks"))).first()[0] or 0
    cores = reps.sparkSession.sparkContext.defaultParallelism
    n = max(min(math.ceil(math.sqrt(8 * cores)), tokens // LEAST_TOKENS), -(-tokens // BLOCK_TOKENS), 1)
    met = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.least("block", o) * n + F.greatest("block", o))
    sets = reps.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "id", "toks")
    placed = sets.select(F.explode(met).alias("pair"), "block", "id", "toks").repartition(n * (n + 1) // 2, "pair").sortWithinPartitions("pair", "block")
    return placed.mapInArrow(lambda batches: made(batches, t, n), schema)


def _by_pair(batches):
    """The rows of one pair of blocks after those of the other."""
    import pyarrow as pa

    held = []
    for batch in batches:
        of = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)] if len(of) else []
        for i, j in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != of[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _alike(rows, t: float, n: int):
    """(row, other rows, their Jaccard) of the sets of two blocks, or of one with itself: each pair once."""
    x, y = divmod(rows.column("pair")[0].as_py(), n)
    many = rows.num_rows if x == y else int((rows.column("block").to_numpy() == x).sum())
    first = 0 if x == y else many
    toks = rows.column("toks").combine_chunks()
    sizes = np.diff(toks.offsets.to_numpy())
    code = toks.flatten().dictionary_encode().indices.to_numpy()
    starts = np.append(0, np.cumsum(sizes))
    theirs, of = code[starts[first] :], sizes[first:]
    held = np.repeat(np.arange(len(of)), of)[np.argsort(theirs, kind="stable")]
    at = np.append(0, np.cumsum(np.bincount(theirs, minlength=code.max() + 1)))
    share, common = t / (1 + t), np.zeros(len(of), np.int32)
    least = share * of - 1e-9
    for r in range(many):
        common[:] = 0
        for c in code[starts[r] : starts[r + 1]].tolist():
            common[held[at[c] : at[c + 1]]] += 1
        hit = np.flatnonzero(common >= np.maximum(least + share * sizes[r], 1))
        hit = hit[hit > r] if x == y else hit
        jaccard = common[hit] / (sizes[r] + of[hit] - common[hit])
        yield r, hit[jaccard >= t] + first, jaccard[jaccard >= t]


def _alike_pairs(batches, t: float, n: int):
    """Batches (a, b, jaccard) of all pairs at or above the threshold."""
    import pyarrow as pa

    def batch(ids, found):
        a = np.repeat([r for r, _, _ in found], [len(hit) for _, hit, _ in found])
        b, jaccard = (np.concatenate([x[i] for x in found]) for i in (1, 2))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(jaccard)], names=["a", "b", "jaccard"])

    for rows in _by_pair(batches):
        ids, found, size = rows.column("id").combine_chunks(), [], 0
        for x in _alike(rows, t, n):
            if len(x[1]):
                found.append(x)
                size += len(x[1])
            if size >= BATCH_PAIRS:
                yield batch(ids, found)
                found, size = [], 0
        if found:
            yield batch(ids, found)


def _forest(batches, t: float, n: int):
    """Batches (a, b) of links that connect what the threshold connects: one less than the sets of each component."""
    import pyarrow as pa

    for rows in _by_pair(batches):
        ids, top, left, links = rows.column("id").combine_chunks(), np.arange(rows.num_rows), rows.num_rows, []
        for r, hit, _ in _alike(rows, t, n):
            if not len(hit):
                continue
            every = np.append(r, hit)
            root = top[every]
            while (top[root] != root).any():
                root = top[root]
            roots, where = np.unique(root, return_index=True)
            new = where[roots != root[0]]
            links += [(r, b) for b in every[new].tolist()]
            left -= len(new)
            top[roots] = top[every] = roots[0]
            if left == 1:
                break
        if links:
            a, b = np.array(links).T
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])


def connected_components(vertices: DataFrame, pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, cluster): cluster is the smallest id reachable.

    Large-star / small-star rounds: labels jump across a component, so rounds grow with the logarithm
    of its diameter, and a hub's edges are rewired away instead of being expanded.  Every round is
    written to the shared folder and the loop ends when the edge set stands still.
    """
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a vertex points at the vertex's smallest neighbour.
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a vertex and its smaller neighbours point at the smallest of them.
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "cc")
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    label = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("cluster"))
    return vertices.select("id").join(label, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def similarity_clusters(log: DataFrame, threshold: float = 0.3, key: str = "id", text: str = "query") -> DataFrame:
    """(id, cluster) of logged questions by token-set similarity."""
    reps = written(representatives(token_sets(log, key, text).withColumnRenamed(key, "id")), "representatives")
    distinct = reps.where(F.col("id") == F.col("rep")).select("id", "toks", F.size("toks").alias("n"))
    comp = connected_components(distinct, _links(distinct.where("n > 0"), threshold))
    return reps.select("id", "rep").join(comp.select(F.col("id").alias("rep"), "cluster"), "rep").select("id", "cluster")


def cluster_ranking(log: DataFrame, clusters: DataFrame, show: int = 20) -> DataFrame:
    """One row per cluster: size, score, outcome counts, top intent, and its first ``show`` members for display.

    Sums and the shown members are bounded aggregates; a very large cluster is never collected.
    """
    rows = log.join(clusters, "id")
    weight = F.coalesce(F.try_element_at(T.string_map(V.OUTCOME_WEIGHT), F.col("outcome")), F.lit(1))
    base = rows.groupBy("cluster").agg(
        F.count("*").alias("size"), F.sum(weight).alias("w"),
        *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("ANSWERED", "PARTIAL", "ABSTAIN", "CLARIFY", "DOWN")],
    )
    per_intent = rows.groupBy("cluster", "intent").agg(F.count("*").alias("n"))
    top = per_intent.groupBy("cluster").agg(F.min_by("intent", F.struct((-F.col("n")).alias("n"), "intent")).alias("top_intent"))
    w = W.partitionBy("cluster").orderBy("id")
    shown = rows.select("cluster", "id").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= show)
    members = shown.groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return base.join(top, "cluster").join(members, "cluster").withColumn("score", F.col("size") * F.col("w")).drop("w")


def promote(labels: DataFrame, golden_ids: DataFrame, prefix: str = "mined") -> DataFrame:
    """Labelled questions with the next free golden ids, numbered after the highest used one."""
    used = golden_ids.select(F.regexp_extract("query_id", rf"^{prefix}-(\d+)$", 1).cast("bigint").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    new = labels.join(golden_ids.select("query_id").withColumnRenamed("query_id", "id"), "id", "left_anti")
    # Numbering across partitions: counts per partition give offsets, so no global sort in one task.
    placed = new.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("c"))
    offsets = sizes.withColumn("off", F.coalesce(F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("part").orderBy("id"))
    return placed.withColumn("k", inside).join(F.broadcast(offsets.select("part", "off")), "part").select(
        F.format_string(f"{prefix}-%04d", F.col("k") + F.col("off") + used.scalar()).alias("query_id"), *labels.columns
    )


def conversation_listing(messages: DataFrame) -> DataFrame:
    """(conv_id, title, messages, last_turn): the title is the first user text, cut to 60."""
    return messages.groupBy("conv_id").agg(
        F.substring(F.coalesce(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))), F.lit("New chat")), 1, 60).alias("title"),
        F.count("*").alias("messages"),
        F.max("turn").alias("last_turn"),
    )


def service_metrics(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 4).alias("mean_latency")
    )
