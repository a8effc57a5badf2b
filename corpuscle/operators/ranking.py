"""From fused candidates to ordered evidence, for a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscle.functions import text as T
from corpuscle.functions import vocab as V
from corpuscle.operators import index as I

RERANK_POOL = 60
FINAL_EVIDENCE = 12
MAX_PARENTS = 6


def exact_candidates(plans: DataFrame, exact_ids: DataFrame) -> DataFrame:
    """(query_id, chunk_id): chunks carrying an identifier the plan names.

    A name ending in an underscore also matches longer identifiers that start with it; the index
    side offers every prefix that ends at an underscore, so this too is an equality.
    """
    named = F.concat("requirement_ids", "api_names", "configuration_parameters")
    want = plans.select("query_id", F.explode(named).alias("ident")).select("query_id", F.lower("ident").alias("ident")).where(F.length("ident") >= 4)
    direct = want.join(exact_ids, "ident").select("query_id", "chunk_id")
    cut = F.split("ident", "_")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(cut) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(cut, 1, n), "_"), F.lit("_"))
    )
    longer = (
        exact_ids.where(F.col("ident").contains("_"))
        .select("chunk_id", F.col("ident").alias("full"), F.explode(prefixes).alias("ident"))
        .where("full <> ident")
    )
    by_prefix = want.where(F.col("ident").endswith("_")).join(longer, "ident").select("query_id", "chunk_id")
    return direct.unionByName(by_prefix).distinct()


def boosted(fused: DataFrame, exact: DataFrame, weight: float = 1.0) -> DataFrame:
    """Fused scores lifted to at least ``weight`` for exact hits."""
    hits = exact.select("query_id", "chunk_id", F.lit(weight).alias("w"))
    return fused.join(hits, ["query_id", "chunk_id"], "full_outer").select(
        "query_id",
        "chunk_id",
        F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("w", F.lit(0.0))).alias("score"),
        F.col("w").isNotNull().alias("exact_hit"),
    )


def candidate_cut(scores: DataFrame, pool: int = RERANK_POOL) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool).withColumn("fused_score", F.round("score", 5)).drop("score")


def identifier_hits(query_tokens: Column, identifiers: Column) -> Column:
    """Identifiers named in the question: equal to a token, or ending in '_' and starting one."""
    low = F.transform(identifiers, F.lower)
    return F.filter(
        low,
        lambda i: (F.length(i) >= 4)
        & (F.array_contains(query_tokens, i) | (i.endswith("_") & F.exists(query_tokens, lambda t: t.startswith(i)))),
    )


def rerank(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, source: DataFrame | None = None,
           w_fused: float = 0.5, w_overlap: float = 0.2, w_exact: float = 0.3) -> DataFrame:
    """Adds rerank_score and the new rank.  Candidates are few per question, so chunk text is read
    once and only candidate rows are tokenized."""
    q = questions.select(
        "query_id",
        F.array_distinct(T.technical_tokens(F.col("text"))).alias("q_terms"),
        F.array_distinct(T.found(F.lower("text"), r"[A-Za-z0-9_]+")).alias("q_words"),
    )
    c = chunks.select(
        "chunk_id",
        F.lower(F.concat_ws(" ", F.coalesce("section_title", F.lit("")), "normalized_text")).alias("body"),
        F.concat("requirement_ids", "api_names", "ecu_parameters").alias("ids"),
    )
    rows = c.join(I.broadcast_if_small(candidates, source), "chunk_id").join(I.broadcast_if_small(q, source), "query_id")
    rows = rows.withColumn("toks", F.array_distinct(T.technical_tokens(F.col("body"))))
    overlap = F.size(F.array_intersect("q_terms", "toks")) / F.greatest(F.size("q_terms"), F.lit(1))
    exact = F.least(F.lit(1.0), 0.5 * F.size(identifier_hits(F.col("q_words"), F.col("ids"))))
    score = F.round(F.col("fused_score") * w_fused + overlap * w_overlap + exact * w_exact, 4)
    out = rows.withColumn("rerank_score", score).drop("body", "ids", "toks", "q_terms", "q_words", "rank")
    return ranked(out)


def ranked(rows: DataFrame, score: str = "rerank_score") -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w))


def parent_expand(rows: DataFrame, chunks: DataFrame, source: DataFrame | None = None, max_parents: int = MAX_PARENTS) -> DataFrame:
    """Parents with two or more ranked children replace them, scored by their best child.

    ``rows`` is (query_id, chunk_id, rank, rerank_score, ...).  At most ``max_parents`` per question,
    largest groups first.  ``merged`` holds the replaced children.
    """
    tree = chunks.select("chunk_id", "parent_chunk_id")
    placed = tree.join(I.broadcast_if_small(rows.select("query_id", "chunk_id", "rank", "rerank_score"), source), "chunk_id")
    groups = placed.where(F.col("parent_chunk_id").isNotNull()).groupBy("query_id", "parent_chunk_id").agg(
        F.count("*").alias("members"),
        F.min("rank").alias("first"),
        F.max("rerank_score").alias("best"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("merged"),
    )
    w = W.partitionBy("query_id").orderBy(F.desc("members"), "first", "parent_chunk_id")
    picked = (
        groups.where("members >= 2")
        .join(tree.select(F.col("chunk_id").alias("parent_chunk_id")), "parent_chunk_id", "left_semi")
        .withColumn("slot", F.row_number().over(w))
        .where(F.col("slot") <= max_parents)
    )
    used = picked.select("query_id", F.explode(F.concat("merged", F.array("parent_chunk_id"))).alias("chunk_id"))
    rest = rows.join(used, ["query_id", "chunk_id"], "left_anti").select(
        "query_id", "chunk_id", "rerank_score", F.lit(1).alias("side"), F.col("rank").alias("slot"),
        F.expr("cast(array() as array<string>)").alias("merged"),
    )
    parents = picked.select("query_id", F.col("parent_chunk_id").alias("chunk_id"), F.col("best").alias("rerank_score"), F.lit(0).alias("side"), "slot", "merged")
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "side", "slot", "chunk_id")
    return parents.unionByName(rest).withColumn("rank", F.row_number().over(order)).drop("side", "slot")


def final_k(intent: Column, k: int = FINAL_EVIDENCE) -> Column:
    return F.when(intent == "configuration", F.lit(int(k * 1.5))).otherwise(k)


def is_model_structure(section_title: Column, text: Column) -> Column:
    """True for chunks that mainly define model classes instead of configuring them."""
    t = F.concat(F.coalesce(section_title, F.lit("")), F.lit("\n"), text)
    model = sum((F.regexp_count(t, F.lit(p)) for p in V.MODEL_MARKERS[1:]), F.regexp_count(t, F.lit(V.MODEL_MARKERS[0])))
    plain = lambda m: F.regexp_count(t, F.lit(m))
    config = sum((plain(m) for m in V.CONFIG_MARKERS[1:]), plain(V.CONFIG_MARKERS[0]))
    return (model >= 4) & (model >= 2 * config) & ~t.contains("ECUC-") & ~t.contains("Mapping Rule")


def model_last(rows: DataFrame) -> DataFrame:
    """Stable partition: configuration evidence first, model structure last."""
    w = W.partitionBy("query_id").orderBy("is_model", "rank")
    return rows.withColumn("is_model", is_model_structure(F.col("section_title"), F.col("normalized_text"))).withColumn(
        "rank", F.row_number().over(w)
    ).drop("is_model")


def compress(text: Column, question: Column, max_chars: Column) -> Column:
    """Extractive: best sentences by word overlap, normative ones favoured, packed greedily into
    ``max_chars`` and put back in order; the head when nothing fits."""
    words = lambda c: F.array_distinct(T.found(F.lower(c), r"[a-z0-9_]+"))
    normative = lambda s: F.exists(F.array(*[F.lit(n) for n in V.NORMATIVE]), lambda n: F.lower(s).contains(n))

    def score_all(q: Column) -> Column:
        return F.transform(
            T.sentences(text),
            lambda s, i: F.struct(
                (-(F.size(F.array_intersect(q, words(s))) + F.when(normative(s), 2).otherwise(0))).alias("neg"),
                i.alias("i"),
                F.length(s).alias("n"),
                s.alias("s"),
            ),
        )

    scored = T.let(words(question), score_all)
    packed = F.aggregate(
        F.array_sort(scored),
        F.struct(F.lit(0).alias("total"), F.expr("cast(array() as array<struct<i:int,s:string>>)").alias("kept")),
        lambda acc, x: F.when(
            (acc["total"] >= max_chars) | (acc["total"] + x["n"] > max_chars), acc
        ).otherwise(
            F.struct(
                (acc["total"] + x["n"]).alias("total"),
                F.concat(acc["kept"], F.array(F.struct(x["i"].alias("i"), x["s"].alias("s")))).alias("kept"),
            )
        ),
        lambda acc: acc["kept"],
    )
    joined = lambda kept: F.array_join(F.transform(F.array_sort(kept), lambda x: x["s"]), " ")
    head = F.substring(text, F.lit(1), max_chars)
    return T.let(packed, lambda kept: F.when(F.size(kept) > 0, joined(kept)).otherwise(head))


def merge_branches(rows: DataFrame, k: Column) -> DataFrame:
    """Per-release rankings (query_id, branch, chunk_id, rank) in branch order, each chunk once, cut to k.

    ``k`` may use the columns of ``rows``.
    """
    rows = rows.withColumn("_k", k).where(F.col("rank") <= F.col("_k"))
    once = rows.withColumn("seen", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("branch", "rank"))).where("seen = 1")
    w = W.partitionBy("query_id").orderBy("branch", "rank", "chunk_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("_k")).drop("seen", "_k")


def sub_questions(plans: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, hop, text): one sub-question per release of a comparison and per module of several, the first ``limit`` if given."""
    text = F.col("text")
    none = F.expr("cast(array() as array<string>)")
    by_release = F.when(F.col("release_mode") == "comparison", F.transform("releases", lambda r: F.concat(text, F.lit(" AUTOSAR "), r))).otherwise(none)
    by_module = F.when(F.size("modules") > 1, F.transform("modules", lambda m: F.concat(text, F.lit(" "), m))).otherwise(none)
    parts = F.array_distinct(F.concat(by_release, by_module))
    parts = F.when(F.size(parts) == 0, F.array(text)).otherwise(parts)
    parts = parts if limit is None else F.slice(parts, 1, limit)
    return plans.select("query_id", F.posexplode(parts).alias("hop", "text"))


def merge_hops(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """Evidence of all hops (query_id, hop, chunk_id, rank) appended in order, new chunks only, ``cap`` a question if given."""
    once = rows.withColumn("seen", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("hop", "rank"))).where("seen = 1")
    w = W.partitionBy("query_id").orderBy("hop", "rank", "chunk_id")
    merged = once.withColumn("rank", F.row_number().over(w)).drop("seen")
    return merged if cap is None else merged.where(F.col("rank") <= cap)


def corrective(first: DataFrame, retry: DataFrame, questions: DataFrame, minimum: int = 3) -> DataFrame:
    """For questions with fewer than ``minimum`` evidence rows, the retry if it is longer."""
    n1 = first.groupBy("query_id").agg(F.count("*").alias("n1"))
    n2 = retry.groupBy("query_id").agg(F.count("*").alias("n2"))
    choice = questions.select("query_id").join(n1, "query_id", "left").join(n2, "query_id", "left").fillna(0, ["n1", "n2"])
    swap = choice.where((F.col("n1") < minimum) & (F.col("n2") > F.col("n1"))).select("query_id")
    return first.join(swap, "query_id", "left_anti").unionByName(retry.select(*first.columns).join(swap, "query_id", "left_semi"))


def retrieval_score(rows: DataFrame, questions: DataFrame) -> DataFrame:
    s = rows.groupBy("query_id").agg(F.avg("rerank_score").alias("s"))
    return questions.select("query_id").join(s, "query_id", "left").select("query_id", F.round(F.round(F.coalesce("s", F.lit(0.0)), 8), 4).alias("retrieval_score"))


TEXT_TYPES = ("text", "requirement", "api", "configuration")
VISUAL_TYPES = ("image", "diagram", "equation", "graph")


def context_budget(evidence: DataFrame, wanted: DataFrame, texts: int = 12, tables: int = 4, visuals: int = 3) -> DataFrame:
    """Evidence that fits the answer context.

    ``evidence`` has query_id, rank, chunk_id, release, content_type, score, caption, page_start;
    ``wanted`` has query_id, releases, modalities.  When a question names releases and any evidence is
    exactly of one, the others are dropped; then every class has its budget.
    """
    e = evidence.join(wanted, "query_id")
    match = (F.size("releases") > 0) & F.array_contains("releases", F.col("release"))
    any_match = F.max(match.cast("int")).over(W.partitionBy("query_id"))
    e = e.withColumn("_m", match).withColumn("_any", any_match).where((F.col("_any") == 0) | F.col("_m"))
    kind = F.when(F.col("content_type").isin(*TEXT_TYPES), "text").when(F.col("content_type") == "table", "table").when(F.col("content_type").isin(*VISUAL_TYPES), "visual")
    visual_ok = (
        F.arrays_overlap("modalities", F.array(F.lit("diagram"), F.lit("image"), F.lit("graph")))
        & ((F.coalesce("score", F.lit(0.0)) >= 0.3) | (F.coalesce("caption", F.lit("")) != ""))
        & F.col("page_start").isNotNull()
    )
    e = e.withColumn("class", kind).where(F.col("class").isNotNull() & ((F.col("class") != "visual") | visual_ok))
    w = W.partitionBy("query_id", "class").orderBy("rank")
    budget = F.when(F.col("class") == "text", texts).when(F.col("class") == "table", tables).otherwise(visuals)
    return e.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= budget).drop("_m", "_any", "releases", "modalities")
