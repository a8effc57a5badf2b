"""Evaluation of batches: ranking metrics, diagnosis, aggregates, golden-set checks, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscle.functions import metrics as M
from corpuscle.functions import text as T
from corpuscle.functions import vocab as V

RATIO_METRICS = ("context_recall", "context_precision")
BINARY_METRICS = ("abstention_accuracy", "hit_rate")


def ranking_metrics(ranked: DataFrame, gold: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """Recall@k, MRR, nDCG@k, context precision/recall and hit rate per question.

    ``ranked`` is (query_id, rank, id), ids distinct per question; ``gold`` is (query_id, id).  Gold ids
    are matched by join and counted, never collected: a passage may have very many copies.
    """
    sizes = gold.groupBy("query_id").agg(F.count_distinct("id").alias("gold_n"))
    hits = ranked.join(gold.distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    gain = F.when(F.col("hit").isNotNull(), 1.0 / F.log2(F.col("rank") + 1.0))
    got = hits.groupBy("query_id").agg(
        F.count("*").alias("retrieved"),
        F.count("hit").alias("hits"),
        F.count(F.when(F.col("rank") <= k, F.col("hit"))).alias("hits_k"),
        F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first_hit"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, gain)), F.lit(0.0)).alias("dcg"),
    )
    rows = questions.select("query_id").join(got, "query_id", "left").join(sizes, "query_id", "left")
    rows = rows.fillna(0, ["retrieved", "hits", "hits_k", "gold_n"]).fillna(0.0, ["dcg"])
    g, r = F.col("gold_n"), F.col("retrieved")
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(g, F.lit(k)).cast("int"))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0)
    )
    none = F.when(r == 0, 1.0).otherwise(0.0)
    return rows.select(
        "query_id",
        "gold_n",
        "retrieved",
        F.round(F.when(g == 0, none).otherwise(F.col("hits_k") / g), 4).alias("recall_at_k"),
        F.round(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)), 4).alias("mrr"),
        F.round(F.when(g == 0, 0.0).otherwise(F.col("dcg") / ideal), 4).alias("ndcg"),
        F.round(F.when((r == 0) | (g == 0), 0.0).otherwise(F.col("hits") / r), 4).alias("context_precision"),
        F.round(F.when(g == 0, 0.0).otherwise(F.col("hits") / g), 4).alias("context_recall"),
        F.when(g > 0, F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )


def citation_pairs(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, claim_no, rank, chunk_id, supported) of cited pairs.

    ``claims`` is (query_id, claim_no, claim); labels ``[En]`` resolve to the n-th evidence row.
    """
    labels = F.array_distinct(F.transform(T.found(F.col("claim"), r"\[E(\d+)\]", 1), lambda x: x.cast("int")))
    cited = claims.select("query_id", "claim_no", "claim", F.explode(labels).alias("rank"))
    return cited.join(evidence.select("query_id", "rank", "chunk_id", "text"), ["query_id", "rank"]).select(
        "query_id", "claim_no", "rank", "chunk_id", M.claim_supported(F.col("claim"), F.col("text")).alias("supported")
    )


def citation_precision(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("query_id").agg(F.round(F.avg(F.col("supported").cast("double")), 4).alias("citation_precision"), F.count("*").alias("pairs"))


def item_rows(items: DataFrame, results: DataFrame, evidence: DataFrame, claims: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """One evaluation row per golden item.

    ``items``: query_id, question, category, difficulty, answerable, gold_answer, gold_requirement_ids.
    ``results``: query_id, answer, abstained, latency_s (answer '' and abstained NULL when the engine did
    not run; ``error`` and ``clarified`` count if present).  ``evidence``: query_id, rank, chunk_id, text, requirement_ids.  ``claims``: query_id,
    claim_no, claim.  ``gold``: query_id, id.
    """
    ranks = ranking_metrics(evidence.select("query_id", "rank", F.col("chunk_id").alias("id")), gold, items, k)
    # Evidence is at most the final k rows per question, so its texts fit one row.
    texts = evidence.groupBy("query_id").agg(
        F.count("*").alias("evidence_count"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"),
        F.array_distinct(F.flatten(F.collect_list("requirement_ids"))).alias("got_reqs"),
    )
    pairs = citation_pairs(claims, evidence)
    prec = citation_precision(pairs).select("query_id", "citation_precision")
    cited = pairs.select("query_id", "chunk_id").distinct()
    gold_cited = cited.join(gold.select("query_id", F.col("id").alias("chunk_id")), ["query_id", "chunk_id"], "left_semi")
    cites = cited.groupBy("query_id").agg(F.count("*").alias("cited")).join(
        gold_cited.groupBy("query_id").agg(F.count("*").alias("gold_cited")), "query_id", "left"
    )
    said = claims.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("claim_no", "claim"))).alias("cs"))
    rows = items
    for part in (results, ranks, texts, prec, cites, said):
        rows = rows.join(part, "query_id", "left")
    none = F.expr("cast(array() as array<string>)")
    answered = F.coalesce("answer", F.lit("")) != ""
    reqs = F.array_distinct("gold_requirement_ids")
    texts_c = F.coalesce("texts", none)
    rows = rows.withColumns(
        {
            "evidence_count": F.coalesce("evidence_count", F.lit(0)),
            "citation_recall": F.when(F.col("cited") > 0, F.round(F.coalesce("gold_cited", F.lit(0)) / F.greatest(F.col("gold_n"), F.lit(1)), 4)),
            "requirement_recall": F.when(F.size(reqs) > 0, F.bround(F.size(F.array_intersect(reqs, F.coalesce("got_reqs", none))) / F.size(reqs), 4)),
            "faithfulness": F.when(F.size("cs") > 0, M.faithfulness(F.transform("cs", lambda c: c["claim"]), texts_c)),
            "answer_relevance": F.when(answered, M.answer_relevance(F.col("question"), F.col("answer"))),
            "answer_correctness": F.when(answered & F.col("answerable") & (F.coalesce("gold_answer", F.lit("")) != ""), M.rouge1_f1(F.col("answer"), F.col("gold_answer"))),
            "exact_id_match": F.when(answered & (F.size(reqs) > 0), M.exact_id_match(reqs, F.col("answer"))),
            "hallucinated_id_rate": F.when(answered, M.hallucinated_rate(F.col("answer"), texts_c)),
            "hallucinated": F.when(answered, F.size(M.hallucinated_ids(F.col("answer"), texts_c))).otherwise(0),
            "abstention_accuracy": M.abstention_accuracy(F.col("answerable"), F.col("abstained")),
        }
    )
    return diagnosed(rows).drop("texts", "got_reqs", "cs")


def diagnosis() -> Column:
    """The first failure rule that holds, else ok; works on the columns of an evaluation row."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    answerable, abstained = c("answerable", False), c("abstained", False)
    none = c("evidence_count", 0) == 0
    return (
        F.when(~answerable & none, "no_evidence_for_unanswerable_question")
        .when(none, "no_evidence_retrieved")
        .when(abstained & (c("context_recall", 0.0) > 0), "abstained_despite_gold_evidence")
        .when(abstained, "abstained_without_evidence")
        .when(answerable & (c("gold_n", 0) > 0) & (c("context_recall", 0.0) == 0), "gold_evidence_not_retrieved")
        .when(c("hallucinated", 0) > 0, "hallucinated_identifier")
        .when(c("citation_precision", 1.0) < 0.5, "citation_not_supporting_claim")
        .when(answerable & (c("answer_correctness", 1.0) < 0.15), "answer_does_not_cover_gold")
        .when(~answerable & F.col("abstained").isNotNull(), "unanswerable_question_was_answered")
        .when(c("latency_s", 0.0) > 30, "slow")
        .otherwise("ok")
    )


def diagnosed(rows: DataFrame) -> DataFrame:
    """Adds ``failure``; ``error`` and ``clarified`` outrank the other rules when present."""
    rule = diagnosis()
    if "clarified" in rows.columns:
        rule = F.when(F.coalesce("clarified", F.lit(False)), "clarify_asked_instead_of_answering").otherwise(rule)
    if "error" in rows.columns:
        rule = F.when(F.coalesce("error", F.lit("")) != "", "error").otherwise(rule)
    return rows.withColumn("failure", rule)


def aggregates(rows: DataFrame, ratios=RATIO_METRICS, binaries=BINARY_METRICS, means=("mrr", "ndcg")) -> DataFrame:
    """Overall, per category and per difficulty in one pass: counts, means, intervals, percentiles."""
    parts = [
        F.count("*").alias("n"),
        F.count_if("answerable").alias("answerable"),
        F.round(F.count_if(F.coalesce("abstained", F.lit(False))) / F.count("*"), 4).alias("abstention_rate"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_s)").alias("latency_p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_s)").alias("latency_p95"),
    ]
    for m in means:
        parts.append(F.round(F.avg(m), 4).alias(m))
    for m in ratios:
        low, high = M.mean_ci(F.avg(m), F.var_samp(m), F.count(m))
        parts += [F.round(F.avg(m), 4).alias(m), low.alias(f"{m}_low"), high.alias(f"{m}_high")]
    for m in binaries:
        low, high = M.wilson(F.count_if(F.col(m) >= 0.999), F.count(m))
        parts += [F.round(F.avg(m), 4).alias(m), low.alias(f"{m}_low"), high.alias(f"{m}_high")]
    named = rows.withColumns({"category": F.coalesce("category", F.lit("unknown")), "difficulty": F.coalesce("difficulty", F.lit("unknown"))})
    out = named.groupingSets([[], [F.col("category")], [F.col("difficulty")]], "category", "difficulty").agg(F.grouping_id().alias("g"), *parts)
    slice_ = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, F.concat(F.lit("category:"), "category")).otherwise(F.concat(F.lit("difficulty:"), "difficulty"))
    return out.withColumn("slice", slice_).drop("g", "category", "difficulty")


def failure_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("failure").agg(F.count("*").alias("n"))


def worst(rows: DataFrame, limit: int = 20) -> DataFrame:
    penalty = F.coalesce(F.try_element_at(T.string_map(V.FAILURE_PENALTY), F.col("failure")), F.lit(0))
    return rows.withColumn("penalty", penalty).orderBy(
        F.desc("penalty"), F.coalesce("context_recall", F.lit(0.0)), F.desc(F.coalesce("latency_s", F.lit(0.0))), "query_id"
    ).limit(limit)


# --- golden set -------------------------------------------------------------------------------


def validation(items: DataFrame) -> DataFrame:
    """(query_id, problem) of a golden set; empty when it is valid."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    size = F.size(F.coalesce("gold_evidence_ids", F.expr("cast(array() as array<string>)")))
    ok = F.coalesce("answerable", F.lit(False))
    rules = [
        *[F.when(F.col(f).isNull(), f"missing field '{f}'") for f in ("query_id", "question", "category", "difficulty", "answerable", "gold_answer")],
        F.when(blank("question"), "empty question"),
        F.when(~blank("category") & ~F.col("category").isin(*V.CATEGORIES), F.concat(F.lit("unknown category '"), "category", F.lit("'"))),
        F.when(~blank("difficulty") & ~F.col("difficulty").isin(*V.DIFFICULTIES), F.concat(F.lit("unknown difficulty '"), "difficulty", F.lit("'"))),
        F.when(ok & (size == 0), "answerable item without gold_evidence_ids"),
        F.when(ok & blank("gold_answer"), "answerable item without gold_answer"),
        F.when(~ok & (size > 0), "unanswerable item must not carry gold_evidence_ids"),
    ]
    per_row = items.select("query_id", F.explode(F.array_compact(F.array(*rules))).alias("problem"))
    # One row per repeated id, counted with map-side combine.
    again = items.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id", F.lit("duplicate query_id").alias("problem"))
    return per_row.unionByName(again)


def coverage(items: DataFrame, count_tag_occurrences: bool = False) -> DataFrame:
    """(slice, target, n, actual, shortfall, met) against the target shares.

    An item counts once per slice, by category or tag; ``count_tag_occurrences`` counts the category and
    every tag occurrence instead.
    """
    total = items.agg(F.count("*").alias("n")).scalar()
    slices = F.concat(F.array("category"), F.coalesce("tags", F.expr("cast(array() as array<string>)")))
    counted = items.select(F.explode(slices if count_tag_occurrences else F.array_distinct(slices)).alias("slice")).groupBy("slice").agg(F.count("*").alias("n"))
    spark = items.sparkSession
    targets = spark.createDataFrame([(k, float(v)) for k, v in V.COVERAGE_TARGETS.items()], "slice string, target double")
    rows = F.broadcast(targets).join(counted, "slice", "left").fillna(0, ["n"])
    need = F.ceil(F.round(F.col("target") * total, 6)) - F.col("n")
    return rows.select(
        "slice", "target", "n", F.round(F.col("n") / total, 4).alias("actual"), F.greatest(need, F.lit(0)).cast("bigint").alias("shortfall"),
        (F.col("n") / total >= F.col("target")).alias("met"),
    )


def stratified_sample(items: DataFrame, size: int = 40, seed: int = 20261021) -> DataFrame:
    """At least size/#categories per category, topped up to ``size``; order by a salted hash.

    The per-category cut and the top-up are limits with a heap per task; the result has ``size`` rows.
    """
    h = F.sha2(F.concat_ws("|", "query_id", F.lit(str(seed))), 256)
    n_cat = items.agg(F.countDistinct("category").alias("c")).scalar()
    w = W.partitionBy("category").orderBy("h", "query_id")
    rows = items.withColumn("h", h).withColumn("rn", F.row_number().over(w))
    rows = rows.where(F.col("rn") <= size)
    quota = F.greatest(F.lit(1), F.floor(F.lit(size) / n_cat))
    return rows.withColumn("extra", (F.col("rn") > quota).cast("int")).orderBy("extra", "h", "query_id").limit(size).drop("h", "rn", "extra")


def golden_fingerprint(items: DataFrame) -> DataFrame:
    h = F.xxhash64(F.to_json(F.struct(*sorted(items.columns))))
    return items.agg(F.count("*").alias("count"), F.bit_xor(h).alias("rows_xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("rows_sum"))


def freeze_split(items: DataFrame, ratio: float = 0.2, salt: str = M.SALT) -> DataFrame:
    return items.select("query_id", M.split_of(F.col("query_id"), ratio, salt).alias("split"))


def split_problems(items: DataFrame, frozen_split: DataFrame, frozen_fingerprint: DataFrame) -> DataFrame:
    """(problem) rows when the golden set drifted from its frozen split."""
    drift = golden_fingerprint(items).exceptAll(frozen_fingerprint).select(F.lit("golden set changed since the split was frozen").alias("problem"))
    gone = frozen_split.where("split = 'holdout'").join(items.select("query_id"), "query_id", "left_anti")
    missing = gone.agg(F.count("*").alias("n")).where("n > 0").select(F.concat(F.col("n").cast("string"), F.lit(" hold-out ids are absent from the golden set")).alias("problem"))
    return drift.unionByName(missing)


def scored_split(items: DataFrame, frozen_split: DataFrame, frozen_fingerprint: DataFrame, split: str) -> DataFrame:
    """The items of one split; refuses to score a drifted set."""
    problem = split_problems(items, frozen_split, frozen_fingerprint).first()
    if problem:
        raise ValueError(problem["problem"])
    return items.join(frozen_split.where(F.col("split") == split).select("query_id"), "query_id", "left_semi")


def gate(measured: DataFrame, rules: DataFrame) -> DataFrame:
    """(metric, measured, threshold, direction, status) of metrics against (metric, direction, threshold, tolerance)."""
    rows = rules.join(measured, "metric", "left")
    low, high = F.col("threshold") - F.col("tolerance"), F.col("threshold") + F.col("tolerance")
    good = F.when(F.col("direction") == "min", F.col("measured") >= low).otherwise(F.col("measured") <= high)
    return rows.withColumn("status", F.when(F.col("measured").isNull(), "skipped").when(good, "pass").otherwise("fail"))


def gate_verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.every(F.col("status") != "fail"), F.lit(True)).alias("passed"), F.count("*").alias("checks"))


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """Document hit rate, abstention, version and module precision and median latency.

    ``rows``: hit (boolean or NULL), abstained, version_ok, module_ok, latency_s.
    """
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    hits = F.count_if(F.coalesce("hit", F.lit(False))) / F.greatest(F.lit(1), F.count("hit"))
    return rows.agg(
        F.count("*").alias("n"), F.round(hits, 4).alias("hit_rate"), mean("abstained").alias("abstention_rate"),
        mean("version_ok").alias("version_precision"), mean("module_ok").alias("module_precision"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_s)").alias("p50_latency_s"),
    )


def compare_backends(runs: dict[str, DataFrame]) -> DataFrame:
    """Aggregates (slice, metrics...) of several backends side by side with a ``backend`` column."""
    out = None
    for name, df in runs.items():
        part = df.withColumn("backend", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
