"""Queries: evaluation, golden set, verification, question understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import metrics as M
from corpuscle.functions import text as T
from corpuscle.functions import vocab as V
from corpuscle.operators import evaluation as E
from corpuscle.operators import golden as GO
from corpuscle.operators import questions as QU
from corpuscle.operators import verification as VE
from corpuscle.plans import corpus as K
from corpuscle.plans import oracle as O
from corpuscle.plans.q_index import channels
from corpuscle.plans.q_retrieval import VIEWS as RVIEWS
from corpuscle.plans.q_retrieval import final
from corpuscle.plans.registry import query
from pyspark.sql.window import Window as W



def none():
    return F.expr("cast(array() as array<string>)")


def sql(body: str, **more: str) -> str:
    return O.sql(body, **{**RVIEWS, **EVAL_VIEWS, **more})


# Best chunk per document of the lexical channel: documents ranked per question.
EVAL_VIEWS = {
    "docrank": """
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY best, id) AS rank FROM (
  SELECT query_id, document_id AS id, min(rank) AS best FROM bm25_ch JOIN chunks USING (chunk_id) GROUP BY ALL) QUALIFY rank <= 12""",
    "rmetrics": """
SELECT q.query_id, coalesce(gold_n, 0) AS gold_n, coalesce(retrieved, 0) AS retrieved,
  round(CASE WHEN gold_n IS NULL THEN CASE WHEN retrieved IS NULL THEN 1.0 ELSE 0.0 END ELSE hits_k / gold_n END::DOUBLE, 4) AS recall_at_k,
  round(coalesce(1.0::DOUBLE / first_hit, 0), 4) AS mrr,
  round(CASE WHEN gold_n IS NULL THEN 0 ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, least(gold_n, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) END::DOUBLE, 4) AS ndcg,
  round(CASE WHEN gold_n IS NULL OR retrieved IS NULL THEN 0 ELSE hits / retrieved END::DOUBLE, 4) AS context_precision,
  round(CASE WHEN gold_n IS NULL THEN 0 ELSE coalesce(hits, 0) / gold_n END::DOUBLE, 4) AS context_recall,
  CASE WHEN gold_n > 0 THEN CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS hit_rate
FROM qs q LEFT JOIN (SELECT query_id, count(DISTINCT document_id) AS gold_n FROM golds GROUP BY 1) g ON g.query_id = q.query_id
LEFT JOIN (SELECT r.query_id, count(*) AS retrieved, count(g.document_id) AS hits, count(CASE WHEN rank <= 10 THEN g.document_id END) AS hits_k,
    min(CASE WHEN g.document_id IS NOT NULL THEN rank END) AS first_hit, sum(CASE WHEN g.document_id IS NOT NULL AND rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) END) AS dcg
  FROM docrank r LEFT JOIN golds g ON g.query_id = r.query_id AND g.document_id = r.id GROUP BY 1) h ON h.query_id = q.query_id""",
    "erows": f"""
SELECT m.*, intent AS category, {O.case('(n % 3)::VARCHAR', dict(enumerate(V.DIFFICULTIES)))} AS difficulty, gold_n > 0 AS answerable, n % 7 = 0 AS abstained, (n % 40)::DOUBLE AS latency_s,
  CASE WHEN n % 11 = 0 THEN 0 ELSE retrieved END AS evidence_count, CASE WHEN n % 13 = 0 THEN 1 ELSE 0 END AS hallucinated, (n % 4) / 4.0::DOUBLE AS citation_precision,
  CASE WHEN gold_n > 0 THEN (n % 10) / 10.0::DOUBLE END AS answer_correctness, CASE WHEN n % 17 = 3 THEN 'timeout' ELSE '' END AS error, n % 19 = 4 AS clarified, ((gold_n > 0) <> (n % 7 = 0))::INT::DOUBLE AS abstention_accuracy
FROM (SELECT *, substr(query_id, 3)::BIGINT AS n FROM rmetrics) m JOIN plans USING (query_id)""",
    "drows": """
SELECT *, CASE WHEN error <> '' THEN 'error' WHEN clarified THEN 'clarify_asked_instead_of_answering' WHEN NOT answerable AND evidence_count = 0 THEN 'no_evidence_for_unanswerable_question'
  WHEN evidence_count = 0 THEN 'no_evidence_retrieved' WHEN abstained AND context_recall > 0 THEN 'abstained_despite_gold_evidence' WHEN abstained THEN 'abstained_without_evidence'
  WHEN answerable AND gold_n > 0 AND context_recall = 0 THEN 'gold_evidence_not_retrieved' WHEN hallucinated > 0 THEN 'hallucinated_identifier' WHEN citation_precision < 0.5 THEN 'citation_not_supporting_claim'
  WHEN answerable AND coalesce(answer_correctness, 1) < 0.15 THEN 'answer_does_not_cover_gold' WHEN NOT answerable THEN 'unanswerable_question_was_answered' WHEN latency_s > 30 THEN 'slow' ELSE 'ok' END AS failure FROM erows""",
}
EVAL_VIEWS["docrank"] = "SELECT * FROM (" + EVAL_VIEWS["docrank"].replace(" QUALIFY rank <= 12", "") + ") WHERE rank <= 12"


def document_ranks(spark, d):
    docs = K.chunks(spark, d).select("chunk_id", F.col("document_id").alias("id"))
    best = channels(spark, d)["bm25"].join(docs, "chunk_id").groupBy("query_id", "id").agg(F.min("rank").alias("best"))
    w = W.partitionBy("query_id").orderBy("best", "id")
    return best.withColumn("rank", F.row_number().over(w)).where("rank <= 12").select("query_id", "rank", "id")


def metric_rows(spark, d):
    gold = K.gold(spark, d).select("query_id", F.col("document_id").alias("id"))
    return E.ranking_metrics(document_ranks(spark, d), gold, K.questions(spark, d))


def eval_rows(spark, d):
    def make():
        n = F.substring("query_id", 3, 20).cast("bigint")
        m = metric_rows(spark, d).join(K.plans(spark, d).select("query_id", F.col("intent").alias("category")), "query_id")
        return m.withColumns({
            "difficulty": F.element_at(F.array(*[F.lit(x) for x in V.DIFFICULTIES]), (n % 3 + 1).cast("int")), "answerable": F.col("gold_n") > 0, "abstained": n % 7 == 0,
            "latency_s": (n % 40).cast("double"), "evidence_count": F.when(n % 11 == 0, 0).otherwise(F.col("retrieved")), "hallucinated": F.when(n % 13 == 0, 1).otherwise(0),
            "citation_precision": (n % 4) / 4.0, "answer_correctness": F.when(F.col("gold_n") > 0, (n % 10) / 10.0), "error": F.when(n % 17 == 3, "timeout").otherwise(""),
            "clarified": n % 19 == 4}).withColumn("abstention_accuracy", M.abstention_accuracy(F.col("answerable"), F.col("abstained")))

    return K.once(spark, d, "eval_rows", make)


def diagnosed(spark, d):
    return E.diagnosed(eval_rows(spark, d))


@query("EVL-01 EVL-02", sql("SELECT query_id, gold_n, retrieved, recall_at_k, mrr, ndcg, context_precision, context_recall, coalesce(hit_rate, -1) AS hit_rate FROM rmetrics"))
def ranking_metrics(spark, d):
    return metric_rows(spark, d).withColumn("hit_rate", F.coalesce("hit_rate", F.lit(-1.0)))


def _supported(claim: str, text: str) -> str:
    ids = O.identifiers(claim)
    words = f"list_distinct({O.content_tokens(claim)})"
    return f"""CASE WHEN len({ids}) > 0 THEN len(list_filter({ids}, lambda i: NOT contains(lower({text}), lower(i)))) = 0
      ELSE len({words}) > 0 AND len(list_filter({words}, lambda w: contains(lower({text}), w))) >= greatest(1, ceil(len({words}) / 2.0)) END"""


# Conversations: a user turn is the question, the next assistant turn the answer.
QA = "SELECT id, query AS question, answer || ' SWS_SRC' || (conv_id % 20) || '_0000' || (turn % 10) || ' CanIf' AS answer, query || ' SWS_SRC' || (conv_id % 20) || '_00001' AS evidence, query AS gold FROM qlog WHERE answer IS NOT NULL"


def qa(spark, d):
    src = (F.col("conv_id") % 20).cast("string")
    return K.query_log(spark, d).where("answer is not null").select(
        "id", F.col("query").alias("question"), F.concat("answer", F.lit(" SWS_SRC"), src, F.lit("_0000"), (F.col("turn") % 10).cast("string"), F.lit(" CanIf")).alias("answer"),
        F.concat("query", F.lit(" SWS_SRC"), src, F.lit("_00001")).alias("evidence"), F.col("query").alias("gold"))


@query("EVL-03", O.sql(f"SELECT chunk_id, query_id, {_supported('q.text', 'c.normalized_text')} AS supported FROM bm25_ch JOIN chunks c USING (chunk_id) JOIN qs q USING (query_id)"))
def claim_support(spark, d):
    rows = channels(spark, d)["bm25"].join(K.chunks(spark, d).select("chunk_id", "normalized_text"), "chunk_id").join(K.questions(spark, d), "query_id")
    return rows.select("chunk_id", "query_id", M.claim_supported(F.col("text"), F.col("normalized_text")).alias("supported"))


@query("EVL-06", O.sql(f"""
SELECT id, CASE WHEN len(qt) = 0 THEN 0 ELSE round_even(len(list_intersect(qt, toks_a))::DOUBLE / len(qt), 4) END::DOUBLE AS relevance,
  CASE WHEN ov = 0 OR len(toks_a) = 0 OR len(gt) = 0 THEN 0 ELSE round_even(2::DOUBLE * (ov::DOUBLE / len(toks_a)) * (ov::DOUBLE / len(gt)) / (ov::DOUBLE / len(toks_a) + ov::DOUBLE / len(gt)), 4) END::DOUBLE AS rouge1,
  CASE WHEN len(ids) = 0 THEN 0 ELSE round_even(len(bad)::DOUBLE / len(ids), 4) END::DOUBLE AS hallucinated_rate, array_to_string(bad, '|') AS hallucinated,
  round_even(len(list_filter(gold_ids, lambda g: contains(lower(answer), lower(g))))::DOUBLE / 2, 4) AS id_match
FROM (SELECT *, list_sum(list_transform(list_distinct(toks_a), lambda t: least(len(list_filter(toks_a, lambda x: x = t)), len(list_filter(gt, lambda x: x = t)))))::BIGINT AS ov,
    list_filter(ids, lambda i: NOT contains(lower(evidence), lower(i))) AS bad
  FROM (SELECT id, answer, evidence, ['CanIf', 'SWS_SRC1_00001'] AS gold_ids, list_distinct({O.content_tokens('question')}) AS qt, {O.content_tokens('answer')} AS toks_a, {O.content_tokens('gold')} AS gt, {O.identifiers('answer')} AS ids FROM qa))""", qa=QA))
def answer_metrics(spark, d):
    a, e = F.col("answer"), F.array("evidence")
    return qa(spark, d).select(
        "id", M.answer_relevance(F.col("question"), a).alias("relevance"), M.rouge1_f1(a, F.col("gold")).alias("rouge1"), M.hallucinated_rate(a, e).alias("hallucinated_rate"),
        F.array_join(M.hallucinated_ids(a, e), "|").alias("hallucinated"), M.exact_id_match(F.array(F.lit("CanIf"), F.lit("SWS_SRC1_00001")), a).alias("id_match"))


DRAFTS = "SELECT id AS query_id, '# Direct answer' || chr(10) || replace(answer, '. ', '. [E' || (conv_id % 9 + 1) || '] ') || chr(10) || '## More' || chr(10) || 'Short one. [E' || (turn % 5 + 1) || '] ' || replace(answer, ', ', '! ') AS draft, conv_id FROM qlog WHERE answer IS NOT NULL"


def drafts(spark, d):
    cite = lambda n: F.concat(F.lit(". [E"), n.cast("string"), F.lit("] "))
    return K.query_log(spark, d).where("answer is not null").select(
        F.col("id").alias("query_id"), "conv_id",
        F.concat(F.lit("# Direct answer\n"), F.replace("answer", F.lit(". "), cite(F.col("conv_id") % 9 + 1)), F.lit("\n## More\nShort one"), cite(F.col("turn") % 5 + 1),
                 F.replace("answer", F.lit(", "), F.lit("! "))).alias("draft"))


_BLOCKS = "list_filter(list_transform(string_split(array_to_string(list_filter(list_transform(regexp_split_to_array(draft, '\\r\\n|[\\r\\n]'), lambda s: CASE WHEN starts_with(" + O.strip("s") + ", '#') THEN chr(1) ELSE " + O.strip("s") + " END), lambda s: s <> ''), ' '), chr(1)), lambda b: trim(b)), lambda b: b <> '')"
_PARTS = f"flatten(list_transform({_BLOCKS}, lambda b: string_split(regexp_replace(regexp_replace(b, '([.!?])\\s+(\\[E\\d+\\])', '\\1' || chr(2) || '\\2', 'g'), '([.!?])\\s+', '\\1' || chr(3), 'g'), chr(3))))"
_CLAIMS = f"list_filter(list_transform({_PARTS}, lambda p: {O.strip('replace(p, chr(2), chr(32))')}), lambda s: s <> '' AND NOT starts_with(s, '#') AND (len({O.words('s')}) >= 4 OR regexp_matches(s, '\\[E\\d+\\]')))"
VER_VIEWS = {
    "drafts": DRAFTS,
    "clist": f"SELECT query_id, conv_id, {_CLAIMS} AS cl FROM drafts",
    "claims": "SELECT query_id, conv_id, i - 1 AS claim_no, cl[i] AS claim FROM (SELECT *, unnest(range(1, len(cl) + 1)) AS i FROM clist)",
    "ev": "SELECT d.query_id, f.rank, f.chunk_id, c.release, c.platform, c.text, c.requirement_ids FROM drafts d JOIN final f ON f.query_id = 'q-' || (d.conv_id % (SELECT max(item_id) + 1 FROM benchmark)) JOIN chunks c USING (chunk_id)",
    "vplans": "SELECT d.query_id, p.releases, p.release_mode, p.platforms FROM drafts d JOIN plans p ON p.query_id = 'q-' || (d.conv_id % (SELECT max(item_id) + 1 FROM benchmark))",
    "cites": "SELECT query_id, claim_no, generate_subscripts(ls, 1) AS pos, unnest(ls)::INT AS rank FROM (SELECT query_id, claim_no, regexp_extract_all(claim, '\\[E(\\d+)\\]', 1) AS ls FROM claims)",
    "verd": """
SELECT c.query_id, c.claim_no, c.claim, e.ids IS NOT NULL AS supported, CASE WHEN e.ids IS NOT NULL AND coalesce(vc, true) AND coalesce(pc, true) THEN 0.9 WHEN e.ids IS NOT NULL THEN 0.4 ELSE 0.0 END::DOUBLE AS support_score,
  coalesce(e.ids, []) AS evidence_ids, coalesce(vc, true) AS version_consistent, coalesce(pc, true) AS platform_consistent
FROM claims c LEFT JOIN (SELECT query_id, claim_no, list(chunk_id ORDER BY pos) AS ids, bool_and(CASE WHEN len(releases) > 0 AND release_mode = 'exact' THEN list_contains(releases, release) ELSE true END) AS vc,
    bool_and(CASE WHEN len(platforms) > 0 THEN list_contains(platforms, platform) ELSE true END) AS pc FROM cites JOIN ev USING (query_id, rank) JOIN vplans USING (query_id) GROUP BY ALL) e
  ON e.query_id = c.query_id AND e.claim_no = c.claim_no""",
    "supp": """
SELECT d.query_id, coalesce(claims, 0) AS claims, coalesce(claim_support_rate, 0) AS claim_support_rate, coalesce(citation_coverage, 0) AS citation_coverage, coalesce(version_ok, false) AS version_ok, coalesce(evidence_cited, 0) AS evidence_cited
FROM drafts d LEFT JOIN (SELECT query_id, count(*) AS claims, round(count_if(supported)::DOUBLE / count(*), 4) AS claim_support_rate, round(count_if(len(evidence_ids) > 0)::DOUBLE / count(*), 4) AS citation_coverage,
  bool_and(CASE WHEN len(evidence_ids) > 0 THEN version_consistent END) AS version_ok, len(list_distinct(flatten(list(evidence_ids)))) AS evidence_cited FROM verd GROUP BY 1) s ON s.query_id = d.query_id""",
}


def _questions(spark, d):
    return K.table(spark, d, "benchmark").agg((F.max("item_id") + 1).alias("n")).scalar()


def draft_evidence(spark, d):
    ask = drafts(spark, d).select(F.col("query_id").alias("draft_id"), F.concat(F.lit("q-"), (F.col("conv_id") % _questions(spark, d)).cast("string")).alias("query_id"))
    rows = final(spark, d).select("query_id", "rank", "chunk_id").join(ask, "query_id").join(
        K.chunks(spark, d).select("chunk_id", "release", "platform", "text", "requirement_ids"), "chunk_id")
    return rows.drop("query_id").withColumnRenamed("draft_id", "query_id")


def draft_plans(spark, d):
    ask = drafts(spark, d).select(F.col("query_id").alias("draft_id"), F.concat(F.lit("q-"), (F.col("conv_id") % _questions(spark, d)).cast("string")).alias("query_id"))
    return K.plans(spark, d).join(ask, "query_id").drop("query_id").withColumnRenamed("draft_id", "query_id")


def claim_rows(spark, d):
    return VE.claim_rows(drafts(spark, d))


def verdict_rows(spark, d):
    return VE.verdicts(claim_rows(spark, d), draft_evidence(spark, d), draft_plans(spark, d))


@query("VER-01", sql("SELECT query_id, claim_no, claim FROM claims", **VER_VIEWS))
def claim_splitting(spark, d):
    return claim_rows(spark, d)


@query("VER-02", sql("SELECT * EXCLUDE (evidence_ids), array_to_string(evidence_ids, '|') AS evidence_ids, CASE WHEN support_score >= 0.8 THEN 'low' WHEN support_score >= 0.4 THEN 'medium' ELSE 'high' END AS risk FROM verd", **VER_VIEWS))
def claim_verdicts(spark, d):
    return verdict_rows(spark, d).withColumn("evidence_ids", F.array_join("evidence_ids", "|"))


@query("VER-03", sql("SELECT * FROM supp", **VER_VIEWS))
def claim_support_rates(spark, d):
    return VE.support(verdict_rows(spark, d), drafts(spark, d))


@query("VER-04", sql("""
SELECT *, n = 0 OR (level = 'Low' AND claim_support_rate < 0.4) AS should_abstain FROM (
  SELECT query_id, claim_support_rate, n, round(conf, 4) AS confidence, CASE WHEN citation_coverage >= 0.5 AND conf >= 0.7 AND version_ok THEN 'High' WHEN conf >= 0.45 THEN 'Medium' ELSE 'Low' END AS level
  FROM (SELECT *, 0.25::DOUBLE * rs + 0.2::DOUBLE * version_ok::INT + 0.2::DOUBLE * least(1.0::DOUBLE, n / 8.0::DOUBLE) + 0.15::DOUBLE * citation_coverage + 0.2::DOUBLE * claim_support_rate AS conf
    FROM (SELECT s.*, (abs(hash_n) % 100) / 100.0::DOUBLE AS rs, hash_n % 13 AS n FROM (SELECT *, claims * 7 + evidence_cited AS hash_n FROM supp) s)))""", **VER_VIEWS))
def answer_confidence(spark, d):
    n = F.col("claims") * 7 + F.col("evidence_cited")
    s = VE.support(verdict_rows(spark, d), drafts(spark, d)).withColumns({"retrieval_score": (n % 100) / 100.0, "evidence_total": n % 13})
    return VE.confidence(s).select("query_id", "claim_support_rate", F.col("evidence_total").alias("n"), "confidence", "level", "should_abstain")


@query("EVL-04 EVL-05", sql(f"""
SELECT d.query_id, coalesce(cp, -1) AS citation_precision, coalesce(pairs, 0) AS pairs, coalesce(faith, -1) AS faithfulness FROM drafts d
LEFT JOIN (SELECT query_id, round(avg({_supported('claim', 'text')}::INT), 4) AS cp, count(*) AS pairs FROM (SELECT DISTINCT query_id, claim_no, rank FROM cites) JOIN ev USING (query_id, rank) JOIN claims USING (query_id, claim_no) GROUP BY 1) p ON p.query_id = d.query_id
LEFT JOIN (SELECT c.query_id, round_even(count_if(CASE WHEN len({O.identifiers('claim')}) > 0 THEN len(list_filter(texts, lambda t: len(list_filter({O.identifiers('claim')}, lambda i: NOT contains(lower(t), lower(i)))) = 0)) > 0
    ELSE len(w) > 0 AND len(list_filter(w, lambda x: contains(lower(array_to_string(texts, chr(10))), x))) >= greatest(1, ceil(len(w) / 2.0)) END)::DOUBLE / count(*), 4) AS faith
  FROM (SELECT *, list_distinct({O.content_tokens('claim')}) AS w FROM claims) c LEFT JOIN (SELECT query_id, list(text) AS texts FROM ev GROUP BY 1) e ON e.query_id = c.query_id GROUP BY 1) f ON f.query_id = d.query_id""", **VER_VIEWS))
def citation_and_faithfulness(spark, d):
    ev, cl = draft_evidence(spark, d), claim_rows(spark, d)
    p = E.citation_precision(E.citation_pairs(cl, ev))
    t = ev.groupBy("query_id").agg(F.collect_list("text").alias("texts"))
    c = cl.groupBy("query_id").agg(F.collect_list("claim").alias("cs")).join(t, "query_id", "left")
    f = c.select("query_id", M.faithfulness(F.col("cs"), F.coalesce("texts", none())).alias("faithfulness"))
    return drafts(spark, d).select("query_id").join(p, "query_id", "left").join(f, "query_id", "left").select(
        "query_id", F.coalesce("citation_precision", F.lit(-1.0)).alias("citation_precision"), F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("faithfulness", F.lit(-1.0)).alias("faithfulness"))


@query("EVL-07", sql("SELECT query_id, abstention_accuracy FROM erows"))
def abstention_accuracy(spark, d):
    return eval_rows(spark, d).select("query_id", "abstention_accuracy")


@query("EVL-08 EVL-07")
def evaluation_rows(spark, d):
    """Item rows over drafts: every metric of a question with an answer, its evidence and its claims."""
    dr = drafts(spark, d)
    items = dr.select("query_id", F.col("draft").alias("question"), F.lit("definition").alias("category"), F.lit("easy").alias("difficulty"), F.lit(True).alias("answerable"),
                      F.col("draft").alias("gold_answer"), F.array(F.lit("SWS_SRC1_00001")).alias("gold_requirement_ids"))
    res = dr.select("query_id", F.col("draft").alias("answer"), F.lit(False).alias("abstained"), F.lit(1.0).alias("latency_s"))
    ev = draft_evidence(spark, d)
    gold = ev.where("rank <= 2").select("query_id", F.col("chunk_id").alias("id"))
    return E.item_rows(items, res, ev.select("query_id", "rank", "chunk_id", "text", "requirement_ids"), claim_rows(spark, d), gold)


@query("EVL-09", sql("SELECT query_id, failure FROM drows"))
def failure_diagnosis(spark, d):
    return diagnosed(spark, d).select("query_id", "failure")


_NUM = ("n", "answerable", "abstention_rate", "latency_p50", "latency_p95", "mrr", "ndcg", "context_recall", "context_recall_low", "context_recall_high", "context_precision",
        "context_precision_low", "context_precision_high", "abstention_accuracy", "abstention_accuracy_low", "abstention_accuracy_high", "hit_rate", "hit_rate_low", "hit_rate_high")


def _agg_sql() -> str:
    def ci(m):
        s = f"coalesce(1.96::DOUBLE * sqrt(var_samp({m}) / count({m})), 0)"
        return f"round(avg({m}), 4) AS {m}, round(greatest(0, avg({m}) - {s}), 4) AS {m}_low, round(least(1, avg({m}) + {s}), 4) AS {m}_high"

    def wil(m):
        n, s = f"count({m})", f"count_if({m} >= 0.999)"
        p = f"({s}::DOUBLE / {n})"
        den = f"(1 + 3.8416::DOUBLE / {n})"
        mid = f"(({p} + 3.8416::DOUBLE / (2 * {n})) / {den})"
        mar = f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + 3.8416::DOUBLE / (4 * {n} * {n})) / {den})"
        return f"round(avg({m}), 4) AS {m}, CASE WHEN {n} > 0 THEN round(greatest(0, {mid} - {mar}), 4) ELSE 0 END AS {m}_low, CASE WHEN {n} > 0 THEN round(least(1, {mid} + {mar}), 4) ELSE 0 END AS {m}_high"

    return f"""SELECT CASE WHEN grouping(category) + grouping(difficulty) = 2 THEN 'overall' WHEN grouping(difficulty) = 1 THEN 'category:' || category ELSE 'difficulty:' || difficulty END AS slice,
  count(*) AS n, count_if(answerable) AS answerable, round(count_if(abstained)::DOUBLE / count(*), 4) AS abstention_rate, quantile_disc(latency_s, 0.5) AS latency_p50, quantile_disc(latency_s, 0.95) AS latency_p95,
  round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, {ci('context_recall')}, {ci('context_precision')}, {wil('abstention_accuracy')}, {wil('hit_rate')}
FROM erows GROUP BY GROUPING SETS ((), (category), (difficulty))"""


@query("EVL-10 EVL-11", sql(_agg_sql()))
def evaluation_aggregates(spark, d):
    return E.aggregates(eval_rows(spark, d)).select("slice", *_NUM)


@query("EVL-10 COD-04", sql("SELECT failure, count(*) AS n FROM drows GROUP BY 1"))
def failure_histogram(spark, d):
    return E.failure_histogram(diagnosed(spark, d))


@query("EVL-17", sql(f"SELECT query_id, failure, penalty FROM (SELECT *, {O.case('failure', {k: str(v) for k, v in V.FAILURE_PENALTY.items()}, '0')}::INT AS penalty FROM drows) ORDER BY penalty DESC, context_recall, latency_s DESC, query_id LIMIT 20"))
def worst_items(spark, d):
    return E.worst(diagnosed(spark, d)).select("query_id", "failure", "penalty")


def golden(spark, d):
    """documents as golden items, with some faults for validation."""
    n = F.col("doc_id")
    cats = F.array(*[F.lit(c) for c in (*V.CATEGORIES, "nonsense")])
    return K.table(spark, d, "documents").select(
        F.concat(F.lit("g-"), F.when(n % 37 == 5, n - 1).otherwise(n).cast("string")).alias("query_id"), F.when(n % 41 == 3, " ").otherwise(F.substring("text", 1, 80)).alias("question"),
        F.element_at(cats, (n % 16 + 1).cast("int")).alias("category"), F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard"), F.lit("brutal")), (n % 4 + 1).cast("int")).alias("difficulty"),
        (n % 3 != 0).alias("answerable"), F.when(n % 29 != 2, F.col("source")).otherwise("").alias("gold_answer"), F.when(n % 5 != 0, F.array("source")).otherwise(none()).alias("gold_evidence_ids"),
        F.when(n % 4 == 0, F.array(F.lit("multi_hop"), F.lit("multi_hop"))).when(n % 9 == 0, F.array(F.lit("unanswerable"))).otherwise(none()).alias("tags"))


GOLDEN = f"""
SELECT 'g-' || CASE WHEN doc_id % 37 = 5 THEN doc_id - 1 ELSE doc_id END AS query_id, CASE WHEN doc_id % 41 = 3 THEN ' ' ELSE substr(text, 1, 80) END AS question,
  {O.case('(doc_id % 16)::VARCHAR', dict(enumerate((*V.CATEGORIES, 'nonsense'))))} AS category, {O.case('(doc_id % 4)::VARCHAR', dict(enumerate(('easy', 'medium', 'hard', 'brutal'))))} AS difficulty,
  doc_id % 3 <> 0 AS answerable, CASE WHEN doc_id % 29 <> 2 THEN source ELSE '' END AS gold_answer, CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END AS n_gold,
  CASE WHEN doc_id % 4 = 0 THEN ['multi_hop', 'multi_hop'] WHEN doc_id % 9 = 0 THEN ['unanswerable'] ELSE []::VARCHAR[] END AS tags FROM documents"""


@query("EVL-12", O.sql("SELECT query_id, CASE WHEN ('0x' || substr(sha256(query_id || '|holdout-2026'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE < 0.2 THEN 'holdout' ELSE 'train' END AS split FROM golden", golden=GOLDEN))
def frozen_split(spark, d):
    return E.freeze_split(golden(spark, d))


@query("EVL-13", O.sql("SELECT query_id, category, difficulty, gold_answer FROM golden WHERE ('0x' || substr(sha256(query_id || '|holdout-2026'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE < 0.2", golden=GOLDEN))
def split_drift(spark, d):
    g = golden(spark, d)
    return E.scored_split(g, E.freeze_split(g), E.golden_fingerprint(g.repartition(3)), "holdout").select("query_id", "category", "difficulty", "gold_answer")


@query("EVL-14", O.sql(f"""
SELECT query_id, unnest(list_filter([CASE WHEN trim(question) = '' THEN 'empty question' END, CASE WHEN category NOT IN ({', '.join(O.lit(c) for c in V.CATEGORIES)}) THEN 'unknown category ''' || category || '''' END,
  CASE WHEN difficulty NOT IN ('easy', 'medium', 'hard') THEN 'unknown difficulty ''' || difficulty || '''' END, CASE WHEN answerable AND n_gold = 0 THEN 'answerable item without gold_evidence_ids' END,
  CASE WHEN answerable AND trim(gold_answer) = '' THEN 'answerable item without gold_answer' END, CASE WHEN NOT answerable AND n_gold > 0 THEN 'unanswerable item must not carry gold_evidence_ids' END], lambda p: p IS NOT NULL)) AS problem FROM golden
UNION ALL SELECT query_id, 'duplicate query_id' FROM golden GROUP BY query_id HAVING count(*) > 1""", golden=GOLDEN))
def golden_validation(spark, d):
    return E.validation(golden(spark, d))


@query("EVL-15", O.sql(f"""
SELECT t.slice, target::DOUBLE AS target, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE / total, 4) AS actual, greatest(ceil(round(target * total, 6)) - coalesce(n, 0), 0)::BIGINT AS shortfall, coalesce(n, 0)::DOUBLE / total >= target AS met
FROM targets t LEFT JOIN (SELECT slice, count(*) AS n FROM (SELECT unnest(list_distinct(list_concat([category], tags))) AS slice FROM golden) GROUP BY 1) c ON c.slice = t.slice, (SELECT count(*) AS total FROM golden)""",
    golden=GOLDEN, targets=O.values("t", "slice, target", [(k, f"{v}::DOUBLE") for k, v in V.COVERAGE_TARGETS.items()]).replace("'0.3::DOUBLE'", "0.3::DOUBLE").replace("'0.15::DOUBLE'", "0.15::DOUBLE").replace("'0.03::DOUBLE'", "0.03::DOUBLE")))
def golden_coverage(spark, d):
    return E.coverage(golden(spark, d))


@query("EVL-16", O.sql("""
SELECT query_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h, query_id, question) AS rn, (SELECT count(DISTINCT category) FROM g) AS c FROM g)
ORDER BY (rn > greatest(1, floor(40 / c)))::INT, h, query_id, question LIMIT 40""", golden=GOLDEN, g="SELECT *, sha256(query_id || '|20261021') AS h FROM golden WHERE query_id = 'g-' || substr(query_id, 3)"))
def stratified_sample(spark, d):
    return E.stratified_sample(golden(spark, d)).select("query_id", "category")


_GATE = (("context_recall", "min", 0.3, 0.03), ("hit_rate", "min", 0.99, 0.005), ("latency_p95", "max", 30.0, 5.0), ("faithfulness", "min", 0.5, 0.05))


@query("EVL-18", sql("""
SELECT r.metric, coalesce(m.v, -1) AS measured, CASE WHEN m.v IS NULL THEN 'skipped' WHEN direction = 'min' AND m.v >= threshold - tol THEN 'pass' WHEN direction = 'max' AND m.v <= threshold + tol THEN 'pass' ELSE 'fail' END AS status
FROM rules r LEFT JOIN (SELECT 'context_recall' AS metric, round(avg(context_recall), 4) AS v FROM erows UNION ALL SELECT 'hit_rate', round(avg(hit_rate), 4) FROM erows UNION ALL SELECT 'latency_p95', quantile_disc(latency_s, 0.95) FROM erows) m ON m.metric = r.metric""",
    rules=O.values("r", "metric, direction, threshold, tol", _GATE)))
def regression_gate(spark, d):
    a = E.aggregates(eval_rows(spark, d)).where("slice = 'overall'")
    measured = a.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("measured")) for m in ("context_recall", "hit_rate", "latency_p95")])).alias("x")).select("x.*")
    rules = spark.createDataFrame(list(_GATE), "metric string, direction string, threshold double, tolerance double")
    return E.gate(measured, rules).select("metric", F.coalesce("measured", F.lit(-1.0)).alias("measured"), "status")


@query("EVL-23", sql("""
SELECT count(*) AS n, round(count_if(hit_rate > 0)::DOUBLE / greatest(1, count(hit_rate)), 4) AS hit_rate, round(avg(abstained::INT), 4) AS abstention_rate, round(avg((context_precision > 0 OR abstained)::INT), 4) AS version_precision,
  round(avg((mrr > 0.5)::INT), 4) AS module_precision, quantile_disc(latency_s, 0.5) AS p50_latency_s FROM erows"""))
def benchmark_summary(spark, d):
    r = eval_rows(spark, d).select(
        F.when(F.col("hit_rate").isNotNull(), F.col("hit_rate") > 0).alias("hit"), "abstained", ((F.col("context_precision") > 0) | F.col("abstained")).alias("version_ok"), (F.col("mrr") > 0.5).alias("module_ok"), "latency_s")
    return E.benchmark_summary(r)


@query("EVL-25", sql("""
SELECT 'bm25' AS backend, round(avg(hit), 4) AS hit FROM (SELECT query_id, max((g.document_id IS NOT NULL)::INT) AS hit FROM bm25_ch JOIN chunks USING (chunk_id) LEFT JOIN golds g USING (query_id, document_id) WHERE rank <= 10 GROUP BY 1)
UNION ALL SELECT 'tfidf', round(avg(hit), 4) FROM (SELECT query_id, max((g.document_id IS NOT NULL)::INT) AS hit FROM cos_ch JOIN chunks USING (chunk_id) LEFT JOIN golds g USING (query_id, document_id) WHERE rank <= 10 GROUP BY 1)"""))
def backend_comparison(spark, d):
    docs = K.chunks(spark, d).select("chunk_id", "document_id")
    gold = K.gold(spark, d).withColumn("g", F.lit(1))

    def hit(rows):
        top = rows.where("rank <= 10").join(docs, "chunk_id").join(gold, ["query_id", "document_id"], "left")
        return top.groupBy("query_id").agg(F.max(F.coalesce("g", F.lit(0))).alias("h")).agg(F.round(F.avg("h"), 4).alias("hit"))

    ch = channels(spark, d)
    return E.compare_backends({"bm25": hit(ch["bm25"]), "tfidf": hit(ch["dense"])}).select("backend", "hit")


def golden_chunks(spark, d):
    """Chunks with the document's language as section title, so that every family has a pool."""
    return K.chunks(spark, d).withColumn("section_title", F.concat(F.lit("Part "), "module"))


@query("EVL-19", sql("""
SELECT chunk_id, family, array_to_string(gold, '|') AS gold FROM (
  SELECT c.chunk_id, 'requirement_lookup' AS family, (SELECT list(x.chunk_id ORDER BY x.chunk_id)[1:4] FROM chunks x WHERE list_contains(x.requirement_ids, c.requirement_ids[1])) AS gold
  FROM (SELECT * FROM chunks WHERE chunk_kind = 'atomic' AND len(requirement_ids) > 0 ORDER BY sha256(chunk_id || '|20261021'), chunk_id LIMIT 40) c
  UNION ALL SELECT chunk_id, 'configuration', [chunk_id] FROM (SELECT * FROM chunks WHERE chunk_kind = 'atomic' AND len(ecu_parameters) > 0 ORDER BY sha256(chunk_id || '|20261021'), chunk_id LIMIT 30))"""))
def golden_single_chunk(spark, d):
    c = golden_chunks(spark, d)
    picked = lambda f, q: GO.single_chunk_items(c, f, q).select("query_id", F.lit(f).alias("family"), F.array_join("gold_evidence_ids", "|").alias("gold"))
    every = picked("requirement_lookup", 40).unionByName(picked("configuration", 30))
    names = c.where("chunk_kind = 'atomic'").select("chunk_id", T.sha12(F.col("chunk_id")).alias("h"))
    return every.withColumn("h", F.substring_index("query_id", "-", -1)).join(names, "h").select("chunk_id", "family", "gold")


@query("EVL-20", O.sql("""
SELECT evidence_id, array_to_string(list(chunk_id ORDER BY chunk_id)[1:3], '|') AS gold FROM (SELECT * FROM side ORDER BY sha256(evidence_id || '|20261021'), evidence_id LIMIT 60) s JOIN atomics a USING (document_id, page_index) GROUP BY evidence_id""",
    side="SELECT 'tbl-' || document_id || '-' || page_index || '-0' AS evidence_id, document_id, page_index FROM raw_pages WHERE page_index % 4 = 1"))
def golden_sidecar(spark, d):
    p = K.pages(spark, d).where("page_index % 4 = 1").select(
        F.concat_ws("-", F.lit("tbl"), "document_id", F.col("page_index").cast("string"), F.lit("0")).alias("evidence_id"), "document_id", "page_index", F.concat(F.lit("Table "), "module").alias("caption"))
    items = GO.sidecar_items(p, K.chunks(spark, d), "table_lookup", 60).select(F.substring_index("query_id", "-", -1).alias("h"), F.array_join("gold_evidence_ids", "|").alias("gold"))
    return items.join(p.select("evidence_id", T.sha12(F.col("evidence_id")).alias("h")), "h").select("evidence_id", "gold")


@query("EVL-21", O.sql("""
SELECT chunk_id, coalesce(arg_min(api, h) FILTER (WHERE near), arg_min(api, h)) AS api_chunk_id FROM (
  SELECT r.chunk_id, a.chunk_id AS api, sha256(a.chunk_id || '|20261021') || a.chunk_id AS h, abs(a.page_index - r.page_index) <= 3 AS near
  FROM marks r JOIN marks a ON a.document_id = r.document_id AND a.chunk_id <> r.chunk_id WHERE r.rq AND a.ap) GROUP BY chunk_id""",
    marks="SELECT chunk_id, document_id, page_index, page_index % 2 = 0 AS rq, page_index % 7 = 0 OR page_index % 11 = 5 AS ap FROM atomics"))
def golden_multi_hop(spark, d):
    n = F.col("page_index")
    c = K.chunks(spark, d).where("chunk_kind = 'atomic'").withColumns({
        "requirement_ids": F.when(n % 2 == 0, F.array(F.lit("SWS_X_1"))).otherwise(none()), "api_names": F.when((n % 7 == 0) | (n % 11 == 5), F.array(F.lit("Com_Init"))).otherwise(none())})
    return GO.multi_hop_pairs(c).select("chunk_id", "api_chunk_id")


@query("EVL-22", O.sql("""
SELECT term AS key, 'release_comparison' AS category FROM (SELECT lower(unnest(api_names)) AS term FROM chunks WHERE release = '4.2.2' INTERSECT SELECT lower(unnest(api_names)) FROM chunks WHERE release = '4.4.0') WHERE NOT regexp_matches(upper(term), '^(SWS|SRS|PRS|TPS|RS|EXP|CONSTR|QM)_')
QUALIFY row_number() OVER (ORDER BY sha256(term || '|20261021'), term) <= 15
UNION ALL SELECT key, 'absent' FROM (SELECT DISTINCT 'src' || p_size AS key FROM part) WHERE key NOT IN (SELECT module FROM chunks)"""))
def golden_probes(spark, d):
    c = K.chunks(spark, d)
    shared = GO.shared_terms(c, "4.2.2", "4.4.0", 15).select(F.col("term").alias("key"), F.lit("release_comparison").alias("category"))
    cand = K.table(spark, d, "part").select(F.concat(F.lit("src"), F.col("p_size").cast("string")).alias("key")).distinct()
    return shared.unionByName(GO.absent_modules(cand, c).select("key", F.lit("absent").alias("category")))


@query("EVL-19 EVL-20 EVL-21 EVL-22")
def golden_set(spark, d):
    """A whole generated golden set, topped up to its targets."""
    c = golden_chunks(spark, d)
    p = K.pages(spark, d).select("document_id", "page_index", "module")
    side = lambda k, r: p.where(F.col("page_index") % 4 == r).select(F.concat_ws("-", F.lit(k), "document_id", F.col("page_index").cast("string"), F.lit("0")).alias("evidence_id"), "document_id", "page_index", F.concat(F.lit(f"{k} "), "module").alias("caption"))
    cand = K.table(spark, d, "part").select(F.concat(F.lit("src"), F.col("p_size").cast("string")).alias("key")).distinct()
    quotas = {"requirement_lookup": 60, "api_lookup": 40, "configuration": 30, "definition": 30, "runtime_behaviour": 20, "table_lookup": 15, "diagram_lookup": 15, "multi_hop": 60,
              "release_comparison": 12, "unanswerable": 30, "code_explanation": 10, "test_analysis": 10, "traceability": 10, "impact_analysis": 10}
    items = GO.top_up(GO.generate(c, side("tbl", 1), side("fig", 2), cand, quotas), c, cand)
    return items.select("query_id", "question", "category", "answerable", "gold_answer", F.array_join("gold_evidence_ids", "|").alias("gold_evidence_ids"), F.array_join("tags", "|").alias("tags"))


# --- question understanding -------------------------------------------------------------------

_ASK = {
    "0": "What is the CanIf module in Classic 4.4.0? ", "1": "Compare Com in 4.2.2 and 4.4.0: ", "2": "Why does Dem_SetEventStatus fail with E_NOT_OK? ",
    "3": "How is CanIfCtrlConfig configured for ethernet switch in R22-11? ", "4": "Explain SWS_CanIf_00072 and [PRS_SOMEIP_00042] ", "5": "Which module does PduR interact with? ",
    "6": "Describe the receive path of the diagnostic event memory ASIL-D ", "7": "What does CanIf_Transmit return? ", "8": "Define the ECUC parameter CanIfTxPduCfg in SWS ", "9": "",
}
ASKED = f"SELECT 'q-' || item_id AS query_id, {O.case('(item_id % 10)::VARCHAR', _ASK)} || text AS text FROM benchmark"


def asked(spark, d):
    n = F.col("item_id")
    return K.table(spark, d, "benchmark").select(
        F.concat(F.lit("q-"), n.cast("string")).alias("query_id"), F.concat(F.element_at(T.string_map(_ASK), (n % 10).cast("string")), "text").alias("text"))


def _any(words) -> str:
    import re

    alts = "|".join(re.escape(w.lower()) for w in words)
    return f"regexp_matches(low, {O.lit(f'(?:^|[^a-z0-9])(?:{alts})(?:[^a-z0-9]|$)')})"


def _present(table: dict) -> str:
    return ordered("list_filter([" + ", ".join(f"CASE WHEN {_any([k])} THEN {O.lit(v)} END" for k, v in table.items()) + "], lambda x: x IS NOT NULL)")


def ordered(x: str) -> str:
    return O.ordered_distinct(x) if len(x) < 200 else f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_groups = "flatten([" + ", ".join(f"CASE WHEN {_any([w])} THEN [{', '.join(O.lit(m) for m in ms)}] ELSE []::VARCHAR[] END" for w, ms in V.MODULE_GROUPS.items()) + "])"
PLAN_VIEWS = {
    "asked": ASKED,
    "p0": f"""
SELECT *, list_concat(regexp_extract_all(t, {O.lit(V.REL_CLASSIC)}), regexp_extract_all(t, {O.lit(V.REL_ADAPTIVE)})) AS rels, {O.distinct_sorted(O.found('t', V.Q_API, 1))} AS api_names,
  {O.distinct_sorted(f"list_transform({O.found('t', V.Q_REQ, 1)}, lambda r: trim(r, '[]'))")} AS requirement_ids,
  {O.distinct_sorted("list_concat(list_concat(" + O.found('t', V.PARAM_PHRASES[0], 1) + ", " + O.found('t', V.PARAM_PHRASES[1], 1) + "), " + O.found('t', V.PARAM_PHRASES[2], 1) + ")")} AS params,
  list_filter([{", ".join(f"CASE WHEN {_any([k])} THEN {O.lit(v)} END" for k, v in V.MODULE_ALIASES.items())}], lambda x: x IS NOT NULL) AS named, {_groups} AS grouped,
  list_filter([{", ".join(f"CASE WHEN {_any([k])} THEN {O.lit(v)} END" for k, v in V.PLATFORM_WORDS.items())}], lambda x: x IS NOT NULL) AS platforms,
  list_filter([{", ".join(f"CASE WHEN {_any([k.lower()])} THEN {O.lit(k)} END" for k in V.DOC_TYPES)}], lambda x: x IS NOT NULL) AS document_types,
  list_transform(regexp_extract_all(t, {O.lit(V.ASIL)}, 1), lambda x: upper(x)) AS asils
FROM (SELECT query_id, trim(text) AS t, lower(trim(text)) AS low FROM asked)""",
    "p1": f"""
SELECT *, list_concat(list_concat(named, grouped), list_filter(list_transform(api_names, lambda a: {O.case("lower(split_part(a, '_', 1))", V.MODULE_ALIASES, "''")}), lambda m: m <> '')) AS mods,
  CASE WHEN len(rels) >= 2 OR ({_any(V.COMPARE_WORDS)} AND len(rels) > 0) THEN 'comparison' WHEN len(rels) = 1 THEN 'exact' ELSE 'none' END AS release_mode FROM p0""",
    "qplans": f"""
SELECT query_id, t AS text, list_sort(list_distinct(rels)) AS releases, release_mode, platforms, list_filter(mods, lambda v, i: list_position(mods, v) = i) AS modules, api_names, requirement_ids, params AS configuration_parameters,
  document_types, list_filter(['D', 'C', 'B', 'A', 'QM'], lambda l: list_contains(asils, l)) AS asil_levels,
  CASE WHEN release_mode = 'comparison' THEN 'comparison' WHEN {_any(V.TROUBLE_WORDS)} THEN 'troubleshooting' WHEN {_any(V.CONFIG_WORDS)} THEN 'configuration' WHEN len(requirement_ids) > 0 THEN 'requirement_lookup'
    WHEN len(api_names) > 0 OR {_any(V.API_WORDS)} THEN 'api_lookup' WHEN {_any(['initialization sequence'])} THEN 'deep_explanation' WHEN {_any(V.DEPENDENCY_WORDS)} THEN 'dependency'
    WHEN {_any(V.EXPLAIN_WORDS)} THEN 'deep_explanation' WHEN {' OR '.join(f'starts_with(low, {O.lit(p)})' for p in V.DEFINITION_PREFIXES)} THEN 'definition' ELSE 'unknown' END AS intent, low FROM p1""",
}
_LISTS = ("releases", "platforms", "modules", "api_names", "requirement_ids", "configuration_parameters", "document_types", "asil_levels")


@query("QRY-04 QRY-05 QRY-06 QRY-07", sql(f"""
SELECT query_id, release_mode, intent, {', '.join(f"array_to_string({c}, '|') AS {c}" for c in _LISTS)}, intent IN ('dependency', 'deep_explanation') AS needs_graph,
  CASE WHEN len(modules) + len(api_names) + len(requirement_ids) > 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM qplans""", **PLAN_VIEWS))
def question_plans(spark, d):
    p = QU.parsed(asked(spark, d))
    return p.select("query_id", "release_mode", "intent", *[F.array_join(c, "|").alias(c) for c in _LISTS], "needs_graph", "confidence")


_EXPAND = "CASE m " + " ".join(f"WHEN {O.lit(m)} THEN [{', '.join(O.lit(x) for x in (m, *ps))}]" for m, ps in V.MODULE_EXPANSIONS.items()) + " ELSE [m] END"


@query("QRY-08", sql(f"""
SELECT query_id, array_to_string(list_filter(lx, lambda v, i: list_position(lx, v) = i), '|') AS lexical, array_to_string(CASE WHEN release_mode = 'comparison' AND len(releases) >= 2 THEN list_transform(releases, lambda r: text || ' ' || r)
  WHEN release_mode = 'comparison' THEN [text] ELSE []::VARCHAR[] END, '|') AS comparison
FROM (SELECT *, list_concat(list_concat(list_concat([text], flatten(list_transform(modules, lambda m: {_EXPAND}))), api_names), requirement_ids) AS lx FROM qplans)""", **PLAN_VIEWS))
def question_rewrites(spark, d):
    r = QU.rewrites(QU.parsed(asked(spark, d)).withColumn("text", F.trim("text")))
    return r.select("query_id", F.array_join("lexical_queries", "|").alias("lexical"), F.array_join("comparison_queries", "|").alias("comparison"))


@query("QRY-09", sql(f"""
SELECT query_id, array_to_string(list_filter(ms, lambda v, i: list_position(ms, v) = i), '|') AS modalities, release_mode = 'comparison' AS comparison_mode, CASE WHEN release_mode = 'comparison' THEN array_to_string(releases, '|') ELSE '' END AS release_branches
FROM (SELECT *, list_concat(list_concat(CASE intent {' '.join(f"WHEN {O.lit(i)} THEN [{', '.join(O.lit(m) for m in ms)}]" for i, ms in V.INTENT_MODALITIES.items())} END,
  CASE WHEN {_any(V.DIAGRAM_WORDS)} THEN ['diagram', 'graph'] ELSE []::VARCHAR[] END), CASE WHEN {_any(V.TABLE_WORDS)} THEN ['table'] ELSE []::VARCHAR[] END) AS ms FROM qplans)""", **PLAN_VIEWS))
def modality_plans(spark, d):
    m = QU.modality_plan(QU.parsed(asked(spark, d)))
    return m.select("query_id", F.array_join("modalities", "|").alias("modalities"), "comparison_mode", F.array_join("release_branches", "|").alias("release_branches"))


_REPLY = {"0": "4.4.0 please ", "1": "Adaptive R22-11 ", "2": "any release is fine ", "3": "the Com module in 4.2.2 "}


@query("QRY-10", """
WITH r AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '4.4.0' WHEN 1 THEN 'R22-11' WHEN 3 THEN '4.2.2' END AS rel, (conv_id + turn) % 4 = 1 AS ad, (conv_id + turn) % 4 = 3 AS com, (conv_id + turn) % 4 = 2 AS clr FROM conversations WHERE role = 'user'),
c AS (SELECT *, coalesce(max(CASE WHEN clr THEN turn END) OVER (PARTITION BY conv_id), -1) AS cut FROM r)
SELECT conv_id, array_to_string(rs, '|') AS releases, ad AS adaptive, com, CASE len(rs) WHEN 0 THEN 'none' WHEN 1 THEN 'exact' ELSE 'comparison' END AS release_mode
FROM (SELECT conv_id, list_sort(list_distinct(coalesce(list(rel) FILTER (WHERE rel IS NOT NULL AND turn > cut), []))) AS rs, bool_or(ad) AS ad, bool_or(com) AS com FROM c GROUP BY conv_id)""")
def merged_slots(spark, d):
    c = K.table(spark, d, "conversations").where("role = 'user'")
    k = ((F.col("conv_id") + F.col("turn")) % 4).cast("string")
    s = QU.merged_slots(c.select("conv_id", "turn", F.element_at(T.string_map(_REPLY), k).alias("text")))
    return s.select("conv_id", F.array_join("releases", "|").alias("releases"), F.array_contains("platforms", "Adaptive").alias("adaptive"), F.array_contains("modules", "Com").alias("com"), "release_mode")


@query("QRY-01 QRY-02 QRY-03")
def corrected_questions(spark, d):
    """Questions with misspellings spliced in, corrected."""
    q = K.questions(spark, d).withColumn("text", F.concat(F.lit("Wich requirment explane the can interface comunication in CanIf_Init "), "text"))
    return QU.corrected(q).select("query_id", "corrected")
