"""Queries: question-log mining and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscle.functions import vocab as V
from corpuscle.operators import mining as M
from corpuscle.operators import questions as QU
from corpuscle.plans import corpus as K
from corpuscle.plans import oracle as O
from corpuscle.plans.registry import query

_TOKS = f"""
SELECT id, CASE WHEN len(c) > 0 THEN c ELSE list_distinct(list_transform(regexp_extract_all(query, {O.lit(V.WORD)}), lambda w: lower(w))) END AS toks
FROM (SELECT id, query, list_distinct({O.content_tokens('query')}) AS c FROM qlog)"""
LOG_VIEWS = {
    "tsets": _TOKS,
    "links": """
SELECT a.id AS a, b.id AS b, len(list_intersect(a.toks, b.toks))::DOUBLE / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) AS j
FROM tsets a JOIN tsets b ON a.id < b.id AND len(a.toks) > 0 AND len(b.toks) > 0""",
}


@query("LOG-01", O.sql("""
SELECT id, CASE WHEN answer IS NULL THEN 'CLARIFY' WHEN starts_with(answer, 'E') THEN 'ABSTAIN' WHEN length(answer) / 300.0 < 1 THEN 'PARTIAL' ELSE 'ANSWERED' END AS outcome FROM qlog"""))
def query_outcomes(spark, d):
    q = K.query_log(spark, d)
    o = M.outcome(F.col("answer").isNull(), F.col("answer").startswith("E"), F.length("answer") / 300.0)
    return q.select("id", o.alias("outcome"))


@query("LOG-02", O.sql("""
SELECT id, query, outcome, intent FROM settled UNION ALL
SELECT id, query, 'DOWN', intent FROM qlog WHERE outcome = 'PARTIAL' AND query NOT IN (SELECT query FROM settled)""",
    settled="SELECT id, query, outcome, intent FROM qlog WHERE outcome <> 'PARTIAL'"))
def log_merge(spark, d):
    q = K.query_log(spark, d).withColumn("created_at", F.col("conv_id") * 1000 + F.col("turn"))
    return M.log_merge(q.where("outcome <> 'PARTIAL'"), q.where("outcome = 'PARTIAL'"))


@query("LOG-03", O.sql("SELECT a, b, round(j, 6) AS jaccard FROM links WHERE j >= 0.1 AND a IN (SELECT rep FROM reps) AND b IN (SELECT rep FROM reps)", **LOG_VIEWS,
    reps="SELECT min(id) AS rep FROM (SELECT id, list_sort(toks) AS s FROM tsets) GROUP BY s"))
def jaccard_pairs(spark, d):
    return M.jaccard_pairs(M.token_sets(K.query_log(spark, d)), 0.1).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


CLUSTERS = """
SELECT id, min(reach) AS cluster FROM (SELECT id, id AS reach FROM qlog UNION ALL SELECT id, reach FROM walk) GROUP BY id"""


def _cluster_sql(body: str) -> str:
    pairs = "SELECT a AS x, b AS y FROM links WHERE j >= 0.1 UNION ALL SELECT b, a FROM links WHERE j >= 0.1"
    text = O.sql("SELECT 1 FROM sym", **LOG_VIEWS, sym=pairs)
    head = text[: text.rindex("\nSELECT 1 FROM sym")]
    return f"""{head},
walk(id, reach) AS (SELECT x, y FROM sym UNION SELECT w.id, s.y FROM walk w JOIN sym s ON s.x = w.reach),
qlog2 AS ({O.VIEWS['qlog']}), clusters AS ({CLUSTERS.replace('qlog', 'qlog2')})
{body}"""


@query("LOG-04", _cluster_sql("SELECT id, cluster FROM clusters"))
def similarity_clusters(spark, d):
    return M.similarity_clusters(K.query_log(spark, d), 0.1)


@query("LOG-05", _cluster_sql("""
SELECT cluster, count(*) AS size, count(*) * sum(CASE outcome WHEN 'ABSTAIN' THEN 3 WHEN 'PARTIAL' THEN 2 ELSE 1 END)::BIGINT AS score, count_if(outcome = 'ANSWERED') AS answered, count_if(outcome = 'PARTIAL') AS partial,
  count_if(outcome = 'ABSTAIN') AS abstain, count_if(outcome = 'CLARIFY') AS clarify, arg_min(intent, intent_key) AS top_intent, array_to_string(list_sort(list(id))[1:20], '|') AS members
FROM (SELECT *, lpad((100000 - count(*) OVER (PARTITION BY cluster, intent))::VARCHAR, 8, '0') || intent AS intent_key FROM clusters JOIN qlog2 USING (id)) GROUP BY cluster"""))
def cluster_ranking(spark, d):
    log = K.query_log(spark, d)
    r = M.cluster_ranking(log, M.similarity_clusters(log, 0.1))
    return r.select("cluster", "size", "score", "answered", "partial", "abstain", "clarify", "top_intent", F.array_join("members", "|").alias("members"))


@query("LOG-06", """
SELECT count(*) AS promoted, count(DISTINCT item_id) AS labels, 40::BIGINT + 0 * count(*) + 1 AS first_number, min(item_id) AS min_item FROM benchmark""".replace("40::BIGINT + 0 * count(*) + 1", "max(item_id) // 2 + 1"))
def promotion(spark, d):
    b = K.table(spark, d, "benchmark")
    golden = b.select(F.format_string("mined-%04d", F.floor(F.col("item_id") / 2)).alias("query_id"))
    p = M.promote(b.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question")), golden)
    n = F.regexp_extract("query_id", r"-(\d+)$", 1).cast("bigint")
    return p.agg(F.countDistinct("query_id").alias("promoted"), F.countDistinct("id").alias("labels"), F.min(n).alias("first_number"), F.min(F.col("id").cast("bigint")).alias("min_item"))


@query("LOG-07", """
SELECT conv_id, substr(coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), 'New chat'), 1, 60) AS title, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def conversation_listing(spark, d):
    return M.conversation_listing(K.table(spark, d, "conversations"))


@query("LOG-08", "SELECT count(*) AS requests, count_if(event_type = 'error') AS errors, round(avg(value), 4) AS mean_latency FROM events")
def service_metrics(spark, d):
    return M.service_metrics(K.table(spark, d, "events"))


@query("LOG-08", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def latest_usage(spark, d):
    return K.table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "event_type")


@query("QRY-11", """
SELECT conv_id, turn, CASE WHEN lu <> '' AND lu <> text THEN text || ' [context: ' || substr(lu, 1, 200) || ' | ' || substr(coalesce(la, ''), 1, 300) || ']' ELSE text END AS query
FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS lu, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER w AS la
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'user'""")
def history_aware_query(spark, d):
    return QU.with_history(K.table(spark, d, "conversations")).select("conv_id", "turn", "query")


@query("SRC-13", """
SELECT conv_id, count(*) AS messages, array_to_string(list(role || ':' || length(text) ORDER BY turn), '|') AS bundle FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def session_bundles(spark, d):
    from corpuscle.sources import tables as ST

    out = ST.import_bundles(ST.export_bundles(K.table(spark, d, "conversations")))
    g = out.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("m")))).alias("ms"))
    return g.select("conv_id", "messages", F.array_join(F.transform("ms", lambda x: x["m"]), "|").alias("bundle"))
