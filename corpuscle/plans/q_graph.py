"""Queries: graph, diff, guard, source code."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions import vocab as V
from corpuscle.operators import code as CO
from corpuscle.operators import graph as G
from corpuscle.operators import guard as GD
from corpuscle.operators import keyed as KY
from corpuscle.plans import corpus as K
from corpuscle.plans import oracle as O
from corpuscle.plans.q_retrieval import VIEWS as RVIEWS
from corpuscle.plans.q_retrieval import reranked
from corpuscle.plans.registry import query

ALIASES = {f"src{i}": f"src{i}" for i in range(20)}

GRAPH_VIEWS = {
    "marked": """
SELECT document_id, chunk_id, source_pdf, module, chunk_kind, normalized_text,
  list_sort(list_distinct(list_filter(requirement_ids, lambda x: NOT regexp_matches(x, '[_-]$')))) AS reqs,
  list_sort(list_distinct(list_filter(api_names, lambda x: NOT regexp_matches(x, '[_-]$') AND NOT regexp_matches(x, '^(SWS|RS|PRS|SRS|TPS|constr)_')
    AND regexp_matches(lower(split_part(x, '_', 1)), '^src([0-9]|1[0-9])$')))) AS apis,
  list_sort(list_distinct(list_filter(ecu_parameters, lambda x: NOT regexp_matches(x, '[_-]$')))) AS ecucs FROM chunks""",
    "mentions": """
SELECT document_id, chunk_id, source_pdf, 'module' AS type, module AS label FROM marked WHERE module <> ''
UNION ALL SELECT document_id, chunk_id, source_pdf, 'requirement', unnest(reqs) FROM marked
UNION ALL SELECT document_id, chunk_id, source_pdf, 'api', unnest(apis) FROM marked
UNION ALL SELECT document_id, chunk_id, source_pdf, 'ecuc', unnest(ecucs) FROM marked""",
    "gnodes": """
SELECT node_id, type, arg_min(label, document_id) AS label, arg_min(source_pdf, document_id) AS source FROM (
  SELECT 'document:' || document_id AS node_id, 'document' AS type, document_id AS label, source_pdf, document_id FROM docs
  UNION ALL SELECT type || ':' || label, type, label, source_pdf, document_id FROM mentions) GROUP BY node_id, type""",
    "containment": "SELECT 'document:' || document_id AS src, 'contains' AS rel, type || ':' || label AS dst, min(chunk_id) AS chunk_id FROM mentions GROUP BY ALL",
    "sents": f"SELECT chunk_id, reqs, apis, list_distinct(regexp_extract_all(lower(s), '[A-Za-z0-9_]+')) AS w FROM (SELECT *, unnest({O.sentences('normalized_text')}) AS s FROM marked WHERE chunk_kind = 'atomic')",
    "named": """
SELECT * FROM (SELECT chunk_id, list_filter(reqs, lambda r: length(r) >= 4 AND list_contains(w, lower(r))) AS r,
  list_filter(apis, lambda a: length(a) >= 4 AND list_contains(w, lower(a))) AS a FROM sents) WHERE len(r) + len(a) BETWEEN 2 AND 8""",
    "co": """
SELECT src, rel, dst, min(chunk_id) AS chunk_id FROM (
  SELECT chunk_id, 'requirement:' || x AS src, 'references' AS rel, 'requirement:' || y AS dst FROM (SELECT chunk_id, unnest(r) AS x, r FROM named), unnest(r) AS u(y) WHERE x < y
  UNION ALL SELECT chunk_id, 'api:' || x, 'satisfies', 'requirement:' || y FROM (SELECT chunk_id, unnest(a) AS x, r FROM named), unnest(r) AS u(y)) GROUP BY ALL""",
    "gedges": """
SELECT 'e-' || substr(sha256(src || '|' || rel || '|' || dst), 1, 12) AS edge_id, src, rel, dst, rel <> 'contains' AS is_inferred,
  CASE WHEN rel = 'contains' THEN 1.0 ELSE 0.6 END::DOUBLE AS confidence, chunk_id FROM (SELECT * FROM containment UNION ALL SELECT * FROM co)""",
}


def sql(body: str, **more: str) -> str:
    return O.sql(body, **{**RVIEWS, **GRAPH_VIEWS, **more})


def marked(spark, d):
    return G.signals(K.chunks(spark, d), ALIASES)


def node_rows(spark, d):
    docs = K.documents(spark, d).select("document_id", F.col("document_id").alias("title"), "source_pdf")
    return G.nodes(marked(spark, d), docs, "snap-1")


def edge_rows(spark, d):
    def make():
        m = marked(spark, d)
        return G.contains_edges(m).unionByName(G.co_mentions(m))

    return K.once(spark, d, "edges", make)


@query("GRF-01", sql("SELECT node_id, type, label, source, substr(sha256(node_id || label), 1, 32) AS content_hash FROM gnodes"))
def graph_nodes(spark, d):
    return node_rows(spark, d).select("node_id", "type", "label", "source", "content_hash")


@query("GRF-02 GRF-03", sql("SELECT edge_id, src, rel, dst, is_inferred, confidence, chunk_id FROM gedges"))
def graph_edges(spark, d):
    m = marked(spark, d)
    e = G.contains_edges(m).unionByName(G.co_mentions(m))
    return e.select("edge_id", "src", "rel", "dst", "is_inferred", "confidence", "chunk_id")


@query("GRF-04", sql("SELECT 'tr-satisfies::' || src || '::' || dst AS link_id, src AS source_id, dst AS target_id, '[{\"chunk_id\":\"' || chunk_id || '\"}]' AS evidence FROM co WHERE rel = 'satisfies'"))
def trace_links(spark, d):
    return G.trace_links(edge_rows(spark, d)).select("link_id", "source_id", "target_id", "evidence")


@query("GRF-05", sql("""
SELECT n.node_id, count(e.at) AS degree FROM gnodes n LEFT JOIN (SELECT src AS at FROM gedges UNION ALL SELECT dst FROM gedges WHERE dst <> src) e ON e.at = n.node_id GROUP BY n.node_id"""))
def node_degrees(spark, d):
    return G.degrees(node_rows(spark, d), edge_rows(spark, d)).select("node_id", "degree")


@query("GRF-06", sql("""
SELECT node_id, source, CASE WHEN type IN ('api', 'requirement') THEN 'new' ELSE 'kept' END AS state FROM gnodes WHERE type IN ('api', 'requirement') OR type = 'module'"""))
def snapshot_replace(spark, d):
    n = node_rows(spark, d).select("node_id", "type", "source")
    old = n.select("node_id", "source", F.when(F.col("type") == "document", "snap-0").otherwise("snap-1").alias("snapshot_id"), F.lit("kept").alias("state"), "type")
    old = old.where(F.col("type").isin("module", "api", "document")).drop("type")
    new = n.where(F.col("type").isin("api", "requirement")).select("node_id", "source", F.lit("snap-1").alias("snapshot_id"), F.lit("new").alias("state"))
    return G.replace_snapshot(old, new, "snap-1", "node_id").select("node_id", "source", "state")


_SEEDS = "SELECT DISTINCT 'api:' || upper(substr(source, 1, 1)) || substr(source, 2) || '_Init' AS seed FROM documents"


@query("GRF-09", sql("""
SELECT seed, node_id, min(hop) AS hop FROM (
  SELECT seed, seed AS node_id, 0 AS hop FROM seeds
  UNION ALL SELECT seed, other, 1 FROM h1 UNION ALL SELECT seed, other, 2 FROM h2) GROUP BY seed, node_id""",
    seeds=_SEEDS, both_ways="SELECT src AS pt, dst AS other FROM gedges UNION ALL SELECT dst, src FROM gedges",
    h1="SELECT DISTINCT seed, other FROM seeds JOIN both_ways ON pt = seed", h2="SELECT DISTINCT seed, b.other FROM h1 JOIN both_ways b ON b.pt = h1.other"))
def neighbourhood(spark, d):
    seeds = K.documents(spark, d).select(F.concat(F.lit("api:"), F.initcap("module"), F.lit("_Init")).alias("node_id")).distinct()
    return G.neighbourhood(seeds, edge_rows(spark, d), 2)[0].select("seed", "node_id", "hop")


_TQ = """
SELECT query_id, CASE k WHEN 0 THEN 'Which APIs satisfy ' || spec || '?' WHEN 1 THEN 'Which requirements does ' || api || ' satisfy?'
  WHEN 2 THEN 'Which requirements does ' || spec || ' reference?' WHEN 3 THEN 'What connects to ' || api || '?' ELSE 'What connects to ' || src || '?' END AS text,
  k, spec, api, src FROM (
  SELECT 'q-' || item_id AS query_id, item_id % 5 AS k, 'SWS_SRC' || (item_id % 20) || '_' || lpad((item_id % 50)::VARCHAR, 5, '0') AS spec, 'Src' || (item_id % 20) || '_Init' AS api, 'src' || (item_id % 20) AS src FROM benchmark)"""


def trace_questions(spark, d):
    n = F.col("item_id")
    src = (n % 20).cast("string")
    spec = F.concat(F.lit("SWS_SRC"), src, F.lit("_"), F.lpad((n % 50).cast("string"), 5, "0"))
    api = F.concat(F.lit("Src"), src, F.lit("_Init"))
    q = (
        F.when(n % 5 == 0, F.concat(F.lit("Which APIs satisfy "), spec, F.lit("?")))
        .when(n % 5 == 1, F.concat(F.lit("Which requirements does "), api, F.lit(" satisfy?")))
        .when(n % 5 == 2, F.concat(F.lit("Which requirements does "), spec, F.lit(" reference?")))
        .when(n % 5 == 3, F.concat(F.lit("What connects to "), api, F.lit("?")))
        .otherwise(F.concat(F.lit("What connects to src"), src, F.lit("?")))
    )
    return K.table(spark, d, "benchmark").select(F.concat(F.lit("q-"), n.cast("string")).alias("query_id"), q.alias("text"))


@query("GRF-10", sql("""
SELECT query_id, 'node' AS kind, node_id AS id FROM asked UNION SELECT query_id, 'node', other FROM met UNION SELECT query_id, 'edge', edge_id FROM met
UNION SELECT query_id, 'chunk', chunk_id FROM met WHERE chunk_id IS NOT NULL""", tq=_TQ,
    asked="SELECT query_id, k, CASE k WHEN 0 THEN 'requirement:' || spec WHEN 1 THEN 'api:' || api WHEN 2 THEN 'requirement:' || spec WHEN 3 THEN 'api:' || api ELSE 'module:' || src END AS node_id FROM tq",
    ends="SELECT edge_id, rel, chunk_id, src AS at, dst AS other, 'src' AS side FROM gedges UNION ALL SELECT edge_id, rel, chunk_id, dst, src, 'dst' FROM gedges",
    met="""SELECT a.query_id, e.* FROM asked a JOIN ends e ON e.at = a.node_id
  AND (a.k >= 3 OR (e.rel = CASE WHEN a.k = 2 THEN 'references' ELSE 'satisfies' END AND e.side = CASE WHEN a.k = 0 THEN 'dst' ELSE 'src' END))"""))
def trace_answers(spark, d):
    return G.trace_answers(trace_questions(spark, d), node_rows(spark, d), edge_rows(spark, d))


@query("GRF-11", sql("""
SELECT query_id, pos, s.label AS subject, rel AS predicate, o.label AS object, is_inferred, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY slot, edge_id) AS pos FROM (
    SELECT DISTINCT query_id, slot, e.* FROM (
      SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, p) AS slot FROM (
        SELECT query_id, node_id, min(rank * 1000000 + p) AS k, arg_min(rank, rank * 1000000 + p) AS rank, arg_min(p, rank * 1000000 + p) AS p FROM (
          SELECT query_id, rank, unnest(ids) AS node_id, generate_subscripts(ids, 1) AS p FROM (
            SELECT query_id, rank, list_concat(list_concat(list_transform(requirement_ids, lambda x: 'requirement:' || x), list_transform(api_names, lambda x: 'api:' || x)),
              list_transform(ecu_parameters, lambda x: 'ecuc:' || x)) AS ids FROM reranked JOIN chunks USING (chunk_id) WHERE rank <= 12))
        GROUP BY query_id, node_id)) seeds JOIN (SELECT *, src AS at FROM gedges UNION SELECT *, dst FROM gedges) e ON e.at = seeds.node_id))
JOIN gnodes s ON s.node_id = src JOIN gnodes o ON o.node_id = dst"""))
def evidence_graph(spark, d):
    c = K.chunks(spark, d).select("chunk_id", "requirement_ids", "api_names", "ecu_parameters")
    e = reranked(spark, d).where("rank <= 12").join(c, "chunk_id")
    return G.evidence_graph(e, node_rows(spark, d), edge_rows(spark, d))


_MODS = ("the", "and", "der", "que", "les", "src1", "src2", "src3", "para", "onen")


@query("GRF-12", O.sql(f"""
SELECT chunk_id, p[i] AS subject, 'co_mentioned_with' AS predicate, p[j] AS object, 0.7::DOUBLE AS confidence, true AS is_inferred
FROM pm, unnest(range(1, len(p) + 1)) AS a(i), unnest(range(1, len(p) + 1)) AS b(j) WHERE i < j
UNION ALL SELECT chunk_id, p[1], 'implements', unnest(api_names), 0.9, false FROM pm WHERE len(p) > 0""",
    pm=f"SELECT chunk_id, api_names, list_filter([{', '.join(O.lit(m) for m in _MODS)}], lambda m: contains(lower(normalized_text), m)) AS p FROM chunks"))
def module_co_mentions(spark, d):
    return G.module_co_mentions(K.chunks(spark, d), _MODS)


@query("GRF-13", sql(f"""
SELECT edge_id, split_part(src, ':', 1) IN ({', '.join(O.lit(k) for k in V.NODE_KINDS)}) AND split_part(dst, ':', 1) IN ({', '.join(O.lit(k) for k in V.NODE_KINDS)})
  AND rel IN ({', '.join(O.lit(k) for k in V.RELATIONS)}) AS valid FROM gedges"""))
def edge_vocabulary(spark, d):
    e = edge_rows(spark, d).select(
        "edge_id", F.substring_index("src", ":", 1).alias("subject_type"), F.substring_index("dst", ":", 1).alias("object_type"), F.col("rel").alias("predicate"))
    return G.validate_edges(e).select("edge_id", "valid")


# --- diff -------------------------------------------------------------------------------------


@query("DIF-01", """
SELECT 'orders' AS domain, coalesce(b.k, t.k) AS entity_key,
  CASE WHEN b.k IS NULL THEN 'added' WHEN t.k IS NULL THEN 'removed' WHEN b.v = t.v THEN 'unchanged' ELSE 'modified' END AS change_type,
  CASE WHEN b.k IS NULL THEN 'info' WHEN t.k IS NULL THEN 'high' WHEN b.v = t.v THEN 'info' ELSE 'warning' END AS severity,
  coalesce(b.v, '') AS base_value, coalesce(t.v, '') AS target_value, coalesce(b.e, '') AS base_evidence, coalesce(t.e, '') AS target_evidence
FROM (SELECT o_orderkey AS k, o_orderstatus || '/' || o_orderpriority AS v, 'cust-' || o_custkey AS e FROM orders WHERE o_orderkey % 5 <> 0) b
FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END || '/' || o_orderpriority AS v, 'cust-' || o_custkey AS e FROM orders WHERE o_orderkey % 7 <> 0) t ON t.k = b.k""")
def record_diff(spark, d):
    o = K.table(spark, d, "orders")
    rec = lambda status, keep: o.where(keep).select(
        F.col("o_orderkey").alias("entity_key"), F.concat_ws("/", status, "o_orderpriority").alias("normalized"),
        F.array(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))).alias("evidence_ids"))
    k = F.col("o_orderkey")
    out = KY.diff_records(rec(F.col("o_orderstatus"), k % 5 != 0), rec(F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")), k % 7 != 0), "orders")
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.select(
        "domain", "entity_key", "change_type", "severity", text(F.col("base_value")).alias("base_value"), text(F.col("target_value")).alias("target_value"),
        text(F.array_join("base_evidence_ids", "|")).alias("base_evidence"), text(F.array_join("target_evidence_ids", "|")).alias("target_evidence"))


@query("DIF-02", O.sql("""
SELECT what, side, id, count(*) OVER (PARTITION BY what, side) AS n, (SELECT count(*) FROM chunks WHERE release = '4.2.2') AS base_chunks,
  (SELECT count(*) FROM chunks WHERE release = '4.4.0') AS target_chunks
FROM (SELECT what, id, CASE WHEN bool_or(release = '4.4.0') THEN 'added' ELSE 'removed' END AS side FROM (
  SELECT 'chunks' AS what, chunk_id AS id, release FROM chunks WHERE release IN ('4.2.2', '4.4.0')
  UNION ALL SELECT 'requirements', unnest(requirement_ids), release FROM chunks WHERE release IN ('4.2.2', '4.4.0'))
  GROUP BY what, id HAVING count(DISTINCT release) = 1)"""))
def release_delta(spark, d):
    return KY.release_delta(K.chunks(spark, d), "4.2.2", "4.4.0").select("what", "side", "id", "n", "base_chunks", "target_chunks")


@query("DIF-03", sql("""
SELECT a.query_id, a.release AS release_1, b.release AS release_2, array_to_string(list_sort(list_distinct(list(a.rid))), '|') AS requirement_ids
FROM ids a JOIN ids b ON a.query_id = b.query_id AND a.rid = b.rid AND a.release < b.release GROUP BY ALL""",
    ids="SELECT DISTINCT query_id, release, unnest(requirement_ids) AS rid FROM reranked JOIN chunks USING (chunk_id)"))
def release_conflicts(spark, d):
    e = reranked(spark, d).join(K.chunks(spark, d).select("chunk_id", "release", "requirement_ids"), "chunk_id")
    return KY.conflicts(e).withColumn("requirement_ids", F.array_join("requirement_ids", "|"))


# --- guard ------------------------------------------------------------------------------------

_SAID = "CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'restricted' ELSE '' END"
_FN = "CASE doc_id % 6 WHEN 0 THEN 'vector_guide.pdf' WHEN 1 THEN 'driver.c' ELSE source || '.txt' END"


def _said(n):
    return F.when(n % 4 == 0, "public").when(n % 4 == 1, "internal").when(n % 4 == 2, "restricted").otherwise("")


def _fn(n):
    return F.when(n % 6 == 0, "vector_guide.pdf").when(n % 6 == 1, "driver.c").otherwise(F.concat("source", F.lit(".txt")))


RISK = f"""
SELECT doc_id, said, CASE WHEN hard THEN 'confidential' WHEN soft THEN CASE WHEN said <> '' THEN said ELSE 'confidential' END WHEN said IN ('public', 'internal') THEN said ELSE 'internal' END AS classification,
  array_to_string(list_filter([CASE WHEN ax THEN 'arxml artifact' END, CASE WHEN cd THEN 'source code' END, CASE WHEN vd THEN 'vendor document' END, CASE WHEN cu THEN 'oem/customer document' END,
    CASE WHEN pii THEN 'pii detected' END, CASE WHEN cr THEN 'credential/secret pattern' END, CASE WHEN ip THEN 'private network identifier' END], lambda x: x IS NOT NULL), '|') AS findings,
  NOT hard AND NOT soft AND said = 'public' AS cloud_eligible, pii OR ip AS redaction_required
FROM (SELECT *, cr OR ax OR cd OR vd OR cu AS hard, pii OR ip OR said IN ('confidential', 'restricted') AS soft FROM (
  SELECT doc_id, {_SAID} AS said, regexp_matches(text, {O.lit(V.ARXML_TAG)}) AS ax, regexp_matches({_FN}, '\\.(c|h|cpp|hpp)$') OR regexp_matches(text, {O.lit(V.C_SOURCE)}) AS cd,
    regexp_matches({_FN}, {O.lit('|'.join(V.VENDOR_NAMES))}) AS vd, regexp_matches({_FN}, {O.lit('|'.join(V.CUSTOMER_NAMES))}) AS cu,
    regexp_matches(text, {O.lit(V.EMAIL)}) OR regexp_matches(text, {O.lit(V.VIN)}) AS pii, regexp_matches(text, {O.lit(V.CREDENTIAL)}) AS cr, regexp_matches(text, {O.lit(V.PRIVATE_IP_SHORT)}) AS ip FROM documents))"""


@query("SEC-01", f"SELECT doc_id, classification, findings, cloud_eligible, redaction_required FROM ({RISK})")
def content_risk(spark, d):
    t = K.spread(K.table(spark, d, "documents"))
    r = GD.content_risk(F.col("text"), _fn(F.col("doc_id")), _said(F.col("doc_id")))
    return t.select("doc_id", r.alias("r")).select("doc_id", "r.classification", F.array_join("r.findings", "|").alias("findings"), "r.cloud_eligible", "r.redaction_required")


#: Pseudonyms by match, in SQL: marks around each match, then every other piece is a value.
def _redacted_sql(src: str, kind: str, pattern: str) -> str:
    parts = f"string_split(regexp_replace(t, {O.lit('(' + pattern + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"""SELECT doc_id, text, array_to_string(list_transform(ps, lambda p, i: CASE WHEN i % 2 = 0 THEN '<{kind}_' || lpad(CAST(list_position(vs, p) AS VARCHAR), 3, '0') || '>' ELSE p END), '') AS t,
  maps || list_transform(vs, lambda v, i: '<{kind}_' || lpad(CAST(i AS VARCHAR), 3, '0') || '>=' || v) AS maps
FROM (SELECT *, list_filter(every, lambda v, i: list_position(every, v) = i) AS vs FROM (SELECT *, list_transform(range(2, len(ps) + 1, 2), lambda i: ps[i]) AS every FROM (SELECT *, {parts} AS ps FROM ({src}))))"""


def _redaction_sql() -> str:
    src = "SELECT doc_id, text, text AS t, CAST([] AS VARCHAR[]) AS maps FROM documents"
    for kind, pattern in (("VIN", V.VIN), ("INTERNAL_IP", V.PRIVATE_IP), ("EMAIL", V.EMAIL), ("PROJECT", V.PROJECT_NAME)):
        src = _redacted_sql(src, kind, pattern)
    return src


@query("SEC-02 SEC-03", f"SELECT doc_id, t AS redacted, array_to_string(maps, '|') AS tokens, true AS restored FROM ({_redaction_sql()})")
def redaction(spark, d):
    t = K.spread(K.table(spark, d, "documents")).select("doc_id", "text", GD.redact(F.col("text")).alias("r"))
    return t.select(
        "doc_id", "r.redacted", F.array_join(F.transform("r.tokens", lambda x: F.concat(x["token"], F.lit("="), x["value"])), "|").alias("tokens"),
        (GD.restore(F.col("r.redacted"), F.col("r.tokens")) == F.col("text")).alias("restored"))


_POLICIES = ("local_only", "cloud_metadata_only", "cloud_redacted_only", "cloud_allowed")
_TASKS = ("chat_answer", "code_review", "document_summary")


@query("SEC-04", f"""
SELECT doc_id, CASE WHEN lt OR denied THEN 'local' ELSE 'cloud' END AS route,
  CASE WHEN lt THEN 'task ' || task || ' is local-only under current policy' WHEN denied THEN 'policy=' || policy || '; eligible=' || CASE WHEN cloud_eligible THEN 'True' ELSE 'False' END
    WHEN policy = 'cloud_redacted_only' THEN 'explicit policy allows redacted cloud' ELSE 'explicit policy + public classification' END AS reason,
  NOT lt AND NOT denied AND policy = 'cloud_redacted_only' AS redacted
FROM (SELECT *, policy = 'local_only' AND task = 'code_review' AS lt, policy = 'local_only' OR NOT cloud_eligible AS denied FROM (
  SELECT doc_id, cloud_eligible, {O.case('((doc_id // 4) % 4)::VARCHAR', dict(enumerate(_POLICIES)))} AS policy, {O.case('(doc_id % 3)::VARCHAR', dict(enumerate(_TASKS)))} AS task FROM ({RISK})))""")
def routing(spark, d):
    n = F.col("doc_id")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    r = GD.content_risk(F.col("text"), _fn(n), _said(n))["cloud_eligible"]
    t = K.spread(K.table(spark, d, "documents")).select("doc_id", GD.route(pick(_TASKS, n % 3), pick(_POLICIES, F.floor(n / 4) % 4), r).alias("r"))
    return t.select("doc_id", "r.*")


# --- code -------------------------------------------------------------------------------------

_CODE = ((" the ", " malloc\n(4); goto end; new\n "), (" and ", " strcpy(a, b); (int *) "), (" que ", " Rte_Read_speed_value "), (" der ", ' #include "x.h" '), (" of ", ' #include "MemMap.h" '), (" in ", " Rte_Write_brake "))


def _code_sql() -> str:
    t = "text"
    for a, b in _CODE:
        t = f"replace({t}, {O.lit(a)}, {O.lit(b)})"
    return f"SELECT 'src/' || doc_id || '.c' AS path, {t} AS text FROM documents"


def _code(spark, d):
    t = F.col("text")
    for a, b in _CODE:
        t = F.replace(t, F.lit(a), F.lit(b))
    return K.spread(K.table(spark, d, "documents")).select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".c")).alias("path"), t.alias("text"))


def _rules() -> str:
    breaks = lambda c: f"length({c}) - length(replace({c}, chr(10), ''))"
    out = []
    for rule, pattern, why in V.CODE_RULES:
        message = f"{O.lit(rule)} AS rule, path || ':' || line AS location, {O.lit(why + ' [' + V.ADVISORY + ']')} AS message"
        if rule == "missing-memmap":  # no look-ahead in this dialect: counted line by line
            n = "len(list_filter(range(2, len(parts) + 1), lambda i: NOT regexp_matches(array_to_string(parts[i:], '#include \"'), '^.*(?:MemMap|Compiler)\\b')))"
            out.append(f"SELECT path, line, {message} FROM code_lines, range({n}) AS r(i)")
            continue
        # A mark before each match: the pieces up to a mark are the text before the match.
        marked = f"string_split(regexp_replace(text, {O.lit('(' + pattern + ')')}, chr(1) || '\\1', 'g'), chr(1))"
        out.append(f"""SELECT path, line, {message} FROM (SELECT path, 1 + CAST(list_sum(list_transform(ps[1:i], lambda x: {breaks('x')})) AS BIGINT) AS line
  FROM (SELECT path, ps, unnest(range(1, len(ps))) AS i FROM (SELECT path, {marked} AS ps FROM code)))""")
    return "\nUNION ALL ".join(out)


@query("COD-01", f"""
WITH code AS ({_code_sql()}), code_lines AS (SELECT path, line, s, string_split(s, '#include "') AS parts FROM (
  SELECT path, generate_subscripts(ls, 1) AS line, unnest(ls) AS s FROM (SELECT path, string_split(text, chr(10)) AS ls FROM code)))
{_rules()}""")
def advisory_scan(spark, d):
    return CO.advisory_scan(_code(spark, d))


@query("COD-02", f"SELECT path, array_to_string(list_sort(regexp_extract_all(text, {O.lit(V.RTE_CALL)})), '|') AS calls FROM ({_code_sql()})")
def call_sites(spark, d):
    return CO.call_sites(_code(spark, d)).select("path", F.array_join("calls", "|").alias("calls"))


@query("COD-03", """
SELECT call || '->' || port AS link_id, call, port, 0.6::DOUBLE AS confidence, 'name overlap: ' || call || ' ~ ' || port AS evidence
FROM (SELECT DISTINCT 'Rte_Call_' || replace(p_name, ' ', '_') || '_' || p_size AS call FROM part) c
JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || p_size AS port FROM part) p ON contains(replace(lower(call), '_', ''), replace(lower(port), ' ', ''))""")
def call_port_matches(spark, d):
    p = K.table(spark, d, "part")
    calls = p.select(F.concat(F.lit("Rte_Call_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string")).alias("call"))
    ports = p.select(F.concat(F.substring_index("p_name", " ", -1), F.lit(" "), F.col("p_size").cast("string")).alias("port"))
    return CO.call_port_matches(calls, ports)


@query("COD-04", """
SELECT event_type AS status, 'value ' || CASE WHEN value < 10 THEN 'low' ELSE 'high' END AS message, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL""")
def failure_clusters(spark, d):
    e = K.table(spark, d, "events").select(
        F.when(F.col("event_type") == "view", "passed").otherwise(F.col("event_type")).alias("status"),
        F.concat(F.lit("value "), F.when(F.col("value") < 10, "low").otherwise("high")).alias("message"))
    return CO.failure_clusters(e)
