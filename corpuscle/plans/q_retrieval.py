"""Queries: filters, lookups, access, candidate ranking, whole retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import vocab as V
from corpuscle.operators import filters as FL
from corpuscle.operators import index as I
from corpuscle.operators import questions as QU
from corpuscle.operators import ranking as R
from corpuscle.operators import scoring as S
from corpuscle.plans import corpus as K
from corpuscle.plans import oracle as O
from corpuscle.plans import retrieve as P
from corpuscle.plans import retrieve_sql as RS
from corpuscle.plans.q_index import FUSED_VIEWS, channels, fused
from corpuscle.plans.registry import query

_SPEC = "'SWS_SRC' || (item_id % 20) || '_' || lpad((item_id % 50)::VARCHAR, 5, '0')"
_NONE = "[]::VARCHAR[]"
PLANS = f"""
SELECT 'q-' || item_id AS query_id, CASE WHEN item_id % 3 = 1 THEN text || ' ' || {_SPEC} ELSE text END AS text,
  {O.case('(item_id % 5)::VARCHAR', dict(enumerate(K.INTENTS)))} AS intent,
  CASE WHEN item_id % 3 = 0 THEN ['Classic'] ELSE {_NONE} END AS platforms,
  CASE WHEN item_id % 4 = 1 THEN ['4.4'] WHEN item_id % 4 = 2 THEN ['4.2.2', 'R22-11'] ELSE {_NONE} END AS releases,
  CASE WHEN item_id % 4 = 1 THEN 'exact' WHEN item_id % 4 = 2 THEN 'comparison' ELSE 'none' END AS release_mode,
  CASE WHEN item_id % 5 = 0 THEN ['nowhere'] WHEN item_id % 2 = 0 THEN ['src' || (item_id % 20)] ELSE {_NONE} END AS modules,
  CASE WHEN item_id % 3 = 1 THEN [{_SPEC}] WHEN item_id % 7 = 3 THEN ['SWS_SRC' || (item_id % 20) || '_'] ELSE {_NONE} END AS requirement_ids,
  CASE WHEN item_id % 6 = 2 THEN ['Src' || (item_id % 20) || '_Init'] ELSE {_NONE} END AS api_names
FROM benchmark"""
_BASE = """(len(platforms) = 0 OR list_contains(platforms, platform)) AND (release_mode <> 'exact' OR len(releases) = 0
  OR len(list_filter(releases, lambda w: release = w OR starts_with(release, w || '.'))) > 0)"""
_MOD = "(len(modules) = 0 OR module = '' OR list_contains(modules, module))"
FILTER_VIEWS = {
    "plans": PLANS,
    "pools": f"""
SELECT query_id, (SELECT count(*) FROM chunks) AS corpus_size, count_if({_MOD}) AS pool, count(*) AS pool_without_module, any_value(len(modules)) AS n_modules
FROM plans p, (SELECT platform, release, module FROM chunks) c WHERE {_BASE} GROUP BY query_id""",
    "relaxed": """
SELECT *, n_modules > 0 AND pool < greatest(1, floor(corpus_size * 0.02)) AND pool_without_module > pool AS relaxed FROM pools""",
    "in_pool": f"""
SELECT query_id, chunk_id FROM plans JOIN relaxed USING (query_id), (SELECT chunk_id, platform, release, module FROM chunks) c
WHERE {_BASE} AND (relaxed OR {_MOD})""",
    "idx": "SELECT DISTINCT lower(ident) AS ident, chunk_id FROM (SELECT chunk_id, unnest(list_concat(list_concat(requirement_ids, api_names), ecu_parameters)) AS ident FROM chunks)",
    "exacts": """
SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, lower(unnest(list_concat(requirement_ids, api_names))) AS want FROM plans) w
JOIN idx ON length(want) >= 4 AND (ident = want OR (ends_with(want, '_') AND starts_with(ident, want)))""",
    "boosted": """
SELECT query_id, chunk_id, greatest(coalesce(score, 0), CASE WHEN e.chunk_id IS NULL THEN 0 ELSE 1 END)::DOUBLE AS score, e.chunk_id IS NOT NULL AS exact_hit
FROM fused f FULL JOIN (SELECT *, true AS hit FROM exacts SEMI JOIN in_pool USING (query_id, chunk_id)) e USING (query_id, chunk_id)""",
    "cands": """
SELECT query_id, chunk_id, round(score, 5) AS fused_score, exact_hit FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM boosted) SEMI JOIN in_pool USING (query_id, chunk_id) WHERE rank <= 60""",
    "reranked": f"""
SELECT query_id, chunk_id, fused_score, exact_hit, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, fused_score, exact_hit, round(fused_score * 0.5::DOUBLE + len(list_intersect(qt, tt))::DOUBLE / greatest(len(qt), 1) * 0.2::DOUBLE
    + least(1.0::DOUBLE, 0.5::DOUBLE * len(list_filter(ids, lambda i: length(i) >= 4 AND (list_contains(qw, i)
      OR (ends_with(i, '_') AND len(list_filter(qw, lambda t: starts_with(t, i))) > 0))))) * 0.3::DOUBLE, 4) AS rerank_score
  FROM (SELECT query_id, chunk_id, fused_score, exact_hit, list_distinct({O.tokens("p.text")}) AS qt,
          list_distinct(regexp_extract_all(lower(p.text), '[A-Za-z0-9_]+')) AS qw,
          list_distinct({O.tokens("lower(section_title || ' ' || normalized_text)")}) AS tt,
          list_transform(list_concat(list_concat(c.requirement_ids, c.api_names), c.ecu_parameters), lambda x: lower(x)) AS ids
        FROM cands JOIN plans p USING (query_id) JOIN chunks c USING (chunk_id)))""",
    "fam": """
SELECT query_id, c.parent_chunk_id AS pid, count(*) AS members, min(rank) AS first, max(rerank_score) AS best, list(chunk_id ORDER BY rank) AS merged
FROM reranked r JOIN chunks c USING (chunk_id) WHERE c.parent_chunk_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
    "picked": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY members DESC, first, pid) AS slot FROM fam) WHERE slot <= 6",
    "expanded": """
SELECT query_id, chunk_id, rerank_score, merged, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, side, slot, chunk_id) AS rank FROM (
  SELECT query_id, pid AS chunk_id, best AS rerank_score, 0 AS side, slot, merged FROM picked
  UNION ALL
  SELECT query_id, chunk_id, rerank_score, 1, rank, []::VARCHAR[] FROM reranked
  ANTI JOIN (SELECT query_id, unnest(list_append(merged, pid)) AS chunk_id FROM picked) USING (query_id, chunk_id))""",
    "final": "SELECT e.* FROM expanded e JOIN plans USING (query_id) WHERE rank <= CASE WHEN intent = 'configuration' THEN 18 ELSE 12 END",
}
VIEWS = {**FUSED_VIEWS, **FILTER_VIEWS}


def sql(body: str, **more: str) -> str:
    return O.sql(body, **{**VIEWS, **more})


def combos(spark, d):
    return K.once(spark, d, "facets", lambda: FL.facets(K.chunks(spark, d)))


def kept(spark, d):
    return K.once(spark, d, "kept", lambda: FL.kept_combinations(K.plans(spark, d), combos(spark, d)))


def _pooled(spark, d, rows):
    facet_of = FL.with_facet(K.chunks(spark, d)).select("chunk_id", *FL.FACET)
    return FL.in_pool(rows.join(facet_of, "chunk_id"), kept(spark, d)).drop(*FL.FACET)


def candidates(spark, d):
    return K.once(spark, d, "candidates", lambda: candidate_plan(spark, d))


def candidate_plan(spark, d):
    exact = _pooled(spark, d, R.exact_candidates(K.plans(spark, d), I.exact_ids(K.chunks(spark, d))))
    return _pooled(spark, d, R.candidate_cut(R.boosted(fused(spark, d), exact)))


def reranked(spark, d):
    def make():
        return R.rerank(candidates(spark, d), K.plans(spark, d), K.chunks(spark, d), K.questions(spark, d))

    return K.once(spark, d, "reranked", make)


def expanded(spark, d):
    return K.once(spark, d, "expanded", lambda: R.parent_expand(reranked(spark, d), K.chunks(spark, d), K.questions(spark, d)))


def final(spark, d):
    rows = expanded(spark, d).join(K.plans(spark, d).select("query_id", "intent"), "query_id")
    return rows.where(F.col("rank") <= R.final_k(F.col("intent"))).drop("intent")


@query("FLT-01 FLT-02 FLT-03", sql("""
SELECT p.query_id, coalesce(corpus_size, (SELECT count(*) FROM chunks)) AS corpus_size, coalesce(pool, 0) AS pool,
  coalesce(pool_without_module, 0) AS pool_without_module, coalesce(relaxed, false) AS relaxed FROM plans p LEFT JOIN relaxed USING (query_id)"""))
def filter_relaxation(spark, d):
    return FL.relaxation(K.plans(spark, d), combos(spark, d)).select("query_id", "corpus_size", "pool", "pool_without_module", "relaxed")


@query("FLT-01 FLT-02", sql("SELECT query_id, platform, release, module, count(*) AS chunks FROM in_pool JOIN chunks USING (chunk_id) GROUP BY ALL"))
def metadata_filter(spark, d):
    return FL.kept_combinations(K.plans(spark, d), combos(spark, d)).join(combos(spark, d), FL.FACET).select("query_id", "platform", "release", "module", "chunks")


@query("FLT-04 FLT-10", O.sql("""
SELECT user_id, m.workspace_id, document_id FROM members m JOIN docs d ON d.ws IS NULL OR d.ws = m.workspace_id
WHERE role IN ('owner', 'admin') OR owner IS NULL OR owner = user_id""",
    members="SELECT DISTINCT 'user-' || (doc_id % 5) AS user_id, 'ws-' || (doc_id % 3) AS workspace_id, CASE (doc_id % 5) WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' ELSE 'member' END AS role FROM documents",
    docs="SELECT 'doc-' || doc_id AS document_id, CASE WHEN doc_id % 7 <> 0 THEN 'ws-' || (doc_id % 3) END AS ws, CASE WHEN doc_id % 4 <> 0 THEN 'user-' || (doc_id % 5) END AS owner FROM documents"))
def authorised_documents(spark, d):
    docs = K.documents(spark, d).select(
        "document_id", F.when(F.col("doc_id") % 7 != 0, F.col("workspace_id")).alias("workspace_id"),
        F.when(F.col("doc_id") % 4 != 0, F.col("owner_user_id")).alias("owner_user_id"))
    return FL.authorised_documents(_members(spark, d), docs)


def _members(spark, d):
    role = F.when(F.col("owner_user_id") == "user-0", "owner").when(F.col("owner_user_id") == "user-1", "admin").otherwise("member")
    return K.documents(spark, d).select(F.col("owner_user_id").alias("user_id"), "workspace_id", role.alias("role")).distinct()


@query("FLT-11", """
WITH members AS (SELECT DISTINCT 'user-' || (doc_id % 5) AS user_id, 'ws-' || (doc_id % 3) AS workspace_id, CASE (doc_id % 5) WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' ELSE 'member' END AS role FROM documents),
cols AS (SELECT DISTINCT 'col-' || source || '-' || (doc_id % 3) AS collection_id, 'ws-' || (doc_id % 3) AS workspace_id,
  CASE WHEN doc_id % 2 = 0 THEN 'private' ELSE 'shared' END AS visibility, 'user-' || (doc_id % 5) AS owner_id FROM documents)
SELECT DISTINCT user_id, workspace_id, collection_id FROM members JOIN cols USING (workspace_id)
WHERE visibility <> 'private' OR role IN ('owner', 'admin') OR owner_id = user_id""")
def visible_collections(spark, d):
    cols = K.documents(spark, d).select(
        F.concat(F.lit("col-"), "module", F.lit("-"), (F.col("doc_id") % 3).cast("string")).alias("collection_id"), "workspace_id",
        F.when(F.col("doc_id") % 2 == 0, "private").otherwise("shared").alias("visibility"), F.col("owner_user_id").alias("owner_id")).distinct()
    members = FL.workspaces_of(_members(spark, d), cols.select("workspace_id").distinct())
    return FL.visible_collections(members, cols).distinct()


@query("FLT-05", O.sql("""
SELECT DISTINCT w.query_id, c.chunk_id FROM wanted w JOIN chunks c ON (w.want = '' OR w.want = c.release)
  AND len(list_filter(c.requirement_ids, lambda r: contains(lower(r), lower(w.needle)))) > 0""",
    wanted="SELECT 'q-' || item_id AS query_id, CASE WHEN item_id % 9 = 4 THEN 'rc' WHEN item_id % 9 = 7 THEN '7' ELSE 'Src' || (item_id % 20) || '_000' || (item_id % 5) END AS needle, CASE WHEN item_id % 2 = 0 THEN 'R22-11' ELSE '' END AS want FROM benchmark"))
def requirement_search(spark, d):
    n = F.col("item_id")
    w = K.table(spark, d, "benchmark").select(
        F.concat(F.lit("q-"), n.cast("string")).alias("query_id"),
        F.when(n % 9 == 4, "rc").when(n % 9 == 7, "7")
        .otherwise(F.concat(F.lit("Src"), (n % 20).cast("string"), F.lit("_000"), (n % 5).cast("string"))).alias("needle"),
        F.when(n % 2 == 0, "R22-11").otherwise("").alias("release"))
    return FL.requirement_search(K.chunks(spark, d), w).select("query_id", "chunk_id")


@query("FLT-05", O.sql("""
SELECT document_id, evidence_id FROM (SELECT 'doc-' || doc_id AS document_id, 'tbl-doc-' || doc_id || '-0-0' AS evidence_id, text, release FROM docs)
WHERE contains(lower(text), 'erst') AND release = '4.4.0'"""))
def caption_search(spark, d):
    t = K.documents(spark, d).select("document_id", F.concat(F.lit("tbl-"), "document_id", F.lit("-0-0")).alias("evidence_id"), F.col("text").alias("caption"), "release")
    return FL.caption_search(t, "erst", ["caption"], "4.4.0").select("document_id", "evidence_id")


@query("FLT-06", O.sql("""
SELECT 'release' AS facet, release AS value FROM docs UNION SELECT 'platform', platform FROM docs UNION SELECT 'module', module FROM docs UNION SELECT 'lang', lang FROM docs"""))
def corpus_facets(spark, d):
    return FL.corpus_facets(K.documents(spark, d), ["release", "platform", "module", "lang"])


@query("FLT-07", sql("""
SELECT query_id, array_to_string(list_filter([CASE WHEN len(releases) = 0 AND (SELECT count(DISTINCT release) FROM docs) > 1 THEN 'release' END,
  CASE WHEN len(platforms) = 0 AND (SELECT count(DISTINCT platform) FROM docs) > 1 THEN 'platform' END], lambda x: x IS NOT NULL), '|') AS missing FROM plans"""))
def missing_slots(spark, d):
    return FL.missing_slots(K.plans(spark, d), K.documents(spark, d)).select("query_id", F.array_join("missing", "|").alias("missing"))


_TENANT = "SELECT doc_id, 'tenant-' || (doc_id % 2) AS tenant_id, 'proj-' || (doc_id % 3) AS project_id, CASE doc_id % 4 WHEN 0 THEN 'generic' WHEN 1 THEN 'acme' ELSE 'other' END AS vendor_scope FROM documents"


def _tenant_rows(spark, d):
    n = F.col("doc_id")
    return K.table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("tenant-"), (n % 2).cast("string")).alias("tenant_id"), F.concat(F.lit("proj-"), (n % 3).cast("string")).alias("project_id"),
        F.when(n % 4 == 0, "generic").when(n % 4 == 1, "acme").otherwise("other").alias("vendor_scope"))


@query("FLT-08", f"SELECT * FROM ({_TENANT}) WHERE tenant_id = 'tenant-1' AND project_id = 'proj-2' AND vendor_scope IN ('generic', 'acme')")
def tenant_filter(spark, d):
    ctx = {"tenant_id": "tenant-1", "project_id": "proj-2", "allowed_vendor_scopes": ["acme"]}
    return FL.tenant_filter(_tenant_rows(spark, d), ctx)


@query("FLT-09", f"""
SELECT doc_id, user_id, CASE WHEN tenant_id <> my_tenant THEN 'cross-tenant access denied' WHEN project_id <> my_project THEN 'project scope denied'
  WHEN vendor_scope NOT IN ('generic', 'acme') THEN 'vendor scope ''' || vendor_scope || ''' not authorized' ELSE 'allowed' END AS reason
FROM (SELECT *, 'user-' || (doc_id % 5) AS user_id, 'tenant-' || (doc_id % 5 % 2) AS my_tenant, 'proj-' || (doc_id % 5 % 3) AS my_project FROM ({_TENANT}))""")
def access_decisions(spark, d):
    u = F.col("doc_id") % 5
    rows = _tenant_rows(spark, d).withColumnsRenamed({"tenant_id": "r_tenant_id", "project_id": "r_project_id", "vendor_scope": "r_vendor_scope"})
    rows = rows.withColumns({
        "user_id": F.concat(F.lit("user-"), u.cast("string")), "tenant_id": F.concat(F.lit("tenant-"), (u % 2).cast("string")),
        "project_id": F.concat(F.lit("proj-"), (u % 3).cast("string")), "allowed_vendor_scopes": F.array(F.lit("acme"))})
    return FL.access_decisions(rows).select("doc_id", "user_id", "reason")


@query("FLT-12", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' AND user_id = 7")
def optional_filters(spark, d):
    return FL.optional_filter(K.table(spark, d, "events"), event_type="error", user_id=7, props=None).select("event_id", "event_type", "user_id")


@query("FLT-13", O.sql("""
SELECT h.chunk_id AS hit_id, n.chunk_id FROM atomics h JOIN (SELECT *, row_number() OVER (PARTITION BY document_id, page_index ORDER BY chunk_id) AS rn FROM atomics) n
USING (document_id, page_index)"""))
def page_neighbours(spark, d):
    a = K.atomics(spark, d)
    return FL.page_neighbours(a, a).select("hit_id", "chunk_id")


@query("FLT-13", O.sql("""
SELECT h.chunk_id AS hit_id, e.kind, e.evidence_id FROM atomics h JOIN (
  SELECT 'chunk' AS kind, chunk_id AS evidence_id, document_id, page_index FROM atomics
  UNION ALL SELECT 'table', 'tbl-doc-' || doc_id || '-0-0', 'doc-' || doc_id, 0 FROM documents
  UNION ALL SELECT 'figure', 'fig-doc-' || doc_id || '-0-0', 'doc-' || doc_id, 0 FROM documents) e USING (document_id, page_index)"""))
def page_evidence(spark, d):
    """Everything on the page of each chunk: chunks, tables and figures."""
    a, docs = K.atomics(spark, d), K.documents(spark, d)
    side = lambda kind: docs.select(F.concat(F.lit(f"{kind}-"), "document_id", F.lit("-0-0")).alias("evidence_id"), "document_id", F.lit(0).alias("page_index"))
    return FL.page_evidence(a, a, side("tbl"), side("fig")).select("hit_id", "kind", "evidence_id")


@query("FLT-13", O.sql("""
SELECT DISTINCT kind, e.evidence_id, e.document_id, e.page_index FROM (
  SELECT 'chunk' AS kind, chunk_id AS evidence_id, document_id, page_index FROM atomics
  UNION ALL SELECT 'table', 'tbl-doc-' || doc_id || '-0-0', 'doc-' || doc_id, 0 FROM documents
  UNION ALL SELECT 'figure', 'fig-doc-' || doc_id || '-0-0', 'doc-' || doc_id, 0 FROM documents) e
WHERE evidence_id IN (SELECT chunk_id FROM atomics) OR evidence_id IN (SELECT CASE WHEN item_id % 2 = 0 THEN 'tbl' ELSE 'fig' END || '-doc-' || item_id || '-0-0' FROM benchmark)"""))
def source_lookups(spark, d):
    a, docs, n = K.atomics(spark, d), K.documents(spark, d), F.col("item_id")
    side = lambda kind: docs.select(F.concat(F.lit(f"{kind}-"), "document_id", F.lit("-0-0")).alias("evidence_id"), "document_id", F.lit(0).alias("page_index"))
    other = F.concat(F.when(n % 2 == 0, "tbl").otherwise("fig"), F.lit("-doc-"), n.cast("string"), F.lit("-0-0"))
    wanted = a.select(F.col("chunk_id").alias("evidence_id")).unionByName(K.table(spark, d, "benchmark").select(other.alias("evidence_id")))
    return FL.source_lookup(wanted, a, side("tbl"), side("fig")).select("kind", "evidence_id", "document_id", F.col("page_index").cast("int").alias("page_index")).distinct()


@query("RET-10", sql("SELECT query_id, chunk_id FROM exacts"))
def exact_candidates(spark, d):
    return R.exact_candidates(K.plans(spark, d), I.exact_ids(K.chunks(spark, d)))


@query("RET-11", sql("SELECT query_id, chunk_id, fused_score, exact_hit FROM cands"))
def candidate_cut(spark, d):
    return candidate_plan(spark, d).select("query_id", "chunk_id", "fused_score", "exact_hit")


@query("RET-12 RET-13", sql("SELECT query_id, chunk_id, rank, rerank_score FROM reranked"))
def rerank(spark, d):
    return reranked(spark, d).select("query_id", "chunk_id", "rank", "rerank_score")


@query("RET-14 RET-20", sql("SELECT query_id, chunk_id, rank, rerank_score, array_to_string(merged, '|') AS merged FROM final"))
def parent_expansion(spark, d):
    return final(spark, d).select("query_id", "chunk_id", "rank", "rerank_score", F.array_join("merged", "|").alias("merged"))


@query("RET-21", sql("SELECT p.query_id, round(coalesce(avg(rerank_score), 0)::DECIMAL(18, 8), 4)::DOUBLE AS retrieval_score FROM plans p LEFT JOIN final f ON f.query_id = p.query_id GROUP BY p.query_id"))
def retrieval_score(spark, d):
    return R.retrieval_score(final(spark, d), K.plans(spark, d))


def _count(t: str, patterns) -> str:
    return " + ".join(f"len(regexp_extract_all({t}, {O.lit(p)}))" for p in patterns)


_MODELLED = "replace(replace(replace(normalized_text, ' the ', ' Class The '), ' and ', ' Aggregated by '), ' que ', ' Mapping Rule ')"


@query("RET-15", O.sql(f"""
SELECT chunk_id, m >= 4 AND m >= 2 * c AND NOT contains(t, 'ECUC-') AND NOT contains(t, 'Mapping Rule') AS is_model FROM (
  SELECT chunk_id, t, {_count('t', (r'Class [A-Z]\w*',) + V.MODEL_MARKERS[1:])} - len(regexp_extract_all(t, 'Traffic Class [A-Z]\\w*')) AS m, {_count('t', V.CONFIG_MARKERS)} AS c
  FROM (SELECT chunk_id, section_title || chr(10) || {_MODELLED} AS t FROM chunks))"""))
def model_structure(spark, d):
    t = F.col("normalized_text")
    for a, b in ((" the ", " Class The "), (" and ", " Aggregated by "), (" que ", " Mapping Rule ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return K.chunks(spark, d).select("chunk_id", R.is_model_structure(F.col("section_title"), t).alias("is_model"))


_QW = "list_distinct(regexp_extract_all(lower(q), '[a-z0-9_]+'))"
_NORM = "regexp_matches(lower(s), 'shall|should|may|must|never|always')"


_COMPRESSED = f"""
SELECT query_id, chunk_id, CASE WHEN len(kept) > 0 THEN array_to_string(list_transform(list_sort(kept), lambda i: ss[i]), ' ') ELSE substr(t, 1, room) END AS compressed FROM (
  SELECT query_id, chunk_id, t, ss, room, list_reduce(order_list, lambda a, x: CASE WHEN a.total >= room OR a.total + x.n > room THEN a
      ELSE {{'total': a.total + x.n, 'n': 0::BIGINT, 'i': 0::BIGINT, 'kept': list_append(a.kept, x.i)}} END, {{'total': 0::BIGINT, 'n': 0::BIGINT, 'i': 0::BIGINT, 'kept': []::BIGINT[]}}).kept AS kept
  FROM (SELECT query_id, chunk_id, t, ss, room, list({{'total': 0::BIGINT, 'n': length(s)::BIGINT, 'i': i::BIGINT, 'kept': []::BIGINT[]}} ORDER BY score DESC, i) AS order_list
    FROM (SELECT query_id, chunk_id, t, ss, room, i, ss[i] AS s, len(list_intersect({_QW}, list_distinct(regexp_extract_all(lower(ss[i]), '[a-z0-9_]+')))) + CASE WHEN {_NORM.replace('lower(s)', 'lower(ss[i])')} THEN 2 ELSE 0 END AS score
      FROM (SELECT f.query_id, f.chunk_id, p.text AS q, c.normalized_text AS t, {O.sentences('c.normalized_text')} AS ss, CASE WHEN intent = 'configuration' THEN 3000 ELSE 1500 END AS room
            FROM final f JOIN plans p USING (query_id) JOIN chunks c USING (chunk_id)), unnest(range(1, len(ss) + 1)) AS u(i))
    GROUP BY ALL))"""


@query("RET-16", sql(_COMPRESSED))
def compressed_evidence(spark, d):
    p = K.plans(spark, d).select("query_id", F.col("text").alias("q"), F.when(F.col("intent") == "configuration", 3000).otherwise(1500).alias("room"))
    rows = final(spark, d).select("query_id", "chunk_id").join(p, "query_id").join(K.chunks(spark, d).select("chunk_id", "normalized_text"), "chunk_id")
    return rows.select("query_id", "chunk_id", R.compress(F.col("normalized_text"), F.col("q"), F.col("room")).alias("compressed"))


_BRANCHED = "SELECT r.*, c.release AS branch FROM reranked r JOIN chunks c USING (chunk_id)"


@query("RET-17", sql("""
SELECT * FROM (SELECT query_id, branch, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY branch, brank, chunk_id) AS rank FROM (
  SELECT query_id, branch, chunk_id, row_number() OVER (PARTITION BY query_id, branch ORDER BY rerank_score DESC, chunk_id) AS brank FROM branched) WHERE brank <= 12)
WHERE rank <= 12""", branched=_BRANCHED))
def release_merge(spark, d):
    from pyspark.sql.window import Window as W

    rows = reranked(spark, d).join(K.chunks(spark, d).select("chunk_id", F.col("release").alias("branch")), "chunk_id")
    w = W.partitionBy("query_id", "branch").orderBy(F.desc("rerank_score"), "chunk_id")
    return R.merge_branches(rows.withColumn("rank", F.row_number().over(w)), F.lit(12)).select("query_id", "branch", "chunk_id", "rank")


@query("RET-18", sql("""
SELECT query_id, hop - 1 AS hop, parts[hop] AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS hop FROM (
  SELECT query_id, CASE WHEN len(ps) = 0 THEN [text] ELSE ps END AS parts FROM (
    SELECT query_id, text, list_concat(CASE WHEN release_mode = 'comparison' THEN list_transform(releases, lambda r: text || ' AUTOSAR ' || r) ELSE []::VARCHAR[] END,
      CASE WHEN len(mods) > 1 THEN list_transform(mods, lambda m: text || ' ' || m) ELSE []::VARCHAR[] END) AS ps
    FROM (SELECT *, CASE WHEN len(modules) > 0 AND substr(query_id, 3)::BIGINT % 8 = 0 THEN list_append(modules, 'Com') ELSE modules END AS mods FROM plans))))"""))
def sub_questions(spark, d):
    n = F.substring("query_id", 3, 20).cast("bigint")
    p = K.plans(spark, d).withColumn("modules", F.when((F.size("modules") > 0) & (n % 8 == 0), F.concat("modules", F.array(F.lit("Com")))).otherwise(F.col("modules")))
    return R.sub_questions(p)


@query("RET-18", sql("""
SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hop, rank, chunk_id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY hop, rank) AS seen FROM (
    SELECT query_id, 0 AS hop, chunk_id, rank FROM bm25_ch WHERE rank <= 12 UNION ALL SELECT query_id, 1, chunk_id, rank FROM cos_ch WHERE rank <= 12
    UNION ALL SELECT query_id, 2, chunk_id, rank FROM reranked WHERE rank <= 12)) WHERE seen = 1)"""))
def hop_merge(spark, d):
    ch = channels(spark, d)
    hop = lambda df, n: df.where("rank <= 12").select("query_id", F.lit(n).alias("hop"), "chunk_id", "rank")
    rows = hop(ch["bm25"], 0).unionByName(hop(ch["dense"], 1)).unionByName(hop(reranked(spark, d), 2))
    return R.merge_hops(rows).select("query_id", "chunk_id", "rank")


@query("RET-19", sql("""
SELECT query_id, chunk_id, rank FROM first_pass ANTI JOIN swap USING (query_id)
UNION ALL SELECT query_id, chunk_id, rank FROM bm25_ch SEMI JOIN swap USING (query_id) WHERE rank <= 12""",
    first_pass="SELECT * FROM reranked WHERE rank <= substr(query_id, 3)::BIGINT % 5",
    n1="SELECT query_id, count(*) AS n FROM first_pass GROUP BY query_id",
    n2="SELECT query_id, count(*) AS n FROM bm25_ch WHERE rank <= 12 GROUP BY query_id",
    swap="SELECT q.query_id FROM qs q LEFT JOIN n1 ON n1.query_id = q.query_id LEFT JOIN n2 ON n2.query_id = q.query_id WHERE coalesce(n1.n, 0) < 3 AND coalesce(n2.n, 0) > coalesce(n1.n, 0)"))
def corrective_retry(spark, d):
    n = F.substring("query_id", 3, 20).cast("bigint")
    first = reranked(spark, d).where(F.col("rank") <= n % 5).select("query_id", "chunk_id", "rank")
    retry = channels(spark, d)["bm25"].where("rank <= 12").select("query_id", "chunk_id", "rank")
    return R.corrective(first, retry, K.questions(spark, d))


@query("RET-22", sql("""
SELECT query_id, chunk_id, class, slot FROM (
  SELECT query_id, chunk_id, class, row_number() OVER (PARTITION BY query_id, class ORDER BY rank) AS slot FROM (
    SELECT *, max(hit) OVER (PARTITION BY query_id) AS any_hit FROM (
      SELECT r.query_id, r.chunk_id, r.rank, list_contains(p.releases, c.release)::INT AS hit,
        CASE WHEN c.chunk_kind = 'context' THEN 'table' WHEN c.page_index % 3 = 1 THEN 'visual' ELSE 'text' END AS class, rerank_score >= 0.3 AS strong, intent = 'comparison' AS visual
      FROM reranked r JOIN plans p USING (query_id) JOIN chunks c USING (chunk_id)))
  WHERE (any_hit = 0 OR hit = 1) AND (class <> 'visual' OR (visual AND strong)))
WHERE slot <= CASE class WHEN 'text' THEN 12 WHEN 'table' THEN 4 ELSE 3 END"""))
def context_budget(spark, d):
    c = K.chunks(spark, d).select(
        "chunk_id", "release", "page_start", F.when(F.col("chunk_kind") == "context", "table").when(F.col("page_index") % 3 == 1, "diagram").otherwise("text").alias("content_type"))
    e = reranked(spark, d).join(c, "chunk_id").select("query_id", "rank", "chunk_id", "release", "page_start", "content_type", F.col("rerank_score").alias("score"), F.lit("").alias("caption"))
    w = K.plans(spark, d).select("query_id", "releases", F.when(F.col("intent") == "comparison", F.array(F.lit("diagram"))).otherwise(F.array(F.lit("text"))).alias("modalities"))
    return R.context_budget(e, w).select("query_id", "chunk_id", "class", "slot")


_V = "list_transform(embedding, lambda v: v::DOUBLE)"


@query("RET-23", f"""
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 6) AS score
  FROM (SELECT vec_id, {_V} AS e FROM embeddings WHERE label = 1) q, (SELECT vec_id, {_V} AS e FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 3 <> 2) v)) WHERE rank <= 5""")
def tenant_vector_search(spark, d):
    n = F.col("vec_id")
    v = I.unit_vectors(K.vectors(spark, d)).withColumns({
        "tenant_id": F.concat(F.lit("tenant-"), (n % 2).cast("string")), "vendor_scope": F.when(n % 3 == 0, "generic").when(n % 3 == 1, "acme").otherwise("other")})
    mine = FL.tenant_filter(v, {"tenant_id": "tenant-1", "allowed_vendor_scopes": ["acme"]})
    q = v.where("label = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    return S.vector_top_k(q, mine.select(F.col("vec_id").alias("chunk_id"), "embedding"), 5)


def index(spark, d):
    no = K.numbers(spark, d)
    pools = K.once_made(spark, d, "pools", lambda: P.pools(K.chunks(spark, d), no))
    posts = I.postings(I.tokenized(I.indexed_text(K.chunks(spark, d))))  # plans, these and the weights: the blocks hold what retrieval reads
    weights = I.tfidf_weights(posts, K.vocabulary(spark, d), K.stats(spark, d))
    return P.Index(K.chunks(spark, d), posts, K.stats(spark, d), K.vocabulary(spark, d), weights,
                   no, K.blocks(spark, d), pools, K.identifiers(spark, d))


_SHOWN = ("query_id", "rank", "chunk_id", "document_id", "release", "fused_score", "rerank_score", "exact_hit", "compressed")


_IS_MODEL = f"""(SELECT m >= 4 AND m >= 2 * g AND NOT contains(t, 'ECUC-') AND NOT contains(t, 'Mapping Rule') FROM (
  SELECT t, {_count('t', (r'Class [A-Z]\w*',) + V.MODEL_MARKERS[1:])} - len(regexp_extract_all(t, 'Traffic Class [A-Z]\\w*')) AS m, {_count('t', V.CONFIG_MARKERS)} AS g
  FROM (SELECT c.section_title || chr(10) || c.normalized_text AS t)))"""
_ALLOWED = "SELECT * FROM chunks WHERE document_id IN (SELECT document_id FROM docs WHERE workspace_id = 'ws-1')"


@query("RET-24 RET-17 RET-19", RS.evidence(VIEWS, _BASE, _IS_MODEL, _COMPRESSED))
def retrieve(spark, d):
    plans = K.plans(spark, d)
    return P.retrieve(plans, QU.variants(plans), index(spark, d)).select(*_SHOWN)


@query("RET-24 QRY-01 QRY-08")
def retrieve_questions(spark, d):
    """From raw questions: corrected, parsed, rewritten, retrieved."""
    return P.ask(K.questions(spark, d), index(spark, d)).select(*_SHOWN)


@query("RET-24 FLT-04", RS.evidence(VIEWS, _BASE, _IS_MODEL, _COMPRESSED, _ALLOWED))
def retrieve_allowed(spark, d):
    """The same batch for an asker who may see one workspace."""
    plans = K.plans(spark, d)
    mine = K.documents(spark, d).where("workspace_id = 'ws-1'").select("document_id")
    return P.retrieve(plans, QU.variants(plans), index(spark, d), allowed=mine).select(*_SHOWN)


@query("RET-18 RET-24")
def retrieve_hops(spark, d):
    """Comparisons and questions on several modules, with sub-questions planned anew."""
    plans = K.plans(spark, d)
    return P.retrieve(plans, QU.variants(plans), index(spark, d), P.Flags(use_multi_hop=True)).select(*_SHOWN)


@query("RET-25")
def ablation(spark, d):
    plans = K.plans(spark, d)
    return P.ablation(plans, QU.variants(plans), index(spark, d), K.gold(spark, d))
