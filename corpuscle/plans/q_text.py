"""Queries: cleaning, signals, metadata, tokens, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions import vocab as V
from corpuscle.operators import chunks as C
from corpuscle.operators import ingest as N
from corpuscle.operators import keyed as KY
from corpuscle.plans import corpus as K
from corpuscle.plans import oracle as O
from corpuscle.plans.registry import query

ARR = lambda c: F.array_join(c, "|")


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


@query("TXT-01 TXT-02", O.sql(f"SELECT document_id, page_index, text, {O.collapse('text')} AS flat FROM norm_pages"))
def normalized_pages(spark, d):
    p = C.normalized_pages(K.pages(spark, d))
    return p.select("document_id", "page_index", "text", T.collapse(F.col("text")).alias("flat"))


@query("TXT-03", f"""
SELECT doc_id, para - 1 AS para, ps[para] AS text FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS para FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', chr(10) || chr(10)), {O.lit(chr(10) + V.WS + "*" + chr(10))}),
         lambda p: {O.strip('p')}), lambda p: p <> '') AS ps FROM documents))""")
def paragraph_split(spark, d):
    t = F.replace(F.col("text"), F.lit(". "), F.lit("\n\n"))
    return K.table(spark, d, "documents").select("doc_id", F.posexplode(T.paragraphs(t)).alias("para", "text"))


@query("TXT-04 TXT-05 TXT-06 TXT-07", O.sql(f"""
SELECT document_id, page_index, para, {joined('requirement_ids')} AS requirement_ids, {joined('api_names')} AS api_names,
       {joined('ecu_parameters')} AS ecu_parameters, section_number, section_title FROM signals"""))
def signal_extraction(spark, d):
    p = C.normalized_pages(K.pages(spark, d))
    paras = p.select("document_id", "page_index", F.posexplode(T.paragraphs(F.col("text"))).alias("para", "t")).where(F.length("t") >= 40)
    head = F.get(T.headings(F.col("t")), F.lit(0))
    t = F.col("t")
    return paras.select(
        "document_id", "page_index", "para", ARR(T.requirement_ids(t)).alias("requirement_ids"),
        ARR(T.api_names(t)).alias("api_names"), ARR(T.ecu_parameters(t)).alias("ecu_parameters"),
        F.coalesce(head["number"], F.lit("")).alias("section_number"), F.coalesce(head["title"], F.lit("")).alias("section_title"),
    )


_KIND = {"0": "Table", "1": "Figure", "2": "Diagram"}


def _captioned(spark, d):
    """documents' lines as pages, every line captioned by its position."""
    lines = K.documents(spark, d).select("document_id", F.posexplode(F.split("body", "\n")).alias("page_index", "line"))
    kind = F.element_at(T.string_map(_KIND), (F.col("page_index") % 3).cast("string"))
    text = F.concat(kind, F.lit(" "), (F.col("page_index") + 1).cast("string"), F.lit(": "), "line", F.lit("\nend"))
    return lines.select("document_id", "page_index", text.alias("text"))


_CAPTIONED = f"""
SELECT document_id, page_index, {O.case('(page_index % 3)::VARCHAR', _KIND)} || ' ' || (page_index + 1) || ': ' || line || chr(10) || 'end' AS text
FROM (SELECT document_id, (generate_subscripts(ls, 1) - 1)::INT AS page_index, unnest(ls) AS line FROM (SELECT document_id, string_split(body, chr(10)) AS ls FROM docs))"""


def _caps(pattern: str) -> str:
    g = lambda i: f"regexp_extract_all(text, {O.lit(pattern)}, {i})"
    return f"list_transform(list_zip({g(1)}, {g(2)}, {g(3)}), lambda z: {{kind: lower(z[1]), number: z[2], caption: {O.strip('z[3]')}}})"


@query("TXT-08", O.sql(f"""
SELECT document_id, page_index, kind, number, caption FROM (
  SELECT document_id, page_index, unnest(list_concat({_caps(V.TABLE_CAP)}, {_caps(V.FIGURE_CAP)}), max_depth := 2) FROM captioned)""", captioned=_CAPTIONED))
def caption_extraction(spark, d):
    both = F.concat(T.captions(F.col("text"), V.TABLE_CAP), T.captions(F.col("text"), V.FIGURE_CAP))
    return _captioned(spark, d).select("document_id", "page_index", F.explode(both).alias("c")).select("document_id", "page_index", "c.*")


def _flags(t: str) -> str:
    return f"""list_filter([CASE WHEN length({O.strip(t)}) < 200 THEN 'low_text_density' END,
      CASE WHEN regexp_matches({t}, {O.lit(V.BROKEN_CHARS)}) THEN 'broken_encoding' END,
      CASE WHEN len(regexp_extract_all({t}, {O.lit(V.WIDE_GAP)})) > 5 THEN 'possible_table_heavy' END,
      CASE WHEN NOT regexp_matches({t}, '\\b(?:SWS|RS|PRS)_[A-Za-z0-9_]+') AND length({t}) > 2000 THEN 'missing_requirement_ids' END],
      lambda f: f IS NOT NULL)"""


@query("TXT-09", O.sql(f"SELECT document_id, page_index, {joined(_flags('raw'))} AS flags FROM raw_pages"))
def page_quality_flags(spark, d):
    return K.pages(spark, d).select("document_id", "page_index", ARR(T.page_flags(F.col("text"))).alias("flags"))


@query("TXT-25", O.sql(f"""
SELECT document_id, count(*) AS page_count, count_if(list_contains(fl, 'low_text_density')) AS pages_with_low_text,
  sum(t)::BIGINT AS tables_detected, sum(f)::BIGINT AS figures_detected,
  count_if(list_contains(fl, 'low_text_density')) AS low_text_density, count_if(list_contains(fl, 'broken_encoding')) AS broken_encoding,
  count_if(list_contains(fl, 'possible_table_heavy')) AS possible_table_heavy,
  count_if(list_contains(fl, 'missing_requirement_ids')) AS missing_requirement_ids,
  round_even(1.0::DOUBLE - count_if(len(fl) > 0)::DOUBLE / count(*), 4) AS quality_score
FROM (SELECT document_id, {_flags('text')} AS fl, len({_caps(V.TABLE_CAP)}) AS t, len({_caps(V.FIGURE_CAP)}) AS f FROM captioned)
GROUP BY document_id""", captioned=_CAPTIONED))
def quality_report(spark, d):
    return N.quality_report(N.page_quality(_captioned(spark, d)))


@query("TXT-24", O.sql(f"""
SELECT document_id, page_index, content_type, n::INT AS n, quality_score::DOUBLE AS quality_score, requires_review,
  content_type || '-' || document_id || '-' || page_index || '-' || n || '-' || {O.sha12('document_id', 'content_type', 'page_index', 'n', "coalesce(t, '')")} AS content_id
FROM (
 SELECT document_id, page_index, 'text' AS content_type, 0 AS n, CASE WHEN len(fl) > 0 THEN 0.5 ELSE 1.0 END AS quality_score, len(fl) > 0 AS requires_review, text AS t FROM c
 UNION ALL SELECT document_id, page_index, 'table', generate_subscripts(tabs, 1) - 1, 0.8, false, '[]' FROM c
 UNION ALL SELECT document_id, page_index, CASE WHEN g.kind IN ('diagram', 'equation', 'image') THEN g.kind ELSE 'image' END, n, 0.7, false, g.caption
   FROM (SELECT document_id, page_index, generate_subscripts(figs, 1) - 1 AS n, unnest(figs) AS g FROM c))""",
    c=f"SELECT *, {_flags('text')} AS fl, {_caps(V.TABLE_CAP)} AS tabs, {_caps(V.FIGURE_CAP)} AS figs FROM captioned", captioned=_CAPTIONED))
def multimodal_rows(spark, d):
    rows = N.multimodal_rows(N.page_quality(_captioned(spark, d)))
    return rows.select("document_id", "page_index", "content_type", "n", "quality_score", "requires_review", "content_id")


@query("TXT-24 TXT-26", O.sql(f"""
SELECT chunk_id AS content_id, document_id, CASE WHEN len(requirement_ids) > 0 THEN 'requirement' ELSE 'text' END AS content_type,
  CASE WHEN len(requirement_ids) > 0 THEN 'requirements' ELSE 'text' END AS collection, release, platform, module,
  {joined('requirement_ids')} AS requirement_ids, coalesce(parent_chunk_id, '') AS parent_content_id FROM chunks"""))
def chunk_payloads(spark, d):
    return N.chunk_content(K.chunks(spark, d)).select(
        "content_id", "document_id", "content_type", N.collection_of(F.col("content_type")).alias("collection"), "release",
        "platform", "module", ARR("requirement_ids").alias("requirement_ids"),
        F.coalesce("parent_content_id", F.lit("")).alias("parent_content_id"),
    )


_META = "'Specification of ' || platform || ' platform release ' || release || ' ' || body"
_FILE = "CASE doc_id % 3 WHEN 0 THEN 'AUTOSAR_SWS_' WHEN 1 THEN 'AUTOSAR_FO_PRS_' ELSE 'notes_' END || source_pdf"


def _with_meta(spark, d):
    name = F.when(F.col("doc_id") % 3 == 0, "AUTOSAR_SWS_").when(F.col("doc_id") % 3 == 1, "AUTOSAR_FO_PRS_").otherwise("notes_")
    return K.documents(spark, d).select(
        "doc_id",
        F.concat(F.lit("Specification of "), "platform", F.lit(" platform release "), "release", F.lit(" "), "body").alias("t"),
        F.concat(name, "source_pdf").alias("f"),
    )


@query("TXT-10", O.sql("""
SELECT doc_id, coalesce(nullif(regexp_extract(f, 'AUTOSAR_(FO_)?(PRS|RS|SWS|TPS|TR|EXP)', 2), ''), 'unknown') AS document_type,
  CASE WHEN y <> '' THEN 'R' || y || '-11' ELSE x END AS release,
  CASE WHEN y <> '' THEN CASE WHEN named THEN 'Foundation' WHEN cp THEN 'Classic' WHEN contains(low, 'adaptive') THEN 'Adaptive' ELSE 'Foundation' END
       WHEN x <> '' THEN 'Classic' WHEN named THEN 'Foundation' ELSE 'unknown' END AS platform
FROM (SELECT *, regexp_extract(b, 'R(\\d{2})-11', 1) AS y, regexp_extract(b, '\\b4\\.[2-4]\\.\\d\\b') AS x,
        contains(f, 'AUTOSAR_FO_') OR contains(low, 'foundation') AS named,
        regexp_matches(b, 'AUTOSAR\\s+CP\\b') OR contains(low, 'classic platform') AS cp
      FROM (SELECT *, f || chr(10) || t AS b, lower(f || chr(10) || t) AS low FROM meta))""",
    meta=f"SELECT doc_id, {_META} AS t, {_FILE} AS f FROM docs"))
def release_platform_detection(spark, d):
    m = _with_meta(spark, d)
    return m.select("doc_id", T.document_type(F.col("f")).alias("document_type"), T.release_and_platform(F.col("t"), F.col("f")).alias("r")).select(
        "doc_id", "document_type", "r.release", "r.platform")


_LANG_ALIASES = {"the": "En", "and": "En", "of the": "En", "der": "De", "und": "De", "le": "Fr", "des": "Fr", "el": "Es", "los": "Es"}


@query("TXT-11 TXT-12", O.sql("""
SELECT document_id, coalesce(max(CASE WHEN n >= 5 AND r = 1 THEN module END), '') AS module FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, p) AS r FROM (
    SELECT document_id, module, sum(hits) AS n, min(CASE WHEN hits > 0 THEN pos END) AS p FROM (
      SELECT document_id, module, pos,
        (length(marked) - length(replace(marked, chr(2), '')))::BIGINT AS hits
      FROM (SELECT document_id, low, alias, module, pos,
              regexp_replace(regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9])' || replace(alias, ' ', '  ') || '([^a-z0-9]|$)', chr(2), 'g') AS marked
            FROM (SELECT document_id, lower(body) AS low FROM docs), aliases))
    GROUP BY document_id, module)) GROUP BY document_id""",
    aliases=O.values("a", "alias, module, pos", [(a, m, i) for i, (a, m) in enumerate(_LANG_ALIASES.items())])))
def module_inference(spark, d):
    return K.documents(spark, d).select("document_id", N.inferred_module(F.col("body"), _LANG_ALIASES).alias("module"))


@query("TXT-13", O.sql("""
SELECT DISTINCT api, CASE WHEN regexp_matches(lower(split_part(api, '_', 1)), '^src[0-9]$') THEN lower(split_part(api, '_', 1)) ELSE '' END AS module
FROM (SELECT unnest(api_names) AS api FROM signals)"""))
def api_modules(spark, d):
    aliases = {f"src{i}": f"src{i}" for i in range(10)}
    apis = K.atomics(spark, d).select(F.explode("api_names").alias("api")).distinct()
    return apis.select("api", T.module_for_api(F.col("api"), aliases).alias("module"))


@query("TXT-14", """
SELECT doc_id, array_to_string(list_filter(['D', 'C', 'B', 'A', 'QM'], lambda l: list_contains(hits, l)), ',') AS asil FROM (
  SELECT doc_id, list_transform(regexp_extract_all(t, '(?i)\\bASIL\\s*[- ]?\\s*(QM|A|B|C|D)\\b', 1), lambda x: upper(x)) AS hits FROM (
    SELECT doc_id, 'ASIL-' || substr('ABCD', (doc_id % 4 + 1)::INT, 1) || ' ' || replace(replace(text, ' de ', ' asil qm '), ' the ', ' ASIL D ') AS t FROM documents))""")
def asil_detection(spark, d):
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("doc_id") % 4 + 1).cast("int"))
    body = F.replace(F.replace(F.col("text"), F.lit(" de "), F.lit(" asil qm ")), F.lit(" the "), F.lit(" ASIL D "))
    return K.table(spark, d, "documents").select("doc_id", T.asil(F.concat(F.lit("ASIL-"), letter, F.lit(" "), body)).alias("asil"))


@query("TXT-15", O.sql(f"SELECT chunk_id, array_to_string(list_sort({O.tokens('normalized_text')}), ' ') AS tokens FROM atomics"))
def technical_tokens(spark, d):
    return K.atomics(spark, d).select("chunk_id", F.array_join(F.array_sort(T.technical_tokens(F.col("normalized_text"))), " ").alias("tokens"))


@query("TXT-16 TXT-17", O.sql(f"""
SELECT chunk_id, array_to_string({O.content_tokens('normalized_text')}, ' ') AS content, {joined(O.identifiers('normalized_text'))} AS identifiers,
  {joined("list_filter(ex, lambda v, i: list_position(list_transform(ex, lambda y: lower(y)), lower(v)) = i)")} AS exact
FROM (SELECT *, list_concat({O.identifiers('normalized_text')}, regexp_extract_all(normalized_text, {O.lit(V.NUMBER_UNIT)})) AS ex FROM atomics)"""))
def content_and_exact_tokens(spark, d):
    t = F.col("normalized_text")
    return K.atomics(spark, d).select(
        "chunk_id", F.array_join(T.content_tokens(t), " ").alias("content"), ARR(T.identifiers(t)).alias("identifiers"), ARR(T.exact_tokens(t)).alias("exact"))


@query("TXT-18 TXT-19", O.sql(f"""
SELECT document_id, len({O.sentences('clean')}) AS sentences,
  coalesce(list_filter({O.sentences('clean')}, lambda s: contains(lower(s), lower(needle)))[1], clean) AS span
FROM (SELECT document_id, {O.collapse('body')} AS clean, coalesce({O.words('body')}[9], module) AS needle FROM docs)"""))
def verbatim_spans(spark, d):
    docs = K.documents(spark, d).select(
        "document_id", "body", F.size(T.sentences(T.collapse(F.col("body")))).alias("sentences"),
        F.coalesce(F.get(T.words(F.col("body")), F.lit(8)), F.col("module")).alias("needle"))
    return docs.select("document_id", "sentences", T.verbatim_span(F.col("body"), F.col("needle")).alias("span"))


@query("TXT-20 SRC-02", """
SELECT doc_id, 'doc-' || substr(sha256(text), 1, 12) AS content_id, substr(sha256(text), 1, 32) AS content_hash,
  'e-' || substr(sha256('document:' || doc_id || '|contains|module:' || source), 1, 12) AS edge_id FROM documents""")
def content_ids(spark, d):
    edge = F.sha2(F.concat(F.lit("document:"), F.col("doc_id").cast("string"), F.lit("|contains|module:"), "source"), 256)
    return K.table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("doc-"), T.sha12(F.col("text"))).alias("content_id"), T.content_hash(F.col("text")).alias("content_hash"),
        F.concat(F.lit("e-"), F.substring(edge, 1, 12)).alias("edge_id"))


@query("TXT-21", O.sql(f"""
SELECT document_id, {joined(O.distinct_sorted(O.found('t', V.CONTENT_REQ)) + '')} AS refs, {joined(O.distinct_sorted(O.found('t', V.CONTENT_API, 1), 20))} AS apis,
  regexp_matches(t, {O.lit(V.CONTENT_HEADING)}) AS has_heading, CASE WHEN len({O.found('t', V.CONTENT_REQ)}) > 0 THEN 'requirement' ELSE 'text' END AS content_type,
  {joined(f"list_transform({O.found('t', V.MODAL, 1)}, lambda m: lower(m))")} AS modals, regexp_matches(t, {O.lit(V.CONDITION)}) AS has_condition
FROM (SELECT document_id, {O.strip("regexp_replace(replace(text, ' the ', ' shall '), '[ \\t]+', ' ', 'g')")} AS t FROM docs)"""))
def normative_features(spark, d):
    t = F.replace(F.col("text"), F.lit(" the "), F.lit(" shall "))
    return K.documents(spark, d).select("document_id", T.normative_features(t).alias("s")).select(
        "document_id", ARR("s.references").alias("refs"), ARR("s.apis").alias("apis"), "s.has_heading", "s.content_type",
        ARR("s.modals").alias("modals"), "s.has_condition")


@query("TXT-22", O.sql(f"""
SELECT document_id, array_to_string(list_transform(rows, lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) AS table_markdown,
  '<table>' || array_to_string(list_transform(rows, lambda r: '<tr>' || array_to_string(list_transform(r, lambda c: '<td>' || c || '</td>'), '') || '</tr>'), '') || '</table>' AS table_html,
  {joined('rows[1]')} AS headers, len(rows) AS row_count,
  {joined(f"list_filter(flatten(rows), lambda c: regexp_matches({O.strip('c')}, {O.lit(V.IDENTIFIER_CELL)}))")} AS params
FROM (SELECT document_id, list_transform(string_split(body, chr(10)), lambda l: string_split(l, ' | ')) AS rows FROM docs)"""))
def table_features(spark, d):
    rows = F.transform(F.split("body", "\n"), lambda x: F.split(x, r" \| "))
    return K.documents(spark, d).select("document_id", T.table_features(rows).alias("s")).select(
        "document_id", "s.table_markdown", "s.table_html", ARR("s.headers").alias("headers"), "s.row_count", ARR("s.params").alias("params"))


@query("TXT-23", O.sql(f"""
SELECT document_id, page_index, kind, deco AS is_decorative, kind = 'diagram' AND NOT deco AS likely_diagram, caption <> '' AS original_preserved,
  CASE WHEN deco THEN 0.3 ELSE 0.7 END::DOUBLE AS quality_score, {joined(O.distinct_sorted(O.found('caption', V.CONTENT_API, 1), 20))} AS entities
FROM (SELECT *, kind = 'diagram' AND regexp_matches(lower(caption), 'logo|cover|decorat|background') AS deco FROM (
  SELECT document_id, page_index, c.kind AS kind, replace(c.caption, ' the ', ' cover ') AS caption FROM (
    SELECT document_id, page_index, unnest({_caps(V.FIGURE_CAP)}) AS c FROM captioned)))""", captioned=_CAPTIONED))
def visual_features(spark, d):
    none = F.lit(None).cast("string")
    f = _captioned(spark, d).select("document_id", "page_index", F.explode(T.captions(F.col("text"), V.FIGURE_CAP)).alias("c"))
    f = f.select("document_id", "page_index", "c.kind", F.replace("c.caption", F.lit(" the "), F.lit(" cover ")).alias("caption"))
    s = T.visual_features(F.col("kind"), F.col("caption"), none, none, none, none, F.lit(0.7))
    return f.select("document_id", "page_index", "kind", s.alias("s")).select(
        "document_id", "page_index", "kind", "s.is_decorative", "s.likely_diagram", "s.original_preserved", "s.quality_score", ARR("s.entities").alias("entities"))


@query("TXT-27", """
SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN length(text) // 4 ELSE 0 END)::BIGINT AS prompt_tokens,
  sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END)::BIGINT AS completion_tokens,
  round_even((sum(CASE WHEN role <> 'assistant' THEN length(text) // 4 ELSE 0 END) * 3 + sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END) * 15)::DOUBLE / 1000000, 6) AS cost_usd
FROM conversations GROUP BY conv_id""")
def token_cost(spark, d):
    n = T.estimated_tokens(F.col("text"))
    g = K.table(spark, d, "conversations").groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") != "assistant", n).otherwise(0)).alias("prompt_tokens"),
        F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("completion_tokens"))
    return g.withColumn("cost_usd", F.bround((F.col("prompt_tokens") * 3 + F.col("completion_tokens") * 15) / 1000000, 6))


@query("CHK-01", O.sql("SELECT chunk_id, document_id, page_start, page_end, section_title, text FROM atomics"))
def atomic_chunks(spark, d):
    return K.atomic_plan(spark, d).select("chunk_id", "document_id", "page_start", "page_end", "section_title", "text")


@query("CHK-02 CHK-03", O.sql(f"""
SELECT chunk_id, document_id, page_start, page_end, chunk_kind, coalesce(parent_chunk_id, '') AS parent_chunk_id, normalized_text,
  {joined('requirement_ids')} AS requirement_ids, {joined('api_names')} AS api_names, {joined('ecu_parameters')} AS ecu_parameters FROM chunks"""))
def hierarchical_chunks(spark, d):
    return K.chunks(spark, d).select(
        "chunk_id", "document_id", "page_start", "page_end", "chunk_kind", F.coalesce("parent_chunk_id", F.lit("")).alias("parent_chunk_id"),
        "normalized_text", ARR("requirement_ids").alias("requirement_ids"), ARR("api_names").alias("api_names"), ARR("ecu_parameters").alias("ecu_parameters"))


@query("CHK-04", """
SELECT 'ps-' || source || '-' || substr(sha256(path || chr(0) || text), 1, 12) || '-' || block AS chunk_id, path, block,
  '[project:' || source || '] ' || path || CASE WHEN block > 0 THEN ' part' || block ELSE '' END AS section_title, substr(text, (block * 1050 + 1)::INT, 1200) AS text
FROM (SELECT *, unnest(range(0, (length(text) - 1) // 1050 + 1))::INT AS block FROM (SELECT source, 'src/' || source || '/' || doc_id || '.c' AS path, text FROM documents))""")
def file_chunks(spark, d):
    f = K.spread(K.table(spark, d, "documents")).select(
        F.col("source").alias("source_id"), F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".c")).alias("path"),
        F.lit("code").alias("kind"), F.concat(F.lit("project:"), "source").alias("scope"), "text")
    return C.file_chunks(f).select("chunk_id", "path", "block", "section_title", "text")


@query("CHK-05", O.sql(f"""
SELECT c.document_id, c.page_index, c.number, coalesce(f.chunk_id, '') AS chunk_id FROM (
  SELECT document_id, page_index, t.number AS number FROM (SELECT document_id, page_index, unnest({_caps(V.TABLE_CAP)}) AS t FROM captioned)) c
LEFT JOIN (SELECT document_id, page_index, arg_min(chunk_id, para * 1000000 + word_offset) AS chunk_id FROM atomics GROUP BY document_id, page_index) f
  ON f.document_id = c.document_id AND f.page_index = c.page_index""", captioned=_CAPTIONED))
def sidecar_links(spark, d):
    tabs = _captioned(spark, d).select("document_id", "page_index", F.explode(T.captions(F.col("text"), V.TABLE_CAP)).alias("t"))
    linked = C.link_sidecars(tabs.select("document_id", "page_index", "t.number"), K.atomics(spark, d))
    return linked.select("document_id", "page_index", "number", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"))


@query("CHK-06", """
SELECT doc_id, CASE WHEN h <> first_h THEN first_id ELSE -1 END AS supersedes FROM (
  SELECT doc_id, sha256(text) AS h, first_value(sha256(text)) OVER w AS first_h, first_value(doc_id) OVER w AS first_id FROM documents
  WINDOW w AS (PARTITION BY source, lang, n_chars ORDER BY doc_id))""")
def supersession(spark, d):
    docs = K.table(spark, d, "documents").select(
        "doc_id", F.concat_ws("/", "source", "lang", F.col("n_chars").cast("string")).alias("path"), F.sha2("text", 256).alias("content_hash"))
    return KY.supersedes(docs, "path", "doc_id", "content_hash").select("doc_id", F.coalesce("supersedes", F.lit(-1)).alias("supersedes"))


@query("CHK-07", O.sql(f"""
SELECT chunk_id, CASE WHEN page_index % 2 = 0 THEN 'snap-1' ELSE 'snap-0' END AS snapshot_id,
  CASE WHEN page_index % 2 = 0 THEN 'given' ELSE substr(sha256(text), 1, 32) END AS content_hash,
  CASE WHEN page_index % 2 = 0 THEN 0.5 ELSE CASE WHEN doc_id % 3 = 0 THEN 0.8 ELSE 1.0 END END::DOUBLE AS confidence
FROM atomics JOIN (SELECT document_id, doc_id FROM docs) USING (document_id)"""))
def provenance_backfill(spark, d):
    even = F.col("page_index") % 2 == 0
    a = K.atomics(spark, d).withColumns({
        "snapshot_id": F.when(even, "snap-1"), "content_hash": F.when(even, "given"), "confidence": F.when(even, F.lit(0.5))})
    docs = K.documents(spark, d).select("document_id", F.when(F.col("doc_id") % 3 == 0, F.lit(0.8)).alias("confidence"))
    once = C.backfill_provenance(a, docs, "snap-0")
    return C.backfill_provenance(once, docs, "snap-2").select("chunk_id", "snapshot_id", "content_hash", "confidence")


@query("CHK-08", O.sql("""SELECT count(*) AS count, count(DISTINCT chunk_id) AS ids,
  substr(sha256(coalesce(string_agg(chunk_id, '|' ORDER BY chunk_id), '')), 1, 32) AS ids_hash FROM chunks"""))
def corpus_fingerprint(spark, d):
    c = K.chunks(spark, d)
    fp = C.fingerprint(c)
    same = C.fingerprint(c.repartition(3)).exceptAll(fp).isEmpty()
    return fp.select("count", F.when(F.lit(same), F.col("ids")).otherwise(F.lit(0)).alias("ids"), "ids_hash")
