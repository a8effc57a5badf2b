"""The corpus rules of ``plans/corpus.py`` as SQL views, for checking results on DuckDB.

``sql(body)`` prefixes a query with the named views it mentions, directly or through others.
"""

from __future__ import annotations

import re

from corpuscle.functions import vocab as V
from corpuscle.plans.corpus import PLATFORMS, RELEASES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(V.WS_CHARS)})"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, {lit(V.WS + '+')}, ' ', 'g')")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(V.WS + '+')}), lambda w: w <> '')"


def found(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {lit(pattern)}, {group})"


def distinct_sorted(x: str, n: int | None = None) -> str:
    out = f"list_sort(list_distinct({x}))"
    return f"{out}[1:{n}]" if n else out


def sha12(*parts: str) -> str:
    return f"substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 12)"


def tokens(x: str) -> str:
    broken = f"regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    subs = f"regexp_extract_all({broken}, '[A-Z]?[a-z0-9]+|[A-Z]+')"
    both = f"list_concat(regexp_extract_all({x}, {lit(V.TOKEN)}), {subs})"
    return f"list_transform(list_filter({both}, lambda t: length(t) > 1), lambda t: lower(t))"


def content_tokens(x: str) -> str:
    stop = "[" + ", ".join(lit(w) for w in V.STOP_WORDS) + "]"
    lowered = f"list_transform(regexp_extract_all(coalesce({x}, ''), {lit(V.WORD)}), lambda w: lower(w))"
    return f"list_filter({lowered}, lambda w: NOT list_contains({stop}, w))"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def identifiers(x: str) -> str:
    t = f"coalesce({x}, '')"
    both = f"list_concat(list_concat({found(t, V.EVAL_REQ)}, {found(t, V.EVAL_API)}), {found(t, V.EVAL_CAMEL)})"
    return ordered_distinct(both)


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def case(x: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(str(k))} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def values(name: str, columns: str, rows) -> str:
    def one(v):
        return lit(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}({columns})"


_cap = "upper(substr(source, 1, 1)) || substr(source, 2)"
_spec = lambda k: f"'SWS_' || upper(source) || '_' || lpad(({k})::VARCHAR, 5, '0')"
_kept = (
    f"list_filter(regexp_split_to_array(raw, {lit(V.LINE_BREAK)}), lambda l: {strip('l')} <> '' AND NOT "
    f"(regexp_matches({strip('l')}, {lit(V.FURNITURE)}) AND length({strip('l')}) < 120))"
)
_carried = "document_id, release, platform, module, source_pdf"
_sig = "requirement_ids, api_names, ecu_parameters"

VIEWS: dict[str, str] = {
    "docs": f"""
        SELECT 'doc-' || doc_id AS document_id, doc_id, lang, source || '.pdf' AS source_pdf,
               {case("((doc_id // 100 + doc_id) % 4)::VARCHAR", dict(enumerate(RELEASES)))} AS release,
               {case("lang", PLATFORMS)} AS platform, source AS module,
               'ws-' || (doc_id % 3) AS workspace_id, 'user-' || (doc_id % 5) AS owner_user_id,
               {_spec("doc_id % 50")} || ' refers to ' || {_spec("(doc_id + 7) % 50")} || ' and requires ' || {_cap}
               || '_Init with ' || {_cap} || 'Config. ' || text AS text, text AS body
        FROM documents""",
    "raw_pages": f"""
        SELECT {_carried}, (generate_subscripts(lines, 1) - 1)::INT AS page_index, unnest(lines) AS raw
        FROM (SELECT *, string_split(text, chr(10)) AS lines FROM docs)""",
    "norm_pages": f"""
        SELECT {_carried}, page_index, raw,
               {strip(f"regexp_replace(array_to_string({_kept}, chr(10)), '[ \\t]+', ' ', 'g')")} AS text
        FROM raw_pages""",
    "paras": f"""
        SELECT {_carried}, page_index, (generate_subscripts(ps, 1) - 1)::INT AS para, unnest(ps) AS ptext
        FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(text, {lit(chr(10) + V.WS + "*" + chr(10))}),
              lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM norm_pages)""",
    "signals": f"""
        SELECT *, {words('ptext')} AS ws,
               {distinct_sorted(f"list_concat({found('ptext', V.REQ_A, 1)}, {found('ptext', V.REQ_B, 1)})", 100)} AS requirement_ids,
               {distinct_sorted(f"list_filter({found('ptext', V.API_SIG, 1)}, lambda a: length(a) <= 64)", 50)} AS api_names,
               {distinct_sorted(found('ptext', V.ECUC, 1), 50)} AS ecu_parameters,
               coalesce({found('ptext', V.HEADING, 1)}[1], '') AS section_number,
               coalesce({strip(found('ptext', V.HEADING, 2) + '[1]')}, '') AS section_title
        FROM paras WHERE length(ptext) >= 40""",
    "atomics": f"""
        SELECT 'chunk-' || {sha12('document_id', 'page_index::VARCHAR', 'para::VARCHAR', 'word_offset::VARCHAR')} AS chunk_id,
               {_carried}, page_index, para, word_offset, page_index + 1 AS page_start, page_index + 1 AS page_end,
               section_number, section_title, {_sig}, text, text AS normalized_text, 'atomic' AS chunk_kind
        FROM (SELECT *, array_to_string(ws[word_offset + 1:word_offset + 220], ' ') AS text
              FROM (SELECT *, unnest(range(0, len(ws), 220))::INT AS word_offset FROM signals))
        WHERE length(text) >= 40""",
    "seq": f"""
        SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_index, para, word_offset) AS pos,
               len({words('text')}) AS n FROM atomics""",
    "numbered": """
        SELECT document_id, pos, 0 AS grp, n AS total FROM seq WHERE pos = 1
        UNION ALL
        SELECT s.document_id, s.pos, r.grp + (r.total >= 600)::INT, CASE WHEN r.total >= 600 THEN s.n ELSE r.total + s.n END
        FROM numbered r JOIN seq s ON s.document_id = r.document_id AND s.pos = r.pos + 1""",
    "placed": "SELECT s.*, r.grp FROM seq s JOIN numbered r USING (document_id, pos)",
    "contexts": f"""
        SELECT 'chunk-' || {sha12('document_id', "'ctx'", 'first_id', 'last_id')} AS chunk_id, * EXCLUDE (first_id, last_id, members),
               {collapse('text')} AS normalized_text, 'context' AS chunk_kind
        FROM (SELECT {_carried}, grp, count(*) AS members, arg_min(chunk_id, pos) AS first_id, arg_max(chunk_id, pos) AS last_id,
                     arg_min(page_index, pos) AS page_index, arg_min(para, pos) AS para, arg_min(word_offset, pos) AS word_offset,
                     arg_min(page_start, pos) AS page_start, arg_max(page_end, pos) AS page_end,
                     arg_min(section_number, pos) AS section_number, arg_min(section_title, pos) AS section_title,
                     list_sort(list_distinct(flatten(list(requirement_ids)))) AS requirement_ids,
                     list_sort(list_distinct(flatten(list(api_names)))) AS api_names,
                     list_sort(list_distinct(flatten(list(ecu_parameters)))) AS ecu_parameters,
                     string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text
              FROM placed GROUP BY {_carried}, grp) WHERE members >= 2""",
    "chunks": f"""
        SELECT p.chunk_id, {', '.join('p.' + c.strip() for c in _carried.split(','))}, p.page_index, p.page_start, p.page_end,
               p.section_number, p.section_title, p.requirement_ids, p.api_names, p.ecu_parameters, p.text, p.normalized_text,
               p.chunk_kind, c.chunk_id AS parent_chunk_id
        FROM placed p LEFT JOIN contexts c ON c.document_id = p.document_id AND c.grp = p.grp
        UNION ALL
        SELECT chunk_id, {_carried}, page_index, page_start, page_end, section_number, section_title, {_sig}, text,
               normalized_text, chunk_kind, NULL FROM contexts""",
    "toks": f"SELECT chunk_id, {tokens(chr(115) + 'ection_title || chr(32) || normalized_text')} AS tokens FROM chunks",
    "posts": """
        SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS len, unnest(tokens) AS term FROM toks)
        GROUP BY ALL""",
    "cstats": "SELECT count(*) AS n, avg(len(tokens)) AS avg_len FROM toks",
    "dfs": "SELECT term, count(*) AS df FROM posts GROUP BY term",
    "vocab": "SELECT * FROM dfs",
    "wraw": """
        SELECT chunk_id, p.term, (0.5::DOUBLE + 0.5::DOUBLE * tf / max(tf) OVER (PARTITION BY chunk_id)) AS f, df
        FROM posts p LEFT JOIN vocab v ON v.term = p.term""",
    "weights": """
        SELECT chunk_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY chunk_id)) AS w
        FROM (SELECT chunk_id, term, f * (ln((n + 1) / (df + 1)) + 1) AS x FROM wraw, cstats WHERE df IS NOT NULL)""",
    "qs": "SELECT 'q-' || item_id AS query_id, text FROM benchmark",
    "qterms": f"""
        SELECT query_id, term, count(*) AS tf, max(count(*)) OVER (PARTITION BY query_id) AS max_tf
        FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM qs) GROUP BY query_id, term""",
    "bm25s": """
        SELECT query_id, chunk_id,
               round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score
        FROM (SELECT DISTINCT query_id, term FROM qterms) q JOIN posts p USING (term) JOIN dfs USING (term), cstats
        GROUP BY query_id, chunk_id""",
    "cosines": """
        SELECT query_id, chunk_id, round(sum(wq * w), 6) AS score
        FROM (SELECT query_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS wq
              FROM (SELECT query_id, q.term, (0.5::DOUBLE + 0.5::DOUBLE * q.tf / q.max_tf) * (ln((n + 1) / (df + 1)) + 1) AS x
                    FROM qterms q JOIN vocab v ON v.term = q.term, cstats)) q
        JOIN weights USING (term) GROUP BY query_id, chunk_id""",
    "bm25_ch": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25s) WHERE rank <= 100",
    "cos_ch": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cosines) WHERE rank <= 100",
    "golds": "SELECT query_id, document_id FROM qs q JOIN docs d ON contains(d.body, q.text)",
    "qlog": """
        SELECT concat_ws('-', 'log', c.conv_id, c.turn) AS id, c.conv_id, c.turn, c.text AS query, a.text AS answer,
               CASE WHEN a.text IS NULL THEN 'CLARIFY' WHEN length(a.text) < 120 THEN 'ABSTAIN' WHEN length(a.text) < 300 THEN 'PARTIAL'
                    ELSE 'ANSWERED' END AS outcome,
               CASE c.conv_id % 3 WHEN 0 THEN 'definition' WHEN 1 THEN 'configuration' ELSE 'unknown' END AS intent
        FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant'
        WHERE c.role = 'user'""",
}


def sql(body: str, **views: str) -> str:
    """``body`` with a WITH clause of the views it needs, in dependency order."""
    known = {**VIEWS, **views}
    order: list[str] = []

    def need(text: str, seen: tuple = ()) -> None:
        for name in re.findall(r"\b[a-z][a-z0-9_]*\b", text):
            if name in known and name not in order and name not in seen:
                need(known[name], seen + (name,))
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    keep = lambda n: "" if n == "numbered" else " MATERIALIZED"
    head = ",\n".join(f"{n}{'(document_id, pos, grp, total)' if n == 'numbered' else ''} AS{keep(n)} ({known[n]})" for n in order)
    return f"WITH RECURSIVE {head}\n{body}"
