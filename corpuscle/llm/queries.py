"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import bitsliced, codes, decontaminate, licenses, minhash, packing, quality, repeats, rules, secrets, toxicity, trie, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on four-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: fixed patterns and entropy spans."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document; a third of the ids, and rows without one, never train."""
    feats = quality.featured(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").filter(quality.not_held_out())
    out = quality.scored(feats, quality.train(labels, feats))
    return out.select("doc_id", F.coalesce(~quality.not_held_out(), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item and its best window."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "window", "matched")


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _mask_sql(src: str, key: str) -> str:
    parts = []
    for k, m in enumerate(decontaminate.MASKS):
        chosen = " || ' ' || ".join(f"h[i + {p + 1}]" for p, c in enumerate(m) if c == "1")
        parts.append(f"SELECT {key}, i AS pos, '{k} ' || {chosen} AS seed FROM (SELECT {key}, h, unnest(range(0, len(h) - {len(m) - 1})) AS i FROM {src})")
    return " UNION ALL ".join(parts)


#: Items are longer than the longest mask in all given tables; the tests cover shorter ones by brute force.
SQL["op8_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS h FROM documents), b AS (SELECT item_id, {_WORDS} AS h FROM benchmark),
ds AS ({_mask_sql('d', 'doc_id')}), bs AS ({_mask_sql('b', 'item_id')}),
hit AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.pos - bs.pos AS diag FROM ds JOIN bs USING (seed)),
cut AS (SELECT doc_id, item_id, least(20, len(b.h)) AS wd,
  list_transform(range(0, least(len(d.h) - greatest(diag, 0), len(b.h) - greatest(-diag, 0))),
    lambda j: CASE WHEN d.h[greatest(diag, 0) + j + 1] = b.h[greatest(-diag, 0) + j + 1] THEN 1 ELSE 0 END) AS same
  FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
sums AS (SELECT doc_id, item_id, wd, list_max(list_transform(range(0, len(same) - wd + 1), lambda s: list_sum(same[s + 1 : s + wd]))) AS matched
  FROM cut WHERE len(same) >= wd)
SELECT doc_id, item_id, CAST(max(wd) AS INTEGER) AS "window", CAST(max(matched) AS INTEGER) AS matched
FROM sums WHERE matched >= wd - floor(wd * {decontaminate.TOLERANCE}) GROUP BY doc_id, item_id
"""


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products for every fiftieth vector, over all others."""
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL["op9_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS a FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, a FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, q.a AS qa, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.a, c.a), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qa ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by rule or by link-graph propagation."""
    return urls.verdicts(table(spark, sf_dir, "pages"))


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
    cut = lambda c: f"regexp_extract({c}, '(?s)^.*?://(.*)$', 1)"
    low = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = urls._LINK.replace("'", "''")
    return f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {rules}) r(rh, rp, rv)),
u AS (SELECT page_id, coalesce({cut("coalesce(url, '')")}, '') AS rest, row_number() OVER () AS rid, html FROM pages),
p AS (SELECT page_id, rid, html, {low("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fit AS (SELECT rid, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid),
j AS (SELECT p.*, rule, rv FROM p LEFT JOIN fit USING (rid)),
seeds AS (SELECT CASE rv WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, CAST(count(*) AS DOUBLE) AS weight
  FROM j WHERE rv IS NOT NULL AND host <> '' GROUP BY 1, 2),
l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM p),
lh AS (SELECT DISTINCT src, {low(f"regexp_extract({cut('CASE WHEN starts_with(link, chr(47) || chr(47)) THEN chr(58) || link ELSE link END')}, '^([^/?#]*)', 1)")} AS dst FROM l),
e AS (SELECT 'trust' AS kind, src, dst FROM lh WHERE src <> '' AND dst <> '' AND src <> dst
  UNION ALL SELECT 'distrust', dst, src FROM lh WHERE src <> '' AND dst <> '' AND src <> dst),
deg AS (SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS n FROM e),
m(kind, host, mass) AS (SELECT kind, host, {1 - urls.DAMPING} * weight FROM seeds
  UNION ALL SELECT m.kind, e.dst, sum(m.mass * {urls.DAMPING} / e.n) FROM m JOIN deg e ON m.kind = e.kind AND m.host = e.src WHERE m.mass > 1e-30 GROUP BY m.kind, e.dst),
h AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS d FROM m GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(rv, CASE WHEN d > 0 AND d >= {urls.RATIO * (1 - urls.MARGIN)} * t THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN h ON j.host = h.host
"""


SQL["op10_urls"] = _url_sql()


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, paragraphs and lines whose entire text is a known licence or notice."""
    return licenses.matches(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    quoted = lambda s: s.replace("'", "''")

    def canon(c: str) -> str:
        s = f"trim(regexp_replace(lower(regexp_replace({c}, '{quoted(licenses.COPYRIGHT_LINE)}', '', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for pattern, one in licenses.SPELLINGS:
            # This dialect has no look-ahead: the digit is captured and put back.
            s = f"regexp_replace({s}, '{pattern.replace('(?=[0-9])', '([0-9])')}', '{one + (chr(92) + '1') * ('(?=' in pattern)}', 'g')"
        return s

    values = ", ".join(f"('{name}', '{quoted(text)}')" for name, text in licenses.KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license, {canon('t')} AS c FROM (VALUES {values}) k(license, t)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, 'document' AS unit, 0 AS position, text AS part FROM d WHERE text <> ''
  UNION ALL SELECT doc_id, 'paragraph', i - 1, ps[i] FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS ps FROM d) WHERE len(ps) > 1)
  UNION ALL SELECT doc_id, 'line', i - 1, ls[i] FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d) WHERE len(ls) > 1))
SELECT doc_id, unit, CAST(position AS INTEGER) AS position, license FROM u JOIN known ON {canon('part')} = c
"""


SQL["op1_licenses"] = _license_sql()


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document from its nearest labelled examples; a fifth of the ids, and rows without one, never train."""
    train = table(spark, sf_dir, "labels").filter(quality.not_held_out(folds=5, held=0)).select("doc_id", F.col("toxic").alias("y"))
    out = toxicity.scores(table(spark, sf_dir, "documents"), train)
    held = F.coalesce(~quality.not_held_out(folds=5, held=0), F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines")


@query
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that stand elsewhere too."""
    return repeats.cut_repeats(table(spark, sf_dir, "documents"))


@query
def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures and verdicts of every document, by thresholds of its language and source."""
    return rules.verdicts(table(spark, sf_dir, "documents"))


def _rules_sql() -> str:
    case = lambda values: "CASE rate " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
    lower, upper = ({k: str(v[i]).upper() for k, v in rules.RATES.items()} for i in (0, 1))
    fine, bits = rules.FINE, rules.FINE.bit_length()
    shift = f"greatest(bucket // {fine} - 1, 0)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ 	-
]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i : i + {rules.WINDOW - 1}], ' ') AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {rules.WINDOW - 2})) AS i FROM w)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, CAST(sum(step) AS BIGINT) AS n FROM (SELECT rid, least({rules.WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {rules.WINDOW})) AS step FROM hit) GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
r AS (SELECT rid, lang, source, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS rate,
  unnest([CASE WHEN word_chars > 0 THEN n_symbols * 10000 // word_chars END, CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines END,
    CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words END, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words END]) AS v FROM m),
b AS (SELECT lang, source, rate, sh * {fine} + (v >> sh) AS bucket FROM (SELECT *, greatest(length(bin(v)) - {bits}, 0) AS sh FROM r WHERE v IS NOT NULL)),
k AS (SELECT lv AS level, CASE WHEN lv < 2 THEN lang END AS lang, CASE WHEN lv < 1 THEN source END AS source, rate, bucket, count(*) AS n
  FROM b, (VALUES (0), (1), (2)) l(lv) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM k),
q AS (SELECT level, lang, source, rate, min(CASE WHEN 4 * upto >= total THEN (bucket - {shift} * {fine}) << {shift} END) AS q1,
  min(CASE WHEN 4 * upto >= 3 * total THEN ((bucket - {shift} * {fine} + 1) << {shift}) - 1 END) AS q3
  FROM c GROUP BY ALL HAVING max(total) >= {rules.LEAST}),
f AS (SELECT level, lang, source, rate, CASE WHEN {case(lower)} THEN q1 - {rules.REACH} * greatest(q3 - q1, {case(rules.SPREAD)}) END AS lo,
  CASE WHEN {case(upper)} THEN q3 + {rules.REACH} * greatest(q3 - q1, {case(rules.SPREAD)}) END AS hi FROM q),
o AS (SELECT r.rid, r.rate, r.v < f.lo OR r.v > f.hi AS beyond, row_number() OVER (PARTITION BY r.rid, r.rate ORDER BY f.level) AS nth
  FROM r JOIN f ON r.rate = f.rate AND CASE f.level WHEN 0 THEN f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source
    WHEN 1 THEN f.lang IS NOT DISTINCT FROM r.lang ELSE TRUE END),
x AS (SELECT rid, string_agg(rate, ',' ORDER BY list_position(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length'], rate)) AS beyond
  FROM o WHERE nth = 1 AND beyond GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND x.rid IS NULL AS kept, coalesce(x.beyond, '') AS beyond
FROM m LEFT JOIN x USING (rid)
"""


SQL["op13_rules"] = _rules_sql()


@query
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-byte codes of all vectors, with their errors."""
    return codes.encode(table(spark, sf_dir, "embeddings"))


def _codes_sql(rounds: int = 4) -> str:
    near = lambda k: f"""n{k} AS MATERIALIZED (SELECT rid, q, min({{'d': d, 'e': e}}) AS m FROM (SELECT p.rid, p.q, b.e,
  coalesce(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS d FROM p JOIN b{k} b USING (q)) GROUP BY rid, q)"""  # noqa: E731
    steps = []
    for k in range(rounds):
        steps += [near(k), f"""b{k + 1} AS MATERIALIZED (SELECT b.q, b.e, coalesce(u.v, b.v) AS v FROM b{k} b LEFT JOIN (
  SELECT q, e, list(c ORDER BY i) AS v FROM (SELECT q, m.e AS e, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS c
    FROM n{k} JOIN (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM p) USING (rid, q) GROUP BY ALL) GROUP BY q, e) u USING (q, e))"""]
    steps.append(near(rounds))
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS a FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, q, a[q * (len(a) // 4) + 1 : (q + 1) * (len(a) // 4)] AS v FROM (SELECT *, unnest(range(4)) AS q FROM k)),
b0 AS MATERIALIZED (SELECT q, rid - 1 AS e, v FROM p WHERE rid <= 256),
{', '.join(steps)},
r AS (SELECT rid, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY q) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM n{rounds} GROUP BY rid),
s AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY q, e, i)) AS codebooks_sha256 FROM (SELECT q, e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT codebooks_sha256 FROM s) AS codebooks_sha256
FROM r JOIN k USING (rid)
"""


SQL["op11_codes"] = _codes_sql()


@query
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie.trie(table(spark, sf_dir, "conversations"))


def _trie_sql() -> str:
    bit = "list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor({}, {}))"
    crc = f"xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)), lambda z, b: {bit.format('z', 'b')}, CAST(4294967295 AS BIGINT)), 4294967295)"
    return f"""
WITH t AS (SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS nb,
  sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, d, nb, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) - 1 AS pos FROM t),
l AS (SELECT c, n, {crc} % 9 AS h FROM (SELECT c, count(*) AS n, CAST(c AS VARCHAR) AS s FROM o GROUP BY c)),
b AS (SELECT l.*, least(l.h, coalesce(m.n, 0)) AS has FROM l LEFT JOIN l m ON m.c = l.c - l.c % 5),
r AS (SELECT c, has + pos - h AS pos, d, nb FROM o JOIN b USING (c) WHERE pos >= h
  UNION ALL SELECT b.c, o.pos, o.d, o.nb FROM b JOIN o ON o.c = b.c - b.c % 5 AND o.pos < b.h),
p AS (SELECT b.c, count(d) AS n, coalesce(string_agg(d, '' ORDER BY pos), '') AS path, list(nb ORDER BY pos) AS sizes FROM b LEFT JOIN r USING (c) GROUP BY b.c),
e AS (SELECT c, n, k, left(path, 64 * k) AS pre, coalesce(sizes[k], 0) AS nb FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM p)),
v AS MATERIALIZED (SELECT k, pre, min(c) AS c, count(*) AS n, max(nb) AS nb, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = k) AS ends FROM e GROUP BY k, pre),
kids AS (SELECT k - 1 AS k, left(pre, 64 * (k - 1)) AS pre, count(*) AS n_children FROM v WHERE k > 0 GROUP BY ALL),
f AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN kids USING (k, pre)),
s AS (SELECT j AS k, left(pre, 64 * j) AS pre, sum((n - 1) * nb) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM f) GROUP BY ALL)
SELECT f.c AS conv_id, CAST(f.k AS BIGINT) AS depth, u.c AS parent_conv_id, f.n AS n_convs, f.n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s USING (k, pre) LEFT JOIN v u ON u.k = f.k - 1 AND u.pre = left(f.pre, 64 * (f.k - 1))
"""


SQL["op12_trie"] = _trie_sql()
