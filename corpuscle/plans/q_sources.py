"""Queries: sources, sinks and incremental forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuscle.operators import graph as G
from corpuscle.operators import index as I
from corpuscle.operators import ingest as N
from corpuscle.operators import keyed as KY
from corpuscle.operators import segments as SG
from corpuscle.plans import corpus as K
from corpuscle.plans import oracle as O
from corpuscle.plans.q_eval import GOLDEN, diagnosed, golden, sql
from corpuscle.plans.registry import query
from corpuscle.session import shared_dir
from corpuscle.sources import files as SF
from corpuscle.sources import tables as ST
from corpuscle.streaming import limits as SL
from corpuscle.streaming import streams as SS


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SRC-01")
def discovered_files(spark, d):
    """The table files of the given folder."""
    return SF.discover(spark, d, "parquet").select(F.substring_index("path", "/", -1).alias("name"), "length")


_EXT = "CASE doc_id % 5 WHEN 0 THEN 'c' WHEN 1 THEN 'arxml' WHEN 2 THEN 'JSON' WHEN 3 THEN 'pdf' ELSE 'toml' END"


def project_rows(spark, d):
    n = F.col("doc_id") % 5
    ext = F.when(n == 0, "c").when(n == 1, "arxml").when(n == 2, "JSON").when(n == 3, "pdf").otherwise("toml")
    folder = F.when(F.col("doc_id") % 7 == 0, ".git").otherwise("src")
    path = F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return K.spread(K.table(spark, d, "documents")).select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))


@query("SRC-03 SRC-04", f"""
SELECT path, CASE WHEN e = 'pdf' THEN NULL ELSE 'code' END AS kind, text FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN '.git' ELSE 'src' END || '/' || doc_id || '.' || {_EXT} AS path, lower({_EXT}) AS e, text, doc_id FROM documents)
WHERE e <> 'pdf' AND doc_id % 7 <> 0""")
def project_files(spark, d):
    return SF.project_files(project_rows(spark, d)).select("path", "kind", SF.file_text(F.col("content")).alias("text"))


@query("SRC-05", O.sql("SELECT query_id, question, category, answerable, array_to_string(tags, '|') AS tags FROM golden", golden=GOLDEN))
def golden_lines(spark, d):
    path = scratch(spark, "golden")
    ST.write_golden(golden(spark, d), path)
    return ST.read_golden(spark, path).select("query_id", "question", "category", "answerable", F.array_join("tags", "|").alias("tags"))


@query("SRC-06", O.sql("SELECT query_id, category, array_to_string(tags, ' | ') AS tags FROM golden WHERE length(question) % 2 = 0", golden=GOLDEN))
def pending_reviews(spark, d):
    g = golden(spark, d)
    path = scratch(spark, "review")
    ST.review_rows(g).withColumn("review_decision", F.when(F.length("question") % 2 == 0, " ").otherwise("keep")).write.option("header", True).option("escape", '"').csv(path)
    return ST.pending_reviews(ST.read_review(spark, path)).select("query_id", "category", F.coalesce("tags", F.lit("")).alias("tags"))


@query("SRC-07", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '|' || lang ELSE '' END AS ids FROM documents")
def decoded_lists(spark, d):
    n = F.col("doc_id") % 3
    raw = F.when(n == 0, F.to_json(F.array("source", "lang"))).when(n == 1, "{not json")
    rows = K.table(spark, d, "documents").select("doc_id", raw.alias("requirement_ids"))
    return ST.decoded_lists(rows, ("requirement_ids",)).select("doc_id", F.array_join("requirement_ids", "|").alias("ids"))


@query("SRC-08", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'second' WHEN o_orderkey % 2 = 0 THEN 'first' ELSE o_orderstatus END AS v FROM orders""")
def keyed_upsert(spark, d):
    o = K.table(spark, d, "orders")
    old = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.lit(0).alias("seq"))
    k = F.col("o_orderkey")
    new = o.where(k % 2 == 0).select(k.alias("k"), F.lit("first").alias("v"), F.lit(1).alias("seq")).unionByName(
        o.where(k % 3 == 0).select(k.alias("k"), F.lit("second").alias("v"), F.lit(2).alias("seq")))
    return KY.upsert(old, new, "k", "seq").select("k", "v")


@query("SRC-09", O.sql("SELECT chunk_id, term, tf, len, true AS fresh FROM posts"))
def saved_index(spark, d):
    path = scratch(spark, "index")
    c = K.chunks(spark, d)
    I.save_index(c, path)
    t = I.load_index(spark, path)
    rows = t["postings"].drop("len").join(t["lengths"], "chunk_id")
    return rows.select("chunk_id", "term", "tf", "len", F.lit(I.index_is_fresh(c, t["fingerprint"])).alias("fresh"))


@query("SRC-09", O.sql("SELECT chunk_id, term, tf, len, df FROM posts JOIN vocab USING (term)"))
def index_upkeep(spark, d):
    """An index in segments of half the documents, brought up to date with all of them."""
    path = scratch(spark, "segments")
    c = K.chunks(spark, d)
    SG.refresh(c.where(F.pmod(F.xxhash64("document_id"), F.lit(2)) == 0), path, segments=16)
    SG.refresh(c, path)
    return SG.live(spark, path, "postings").join(SG.vocabulary(spark, path), "term").select("chunk_id", "term", "tf", "len", "df")


@query("SRC-10", """
SELECT 'lint/' || event_type AS rule, 'tool_reported' AS level, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'u' || user_id || '.c:' || CASE WHEN event_id % 3 = 1 THEN event_id::VARCHAR ELSE '?' END END AS location, props AS message, 'sarif:lint:1.0' AS provenance FROM events""")
def sarif_findings(spark, d):
    n = F.col("event_id") % 3
    region = F.struct(F.when(n == 1, F.col("event_id")).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".c")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("event_type").alias("ruleId"), F.struct(F.col("props").alias("text")).alias("message"), F.when(n != 0, F.array(place)).alias("locations"))
    tool = F.struct(F.struct(F.lit("lint").alias("name"), F.lit("1.0").alias("version")).alias("driver"))
    run = F.struct(tool.alias("tool"), F.array(result).alias("results"))
    reports = K.table(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), F.to_json(F.struct(F.array(run).alias("runs"))).alias("text"))
    return SF.sarif_findings(reports).select("rule", "level", "location", "message", "provenance")


def xml_files(spark, d):
    """One description per supplier: components, ports, a runnable, an interface, a connector, a parameter; some not well formed."""
    k = F.col("s_suppkey").cast("string")
    doctype = F.when(F.col("s_suppkey") % 9 == 4, '<!DOCTYPE a [<!ENTITY x "y">]>').otherwise("")
    xml = F.concat(
        doctype, F.lit("<AUTOSAR><AR-PACKAGES><AR-PACKAGE><SHORT-NAME>Pkg"), k, F.lit("</SHORT-NAME><ELEMENTS><APPLICATION-SW-COMPONENT-TYPE><SHORT-NAME>Ctrl"), k,
        F.lit("</SHORT-NAME><PORTS><R-PORT-PROTOTYPE><SHORT-NAME>Speed</SHORT-NAME><REQUIRED-INTERFACE-TREF>/Pkg/Speed_I</REQUIRED-INTERFACE-TREF></R-PORT-PROTOTYPE>"
              "<P-PORT-PROTOTYPE><SHORT-NAME>Brake</SHORT-NAME></P-PORT-PROTOTYPE></PORTS><RUNNABLE-ENTITY><SHORT-NAME>RE_Calc</SHORT-NAME></RUNNABLE-ENTITY></APPLICATION-SW-COMPONENT-TYPE>"
              "<ATOMIC-SW-COMPONENT-TYPE><SHORT-NAME>Atom</SHORT-NAME><INTERNAL-BEHAVIOR><SHORT-NAME>IB</SHORT-NAME></INTERNAL-BEHAVIOR></ATOMIC-SW-COMPONENT-TYPE>"
              "<SENDER-RECEIVER-INTERFACE><SHORT-NAME>Speed_I</SHORT-NAME><DATA-ELEMENTS><VARIABLE-DATA-PROTOTYPE><SHORT-NAME>v</SHORT-NAME></VARIABLE-DATA-PROTOTYPE></DATA-ELEMENTS>"
              "</SENDER-RECEIVER-INTERFACE><ASSEMBLY-SW-CONNECTOR><SHORT-NAME>C</SHORT-NAME><PROVIDER-IREF><TARGET-P-PORT-REF>Brake"
              "</TARGET-P-PORT-REF></PROVIDER-IREF><REQUESTER-IREF><TARGET-R-PORT-REF>Lost"), k,
        F.lit("</TARGET-R-PORT-REF></REQUESTER-IREF></ASSEMBLY-SW-CONNECTOR><ECUC-NUMERICAL-PARAM-VALUE><DEFINITION-REF>/Ecuc/Rate</DEFINITION-REF><VALUE>"), k,
        F.lit("</VALUE></ECUC-NUMERICAL-PARAM-VALUE></ELEMENTS></AR-PACKAGE></AR-PACKAGES></AUTOSAR>"),
        F.when(F.col("s_suppkey") % 9 == 7, "<").otherwise(""))
    return K.table(spark, d, "supplier").select(F.concat(F.lit("arch/"), k, F.lit(".arxml")).alias("path"), F.encode(xml, "UTF-8").alias("content"))


def entities(spark, d):
    return SF.arxml_entities(xml_files(spark, d))


_GOOD = "SELECT s_suppkey AS k, '/Pkg' || s_suppkey || '/Ctrl' || s_suppkey AS c FROM supplier WHERE s_suppkey % 9 NOT IN (4, 7)"


@query("SRC-11", f"""
WITH good AS ({_GOOD})
SELECT 'arch/' || k || '.arxml' AS path, e.* FROM good, LATERAL (
  SELECT 'component' AS entity, c AS qualified_name, 'APPLICATION-SW-COMPONENT-TYPE' AS kind, '' AS parent, '' AS ref, '' AS value
  UNION ALL SELECT 'component', '/Pkg' || k || '/Atom', 'ATOMIC-SW-COMPONENT-TYPE', '', '', '' UNION ALL SELECT 'behaviour', '/Pkg' || k || '/Atom/IB', '', '/Pkg' || k || '/Atom', '', ''
  UNION ALL SELECT 'data_element', '/Pkg' || k || '/Speed_I/v', '', '/Pkg' || k || '/Speed_I', '', ''
  UNION ALL SELECT 'port', c || '/Speed', 'R', c, '/Pkg/Speed_I', '' UNION ALL SELECT 'port', c || '/Brake', 'P', c, '', ''
  UNION ALL SELECT 'runnable', c || '/RE_Calc', '', c, '', '' UNION ALL SELECT 'interface', '/Pkg' || k || '/Speed_I', 'sender_receiver', '', '', ''
  UNION ALL SELECT 'connector', '/Pkg' || k || '/C', 'assembly', '', 'Brake', '' UNION ALL SELECT 'parameter', '/Ecuc/Rate', '', '/Pkg' || k, '', k::VARCHAR) e
UNION ALL SELECT 'arch/' || s_suppkey || '.arxml', 'rejected', '', CASE WHEN s_suppkey % 9 = 7 THEN 'malformed' ELSE '' END, '', '', '' FROM supplier WHERE s_suppkey % 9 IN (4, 7)""")
def architecture_entities(spark, d):
    value = F.when(F.col("entity") == "rejected", "").otherwise(F.col("value")).alias("value")  # the reader's message is not compared
    e = entities(spark, d).select("path", "entity", "qualified_name", "kind", "parent", "ref", value)
    return e.select("path", "entity", *[F.coalesce(c, F.lit("")).alias(c) for c in ("qualified_name", "kind", "parent", "ref", "value")])


@query("GRF-07", f"""
WITH good AS ({_GOOD})
SELECT rel, dst, count(*) AS n FROM (
  SELECT 'CONTAINS' AS rel, 'swc:' || c AS dst FROM good UNION ALL SELECT 'CONTAINS', 'swc:/Pkg' || k || '/Atom' FROM good UNION ALL SELECT 'CONTAINS', 'runnable:' || c || '/RE_Calc' FROM good
  UNION ALL SELECT 'HAS_PORT', 'port:' || c || '/Speed' FROM good UNION ALL SELECT 'HAS_PORT', 'port:' || c || '/Brake' FROM good
  UNION ALL SELECT 'REFERENCES_INTERFACE', 'interface:/Pkg/Speed_I' FROM good UNION ALL SELECT 'ASSEMBLY_CONNECTS', 'port:Brake' FROM good) GROUP BY rel, dst""")
def architecture_graph(spark, d):
    e = G.topology_graph(entities(spark, d))[1]
    return e.groupBy("rel", "dst").agg(F.count("*").alias("n"))


@query("GRF-08", "SELECT 'Lost' || s_suppkey AS ref FROM supplier WHERE s_suppkey % 9 NOT IN (4, 7)")
def unresolved_references(spark, d):
    return G.unresolved_references(entities(spark, d)).select("ref")


@query("TXT-28", f"""
WITH good AS ({_GOOD})
SELECT 'SWC Ctrl' || k || ' [APPLICATION-SW-COMPONENT-TYPE]: Speed, Brake' || chr(10) || 'SWC Atom [ATOMIC-SW-COMPONENT-TYPE]: ' || chr(10) || 'CONN [assembly]: Brake -> Lost' || k || chr(10) || 'ECUC /Ecuc/Rate = ' || k AS summary FROM good""")
def topology_summary(spark, d):
    return N.topology_summary(entities(spark, d)).select("summary")


@query("SRC-12", """
SELECT 'res-' || substr(sha256(concat_ws('|', 'run-1', event_id, CASE event_type WHEN 'view' THEN 'passed' WHEN 'error' THEN NULL ELSE event_type END)), 1, 12) AS result_id,
  event_id::VARCHAR AS test_id, CASE event_type WHEN 'view' THEN 'passed' WHEN 'error' THEN 'unknown' ELSE event_type END AS status,
  (SELECT count(*) FROM events) AS total, (SELECT count_if(event_type = 'view') FROM events) AS passed, (SELECT count_if(event_type = 'error') FROM events) AS unknown FROM events""")
def test_result_batch(spark, d):
    e = K.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("test_id"), F.when(F.col("event_type") == "view", "passed").when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("event_type")).alias("status"))
    run, rows = ST.test_result_rows(e, "run-1")
    path = scratch(spark, "results")
    ST.append(rows, path)
    total = run.first()
    return spark.read.parquet(path).select("result_id", "test_id", "status", *[F.lit(total[c]).alias(c) for c in ("total", "passed", "unknown")])


@query("SRC-14", sql("SELECT query_id, failure, failure <> 'ok' AS reported FROM drows"))
def evaluation_sinks(spark, d):
    rows = diagnosed(spark, d)
    path = scratch(spark, "run")
    ST.write_run(rows, rows.agg(F.count("*").alias("n")), path)
    items = spark.read.json(f"{path}/items").select("query_id", "failure")
    bad = spark.read.option("header", True).csv(f"{path}/failures").select("query_id", F.lit(True).alias("bad"))
    return items.join(bad, "query_id", "left").select("query_id", "failure", F.coalesce("bad", F.lit(False)).alias("reported"))


@query("SRC-14", """
SELECT o_orderkey::VARCHAR AS run_id, o_orderdate AS generated_at FROM orders UNION ALL SELECT 'new', max(o_orderdate) FROM orders""")
def run_history(spark, d):
    """All runs of the history with a new one."""
    runs = K.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").alias("generated_at"))
    return ST.run_history(runs, runs.agg(F.lit("new").alias("run_id"), F.max("generated_at").alias("generated_at")))


@query("STR-01", "SELECT event_id % 500 AS k, max(event_id) AS last FROM events GROUP BY 1")
def streamed_ingest(spark, d):
    """The events table read as a stream and kept as the last row per key."""
    path, ck, src = scratch(spark, "ingest"), scratch(spark, "ingest-checkpoint"), f"{d.rstrip('/')}"
    schema = K.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(src)
    SS.ingest(stream.select((F.col("event_id") % 500).alias("k"), "event_id"), path, ck, "k", "event_id").awaitTermination()
    return SS.current(spark, path, "k", "event_id").select("k", F.col("event_id").alias("last"))


@query("STR-02", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events""")
def client_arrivals(spark, d):
    e = K.table(spark, d, "events").select(F.col("user_id").alias("client"), "ts", "event_id")
    return SS.arrivals(e, "event_id", 3600, 6 * 3600).select("event_id", "n")


@query("STR-02", """
SELECT user_id AS client, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (
  SELECT user_id, time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * i) AS start FROM events, range(6) AS r(i)) GROUP BY ALL""")
def sliding_rates(spark, d):
    e = K.table(spark, d, "events").select(F.col("user_id").alias("client"), "ts")
    return SS.request_rates(e).select("client", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_RATE_LIMIT, _RATE_SECONDS = 4, 24 * 3600


@query("STR-02", f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT user_id, event_id, i, [us] AS kept, true AS accepted FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN len(kept) < {_RATE_LIMIT} THEN list_append(kept, us) ELSE kept END, len(kept) < {_RATE_LIMIT} FROM (
    SELECT e.user_id, e.event_id, e.i, e.us, list_filter(r.kept, lambda t: e.us - t < {_RATE_SECONDS}000000) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT event_id, accepted FROM r""")
def accepted_requests(spark, d):
    """Events as requests of which only accepted ones count: at most four of a user in a day."""
    e = K.table(spark, d, "events").select(F.col("user_id").alias("client"), "ts", "event_id")
    return SL.accepted(e, "event_id", _RATE_LIMIT, _RATE_SECONDS).select("event_id", "accepted")


@query("STR-03", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS requests, count_if(event_type = 'error') AS errors, round(avg(value), 4) AS mean_latency FROM events GROUP BY ALL")
def hourly_counters(spark, d):
    e = K.table(spark, d, "events").select("ts", F.col("event_type").alias("outcome"), F.col("value").alias("latency"))
    return SS.counters(e).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("UDF-01")
def encoded_chunks(spark, d):
    """Chunks encoded by the default hashing encoder, and their unit length."""
    v = I.encode_texts(I.indexed_text(K.chunks(spark, d)), I.hashed_encoder(), 64)
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return v.select("chunk_id", F.round(sq, 3).alias("norm"))
