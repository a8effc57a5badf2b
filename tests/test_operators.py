"""Graph, diff, guard, code, mining, evaluation, verification, sources and streams on small fixtures."""

import difflib
import itertools

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import metrics as M
from corpuscle.functions import text as T
from corpuscle.operators import code as CO
from corpuscle.operators import evaluation as E
from corpuscle.operators import filters as FL
from corpuscle.operators import graph as G
from corpuscle.operators import guard as GD
from corpuscle.operators import keyed as KY
from corpuscle.operators import mining as MI
from corpuscle.operators import questions as QU
from corpuscle.operators import verification as VE
from corpuscle.sources import files as SF
from corpuscle.sources import tables as ST
from corpuscle.operators import ranking as R
from corpuscle.streaming import streams as SS


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


CHUNK = "chunk_id string, document_id string, source_pdf string, module string, chunk_kind string, normalized_text string, requirement_ids array<string>, api_names array<string>, ecu_parameters array<string>"


def graph(spark, rows):
    c = G.signals(spark.createDataFrame(rows, CHUNK))
    docs = spark.createDataFrame([("d1", "Spec", "a.pdf")], "document_id string, title string, source_pdf string")
    return G.nodes(c, docs, "s"), G.contains_edges(c).unionByName(G.co_mentions(c))


def test_graph_build(spark):
    rows = [("c1", "d1", "a.pdf", "CanIf", "atomic", "CanIf_Init meets SWS_CANIF_1 and SWS_CANIF_2.", ["SWS_CANIF_1", "SWS_CANIF_2", "SWS_"], ["CanIf_Init", "SWS_CANIF_1", "E_OK"], ["CanIfCtrlMode"])]
    n, e = graph(spark, rows)
    assert {r.node_id for r in n.collect()} == {"document:d1", "module:CanIf", "requirement:SWS_CANIF_1", "requirement:SWS_CANIF_2", "api:CanIf_Init", "ecuc:CanIfCtrlMode"}
    rel = {(r.src, r.rel, r.dst, r.is_inferred) for r in e.collect()}
    assert ("requirement:SWS_CANIF_1", "references", "requirement:SWS_CANIF_2", True) in rel
    assert ("api:CanIf_Init", "satisfies", "requirement:SWS_CANIF_1", True) in rel
    assert G.trace_links(e.where("rel <> 'contains'")).first().link_id.startswith("tr-satisfies::")


def test_trace_questions(spark):
    rows = [
        ("c1", "d1", "a.pdf", "", "atomic", "CanIf_Init implements SWS_CANIF_00072 here.", ["SWS_CANIF_00072"], ["CanIf_Init"], []),
        ("c2", "d1", "a.pdf", "", "atomic", "Upstream requirements of SWS_CANIF_00072: SWS_CANIF_00073.", ["SWS_CANIF_00072", "SWS_CANIF_00073"], [], []),
    ]
    n, e = graph(spark, rows)
    e = e.where("rel <> 'contains'")
    q = spark.createDataFrame(
        [("a", "Which APIs satisfy SWS_CANIF_00072?"), ("b", "Which requirements does SWS_CANIF_00072 reference?"), ("c", "What connects to CanIf_Init?"), ("d", "Which APIs satisfy SWS_NONE_1?")],
        "query_id string, text string")
    got = {(r.query_id, r.kind, r.id) for r in G.trace_answers(q, n, e).collect()}
    ids = lambda q, kind: {i for x, k, i in got if (x, k) == (q, kind)}
    assert "api:CanIf_Init" in ids("a", "node") and ids("a", "chunk") == {"c1"}
    assert "requirement:SWS_CANIF_00073" in ids("b", "node") and ids("b", "chunk") == {"c2"}
    assert "requirement:SWS_CANIF_00072" in ids("c", "node")
    assert ids("d", "node") == {"requirement:SWS_NONE_1"} and not ids("d", "edge")


def test_every_hop_is_kept(spark):
    plans = spark.createDataFrame([("q", "text", "comparison", ["1", "2", "3"], ["A", "B", "C"])], "query_id string, text string, release_mode string, releases array<string>, modules array<string>")
    assert R.sub_questions(plans).count() == 6 and R.sub_questions(plans, 4).count() == 4
    rows = spark.createDataFrame([("q", h, f"c{h}", 1) for h in range(5)] + [("q", 4, "c0", 2)], "query_id string, hop int, chunk_id string, rank int")
    assert [r.chunk_id for r in R.merge_hops(rows).orderBy("rank").collect()] == ["c0", "c1", "c2", "c3", "c4"]


def test_neighbourhood_hops(spark):
    e = spark.createDataFrame([("1", "a", "r", "b"), ("2", "b", "r", "c"), ("3", "c", "s", "d"), ("4", "a", "r", "a")], "edge_id string, src string, rel string, dst string")
    seeds = spark.createDataFrame([("a",)], "node_id string")
    seen, touched = G.neighbourhood(seeds, e, 2)
    assert {(r.node_id, r.hop) for r in seen.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.edge_id for r in touched.collect()} == {"1", "2", "4"}


def test_record_diff(spark):
    mk = lambda rows: spark.createDataFrame([(k, v, [k]) for k, v in rows], "entity_key string, normalized string, evidence_ids array<string>")
    d = KY.diff_records(mk([("A", "1"), ("C", "0"), ("D", "5")]), mk([("A", "2"), ("B", "x"), ("D", "5")]), "api")
    assert {r.entity_key: r.change_type for r in d.collect()} == {"A": "modified", "B": "added", "C": "removed", "D": "unchanged"}


def test_upsert_last_wins(spark):
    mk = lambda rows: spark.createDataFrame(rows, "k int, v string, seq int")
    got = KY.upsert(mk([(1, "a", 0), (2, "b", 0)]), mk([(2, "x", 1), (2, "y", 2), (3, "z", 1)]), "k", "seq")
    assert {r.k: r.v for r in got.collect()} == {1: "a", 2: "y", 3: "z"}


def test_redaction_and_restore(spark):
    text = "contact a@b.com ecu 10.1.2.3 and a@b.com for Brake-ECU1"
    r = one(spark, GD.redact(F.lit(text)))
    assert "<EMAIL_001>" in r.redacted and "10.1.2.3" not in r.redacted and "Brake-ECU1" not in r.redacted and r.tokens
    back = spark.createDataFrame([(r.redacted, r.tokens)], "t string, m array<struct<token:string,value:string>>").select(GD.restore(F.col("t"), F.col("m")).alias("x")).first().x
    assert back == text
    assert one(spark, GD.redact(F.lit("ecu 10.1.2.3"), parity=True)).redacted == "ecu <INTERNAL_IP_001>.3"


def test_code_scan(spark):
    src = '#include "x.h"\nvoid f(){ char *p = malloc(4); goto end; end:; }\nRte_Read_Speed_Value(a); Rte_Read_Speed_Value(b);'
    f = spark.createDataFrame([("a.c", src)], "path string, text string")
    hits = CO.advisory_scan(f).collect()
    assert {(h.rule, h.line) for h in hits} == {("missing-memmap", 1), ("dynamic-allocation", 2), ("goto", 2)}
    assert all("Advisory finding" in h.message and "compliant" not in h.message for h in hits)
    assert CO.call_sites(f).first().calls == ["Rte_Read_Speed_Value"] * 2
    ports = spark.createDataFrame([("Speed Value",), ("Brake",), ("ee",)], "port string")
    calls = spark.createDataFrame([("Rte_Read_Speed_Value",)], "call string")
    assert {r.port for r in CO.call_port_matches(calls, ports).collect()} == {"Speed Value", "ee"} - {"ee"} | ({"ee"} if "ee" in "rtereadspeedvalue" else set())


def test_sarif(spark):
    doc = '{"runs":[{"tool":{"driver":{"name":"T","version":"2"}},"results":[{"ruleId":"R1","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a.c"},"region":{"startLine":3}}}]},{"message":{"text":"n"}}]}]}'
    rows = SF.sarif_findings(spark.createDataFrame([("p", doc)], "path string, text string")).collect()
    assert {(r.rule, r.level, r.location) for r in rows} == {("T/R1", "tool_reported", "a.c:3"), ("T/external-rule", "tool_reported", "")}


def test_arxml(spark):
    xml = ('<A xmlns="http://x/r4.0"><AR-PACKAGE><SHORT-NAME>Pkg</SHORT-NAME><ELEMENTS><APPLICATION-SW-COMPONENT-TYPE><SHORT-NAME>BrakeCtrl</SHORT-NAME><PORTS>'
           '<R-PORT-PROTOTYPE><SHORT-NAME>VehicleSpeed</SHORT-NAME><REQUIRED-INTERFACE-TREF>/Pkg/VehSpeed_I</REQUIRED-INTERFACE-TREF></R-PORT-PROTOTYPE>'
           '<P-PORT-PROTOTYPE><SHORT-NAME>BrakeCmd</SHORT-NAME><PROVIDED-INTERFACE-TREF>/Pkg/Brake_I</PROVIDED-INTERFACE-TREF></P-PORT-PROTOTYPE></PORTS>'
           '<RUNNABLE-ENTITY><SHORT-NAME>RE_Calc</SHORT-NAME></RUNNABLE-ENTITY></APPLICATION-SW-COMPONENT-TYPE>'
           '<SENDER-RECEIVER-INTERFACE><SHORT-NAME>VehSpeed_I</SHORT-NAME></SENDER-RECEIVER-INTERFACE></ELEMENTS></AR-PACKAGE></A>')  # fmt: skip
    bad = '<!DOCTYPE foo [<!ENTITY x "y">]><AUTOSAR></AUTOSAR>'
    e = SF.arxml_entities(spark.createDataFrame([("g", bytearray(xml, "utf8")), ("b", bytearray(bad, "utf8"))], "path string, content binary"))
    got = {(r.entity, r.qualified_name, r.ref) for r in e.collect()}
    assert ("port", "/Pkg/BrakeCtrl/VehicleSpeed", "/Pkg/VehSpeed_I") in got and ("component", "/Pkg/BrakeCtrl", None) in got
    assert ("interface", "/Pkg/VehSpeed_I", None) in got and ("rejected", None, None) in got
    edges = G.topology_graph(e)[1].collect()
    assert any(r.rel == "HAS_PORT" for r in edges) and not any(r.is_inferred for r in edges)


def parse(spark, text):
    return QU.parsed(spark.createDataFrame([("q", text)], "query_id string, text string")).first()


def test_question_plans(spark):
    p = parse(spark, "What does CanIf_Init do in 4.4?")
    assert (p.release_mode, p.releases, p.api_names) == ("exact", ["4.4"], ["CanIf_Init"]) and "CanIf" in p.modules
    assert parse(spark, "difference between 4.2.2 and 4.4.0").intent == "comparison"
    assert parse(spark, "why does it fail").intent == "troubleshooting"
    assert parse(spark, "complete communication component").modules == []
    assert set(parse(spark, "diag DTC handling").modules) >= {"Dem", "Dcm"}
    assert parse(spark, "Explain SWS_COM_00001").intent == "requirement_lookup"


def test_spelling(spark):
    rows = [("a", "Wich requirment of can if"), ("b", "Rte_Init and SWS_COM_1 config"), ("c", "pdu router comunication")]
    got = {r.query_id: r.corrected for r in QU.corrected(spark.createDataFrame(rows, "query_id string, text string")).collect()}
    assert got["a"] == "Which requirement of CanIf"
    assert got["b"] == "Rte_Init and SWS_COM_1 configuration"
    assert got["c"] == "PduR communication"


def test_fuzzy_words_equal_a_plain_search(spark):
    toks = ["requirment", "comunicate", "initialze", "troubleshot", "paramter", "zzzzzz", "componet"]
    got = {r.core: r.fixed for r in QU.close_words(spark.createDataFrame([(t,) for t in toks], "core string")).collect()}
    want = {t: (difflib.get_close_matches(t, QU.FUZZY_WORDS, n=1, cutoff=0.86) or [None])[0] for t in toks}
    assert got == {k: v for k, v in want.items() if v}


def clusters_by_force(sets, t):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        u = sets[a] | sets[b]
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(u) >= t - 1e-12:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("t", [0.3, 0.4, 0.55])
def test_clusters_match_brute_force_with_a_hot_word(spark, t):
    import random

    rng = random.Random(int(t * 100))
    words = [f"w{i}" for i in range(25)]
    sets = {f"id{n:03d}": set(rng.sample(words, rng.randint(1, 9))) | ({"hot"} if n % 3 == 0 else set()) for n in range(90)}
    log = spark.createDataFrame([(k, " ".join(sorted(v))) for k, v in sets.items()], "id string, query string")
    got = {r.id: r.cluster for r in MI.similarity_clusters(log, t).collect()}
    assert got == clusters_by_force(sets, t)


def test_cluster_ranking_puts_failures_first(spark):
    log = spark.createDataFrame([("1", "how does com route signals", "ABSTAIN", "x"), ("2", "how com routes the signals route", "ABSTAIN", "x"), ("3", "weather tomorrow", "ANSWERED", "y")],
                                "id string, query string, outcome string, intent string")
    r = MI.cluster_ranking(log, MI.similarity_clusters(log, 0.4)).orderBy(F.desc("score")).collect()
    assert [x["size"] for x in r] == [2, 1] and r[0].score == 12 and r[0].members == ["1", "2"]


def test_metrics(spark):
    r = E.ranking_metrics(
        spark.createDataFrame([("q", 1, "a"), ("q", 2, "x"), ("e", 1, "z")], "query_id string, rank int, id string"),
        spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, id string"),
        spark.createDataFrame([("q",), ("e",), ("n",)], "query_id string"))
    rows = {x.query_id: x for x in r.collect()}
    assert (rows["q"].context_recall, rows["q"].mrr, rows["q"].hit_rate) == (0.5, 1.0, 1.0)
    assert (rows["n"].recall_at_k, rows["e"].recall_at_k, rows["e"].hit_rate) == (1.0, 0.0, None)
    assert one(spark, M.citation_recall(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a")))) == 0.5
    low, high = M.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 0.0)
    assert one(spark, M.rouge1_f1(F.lit("bus bus frame"), F.lit("bus frame frame"))) == pytest.approx(0.6667)
    assert one(spark, M.claim_supported(F.lit("CanIf_Init starts"), F.lit("x canif_init y"))) is True


def test_hallucinated_identifiers(spark):
    a, ev = F.lit("CanIf_Init and Com_Send"), F.array(F.lit("only canif_init"))
    assert one(spark, M.hallucinated_ids(a, ev)) == ["Com_Send"] and one(spark, M.hallucinated_rate(a, ev)) == 0.5


def test_split_refuses_a_changed_set(spark):
    g = spark.createDataFrame([(f"q{i}", "x") for i in range(50)], "query_id string, question string")
    split, fp = E.freeze_split(g), E.golden_fingerprint(g)
    assert E.split_problems(g.repartition(3), split, fp).isEmpty()
    with pytest.raises(ValueError):
        E.scored_split(g.limit(10), split, fp, "holdout")


def test_verification(spark):
    draft = "## Direct answer\nCom is a module. [E1]\n## More\nIt routes many signals today. Yes."
    d = spark.createDataFrame([("q", draft), ("n", "It routes many signals today.")], "query_id string, draft string")
    ev = spark.createDataFrame([("q", 1, "c1", "4.4.0", "Classic")], "query_id string, rank int, chunk_id string, release string, platform string")
    plans = spark.createDataFrame([("q", ["4.2.2"], "exact", []), ("n", [], "none", [])], "query_id string, releases array<string>, release_mode string, platforms array<string>")
    claims = VE.claim_rows(d)
    assert [r.claim for r in claims.where("query_id = 'q'").orderBy("claim_no").collect()] == ["Com is a module. [E1]", "It routes many signals today."]
    v = {(r.query_id, r.claim_no): r for r in VE.verdicts(claims, ev, plans).collect()}
    assert v[("q", 0)].supported and not v[("q", 0)].version_consistent and v[("q", 0)].support_score == 0.4 and v[("q", 1)].risk == "high"
    s = VE.support(VE.verdicts(claims, ev, plans), d).withColumns({"retrieval_score": F.lit(0.5), "evidence_total": F.lit(3)})
    c = {r.query_id: r for r in VE.confidence(s).collect()}
    assert c["n"].should_abstain and not c["q"].should_abstain


def test_access(spark):
    rows = spark.createDataFrame([("t1", "generic"), ("t1", "acme"), ("t2", "generic")], "tenant_id string, vendor_scope string")
    with pytest.raises(PermissionError):
        FL.tenant_filter(rows, {})
    assert FL.tenant_filter(rows, {"tenant_id": "t1"}).count() == 1
    assert FL.tenant_filter(rows, {"tenant_id": "t1"}, {"tenant_id": "t2"}).count() == 0
    pair = spark.createDataFrame([("u", "t1", None, ["a"], "t2", None, None), ("u", "t1", None, ["a"], "t1", None, "b"), ("", "t1", None, [], None, None, None), ("u", "t1", None, ["a"], "t1", None, "a")],
                                 "user_id string, tenant_id string, project_id string, allowed_vendor_scopes array<string>, r_tenant_id string, r_project_id string, r_vendor_scope string")
    assert [r.allowed for r in FL.access_decisions(pair).collect()] == [False, False, False, True]


def test_golden_round_trip_and_bad_lines(spark, tmp_path):
    good = tmp_path / "g"
    good.mkdir()
    (good / "a.jsonl").write_text('{"query_id": "1", "question": "x", "tags": ["a", "b"]}\n\n{"query_id": "2", "question": "y"}\n')
    g = ST.read_golden(spark, str(good))
    assert g.count() == 2
    ST.write_golden(g, str(tmp_path / "out"))
    assert ST.read_golden(spark, str(tmp_path / "out")).exceptAll(g).isEmpty()
    assert ST.review_rows(g).where("query_id = '1'").first().tags == "a | b"
    (good / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        ST.read_golden(spark, str(good)).collect()


def test_discovery_ignores_case(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.pdf", "sub/b.PDF", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert SF.discover(spark, str(tmp_path)).count() == 2


def test_stream_ingest_keeps_the_last_row_and_survives_a_second_run(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    write = lambda rows: spark.createDataFrame(rows, "k int, seq int, v string").coalesce(1).write.mode("append").parquet(src)
    write([(1, 1, "a"), (2, 1, "b")])
    read = lambda: spark.readStream.schema("k int, seq int, v string").parquet(src)
    SS.ingest(read(), out, ck, "k", "seq").awaitTermination()
    write([(1, 2, "z")])
    SS.ingest(read(), out, ck, "k", "seq").awaitTermination()
    assert {r.k: r.v for r in SS.current(spark, out, "k", "seq").collect()} == {1: "z", 2: "b"}


def test_streamed_rates_drop_nothing_in_order(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as ts, 'u' as client from range(30)").write.parquet(src)
    q = SS.request_rates(spark.readStream.schema("ts timestamp, client string").parquet(src), limit=20).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select max(n) n from rates").first().n == 30 and spark.sql("select count(*) c from rates where above").first().c > 0


def test_slotted_arrivals_equal_a_plain_window(spark):
    e = spark.sql("select timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id * 17 % 4000) as ts, 'u' || id % 2 as client, id from range(400)")
    got = {r.id: r.n for r in SS.arrivals(e, "id", 60, 300).collect()}
    rows = e.collect()
    want = {r.id: sum(1 for s in rows if s.client == r.client and 0 <= (r.ts - s.ts).total_seconds() <= 60) for r in rows}
    assert got == want


def test_document_metadata(spark):
    r = one(spark, T.release_and_platform(F.lit("AUTOSAR CP R22-11"), F.lit("x.pdf")))
    assert (r.release, r.platform) == ("R22-11", "Classic")
    r = one(spark, T.release_and_platform(F.lit("release 4.3.1 text"), F.lit("x.pdf")))
    assert (r.release, r.platform) == ("4.3.1", "Classic")
    assert one(spark, T.document_type(F.lit("AUTOSAR_FO_PRS_E2E.pdf"))) == "PRS"
