"""Similarity links connect exactly what the threshold connects, whatever the sizes of the sets."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import code as CO
from corpuscle.operators import filters as FL
from corpuscle.operators import guard as GD
from corpuscle.operators import mining as MI
from corpuscle.sources import files as SF


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("t", [0.05, 0.1, 0.2, 0.25, 0.4, 0.5, 0.7, 0.95])
def test_links_connect_what_the_threshold_connects(spark, t):
    rng = random.Random(int(t * 100))
    sets = {}
    for i in range(70):
        size = rng.randrange(1, 21)
        # Few shared words among many own ones: components stay small, so a lost link shows.
        toks = {f"s{rng.randrange(60)}" for _ in range(rng.randrange(0, 4))} | {f"o{i}_{j}" for j in range(size)}
        if i % 5 == 0 and i:
            toks = set(rng.sample(sorted(sets[i - 1]), max(1, len(sets[i - 1]) - 1))) | {f"x{i}"}
        sets[i] = set(sorted(toks)[:20])
    true = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t]
    reps = spark.createDataFrame([(i, sorted(s), len(s)) for i, s in sets.items()], "id long, toks array<string>, n int")
    got = [(r.a, r.b) for r in MI._links(reps, t).collect()]
    assert {tuple(sorted(p)) for p in got} <= set(true)
    assert components(sets, got) == components(sets, true)


@pytest.mark.parametrize("blocks", [1, 3])
def test_pairs_of_frequent_words_are_counted_and_not_joined(spark, monkeypatch, blocks):
    rng = random.Random(blocks)
    sets = {i: {"hot", "warm", "mild", *rng.sample([f"w{x}" for x in range(40)], rng.randrange(0, 6))} for i in range(60)} | {60 + i: {f"own{i}", "few"} for i in range(4)}
    sets = {i: s for i, s in sets.items() if s not in [sets[k] for k in range(i)]}
    reps = spark.createDataFrame([(i, sorted(s), len(s)) for i, s in sets.items()], "id long, toks array<string>, n int")
    monkeypatch.setattr(MI, "LEAST_TOKENS", 1)
    monkeypatch.setattr(MI, "BLOCK_TOKENS", -(-sum(map(len, sets.values())) // blocks))
    monkeypatch.setattr(MI.math, "ceil", lambda _: 1)
    monkeypatch.setattr(MI, "BATCH_PAIRS", 100)
    true = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    for t in (0.2, 0.5):
        want = {p: j for p, j in true.items() if j >= t}
        pairs, links = MI._pairs(reps, t), [(r.a, r.b) for r in MI._links(reps, t).collect()]
        got = [((r.a, r.b), r.jaccard) for r in pairs.collect()]
        assert dict(got) == want and len(got) == len(want)
        assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert components(sets, links) == components(sets, want) and {tuple(sorted(p)) for p in links} <= set(want)
        assert len(links) < (blocks + 1) * len(sets) < len(want) or t > 0.2


def test_a_row_that_comes_twice_keeps_its_links(spark):
    words = lambda k: " ".join([f"own{k}{chr(97 + i)}" for i in range(16)] + ["bus", "frame", "signal", "timer"])
    log = spark.createDataFrame([("a", words("x")), ("a", words("x")), ("b", words("y")), ("c", "other things")], "id string, query string")
    assert {(r.id, r.cluster) for r in MI.similarity_clusters(log, 0.1).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_values_are_replaced_at_their_matches_only(spark):
    text = "host 10.1.2.3 and 110.1.2.34 and 210.1.2.3, a@b.de a@b.de c@d.org Alpha-ECU Beta-ECU1 Alpha-ECU"
    r = spark.createDataFrame([(text,)], "t string").select(GD.redact(F.col("t"), F.lit("host")).alias("r")).first().r
    assert r.redacted == "<PROJECT_001> <INTERNAL_IP_001> and 110.1.2.34 and 210.1.2.3, <EMAIL_001> <EMAIL_001> <EMAIL_002> <PROJECT_002> <PROJECT_003> <PROJECT_002>"
    tokens = [(x.token, x.value) for x in r.tokens]
    assert ("<INTERNAL_IP_001>", "10.1.2.3") in tokens and len(tokens) == 6
    back = spark.createDataFrame([(r.redacted, tokens)], "t string, m array<struct<token:string,value:string>>").select(GD.restore(F.col("t"), F.col("m")).alias("x"))
    assert back.first().x == text


def test_findings_may_span_lines(spark):
    f = spark.createDataFrame([("a.c", "int x;\n  malloc\n (4);\np = new\nT;\n\ngoto end;")], "path string, text string")
    assert sorted((r.line, r.rule) for r in CO.advisory_scan(f).collect()) == [(2, "dynamic-allocation"), (4, "dynamic-allocation"), (6, "goto")]


def test_short_and_differently_cased_needles_find_ids(spark):
    chunks = spark.createDataFrame([("c1", "R1", ["SWS_Com_00001"]), ("c2", "R2", ["SRS_Can_2"])], "chunk_id string, release string, requirement_ids array<string>")
    wanted = spark.createDataFrame([("q1", "Co", ""), ("q2", "sws_com", ""), ("q3", "2", ""), ("q4", "_Ca", "R1"), ("q5", "", "")], "query_id string, needle string, release string")
    got = {(r.query_id, r.chunk_id) for r in FL.requirement_search(chunks, wanted).collect()}
    assert got == {("q1", "c1"), ("q2", "c1"), ("q3", "c2")}


def test_a_malformed_description_is_a_row_and_not_the_end(spark):
    files = spark.createDataFrame([("a", bytearray(b"<A><B></A>")), ("b", bytearray(b"<A><AR-PACKAGE><SHORT-NAME>P</SHORT-NAME><CLIENT-SERVER-INTERFACE><SHORT-NAME>I</SHORT-NAME>"
        b"<OPERATIONS><CLIENT-SERVER-OPERATION><SHORT-NAME>op</SHORT-NAME></CLIENT-SERVER-OPERATION></OPERATIONS></CLIENT-SERVER-INTERFACE></AR-PACKAGE></A>"))], "path string, content binary")  # fmt: skip
    got = {(r.path, r.entity, r.kind, r.qualified_name) for r in SF.arxml_entities(files).collect()}
    assert got == {("a", "rejected", "malformed", None), ("b", "interface", "client_server", "/P/I"), ("b", "operation", None, "/P/I/op")}
