"""The pipeline's stages, one after the other, against plain versions on a small corpus."""

import random

import numpy as np
from test_operators_llm import DOCS, EDGE, SECRET_TEXTS, brute_components, brute_leaks, near_texts, prose, word_sets

import corpus_pipeline
from corpuscle.llm import queries, secrets


def write(df, folder, name):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def corpus(spark, folder):
    rng = random.Random(21)
    items = [(i, prose(rng, 24, 10**6)) for i in range(5)] + [(50, None)]
    good = [prose(rng, rng.randrange(60, 300), 10**5) + "." for _ in range(60)]
    leaky = [f"{prose(rng, 30, 10**5)} {t} {prose(rng, 30, 10**5)}" for _, t in items[:5]]
    hidden = [f"{prose(rng, 40, 10**5)} {t}" for t in SECRET_TEXTS[-7:]]
    junk = ["| ### $$ |" * (8 + i) for i in range(40)]
    texts = good + leaky + hidden + near_texts(random.Random(8)) + junk + EDGE
    rows = [(i, t, "en", "s", len(t or ""), 1, "r", "h") for i, t in enumerate(texts)] + [(0, good[0], "en", "s", len(good[0]), 1, "r", "h"), (None, good[1], "en", "s", 1, 1, "r", "h")]
    write(spark.createDataFrame(rows, DOCS), folder, "documents")
    n = len(good)
    labels = [(i, 1, 0) for i in range(n)] + [(len(texts) - len(EDGE) - 1 - i, 0, 0) for i in range(40)] + [(None, 1, 0), (2, None, 1)]
    write(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), folder, "labels")
    write(spark.createDataFrame(items, "item_id long, text string"), folder, "benchmark")
    return texts, items, junk


def test_stages_match_plain_versions(spark, tmp_path):
    folder = str(tmp_path)
    texts, items, junk = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, by_stage = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/out-{k}")
        docs = spark.read.parquet(f"{folder}/out-{k}")
        by_stage[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    kept = by_stage["quality"]
    assert not {r.text for r in kept} & set(junk) and {r.text for r in kept} >= set(texts[:60])
    near = by_stage["near_dedup"]
    sets = word_sets([(i, r.text) for i, r in enumerate(kept)], 5)
    groups = brute_components(sets, 80)
    left = [i for i, r in enumerate(kept) if r in near]
    assert len(near) == len({groups[i] for i in groups if sets[i]}) + sum(not s for s in sets.values())
    for g in {groups[i] for i in groups if sets[i]}:
        ids = [kept[i].doc_id for i in groups if groups[i] == g and kept[i].doc_id is not None]
        assert {kept[i].doc_id for i in left if groups[i] == g} == {min(ids)}
    clean = by_stage["decontamination"]
    leaks = {i for i, _ in brute_leaks(list(enumerate(r.text for r in near)), items)}
    assert sorted(map(str, clean)) == sorted(str(r) for i, r in enumerate(near) if i not in leaks) and len(leaks) == 5
    safe = by_stage["secrets"]
    assert len(safe) == len(clean)
    want = sorted(secrets.masked(r.text, s, "[secret]") if (s := secrets.find(r.text)) else str(r.text) for r in clean)
    assert sorted(str(r.text) for r in safe) == want and any("[secret]" in t for t in want)
    packed = by_stage["packing"]
    assert {(r.doc_id) for r in packed} == {r.doc_id for r in safe}
    for s in {r.sequence_id for r in packed}:
        rows = sorted((r.offset, r.length) for r in packed if r.sequence_id == s)
        assert [o for o, _ in rows] == np.concatenate([[0], np.cumsum([n for _, n in rows])[:-1]]).tolist() and sum(n for _, n in rows) <= 4096


def test_stages_take_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/empty-{k}")
        docs = spark.read.parquet(f"{folder}/empty-{k}")
        assert docs.count() == 0, name


def test_registered_queries_have_the_contracts_columns(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    write(spark.createDataFrame([(i, [float(i % 7), 1.0], i % 3) for i in range(60)], "vec_id long, embedding array<float>, label int"), folder, "embeddings")
    write(spark.createDataFrame([(c, t, "user", f"turn {t}") for c in range(6) for t in range(3)], "conv_id long, turn long, role string, text string"), folder, "conversations")
    write(spark.createDataFrame([(1, "http://a.org/x", "<p>")], "page_id long, url string, html string"), folder, "pages")
    first = {
        "op2": ["doc_id", "held_out", "score", "predicted"], "op3": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op4": ["doc_id", "n_shingles", "component_id", "kept"], "op5": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op6": ["doc_id", "n_assign", "n_access", "n_hex"], "op7": ["doc_id", "held_out", "score", "predicted"], "op9": ["query_id", "rank", "vec_id", "score"],
        "op10": ["page_id", "host", "path", "rule", "verdict"], "op11": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
        "op12": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
        "op13": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    assert len(queries.QUERIES) == 13
    for name, run in queries.QUERIES.items():
        want = first.get(name.split("_")[0], [])
        assert run(spark, folder).columns[: len(want)] == want, name
