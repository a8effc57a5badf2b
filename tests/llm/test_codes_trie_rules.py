"""Vector codes, the conversation trie and the adaptive rules against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuscle.llm import codes, rules, trie

VECTORS = "vec_id long, embedding array<double>, label int, part int, v string"
TURNS = "conv_id long, turn long, role string, text string, pos int, t string"
DOCS = "doc_id long, text string, lang string, source string, r string, m string, n_words int"


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, e, lab) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    wide = -(-max(len(e) for _, e, _ in kept) // parts)
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    ints = [[math.floor(1024 * x) for x in e] + [0] * (wide * parts - len(e)) for _, e, _ in kept]
    cut = [[tuple(v[q * wide : (q + 1) * wide]) for q in range(parts)] for v in ints]
    books = [[c[q] for c in cut[:entries]] for q in range(parts)]

    def assign():
        out = []
        for c in cut:
            out.append([min((sum((a - b) ** 2 for a, b in zip(c[q], e)), k) for k, e in enumerate(books[q])) for q in range(parts)])
        return out

    for _ in range(rounds):
        got = assign()
        for q in range(parts):
            members = defaultdict(list)
            for c, a in zip(cut, got):
                members[a[q][1]].append(c[q])
            for k, m in members.items():
                books[q][k] = tuple(sum(col) // len(m) for col in zip(*m))
    got = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = Counter()
    for (_, _, lab), a in zip(kept, got):
        total[lab] += sum(d for d, _ in a)
    return Counter((i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), total[lab], sha) for (i, _, lab), a in zip(kept, got))


def coded(spark, rows, **options):
    df = spark.createDataFrame([(i, e, lab, 1, "x") for i, e, lab in rows], VECTORS)
    return Counter(tuple(r) for r in codes.encode(df, **options).collect())


def test_codes_match_plain_lloyd(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(6)]
    rows = [(i * 7 % 400, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(400)]
    rows += [(401, None, 1), (402, [0.1] * 7 + [None], 1), (403, [float("nan")] + [0.0] * 7, 2), (404, [float("inf")] * 8, 2), (None, [0.2] * 8, 5)]
    rows += [rows[3], rows[3], (rows[5][0], [0.5] * 8, 1)]
    assert coded(spark, rows, entries=16) == plain_codes(rows, entries=16)


def test_codes_with_ties_few_rows_and_odd_dimensions(spark):
    grid = [(i, [float(i % 3), float(i % 2), 0.0], i % 2) for i in range(30)]  # many equal distances, 3 components in 4 parts
    assert coded(spark, grid, entries=8) == plain_codes(grid, entries=8)
    few = [(5, [0.5, -0.5, 0.25, 1.0, 2.0], None), (3, [1.5], None)]
    assert coded(spark, few) == plain_codes(few)
    assert coded(spark, [(1, None, 0)]) == Counter() and coded(spark, []) == Counter()
    assert set(coded(spark, [(1, [], 0)])) == {(1, "00000000", 0, 0, hashlib.sha256(b",".join([])).hexdigest())}


def test_codes_of_large_integers_are_exact_or_fail(spark):
    rng = random.Random(9)
    large = [(i, [rng.uniform(-1, 1) * 3e5 for _ in range(4)], 0) for i in range(40)]
    assert coded(spark, large, entries=6, rounds=2) == plain_codes(large, entries=6, rounds=2)
    with pytest.raises(Exception, match="64 bits"):
        coded(spark, [(1, [1e300] * 4, 0)])


def test_stayed_parts_compare_moved_entries_only():
    rng = np.random.default_rng(2)
    x, book = rng.integers(-50, 50, (500, 3)), rng.integers(-50, 50, (40, 3))
    entry, dist, full = codes.nearest(x, book)
    new, moved = book.copy(), np.zeros(40, bool)
    for k in (3, 7, 20):
        new[k] += rng.integers(-20, 20, 3)
        moved[k] = True
    e, d, taken = codes.nearest(x, new, moved, entry, dist)
    want, wd, _ = codes.nearest(x, new)
    assert (e == want).all() and (d == wd).all()
    gone = int(moved[entry].sum())
    assert taken == gone * 40 + (500 - gone) * 3 < full / 4


def plain_trie(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn, role or "", text or ""))
    name = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
    said = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, name(*x[2:])))] for c, v in said.items()}
    made = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(math.fmod(c, 5))
        made[c] = tuple(said.get(c - base, [])[:h] + own[h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, m in made.items():
        for d in range(len(m) + 1):
            members[m[:d]].append(c)
            if d:
                kids[m[: d - 1]].add(m[:d])
        ends[m].append(c)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        cost = (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += not kids[p]
    return Counter((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, cs in members.items())


def grown(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.trie(df).collect())


def test_trie_matches_plain_version(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHAIN", 2)
    rng, rows = random.Random(4), []
    stem = [("user", f"long {i} ä") for i in range(70)]
    for c in range(-12, 60):
        n = rng.choice([1, 2, 3, 8, 9, 16, 17, 30])
        talk = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "common"])) for _ in range(n)]
        if c % 4 == 0:
            talk = stem[: rng.choice([8, 16, 40, 64, 70])] + talk[: rng.randrange(4)]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(talk)]
    rows += [(None, 0, "user", "nobody"), (61, None, "user", "first"), (61, 0, None, None), (62, 4, "a", "tie"), (62, 4, "b", "tie"), (62, 4, "a", "tie"), (63, 0, "user", "x" * 100_000)]
    rng.shuffle(rows)
    assert grown(spark, rows) == plain_trie(rows)


def test_trie_of_copies_and_nothing(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(700) for t in range(3)]  # one group of copies over several runs of ids
    assert grown(spark, same) == plain_trie(same)
    assert grown(spark, []) == Counter() and grown(spark, [(None, 1, "user", "x")]) == Counter()
    one = [(5, 0, "user", "only")]
    assert grown(spark, one) == plain_trie(one)


def test_a_conversation_of_most_turns_lies_in_many_pieces(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(trie, "written", lambda df, name, write=trie.written: kept.setdefault(name, write(df, name)))
    rows = [(1, t, "user", f"t{t}") for t in range(4000)] + [(c, 0, "user", "t0") for c in range(2, 40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, sizes = trie.numbered(trie.turns(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.conv_id, r.pos) for r in placed.collect()} == {(c, t) for c, t, _, _ in rows}
    assert {r.conv_id: r.n for r in sizes.collect()}[1] == 4000
    assert kept["pieces"].filter("conv_id = 1").count() > 1


def plain_measures(text):
    t = text or ""
    ws = re.findall("[^\x20\x09-\x0d]+", t)
    grams = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    inside = {i + j for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for j in range(8)}
    full = [s for s in t.split("\n") if re.search("[^\x20\x09-\x0d]", s)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(inside), len(full)


def plain_rules(rows, least):
    def bucket(v):
        s = max(v.bit_length() - 6, 0)
        return s, v >> s

    sketch, seen, out = defaultdict(list), [], []
    for i, text, lang, source in rows:
        w, ch, sy, du, re_, ln = plain_measures(text)
        rate = {"symbol_rate": sy * 10_000 // ch if ch else None, "dup_line_rate": du * 10_000 // ln if ln else None,
                "repeat_rate": re_ * 10_000 // w if w else None, "word_length": ch * 100 // w if w else None}
        seen.append((i, (w, ch, sy, du, re_), rate, (lang, source)))
        for k, v in rate.items():
            if v is not None:
                for scope in ((0, lang, source), (1, lang, None), (2, None, None)):
                    sketch[(*scope, k)].append(v)
    for i, m, rate, (lang, source) in seen:
        beyond = []
        for k, v in rate.items():
            for scope in ((0, lang, source), (1, lang, None), (2, None, None)):
                vs = sorted(sketch[(*scope, k)])
                if v is None or len(vs) < least:
                    continue
                s, low = bucket(vs[-(-len(vs) // 4) - 1])
                q1 = low << s
                s, low = bucket(vs[-(-3 * len(vs) // 4) - 1])
                q3 = ((low + 1) << s) - 1
                far = 3 * max(q3 - q1, rules.SPREAD[k])
                if v > q3 + far or (k == "word_length" and v < q1 - far):
                    beyond.append(k)
                break
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        out.append((i, *m, failed, not failed and not beyond, ",".join(beyond)))
    return Counter(out)


def rule_rows():
    rng, rows = random.Random(8), []
    for i in range(260):
        ws = [rng.choice(["alpha", "be", "gamma", "delta", "eps", "ζήτα"]) + str(rng.randrange(50)) for _ in range(rng.randrange(5, 120))]
        if i % 9 == 0:
            ws = ws + ws[: rng.randrange(len(ws))]
        if i % 13 == 0:
            ws = [w + "#$%" for w in ws]
        if i % 17 == 0:
            ws = [w * 9 for w in ws]
        text = "".join(w + rng.choice([" ", " ", "\n", "\t", "\r\n", "  "]) for w in ws)
        rows.append((i, text * 3 if i % 31 == 0 else text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "a"])))
    extra = [None, "", " \n\t", "one", "w " * 3000, "same line\nsame line\n\nsame line \nx", "   x", "a b c d e f g h a b c d e f g h", "y" * 50_000,
             " ".join(f"long{i % 4999}" for i in range(12_000))]
    return rows + [(1000 + i, t, "en", "a") for i, t in enumerate(extra)] + [(None, rows[0][1], "fr", "c"), rows[1], rows[1]]


def test_rules_match_plain_version(spark):
    rows = rule_rows()
    df = spark.createDataFrame([(*r, "r", "m", 1) for r in rows], DOCS)
    got = rules.verdicts(df, least=20).collect()
    assert Counter(tuple(r) for r in got) == plain_rules(rows, 20)
    assert sum(r.kept for r in got) > 100 and any(r.beyond and not r.base_failed for r in got)
    kept = rules.keep_good(df, least=20)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_rules_of_small_and_empty_tables(spark):
    rows = rule_rows()[:30]
    df = spark.createDataFrame([(*r, "r", "m", 1) for r in rows], DOCS)
    assert all(r.kept == (not r.base_failed) for r in rules.verdicts(df).collect())  # too few for any sketch
    assert rules.verdicts(df.limit(0)).count() == 0 and rules.keep_good(df.limit(0)).columns == df.columns


def test_rule_buckets_hold_their_values(spark):
    from pyspark.sql import functions as F

    v = F.col("id")
    b = rules.bucket(v)
    got = spark.range(200_000).select(v.alias("v"), b.alias("b"), rules.bucket_low(b).alias("lo"), rules.bucket_top(b).alias("hi"))
    assert got.filter("v < lo OR v > hi OR hi - lo > v / 32").isEmpty()
    assert got.agg(F.countDistinct("b").alias("n"), F.max("b").alias("m")).first()[0:2] == (got.agg(F.max("b")).first()[0] + 1, got.agg(F.max("b")).first()[0])
