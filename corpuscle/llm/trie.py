"""Conversations as a prefix trie: what they share, turn by turn, and what sharing would save.

``rebuilt`` makes the conversations; ``nodes`` builds the trie.  A turn is named by a digest of its role and text.
Conversations are laid out in blocks of ``WIDTH`` positional columns, and one ``GROUP BY ... ROLLUP`` over these
columns aggregates all prefixes of a block together, its level told by ``grouping_id``.  A longer conversation
goes on in further blocks keyed by the node in which its block before ended; that node is named by its depth and
a digest that every row can tell for itself, so all blocks of all conversations are rolled up in the same pass and
the length of a conversation costs no rounds.

Nodes with one member need no more than that pass: below them is a single chain.  Sums over subtrees are taken of
shared nodes only, by a second ROLLUP over the nodes' own columns, after the totals of later blocks were carried
to the block they hang from (pointer doubling: log2 of the number of blocks, and no round at all where nothing
is shared beyond the first block).

Nothing is gathered by conversation, by turn or by node: positions come from a sort by ranges and the sizes of its
pieces, so a conversation of a third of all turns is dealt over many tasks; a turn, prefix or conversation that
many share is combined before the exchange; children meet hot parents under salts; and members' ids are joined
in blocks of 256 numbers that one pass streams through the hash, in order and in bounded memory.

Edge cases: rows without a conv_id belong to no conversation and take no part; null roles and texts are empty;
turns of one number (nulls among them, which come first) are ordered by their digests, and repeated rows are
turns each; a conversation left without turns is a member of the root alone; very long texts are digested whole
and very long conversations fill more blocks; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscle.session import written

WIDTH = 8
#: Blocks of a conversation whose digests are summed in one step.
CHAIN = 1024
#: Salts under which children meet their parents.
SALTS = 16
NODE = ["depth", "p1", "p2"]


def sorted_side(side: DataFrame) -> DataFrame:
    """A join side that is met by sorting, however small its files are.

    Every side here grows with the conversations, and its size by files, of which a few columns are a share on paper, says
    little about its rows: numbers are stored in a few bytes and salted sides have ``SALTS`` rows for one that is read.  A
    broadcast of such a side goes through the driver and does not fit it.
    """
    return side.hint("merge")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t): a turn's digest ``t.d`` of role and text and the bytes ``t.n`` of its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    t = F.struct(digest.alias("d"), F.octet_length(text).cast("long").alias("n"))
    return conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", t.alias("t"))


def numbered(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, t), (conv_id, n)): positions from 0 in the order of turns, and lengths.

    Rows are sorted by ranges and written; the rows of a conversation in one piece of that sort are counted on, and
    their first number is what the pieces before hold.
    """
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("t.d")]
    rows = written(said.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t", F.monotonically_increasing_id().alias("at")), "turns")
    rows = rows.withColumn("piece", F.shiftright("at", 33))
    pieces = rows.groupBy("conv_id", "piece").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("piece")) - F.col("n")
    pieces = written(pieces.select("conv_id", "piece", (F.col("first") - before).alias("zero"), "n"), "pieces")
    placed = rows.join(sorted_side(pieces.drop("n")), ["conv_id", "piece"]).select("conv_id", (F.col("at") - F.col("zero")).alias("pos"), "t")
    return placed, pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, t), (conv_id, len)) of the rebuilt conversations.

    Conversation c takes its first h turns, h = crc32(c) mod (most + 1), from conversation c - c % family (all of them
    if that is shorter) and goes on with its own turns after its first h.
    """
    placed, sizes = numbered(turns(conversations))
    c = F.col("conv_id")
    own = sizes.select(c, "n", (c - c % family).alias("base"), (F.crc32(c.cast("string").cast("binary")) % (most + 1)).alias("h"))
    has = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    plan = written(own.join(sorted_side(sizes.select(c.alias("base"), F.col("n").alias("base_n"))), "base", "left").select(
        "conv_id", "base", "h", has.alias("has"), (has + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "plan")
    # A conversation of very many turns would make its key hot: turns meet their plan under salts.
    salt = F.array(*[F.lit(i) for i in range(SALTS)])
    salted = plan.select("conv_id", "h", "has", F.explode(salt).alias("salt"))
    tail = placed.withColumn("salt", (F.col("pos") % SALTS).cast("int")).join(sorted_side(salted), ["conv_id", "salt"]).filter("pos >= h")
    head = placed.filter((F.col("conv_id") % family == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base").join(sorted_side(plan), "base").filter("pos < h")
    both = tail.select("conv_id", (F.col("has") + F.col("pos") - F.col("h")).alias("pos"), "t").unionByName(head.select("conv_id", "pos", "t"))
    return both, plan.select("conv_id", "len")


def _mark(pos: Column, t: Column, side: int) -> Column:
    return F.xxhash64(F.lit(side), pos.cast("long"), t["d"], t["n"])


def _blocks(both: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, block, len, k1, k2, x1, x2, t0, t1, ...): up to ``WIDTH`` turns a row.

    (k1, k2) is the digest of all turns before the block and (x1, x2) that of the turns in it.
    """
    rows = both.select("conv_id", F.floor(F.col("pos") / WIDTH).alias("block"), F.struct("pos", "t").alias("x"))
    # Every conversation has a first block, with or without turns.
    rows = rows.unionByName(lengths.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(None).cast(rows.schema["x"].dataType).alias("x")))
    kept = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # WIDTH entries at most
    fold = lambda side: F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(_mark(x["pos"], x["t"], side)))
    blocks = written(kept.select("conv_id", "block", fold(1).alias("x1"), fold(2).alias("x2"), *[F.get("xs", F.lit(j))["t"].alias(f"t{j}") for j in range(WIDTH)]), "blocks")
    later = blocks.filter("block > 0")
    slim = blocks.join(sorted_side(later.select("conv_id").distinct()), "conv_id", "left_semi").select("conv_id", "block", "x1", "x2", F.floor(F.col("block") / CHAIN).alias("link"))
    links = slim.groupBy("conv_id", "link").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    before = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.bit_xor(c).over(w), F.lit(0).cast("long"))
    chain, inner = before(["conv_id"], "link"), before(["conv_id", "link"], "block")
    links = links.select("conv_id", "link", upto("x1", chain).alias("l1"), upto("x2", chain).alias("l2"))
    keys = slim.select("conv_id", "block", "link", upto("x1", inner).alias("i1"), upto("x2", inner).alias("i2")).join(sorted_side(links), ["conv_id", "link"]).select(
        "conv_id", "block", F.col("i1").bitwiseXOR(F.col("l1")).alias("k1"), F.col("i2").bitwiseXOR(F.col("l2")).alias("k2"))
    none = F.lit(0).cast("long")
    return blocks.filter("block = 0").withColumns({"k1": none, "k2": none}).unionByName(later.join(sorted_side(keys), ["conv_id", "block"]))


def _rolled(rows: DataFrame, sums: str) -> DataFrame:
    """ROLLUP of the turn columns under (block, k1, k2): one row a prefix, with its level, path and node names.

    ``depth, p1, p2`` name the prefix's node, ``q1, q2`` its parent.  Levels beyond the end of a row repeat what ends
    before and are left out, as are level-0 rows, which belong to the block before, but for the root.
    """
    cols = [f"t{j}" for j in range(WIDTH)]
    out = rows.sparkSession.sql(
        f"SELECT block, k1, k2, {', '.join(cols)}, {WIDTH} - bit_count(grouping_id()) AS level, {sums} FROM {{rows}} GROUP BY block, k1, k2, ROLLUP({', '.join(cols)})", rows=rows)
    level, last = F.col("level"), F.array(*cols)
    out = out.filter(((level == 0) & (F.col("block") == 0)) | ((level > 0) & F.get(last, level - 1).isNotNull()))

    def name(side: int, upto: Column) -> Column:
        marks = [F.when(upto > j, _mark(F.col("block") * WIDTH + j, F.col(c), side)).otherwise(F.lit(0).cast("long")) for j, c in enumerate(cols)]
        return reduce(lambda a, b: a.bitwiseXOR(b), marks, F.col(f"k{side}"))

    return out.withColumns({
        "depth": F.col("block") * WIDTH + level, "p1": name(1, level), "p2": name(2, level), "q1": name(1, level - 1), "q2": name(2, level - 1),
        "bytes": F.coalesce(F.get(last, level - 1)["n"], F.lit(0).cast("long"))})


def _ends_hashed(batches):
    """SHA-256 of the ids of each node, from rows ordered by node and number."""
    key, h = None, None
    for b in batches:
        out = []
        for k1, k2, k3, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
            if (k1, k2, k3) != key:
                if h:
                    out.append((*key, h.hexdigest()))
                key, h = (k1, k2, k3), hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield _hash_rows(out)
    if h:
        yield _hash_rows([(*key, h.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[*NODE, "ends_sha256"])


def _ends(blocks: DataFrame, lengths: DataFrame, shared: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the shared nodes in which conversations end."""
    whole = blocks.groupBy("conv_id").agg(F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    at = whole.join(sorted_side(lengths.withColumnRenamed("len", "depth")), "conv_id")
    few = at.groupBy(*NODE, F.shiftright("conv_id", 8).alias("run")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    few = few.join(sorted_side(shared.select(*NODE)), NODE, "left_semi")
    return few.repartition(*NODE).sortWithinPartitions(*NODE, "run").mapInArrow(_ends_hashed, "depth long, p1 long, p2 long, ends_sha256 string")


def _carried(shared: DataFrame) -> DataFrame | None:
    """(depth, p1, p2, leaves_below, saved_below): totals of all later blocks under the nodes that end a block."""
    deeper = shared.filter("block > 0")
    if deeper.isEmpty():
        return None
    tops = shared.select((F.col("depth") / WIDTH).cast("long").alias("block"), F.col("p1").alias("k1"), F.col("p2").alias("k2"),
                         F.struct("block", "k1", "k2").alias("up")).filter(shared["level"] == WIDTH)
    own = deeper.groupBy("block", "k1", "k2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    here = F.struct("block", "k1", "k2").alias("id")
    state = written(own.join(sorted_side(tops), ["block", "k1", "k2"]).select(here, F.when(F.col("up.block") > 0, F.col("up")).alias("up"), "leaves", "saved"), "carried")
    while not state.filter("up IS NOT NULL").isEmpty():
        given = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jump = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        state = written(state.join(sorted_side(given), "id", "left").join(sorted_side(jump), "up", "left").select("id", F.col("next").alias("up"), add("leaves", "l"), add("saved", "s")), "carried")
    return state.select((F.col("id.block") * WIDTH).alias("depth"), F.col("id.k1").alias("p1"), F.col("id.k2").alias("p2"),
                        F.col("leaves").alias("leaves_below"), F.col("saved").alias("saved_below"))


def nodes(both: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node of the trie of (conv_id, pos, t); ``lengths`` (conv_id, len) names every conversation."""
    blocks = _blocks(both, lengths)
    rows = blocks.join(sorted_side(lengths), "conv_id").drop("x1", "x2")
    found = _rolled(rows, "min(conv_id) AS conv_id, count(*) AS n_convs, max(len) AS longest")
    cols = [f"t{j}" for j in range(WIDTH)]
    path = [F.when(F.col("n_convs") > 1, F.col(c)).alias(c) for c in cols]  # only shared nodes are summed by their paths
    found = written(found.select(*NODE, "q1", "q2", "block", "k1", "k2", "level", "conv_id", "n_convs", "longest", "bytes", *path), "nodes")

    kids = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count("*").alias("n_children"), F.sum((F.col("n_convs") == 1).cast("long")).alias("single"))
    n_children = F.coalesce("n_children", F.lit(0).cast("long"))
    # Below a child with one member is one leaf; a shared node without children is a leaf itself.
    leaves = F.when(n_children == 0, F.lit(1).cast("long")).otherwise(F.col("single"))
    shared = written(found.filter("n_convs > 1").join(sorted_side(kids), NODE, "left").withColumns(
        {"n_children": n_children, "leaves": leaves, "saved": (F.col("n_convs") - 1) * F.col("bytes")}).drop("single"), "shared")

    weighed = shared.select(*NODE, "block", "k1", "k2", *cols, "leaves", "saved")
    below = _carried(shared)
    if below is not None:
        more = lambda a: (F.col(a) + F.coalesce(f"{a}_below", F.lit(0))).alias(a)
        weighed = weighed.join(sorted_side(below), NODE, "left").select(*NODE, "block", "k1", "k2", *cols, more("leaves"), more("saved"))
    totals = _rolled(weighed.drop(*NODE), "sum(leaves) AS n_leaves, sum(saved) AS saved_tokens").select(*NODE, "n_leaves", "saved_tokens")

    none = hashlib.sha256(b"").hexdigest()
    full = shared.join(sorted_side(totals), NODE).join(sorted_side(_ends(blocks, lengths, shared)), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    alone = found.filter("n_convs = 1").withColumns({
        "n_children": (F.col("longest") > F.col("depth")).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long"),
        "ends_sha256": F.when(F.col("longest") == F.col("depth"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(none))})
    keep = ["conv_id", *NODE, "q1", "q2", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = full.select(*keep).unionByName(alone.select(*keep)).withColumn("salt", F.pmod(F.col("p1"), F.lit(SALTS)).cast("int"))
    parents = shared.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("up"),
        F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    # A parent that is not shared has its child's only member.
    up = F.when(F.col("depth") > 0, F.coalesce("up", "conv_id"))
    return every.join(sorted_side(parents), ["depth", "q1", "q2", "salt"], "left").select(
        "conv_id", "depth", up.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(conversations: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    both, lengths = rebuilt(conversations, family, most)
    return nodes(both, lengths)
