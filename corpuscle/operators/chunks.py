"""Pages to hierarchical chunks.

Atomic chunks are a row-local explode of each page.  Context chunks need a running word count
with reset over a document; it is computed over blocks of pages, so no task ever holds more than
one block of text, however long a document is.
"""

from __future__ import annotations

import hashlib
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the plan: workers need no copy of the package

ATOMIC_WORDS = 220
CONTEXT_WORDS = 600
MIN_CHARS = 40
PAGES_PER_BLOCK = 512


def normalized_pages(pages: DataFrame, keep_blank_lines: bool = False) -> DataFrame:
    return pages.withColumn("text", T.normalize_page(F.col("text"), keep_blank_lines))


def atomic_chunks(pages: DataFrame, words_per_chunk: int = ATOMIC_WORDS) -> DataFrame:
    """Word windows of each paragraph, with the paragraph's signals.

    Needs ``document_id, page_index, text``; other columns ride along.  ``page_unknown`` (optional)
    blanks the page numbers.
    """
    carried = [c for c in pages.columns if c not in ("text", "page_unknown")]
    unknown = F.col("page_unknown") if "page_unknown" in pages.columns else F.lit(False)
    paras = pages.select(
        *carried, unknown.alias("_unknown"), F.posexplode(T.paragraphs(F.col("text"))).alias("para", "_text")
    ).where(F.length("_text") >= MIN_CHARS)
    paras = paras.withColumns(
        {
            "_words": T.words(F.col("_text")),
            "requirement_ids": T.requirement_ids(F.col("_text")),
            "api_names": T.api_names(F.col("_text")),
            "ecu_parameters": T.ecu_parameters(F.col("_text")),
            "_head": F.get(T.headings(F.col("_text")), F.lit(0)),
        }
    )
    starts = F.sequence(F.lit(0), F.size("_words") - 1, F.lit(words_per_chunk))
    windows = F.transform(
        starts,
        lambda s: F.struct(
            s.alias("word_offset"),
            F.array_join(F.slice(F.col("_words"), s + 1, F.lit(words_per_chunk)), " ").alias("text"),
        ),
    )
    out = paras.withColumn("_w", F.explode(windows)).where(F.length("_w.text") >= MIN_CHARS)
    page = F.when(~F.col("_unknown"), F.col("page_index") + 1)
    return out.select(
        F.concat(
            F.lit("chunk-"), T.sha12(F.col("document_id"), F.col("page_index"), F.col("para"), F.col("_w.word_offset"))
        ).alias("chunk_id"),
        *carried,
        "para",
        F.col("_w.word_offset").alias("word_offset"),
        page.alias("page_start"),
        page.alias("page_end"),
        F.coalesce("_head.number", F.lit("")).alias("section_number"),
        F.coalesce("_head.title", F.lit("")).alias("section_title"),
        "requirement_ids",
        "api_names",
        "ecu_parameters",
        F.col("_w.text").alias("text"),
        F.col("_w.text").alias("normalized_text"),
        F.lit("atomic").alias("chunk_kind"),
        F.lit(None).cast("string").alias("parent_chunk_id"),
    )


def _step(acc, n, target):
    """Running word count that restarts when it reaches the target."""
    total = acc["left"] + n
    full = total >= target
    return F.struct(
        F.when(full, 0).otherwise(total).cast("int").alias("left"),
        (acc["resets"] + F.when(full, 1).otherwise(0)).cast("int").alias("resets"),
    )


def _entering_states(atomics: DataFrame, target: int, pages_per_block: int) -> DataFrame:
    """(document_id, block, left, resets): the running state with which a block of pages begins.

    The state is a number below the target, so a block is summarised by a map from every entering
    state to (leaving state, restarts).  Maps are composed by a tree of ``FAN`` neighbours, so a row holds
    that many maps at most and a document of n blocks takes log n rounds.  Only documents of several blocks are
    looked at, and only numbers travel.
    """
    long_docs = atomics.where(F.col("page_index") >= pages_per_block).select("document_id").distinct()
    counted = atomics.select(
        "document_id", "page_index", "para", "word_offset", F.size(T.words(F.col("text"))).alias("n")
    ).join(long_docs, "document_id", "left_semi")
    blocks = (
        counted.groupBy("document_id", F.floor(F.col("page_index") / pages_per_block).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("page_index", "para", "word_offset", "n"))).alias("items"))
        .withColumn("ns", F.transform("items", lambda i: i["n"]))
    )

    def run(start):
        zero = F.struct(start.cast("int").alias("left"), F.lit(0).cast("int").alias("resets"))
        return F.aggregate("ns", zero, lambda acc, n: _step(acc, n, target))

    maps = blocks.select(
        "document_id", "block", F.transform(F.sequence(F.lit(0), F.lit(target - 1)), run).alias("effect")
    )
    last = (atomics.agg(F.max("page_index")).first()[0] or 0) // pages_per_block
    # Up: FAN neighbours become one map, until a document is one.  Down: a map's entering state becomes those of its parts.
    levels = [maps]
    while last >= FAN:
        levels[-1] = written(levels[-1], "block_maps")
        parts = _neighbours(levels[-1])
        levels.append(parts.select("document_id", F.col("above").alias("block"), F.aggregate("parts", _identity(target), _after).alias("effect")))
        last //= FAN
    states = None
    for level in reversed(levels):
        parts = _neighbours(level)
        if states is None:
            begun = parts.withColumns({"left": F.lit(0), "resets": F.lit(0)})
        else:
            begun = parts.join(states.withColumnRenamed("block", "above"), ["document_id", "above"])
        states = _opened(begun)
    return states


#: Neighbouring maps that meet in one row.
FAN = 32


def _identity(target: int):
    each = lambda s: F.struct(s.cast("int").alias("left"), F.lit(0).cast("int").alias("resets"))
    return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), each)


def _after(acc, part):
    """The map ``acc`` followed by that of ``part``."""
    def one(x):
        y = F.get(part["effect"], x["left"])
        return F.struct(y["left"].alias("left"), (x["resets"] + y["resets"]).cast("int").alias("resets"))

    return F.transform(acc, one)


def _neighbours(maps: DataFrame) -> DataFrame:
    """(document_id, above, parts): ``FAN`` neighbouring maps at most, in order."""
    parts = F.sort_array(F.collect_list(F.struct("block", "effect"))).alias("parts")
    return maps.groupBy("document_id", F.floor(F.col("block") / FAN).alias("above")).agg(parts)


def _opened(begun: DataFrame) -> DataFrame:
    """(document_id, block, left, resets) of every part, from the state with which its row begins."""
    start = F.struct(
        F.col("left").cast("int").alias("left"), F.col("resets").cast("int").alias("resets"),
        F.expr("cast(array() as array<struct<block:bigint,left:int,resets:int>>)").alias("out"),
    )

    def compose(acc, m):
        after = F.get(m["effect"], acc["left"])
        here = F.struct(m["block"].alias("block"), acc["left"].alias("left"), acc["resets"].alias("resets"))
        return F.struct(
            after["left"].alias("left"),
            (acc["resets"] + after["resets"]).cast("int").alias("resets"),
            F.concat(acc["out"], F.array(here)).alias("out"),
        )

    each = F.explode(F.aggregate("parts", start, compose, lambda acc: acc["out"])).alias("e")
    return begun.select("document_id", each).select("document_id", "e.block", "e.left", "e.resets")


def grouped(atomics: DataFrame, target_words: int = CONTEXT_WORDS, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """Atomic chunks with ``grp``: runs of consecutive chunks that reach ``target_words`` words.

    No task holds more than one block of pages, whatever the length of a document.
    """
    row = F.struct("page_index", "para", "word_offset", F.struct(*atomics.columns).alias("row"))
    blocks = atomics.groupBy(
        "document_id", F.floor(F.col("page_index") / pages_per_block).alias("block")
    ).agg(F.sort_array(F.collect_list(row)).alias("items"))
    entering = _entering_states(atomics, target_words, pages_per_block)
    state = F.struct(
        F.coalesce("left", F.lit(0)).alias("left"),
        F.coalesce("resets", F.lit(0)).alias("resets"),
        F.expr("cast(array() as array<int>)").alias("out"),
    )

    def number(acc, n):
        nxt = _step(acc, n, target_words)
        return F.struct(
            nxt["left"].alias("left"),
            nxt["resets"].alias("resets"),
            F.concat(acc["out"], F.array(acc["resets"])).alias("out"),
        )

    ns = F.transform("items", lambda i: F.size(T.words(i["row"]["text"])))
    numbers = F.aggregate(ns, state, number, lambda acc: acc["out"])
    pairs = F.zip_with("items", numbers, lambda i, g: F.struct(i["row"].alias("row"), g.alias("grp")))
    return (
        blocks.join(entering, ["document_id", "block"], "left")
        .select(F.explode(pairs).alias("p"))
        .select("p.row.*", "p.grp")
    )


def _short_groups(atomics: DataFrame, target_words: int) -> DataFrame:
    """(document_id, members) of documents that are one block: numbered, cut and kept inside their row."""
    row = F.struct("page_index", "para", "word_offset", F.struct(*atomics.columns).alias("row"))
    docs = atomics.groupBy("document_id").agg(F.sort_array(F.collect_list(row)).alias("items"))
    start = F.struct(F.lit(0).alias("left"), F.lit(0).alias("resets"), F.expr("cast(array() as array<int>)").alias("out"))

    def number(acc, n):
        nxt = _step(acc, n, target_words)
        return F.struct(nxt["left"].alias("left"), nxt["resets"].alias("resets"), F.concat(acc["out"], F.array(acc["resets"])).alias("out"))

    ns = F.transform("items", lambda i: F.size(T.words(i["row"]["text"])))
    numbered = docs.withColumn("grps", F.aggregate(ns, start, number, lambda acc: acc["out"]))
    # Numbers never fall, so a group is a slice.
    cut = lambda g: F.slice("items", F.array_position("grps", g).cast("int"), F.size(F.filter("grps", lambda x: x == g)))
    runs = F.transform(F.array_distinct("grps"), cut)
    return numbered.select("document_id", F.explode(runs).alias("run")).select("document_id", F.transform("run", lambda x: x["row"]).alias("members"))


def with_contexts(atomics: DataFrame, target_words: int = CONTEXT_WORDS, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """Atomic chunks with their parent id, plus one context chunk per group of two or more.

    A group is bounded by the target, so it is collected once and yields its members and its
    context row together; no join back is needed.  Documents of one block of pages, which are most, are grouped inside
    their row; if ``atomics`` are placed by document, their text is not moved at all.  Only longer documents
    (and rows without a document) meet by block and by group.
    """
    cols = atomics.columns
    one_block = F.coalesce(F.col("page_index").between(0, pages_per_block - 1), F.lit(False)) & F.col("document_id").isNotNull()
    long_docs = written(atomics.where(~one_block).select("document_id").distinct(), "long_documents")
    if long_docs.isEmpty():
        groups = _short_groups(atomics, target_words)
    else:
        row = F.struct("page_index", "para", "word_offset", F.struct(*cols).alias("row"))
        long = atomics.join(long_docs, "document_id", "left_semi").unionByName(atomics.where(F.col("document_id").isNull()))
        long_groups = (
            grouped(long.select(*cols), target_words, pages_per_block)
            .groupBy("document_id", "grp")
            .agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["row"]).alias("members"))
            .select("document_id", "members")
        )
        short = atomics.where(F.col("document_id").isNotNull()).join(long_docs, "document_id", "left_anti")
        groups = _short_groups(short.select(*cols), target_words).unionByName(long_groups)
    groups = (
        groups.withColumn("first", F.get("members", F.lit(0)))
        .withColumn("last", F.element_at("members", -1))
        .withColumn("several", F.size("members") >= 2)
    )
    parent = F.when(
        F.col("several"),
        F.concat(F.lit("chunk-"), T.sha12(F.col("document_id"), F.lit("ctx"), F.col("first.chunk_id"), F.col("last.chunk_id"))),
    )
    groups = groups.withColumn("parent", parent).withColumn(
        "joined", F.array_join(F.transform("members", lambda m: m["text"]), "\n\n")
    )
    union = lambda c: T.distinct_sorted(F.flatten(F.transform("members", lambda m: m[c])))
    own = {
        "chunk_id": F.col("parent"),
        "page_end": F.col("last.page_end"),
        "requirement_ids": union("requirement_ids"),
        "api_names": union("api_names"),
        "ecu_parameters": union("ecu_parameters"),
        "text": F.col("joined"),
        "normalized_text": T.collapse(F.col("joined")),
        "chunk_kind": F.lit("context"),
        "parent_chunk_id": F.lit(None).cast("string"),
    }
    context = F.struct(*[own[c].alias(c) if c in own else F.col(f"first.{c}").alias(c) for c in cols])
    kids = F.transform(
        "members",
        lambda m: F.struct(*[(F.col("parent") if c == "parent_chunk_id" else m[c]).alias(c) for c in cols]),
    )
    out = F.when(F.col("several"), F.concat(kids, F.array(context))).otherwise(kids)
    return groups.select(F.explode(out).alias("row")).select("row.*")


def first_chunk_of_page(atomics: DataFrame) -> DataFrame:
    """(document_id, page_index, chunk_id): the chunk a page's tables and figures link to."""
    return atomics.groupBy("document_id", "page_index").agg(
        F.min_by("chunk_id", F.struct("para", "word_offset")).alias("chunk_id")
    )


def link_sidecars(sidecars: DataFrame, atomics: DataFrame) -> DataFrame:
    return sidecars.join(first_chunk_of_page(atomics), ["document_id", "page_index"], "left")


def file_chunks(files: DataFrame, summary: str | None = None, size: int = 1200, step: int = 1050,
                max_blocks: int | None = None) -> DataFrame:
    """Overlapping character windows of linked files; an optional summary column becomes block 0.

    Needs ``source_id, path, kind, scope, text``.  Ids derive from path and content.  Page numbers
    stay NULL.  ``max_blocks`` (off by default) bounds the windows of one file.
    """
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(step))
    windows = F.transform(starts, lambda s: F.substring(F.col("text"), s, F.lit(size)))
    if summary:
        has = F.coalesce(F.col(summary), F.lit("")) != ""
        windows = F.concat(F.when(has, F.array(F.col(summary))).otherwise(F.expr("cast(array() as array<string>)")), windows)
    if max_blocks:
        windows = F.slice(windows, 1, max_blocks)
    file_hash = F.substring(F.sha2(F.concat("path", F.lit("\0"), "text"), 256), 1, 12)
    part = F.when(F.col("block") > 0, F.concat(F.lit(" part"), F.col("block"))).otherwise("")
    return (
        files.where(T.strip(F.col("text")) != "")
        .withColumn("_file", file_hash)
        .select("*", F.posexplode(windows).alias("block", "block_text"))
        .select(
            F.concat_ws("-", F.lit("ps"), F.substring("source_id", 1, 8), "_file", F.col("block").cast("string")).alias("chunk_id"),
            F.col("source_id").alias("document_id"),
            "path",
            "block",
            F.col("kind").alias("document_type"),
            F.concat(F.lit("["), "scope", F.lit("] "), "path", part).alias("section_title"),
            T.content_hash(F.col("block_text")).alias("sha256"),
            F.lit(None).cast("int").alias("page_start"),
            F.lit(None).cast("int").alias("page_end"),
            F.col("block_text").alias("text"),
            F.col("block_text").alias("normalized_text"),
        )
    )


def backfill_provenance(chunks: DataFrame, documents: DataFrame, snapshot_id: str) -> DataFrame:
    """Fill missing snapshot, hash and confidence; a second run changes nothing."""
    conf = documents.select("document_id", F.col("confidence").alias("_doc_conf"))
    blank = F.coalesce(F.col("snapshot_id"), F.lit("")) == ""
    return (
        chunks.join(conf, "document_id", "left")
        .withColumns(
            {
                "content_hash": F.when(blank, T.content_hash(F.coalesce("text", F.lit("")))).otherwise(F.col("content_hash")),
                "confidence": F.when(blank, F.coalesce("_doc_conf", F.lit(1.0))).otherwise(F.col("confidence")),
                "snapshot_id": F.when(blank, F.lit(snapshot_id)).otherwise(F.col("snapshot_id")),
            }
        )
        .drop("_doc_conf")
    )


def link_evidence_rows(rows: DataFrame, atomics: DataFrame) -> DataFrame:
    """Chunk id of table/figure rows by the page inside their evidence id ``tbl-<doc>-<page>-<n>``."""
    pattern = r"^(?:tbl|fig)-(.+)-(\d+)-(\d+)$"
    keyed = rows.withColumns(
        {
            "document_id": F.regexp_extract("evidence_id", pattern, 1),
            "page_index": F.regexp_extract("evidence_id", pattern, 2).cast("int"),
        }
    )
    firsts = first_chunk_of_page(atomics).withColumnRenamed("chunk_id", "_first")
    return (
        keyed.join(firsts, ["document_id", "page_index"], "left")
        .withColumn("chunk_id", F.coalesce("chunk_id", "_first"))
        .drop("_first")
    )


#: Ids that are hashed as one row.
RUN = 256


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row (count, ids, ids_hash): rows, distinct chunk ids and the SHA-256 of all ids in order, joined by ``|`` (32 digits).

    Ids are sorted by ranges and joined to runs of ``RUN`` where they lie; a hash has to be fed in order, so the runs go
    through one stream of bounded memory.  Null ids are rows only.
    """
    ids = chunks.select(F.col("chunk_id").cast("string").alias("id")).repartitionByRange("id").sortWithinPartitions("id")
    run = RUN
    runs = written(ids.mapInArrow(lambda batches: _id_runs(batches, run), "part int, no long, count long, ids long, joined string"), "id_runs")
    none = F.lit(hashlib.sha256(b"").hexdigest()[:32])
    one = runs.repartition(1).sortWithinPartitions("part", "no").mapInArrow(_hash_of_runs, "count long, ids long, ids_hash string")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
    return one.agg(zero("count"), zero("ids"), F.coalesce(F.max("ids_hash"), none).alias("ids_hash"))  # one row, without ids as well


def _id_runs(batches, run: int):
    """Joined runs of the sorted ids of one task; equal ids lie in one task."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, no, last, rows, many, held = TaskContext.get().partitionId(), 0, None, 0, 0, []

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([no], pa.int64()), pa.array([rows], pa.int64()), pa.array([many], pa.int64()), pa.array(["|".join(held) if held else None], pa.string())],
            names=["part", "no", "count", "ids", "joined"])

    for batch in batches:
        for x in batch.column(0).to_pylist():
            rows += 1
            if x is None:
                continue
            many, last = many + (x != last), x
            held.append(x)
            if len(held) == run:
                yield row()
                no, rows, many, held = no + 1, 0, 0, []
    if rows:
        yield row()


def _hash_of_runs(batches):
    import pyarrow as pa

    h, first, rows, many = hashlib.sha256(), True, 0, 0
    for batch in batches:
        rows, many = rows + sum(batch.column(2).to_pylist()), many + sum(batch.column(3).to_pylist())
        for x in batch.column(4).to_pylist():
            if x is not None:
                h.update((x if first else "|" + x).encode())
                first = False
    yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([many], pa.int64()), pa.array([h.hexdigest()[:32]])], names=["count", "ids", "ids_hash"])
