"""The given tables seen as a documentation corpus.

Every rule here is mirrored by ``plans/oracle.py`` in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import blockmax as B
from corpuscle.operators import chunks as C
from corpuscle.operators import index as I
from corpuscle.operators.index import broadcast_if_small, source_bytes
from corpuscle.operators.substrings import passages_held
from corpuscle.session import written

RELEASES = ("4.2.2", "4.4.0", "R22-11", "R24-11")
PLATFORMS = {"en": "Classic", "de": "Adaptive", "fr": "Foundation", "es": "Classic"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, bytes_per_task: int = 4 << 20) -> DataFrame:
    """Give a small file enough tasks for text work; a large scan already has them and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if source_bytes(df) < cores * bytes_per_task else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with release, platform, module, owner and a leading identifier sentence."""
    d = spread(table(spark, sf_dir, "documents"))
    n = F.col("doc_id") % 50
    spec = lambda k: F.concat(F.lit("SWS_"), F.upper("source"), F.lit("_"), F.lpad(k.cast("string"), 5, "0"))
    cap = F.initcap("source")
    head = F.concat(
        spec(n), F.lit(" refers to "), spec((F.col("doc_id") + 7) % 50), F.lit(" and requires "), cap, F.lit("_Init with "),
        cap, F.lit("Config. "),
    )
    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"),
        "doc_id",
        "lang",
        F.concat("source", F.lit(".pdf")).alias("source_pdf"),
        F.element_at(F.array(*[F.lit(r) for r in RELEASES]), ((F.floor(F.col("doc_id") / 100) + F.col("doc_id")) % 4 + 1).cast("int")).alias("release"),
        F.element_at(T.string_map(PLATFORMS), F.col("lang")).alias("platform"),
        F.col("source").alias("module"),
        F.concat(F.lit("ws-"), (F.col("doc_id") % 3).cast("string")).alias("workspace_id"),
        F.concat(F.lit("user-"), (F.col("doc_id") % 5).cast("string")).alias("owner_user_id"),
        F.concat(head, "text").alias("text"),
        F.col("text").alias("body"),
    )


def pages(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """One page per line of a document; with ``parts``, placed by document in that many partitions."""
    of = ["document_id", "release", "platform", "module", "source_pdf"]
    docs = documents(spark, sf_dir).select(*of, "text")
    if parts:
        docs = docs.repartition(parts, "document_id")
    return docs.select(*of, F.posexplode(F.split("text", "\n")).alias("page_index", "text"))


#: Bytes of written chunks whose postings one task takes.
INDEX_BYTES = 2 << 20

_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make, bucket_by: str | None = None, already_placed: bool = False) -> DataFrame:
    """Ingest and index results are written once per application and then read, as a user would."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = written(make(), name, bucket_by, already_placed=already_placed)
    return _BUILT[key]


def once_made(spark: SparkSession, sf_dir: str, name: str, make):
    """What ``make`` has written itself, made once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def atomic_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.atomic_chunks(C.normalized_pages(pages(spark, sf_dir)))


def parts(df: DataFrame, bytes_per_part: int) -> int:
    """Partitions for a table, counted by its size."""
    return max(-(-source_bytes(df) // bytes_per_part), df.sparkSession.sparkContext.defaultParallelism)


def atomics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atomic chunks, written bucketed by document; their normalized text is their text, so it is stored once."""
    def make():
        n = parts(table(spark, sf_dir, "documents"), 4 << 20)
        plan = C.atomic_chunks(C.normalized_pages(pages(spark, sf_dir, n)))
        made = written(plan.drop("normalized_text"), "atomics", "document_id", n, already_placed=True)
        return made.select(*[F.col("text").alias(c) if c == "normalized_text" else F.col(c) for c in plan.columns])

    return once_made(spark, sf_dir, "atomics", make)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atomic and context chunks.

    A context's text is its members' texts, which hold single blanks only, with blank lines between
    them; its normalized text follows from it and is not stored.
    """
    def make():
        every = atomics(spark, sf_dir)
        made = written(C.with_contexts(every.drop("normalized_text")), "chunks")
        flat = F.when(F.col("chunk_kind") == "context", F.replace("text", F.lit("\n\n"), F.lit(" "))).otherwise(F.col("text"))
        return made.select(*[flat.alias(c) if c == "normalized_text" else F.col(c) for c in every.columns])

    return once_made(spark, sf_dir, "chunks", make)


def index_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the index: a chunk's postings are sorted and counted in memory, however large the table is."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts(chunks(spark, sf_dir), INDEX_BYTES))


def term_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, len, terms, tfs, copies) of all chunks, bucketed by chunk; chunks of one id and length are one row."""
    def make():
        n = index_parts(spark, sf_dir)
        made = written(I.term_lists(I.indexed_text(chunks(spark, sf_dir)), parts=n), "term_lists", "chunk_id", n, already_placed=True)
        again = written(made.groupBy("chunk_id").count().where("count > 1").select("chunk_id"), "repeated_chunks")
        if again.isEmpty():
            return made.withColumn("copies", F.lit(1).cast("long"))
        rows = made.join(again, "chunk_id", "left_semi")
        terms = I.postings_of(rows).groupBy("chunk_id", "len", "term").agg(F.sum("tf").cast("int").alias("tf"))
        terms = terms.groupBy("chunk_id", "len").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))
        rows = rows.groupBy("chunk_id", "len").agg(F.count("*").alias("copies")).join(terms, ["chunk_id", "len"], "left")
        none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)")).alias(c)
        rows = rows.select("chunk_id", "len", none("terms", "string"), none("tfs", "int"), "copies")
        once_each = made.join(again, "chunk_id", "left_anti").withColumn("copies", F.lit(1).cast("long"))
        return written(once_each.unionByName(rows), "term_lists", "chunk_id", n)

    return once_made(spark, sf_dir, "term_lists", make)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of all chunks, placed by chunk."""
    return I.postings_of(term_lists(spark, sf_dir))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term lists of all chunks by shard, made where the chunks lie."""
    return once_made(spark, sf_dir, "shards", lambda: B.shards(I.indexed_text(chunks(spark, sf_dir)), shard_buckets(spark, sf_dir)))


def shard_buckets(spark: SparkSession, sf_dir: str) -> int:
    return parts(chunks(spark, sf_dir), 4 << 20)


def listed(spark: SparkSession, sf_dir: str) -> bool:
    """Whether term lists by chunk are written already; what both tables tell is then read from these."""
    return (spark.sparkContext.applicationId, sf_dir, "term_lists") in _BUILT


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, len) of every chunk; a chunk without tokens has length 0.

    Chunks that share an id take the length of one that has tokens.
    """
    if listed(spark, sf_dir):
        one = F.coalesce(F.max(F.when(F.col("len") > 0, F.col("len"))), F.lit(0)).alias("len")
        ids = term_lists(spark, sf_dir).groupBy("chunk_id").agg(one, F.sum("copies").alias("copies"))
    else:
        ids = B.about_texts(shards(spark, sf_dir))
    return ids.select("chunk_id", "len", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("chunk_id", "len")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "stats", lambda: lengths(spark, sf_dir).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms with their document frequency."""
    def make():
        return I.vocabulary(I.document_frequency(postings(spark, sf_dir)) if listed(spark, sf_dir) else B.shard_frequency(shards(spark, sf_dir)))

    return once(spark, sf_dir, "vocabulary", make)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit TF-IDF rows with their counts, bucketed by chunk."""
    def make():
        n = index_parts(spark, sf_dir)
        rows = I.tfidf_weights(postings(spark, sf_dir), vocabulary(spark, sf_dir), stats(spark, sf_dir), keep=("tf", "len"), parts=n)
        return written(rows, "weights", "chunk_id", n, already_placed=True)

    return once_made(spark, sf_dir, "weights", make)


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, no) of all chunks, as their shards hold them."""
    return B.about_texts(shards(spark, sf_dir)).select("chunk_id", "no")


def blocks(spark: SparkSession, sf_dir: str) -> B.Counted:
    """Posting blocks of both channels."""
    make = lambda: B.shard_blocks(shards(spark, sf_dir), vocabulary(spark, sf_dir), stats(spark, sf_dir), shard_buckets(spark, sf_dir))
    return once_made(spark, sf_dir, "blocks", make)


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ident, chunk_id) of all chunks."""
    return once(spark, sf_dir, "identifiers", lambda: I.exact_ids(chunks(spark, sf_dir)))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark passages as questions (query_id, text)."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("q-"), F.col("item_id").cast("string")).alias("query_id"), F.col("text"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, document_id): a row for every question and document whose text holds the passage, of whatever length."""
    q = questions(spark, sf_dir)
    d = documents(spark, sf_dir)
    held = passages_held(q.select("text"), d.select("document_id", "body"), "document_id", "body")
    return held.join(broadcast_if_small(q), "text").select("query_id", "document_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations as logged questions, with the next assistant turn's outcome."""
    c = table(spark, sf_dir, "conversations")
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    n = F.length("answer")
    return (
        c.where("role = 'user'")
        .join(answer, ["conv_id", "turn"], "left")
        .select(
            F.concat_ws("-", F.lit("log"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
            "conv_id", "turn", F.col("text").alias("query"), "answer",
            F.when(n.isNull(), "CLARIFY").when(n < 120, "ABSTAIN").when(n < 300, "PARTIAL").otherwise("ANSWERED").alias("outcome"),
            F.element_at(
                F.array(F.lit("definition"), F.lit("configuration"), F.lit("unknown")), (F.col("conv_id") % 3 + 1).cast("int")
            ).alias("intent"),
        )
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a plan derived from their number: modules, platforms, releases, identifiers."""
    n = F.col("item_id")
    src = (n % 20).cast("string")
    none = F.expr("cast(array() as array<string>)")
    one = lambda c: F.array(c)
    spec = F.concat(F.lit("SWS_SRC"), src, F.lit("_"), F.lpad((n % 50).cast("string"), 5, "0"))
    intents = F.array(*[F.lit(i) for i in INTENTS])
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q-"), n.cast("string")).alias("query_id"),
        F.when(n % 3 == 1, F.concat("text", F.lit(" "), spec)).otherwise(F.col("text")).alias("text"),
        F.element_at(intents, (n % 5 + 1).cast("int")).alias("intent"),
        F.when(n % 3 == 0, one(F.lit("Classic"))).otherwise(none).alias("platforms"),
        F.when(n % 4 == 1, one(F.lit("4.4"))).when(n % 4 == 2, F.array(F.lit("4.2.2"), F.lit("R22-11"))).otherwise(none).alias("releases"),
        F.when(n % 4 == 1, "exact").when(n % 4 == 2, "comparison").otherwise("none").alias("release_mode"),
        F.when(n % 5 == 0, one(F.lit("nowhere"))).when(n % 2 == 0, one(F.concat(F.lit("src"), src))).otherwise(none).alias("modules"),
        none.alias("asil_levels"),
        F.when(n % 3 == 1, one(spec)).when(n % 7 == 3, one(F.concat(F.lit("SWS_SRC"), src, F.lit("_")))).otherwise(none).alias("requirement_ids"),
        F.when(n % 6 == 2, one(F.concat(F.lit("Src"), src, F.lit("_Init")))).otherwise(none).alias("api_names"),
        none.alias("configuration_parameters"),
    )


INTENTS = ("definition", "api_lookup", "configuration", "comparison", "unknown")
