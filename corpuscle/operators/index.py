"""Index tables: postings, term statistics, weights, identifiers.

The index is partitioned by chunk, like the shards of a search engine: one exchange places a
chunk's tokens, and counting, weighting and scoring by chunk all reuse that placement.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscle.functions import text as T
from corpuscle.functions import vocab as V
from corpuscle.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the plan: workers need no copy of the package

#: A side is broadcast only when the tables it is read from are known to be at most this large.
BROADCAST_BYTES = 16 << 20


def source_bytes(df: DataFrame) -> int:
    """Size of a DataFrame as the optimizer knows it (file sizes for scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, source: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` when its source is within ``limit``; otherwise leave a shuffle join to AQE."""
    return F.broadcast(df) if source_bytes(df if source is None else source) <= limit else df


def indexed_text(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.concat_ws(" ", F.coalesce("section_title", F.lit("")), "normalized_text").alias("text"))


def tokenized(texts: DataFrame, key: str = "chunk_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(key, tokens), placed by key in ``parts`` partitions: the one exchange of the index.

    Text travels, not tokens: it is a third of their size.
    """
    n = parts or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.select(key, F.col(text).alias("_text")).repartition(n, key).select(key, T.technical_tokens(F.col("_text")).alias("tokens"))


def term_lists(texts: DataFrame, key: str = "chunk_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(key, len, terms, tfs), placed by key in ``parts`` partitions: the postings of ``postings`` with a row per text.

    Words are counted by their codes in a batch, and a word's parts are looked for once a batch and not once
    an occurrence.
    """
    n = parts or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = texts.schema[key].dataType.simpleString()
    token, sub_token = V.TOKEN, V.SUB_TOKEN  # both match ASCII only
    placed = texts.select(key, F.col(text).alias("_text")).repartition(n, key)
    return placed.mapInArrow(lambda batches: _counted(batches, token, sub_token), f"{key} {kind}, len int, terms array<string>, tfs array<int>")


def _counted(batches, token: str, sub_token: str):
    import re
    from itertools import chain

    import numpy as np
    import pyarrow as pa

    whole, part = re.compile(token), re.compile(sub_token)
    for batch in batches:
        found = [whole.findall(text or "") for text in batch.column(1).to_pylist()]
        row = np.repeat(np.arange(len(found)), [len(ws) for ws in found])
        coded = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
        code, names = coded.indices.to_numpy(), {}
        forms, sizes = [], []
        for word in coded.dictionary.to_pylist():
            own = [names.setdefault(t.lower(), len(names)) for t in (word, *part.findall(word)) if len(t) > 1]
            forms.extend(own)
            sizes.append(len(own))
        forms, sizes = np.array(forms, np.int64), np.array(sizes, np.int64)
        first, many = np.cumsum(sizes) - sizes, sizes[code]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row = np.repeat(row, many)
        pair, tf = np.unique(row * max(len(names), 1) + forms[np.repeat(first[code], many) + nth], return_counts=True)
        ends = np.searchsorted(pair, (np.arange(len(found) + 1)) * max(len(names), 1))
        lists = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        terms = pa.array(list(names), pa.string()).take(pa.array(pair % max(len(names), 1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.bincount(row, minlength=len(found)), pa.int32()), lists(terms), lists(pa.array(tf, pa.int32()))],
            names=[batch.schema.names[0], "len", "terms", "tfs"])


def postings_of(lists: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, term, tf, len) of ``term_lists``, in their placement."""
    one = F.explode(F.arrays_zip("terms", "tfs")).alias("p")
    return lists.select(key, "len", one).select(key, "len", F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf"))


def token_counts(texts: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, len) of every row: counted where the text lies, without the exchange of ``tokenized``."""
    return texts.select(key, F.size(T.technical_tokens(F.col(text))).alias("len"))


def postings(tokens: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, term, tf, len): counted inside the placement of ``tokenized``."""
    return (
        tokens.select(key, F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
        .groupBy(key, "len", "term")
        .agg(F.count("*").alias("tf"))
    )


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: number of chunks and mean token count."""
    return tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_len"))


def document_frequency(posts: DataFrame, only_terms: DataFrame | None = None) -> DataFrame:
    if only_terms is not None:
        posts = posts.join(only_terms, "term", "left_semi")
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Terms with their document frequency; ``limit`` keeps the most frequent ones, ties by term."""
    return df.orderBy(F.desc("df"), "term").limit(limit) if limit else df


def tfidf_weights(posts: DataFrame, vocab: DataFrame, stats: DataFrame, key: str = "chunk_id",
                  limit: int | None = None, keep: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """(key, term, w): augmented TF-IDF rows of unit length, with the columns of ``posts`` named in ``keep``.

    ``vocab`` is broadcast if ``limit`` bounds its rows or its table is small; otherwise rows meet it by term and
    then return to their key, in ``parts`` partitions if given.
    """
    n = stats.select("n").scalar()
    by_key = W.partitionBy(key)
    side = F.broadcast(vocab) if limit else broadcast_if_small(vocab)
    raw = (
        posts.withColumn("max_tf", F.max("tf").over(by_key))
        .join(side, "term")
        .withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)
        .select(key, "term", ((0.5 + 0.5 * F.col("tf") / F.col("max_tf")) * F.col("idf")).alias("raw"), *keep)
    )
    if parts and not limit and source_bytes(vocab) > BROADCAST_BYTES:
        raw = raw.repartition(parts, key)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(by_key))
    return raw.withColumn("norm", norm).select(
        key, "term", (F.col("raw") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"), *keep
    )


def exact_ids(chunks: DataFrame) -> DataFrame:
    """(ident, chunk_id): lower-cased identifiers of the three signal arrays."""
    ids = F.concat("requirement_ids", "api_names", "ecu_parameters")
    return chunks.select(F.explode(ids).alias("ident"), "chunk_id").select(F.lower("ident").alias("ident"), "chunk_id").distinct()


def unit_vectors(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """Vectors scaled to length one; a zero vector stays zero."""
    as_double = F.transform(col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn("_norm", norm).withColumn(
        col, F.transform(as_double, lambda x: x / F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm")))
    ).drop("_norm")


def encode_texts(texts: DataFrame, encoder, dim: int, text: str = "text", placeholder: str = " ") -> DataFrame:
    """Adds ``embedding`` from a caller's ``list[str] -> array`` encoder in Arrow batches, and ``encode_failed``.

    Blank text is replaced by a placeholder.  A failed batch is tried again text by text, so only the
    texts that fail on their own get a zero vector, and they are marked.
    """
    @F.pandas_udf("embedding array<float>, encode_failed boolean")
    def run(batch: pd.Series) -> pd.DataFrame:
        import numpy as np

        items = [t if t and t.strip() else placeholder for t in batch]
        failed = np.zeros(len(items), bool)
        try:
            out = np.asarray(encoder(items), dtype="float32").reshape(len(items), dim)
        except Exception:  # noqa: BLE001  (the encoder is the caller's)
            out = np.zeros((len(items), dim), dtype="float32")
            for i, t in enumerate(items):
                try:
                    out[i] = np.asarray(encoder([t]), dtype="float32").reshape(dim)
                except Exception:  # noqa: BLE001
                    failed[i] = True
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.DataFrame({"embedding": list(out / np.where(norms == 0, 1, norms)), "encode_failed": failed})

    return texts.withColumn("_e", run(F.col(text))).withColumn("embedding", F.col("_e.embedding")).withColumn("encode_failed", F.col("_e.encode_failed")).drop("_e")


def hashed_encoder(dim: int = 64):
    """A default encoder without a model: signed hashing of technical-looking words."""

    def encode(texts):
        import re
        import zlib

        import numpy as np

        found = [re.findall(r"[A-Za-z0-9_]+", t.lower()) for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(ws) for ws in found])
        hashes = np.fromiter((zlib.crc32(w.encode()) for ws in found for w in ws), np.int64, len(rows))
        out = np.zeros((len(texts), dim), dtype="float32")
        np.add.at(out, (rows, hashes % dim), np.where(hashes & 0x80000000, 1.0, -1.0))
        return out

    return encode


def save_index(chunks: DataFrame, path: str, buckets: int | None = None) -> None:
    """Write postings (clustered by term), chunk lengths and the fingerprint under ``path``."""
    from corpuscle.operators.chunks import fingerprint

    texts = indexed_text(chunks)
    # Written first, because a range is cut from a sample: otherwise all text is tokenized for the sample too.
    posts = written(postings(tokenized(texts)), "saved_postings")
    placed = posts.repartitionByRange(buckets, "term", "chunk_id") if buckets else posts.repartitionByRange("term", "chunk_id")
    placed.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    token_counts(texts).write.mode("overwrite").parquet(f"{path}/lengths")
    fingerprint(chunks).write.mode("overwrite").parquet(f"{path}/fingerprint")


def load_index(spark, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "fingerprint")}


def index_is_fresh(chunks: DataFrame, saved_fingerprint: DataFrame) -> bool:
    from corpuscle.operators.chunks import fingerprint

    return fingerprint(chunks).exceptAll(saved_fingerprint).isEmpty()
