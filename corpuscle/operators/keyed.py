"""Keyed tables: upsert, supersession, snapshots, record diff, release delta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def last_per_key(rows: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """One row per key: the last by ``order``.  An aggregate, so a hot key is combined before the exchange."""
    keys = [key] if isinstance(key, str) else key
    orders = [order] if isinstance(order, str) else order
    packed = F.max_by(F.struct(*rows.columns), F.struct(*orders)).alias("row")
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(packed).select("row.*")


def first_per_key(rows: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    orders = [order] if isinstance(order, str) else order
    packed = F.min_by(F.struct(*rows.columns), F.struct(*orders)).alias("row")
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(packed).select("row.*")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """``old`` with the last row of ``new`` per key put in place."""
    keys = [key] if isinstance(key, str) else key
    fresh = last_per_key(new, keys, order)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*old.columns))


def replace_snapshot(old: DataFrame, new: DataFrame, snapshot_id: str, key: str, order: str) -> DataFrame:
    """Rows of other snapshots leave; the current snapshot's rows are upserted."""
    return upsert(old.where(F.col("snapshot_id") == snapshot_id), new, key, order)


def supersedes(docs: DataFrame, path: str, key: str, content_hash: str) -> DataFrame:
    """Adds ``supersedes``: the earliest document of the same path, when its content differs.

    The first document of a path is an aggregate joined back, so a path with very many versions
    is never held in one window.
    """
    firsts = docs.groupBy(path).agg(F.min_by(F.struct(key, content_hash), F.col(key)).alias("_first"))
    out = docs.join(firsts, path)
    differs = F.col(content_hash) != F.col(f"_first.{content_hash}")
    return out.withColumn("supersedes", F.when(differs, F.col(f"_first.{key}"))).drop("_first")


def diff_records(base: DataFrame, target: DataFrame, domain: str, key: str = "entity_key") -> DataFrame:
    """Keyed diff by exact equality of ``normalized``; both sides' values and evidence are kept."""
    b = base.select(F.col(key).alias("entity_key"), F.struct(F.col("normalized").alias("v"), F.col("evidence_ids").alias("e")).alias("b"))
    t = target.select(F.col(key).alias("entity_key"), F.struct(F.col("normalized").alias("v"), F.col("evidence_ids").alias("e")).alias("t"))
    both = b.join(t, "entity_key", "full_outer")
    kind = (
        F.when(F.col("b").isNull(), "added")
        .when(F.col("t").isNull(), "removed")
        .when(F.col("b.v").eqNullSafe(F.col("t.v")), "unchanged")
        .otherwise("modified")
    )
    pick = lambda added, removed, modified: (
        F.when(F.col("change_type") == "added", added).when(F.col("change_type") == "removed", removed).when(F.col("change_type") == "modified", modified)
    )
    return both.withColumn("change_type", kind).select(
        F.lit(domain).alias("domain"),
        "entity_key",
        "change_type",
        F.coalesce(pick("info", "high", "warning"), F.lit("info")).alias("severity"),
        F.col("b.v").alias("base_value"),
        F.col("t.v").alias("target_value"),
        F.col("b.e").alias("base_evidence_ids"),
        F.col("t.e").alias("target_evidence_ids"),
        F.coalesce(
            pick("new entity — verify integration impact", "removed entity — migration break risk", "signature/content changed — review callers"),
            F.lit(""),
        ).alias("compatibility_risk"),
        pick("adopt and test", "replace or remove usage", "update call sites and parameter references").alias("migration_action"),
    )


def release_delta(chunks: DataFrame, base: str, target: str, show: int | None = None) -> DataFrame:
    """One row for each chunk and requirement id added or removed (the first ``show`` of a kind and side,
    if given), with the number of its kind and side and the chunks of both releases.

    Set differences are found by grouping on the id with one flag per side; at most four counts are joined.
    """
    both = chunks.where(F.col("release").isin(base, target)).withColumn("is_base", F.col("release") == base)

    def sides(ids: DataFrame) -> DataFrame:
        g = ids.groupBy("id").agg(F.max(F.col("is_base").cast("int")).alias("b"), F.max((~F.col("is_base")).cast("int")).alias("t"))
        return g.where("b <> t").select("id", F.when(F.col("t") == 1, "added").otherwise("removed").alias("side"))

    ck = sides(both.select(F.col("chunk_id").alias("id"), "is_base")).withColumn("what", F.lit("chunks"))
    rq = sides(both.select(F.explode("requirement_ids").alias("id"), "is_base")).withColumn("what", F.lit("requirements"))
    every = ck.unionByName(rq)
    top = every if show is None else every.withColumn("rn", F.row_number().over(W.partitionBy("what", "side").orderBy("id"))).where(F.col("rn") <= show)
    counts = every.groupBy("what", "side").agg(F.count("*").alias("n"))
    sizes = both.agg(F.count_if("is_base").alias("base_chunks"), F.count_if(~F.col("is_base")).alias("target_chunks"))
    return top.join(F.broadcast(counts), ["what", "side"]).select(  # two kinds, two sides
        F.lit(base).alias("base"), F.lit(target).alias("target"), "what", "side", "id", "n",
        sizes.select("base_chunks").scalar().alias("base_chunks"), sizes.select("target_chunks").scalar().alias("target_chunks"),
    )


def conflicts(evidence: DataFrame) -> DataFrame:
    """Requirement ids that a question's evidence shows in several releases, per release pair.

    Releases per id are few (the releases of a corpus), so pairing them after ``distinct`` is bounded.
    """
    ids = evidence.select(
        "query_id", F.when(F.col("release") != "", F.col("release")).otherwise("unknown").alias("release"), F.explode("requirement_ids").alias("rid")
    ).distinct()
    a = ids.withColumnRenamed("release", "release_1")
    b = ids.withColumnRenamed("release", "release_2")
    pairs = a.join(b, ["query_id", "rid"]).where("release_1 < release_2")
    return pairs.groupBy("query_id", "release_1", "release_2").agg(F.sort_array(F.collect_set("rid")).alias("requirement_ids"))
