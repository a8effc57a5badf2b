"""Document metadata, multimodal rows, quality reports and payload projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions import vocab as V


def inferred_module(text: Column, aliases: dict[str, str] | None = None, sample_chars: int | None = None,
                    min_hits: int = 5) -> Column:
    """The module a document is about, or ''.

    ``BSW Context <Mod>`` markers decide first: exactly one known module wins; none known, or more
    than three named, means no guess.  Otherwise the most mentioned module needs ``min_hits`` hits.
    """
    aliases = aliases or V.MODULE_ALIASES
    markers = F.array_distinct(T.found(text, r"BSW Context\s+(\w+)", 1))
    table = T.string_map(aliases)
    known = F.array_distinct(
        F.filter(F.transform(markers, lambda m: F.try_element_at(table, F.lower(m))), lambda m: m.isNotNull())
    )
    low = F.lower(F.substring(text, 1, sample_chars) if sample_chars else text)
    by_module: dict[str, list[str]] = {}
    for alias, module in aliases.items():
        by_module.setdefault(module, []).append(alias)

    def hits(alias: str) -> Column:
        return F.regexp_count(low, F.lit(r"(?<![a-z0-9])" + re.escape(alias) + r"(?![a-z0-9])"))

    # Among equal scores the module whose alias comes first in the table and occurs wins.
    position = {a: i for i, a in enumerate(aliases)}
    scored = []
    for module, names in by_module.items():
        total = sum((hits(a) for a in names[1:]), hits(names[0]))
        firsts = [F.when(hits(a) > 0, F.lit(-position[a])) for a in names]
        first = firsts[0] if len(firsts) == 1 else F.coalesce(*firsts)
        scored.append(F.struct(total.alias("n"), first.alias("p"), F.lit(module).alias("module")))
    best = F.array_max(F.array(*scored))
    by_count = F.when(best["n"] >= min_hits, best["module"]).otherwise("")
    return (
        F.when(F.size(markers) == 0, by_count)
        .when(F.size(known) == 1, F.get(known, F.lit(0)))
        .when((F.size(known) == 0) | (F.size(markers) > 3), "")
        .otherwise(by_count)
    )


def page_quality(pages: DataFrame) -> DataFrame:
    """Pages with flags and caption lists."""
    t = F.col("text")
    return pages.withColumns(
        {
            "needs_review": T.page_flags(t),
            "tables": T.captions(t, V.TABLE_CAP),
            "figures": T.captions(t, V.FIGURE_CAP),
        }
    )


def quality_report(pages: DataFrame) -> DataFrame:
    """One row per document: counts, low-text pages, flag histogram, share of clean pages.

    Works on ``page_quality`` output.  All parts are plain aggregates; the histogram is four sums.
    """
    has = lambda f: F.array_contains("needs_review", f)
    flags = ("low_text_density", "broken_encoding", "possible_table_heavy", "missing_requirement_ids")
    flagged = F.sum(F.when(F.size("needs_review") > 0, 1).otherwise(0))
    return pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        F.count_if(has("low_text_density")).alias("pages_with_low_text"),
        F.sum(F.size("tables")).alias("tables_detected"),
        F.sum(F.size("figures")).alias("figures_detected"),
        *[F.count_if(has(f)).alias(f) for f in flags],
        F.bround(1.0 - flagged / F.count("*"), 4).alias("quality_score"),
    )


def content_id(document_id: Column, kind: Column, page: Column, n: Column, text: Column) -> Column:
    h = T.sha12(document_id, kind, page, n, F.coalesce(text, F.lit("")))
    return F.concat_ws("-", kind, document_id, page.cast("string"), n.cast("string"), h)


def multimodal_rows(pages: DataFrame) -> DataFrame:
    """Pages with captions to one text row, n table rows and m figure rows each."""
    flagged = F.size("needs_review") > 0
    base = ["document_id", "page_index"]
    texts = pages.select(
        *base, F.lit("text").alias("content_type"), F.lit(0).alias("n"), F.col("text").alias("raw_text"),
        F.lit(None).cast("string").alias("caption"), F.when(flagged, 0.5).otherwise(1.0).alias("quality_score"),
        flagged.alias("requires_review"), F.col("text").alias("_id_text"),
    )
    tabs = pages.select(*base, F.posexplode("tables").alias("n", "t")).select(
        *base, F.lit("table").alias("content_type"), "n", F.col("t.caption").alias("raw_text"), "t.caption",
        F.lit(0.8).alias("quality_score"), F.lit(False).alias("requires_review"), F.lit("[]").alias("_id_text"),
    )
    kind = F.when(F.col("f.kind").isin("diagram", "equation", "image"), F.col("f.kind")).otherwise("image")
    figs = pages.select(*base, F.posexplode("figures").alias("n", "f")).select(
        *base, kind.alias("content_type"), "n", F.lit(None).cast("string").alias("raw_text"), "f.caption",
        F.lit(0.7).alias("quality_score"), F.lit(False).alias("requires_review"), F.col("f.caption").alias("_id_text"),
    )
    every = texts.unionByName(tabs).unionByName(figs)
    cid = content_id(F.col("document_id"), F.col("content_type"), F.col("page_index"), F.col("n"), F.col("_id_text"))
    return every.withColumn("content_id", cid).drop("_id_text")


def chunk_content(chunks: DataFrame) -> DataFrame:
    """Chunks as multimodal rows: requirement when ids are present, else text."""
    nil = lambda c: F.when(F.col(c) != "", F.col(c))
    return chunks.select(
        F.col("chunk_id").alias("content_id"),
        "document_id",
        F.when(F.size("requirement_ids") > 0, "requirement").otherwise("text").alias("content_type"),
        F.col("text").alias("raw_text"),
        nil("section_number").alias("section"),
        nil("release").alias("release"),
        nil("platform").alias("platform"),
        nil("module").alias("module"),
        "requirement_ids", "api_names", "ecu_parameters",
        F.col("parent_chunk_id").alias("parent_content_id"),
        F.lit(1.0).alias("quality_score"),
    )


def collection_of(content_type: Column) -> Column:
    """Index collection that holds a content type."""
    return (
        F.when(content_type.isin("table"), "tables")
        .when(content_type.isin("image", "diagram", "equation"), "visuals")
        .when(content_type.isin("requirement", "api", "configuration"), F.concat(content_type, F.lit("s")))
        .otherwise("text")
    )


def evidence_rows(ranked: DataFrame) -> DataFrame:
    """Ranked chunks as evidence: defaults filled, names fixed."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return ranked.select(
        "query_id", "rank", "chunk_id", "document_id", text("source_pdf"), text("release"), text("platform"),
        text("module"), text("section_number"), text("section_title"),
        F.coalesce("page_start", F.lit(0)).alias("page_start"), F.coalesce("page_end", F.lit(0)).alias("page_end"),
        F.coalesce("fused_score", F.lit(0.0)).alias("fused_score"),
        F.coalesce("rerank_score", F.lit(0.0)).alias("rerank_score"),
        F.coalesce("exact_hit", F.lit(False)).alias("exact_hit"),
    )


def topology_summary(entities: DataFrame, items: int | None = None, ports: int | None = None, chars: int | None = None) -> DataFrame:
    """Text per artifact over the long entity table: components with ports, connectors, parameters.

    Limits on items of a kind, ports of a component and characters are off by default.
    """
    upto = lambda n: F.lit(True) if n is None else F.col("rn") <= n
    from pyspark.sql.window import Window as W

    own = W.partitionBy("artifact_id", "parent").orderBy("seq")
    port = (
        entities.where("entity = 'port'")
        .withColumn("rn", F.row_number().over(own))
        .where(upto(ports))
        .groupBy("artifact_id", "parent")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "short_name"))), lambda x: x["short_name"]), ", ").alias("ports"))
    )
    ranked = entities.where(F.col("entity").isin("component", "connector", "parameter")).withColumn(
        "rn", F.row_number().over(W.partitionBy("artifact_id", "entity").orderBy("seq"))
    ).where(upto(items))
    side = port.withColumnsRenamed({"parent": "qualified_name"})
    lines = ranked.join(side, ["artifact_id", "qualified_name"], "left").select(
        "artifact_id",
        F.when(F.col("entity") == "component", 0).when(F.col("entity") == "connector", 1).otherwise(2).alias("kind_order"),
        "rn",
        F.when(F.col("entity") == "component", F.concat(F.lit("SWC "), "short_name", F.lit(" ["), "kind", F.lit("]: "), F.coalesce("ports", F.lit(""))))
        .when(F.col("entity") == "connector", F.concat(F.lit("CONN ["), "kind", F.lit("]: "), F.coalesce("ref", F.lit("?")), F.lit(" -> "), F.coalesce("ref2", F.lit("?"))))
        .otherwise(F.concat(F.lit("ECUC "), "qualified_name", F.lit(" = "), F.coalesce("value", F.lit(""))))
        .alias("line"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("kind_order", "rn", "line")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return lines.groupBy("artifact_id").agg((text if chars is None else F.substring(text, 1, chars)).alias("summary"))
