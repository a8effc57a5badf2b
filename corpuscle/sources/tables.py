"""Record tables: JSON lines, review CSV, JSON-text columns, bundles, appends, run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY
from pyspark.sql.window import Window as W

GOLDEN = (
    "query_id string, question string, category string, difficulty string, answerable boolean, "
    "needs_expert_review boolean, gold_answer string, gold_evidence_ids array<string>, required_versions array<string>, "
    "required_platforms array<string>, required_modules array<string>, gold_source_documents array<string>, "
    "gold_sections array<string>, gold_requirement_ids array<string>, tags array<string>, gold_pages array<int>, "
    "gold_claims array<struct<claim:string,source:string,page:int>>, expected_answer_type string, source string, notes string"
)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden items from JSON lines; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)


def write_golden(items: DataFrame, path: str) -> None:
    """JSON lines with fields in name order."""
    items.select(*sorted(items.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def review_rows(items: DataFrame) -> DataFrame:
    """Flat review table: lists joined with ' | ', three empty decision columns."""
    flat = [
        F.array_join(f.name, " | ").alias(f.name) if isinstance(f.dataType, TY.ArrayType) and isinstance(f.dataType.elementType, TY.StringType) else F.col(f.name)
        for f in items.schema.fields
    ]
    blank = [F.lit("").alias(c) for c in ("review_decision", "review_comment", "reviewer")]
    return items.select(*flat, *blank)


def write_review(items: DataFrame, path: str) -> None:
    review_rows(items).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def pending_reviews(rows: DataFrame) -> DataFrame:
    return rows.where(F.trim(F.coalesce("review_decision", F.lit(""))) == "")


def read_review(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def decoded_lists(rows: DataFrame, columns: tuple[str, ...] = ("requirement_ids", "api_names", "ecu_parameters")) -> DataFrame:
    """JSON text columns to arrays; missing or bad JSON is an empty array."""
    return rows.withColumns({c: F.coalesce(F.from_json(c, "array<string>"), F.expr("cast(array() as array<string>)")) for c in columns})


def export_bundles(messages: DataFrame) -> DataFrame:
    """One nested record per conversation with its ordered messages."""
    items = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(F.lit("session/1").alias("format"), items.alias("messages"))


def import_bundles(bundles: DataFrame) -> DataFrame:
    """Messages of bundles; only user and assistant turns are taken."""
    rows = bundles.where("format = 'session/1'").select("conv_id", F.explode("messages").alias("m"))
    return rows.select("conv_id", "m.*").where(F.col("role").isin("user", "assistant"))


def test_result_rows(results: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(run row, result rows) of one batch: generated ids, status ``unknown`` when missing."""
    status = F.when(F.coalesce("status", F.lit("")) == "", "unknown").otherwise(F.col("status"))
    rows = results.withColumns(
        {
            "run_id": F.lit(run_id),
            "status": status,
            "result_id": F.concat(F.lit("res-"), F.substring(F.sha2(F.concat_ws("|", F.lit(run_id), *results.columns), 256), 1, 12)),
        }
    )
    run = rows.agg(
        F.lit(run_id).alias("run_id"), F.count("*").alias("total"), F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") == "unknown").alias("unknown"),
    )
    return run, rows


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def run_history(history: DataFrame, run: DataFrame, keep: int | None = None) -> DataFrame:
    """Run history with a new run; the latest ``keep`` only, if given."""
    every = history.unionByName(run)
    return every if keep is None else every.orderBy(F.desc("generated_at"), "run_id").limit(keep)


def write_run(rows: DataFrame, aggregate: DataFrame, path: str) -> None:
    """Evaluation sinks: per-item JSON, aggregate JSON and a CSV of failures."""
    rows.write.mode("overwrite").json(f"{path}/items")
    aggregate.write.mode("overwrite").json(f"{path}/latest")
    flat = [c for c, t in rows.dtypes if not t.startswith(("array", "struct", "map"))]
    rows.where("failure <> 'ok'").select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/failures")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
