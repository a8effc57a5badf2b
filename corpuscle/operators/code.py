"""Advisory source scan, call sites, call-to-port matches and test-failure clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions import vocab as V
from corpuscle.operators.substrings import contained

#: Stands before matches; a text that holds it already holds another control character instead.
MARK = "\x01"


def advisory_scan(files: DataFrame) -> DataFrame:
    """(path, line, rule, location, message): every match of every rule in the whole text.

    A match may span lines; its line is that of its first character, counted from the text before it.
    """
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    text = F.translate("text", MARK, "\x02")

    def hits_of(rule: str, pattern: str, message: str):
        # One pass of the pattern puts a mark before each match; the line of a match is counted from the pieces before it.
        first = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<int>)").alias("lines"))
        lines = lambda pieces: F.aggregate(
            F.slice(pieces, 1, F.size(pieces) - 1), first,
            lambda s, x: F.struct((s["at"] + breaks(x)).alias("at"), F.concat(s["lines"], F.array(s["at"] + breaks(x))).alias("lines")),
            lambda s: s["lines"])
        marked = F.split(F.regexp_replace(text, pattern, MARK + "$0"), MARK, -1)
        return F.transform(T.let(marked, lines), lambda n: F.struct(n.alias("line"), F.lit(rule).alias("rule"), F.lit(message).alias("why")))

    hits = files.select("path", F.explode(F.concat(*[hits_of(*r) for r in V.CODE_RULES])).alias("h"))
    return hits.select(
        "path", "h.line", "h.rule", F.concat_ws(":", "path", F.col("h.line").cast("string")).alias("location"),
        F.concat("h.why", F.lit(f" [{V.ADVISORY}]")).alias("message"),
    )


def call_sites(files: DataFrame) -> DataFrame:
    """(path, calls): sorted runtime calls of a file, repeats kept."""
    return files.select("path", F.array_sort(T.found(F.col("text"), V.RTE_CALL, 0)).alias("calls"))


def call_port_matches(calls: DataFrame, ports: DataFrame) -> DataFrame:
    """(link_id, call, port, confidence): ports whose normalised name occurs in the normalised call.

    Calls and ports meet on a port's rarest gram among the calls.
    """
    c = calls.select("call").distinct().withColumn("hay", F.replace(F.lower("call"), F.lit("_"), F.lit("")))
    p = ports.select("port").distinct().withColumn("needle", F.replace(F.lower("port"), F.lit(" "), F.lit("")))
    return contained(p, c).join(p, "needle").join(c, "hay").select(
        F.concat("call", F.lit("->"), "port").alias("link_id"), "call", "port", F.lit(0.6).alias("confidence"),
        F.concat(F.lit("name overlap: "), "call", F.lit(" ~ "), "port").alias("evidence"),
    ).distinct()


def failure_clusters(results: DataFrame) -> DataFrame:
    return results.where("status <> 'passed'").groupBy("status", "message").agg(F.count("*").alias("n"))
