"""Content risk, reversible redaction and local/cloud routing, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions import vocab as V


def content_risk(text: Column, filename: Column, declared: Column) -> Column:
    """(classification, findings, cloud_eligible, redaction_required) of one text."""
    t = F.coalesce(text, F.lit(""))
    name = F.lower(F.coalesce(filename, F.lit("")))
    said = F.coalesce(declared, F.lit(""))
    any_of = lambda ws: reduce(lambda a, b: a | b, [name.contains(w) for w in ws])
    arxml = t.rlike(V.ARXML_TAG) | name.endswith(".arxml")
    code = name.rlike(r"\.(c|h|cpp|hpp)$") | t.rlike(V.C_SOURCE)
    vendor, customer = any_of(V.VENDOR_NAMES), any_of(V.CUSTOMER_NAMES)
    pii = t.rlike(V.EMAIL) | t.rlike(V.VIN)
    credential, address = t.rlike(V.CREDENTIAL), t.rlike(V.PRIVATE_IP_SHORT)
    hard = credential | arxml | code | vendor | customer
    soft = pii | address | said.isin("confidential", "restricted")
    finding = lambda cond, label: F.when(cond, F.lit(label))
    return F.struct(
        F.when(hard, "confidential")
        .when(soft, F.when(said != "", said).otherwise("confidential"))
        .when(said.isin("public", "internal"), said)
        .otherwise("internal")
        .alias("classification"),
        F.array_compact(
            F.array(
                finding(arxml, "arxml artifact"), finding(code, "source code"), finding(vendor, "vendor document"),
                finding(customer, "oem/customer document"), finding(pii, "pii detected"),
                finding(credential, "credential/secret pattern"), finding(address, "private network identifier"),
            )
        ).alias("findings"),
        (~hard & ~soft & (said == "public")).alias("cloud_eligible"),
        (pii | address).alias("redaction_required"),
    )


def _substituted(text: Column, pattern: str, kind: str, first: Column) -> Column:
    """(out, pairs): every match of ``pattern`` replaced by its token, the rest of the text untouched.

    Equal values share a token, numbered from ``first`` + 1 in order of appearance.
    """
    def build(found: Column) -> Column:
        values = F.array_distinct(found)
        number = lambda v: F.format_string(f"<{kind}_%03d>", (F.array_position(values, v) + first).cast("int"))
        pieces = F.split(text, pattern, -1)  # one more than matches
        joined = F.array_join(F.flatten(F.zip_with(pieces, found, lambda p, v: F.array(p, F.coalesce(F.when(v.isNotNull(), number(v)), F.lit(""))))), "")
        return F.struct(joined.alias("out"), F.transform(values, lambda v: F.struct(number(v).alias("token"), v.alias("value"))).alias("pairs"))

    return T.let(T.found(text, pattern, 0), build)


def redact(text: Column, project_hint: Column | None = None, parity: bool = False) -> Column:
    """(redacted, tokens): each sensitive value becomes ``<KIND_001>``, the same value the same token.

    Kinds are replaced at their matches, in a fixed order, on the text the previous kinds left behind.
    """
    rules = [("VIN", V.VIN), ("INTERNAL_IP", V.PRIVATE_IP_SHORT if parity else V.PRIVATE_IP), ("EMAIL", V.EMAIL)]

    def step(state: Column, pattern: str, kind: str, first: Column) -> Column:
        done = T.let(state["out"], lambda t: _substituted(t, pattern, kind, first))
        return T.let(done, lambda x: F.struct(x["out"].alias("out"), F.concat(state["pairs"], x["pairs"]).alias("pairs")))

    none = F.expr("cast(array() as array<struct<token:string,value:string>>)")
    state = F.struct(text.alias("out"), none.alias("pairs"))
    next_kind = lambda kind, pattern: lambda st: step(st, pattern, kind, F.lit(0))
    for kind, pattern in rules:
        state = T.let(state, next_kind(kind, pattern))
    hint = F.coalesce(project_hint, F.lit("")) if project_hint is not None else F.lit("")

    def projects(st: Column) -> Column:
        hinted = (hint != "") & st["out"].contains(hint)
        token = F.struct(F.lit("<PROJECT_001>").alias("token"), hint.alias("value"))
        out = F.when(hinted, F.replace(st["out"], hint, F.lit("<PROJECT_001>"))).otherwise(st["out"])
        pairs = F.when(hinted, F.concat(st["pairs"], F.array(token))).otherwise(st["pairs"])
        return T.let(F.struct(out.alias("out"), pairs.alias("pairs")), lambda x: step(x, V.PROJECT_NAME, "PROJECT", F.when(hinted, 1).otherwise(0)))

    return T.let(T.let(state, projects), lambda st: F.struct(st["out"].alias("redacted"), st["pairs"].alias("tokens")))


def restore(text: Column, tokens: Column) -> Column:
    return F.aggregate(tokens, text, lambda acc, x: F.replace(acc, x["token"], x["value"]))


def route(task: Column, policy: Column, eligible: Column) -> Column:
    """(route, reason, redacted) of a task under a cloud policy."""
    local_task = task.isin(*V.LOCAL_ONLY_TASKS) & (policy == "local_only")
    denied = (policy == "local_only") | ~eligible
    word = F.when(eligible, "True").otherwise("False")
    allowed = policy.isin("cloud_redacted_only", "cloud_metadata_only", "cloud_allowed")
    return F.struct(
        F.when(~local_task & ~denied & allowed, "cloud").otherwise("local").alias("route"),
        F.when(local_task, F.concat(F.lit("task "), task, F.lit(" is local-only under current policy")))
        .when(denied, F.concat(F.lit("policy="), policy, F.lit("; eligible="), word))
        .when(policy == "cloud_redacted_only", "explicit policy allows redacted cloud")
        .when(allowed, "explicit policy + public classification")
        .otherwise("default-deny fallback")
        .alias("reason"),
        (~local_task & ~denied & (policy == "cloud_redacted_only")).alias("redacted"),
    )
