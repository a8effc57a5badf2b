"""Golden-set generation from a corpus: question families with verbatim answers and gold ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions import vocab as V
from corpuscle.operators.evaluation import coverage
from corpuscle.session import written

# Question templates per family.
TEMPLATES = {
    "requirement_lookup": (
        "What does the requirement %s specify?",
        "State the requirement %s and the condition it places on the implementation.",
    ),
    "api_lookup": (
        "What is the role of %s in the architecture?",
        "Which interface or element is named %s, and what does it specify?",
        "Describe the element %s as the specification defines it.",
    ),
    "configuration": (
        "Which configuration parameter is named %s, and what does it configure?",
        "How is %s configured in the system template?",
        "What does the ECUC parameter %s control?",
    ),
    "definition": (
        "Explain the content of the section titled '%s'.",
        "What is specified under '%s'?",
    ),
    "runtime_behaviour": (
        "What runtime behaviour does the specification prescribe in '%s'?",
        "Describe the behaviour required at runtime under '%s'.",
    ),
    "table_lookup": ("What does the table '%s' list?",),
    "diagram_lookup": ("What does the figure '%s' show?",),
    "unanswerable": (
        "What is the initialization sequence of the %s module?",
        "Which configuration containers does %s require in the ECU extract?",
        "List the error codes that %s can return.",
    ),
    "code_explanation": ("Which C function in the project sources implements the %s handling logic?",),
    "test_analysis": ("Which test case verifies the %s requirement?",),
    "traceability": ("Which requirement is traceable to the %s configuration parameter?",),
    "impact_analysis": ("Which modules are affected if the %s routing changes?",),
}
# Identifiers that exist nowhere.
FAKE_IDS = (
    "SWS_CanIf_00123", "PRS_SOMEIP_99001", "SRS_Dcm_00042", "constr_E2E_77777", "SWS_PduR_00444",
    "PRS_SOMEIP_99002", "SRS_EcuM_00021", "TPS_Com_00333", "SWS_Dem_00777", "PRS_E2E_99003",
)
GAP_FAMILIES = ("code_explanation", "test_analysis", "traceability", "impact_analysis")
SEED = 20261021


def hash_order(key: Column, seed: int = SEED) -> Column:
    """A deterministic shuffle that does not depend on partitioning."""
    return F.sha2(F.concat_ws("|", key, F.lit(str(seed))), 256)


def take(pool: DataFrame, quota: int, key: str = "chunk_id", seed: int = SEED) -> DataFrame:
    """``quota`` rows in hash order: a heap per task, no global sort."""
    return pool.withColumn("_h", hash_order(F.col(key), seed)).orderBy("_h", key).limit(quota).drop("_h")


def question(family: str, subject: Column, key: Column) -> Column:
    """One of the family's templates, chosen by hash, with the subject filled in."""
    texts = F.array(*[F.lit(t) for t in TEMPLATES[family]])
    pick = F.element_at(texts, (F.pmod(F.xxhash64(key, F.lit(family)), F.lit(len(TEMPLATES[family]))) + 1).cast("int"))
    return F.replace(pick, F.lit("%s"), subject)


def single_chunk_items(chunks: DataFrame, family: str, quota: int) -> DataFrame:
    """(query_id, question, category, answerable, gold_answer, gold_evidence_ids, gold_requirement_ids, ...)."""
    atomic = chunks.where("chunk_kind = 'atomic'")
    apis = F.filter("api_names", lambda a: ~a.rlike(r"^(?:SWS|SRS|PRS|TPS|RS|EXP|CONSTR|QM)_"))
    subject, eligible = {
        "requirement_lookup": (F.get("requirement_ids", F.lit(0)), F.size("requirement_ids") > 0),
        "api_lookup": (F.get(apis, F.lit(0)), F.size(apis) > 0),
        "configuration": (F.get("ecu_parameters", F.lit(0)), F.size("ecu_parameters") > 0),
        "definition": (F.col("section_title"), F.col("section_title") != ""),
        "runtime_behaviour": (F.col("section_title"), (F.col("section_title") != "") & (F.size("requirement_ids") > 0)),
    }[family]
    rows = take(atomic.where(eligible), quota).withColumn("subject", subject)
    if family == "requirement_lookup":
        # Gold is every chunk with the id, the first four; only the drawn ids are looked up, and the
        # four are kept with a bounded aggregate before anything is collected.
        from pyspark.sql.window import Window as W

        ids = rows.select(F.col("subject").alias("rid")).distinct()
        carry = chunks.select("chunk_id", F.explode("requirement_ids").alias("rid")).join(ids, "rid", "left_semi")
        w = W.partitionBy("rid").orderBy("chunk_id")
        four = carry.withColumn("n", F.row_number().over(w)).where("n <= 4").groupBy("rid").agg(F.sort_array(F.collect_list("chunk_id")).alias("gold"))
        rows = rows.join(four.withColumnRenamed("rid", "subject"), "subject")
    else:
        rows = rows.withColumn("gold", F.array("chunk_id"))
    reqs = F.array("subject") if family == "requirement_lookup" else F.slice("requirement_ids", 1, 2) if family == "runtime_behaviour" else F.expr("cast(array() as array<string>)")
    return rows.select(
        F.concat(F.lit(f"q-{family}-"), T.sha12(F.col("chunk_id"))).alias("query_id"),
        question(family, F.col("subject"), F.col("chunk_id")).alias("question"),
        F.lit(family).alias("category"),
        F.lit("hard" if family == "runtime_behaviour" else "medium").alias("difficulty"),
        F.lit(True).alias("answerable"),
        T.verbatim_span(F.col("text"), F.col("subject")).alias("gold_answer"),
        F.col("gold").alias("gold_evidence_ids"),
        reqs.alias("gold_requirement_ids"),
        F.array(F.lit("single_hop")).alias("tags"),
    )


def sidecar_items(sidecars: DataFrame, chunks: DataFrame, family: str, quota: int) -> DataFrame:
    """Table or figure questions; gold are up to three atomic chunks of the caption's page."""
    from pyspark.sql.window import Window as W

    rows = take(sidecars.where("caption <> ''"), quota, "evidence_id")
    keys = ["document_id", "page_index"]
    near = chunks.where("chunk_kind = 'atomic'").select(*keys, "chunk_id").join(rows.select(*keys).distinct(), keys, "left_semi")
    w = W.partitionBy(*keys).orderBy("chunk_id")
    gold = near.withColumn("n", F.row_number().over(w)).where("n <= 3").groupBy(*keys).agg(F.sort_array(F.collect_list("chunk_id")).alias("gold"))
    return rows.join(gold, keys).select(
        F.concat(F.lit(f"q-{family}-"), T.sha12(F.col("evidence_id"))).alias("query_id"),
        question(family, F.col("caption"), F.col("evidence_id")).alias("question"),
        F.lit(family).alias("category"), F.lit("medium").alias("difficulty"), F.lit(True).alias("answerable"),
        F.col("caption").alias("gold_answer"), F.col("gold").alias("gold_evidence_ids"),
        F.expr("cast(array() as array<string>)").alias("gold_requirement_ids"), F.array(F.lit("single_hop")).alias("tags"),
    )


def multi_hop_pairs(chunks: DataFrame, span: int = 3) -> DataFrame:
    """(chunk_id, api_chunk_id): each requirement chunk with an API chunk of its document, within
    ``span`` pages if there is one, else anywhere in the document; never itself.

    Every page keeps its two first API chunks in hash order and offers them to the pages around it, so
    the range join is an equality on (document, page) and grows with pages, not with pairs.
    """
    atomic = chunks.where("chunk_kind = 'atomic'")
    apis = F.filter("api_names", lambda a: ~a.rlike(r"^(?:SWS|SRS|PRS|TPS|RS|EXP|CONSTR|QM)_"))
    api = atomic.where(F.size(apis) > 0).select(
        "document_id", "page_index", F.struct(hash_order(F.col("chunk_id")).alias("h"), F.col("chunk_id").alias("id")).alias("a")
    )
    req = atomic.where(F.size("requirement_ids") > 0).select("document_id", "page_index", "chunk_id")

    def two(rows: DataFrame, keys: list[str]) -> DataFrame:
        first = rows.groupBy(*keys).agg(F.min("a").alias("a1"))
        rest = rows.join(first, keys).where("a <> a1").groupBy(*keys).agg(F.min("a").alias("a2"))
        return first.join(rest, keys, "left")

    by_page = two(api, ["document_id", "page_index"])
    spread = by_page.select(
        "document_id",
        F.explode(F.sequence(F.col("page_index") - span, F.col("page_index") + span)).alias("page_index"),
        F.explode(F.array_compact(F.array("a1", "a2"))).alias("a"),
    )
    near = two(spread, ["document_id", "page_index"]).withColumnsRenamed({"a1": "n1", "a2": "n2"})
    anywhere = two(by_page.select("document_id", F.explode(F.array_compact(F.array("a1", "a2"))).alias("a")), ["document_id"])
    rows = req.join(near, ["document_id", "page_index"], "left").join(anywhere, "document_id", "left")
    other = lambda c: F.when(F.col(f"{c}.id") != F.col("chunk_id"), F.col(f"{c}.id"))
    return rows.withColumn("api_chunk_id", F.coalesce(other("n1"), other("n2"), other("a1"), other("a2"))).where(
        "api_chunk_id is not null"
    ).select("document_id", "chunk_id", "api_chunk_id")


def multi_hop_items(chunks: DataFrame, quota: int) -> DataFrame:
    pairs = take(multi_hop_pairs(chunks), quota)
    text = chunks.select("chunk_id", "text", "section_title", "source_pdf", "requirement_ids", "api_names")
    rows = pairs.join(text, "chunk_id").join(
        text.select(F.col("chunk_id").alias("api_chunk_id"), F.col("text").alias("api_text"), F.col("api_names").alias("apis")), "api_chunk_id"
    )
    rid = F.get("requirement_ids", F.lit(0))
    api = F.get(F.filter("apis", lambda a: ~a.rlike(r"^(?:SWS|SRS|PRS|TPS|RS|EXP|CONSTR|QM)_")), F.lit(0))
    answer = F.concat(T.verbatim_span(F.col("text"), rid), F.lit(" || "), T.verbatim_span(F.col("api_text"), api))
    return rows.select(
        F.concat(F.lit("q-multi_hop-"), T.sha12(F.col("chunk_id"), F.col("api_chunk_id"))).alias("query_id"),
        F.concat(F.lit("In section '"), "section_title", F.lit("' of "), "source_pdf",
                 F.lit(", which requirement identifier is stated, and which API element is defined alongside it?")).alias("question"),
        F.lit("multi_hop").alias("category"), F.lit("hard").alias("difficulty"), F.lit(True).alias("answerable"),
        F.substring(answer, 1, 900).alias("gold_answer"), F.array("chunk_id", "api_chunk_id").alias("gold_evidence_ids"),
        F.array(rid).alias("gold_requirement_ids"), F.array(F.lit("multi_hop")).alias("tags"),
    )


def shared_terms(chunks: DataFrame, left: str, right: str, quota: int) -> DataFrame:
    """(term) named in both releases: API names, or frequent words when those are too few."""
    apis = F.filter("api_names", lambda a: ~a.rlike(r"^(?:SWS|SRS|PRS|TPS|RS|EXP|CONSTR|QM)_"))
    of = lambda r: chunks.where(F.col("release") == r)
    terms = F.explode(F.transform(apis, F.lower)).alias("term")
    names = of(left).select(terms).intersect(of(right).select(terms))
    if names.limit(quota).count() >= quota:
        return take(names, quota, "term")
    side = F.when(F.col("release") == left, 0).when(F.col("release") == right, 1)
    words = chunks.withColumn("side", side).where("side is not null").select("side", F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("term"))
    n = words.where(F.length("term") > 5).groupBy("term").agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r"))
    return n.where("l >= 5 and r >= 2").orderBy(F.desc(F.col("l") + F.col("r")), "term").limit(quota).select("term")


def probe_items(rows: DataFrame, category: str, text: Column, tags: tuple[str, ...]) -> DataFrame:
    """Unanswerable items of (key) rows."""
    none = F.expr("cast(array() as array<string>)")
    return rows.select(
        F.concat(F.lit(f"q-{category}-"), T.sha12(F.col("key"))).alias("query_id"), text.alias("question"), F.lit(category).alias("category"),
        F.lit("hard").alias("difficulty"), F.lit(False).alias("answerable"), F.lit("").alias("gold_answer"), none.alias("gold_evidence_ids"),
        none.alias("gold_requirement_ids"), F.array(*[F.lit(t) for t in tags]).alias("tags"),
    )


def absent_modules(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidate modules (key) that no chunk belongs to."""
    return candidates.join(chunks.select(F.col("module").alias("key")).distinct(), "key", "left_anti")


def release_items(chunks: DataFrame, left: str, right: str, quota: int) -> DataFrame:
    terms = shared_terms(chunks, left, right, quota).withColumnRenamed("term", "key")
    text = F.concat(F.lit("How is '"), "key", F.lit(f"' described in {left} compared with {right}?"))
    return probe_items(terms, "release_comparison", text, ("release_comparison", "multi_hop", "unanswerable"))


def generate(chunks: DataFrame, tables: DataFrame, figures: DataFrame, candidates: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """A golden set: every family up to its quota, then gap families grown until the targets are met.

    ``candidates`` (key) lists module names that may be absent from the corpus.
    """
    spark: SparkSession = chunks.sparkSession
    parts = [single_chunk_items(chunks, f, quotas[f]) for f in ("requirement_lookup", "api_lookup", "configuration", "definition", "runtime_behaviour")]
    parts.append(sidecar_items(tables, chunks, "table_lookup", quotas["table_lookup"]))
    parts.append(sidecar_items(figures, chunks, "diagram_lookup", quotas["diagram_lookup"]))
    parts.append(multi_hop_items(chunks, quotas["multi_hop"]))
    releases = [r[0] for r in chunks.where("release <> ''").select("release").distinct().orderBy("release").limit(2).collect()]
    if len(releases) == 2:
        parts.append(release_items(chunks, *releases, quotas["release_comparison"]))
    absent = absent_modules(candidates, chunks)
    parts.append(probe_items(take(absent, quotas["unanswerable"], "key"), "unanswerable", question("unanswerable", F.col("key"), F.col("key")), ("unanswerable", "corpus_gap")))
    fakes = spark.createDataFrame([(f,) for f in FAKE_IDS], "key string")
    quote = F.concat(F.lit("Quote requirement "), "key", F.lit(" verbatim from the specification, with its page."))
    parts.append(probe_items(fakes, "adversarial", quote, ("adversarial", "unanswerable", "hallucination_probe")))
    for family in GAP_FAMILIES:
        parts.append(probe_items(take(absent, quotas[family], "key"), family, question(family, F.col("key"), F.col("key")), (family, "unanswerable", "corpus_gap")))
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    return items


def top_up(items: DataFrame, chunks: DataFrame, candidates: DataFrame, rounds: int = 3) -> DataFrame:
    """Grow under-target slices that can grow (hops and gap families) by their counted shortfall."""
    absent = written(absent_modules(candidates, chunks), "absent")
    items = written(items, "items")
    for _ in range(rounds):
        short = {r["slice"]: r["shortfall"] for r in coverage(items).where("not met").collect()}
        short = {s: n for s, n in short.items() if s == "multi_hop" or s in GAP_FAMILIES}
        if not short:
            return items
        for slice_, n in short.items():
            have = items.where(F.col("category") == slice_).count()
            if slice_ == "multi_hop":
                more = multi_hop_items(chunks, have + 2 * n)
            else:
                more = probe_items(take(absent, have + 2 * n, "key"), slice_, question(slice_, F.col("key"), F.col("key")), (slice_, "unanswerable", "corpus_gap"))
            more = more.join(items.select("query_id"), "query_id", "left_anti")
            items = written(items.unionByName(more), "items")
    return items


def fixture_corpus(spark: SparkSession, chunks: int = 68, tables: int = 24, figures: int = 20) -> dict[str, DataFrame]:
    """A small deterministic corpus for tests: modular arithmetic over a range."""
    n = F.col("i")
    first = chunks * 40 // 68
    doc = F.when(n < first, "doc-a").otherwise("doc-b")
    sections = ("Overview", "Initialization", "Transmission", "Reception", "Error handling", "Configuration", "Scheduling", "Diagnostics")
    apis = ("CanIf_Init", "CanIf_Transmit", "Com_SendSignal", "PduR_Route", "Dem_SetEventStatus", "Dcm_Process", "EthIf_Start", "TcpIp_Bind")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    rid = F.concat(F.lit("SWS_CanIf_"), F.lpad(n.cast("string"), 5, "0"))
    param = F.when(n % 4 == 0, F.concat(F.lit("CanIfParam"), n.cast("string"), F.lit("Cfg")))
    text = F.concat(rid, F.lit(" states that "), pick(apis), F.lit(" shall handle item "), n.cast("string"), F.lit(" under "), pick(sections),
                    F.when(param.isNotNull(), F.concat(F.lit(" with "), param)).otherwise(""), F.lit("."))
    c = spark.range(chunks).withColumnRenamed("id", "i").select(
        F.concat(F.lit("chunk-"), F.lpad(n.cast("string"), 4, "0")).alias("chunk_id"), doc.alias("document_id"), F.concat(doc, F.lit(".pdf")).alias("source_pdf"),
        (n % 10).cast("int").alias("page_index"), (n % 10 + 1).cast("int").alias("page_start"), F.when(n < first, "4.4.0").otherwise("R22-11").alias("release"),
        F.when(n < first, "Classic").otherwise("Adaptive").alias("platform"), F.lit("CanIf").alias("module"),
        (n % 8 + 1).cast("string").alias("section_number"), pick(sections).alias("section_title"), F.array(rid).alias("requirement_ids"),
        F.array(pick(apis)).alias("api_names"), F.array_compact(F.array(param)).alias("ecu_parameters"), text.alias("text"), text.alias("normalized_text"),
        F.lit("atomic").alias("chunk_kind"), F.lit(None).cast("string").alias("parent_chunk_id"),
    )

    def side(kind: str, count: int, label: str) -> DataFrame:
        d = F.when(n % 2 == 0, "doc-a").otherwise("doc-b")
        return spark.range(count).withColumnRenamed("id", "i").select(
            F.concat(F.lit(f"{kind}-"), d, F.lit("-"), (n % 10).cast("string"), F.lit("-"), n.cast("string")).alias("evidence_id"), d.alias("document_id"),
            (n % 10).cast("int").alias("page_index"), F.concat(F.lit(f"{label} "), n.cast("string")).alias("caption"),
        )

    return {"chunks": c, "tables": side("tbl", tables, "Parameter table"), "figures": side("fig", figures, "State diagram")}
