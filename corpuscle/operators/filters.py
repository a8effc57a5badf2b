"""Metadata filters, lookups and access control.

A question's filter is decided once per combination of metadata values, not once per chunk: chunks
share few combinations, so (question, combination) stays small and meets candidates by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscle.functions import vocab as V
from corpuscle.operators.substrings import contained

FACET = ["platform", "release", "module", "asil", "is_project"]
ANY, PROJECT = "*", "#project"


def with_facet(chunks: DataFrame) -> DataFrame:
    """Chunks with their filter columns filled: platform, release, module, asil, is_project."""
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in chunks.columns else F.lit("")
    project = F.col("chunk_id").startswith("ps-")
    if "document_type" in chunks.columns:
        project = project | F.coalesce(F.col("document_type"), F.lit("")).isin(*V.PROJECT_TYPES)
    return chunks.withColumns(
        {"platform": have("platform"), "release": have("release"), "module": have("module"), "asil": have("asil"), "is_project": project}
    )


def facets(chunks: DataFrame) -> DataFrame:
    """Combinations of metadata values with their number of chunks."""
    return with_facet(chunks).groupBy(*FACET).agg(F.count("*").alias("chunks"))


def release_family(release: Column) -> Column:
    """A release and its shorter labels at version boundaries: 4.4.0 -> 4, 4.4, 4.4.0."""
    parts = F.split(release, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def _levels(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.upper(c), ","), F.trim), lambda x: x != "")


def decisions(plans: DataFrame, combos: DataFrame, use_module: bool = True, use_release: bool = True) -> DataFrame:
    """(query_id, facet columns): the combinations each question keeps.

    ``plans`` has query_id, platforms, releases, release_mode, modules, asil_levels (arrays).  Every
    rule becomes an equality on a key with a wildcard, so the theta join is a plain hash join.
    """
    wild = lambda want: F.when(F.size(want) == 0, F.array(F.lit(ANY))).otherwise(want)
    exact = (F.col("release_mode") == "exact") if use_release else F.lit(False)
    none = F.expr("cast(array() as array<string>)")
    wants = plans.select(
        "query_id",
        F.explode(F.concat(wild(F.col("platforms")), F.array(F.lit(PROJECT)))).alias("k_platform"),
        F.when(exact, F.col("releases")).otherwise(none).alias("rels"),
        F.col("modules").alias("mods") if use_module else none.alias("mods"),
        "asil_levels",
    )
    wants = wants.select(
        "query_id", "k_platform", "mods", "asil_levels", F.explode(F.concat(wild(F.col("rels")), F.array(F.lit(PROJECT)))).alias("k_release")
    ).where((F.col("k_platform") == PROJECT) == (F.col("k_release") == PROJECT))
    blank = F.array(F.lit(""))
    or_blank = lambda want: F.when(F.size(want) == 0, F.array(F.lit(ANY))).otherwise(F.concat(want, blank))
    wants = wants.select("query_id", "k_platform", "k_release", "asil_levels", F.explode(or_blank(F.col("mods"))).alias("k_module"))
    upper = F.transform("asil_levels", lambda x: F.upper(F.trim(x)))
    wants = wants.select("query_id", "k_platform", "k_release", "k_module", F.explode(or_blank(upper)).alias("k_asil"))

    proj = F.array(F.lit(PROJECT))
    offer = combos.select(
        *FACET,
        F.explode(F.when(F.col("is_project"), proj).otherwise(F.array(F.lit(ANY), F.col("platform")))).alias("k_platform"),
        F.when(F.col("is_project"), proj).otherwise(F.concat(F.array(F.lit(ANY)), release_family(F.col("release")))).alias("rel_keys"),
    )
    offer = offer.select(*FACET, "k_platform", F.explode("rel_keys").alias("k_release"))
    offer = offer.select("*", F.explode(F.array(F.lit(ANY), F.col("module"))).alias("k_module"))
    levels = _levels(F.col("asil"))
    offer = offer.select(
        "*", F.explode(F.concat(F.array(F.lit(ANY)), F.when(F.size(levels) == 0, blank).otherwise(levels))).alias("k_asil")
    )
    keys = ["k_platform", "k_release", "k_module", "k_asil"]
    return wants.join(offer, keys).select("query_id", *FACET).distinct()


def pool_sizes(plans: DataFrame, combos: DataFrame, use_release: bool = True) -> DataFrame:
    """(query_id, corpus_size, pool, pool_without_module), summed over combinations."""
    sized = combos.select(*FACET, "chunks")
    n = sized.agg(F.sum("chunks").alias("n")).scalar()
    count = lambda keep, name: keep.join(sized, FACET).groupBy("query_id").agg(F.sum("chunks").alias(name))
    strict = count(decisions(plans, combos, True, use_release), "pool")
    loose = count(decisions(plans, combos, False, use_release), "pool_without_module")
    return (
        plans.select("query_id", F.size("modules").alias("n_modules"))
        .join(strict, "query_id", "left")
        .join(loose, "query_id", "left")
        .fillna(0, ["pool", "pool_without_module"])
        .withColumn("corpus_size", n)
    )


def relaxation(plans: DataFrame, combos: DataFrame, ratio: float = 0.02, use_release: bool = True) -> DataFrame:
    """Pool sizes with ``relaxed``: the module constraint is dropped when it leaves too little."""
    floor = F.greatest(F.lit(1), F.floor(F.col("corpus_size") * ratio))
    thin = (F.col("n_modules") > 0) & (F.col("pool") < floor) & (F.col("pool_without_module") > F.col("pool"))
    return pool_sizes(plans, combos, use_release).withColumn("relaxed", thin).withColumn(
        "pool_size", F.when(thin, F.col("pool_without_module")).otherwise(F.col("pool"))
    )


def kept_combinations(plans: DataFrame, combos: DataFrame, module_filter: bool = True, version_filter: bool = True,
                      ratio: float = 0.02) -> DataFrame:
    """The combinations each question keeps after relaxation."""
    if not module_filter:
        return decisions(plans, combos, False, version_filter)
    relaxed = relaxation(plans, combos, ratio, version_filter).where("relaxed").select("query_id")
    strict = decisions(plans.join(relaxed, "query_id", "left_anti"), combos, True, version_filter)
    return strict.unionByName(decisions(plans.join(relaxed, "query_id", "left_semi"), combos, False, version_filter))


def in_pool(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """Candidates (query_id, chunk_id, facet columns) that the question's filter keeps."""
    return candidates.join(kept, ["query_id", *FACET], "left_semi")


def authorised(chunks: DataFrame, allowed: DataFrame) -> DataFrame:
    return chunks.join(allowed.select("document_id"), "document_id", "left_semi")


# --- lookups --------------------------------------------------------------------------------


def requirement_search(chunks: DataFrame, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks with an id containing the wanted text, in any case: (query_id, chunk_id, rn).

    ``wanted`` is (query_id, needle, release or '').  Ids and needles meet on a needle's rarest gram; the substring
    test follows.  ``limit`` keeps the first rows of a question; none by default.
    """
    ids = chunks.select(F.explode("requirement_ids").alias("rid")).distinct().withColumn("hay", F.lower("rid"))
    keyed = wanted.select("query_id", F.lower("needle").alias("needle"), F.col("release").alias("want"))
    hits = ids.join(contained(keyed, ids), "hay").join(keyed, "needle").select("rid", "query_id", "want")
    rows = chunks.select("chunk_id", "release", F.explode("requirement_ids").alias("rid")).join(hits, "rid")
    rows = rows.where((F.col("want") == "") | (F.col("release") == F.col("want")))
    found = rows.select("query_id", "chunk_id").distinct().withColumn("rn", F.row_number().over(W.partitionBy("query_id").orderBy("chunk_id")))
    return found if limit is None else found.where(F.col("rn") <= limit)


def caption_search(sidecars: DataFrame, needle: str, text_columns: list[str], release: str = "", limit: int | None = None) -> DataFrame:
    """Tables or figures whose caption (or rows) contain a text; the first ``limit`` if one is given."""
    hit = F.lit(False)
    for c in text_columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle.lower())
    if release:
        hit = hit & (F.col("release") == release)
    found = sidecars.where(hit)
    return found if limit is None else found.orderBy("evidence_id").limit(limit)


def corpus_facets(documents: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value): distinct non-empty values per column, from one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns]))
    return documents.select(pairs.alias("p")).select("p.*").where(F.coalesce("value", F.lit("")) != "").distinct()


def missing_slots(plans: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``missing``: release/platform when the plan names none and the corpus spans several."""
    span = documents.agg(F.countDistinct("release").alias("r"), F.countDistinct("platform").alias("p"))
    r, p = span.select("r").scalar(), span.select("p").scalar()
    return plans.withColumn(
        "missing",
        F.array_compact(
            F.array(
                F.when((F.size("releases") == 0) & (r > 1), F.lit("release")),
                F.when((F.size("platforms") == 0) & (p > 1), F.lit("platform")),
            )
        ),
    )


def source_lookup(wanted: DataFrame, chunks: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Ids (evidence_id) looked up in chunks, tables and figures: (kind, evidence_id, document_id, page_index)."""
    one = lambda df, kind, key: df.select(
        F.lit(kind).alias("kind"), F.col(key).alias("evidence_id"), "document_id", "page_index"
    ).join(wanted.select("evidence_id").distinct(), "evidence_id", "left_semi")
    return one(chunks, "chunk", "chunk_id").unionByName(one(tables, "table", "evidence_id")).unionByName(one(figures, "figure", "evidence_id"))


def page_neighbours(hits: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks on the page of each hit, the first ``limit`` if one is given: (hit_id, chunk_id, rn)."""
    same = hits.select(F.col("chunk_id").alias("hit_id"), "document_id", "page_index").join(
        chunks.select("chunk_id", "document_id", "page_index"), ["document_id", "page_index"]
    )
    ranked = same.withColumn("rn", F.row_number().over(W.partitionBy("hit_id").orderBy("chunk_id")))
    return ranked if limit is None else ranked.where(F.col("rn") <= limit)


def page_evidence(hits: DataFrame, chunks: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """(hit_id, kind, evidence_id): the chunks, tables and figures on the page of each hit."""
    one = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("evidence_id"), "document_id", F.col("page_index").cast("long").alias("page_index"))
    every = one(chunks, "chunk", "chunk_id").unionByName(one(tables, "table", "evidence_id")).unionByName(one(figures, "figure", "evidence_id"))
    at = hits.select(F.col("chunk_id").alias("hit_id"), "document_id", F.col("page_index").cast("long").alias("page_index"))
    return at.join(every, ["document_id", "page_index"]).select("hit_id", "kind", "evidence_id")


def optional_filter(df: DataFrame, **wanted) -> DataFrame:
    """Equality on every given value; None and '' are skipped."""
    for c, v in wanted.items():
        if v not in (None, ""):
            df = df.where(F.col(c) == v)
    return df


# --- access ---------------------------------------------------------------------------------

GENERIC_SCOPE = "generic"


def tenant_filter(rows: DataFrame, context: dict, caller: dict | None = None) -> DataFrame:
    """Rows of the caller's tenant, project and workspace, from allowed or generic vendors.

    A caller's own filter can narrow the result but never replaces the mandatory part.
    """
    if not context.get("tenant_id"):
        raise PermissionError("a tenant is required")
    rows = rows.where(F.col("tenant_id") == context["tenant_id"])
    for c in ("project_id", "workspace_id"):
        if context.get(c):
            rows = rows.where(F.col(c) == context[c])
    vendors = sorted({GENERIC_SCOPE, *(context.get("allowed_vendor_scopes") or [])})
    rows = rows.where(F.col("vendor_scope").isin(*vendors))
    return optional_filter(rows, **(caller or {}))


def access_decisions(pairs: DataFrame) -> DataFrame:
    """(allowed, reason) for rows of a context (user_id, tenant_id, project_id, allowed_vendor_scopes)
    and a resource (r_tenant_id, r_project_id, r_vendor_scope)."""
    set_ = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    vendor = F.coalesce("r_vendor_scope", F.lit(""))
    reason = (
        F.when(~set_("tenant_id") | ~set_("user_id"), "missing security context")
        .when(set_("r_tenant_id") & (F.col("r_tenant_id") != F.col("tenant_id")), "cross-tenant access denied")
        .when(set_("project_id") & set_("r_project_id") & (F.col("r_project_id") != F.col("project_id")), "project scope denied")
        .when(
            (vendor != "") & (vendor != GENERIC_SCOPE) & ~F.coalesce(F.array_contains("allowed_vendor_scopes", vendor), F.lit(False)),
            F.concat(F.lit("vendor scope '"), vendor, F.lit("' not authorized")),
        )
        .otherwise("allowed")
    )
    return pairs.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "allowed")


def workspaces_of(memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(user_id, workspace_id, role) of existing workspaces."""
    return memberships.join(workspaces.select("workspace_id"), "workspace_id").select("user_id", "workspace_id", "role")


def visible_collections(memberships: DataFrame, collections: DataFrame) -> DataFrame:
    """Collections a member sees: private ones only as owner/admin of the workspace or as their owner."""
    rows = memberships.join(collections, "workspace_id")
    private = F.col("visibility") == "private"
    return rows.where(~private | F.col("role").isin("owner", "admin") | (F.col("owner_id") == F.col("user_id"))).select(
        "user_id", "workspace_id", "collection_id"
    )


def authorised_documents(memberships: DataFrame, documents: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(user_id, workspace_id, document_id): what a member may read in a workspace.

    Documents of the workspace or of none; members who are not owner or admin additionally need to
    own them, or nobody does.  Both rules are equalities on keys that documents offer and members
    ask for.  ``selected`` (user_id, document_id) narrows users who selected collections.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    offers = documents.select(
        "document_id",
        F.when(blank("workspace_id"), ANY).otherwise(F.col("workspace_id")).alias("k_workspace"),
        F.explode(F.array(F.when(blank("owner_user_id"), ANY).otherwise(F.col("owner_user_id")), F.lit("#boss"))).alias("k_owner"),
    )
    boss = F.col("role").isin("owner", "admin")
    asks = memberships.select(
        "user_id", "workspace_id", F.explode(F.array(F.lit(ANY), "workspace_id")).alias("k_workspace"), "role"
    ).select(
        "user_id", "workspace_id", "k_workspace",
        F.explode(F.when(boss, F.array(F.lit("#boss"))).otherwise(F.array(F.lit(ANY), "user_id"))).alias("k_owner"),
    )
    out = offers.join(asks, ["k_workspace", "k_owner"]).select("user_id", "workspace_id", "document_id")
    if selected is not None:
        chosen = selected.select("user_id").distinct()
        narrowed = out.join(selected, ["user_id", "document_id"], "left_semi")
        out = out.join(chosen, "user_id", "left_anti").unionByName(narrowed)
    return out
