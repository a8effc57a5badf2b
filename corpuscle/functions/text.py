"""Column functions over text: cleaning, signals, tokens, spans, ids.

All of them are built-in Spark expressions, so they run inside the JVM next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions import vocab as V

# The same sets of characters, with a test first that letters fail at once; V's forms are for SQL as well.
_WS = rf"[[^!-~]&&{V.WS}]"
_LINE_BREAK = rf"(?=[^ -~])(?:{V.LINE_BREAK})"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(V.WS_CHARS))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A lambda evaluates an outer expression anew for every element; a bound variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c: Column) -> Column:
    """All white space to single blanks, ends trimmed."""
    return strip(F.regexp_replace(c, _WS + "+", " "))


def words(c: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.filter(F.split(c, _WS + "+"), lambda w: w != "")


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of one group, in text order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def found_if(c: Column, may: Column, pattern: str, group: int = 0) -> Column:
    """``found``, where ``may`` is a cheap test that every text with a match passes."""
    return F.when(~may, F.expr("cast(array() as array<string>)")).otherwise(found(c, pattern, group))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def distinct_sorted(c: Column, limit: int | None = None) -> Column:
    out = F.array_sort(F.array_distinct(c))
    return F.slice(out, 1, limit) if limit else out


def sha12(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12)


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


# --- pages ----------------------------------------------------------------------------------


def normalize_page(c: Column, keep_blank_lines: bool = False) -> Column:
    """Drop blank lines and short page furniture, collapse blanks and tabs, trim."""
    def wanted(s: Column) -> Column:
        furniture = (F.length(s) < 120) & s.rlike(V.FURNITURE)
        return ~furniture if keep_blank_lines else (s != "") & ~furniture

    text = F.array_join(F.filter(F.split(c, _LINE_BREAK), lambda line: let(strip(line), wanted)), "\n")
    blanks = lambda t: F.when(t.contains("  ") | t.contains("\t"), F.regexp_replace(t, r"[ \t]+", " ")).otherwise(t)
    breaks = lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    return strip(let(let(text, blanks), breaks))


def paragraphs(c: Column) -> Column:
    parts = F.when(~c.contains("\n"), F.array(c)).otherwise(F.split(c, r"\n" + _WS + r"*\n"))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def requirement_ids(c: Column, limit: int | None = None) -> Column:
    return distinct_sorted(F.concat(found_if(c, c.contains("S_"), V.REQ_A, 1), found_if(c, c.contains("["), V.REQ_B, 1)), limit)


def api_names(c: Column, limit: int | None = None) -> Column:
    return distinct_sorted(F.filter(found_if(c, c.contains("_"), V.API_SIG, 1), lambda a: F.length(a) <= 64), limit)


def ecu_parameters(c: Column, limit: int | None = None) -> Column:
    return distinct_sorted(found_if(c, c.contains("fg") | c.contains("Config"), V.ECUC, 1), limit)


def headings(c: Column, limit: int | None = None) -> Column:
    """Numbered headings as an array of (number, title)."""
    may = c.rlike(r"(?m)^\d")
    pairs = F.zip_with(
        found_if(c, may, V.HEADING, 1),
        found_if(c, may, V.HEADING, 2),
        lambda n, t: F.struct(n.alias("number"), strip(t).alias("title")),
    )
    return F.slice(pairs, 1, limit) if limit else pairs


def captions(c: Column, pattern: str) -> Column:
    """Caption lines as an array of (kind, number, caption)."""
    rest = F.arrays_zip(found(c, pattern, 1), found(c, pattern, 2), found(c, pattern, 3))
    return F.transform(
        rest,
        lambda z: F.struct(
            F.lower(z["0"]).alias("kind"), z["1"].alias("number"), strip(z["2"]).alias("caption")
        ),
    )


def page_flags(c: Column) -> Column:
    """Quality flags of one page."""
    no_id = ~c.rlike(r"\b(?:SWS|RS|PRS)_[A-Za-z0-9_]+") & (F.length(c) > 2000)
    return F.array_compact(
        F.array(
            F.when(F.length(strip(c)) < 200, F.lit("low_text_density")),
            F.when(c.rlike(V.BROKEN_CHARS), F.lit("broken_encoding")),
            F.when(F.regexp_count(c, F.lit(V.WIDE_GAP)) > 5, F.lit("possible_table_heavy")),
            F.when(no_id, F.lit("missing_requirement_ids")),
        )
    )


# --- metadata -------------------------------------------------------------------------------


def word_hit(lowered: Column, phrase: str) -> Column:
    """True when a phrase occurs as whole words in lower-cased text."""
    import re

    return lowered.rlike(r"(?<![a-z0-9])" + re.escape(phrase.lower()) + r"(?![a-z0-9])")


def any_word(lowered: Column, phrases) -> Column:
    import re

    alts = "|".join(re.escape(p.lower()) for p in phrases)
    return lowered.rlike(rf"(?<![a-z0-9])(?:{alts})(?![a-z0-9])")


def quoted(c: Column) -> Column:
    """A column's text as a literal regex fragment."""
    return F.regexp_replace(c, r"([^A-Za-z0-9_ ])", r"\\$1")


def string_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def module_for_api(api: Column, aliases: dict | None = None) -> Column:
    """Owning module by the text before the first underscore; '' when unknown."""
    prefix = F.lower(F.trim(F.substring_index(api, "_", 1)))
    return F.coalesce(F.try_element_at(string_map(aliases or V.MODULE_ALIASES), prefix), F.lit(""))


def document_type(filename: Column) -> Column:
    kind = first_group(filename, r"AUTOSAR_(FO_)?(PRS|RS|SWS|TPS|TR|EXP)", 2)
    return F.when(kind != "", kind).otherwise("unknown")


def release_and_platform(text: Column, filename: Column, head_chars: int | None = None) -> Column:
    """(release, platform) by ordered rules over file name and text.

    The year-style label outranks the dotted one and implies a platform from the words around it.
    ``head_chars`` restricts the search to the document's head.
    """
    body = F.substring(text, 1, head_chars) if head_chars else text
    blob = F.concat(filename, F.lit("\n"), body)
    low = F.lower(blob)
    year = first_group(blob, r"R(\d{2})-11", 1)
    dotted = first_group(blob, r"\b4\.[2-4]\.\d\b", 0)
    named = F.when(filename.contains("AUTOSAR_FO_") | low.contains("foundation"), "Foundation")
    by_year = (
        F.when(blob.rlike(r"AUTOSAR\s+CP\b") | low.contains("classic platform"), "Classic")
        .when(low.contains("adaptive"), "Adaptive")
        .otherwise("Foundation")
    )
    return F.struct(
        F.when(year != "", F.concat(F.lit("R"), year, F.lit("-11"))).otherwise(dotted).alias("release"),
        F.when(year != "", F.coalesce(named, by_year))
        .when(dotted != "", "Classic")
        .otherwise(F.coalesce(named, F.lit("unknown")))
        .alias("platform"),
    )


def asil_levels(c: Column) -> Column:
    """Distinct safety levels, most severe first."""
    order = F.array(*[F.lit(x) for x in V.ASIL_ORDER])
    hits = F.transform(found(c, V.ASIL, 1), F.upper)
    return let(hits, lambda hs: F.filter(order, lambda level: F.array_contains(hs, level)))


def asil(c: Column) -> Column:
    return F.array_join(asil_levels(c), ",")


# --- tokens ---------------------------------------------------------------------------------


def technical_tokens(c: Column) -> Column:
    """Whole tokens and their CamelCase / underscore parts, lower-cased, duplicates kept.

    The part pattern never crosses a separator, so two scans of the text give the same bag as
    splitting token by token.
    """
    both = F.concat(found(c, V.TOKEN, 0), found(c, V.SUB_TOKEN, 0))
    return F.transform(F.filter(both, lambda t: F.length(t) > 1), F.lower)


def content_tokens(c: Column) -> Column:
    """Lower-cased words without stop words, duplicates kept."""
    stop = F.array(*[F.lit(w) for w in V.STOP_WORDS])
    lowered = F.transform(found(F.coalesce(c, F.lit("")), V.WORD, 0), F.lower)
    return F.filter(lowered, lambda w: ~F.array_contains(stop, w))


def identifiers(c: Column) -> Column:
    """Requirement ids, API names and CamelCase names: distinct, first seen first."""
    t = F.coalesce(c, F.lit(""))
    return F.array_distinct(F.concat(found(t, V.EVAL_REQ), found(t, V.EVAL_API), found(t, V.EVAL_CAMEL)))


def exact_tokens(c: Column) -> Column:
    """Identifiers plus numbers with units, the first spelling of each lower-cased form."""
    t = F.coalesce(c, F.lit(""))
    both = F.concat(identifiers(t), found(t, V.NUMBER_UNIT))
    first = lambda b, keys: F.filter(b, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)
    return let(both, lambda b: let(F.transform(b, F.lower), lambda keys: first(b, keys)))


def sentences(c: Column) -> Column:
    return F.split(c, V.SENTENCE_END)


def verbatim_span(text: Column, needle: Column, limit: int | None = None) -> Column:
    """The first sentence holding the needle, else the whole text; ``limit`` cuts it to an answer's length."""
    holds = lambda s, n: (n != "") & F.lower(s).contains(n)
    pick = lambda clean, n: F.get(F.filter(sentences(clean), lambda s: holds(s, n)), F.lit(0))
    span = let(collapse(text), lambda clean: let(F.lower(needle), lambda n: F.coalesce(pick(clean, n), clean)))
    return span if limit is None else F.substring(span, 1, limit)


def normative_features(c: Column, limit: int | None = None) -> Column:
    """References, API names, heading flag, modal verbs and condition flag of one text.

    ``limit`` keeps the first references and names of the sorted lists.
    """
    t = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t]+", " "))
    refs = distinct_sorted(found(t, V.CONTENT_REQ))
    return F.struct(
        t.alias("raw_text"),
        (F.slice(refs, 1, limit) if limit else refs).alias("references"),
        distinct_sorted(found(t, V.CONTENT_API, 1), limit).alias("apis"),
        t.rlike(V.CONTENT_HEADING).alias("has_heading"),
        F.when(F.size(refs) > 0, "requirement").otherwise("text").alias("content_type"),
        F.transform(found(t, V.MODAL, 1), F.lower).alias("modals"),
        t.rlike(V.CONDITION).alias("has_condition"),
    )


def table_features(rows: Column, max_rows: int | None = None, max_params: int | None = None) -> Column:
    """Markdown, HTML, header, row count and identifier-like cells of ``array<array<string>>``.

    ``max_rows`` bounds the rows shown, ``max_params`` the cells listed.
    """
    head = F.slice(rows, 1, max_rows) if max_rows else rows
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    cells = lambda r: F.concat(
        F.lit("<tr>"),
        F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""),
        F.lit("</tr>"),
    )
    params = F.filter(F.flatten(rows), lambda c: strip(c).rlike(V.IDENTIFIER_CELL))
    return F.struct(
        F.array_join(F.transform(head, line), "\n").alias("table_markdown"),
        F.concat(F.lit("<table>"), F.array_join(F.transform(head, cells), ""), F.lit("</table>")).alias("table_html"),
        F.get(rows, F.lit(0)).alias("headers"),
        F.size(rows).alias("row_count"),
        (F.slice(params, 1, max_params) if max_params else params).alias("params"),
    )


def visual_features(kind: Column, caption: Column, raw_text: Column, image_path: Column, ocr: Column,
                    latex: Column, quality: Column) -> Column:
    """Preservation flags, caption entities and the decorative test of images, diagrams, equations."""
    cap = F.coalesce(caption, F.lit(""))
    low = F.lower(cap)
    decorative = (kind == "diagram") & F.lit(False)
    for w in V.DECORATIVE:
        decorative = decorative | ((kind == "diagram") & low.contains(w))
    present = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.struct(
        (present(image_path) | present(caption) | present(raw_text)).alias("original_preserved"),
        distinct_sorted(found(F.concat(cap, F.coalesce(ocr, F.lit(""))), V.CONTENT_API, 1)).alias("entities"),
        decorative.alias("is_decorative"),
        ((kind == "diagram") & ~decorative).alias("likely_diagram"),
        ((kind == "equation") & present(latex)).alias("latex_preserved"),
        ((kind == "equation") & present(image_path)).alias("image_preserved"),
        F.when(decorative, F.least(quality, F.lit(0.3))).otherwise(quality).alias("quality_score"),
    )


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)


def estimated_cost(prompt: Column, completion: Column, price_in: float, price_out: float) -> Column:
    return F.bround(estimated_tokens(prompt) * price_in + estimated_tokens(completion) * price_out, 6)
