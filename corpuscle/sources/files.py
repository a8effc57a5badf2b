"""Files to rows: discovery, project files, architecture descriptions, analyser findings."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T

# File extensions by kind; the code set wins in mixed mode.
CODE_EXTENSIONS = (
    "c", "h", "cpp", "hpp", "cc", "py", "cs", "java", "rs", "dbc", "yaml", "yml", "json", "xml", "arxml", "txt", "md",
    "cfg", "ini", "toml", "cmake", "mk", "ld", "a2l", "xdm",
)
ARXML_EXTENSIONS = ("arxml", "xml")
CONFIG_EXTENSIONS = ("json", "yaml", "yml", "toml", "ini", "cfg", "dbc", "xdm", "xml")


def discover(spark: SparkSession, root: str, extension: str = "pdf") -> DataFrame:
    """(path, length, modificationTime) of files below ``root`` by extension, any case."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", "modificationTime")


def file_kind(path: Column, source_kind: str = "mixed") -> Column:
    """code, config, arxml or NULL by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    only = {
        "code": F.when(ext.isin(*CODE_EXTENSIONS), "code"),
        "config": F.when(ext.isin(*CONFIG_EXTENSIONS), "config"),
        "arxml": F.when(ext.isin(*ARXML_EXTENSIONS), "arxml"),
    }
    return only.get(source_kind, F.coalesce(only["code"], only["arxml"], only["config"]))


def project_files(files: DataFrame, source_kind: str = "mixed", max_files: int | None = None) -> DataFrame:
    """Linked files with their kind; version-control folders are skipped."""
    rows = files.withColumn("kind", file_kind(F.col("path"), source_kind)).where("kind is not null").where(~F.col("path").rlike(r"(^|/)\.git/"))
    return rows.orderBy("path").limit(max_files) if max_files else rows


def file_text(content: Column, max_chars: int | None = None) -> Column:
    """Bytes as UTF-8 text, bad bytes replaced; the whole file unless ``max_chars`` bounds it."""
    text = F.decode(content, "UTF-8")
    return F.substring(text, 1, max_chars) if max_chars else text


# --- architecture descriptions ----------------------------------------------------------------

ENTITIES = (
    "artifact_id string, path string, entity string, qualified_name string, short_name string, kind string, "
    "parent string, ref string, ref2 string, value string, xpath string, seq int"
)
# Element names.
_COMPONENTS = {
    "APPLICATION-SW-COMPONENT-TYPE", "ATOMIC-SW-COMPONENT-TYPE", "COMPOSITION-SW-COMPONENT-TYPE", "SERVICE-SW-COMPONENT-TYPE",
    "COMPLEX-DEVICE-DRIVER-SW-COMPONENT-TYPE", "ECU-ABSTRACTION-SW-COMPONENT-TYPE", "SENSOR-ACTUATOR-SW-COMPONENT-TYPE",
}
_PORTS = {"P-PORT-PROTOTYPE": "P", "R-PORT-PROTOTYPE": "R", "PR-PORT-PROTOTYPE": "PR"}
_INTERFACES = {
    "SENDER-RECEIVER-INTERFACE": "sender_receiver", "CLIENT-SERVER-INTERFACE": "client_server", "MODE-SWITCH-INTERFACE": "mode_switch",
    "NV-DATA-INTERFACE": "nv_data", "PARAMETER-INTERFACE": "parameter", "TRIGGER-INTERFACE": "trigger",
}
_INTERFACE_PARTS = {"VARIABLE-DATA-PROTOTYPE": "data_element", "DATA-ELEMENT": "data_element", "CLIENT-SERVER-OPERATION": "operation"}
_CONNECTORS = {
    "ASSEMBLY-SW-CONNECTOR": ("assembly", "PROVIDER-IREF", "REQUESTER-IREF"),
    "DELEGATION-SW-CONNECTOR": ("delegation", "OUTER-PORT-IREF", "INNER-PORT-IREF"),
}
_PORT_REFS = {"TARGET-P-PORT-REF", "TARGET-R-PORT-REF", "TARGET-PR-PORT-REF", "TARGET-PORT-REF", "CONTEXT-COMPONENT-REF"}
_INTERFACE_REFS = {"PROVIDED-INTERFACE-TREF", "REQUIRED-INTERFACE-TREF", "PROVIDED-REQUIRED-INTERFACE-TREF"}


def _entities(xml: str) -> Iterator[dict]:
    """Entities of one document, by a single descent that carries package and owning component."""
    import xml.etree.ElementTree as ET

    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def text_of(e, names) -> str | None:
        return next((s.text.strip() for s in e.iter() if local(s) in names and s.text and s.text.strip()), None)

    def child(e, name) -> str:
        return next(((s.text or "").strip() for s in e if local(s) == name), "")

    stack = [(ET.fromstring(xml), "", "", "")]
    while stack:
        el, where, package, owner = stack.pop()
        tag = local(el)
        name = child(el, "SHORT-NAME")
        row = {"short_name": name, "xpath": where or f"/{tag}"}
        if tag == "AR-PACKAGE":
            package = f"{package}/{name}"
        elif tag in _COMPONENTS:
            owner = f"{package}/{name}"
            yield {**row, "entity": "component", "qualified_name": owner, "kind": tag}
        elif tag in _PORTS and owner:
            yield {**row, "entity": "port", "qualified_name": f"{owner}/{name}", "kind": _PORTS[tag], "parent": owner, "ref": text_of(el, _INTERFACE_REFS)}
        elif tag == "RUNNABLE-ENTITY" and owner:
            yield {**row, "entity": "runnable", "qualified_name": f"{owner}/{name}", "parent": owner, "value": child(el, "SYMBOL")}
        elif tag == "INTERNAL-BEHAVIOR" and owner:
            yield {**row, "entity": "behaviour", "qualified_name": f"{owner}/{name}", "parent": owner}
        elif tag in _INTERFACES:
            face = f"{package}/{name}"
            yield {**row, "entity": "interface", "qualified_name": face, "kind": _INTERFACES[tag]}
            for part in el.iter():
                if (kind := _INTERFACE_PARTS.get(local(part))) is not None:
                    own = child(part, "SHORT-NAME")
                    yield {"entity": kind, "qualified_name": f"{face}/{own}", "short_name": own, "parent": face, "xpath": row["xpath"]}
        elif tag in _CONNECTORS:
            kind, a, b = _CONNECTORS[tag]
            end = lambda which: next((text_of(s, _PORT_REFS) for s in el.iter() if local(s) == which), None)
            yield {**row, "entity": "connector", "qualified_name": f"{package}/{name}", "kind": kind, "ref": end(a), "ref2": end(b)}
        elif tag == "ECUC-NUMERICAL-PARAM-VALUE":
            definition = child(el, "DEFINITION-REF")
            yield {**row, "entity": "parameter", "qualified_name": definition, "short_name": definition.rsplit("/", 1)[-1], "parent": package, "value": child(el, "VALUE")}
        here = where or f"/{tag}"
        kids = [(c, f"{here}/{local(c)}[{i}]", package, owner) for i, c in enumerate(el)]
        stack.extend(reversed(kids))


def arxml_entities(files: DataFrame) -> DataFrame:
    """Long entity table of XML files (path, content): one row per component, port, interface,
    connector, runnable, parameter, internal behaviour, interface data element and operation.

    Files declaring a document type or entities in their first 4096 bytes are rejected before they are
    parsed and appear as one ``rejected`` row; so does a malformed file, with the reader's message.
    """
    head = F.decode(F.substring("content", 1, 4096), "UTF-8")
    rows = files.select(
        F.concat(F.lit("arxml-"), F.substring(F.sha2("content", 256), 1, 12)).alias("artifact_id"), "path",
        (head.contains("<!DOCTYPE") | head.contains("<!ENTITY")).alias("bad"), F.decode("content", "UTF-8").alias("xml"),
    )
    names = [f.split()[0] for f in ENTITIES.split(", ")]
    # The reader travels by value, so workers need not have this package installed.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for artifact, path, xml in zip(pdf.artifact_id, pdf.path, pdf.xml):
                try:
                    own = list(_entities(xml))
                except SyntaxError as e:  # what the XML reader raises for a malformed document
                    own = [{"entity": "rejected", "kind": "malformed", "value": str(e)}]
                out += [{"artifact_id": artifact, "path": path, "seq": i, **e} for i, e in enumerate(own)]
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda x: x.notna(), None)

    good = rows.where(~F.col("bad")).drop("bad").mapInPandas(read, ENTITIES)
    gone = [F.lit(None).cast("int" if n == "seq" else "string").alias(n) for n in names[3:]]
    return good.unionByName(rows.where("bad").select("artifact_id", "path", F.lit("rejected").alias("entity"), *gone))


# --- analyser findings ------------------------------------------------------------------------

SARIF = (
    "runs array<struct<tool:struct<driver:struct<name:string,version:string>>,results:array<struct<ruleId:string,"
    "message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,"
    "region:struct<startLine:string>>>>>>>>"
)


def sarif_findings(reports: DataFrame, label: str = "") -> DataFrame:
    """Findings of SARIF reports (path, text): rule, level, location, message and provenance."""
    runs = reports.select("path", F.explode(F.from_json("text", SARIF)["runs"]).alias("run"))
    rows = runs.select("path", "run.tool.driver.name", "run.tool.driver.version", F.explode("run.results").alias("r"))
    tool = F.lit(label) if label else F.coalesce("name", F.lit("external-analyzer"))
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    location = F.when(
        at["artifactLocation"]["uri"].isNotNull() & at["region"].isNotNull(),
        F.concat(at["artifactLocation"]["uri"], F.lit(":"), F.coalesce(at["region"]["startLine"], F.lit("?"))),
    ).otherwise("")
    return rows.select(
        "path", F.concat(tool, F.lit("/"), F.coalesce("r.ruleId", F.lit("external-rule"))).alias("rule"), F.lit("tool_reported").alias("level"),
        location.alias("location"), F.coalesce("r.message.text", F.lit("")).alias("message"),
        F.concat(F.lit("sarif:"), tool, F.lit(":"), F.coalesce("version", F.lit(""))).alias("provenance"),
    )
