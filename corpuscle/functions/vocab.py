"""Word lists, tables and patterns that results depend on.

Everything here is data.  Order matters where a table says so.
"""

# --- characters -----------------------------------------------------------------------------
# The characters Python treats as white space, as one regex class and as a trim set.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# --- identifiers and signals ----------------------------------------------------------------
# Patterns.
REQ_A = r"\b((?:SWS|RS|PRS)_[A-Za-z0-9_]+)"
REQ_B = r"\[((?:SWS|RS|PRS|SRS|TPS|constr)_[A-Za-z0-9_\-]+)\]"
API_SIG = r"\b([A-Z][A-Za-z0-9_]*(?:_[A-Z][A-Za-z0-9_]*)+)\b"
ECUC = r"\b([A-Z][A-Za-z0-9]*[Cc]fg|[A-Z][A-Za-z0-9]*Config[A-Za-z0-9]*)\b"
HEADING = r"(?m)^(\d+(?:\.\d+){0,3})\s+(.{3,120})$"
FIGURE_CAP = r"(?im)^(Figure|Diagram|Equation)\s+([\d.\-]+)[:.\s]+(.{5,200})"
TABLE_CAP = r"(?im)^(Table)\s+([\d.\-]+)[:.\s]+(.{5,200})"
FURNITURE = (
    r"(?i)AUTOSAR\s+.*(?:Release|Specification).*|Page\s+\d+\s+of\s+\d+|Document\s+(?:ID|Status|Title).*"
)
TOKEN = r"[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)*"
SUB_TOKEN = r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])"
SENTENCE_END = r"(?<=[.!?])\s+"
WORD = r"[A-Za-z_][A-Za-z0-9_]*"
EVAL_REQ = r"\b(?:SWS|SRS|PRS|TPS|RS|EXP|CONSTR|QM)_[A-Za-z0-9_]+\b"
EVAL_API = r"\b[A-Z][A-Za-z0-9]*_[A-Za-z0-9_]+\b"
EVAL_CAMEL = r"\b[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+\b"
NUMBER_UNIT = (
    r"\b\d+(?:[.,]\d+)?\s?(?:ms|us|ns|s|mm|Hz|kHz|MHz|GB|MB|KB|kB|bit|byte|bytes|%|V|mA|A|W)\b"
)
CONTENT_REQ = r"\b(?:SWS|RS|PRS)_[A-Za-z0-9_\-]+\b"
CONTENT_API = r"\b([A-Z][A-Za-z0-9]*_[A-Za-z0-9_]+)\b"
MODAL = r"(?i)\b(shall not|shall|should|may)\b"
CONDITION = r"(?i)\b(if|when|unless|except)\b"
CONTENT_HEADING = r"(?m)^(?:\d+(?:\.\d+)*)\s+\S+"
ASIL = r"(?i)\bASIL\s*[- ]?\s*(QM|A|B|C|D)\b"
BROKEN_CHARS = r"[\x{fffd}\x00-\x08]"
WIDE_GAP = r"\S+\s{3,}\S+"
IDENTIFIER_CELL = r"^[A-Za-z][A-Za-z0-9_]*$"
DECORATIVE = ("logo", "cover", "decorat", "background")

# Stop words of the content-word measures.
STOP_WORDS = tuple(
    """
    a an the of to in on for with by from as at is are was were be been being and or but if
    then than that this these those it its we our you your i me my do does did not no nor so
    such can could should would may might must shall will shall there here what which who whom
    whose when where why how all any both each few more most other some only own same too very
    about into over under again further once because while during before after above below
    """.split()
)

# --- modules, platforms, releases -----------------------------------------------------------
# Alias -> module, in matching order.
MODULE_ALIASES = {
    "canif": "CanIf", "can interface": "CanIf",
    "pdurouter": "PduR", "pdu router": "PduR", "pdur": "PduR",
    "candrv": "CanDrv", "can driver": "CanDrv",
    "cansm": "CanSM", "can state manager": "CanSM",
    "com": "Com", "autosar com": "Com",
    "someip": "SOME-IP", "some-ip": "SOME-IP", "some/ip": "SOME-IP",
    "ecuc": "ECUC", "ecu configuration": "ECUC",
    "ara::com": "ara::com",
    "doip": "DoIP", "xcp": "XCP", "dcm": "Dcm", "dem": "Dem",
    "rte": "RTE", "run-time environment": "RTE", "runtime environment": "RTE",
    "runnable": "RTE", "runnables": "RTE",
    "swc": "RTE", "sw component": "RTE", "sw components": "RTE",
    "software component": "RTE", "software components": "RTE",
    "vfb": "RTE", "virtual functional bus": "RTE",
    "dtc": "Dem", "diagnostic trouble code": "Dem", "diagnostic event": "Dem",
    "debounce": "Dem", "freeze frame": "Dem", "obd": "Dem",
    "uds": "Dcm", "unified diagnostic services": "Dcm",
    "det": "Det", "default error tracer": "Det",
    "bsw": "BSW", "basic software": "BSW",
    "mcal": "MCAL", "microcontroller abstraction": "MCAL",
    "eth": "Eth", "ethernet": "Eth",
    "ethif": "EthIf", "eth if": "EthIf", "ethernet interface": "EthIf",
    "ethswt": "EthSwt", "eth switch": "EthSwt", "ethernet switch": "EthSwt", "eth switch port": "EthSwt",
    "ethtsyn": "EthTSyn", "eth tsyn": "EthTSyn", "ethernet time sync": "EthTSyn",
    "tcpip": "TcpIp", "tcp ip": "TcpIp", "tcp/ip": "TcpIp",
    "ethtrcv": "EthTrcv", "eth transceiver": "EthTrcv",
    "ethctrl": "EthCtrl", "eth controller": "EthCtrl",
}
# Umbrella word -> modules.
MODULE_GROUPS = {
    "diagnostic": ("Dcm", "Dem"),
    "diagnostics": ("Dcm", "Dem"),
    "diag": ("Dcm", "Dem"),
    "diags": ("Dcm", "Dem"),
    "ethernet": ("Eth", "EthIf", "EthSwt", "EthTSyn", "TcpIp"),
    "eth switch": ("EthSwt", "EthIf"),
}
PLATFORM_WORDS = {"classic": "Classic", "adaptive": "Adaptive", "foundation": "Foundation"}
CO_MENTION_MODULES = ("CanIf", "CanDrv", "CanSM", "PduR", "Com", "SOME-IP", "ECUC", "Dcm", "Dem", "DoIP")
ASIL_ORDER = ("D", "C", "B", "A", "QM")

# --- questions ------------------------------------------------------------------------------
# Patterns and word sets of question understanding.
Q_API = r"\b([A-Z][A-Za-z0-9]*_[A-Za-z0-9_]+)\b"
Q_REQ = r"\b((?:SWS|RS|PRS)_[A-Za-z0-9_\-]+|\[PRS_[A-Za-z0-9_\-]+\])"
REL_CLASSIC = r"\b4\.[2-4](?:\.\d)?\b"
REL_ADAPTIVE = r"\bR\d{2}-11\b"
PARAM_PHRASES = (
    r"named\s+([A-Za-z][A-Za-z0-9_]*)",
    r"ECUC parameter ([A-Za-z][A-Za-z0-9_]*)",
    r"How is ([A-Za-z][A-Za-z0-9_]*) configur",
)
COMPARE_WORDS = ("compare", "comparison", "difference", "differences", "changed", "vs", "versus", "between")
TROUBLE_WORDS = (
    "why", "error", "errors", "fail", "fails", "failure", "e_not_ok", "det",
    "not reaching", "mismatch", "troubleshoot", "troubleshooting",
)
CONFIG_WORDS = (
    "configure", "configures", "configured", "configuring", "configuration",
    "configurations", "config", "ecuc", "parameter", "parameters",
    "container", "containers", "mandatory", "default",
    "switch", "topology", "coupling", "vlan", "uplink",
)
API_WORDS = ("api", "apis", "function", "functions", "return value", "precondition", "preconditions", "init", "transmit")
DEPENDENCY_WORDS = (
    "interact", "interacts", "interaction", "interactions", "relationship", "relationships",
    "depend", "depends", "depending", "dependency", "dependencies", "which module", "path from", "sequence",
)
EXPLAIN_WORDS = ("explain", "describe", "complete", "initialization sequence", "receive path")
DEFINITION_PREFIXES = ("what is", "what are", "define", "meaning of", "purpose of")
DOC_TYPES = ("SWS", "PRS", "RS", "TPS", "TR")
DIAGRAM_WORDS = ("diagram", "diagrams", "figure", "figures", "path from", "communication path", "sequence")
TABLE_WORDS = ("table", "tables", "parameter", "parameters", "container", "containers")
ANY_RELEASE = ("any release", "all versions")

# Intent -> modalities.
INTENT_MODALITIES = {
    "api_lookup": ("api", "requirement", "text", "configuration", "table"),
    "requirement_lookup": ("requirement", "text", "table"),
    "configuration": ("configuration", "table", "text", "api"),
    "comparison": ("api", "requirement", "configuration", "text", "table", "diagram"),
    "dependency": ("diagram", "graph", "text", "api"),
    "deep_explanation": ("text", "diagram", "table", "graph", "requirement", "api"),
    "troubleshooting": ("requirement", "api", "text", "table"),
    "definition": ("text", "requirement"),
    "unknown": ("text", "requirement", "api"),
}
# Module -> expansion phrases.
MODULE_EXPANSIONS = {
    "CanIf": ("CAN Interface", "CanIf_Init", "CanIf_Transmit"),
    "PduR": ("PDU Router", "PduR routing"),
    "CanDrv": ("CAN Driver",),
    "CanSM": ("CAN State Manager",),
    "Com": ("COM stack", "Com_SendSignal", "signal gateway"),
    "RTE": (
        "Run-Time Environment", "runnable", "software component", "VFB",
        "SwComponentPrototype", "AtomicSwComponentType", "RunnableEntity",
        "RTEEvent", "TimingEvent", "PortPrototype", "PortInterface",
    ),
    "Dem": ("Diagnostic Event Manager", "DTC", "diagnostic trouble code", "event memory"),
    "Dcm": ("Diagnostic Communication Manager", "UDS", "diagnostic session"),
    "Det": ("Default Error Tracer", "Det_ReportError"),
    "BSW": ("Basic Software", "BSW scheduler"),
    "MCAL": ("Microcontroller Abstraction Layer",),
    "SOME-IP": ("SOMEIP", "SOME/IP", "service oriented communication"),
    "Eth": ("Ethernet", "EthIf", "EthSwt", "EthTSyn"),
    "EthIf": (
        "Ethernet Interface", "EthIfSwitchPortGroup", "CouplingPort", "CouplingElement",
        "VlanMembership", "EthernetPhysicalChannel",
    ),
    "EthSwt": ("Ethernet Switch", "EthSwtPort", "EthSwtNvm", "switch port", "uplink port"),
    "EthTSyn": ("Ethernet Time Sync", "EthTSynSwitchManagement", "AVB bridge"),
    "TcpIp": ("TCP/IP", "IpAddrAssignment", "socket"),
}

# Spelling corrections, shorthand and spaced aliases.
TYPOS = {
    "alla": "all", "hot": "how",
    "teh": "the", "nad": "and", "wich": "which", "whch": "which",
    "requared": "required", "requried": "required", "requird": "required",
    "deatiled": "detailed", "detialed": "detailed", "detials": "details",
    "proparty": "property", "proparties": "properties", "propetry": "property",
    "queation": "question", "quear": "question", "quetion": "question",
    "anaylsis": "analysis", "analsysis": "analysis",
    "chnage": "change", "chaneg": "change",
    "speling": "spelling", "spelling": "spelling",
    "elemnt": "element", "elemnts": "elements", "elment": "element",
    "maping": "mapping", "mappping": "mapping",
    "configruation": "configuration", "configuraion": "configuration",
    "explane": "explain", "explan": "explain",
    "defination": "definition", "definations": "definitions",
    "exmaple": "example", "exmple": "example",
    "diagostic": "diagnostic", "diagnostc": "diagnostic",
    "communcation": "communication", "comunication": "communication",
    "intialization": "initialization", "initialisation": "initialization",
    "architecure": "architecture", "archietcture": "architecture",
    "topolgy": "topology", "topologie": "topology",
    "diag": "diagnostic", "diags": "diagnostics", "config": "configuration",
    "init": "initialization", "req": "requirement", "reqs": "requirements",
}
SPACED_ALIASES = {"can if": "CanIf", "some ip": "SOME-IP", "can sm": "CanSM", "can drv": "CanDrv", "pdu r": "PduR"}
TECH_WORDS = (
    "classic", "adaptive", "foundation", "sws", "prs", "rs", "tps",
    "configuration", "configure", "initialization", "initialize", "initialise",
    "transmit", "receive", "controller", "protocol", "requirement", "requirements",
    "parameter", "parameters", "interaction", "interact", "difference", "compare",
    "comparison", "diagnostic", "troubleshoot", "sequence", "behavior", "behaviour",
    "return", "error", "message", "communication", "service", "discovery",
    "definition", "purpose", "explain", "version", "release", "module", "between",
    "component", "components",
    "detailed", "details", "property", "properties", "required", "mapping",
    "analysis", "question", "questions", "example", "examples", "element",
    "elements", "derive", "derived", "need", "needs", "provide", "provided",
)
PROTECTED = (
    r"^(\[?(?:SWS|RS|PRS)_[A-Za-z0-9_\-]+R?\d*\]?|[A-Z][A-Za-z0-9]*_[A-Za-z0-9_]+"
    r"|R\d{2}-11|\d+\.\d+(?:\.\d+)?|E_[A-Z_]+|\[E\d+\])$"
)
PUNCT = ".,?:;!\"'()"

# --- ranking --------------------------------------------------------------------------------
# Intent -> (lexical, dense) weights.
FUSION_WEIGHTS = {
    "definition": (0.5, 0.35), "api_lookup": (0.65, 0.2), "requirement_lookup": (0.65, 0.2),
    "configuration": (0.5, 0.25), "comparison": (0.4, 0.4), "dependency": (0.25, 0.25),
    "troubleshooting": (0.5, 0.3), "deep_explanation": (0.25, 0.55), "architecture": (0.25, 0.55),
    "unknown": (0.4, 0.4),
}
# Intent -> (lexical, dense, graph, modality) weights.
MODALITY_WEIGHTS = {
    "api_lookup": (0.60, 0.20, 0.10, 0.10), "requirement_lookup": (0.60, 0.20, 0.10, 0.10),
    "definition": (0.60, 0.20, 0.10, 0.10), "deep_explanation": (0.20, 0.35, 0.30, 0.15),
    "dependency": (0.20, 0.35, 0.30, 0.15), "configuration": (0.45, 0.20, 0.20, 0.15),
    "troubleshooting": (0.40, 0.25, 0.25, 0.10), "comparison": (0.40, 0.30, 0.15, 0.15),
    "unknown": (0.40, 0.30, 0.15, 0.15),
}
NORMATIVE = ("shall", "shall not", "should", "may", "must", "never", "always")
MODEL_MARKERS = (
    r"(?<!Traffic )Class [A-Z]\w*", r"Package M2::", r"Aggregated by",
    r"Base ARObject", r"«enumeration»", r"atp\.recommendedPackage",
)
CONFIG_MARKERS = (
    "Mapping Rule", "ECUC-", "BSW Description", "Template Description", "M2 Parameter", "shall ", "constr_",
)
PROJECT_TYPES = ("code", "arxml", "config", "diagram")

# --- graph ----------------------------------------------------------------------------------
# Vocabulary of typed edges.
NODE_KINDS = (
    "document", "release", "platform", "module", "chapter", "section", "subsection", "requirement", "api",
    "ecuc_parameter", "table", "image", "diagram", "equation", "interface", "error_code", "state", "event",
)
RELATIONS = (
    "contains", "belongs_to", "available_in", "defined_in", "depends_on", "interacts_with", "routes_through",
    "configured_by", "satisfies", "references", "has_table", "has_image", "has_diagram", "explains",
    "precedes", "transitions_to", "differs_from", "supported_by",
)

# --- security -------------------------------------------------------------------------------
# Patterns of sensitive content.
VIN = r"\b[A-HJ-NPR-Z0-9]{17}\b"
PRIVATE_IP = r"\b(?:10\.\d{1,3}\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)\d{1,3}\.\d{1,3}\b"
PRIVATE_IP_SHORT = r"\b(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)\d{1,3}\.\d{1,3}\b"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
CREDENTIAL = r"(?i)\b(api[_-]?key|secret|passwd|password)\s*[:=]\s*\S+"
ARXML_TAG = (
    r"<\s*(?:\w+:)?(?:APPLICATION-SW-COMPONENT-TYPE|COMPOSITION-SW-COMPONENT-TYPE|"
    r"ECUC-MODULE-CONFIGURATION-VALUES|R-PORT-PROTOTYPE|P-PORT-PROTOTYPE)"
)
C_SOURCE = r"#include\s*[<\"].*\.h[>\"]|Rte_(?:Read|Write|Call|Mode)|FUNC\s*\("
PROJECT_NAME = r"\b([A-Z][A-Za-z0-9_-]{2,40}-(?:ECU|Project|Platform)[A-Za-z0-9_-]*)\b"
VENDOR_NAMES = ("microsar", "tresos", "elektrobit", "vector", "kpit", "eb_")
CUSTOMER_NAMES = ("oem", "customer", "requirement", "rfq", "sow")
LOCAL_ONLY_TASKS = ("arxml_explanation", "arxml_to_code", "code_review")

# --- source code ----------------------------------------------------------------------------
# Advisory rules (name, pattern, message).
CODE_RULES = (
    ("dynamic-allocation", r"\bmalloc\s*\(|\bcalloc\s*\(|\brealloc\s*\(|\bnew\s+", "avoid dynamic allocation in safety code"),
    ("goto", r"(?m)^\s*goto\s+\w+|[^a-zA-Z_]goto\s+\w+", "unstructured control flow"),
    ("unsafe-api", r"\b(?:gets|strcpy|strcat|sprintf|system)\s*\(", "unsafe C library API"),
    ("suspicious-cast", r"\(\s*(?:uint8_t|uint16_t|int)\s*\*\s*\)", "suspicious pointer cast — review aliasing"),
    ("missing-memmap", r"#include\s*[\"<](?!.*(?:MemMap|Compiler)\b)", "include without MemMap/Compiler abstraction visible"),
)
ADVISORY = (
    "Advisory finding — requires configured static-analysis verification. Not a compliance determination."
)
RTE_CALL = r"\bRte_(?:Read|Write|Call|Mode|Invalidate|Receive|Send)_\w+"

# --- evaluation -----------------------------------------------------------------------------
# Taxonomy, targets, penalties, gate.
CATEGORIES = (
    "definition", "api_lookup", "requirement_lookup", "configuration", "runtime_behaviour", "table_lookup",
    "diagram_lookup", "release_comparison", "multi_hop", "code_explanation", "traceability",
    "impact_analysis", "test_analysis", "unanswerable", "adversarial",
)
COVERAGE_TARGETS = {
    "multi_hop": 0.30, "unanswerable": 0.15, "table_lookup": 0.03, "diagram_lookup": 0.03,
    "release_comparison": 0.03, "code_explanation": 0.03, "traceability": 0.03, "impact_analysis": 0.03,
    "test_analysis": 0.03,
}
DIFFICULTIES = ("easy", "medium", "hard")
FAILURE_PENALTY = {
    "error": 100, "clarify_asked_instead_of_answering": 95, "no_evidence_retrieved": 90,
    "abstained_despite_gold_evidence": 85, "abstained_without_evidence": 80, "gold_evidence_not_retrieved": 70,
    "hallucinated_identifier": 60, "citation_not_supporting_claim": 50, "answer_does_not_cover_gold": 40,
    "unanswerable_question_was_answered": 35, "slow": 10, "ok": 0,
}
OUTCOME_WEIGHT = {"ABSTAIN": 3, "DOWN": 3, "PARTIAL": 2}
