"""Secrets in whole texts: three fixed patterns and sliding-window entropy over candidate strings.

Candidates are the maximal runs of letters, digits and ``+/_=-``.  For each character class a window
moves over the candidate; adding one character and removing another changes two counts, from which
the window's Shannon entropy follows without counting again.  Windows at or above the class's
threshold that hold the class's mixture of characters are merged into spans.  What a fixed pattern
has found is cut out of them and the free pieces stay.  Allowed pieces (identifiers, placeholders, plain
words and numbers) are suppressed, and so are candidates announced as digests that have the form of the
digest announced; a placeholder between separators or inside a dense string speaks for itself only, not
for what stands beside it, and one that begins or ends a string marks it as made up.  Positions are code points, ends exclusive.

Only texts with a long run or a key word are looked at character by character; the runs come from
one numpy pass over the bytes of all texts.

Edge cases: a null text is empty and has no span; repeated rows get a result each; a null doc_id is
kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuscle.llm import texts as X

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of 32 or more
KINDS = ("assign", "access", "hex", "entropy")

_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_CANDIDATE_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_KEYS = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia")
#: class: characters, window, least entropy, groups that a window must all hold
CLASSES = (
    ("hex", frozenset("0123456789abcdef"), 20, 2.9, ("0123456789", "abcdef")),
    ("HEX", frozenset("0123456789ABCDEF"), 20, 2.9, ("0123456789", "ABCDEF")),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 24, 3.9,
     ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")),
    # From the candidates' least length on; words pass these thresholds too and are left to the allow list.
    ("mixed", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 16, 3.3,
     ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")),
    ("lower", frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), 16, 2.7, ("0123456789", "abcdefghijklmnopqrstuvwxyz")),
    ("upper", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16, 2.7, ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    ("letters", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), 16, 2.7, ()),
)
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9_+/=-]+|[0-9]{8}T[0-9]{4,9}Z?",  # numbers, dates
    re.IGNORECASE,
)
_MADE_UP = "example|changeme|placeholder|x{5,}|0?1234567890?|abcdefgh"
#: A placeholder at either end of a string.
PLACEHOLDER = re.compile(rf"^(?:{_MADE_UP})|(?:{_MADE_UP})(?:key|token|secret|value)?$", re.IGNORECASE)
#: A placeholder that is a part of a path or name of its own.
_APART = re.compile(rf"(?<![A-Za-z0-9])(?:{_MADE_UP})(?![A-Za-z0-9])", re.IGNORECASE)
#: The pairs of letters that make up 89 % of those in distinct words of prose and code, and 27 % of those in random letters.
_PAIRS = frozenset(
    ("aa ab ac ad ae ai al am an ao ar as at au be bl bo ca ce ch ci co ct da de dh di do dr ds dt ea eb ec ed ee ef eg eh ei el em en eo ep "
     "er es et eu ev ew ex ez fa fe fi fo fr ft ga ge ha hb he hh hi hl hn ho hr hs ht hw ia ic ie il im in io ir is it ja ke la le li ll lo "
     "ly ma me mi mp na nb nc nd ne ng nh ni nl nn no nr ns nt nu nv nw oa oc od of oi ol om on oo or os ot ou pa pe pf po pr qu ra rb rc re "
     "rh ri rl rn ro rr rs rt sa sc se sh si so sr ss st su ta tb te th ti tl tn to tr ts tt tz ua ue ui ul un uo ur us ut ux ve vi wh ye zu ").split()
)
ANNOUNCED = re.compile(r"(sha-?(?:1|256|384|512)|md5|crc32|commit|etag)[ \t]*[:=-]?[ \t]*$", re.IGNORECASE)
#: Bytes of a digest by its announcement.
_DIGEST_BYTES = {"sha1": (20,), "sha256": (32,), "sha384": (48,), "sha512": (64,), "md5": (16,), "crc32": (4, 8), "commit": (20, 32), "etag": (16, 20, 32)}
_HEX_RUN = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Least share of such pairs.
WORDLIKE = 0.6
_PLOGP = [0.0] + [c * math.log2(c) for c in range(1, 65)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def dense_windows(s: str, chars: frozenset, width: int, least: float, groups: tuple[str, ...]) -> list[tuple[int, int]]:
    """Merged windows of ``s`` whose entropy reaches ``least`` bits, by incremental counts."""
    out: list[list[int]] = []
    count: dict[str, int] = {}
    total, start = 0.0, 0  # total: the sum of c * log2(c) over the window's counts
    for i, ch in enumerate(s):
        if ch not in chars:
            count, total, start = {}, 0.0, i + 1
            continue
        c = count.get(ch, 0)
        total += _PLOGP[c + 1] - _PLOGP[c]
        count[ch] = c + 1
        if i - start >= width:
            old = s[start]
            c = count[old]
            total += _PLOGP[c - 1] - _PLOGP[c]
            count[old] = c - 1
            start += 1
        if i - start == width - 1 and math.log2(width) - total / width >= least - 1e-9 and all(any(count.get(x, 0) for x in g) for g in groups):
            if out and start <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([start, i + 1])
    return [(a, b) for a, b in out]


def merged_windows(s: str) -> list[tuple[int, int]]:
    """Merged dense windows of all classes."""
    out: list[list[int]] = []
    for a, b in sorted(w for _, chars, width, least, groups in CLASSES for w in dense_windows(s, chars, width, least, groups)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def wordlike(s: str) -> bool:
    """Whether words make up the string: most neighbours of letters are letters that follow them in words.

    Separators and the humps of camel case count as ends of words, a digit beside a letter does not.
    """
    good = bad = 0
    for a, b in zip(s, s[1:]):
        if a.isalpha() and b.isalpha():
            if not (a.islower() and b.isupper()):
                pair = (a + b).lower() in _PAIRS
                good, bad = good + pair, bad + (not pair)
        elif a.isalnum() and b.isalnum() and not (a.isdigit() and b.isdigit()):
            bad += 1
    return good >= WORDLIKE * (good + bad)


def allowed(s: str) -> bool:
    """Whether a found string is no secret."""
    return bool(ALLOWED.fullmatch(s) or PLACEHOLDER.search(s)) or wordlike(s)


def announced_digest(text: str, start: int, end: int) -> bool:
    """Whether the run from ``start`` to ``end`` is announced as a digest and has its form: hex, or for sums base64, of its length."""
    m = ANNOUNCED.search(text, max(0, start - 16), start)
    if not m:
        return False
    kind, run = m.group(1).lower().replace("-", ""), text[start:end]
    sizes = _DIGEST_BYTES[kind]
    if _HEX_RUN.fullmatch(run):
        return len(run) in [2 * n for n in sizes] or (kind == "commit" and len(run) < 40)
    return kind not in ("commit", "etag") and len(run) in [-(-n // 3) * 4 for n in sizes] and len(run.rstrip("=")) in [-(-n * 4 // 3) for n in sizes]


def _reported(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """What is no placeholder of the found string from ``a`` to ``b``."""
    s = text[a:b]
    cuts = [m.span() for m in _APART.finditer(s)]
    if not cuts:
        return [] if allowed(s) else [(a, b)]
    # The string without its placeholders: the parts beside them count if they are dense themselves.
    out, at = [], 0
    for x, y in [*cuts, (len(s), len(s))]:
        out += [(a + at + i, a + at + j) for i, j in merged_windows(s[at:x]) if not allowed(s[at + i : at + j])]
        at = y
    return out


def entropy_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what ``taken`` (sorted) leaves free of dense candidates and is not allowed."""
    cover: list[list[int]] = []
    for a, _, b in taken:
        if cover and a <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], b)
        else:
            cover.append([a, b])
    out, j = [], 0
    for m in _CANDIDATE_RUN.finditer(text):
        if announced_digest(text, m.start(), m.end()) or ALLOWED.fullmatch(m.group()):
            continue
        for a, b in merged_windows(m.group()):
            a, b = m.start() + a, m.start() + b
            while j < len(cover) and cover[j][1] <= a:
                j += 1
            i = j
            while i < len(cover) and cover[i][0] < b:
                if cover[i][0] > a:
                    out += _reported(text, a, cover[i][0])
                a = max(a, cover[i][1])
                i += 1
            if a < b:
                out += _reported(text, a, b)
    return [(a, 3, b) for a, b in out]


def find(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind, end), by start and then kind."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + entropy_spans(text, base))


def _suspects(col: pa.Array) -> np.ndarray:
    """Which texts hold a long run or a key word; all others have no span."""
    flag = np.zeros(len(col), bool)
    for a, b, data, offs in X.blocks(col):
        s, e = X.runs(_CANDIDATE[data], offs)
        flag[a + np.searchsorted(offs, s[e - s >= 16], side="right") - 1] = True
        low = data.tobytes().lower()
        for key in _KEYS:
            i = low.find(key)
            while i >= 0:
                r = int(np.searchsorted(offs, i, side="right")) - 1
                flag[a + r] = True
                i = low.find(key, int(offs[r + 1]))
    return flag


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches):
    for b in batches:
        col = b.column("text")
        flag = _suspects(col)
        rows = [find(col[i].as_py()) if f else [] for i, f in enumerate(flag.tolist())]
        base = [[x for x in r if x[1] < 3] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), *(pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64()) for k in range(4)),
             pa.array([hashlib.sha256(_spell(r).encode()).hexdigest() for r in base], pa.string()), pa.array([_spell(r) for r in rows], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of the fixed patterns' spans, and all spans."""
    return docs.select("doc_id", "text").mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with every span (overlaps merged) replaced by ``mask``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with secrets replaced in ``text`` (and ``n_chars`` brought up to date if it is there)."""
    names = docs.columns

    def run(batches):
        for b in batches:
            col = b.column("text")
            flag = _suspects(col)
            if flag.any():
                new, sizes = col.to_pylist(), {}
                for i in np.flatnonzero(flag).tolist():
                    if spans := find(new[i]):
                        new[i] = masked(new[i], spans, mask)
                        sizes[i] = len(new[i])
                if sizes:
                    cols = {n: b.column(n) for n in names} | {"text": pa.array(new, col.type)}
                    if "n_chars" in cols:
                        old = cols["n_chars"]
                        cols["n_chars"] = pa.array([sizes.get(i, v) for i, v in enumerate(old.to_pylist())], old.type)
                    b = pa.RecordBatch.from_arrays(list(cols.values()), names)
            yield b.select(names)

    return docs.mapInArrow(run, docs.schema)
