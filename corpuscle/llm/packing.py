"""Packing whole documents into training sequences by linear grouping and best fit.

Tokens are counted in one pass over the texts.  Lengths are integers up to the capacity, so the plan
needs only how many pieces there are of each length: a table of at most ``capacity`` rows, whatever
the corpus' size.  From it the driver makes the plan:

1. large lengths are sorted and cut into groups of equal cardinality, each rounded up to its largest;
2. few-size configurations of rounded lengths are chosen one after the other, each the fullest around
   the largest remaining group (a knapsack over the groups) and used as often as the groups allow;
3. the actual lengths take the groups' places, which leaves some more room in each sequence;
4. the small lengths, largest first, go where they fit best, into new sequences when nowhere.

This is done for each number of groups in ``GROUPS`` and the plan with the fewest sequences is used.
The plan is a list of runs: pieces of length l with ranks from r go one by one to the sequences from s,
at offset o.  Its size depends on lengths and configurations, not on the number of documents.  A piece's
rank among those of its length is its rank within a hash slice of its document plus the counts of the
slices before, so no task ranks all pieces of a frequent length.

Edge cases: a null or empty text is the closing id alone; repeated rows are packed each; a null doc_id is
packed and stays null; longer documents are cut into pieces of the capacity, the last one shorter; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import texts as X
from corpuscle.session import written

CAPACITY, END_ID = 4096, 1
#: Lengths above this share of the capacity are large.
LARGE = 1 / 8
GROUPS = (64, 128, 256, 512, 1024)
#: Words whose ids a task remembers at most before it starts anew (memory only; ids do not depend on it).
REMEMBERED = 100_000


_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
#: Kinds of bytes in a plain word: 1 letter, 2 digit, 3 other printable, 0 not plain.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = 1
_KIND[0x30:0x3A] = 2
_KIND[[0x27, 0x3C]] = 0  # contractions and special tokens have rules of their own


def _fast_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, a blank standing for the end of a word.

    None unless the file is a word-end BPE vocabulary whose ids follow the order of its merges.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("end_of_word_suffix") != "</w>" or any(model["vocab"].get("".join(m)) != 512 + i for i, m in enumerate(model["merges"])):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
    out = {}
    for token, i in model["vocab"].items():
        end = token.endswith("</w>") and len(token) > 4
        raw = bytes(byte[c] for c in (token[:-4] if end else token)) if set(token.removesuffix("</w>")) <= byte.keys() else b" "
        if 32 not in raw:
            out[raw + b" " * end] = i
    return out | {b" ": len(model["vocab"]) + 16}


class Encoder:
    """Ids of texts, word by word: the tokenizer never joins across a blank or line end.

    The different words of a block are found by hash; new ones are encoded once and remembered.  Words of
    ASCII and Latin-1 letters, digits and signs are lower-cased and split here by the vocabulary's rules
    and merged by ranks, which gives the same ids as the tokenizer several times faster; any other word
    goes through the tokenizer as it is.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ranks = _fast_ranks(path)
        self.ranked = ranks and tiktoken.Encoding("ranks", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        if ranks:
            self.last = np.zeros(max(ranks.values()) + 1, bool)
            self.last[[i for raw, i in ranks.items() if raw.endswith(b" ")]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.starts, self.used, self.words = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0, 0

    def _remember(self, names: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.words + len(sizes) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.number.update(zip(names.tolist(), range(self.words, self.words + len(sizes))))
        self.starts[self.words + 1 : self.words + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.words, self.used = self.words + len(sizes), self.used + len(ids)

    def _learn(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, names: np.ndarray) -> None:
        n = e - s
        first = np.cumsum(n) - n
        b = data[np.arange(int(n.sum())) + np.repeat(s - first, n)]
        kind = _KIND[b]
        second = np.zeros(len(b), bool)  # after the lead byte of a Latin-1 letter
        second[1:] = b[:-1] == 0xC3
        second &= (b >= 0x80) & (b < 0xC0) & (b != 0x97) & (b != 0xB7)
        kind[second] = 1
        plain = np.minimum.reduceat(kind, first) > 0
        if self.ranked is None:
            plain[:] = False
        if plain.any():
            keep = np.repeat(plain, n)
            starts = np.zeros(len(b), bool)
            starts[first] = True
            b, kind, second, starts = b[keep], kind[keep], second[keep], starts[keep]
            b = b + np.where((b >= 0x41) & (b < 0x5B) | second & (b >= 0x80) & (b < 0x9F), np.uint8(32), np.uint8(0))
            edge = starts | (kind == 2)
            edge[1:] |= kind[1:] != kind[:-1]
            text = np.full(len(b) + int(edge.sum()), 0x20, np.uint8)
            text[np.arange(len(b)) + np.cumsum(edge) - 1] = b
            ids = np.array(self.ranked.encode_ordinary(text.tobytes().decode()), np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1  # one for each piece
            pieces = np.add.reduceat(edge.astype(np.int64), np.flatnonzero(starts))
            self._remember(names[plain], ids, np.diff(ends[np.cumsum(pieces) - 1], prepend=0))
        if not plain.all():
            other = np.flatnonzero(~plain)
            own = [x.ids for x in self.tokenizer.encode_batch([data[s[i] : e[i]].tobytes().decode() for i in other.tolist()], add_special_tokens=False)]
            self._remember(names[other], np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own], np.int64))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and how many each text has."""
        if self.words > REMEMBERED:
            self.forget()
        s, e, first = X.words(data, offs, _BREAK)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        names, at, word = np.unique(X.span_hashes(data, s, e), return_index=True, return_inverse=True)
        get = self.number.get
        known = np.array([get(x, -1) for x in names.tolist()], np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            self._learn(data, s[at[new]], e[at[new]], names[new])
            known[new] = [get(x) for x in names[new].tolist()]
        a = self.starts[known]
        n = (self.starts[known + 1] - a)[word]
        total = np.concatenate(([0], np.cumsum(n)))
        out = self.ids[np.arange(total[-1]) + np.repeat(a[word] - total[:-1], n)]
        return out, np.diff(total[first])


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int):
    def run(batches):
        enc = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for b in batches:
            doc, out = b.column("doc_id").to_pylist(), defaultdict(list)
            for first, _, data, offs in X.blocks(b.column("text")):
                ids, sizes = enc.encode(data, offs)
                ids, at = ids.astype("<u4"), 0
                for d, n in zip(doc[first:], sizes.tolist()):
                    x = np.append(ids[at : at + n], np.uint32(END_ID)).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, len(x), capacity)):
                        cut = x[start : start + capacity]
                        for name, v in (("doc_id", d), ("piece", k), ("start", start), ("length", len(cut)), ("ids_crc32", zlib.crc32(cut.tobytes()))):
                            out[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _fullest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each rounded size go with one of the largest left to fill ``capacity`` best."""
    take = np.zeros(len(sizes), np.int64)
    lead = int(np.flatnonzero(left)[0])
    take[lead] = 1
    capacity -= int(sizes[lead])
    reach = np.zeros(capacity + 1, bool)
    reach[0] = True
    by = np.full(capacity + 1, -1, np.int64)  # the group whose piece first reached a fill
    for g in np.flatnonzero((left > 0) & (sizes <= capacity)).tolist() if capacity else []:
        s = int(sizes[g])
        for _ in range(int(min(left[g] - take[g], capacity // s))):
            new = np.zeros_like(reach)
            new[s:] = reach[:-s]
            new &= ~reach
            if not new.any():
                break
            by[new] = g
            reach |= new
        if reach[capacity]:
            break
    fill = int(np.flatnonzero(reach).max())
    while fill:
        take[by[fill]] += 1
        fill -= int(sizes[by[fill]])
    return take


class _Runs:
    """Sequences of one content: (first number, how many, room) in runs; what lies in them goes to ``plan``."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.plan = capacity, 0, []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, how many)]

    def new(self, n: int) -> int:
        self.count += n
        return self.count - n

    def best_fit(self, length: int, rank: int, n: int) -> None:
        """Put ``n`` pieces of one length, ranked from ``rank``, where they leave least room."""
        while n:
            room = min((r for r, runs in self.open.items() if r >= length and runs), default=None)
            if room is None:
                each = self.capacity // length
                full, rest = divmod(n, each)
                for bins, per in ((full, each), (1 if rest else 0, rest)):
                    if bins:
                        s = self.new(bins)
                        for k in range(per):
                            self.plan.append((length, rank, bins, s, k * length))
                            rank += bins
                        self._leave(self.capacity - per * length, s, bins)
                return
            s, bins = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
            each = room // length
            full = min(bins, n // each)
            if full:
                for k in range(each):
                    self.plan.append((length, rank, full, s, self.capacity - room + k * length))
                    rank += full
                n -= full * each
                self._leave(room - each * length, s, full)
                if bins > full:
                    self._leave(room, s + full, bins - full)
            else:  # fewer pieces than one sequence takes
                for k in range(n):
                    self.plan.append((length, rank + k, 1, s, self.capacity - room + k * length))
                self._leave(room - n * length, s, 1)
                if bins > 1:
                    self._leave(room, s + 1, bins - 1)
                n = 0

    def _leave(self, room: int, s: int, bins: int) -> None:
        if room:
            self.open[room].append((s, bins))


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset) that place every piece once."""
    return min((_planned(counts, capacity, g) for g in groups), key=lambda r: r.count).plan


def _planned(counts: dict[int, int], capacity: int, groups: int) -> _Runs:
    runs = _Runs(capacity)
    used: dict[int, int] = defaultdict(int)  # ranks given out, by length
    large = sorted(((l, n) for l, n in counts.items() if l > capacity * LARGE and l < capacity), reverse=True)
    if counts.get(capacity):
        runs.plan.append((capacity, 0, counts[capacity], runs.new(counts[capacity]), 0))
    # Groups of equal cardinality: (length, count) parts in descending order, each group's size its largest.
    each = max(1, -(-sum(n for _, n in large) // groups))
    members: list[list[list[int]]] = []
    free = 0
    for l, n in large:
        while n:
            if not free:
                members.append([])
                free = each
            k = min(n, free)
            members[-1].append([l, k])
            n -= k
            free -= k
    sizes = np.array([m[0][0] for m in members], np.int64)
    left = np.array([sum(k for _, k in m) for m in members], np.int64)
    while left.any():
        take = _fullest(sizes, left, capacity)
        some = take > 0
        times = int((left[some] // take[some]).min())
        left -= take * times
        _substitute(runs, members, take, times, used, capacity)
    for l, n in sorted(counts.items(), reverse=True):
        if l < capacity and n > used[l]:
            runs.best_fit(l, used[l], n - used[l])
    return runs


def _substitute(runs: _Runs, members, take, times: int, used, capacity: int) -> None:
    """Fill ``times`` sequences of one configuration with actual lengths of its groups."""
    slots = [g for g, k in enumerate(take) for _ in range(k)]
    first = runs.new(times)
    cuts: list[list[tuple[int, int]]] = []  # for each slot the lengths along the sequences
    for g in slots:
        need, part = times, []
        while need:
            l, k = members[g][0]
            n = min(k, need)
            part.append((l, n))
            need -= n
            if n == k:
                members[g].pop(0)
            else:
                members[g][0][1] -= n
        cuts.append(part)
    at, index, gone = 0, [0] * len(slots), [0] * len(slots)
    while at < times:
        n = min(cuts[j][index[j]][1] - gone[j] for j in range(len(slots)))
        offset = 0
        for j in range(len(slots)):
            l = cuts[j][index[j]][0]
            runs.plan.append((l, used[l], n, first + at, offset))
            used[l] += n
            offset += l
            gone[j] += n
            if gone[j] == cuts[j][index[j]][1]:
                index[j], gone[j] = index[j] + 1, 0
        runs._leave(capacity - offset, first + at, n)
        at += n


def _placed(runs: list[tuple[int, int, int, int, int]]):
    """Look up sequence and offset by (length, rank)."""
    p = np.array(sorted(runs), np.int64).reshape(-1, 5)
    stride = np.int64(1) << np.int64(48)
    keys = p[:, 0] * stride + p[:, 1]

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = p[np.searchsorted(keys, length * stride + rank, side="right") - 1] if len(p) else np.zeros((len(length), 5), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(r[:, 3] + rank - r[:, 1]), pa.array(r[:, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document with its sequence and offset.

    ``tokenizer`` is the path of a word-level vocabulary file that every executor can read.
    """
    from pyspark.sql import Window as W

    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = written(pieces, "pieces")
    slices = max(256, pieces.count() // 200_000)
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    sizes = written(pieces.groupBy("length", "slice").agg(F.count("*").alias("n")), "sizes")
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = F.sum("n").over(W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("length", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("own", own).join(sizes, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    # Repeated rows tie in every column, so any order of theirs places the same pieces.
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _placed(plan(histogram, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
