"""SentencePiece encoding with N-best segmentations, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NEWLINE_FREE = re.compile(r" *[^ \n]+| +|\n")
#: Penalty of a character without a piece, below the least score of an ordinary piece; it becomes its bytes.
UNKNOWN = 10.0
#: Ids whose texts are joined at once.
JOINED = 1 << 20
#: Segmentations remembered by a Python worker, which bounds its memory and changes no result, and their longest unit.
REMEMBERED, REMEMBERED_CHARS = 600_000, 64
#: Longer units, and such with unknown characters, are segmented one by one.
BATCH_CHARS = 40
#: Multiplier of the rolling hash by which substrings are looked up in columns.
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces with ids and scores; `table` has None for a string that only begins pieces."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    table: dict[str, tuple[int, float] | None] = field(default_factory=dict)
    unknown: float = 0.0
    #: Sorted hashes of pieces and of what begins pieces, with ids (-1 for a mere beginning) and scores.
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    gains: np.ndarray = field(default_factory=lambda: np.zeros(0))
    longest: int = 0
    single: set[str] = field(default_factory=set)
    memory: dict[str, tuple[bytes, float]] = field(default_factory=dict)
    scored: np.ndarray = field(default_factory=lambda: np.zeros(0))
    leads: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def __post_init__(self) -> None:
        special = set(self.byte_ids) | {0, 1, 2}
        ordinary = [(p, i) for i, p in enumerate(self.pieces) if i not in special]
        for p, _ in ordinary:
            for end in range(1, len(p)):
                self.table.setdefault(p[:end], None)
        for p, i in ordinary:
            self.table[p] = (i, self.scores[i])
        self.unknown = min((self.scores[i] for p, i in ordinary if p.strip(SPACE)), default=0.0) - UNKNOWN
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p, _ in ordinary):
            raise ValueError("pieces must not span words or lines")
        self.longest = max(map(len, self.table), default=0)
        self.single = {p for p, hit in self.table.items() if len(p) == 1 and hit}
        rows = sorted((_hash(p), *(hit or (-1, 0.0))) for p, hit in self.table.items())
        self.hashes, self.ids, self.gains = (np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int32, float)))
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.slots, self.shift = _slots(self.hashes)
        self.lattice = lru_cache(10_000)(lambda unit: _backward_edges(unit, self))
        self.joint = lru_cache(20_000)(lambda parts, n: _paths(list(parts), self, n))


def _hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
    return h


def _slot(h: np.ndarray, shift: np.uint64) -> np.ndarray:
    return ((h * BASE) >> shift).astype(np.int64)


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """An open hash table of row numbers, an eighth of it filled at most: a taken slot sends a row to the next one."""
    bits = max(4, (8 * len(hashes)).bit_length())
    shift, slots = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
    rows = np.arange(len(hashes))
    at = _slot(hashes, shift)
    while len(rows):
        free = slots[at] < 0
        slots[at[free]] = rows[free]
        left = slots[at] != rows
        rows, at = rows[left], (at[left] + 1) % len(slots)
    return slots, shift


def _found(h: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Row number of each hash, or -1."""
    slot = _slot(h, v.shift)
    at = v.slots[slot]
    other = np.flatnonzero((at >= 0) & (v.hashes[at] != h))
    while len(other):
        slot[other] = (slot[other] + 1) % len(v.slots)
        at[other] = v.slots[slot[other]]
        other = other[(at[other] >= 0) & (v.hashes[at[other]] != h[other])]
    return at


def read_vocabulary(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and the ids of the 256 byte pieces of a model with byte fallback, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def _edges(unit: str, start: int, v: Vocabulary) -> Iterator[tuple[int, int, float]]:
    """(end, id, score) of the pieces that begin at `start`; an unknown character is an edge of id -1."""
    known = False
    for end in range(start + 1, len(unit) + 1):
        hit = v.table.get(unit[start:end], 0)
        if hit == 0:
            break
        if hit is not None:
            known = known or end == start + 1
            yield end, hit[0], hit[1]
    if not known:
        yield start + 1, -1, v.unknown


def forward(unit: str, v: Vocabulary) -> tuple[list[float], list[float], list[tuple[int, int]]]:
    """Best and second best score of every position of the piece lattice, and the last edge of the best path to it."""
    best, second = [-inf] * (len(unit) + 1), [-inf] * (len(unit) + 1)
    back = [(0, 0)] * (len(unit) + 1)
    best[0] = 0.0
    table, n = v.table, len(unit)
    for start in range(n):
        here, other, known, end = best[start], second[start], False, start + 1
        while end <= n:
            hit = table.get(unit[start:end], 0)
            if hit == 0:
                break
            if hit is not None:
                known = known or end == start + 1
                score = here + hit[1]
                if score > best[end]:
                    second[end] = max(best[end], other + hit[1])
                    best[end], back[end] = score, (start, hit[0])
                elif score > second[end]:
                    second[end] = score
            end += 1
        if not known:
            score, end = here + v.unknown, start + 1
            if score > best[end]:
                second[end] = max(best[end], other + v.unknown)
                best[end], back[end] = score, (start, -1)
            elif score > second[end]:
                second[end] = score
    return best, second, back


#: Stands for a literal U+2581 of the text inside a unit, where that sign means a blank.
MARK = "\x00"


def units(text: str) -> list[str]:
    """The text with its leading blank, cut where no piece can cross: before blanks and around line ends."""
    return NEWLINE_FREE.findall(" " + text) if text else []


def _lattice(unit: str) -> str:
    """A unit as pieces spell it. A literal block sign has no piece of its own meaning and falls back to bytes."""
    return unit.replace(SPACE, MARK).replace(" ", SPACE)


def segment(unit: str, v: Vocabulary) -> tuple[bytes, float]:
    """Ids of the best segmentation of a unit as int32, and how much the second best falls short (inf if none)."""
    u = _lattice(unit)
    literal = SPACE in unit
    best, second, back = forward(u, v)
    steps: list[list[int]] = []
    at = len(u)
    while at:
        start, piece = back[at]
        steps.append(_bytes_or_piece(unit, u, start, piece, v, literal))
        at = start
    return np.fromiter(chain.from_iterable(reversed(steps)), "<i4").tobytes(), best[-1] - second[-1]


def segment_columns(units: list[str], v: Vocabulary) -> list[tuple[bytes, float]]:
    """`segment` of many units of one length without unknown characters: the same forward pass, a column at a time."""
    n, size = len(units), len(units[0])
    codes = np.frombuffer("".join(u.replace(" ", SPACE) for u in units).encode("utf-32-le"), "<u4").reshape(n, size).astype(np.uint64) + np.uint64(1)
    best, second = np.full((size + 1, n), -inf), np.full((size + 1, n), -inf)
    start, piece = np.zeros((size + 1, n), np.int16), np.zeros((size + 1, n), np.int32)
    best[0] = 0.0
    for s in range(size):
        rows, h = np.arange(n), np.zeros(n, np.uint64)
        for e in range(s + 1, min(s + v.longest, size) + 1):
            h = h * BASE + codes[rows, e - 1]
            at = _found(h, v)
            known = at >= 0
            if not known.all():
                rows, h, at = rows[known], h[known], at[known]
                if not len(rows):
                    break
            whole = v.ids[at] >= 0
            r, gain = (rows, v.gains[at]) if whole.all() else (rows[whole], v.gains[at[whole]])
            score, old = best[s, r] + gain, best[e, r]
            more = score > old
            won, lost = r[more], r[~more]
            # A path that beats the best leaves it, or its own second best, as the second best.
            second[e, won] = np.maximum(old[more], second[s, won] + gain[more])
            second[e, lost] = np.maximum(second[e, lost], score[~more])
            best[e, won], start[e, won], piece[e, won] = score[more], s, v.ids[at[whole][more]]
    path, at, every = np.full((n, size), -1, np.int32), np.full(n, size), np.arange(n)
    for column in range(size - 1, -1, -1):
        live = at > 0
        if not live.any():
            break
        path[live, column] = piece[at[live], every[live]]
        at = np.where(live, start[at, every], 0)
    counts = (path >= 0).sum(axis=1)
    flat, ends = path[path >= 0].astype("<i4").tobytes(), 4 * np.cumsum(counts)
    return list(zip([flat[b - 4 * c : b] for b, c in zip(ends.tolist(), counts.tolist())], (best[-1] - second[-1]).tolist()))


def remember(wanted: set[str], v: Vocabulary) -> None:
    """Segments the units that aren't in memory; a full memory is emptied first."""
    new = wanted.difference(v.memory)
    if len(v.memory) + len(new) > REMEMBERED:
        v.memory.clear()
        new = wanted
    by_length: dict[int, list[str]] = {}
    for u in new:
        if len(u) <= BATCH_CHARS and v.single.issuperset(u.replace(" ", SPACE)) and SPACE not in u:
            by_length.setdefault(len(u), []).append(u)
        else:
            v.memory[u] = segment(u, v)
    for same in by_length.values():
        for at in range(0, len(same), 20_000):
            part = same[at : at + 20_000]
            v.memory.update(zip(part, segment_columns(part, v)))


def _bytes_or_piece(unit: str, u: str, start: int, piece: int, v: Vocabulary, literal: bool) -> list[int]:
    if piece >= 0:
        return [piece]
    return [v.byte_ids[b] for b in (unit if literal else u)[start].encode("utf-8", "surrogatepass")]


def _backward_edges(unit: str, v: Vocabulary) -> tuple[str, list[float], list[list[tuple[int, int, float]]]]:
    """A unit as pieces spell it, its forward scores, and for every position the edges that end there."""
    u = _lattice(unit)
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(u) + 1)]
    for start in range(len(u)):
        for end, piece, score in _edges(u, start, v):
            into[end].append((start, piece, score))
    return u, forward(u, v)[0], into


def _paths(parts: list[str], v: Vocabulary, n: int) -> list[tuple[float, list[list[int]]]]:
    """The n best joint segmentations of some units, best first.

    A-star search from the end of the last unit to the beginning of the first. The forward Viterbi score of a position
    is exactly what is left to gain from there, so complete paths leave the agenda in the order of their scores. No
    more than n of the paths to a position can be part of the n best, so a position is left n times at most; of equal ranks the
    latest goes first, which takes one of many ties to its end instead of all of them a step.
    """
    lattices, scores, into = zip(*[v.lattice(p) if len(p) <= REMEMBERED_CHARS else _backward_edges(p, v) for p in parts])
    upto = [0.0]
    for s in scores:
        upto.append(upto[-1] + s[-1])
    k = len(parts) - 1
    agenda = [(-upto[-1], 0, k, len(lattices[k]), 0.0, None)]
    made, found = 0, []
    left = [[0] * (len(u) + 1) for u in lattices]
    while agenda and len(found) < n:
        rank, _, k, at, gained, path = heapq.heappop(agenda)
        if left[k][at] == n:
            continue
        left[k][at] += 1
        if at == 0 and k == 0:
            ids: list[list[int]] = [[] for _ in parts]
            while path:
                (unit, start, piece), path = path
                ids[unit] += _bytes_or_piece(parts[unit], lattices[unit], start, piece, v, SPACE in parts[unit])
            found.append((-rank, ids))
            continue
        if at == 0:
            k -= 1
            at = len(lattices[k])
        for start, piece, score in into[k][at]:
            if left[k][start] == n:
                continue
            made -= 1
            total = gained + score
            heapq.heappush(agenda, (-(total + scores[k][start] + upto[k]), made, k, start, total, ((k, start, piece), path)))
    return found


def encode(text: str, v: Vocabulary, n: int) -> tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, list[int]]]]]]:
    """Ids and score of the best segmentation, and the n best as (score, edits of the best: first piece, pieces, ids).

    Only the n-1 units whose second best segmentation costs least can differ from the best in any of the n best: each
    of them alone gives a better alternative than any other unit does. The joint search runs over these.
    """
    whole = units(text)
    return encode_units(whole, v, n)


def encode_units(whole: list[str], v: Vocabulary, n: int):
    """`encode` of a text that is cut into units already."""
    try:
        found = list(map(v.memory.__getitem__, whole))
    except KeyError:
        remember(set(whole), v)
        found = list(map(v.memory.__getitem__, whole))
    if not whole:
        return np.zeros(0, "<i4"), 0.0, []
    blobs, gaps = zip(*found)
    ids, gaps = np.frombuffer(b"".join(blobs), "<i4"), np.array(gaps)
    near = np.arange(len(gaps))
    if 1 < n < len(gaps):
        near = np.flatnonzero(gaps <= np.partition(gaps, n - 2)[n - 2])
    loose = sorted(i for i in near[np.argsort(gaps[near], kind="stable")[: n - 1]].tolist() if gaps[i] < inf)
    parts = [whole[i] for i in loose]
    short = sum(map(len, parts)) <= REMEMBERED_CHARS * n
    outcomes = (v.joint(tuple(parts), n) if short else _paths(parts, v, n)) if loose else [(0.0, [])]
    # Unknown characters score as such, not as the bytes they become: the plain sum only holds for pieces.
    score = float(_gains(v)[ids].sum()) + _unknown_gain(ids, v)
    if not loose:
        return ids, score, [(score, [])]
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    offset = (np.cumsum(lengths) - lengths)[loose].tolist()
    first = outcomes[0][0]
    best = []
    for gained, new in outcomes:
        edits = [(o, len(found[i][0]) // 4, p) for i, o, p in zip(loose, offset, new) if np.array(p, "<i4").tobytes() != found[i][0]]
        best.append((score + (gained - first), edits))
    return ids, score, best


def _gains(v: Vocabulary) -> np.ndarray:
    """Score of each id; byte pieces score nothing here."""
    if len(v.scored) == 0:
        v.scored = np.array(v.scores)
        v.scored[v.byte_ids] = 0.0
    return v.scored


def _unknown_gain(ids: np.ndarray, v: Vocabulary) -> float:
    """Score of the unknown characters: one for every first byte of a character among the byte pieces."""
    if len(v.leads) == 0:
        v.leads = np.zeros(len(v.pieces), bool)
        v.leads[[i for b, i in enumerate(v.byte_ids) if b & 0xC0 != 0x80]] = True
    return v.unknown * int(v.leads[ids].sum())


def decode(ids, v: Vocabulary) -> str:
    """The text of a sequence of ids: blanks for block signs, runs of bytes as UTF-8, without the leading blank."""
    byte = {i: b for b, i in enumerate(v.byte_ids)}
    out, run = [], bytearray()
    for i in ids:
        b = byte.get(i)
        if b is not None:
            run.append(b)
            continue
        if run:
            out.append(run.decode("utf-8", "surrogatepass"))
            run.clear()
        out.append(v.pieces[i].replace(SPACE, " "))
    if run:
        out.append(run.decode("utf-8", "surrogatepass"))
    return "".join(out)[1:]


NBEST = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
NBEST_SQL = "array<struct<score: double, edits: array<struct<at: int, `drop`: int, ids: array<int>>>>>"


def _shared(spark: SparkSession, path: str):
    """The vocabulary for the tasks, under a name; its size is that of the model file, whatever the corpus."""
    return path, spark.sparkContext.broadcast(read_vocabulary(path))


_BUILT: dict[str, Vocabulary] = {}


def _built(shared) -> Vocabulary:
    """One vocabulary, with its memory, for each Python worker."""
    path, content = shared
    if path not in _BUILT:
        _BUILT.clear()
        _BUILT[path] = Vocabulary(*content.value)
    return _BUILT[path]


def encoded(docs: DataFrame, n: int = 4, path: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, score, nbest): segmentation of every whole text by the model's own piece scores.

    nbest holds up to n different segmentations, best first, as edits of ids; equal scores come in the order of the
    search. A null text has null ids, score and nbest; an empty one has no ids, score 0 and no segmentations. Repeated
    rows give equal rows, an empty table an empty one. `decoded` gives the text back exactly.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    shared = _shared(docs.sparkSession, path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _built(shared)
        for batch in batches:
            split = [None if t is None else units(t) for t in batch.column(1).to_pylist()]
            remember({u for whole in split for u in whole or ()}, v)
            done = [None if whole is None else encode_units(whole, v, n) for whole in split]
            sizes = [0 if d is None else len(d[0]) for d in done]
            flat = np.concatenate([d[0] for d in done if d is not None] or [np.zeros(0, np.int32)])
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([d is None for d in done])
            )
            nbest = [None if d is None else [{"score": s, "edits": [{"at": a, "drop": k, "ids": p} for a, k, p in edits]} for s, edits in d[2]] for d in done]
            scores = pa.array([None if d is None else d[1] for d in done], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, scores, pa.array(nbest, NBEST)], names=["doc_id", "ids", "score", "nbest"])
            for whole in split:  # what is too long to stay
                for u in whole or ():
                    if len(u) > REMEMBERED_CHARS:
                        v.memory.pop(u, None)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, score double, nbest {NBEST_SQL}")


def _plain(v) -> pa.Array:
    """The text of each piece. A byte below 128 is a character of its own; longer characters are put together by `decode`."""
    texts: list[str | None] = [p.replace(SPACE, " ") for p in v.pieces]
    for b, i in enumerate(v.byte_ids):
        texts[i] = chr(b) if b < 128 else None
    return pa.array(texts, pa.string())


def _decoded(lists: pa.ListArray, plain: pa.Array, v) -> pa.Array:
    """`decode` of each list of ids, a column at a time where no byte is part of a longer character."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    if len(lists) > 1 and sizes.sum() > JOINED:
        half = len(lists) // 2
        return pa.concat_arrays([_decoded(lists[:half], plain, v), _decoded(lists[half:], plain, v)])
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    # A list with a null joins to a null.
    joined = pc.utf8_slice_codeunits(pc.binary_join(pa.ListArray.from_arrays(ends, plain.take(lists.flatten())), ""), 1)
    open_ = pc.and_(pc.is_null(joined), pc.is_valid(lists))
    if pc.any(open_).as_py():
        found = pa.array([decode(x, v) for x in lists.filter(open_).to_pylist()], pa.string())
        joined = pc.replace_with_mask(joined, open_, found)
    return pc.if_else(pc.is_valid(lists), joined, pa.scalar(None, pa.string()))


def decoded(rows: DataFrame, ids: str = "ids", into: str = "decoded", path: str = MODEL) -> DataFrame:
    """All rows and columns plus the text of `ids`; null ids give a null text, no ids an empty one."""
    shared = _shared(rows.sparkSession, path)
    small_batches(rows.sparkSession)

    @F.arrow_udf("string")
    def back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from types import SimpleNamespace

        v = SimpleNamespace(**dict(zip(("pieces", "scores", "byte_ids"), shared[1].value)))
        plain = _plain(v)
        for batch in batches:
            yield _decoded(batch, plain, v)

    return rows.withColumn(into, back(F.col(ids)))
