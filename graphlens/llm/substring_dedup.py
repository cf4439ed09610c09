"""Removal of repeated passages with difference-cover anchors.

A window is 35 consecutive words of one text. The positions p with p mod 21 in the perfect
difference cover {0, 1, 4, 14, 16} are anchors: for any two positions there is a shift below
21 that puts both on anchors, so any two equal windows share, at the same offset, an aligned
anchor whose 15 words (35 - 21 + 1) lie inside both. The steps:

1. documents are dealt into blocks of bounded size; each block hashes its anchors,
   keeps each hash once, and notes those it holds twice (pre-aggregation);
2. hashes held by two blocks, or twice by one, go back to the blocks that hold them;
3. windows around such an anchor are extended to their 35 words (96-bit hash), counted
   by block in the same way, and those that occur again go back to the blocks;
4. the words covered by them are removed.

A hot passage costs one row for each block that holds it, however often it occurs, and no pairs are
formed. Words and runs of words are compared by hashes under a key that is drawn anew for each call (by the driver, so that
tasks that are run again use the same one) and that appears in no result: nobody can write down texts that collide. Words have 64 bits (of up to
8 bytes the bytes themselves, mixed; of up to 32 mixed step by step; of more a keyed BLAKE2 digest) and windows 96, so
that two different windows are taken for the same with a probability of some 2^-96, whatever the texts. Null and empty texts have no words; texts of under 35 words are kept
whole; copies of a text remove each other whole, so of a clean document go just the words that lie in a run
of 35 which stands elsewhere too; rows with equal or null ids are different documents, and each gives a row. A long
text is one row of one block, whose task needs some 20 times its bytes. Other columns are not read, so
their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
BLOCK_BYTES = 16 << 20
#: Small tables are dealt into so many blocks, if they are of so many bytes at least.
LEAST_BLOCKS, LEAST_BLOCK_BYTES = 64, 1 << 20
#: Blocks beyond so many share partitions, which take one after the other.
MOST_PARTITIONS = 20_000

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_ON_COVER = np.isin(np.arange(PERIOD), COVER)
#: Longer words are hashed by a digest.
MIXED_BYTES = 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of words and of runs of words under a key."""

    def __init__(self, key: bytes):
        self.key = key
        draw = np.random.default_rng(int.from_bytes(key, "little"))
        self.bases = [int(x) | 1 for x in draw.integers(2**62, 2**64, 5, dtype=np.uint64)]
        self.start = np.uint64(draw.integers(0, 2**64, dtype=np.uint64))

    def words(self, text: bytes) -> np.ndarray:
        """A 64-bit hash of each word of a text; words of up to 8 bytes of equal length never share one."""
        n = len(text)
        padded = text + bytes(8)
        gap = np.ones(n + 2, bool)
        gap[1:-1] = _SPACES[np.frombuffer(text, np.uint8)]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        del gap
        starts, ends = edges[::2], edges[1::2]
        eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        lengths = ends - starts
        out = _mix(((eight[starts] & _MASKS[np.minimum(lengths, 8)]) ^ self.start) + lengths.astype(np.uint64) * np.uint64(self.bases[0]))
        for k in range(8, MIXED_BYTES, 8):
            at = np.flatnonzero(lengths > k)
            if not len(at):
                break
            out[at] = _mix(out[at] * np.uint64(self.bases[4]) ^ (eight[starts[at] + k] & _MASKS[np.minimum(lengths[at] - k, 8)]))
        for i in np.flatnonzero(lengths > MIXED_BYTES).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(text[starts[i] : ends[i]], digest_size=8, key=self.key).digest(), "little")
        return out

    def runs(self, words: np.ndarray, width: int, k: int = 1) -> np.ndarray:
        """A hash of each run of ``width`` words, by its first word: runs of a power of two are made from halves, and put together."""
        n = len(words) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        base, run, size, done = self.bases[k], words, 1, 0
        out = np.zeros(n, np.uint64)
        while True:
            power = np.uint64(pow(base, size, 1 << 64))
            if width & size:
                out *= power
                out += run[done : done + n]
                done += size
            if 2 * size > width:
                return _mix(out)
            run = run[:-size] * power + run[size:]
            size *= 2


@functools.cache
def hashes(key: bytes) -> Hashes:
    return Hashes(key)


def new_key() -> bytes:
    return os.urandom(32)


def _anchors(by: Hashes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(words) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    found = by.runs(words, ANCHOR)
    at = np.flatnonzero(np.resize(_ON_COVER, len(found)))
    return at, found[at]


def _once(h: np.ndarray, h2: np.ndarray | None, block: int) -> pa.RecordBatch | pa.Table:
    """Each value once, with whether it came twice."""
    order = np.argsort(h, kind="stable") if h2 is None else np.lexsort((h2, h))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if h2 is not None:
        h2 = h2[order]
        new[1:] |= h2[1:] != h2[:-1]
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(h))) > 1
    cols = {"h": h[at].view(np.int64)} | ({} if h2 is None else {"h2": h2[at].view(np.int32)})
    return pa.table(cols | {"block": np.full(len(at), block, np.int32), "many": many})


def _bytes(column) -> Iterator[bytes]:
    for chunk in column.cast(pa.binary()).chunks:
        yield from (x.as_py() or b"" for x in chunk)


def _anchor_rows(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = hashes(key)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            blocks = table["block"].to_numpy()
            found: dict[int, list] = {}
            for block, text in zip(blocks, _bytes(table["text"]), strict=True):
                found.setdefault(int(block), []).append(_anchors(by, by.words(text))[1])
            for block, parts in found.items():
                yield from _once(np.concatenate(parts), None, block).to_batches()

    return run


def _candidates(by: Hashes, words: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """First words of the windows that hold a shared anchor."""
    at, found = _anchors(by, words)
    at = at[_within(found, shared)]
    if not len(at):
        return at
    n = len(words) - WINDOW + 1
    turn = np.zeros(n + 1, np.int64)
    np.add.at(turn, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(turn, np.minimum(at + 1, n), -1)
    return np.flatnonzero(np.cumsum(turn[:-1]) > 0)


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _windows(by: Hashes, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return by.runs(words, WINDOW, 2)[at], (by.runs(words, WINDOW, 3)[at] >> np.uint64(32)).astype(np.uint32)


def _window_rows(key: bytes, docs: pa.Table, shared: pa.Table) -> pa.Table:
    by = hashes(key)
    known = np.sort(shared["h"].to_numpy().view(np.uint64))
    first, second, block = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)], docs["block"][0].as_py() if len(docs) else 0
    for text in _bytes(docs["text"]):
        words = by.words(text)
        a, b = _windows(by, words, _candidates(by, words, known))
        first.append(a)
        second.append(b)
    return _once(np.concatenate(first), np.concatenate(second), block)


def _kept_rows(key: bytes, docs: pa.Table, again: pa.Table) -> pa.Table:
    by = hashes(key)
    h, h2 = again["h"].to_numpy().view(np.uint64), again["h2"].to_numpy().view(np.uint32)
    order = np.lexsort((h2, h))
    h, h2 = h[order], h2[order]
    out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": []}
    for text in _bytes(docs["text"]):
        parts = text.split()
        removed = np.zeros(len(parts), bool)
        if len(parts) >= WINDOW and len(h):
            a, b = _windows(by, by.words(text), np.arange(len(parts) - WINDOW + 1))
            # where several repeated windows share the first half of the hash, each is tried
            first, last = np.searchsorted(h, a), np.searchsorted(h, a, "right")
            hit = np.zeros(len(a), bool)
            for k in range(int((last - first).max(initial=0))):
                at = first + k
                ok = at < last
                hit[ok] |= h2[at[ok]] == b[ok]
            turn = np.zeros(len(parts) + 1, np.int64)
            at = np.flatnonzero(hit)
            turn[at] += 1
            np.add.at(turn, at + WINDOW, -1)
            removed = np.cumsum(turn[:-1]) > 0
        kept = [w for w, gone in zip(parts, removed.tolist(), strict=True) if not gone] if removed.any() else parts
        out["n_words"].append(len(parts))
        out["n_removed"].append(int(removed.sum()))
        out["kept_text"].append(b" ".join(kept))
    return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_text": pa.array(out["kept_text"], pa.binary())})


def _repeated(keys: list[str]):
    """Of rows sorted by keys and block, each block's once, where the keys come from two blocks or twice from one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, and whether its key is known to repeat
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            cols = {c: table[c].to_numpy() for c in (*keys, "block")}
            many = table["many"].to_numpy(zero_copy_only=False)
            if held is not None:
                cols = {c: np.concatenate([[held[0][c]], v]).astype(v.dtype) for c, v in cols.items()}
                many = np.concatenate([[held[1]], many])
            n = len(many)
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([cols[k][1:] != cols[k][:-1] for k in keys])
            starts = np.flatnonzero(new)
            again = np.logical_or.reduceat(many, starts) | (np.diff(np.append(starts, n)) > 1)
            rows = np.repeat(again, np.diff(np.append(starts, n)))
            # the last row may go on in the next batch; a first row carried over was given out already if it was known to repeat
            keep = rows.copy()
            if held is not None and held[1]:
                keep[0] = False
            keep[1:] &= new[1:] | (cols["block"][1:] != cols["block"][:-1])
            carried = ({c: v[-1] for c, v in cols.items()}, bool(rows[-1]))
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_pydict({c: v[at] for c, v in cols.items()})
            held = carried

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (binary, UTF-8) of each row."""
    size = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    small = min(LEAST_BLOCKS, -(-size // LEAST_BLOCK_BYTES))
    blocks = max(1, small, -(-size // BLOCK_BYTES))
    # rows that are the same, ids and all, are parted by where they are read
    spread = F.pmod(F.xxhash64(docs[id_col], F.crc32(docs[text_col].cast("binary")), F.spark_partition_id()), F.lit(blocks)).cast("int")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), spread.alias("block")).repartition(min(blocks, MOST_PARTITIONS), "block")
    kind = docs.schema[id_col].dataType.simpleString()
    key = new_key()

    def shared(found: DataFrame, keys: dict[str, str]) -> DataFrame:
        schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", block int"
        return found.repartition("h").sortWithinPartitions(*keys, "block").mapInArrow(_repeated([*keys]), schema)

    anchors = shared(rows.mapInArrow(_anchor_rows(key), "h long, block int, many boolean"), {"h": "long"})
    windows = rows.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(lambda docs, shared: _window_rows(key, docs, shared), "h long, h2 int, block int, many boolean")
    again = shared(windows, {"h": "long", "h2": "int"})
    return rows.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(lambda docs, again: _kept_rows(key, docs, again), f"doc_id {kind}, n_words long, n_removed long, kept_text binary")
