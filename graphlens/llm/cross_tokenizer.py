"""Alignment of the tokens of two tokenizers over a corpus.

A text is encoded by a byte-level tokenizer A (with a space before it) and by a piece tokenizer B (which adds that space
itself), both without special tokens: their strings within texts are ordinary text. Where tokens of both end at one byte,
the texts are cut into groups. A link is a token of A and one of B whose bytes overlap. The steps:

1. one scan encodes and aligns. For each id of A the id of B with the same bytes is known beforehand (the identity map). Groups of one
   token on both sides that follow it are counted in a vector as long as the vocabulary, one for each task;
   only links of other groups are counted as pairs of ids, each different pair once for a run of texts. Of each document the different pairs of
   its links with their numbers are written, with all that needs no other document;
2. the vectors are summed by id, the pairs by pair (a shuffle of irregular links alone), and each id of B gets its highest count;
3. the counts of the identity map and of the most frequent pairs, KNOWN of them at most, are broadcast and looked up for each document.
   Rarer pairs, if there are any, meet their counts in a join: each occurs less often than all that were broadcast, so none is hot.

Null and empty texts have no tokens, nor have texts whose bytes one of the tokenizers does not give back; their numbers are zero and
their groups the empty text. Each row is handled by itself: ids may be null and repeat, and copies count as often as they stand. Texts are taken some megabytes
at a time; a longer one is taken whole, whose task needs some 150 times its bytes. Other columns are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER, Parts, binary_column, byte_characters, gather
from .common import by_bytes, new_folder, reliable
from .token_files import LibraryEncoder

PIECES = "piece_bpe_32k.model"
#: Bytes of text that are aligned together.
TOGETHER = 2 << 20
#: Pairs whose counts are broadcast, beside those of the identity map: some 17 bytes each.
KNOWN = 1 << 20
#: Words that a worker remembers for each tokenizer.
REMEMBERED = 250_000
#: Different irregular pairs that a task holds before it gives out their counts.
HELD = 1 << 18
_SPACE = "▁"


class PlainEncoder(LibraryEncoder):
    """The tokenizers library with the strings of special tokens as ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.lib.encode_special_tokens = True
        self.parts = Parts(self.raw, self.many, lambda marks: self.raw(marks) if marks else b"", [], remembered=REMEMBERED)
        byte_of = {c: b for b, c in byte_characters().items()}
        spec = json.load(open(path, encoding="utf-8"))
        tokens = {k: bytes(byte_of[c] for c in t) for t, k in spec["model"]["vocab"].items()}
        self.bytes = [tokens.get(k, b"") for k in range(self.size)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.parts.encode_some(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))


class WholeParts(Parts):
    """Parts between single spaces that are not cut further: pieces may join letters and marks."""

    def cut(self, parts: pa.Array) -> tuple[pa.Array, pa.Array]:
        return parts, pa.array([""], pa.large_string()).take(pa.array(np.zeros(len(parts), np.int64)))


class PieceEncoder:
    """A sentencepiece model behind a memory of the parts between single spaces, over which no piece reaches."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.lib.get_piece_size()
        names = [self.lib.id_to_piece(k) for k in range(self.size)]
        self.bytes = [bytes([int(t[3:5], 16)]) if self.lib.is_byte(k) else t.replace(_SPACE, " ").encode() for k, t in enumerate(names)]
        self.opens = np.array([t.startswith(_SPACE) for t in names])
        self.parts = WholeParts(self.raw, self.many, self.raw, [], remembered=REMEMBERED)
        self.parts.odd += "|^ "
        if any(_SPACE in t.strip(_SPACE) or t.endswith(_SPACE) and t.strip(_SPACE) for t in names):  # then parts cannot be encoded by themselves
            self.parts.odd = ""

    def raw(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, num_threads=1), "<u4").tobytes()

    def many(self, parts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(parts), 500):
            some = parts[k : k + 500]
            ids = np.array(self.lib.encode(" ".join(some), num_threads=1), "<u4")
            at = np.append(np.flatnonzero(self.opens[ids]), len(ids)).tolist()
            if len(at) == len(some) + 1:
                out += [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            else:  # a part holds the sign of a space
                out += [self.raw(p) for p in some]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.parts.encode_some(texts)


class Both:
    """Two tokenizers with the bytes of their tokens and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PlainEncoder(path_a), PieceEncoder(path_b)
        self.size = self.b.size
        of = {}
        for k, t in enumerate(self.b.bytes):
            if t not in of or self.b.lib.is_byte(of[t]):
                of[t] = k
        self.same = np.array([of.get(t, -1) if t else -1 for t in self.a.bytes], np.int64)
        self.flat = []
        for e in (self.a, self.b):
            lengths = np.array([len(t) for t in e.bytes], np.int64)
            self.flat.append((np.frombuffer(b"".join(e.bytes), np.uint8), np.cumsum(lengths) - lengths, lengths))
        digits = [str(k).encode() for k in range(max(self.a.size, self.b.size))]
        width = len(digits[-1]) + 1
        self.digits = np.frombuffer(b"".join(d.ljust(width) for d in digits), np.uint8).reshape(-1, width)
        self.width = np.array([len(d) for d in digits], np.int64)

    def encoded(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and counts on both sides; texts whose bytes a side does not give back have none."""
        whole = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        size = pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer(whole.buffers()[2], np.uint8)[: int(size.sum())]
        ok, out = size > 1, []
        for e, (flat, starts, lengths) in zip((self.a, self.b), self.flat, strict=True):
            ids, counts = e.encode(texts)
            ids = ids.astype(np.int64)
            text = np.repeat(np.arange(len(texts)), counts)
            fits = np.bincount(text, lengths[ids], len(texts)) == size
            some = ids[fits[text]]
            differ = np.flatnonzero(gather(flat, starts[some], lengths[some]) != raw[np.repeat(fits, size)])
            if len(differ):
                ends = np.cumsum(size * fits)
                fits[np.searchsorted(ends, differ, "right")] = False
            ok &= fits
            out.append((ids, counts, text))
        return [(ids[ok[text]], counts * ok) for ids, counts, text in out]

    def align(self, texts: pa.Array) -> Aligned:
        (a, n_a), (b, n_b) = self.encoded(texts)
        ends_a, ends_b = (np.cumsum(lengths[ids]) for ids, (_, _, lengths) in zip((a, b), self.flat, strict=True))
        total = int(ends_a[-1]) if len(ends_a) else 0
        mark_a, mark_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        mark_a[ends_a], mark_b[ends_b] = True, True
        cut = mark_a & mark_b
        # each stretch between two ends lies in one token of each side: a link
        links = np.flatnonzero(mark_a | mark_b)
        before = lambda mark: np.cumsum(mark)[links] - mark[links]
        of_a, of_b = a[before(mark_a)], b[before(mark_b)]
        last_a, last_b = cut[ends_a], cut[ends_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        plain = ((size_a == 1) & (size_b == 1))[before(cut)] & (self.same[of_a] == of_b)
        ends = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
        per = lambda mark: np.diff(np.concatenate([[0], np.cumsum(mark)[ends]]))
        written, stops = self.written(n_a + n_b, a, b, last_a, last_b, group_a, group_b, size_a, size_b)
        return Aligned(n_a, n_b, per(cut), per(mark_a | mark_b), of_a, of_a * self.size + of_b, plain, written, stops)

    def written(self, n, a, b, last_a, last_b, group_a, group_b, size_a, size_b) -> tuple[bytes, np.ndarray]:
        """The groups of all texts as decimal ids, each followed by its sign, and where each text's end; n: ids of each text."""
        at_a = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(size_a)[group_b]
        ids, signs = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        signs[at_a[last_a]], signs[at_b[last_b]] = ord("|"), ord(";")
        rows, width = self.digits[ids], self.width[ids]
        rows[np.arange(len(ids)), width] = signs
        raw = rows[np.arange(rows.shape[1]) <= width[:, None]].tobytes()
        return raw, np.concatenate([[0], np.cumsum(width + 1)])[np.cumsum(n)]


@dataclass
class Aligned:
    """Of a run of texts: numbers by text; by link the id of A, the pair of ids as one number, and whether it is a group that follows the identity map; the groups of all texts, and where each text's end."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    link_a: np.ndarray
    pair: np.ndarray
    plain: np.ndarray
    written: bytes
    stops: np.ndarray


@functools.cache
def both(path_a: str, path_b: str) -> Both:
    return Both(path_a, path_b)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in (b for whole in batches for b in by_bytes(whole, 1, TOGETHER)):
        yield batch, pa.concat_arrays([pc.fill_null(batch.column(1).cast(pa.large_string()), "")])


def _scan(path_a: str, path_b: str, groups: bool):
    """A row for each document, and rows with counts: of the identity map by id of A, of irregular links by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = both(path_a, path_b)
        vector, pairs, times = np.zeros(t.a.size, np.int64), [], []
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times", "counted"]
        kind = None

        def counts() -> pa.RecordBatch:
            """What has been counted as a row: pairs, those of the identity map among them, with their numbers."""
            at = np.flatnonzero(vector)
            pair = np.concatenate([at * t.size + t.same[at], *pairs])
            n = np.concatenate([vector[at], *times])
            regular = np.arange(len(pair)) < len(at)
            raw = np.stack([pair, n, regular], 1).astype("<i8").tobytes()
            vector[:] = 0
            pairs.clear()
            times.clear()
            kinds = [kind, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], pa.array([raw], pa.binary())], names)

        for batch, texts in _slices(batches):
            kind, x = batch.column(0).type, t.align(texts)
            vector += np.bincount(x.link_a[x.plain], minlength=t.a.size)
            pair, n = np.unique(x.pair[~x.plain], return_counts=True)
            pairs.append(pair)
            times.append(n)
            # the different pairs of each text
            text = np.repeat(np.arange(len(texts)), x.n_links)
            key, n = np.unique(text << 40 | x.pair, return_counts=True)
            per = np.bincount(key >> 40, minlength=len(texts))
            ends = x.stops.tolist()
            parts = [x.written[a : b - 1] if b > a else b"" for a, b in zip([0, *ends], ends, strict=False)]
            shas = [hashlib.sha256(p).hexdigest() if p else "" for p in parts]
            whole = pa.array(parts, pa.binary()) if groups else pa.nulls(len(texts), pa.binary())
            numbers = [pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)]
            kept = [binary_column((key & (1 << 40) - 1).astype("<u4"), per), binary_column(n.astype("<u4"), per)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(shas, pa.string()), whole, *kept, pa.nulls(len(texts), pa.binary())], names)
            del x, text, key, n, parts, whole, kept
            pa.default_memory_pool().release_unused()
            if sum(map(len, pairs)) > HELD:
                pair, of = np.unique(np.concatenate(pairs), return_inverse=True)
                pairs, times = [pair], [np.bincount(of, np.concatenate(times)).astype(np.int64)]
                if len(pair) > HELD // 2:
                    yield counts()
        if kind is not None:
            yield counts()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell in batch.column(0):
            rows = np.frombuffer(cell.as_py(), "<i8").reshape(-1, 3)
            yield pa.RecordBatch.from_pydict({"pair": rows[:, 0], "n": rows[:, 1], "regular": rows[:, 2] == 1})


def _summed(known):
    """For each document the sums over its pairs that are known, and the pairs that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, top = known.value
        for batch in batches:
            per = pc.binary_length(batch.column("pairs")).to_numpy(zero_copy_only=False) // 4
            text = np.repeat(np.arange(batch.num_rows), per)
            pair = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), "<u4").astype(np.int64)
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            found = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            total, best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, text[found], n[at[found]] * times[found])
            np.add.at(best, text[found], top[at[found]] * times[found])
            left = np.bincount(text[~found], minlength=batch.num_rows)
            rest = [binary_column(v[~found].astype("<u4"), left) for v in (pair, times)]
            kept = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(best), pa.array(total), *rest], [*kept, "n_best", "count_sum", "pairs", "times"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, pairs, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            pair = np.frombuffer(pairs, "<u4").astype(np.int64)
            yield pa.RecordBatch.from_pydict({"row": np.full(len(pair), row, np.int64), "pair": pair, "times": np.frombuffer(times, "<u4").astype(np.int64)})


@dataclass
class Alignment:
    """``documents``: one row per input row; ``pairs``: id_a, id_b, n and whether n is the highest of id_b (top)."""

    documents: DataFrame
    pairs: DataFrame


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, groups: bool = False, known: int = KNOWN) -> Alignment:
    """``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and, if asked for, groups (binary)."""
    spark = docs.sparkSession
    path_a, path_b = path_a or public_tokenizers.path(TOKENIZER), path_b or public_tokenizers.path(PIECES)
    size = both(path_a, path_b).size
    kind, folder = docs.schema[id_col].dataType.simpleString(), new_folder(spark, "alignment")
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups binary, pairs binary, times binary, counted binary"
    scanned = rows.mapInArrow(_scan(path_a, path_b, groups), schema).withColumn("row", F.monotonically_increasing_id())
    scanned.write.option("compression", "zstd").parquet(f"{folder}/documents")
    scanned = spark.read.parquet(f"{folder}/documents")

    counted = scanned.where("counted IS NOT NULL").select("counted").mapInArrow(_counted, "pair long, n long, regular boolean")
    totals = counted.groupBy("pair").agg(F.sum("n").alias("n"), F.max("regular").alias("regular")).withColumn("id_b", F.pmod("pair", F.lit(size)).cast("int"))
    totals = reliable(totals)
    best = totals.groupBy("id_b").agg(F.max("n").alias("most"))  # a row for each id of B at most
    totals = reliable(totals.join(F.broadcast(best), "id_b").select("pair", "n", "regular", (F.col("n") == F.col("most")).alias("top")))
    # counts are broadcast from a power of two on, the least that leaves few enough
    steps = totals.where("NOT regular").groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()  # 63 rows at most
    least, many = 64, 0
    for step, count in steps:
        many += count
        if many > known:
            break
        least = step
    else:
        least = 0
    frequent = (F.col("regular") | (F.floor(F.log2("n")) >= least)) if least else F.lit(True)
    table = totals.where(frequent).select("pair", "n", "top").toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "top")))

    of = scanned.where("counted IS NULL").drop("counted")
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in of.select(*names).schema)
    summed = of.select(*names, "pairs", "times").mapInArrow(_summed(shared), f"{kept}, n_best long, count_sum long, pairs binary, times binary")
    if least:
        summed = reliable(summed)
        rest = summed.where(F.length("pairs") > 0).select("row", "pairs", "times").mapInArrow(_unpacked, "row long, pair long, times long")
        rest = rest.join(totals.where(~frequent), "pair").groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
        summed = summed.join(rest, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    documents = summed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []))
    pairs = totals.select(F.floor(F.col("pair") / size).cast("int").alias("id_a"), F.pmod("pair", F.lit(size)).cast("int").alias("id_b"), "n", "top")
    return Alignment(documents, pairs)
