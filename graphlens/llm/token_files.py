"""Token ids in files of variable-length codes.

The file format. Ids are replaced by their ranks by frequency over the whole corpus (ties
by id), so that frequent ids take one byte. A file holds a contiguous range of documents in
ascending id order and consists of

    8 bytes   magic ``TOKRANK1``
    8 bytes   number of documents, little-endian, then as many ids (signed 64-bit) and lengths in tokens (64-bit)
    8 bytes   number of ids of the rank table, then that many ids (32-bit), in rank order
    control   two bits for each token, four to a byte, lowest first: bytes of its code minus one
    data      the codes, each 1 to 4 bytes, little-endian

The control bytes stand apart from the data, so a file is decoded without a loop: a table
gives the four lengths of each control byte, sums of lengths give each code's place, and
the codes are gathered by numpy.

Null texts are empty; every document ends with the end id, so none is without tokens. Rows
with equal ids stand in any order beside each other, and may go on in the next file; null ids come
first and read back as null. A text of any length is one row of one file. Other columns are not
read, so their names cannot clash. An empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import TOKENIZER, Parts, byte_characters
from .common import BROADCAST_ROWS, new_folder, split_uri

END_ID = 2
MAGIC = b"TOKRANK1"
FILE_TOKENS = 8_000_000
_NULL_ID = -(1 << 63)
#: The four code lengths that a control byte stands for.
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.uint8)


class LibraryEncoder:
    """The tokenizers library behind a memory of the parts between spaces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        space = byte_characters()[32]
        self.opens[[k for t, k in vocab.items() if t.startswith(space)]] = True
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.parts = Parts(self.raw, self.many, lambda marks: self.raw(marks) if marks else b"", special)
        self.size = len(self.opens)

    def raw(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def many(self, parts: list[str]) -> list[bytes]:
        """Parts that follow a space, encoded as one text: each begins at a token that begins with a space."""
        out = []
        for k in range(0, len(parts), 500):
            some = parts[k : k + 500]
            ids = np.array(self.lib.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
            if len(at) != len(some) + 1:
                raise ValueError("parts and tokens do not agree")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        return self.parts.chunks(texts)


@functools.cache
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of a sequence of ranks."""
    n = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(n) // 4) * 4, np.uint8)
    codes[: len(n)] = n - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    raw = np.ascontiguousarray(ranks.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) < n[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    n = LENGTHS[control].reshape(-1)[:count]
    ends = np.cumsum(n, dtype=np.int64)
    at = ends - n
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(n > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(ids: list, tokens: list[np.ndarray], table: np.ndarray, rank: np.ndarray) -> bytes:
    lengths = np.array([len(t) for t in tokens], "<i8")
    names = np.array([_NULL_ID if i is None else i for i in ids], "<i8")
    control, data = pack(rank[np.concatenate(tokens)])
    count = lambda n: int(n).to_bytes(8, "little")
    return b"".join([MAGIC, count(len(ids)), names.tobytes(), lengths.tobytes(), count(len(table)), table.astype("<u4").tobytes(), control, data])


def read_file(raw: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs = int.from_bytes(raw[8:16], "little")
    names, lengths = np.frombuffer(raw, "<i8", docs, 16), np.frombuffer(raw, "<i8", docs, 16 + 8 * docs)
    at = 16 + 16 * docs
    table = np.frombuffer(raw, "<u4", int.from_bytes(raw[at : at + 8], "little"), at + 8)
    at += 8 + 4 * len(table)
    total = int(lengths.sum())
    control = np.frombuffer(raw, np.uint8, -(-total // 4), at)
    data, groups = np.frombuffer(raw, np.uint8, offset=at + len(control)), LENGTHS[control].sum(1, dtype=np.int64)
    ends = np.cumsum(lengths)
    # some documents at a time, from the control byte in which the first of them begins
    k, code0, byte0 = 0, 0, 0
    while k < docs:
        last = max(k + 1, int(np.searchsorted(ends, code0 * 4 + 2_000_000)))
        stop = -(-int(ends[last - 1]) // 4)
        part = unpack(control[code0:stop], data[byte0:], min(4 * (stop - code0), total - 4 * code0))
        for j in range(k, last):
            a = int(ends[j] - lengths[j]) - 4 * code0
            yield (None if names[j] == _NULL_ID else int(names[j])), table[part[a : a + int(lengths[j])]]
        whole = int(ends[last - 1]) // 4
        byte0 += int(groups[code0:whole].sum())
        k, code0 = last, whole


def encode_once(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents, in any order, and keep the ids compressed in the folder with their counts.

    Rows (doc_id, ids) hold a document; rows without ids hold what a task has counted: pairs of id and number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        lib, press = library(path), zstandard.ZstdCompressor(1)
        counts = np.zeros(max(lib.size, END_ID + 1), np.int64)
        names = ["doc_id", "ids", "counts"]
        kind = "<u4" if lib.size > 1 << 16 else "<u2"
        for batch in batches:
            for a, b, ids, sizes in lib.chunks(batch.column(1)):
                counts += np.bincount(ids, minlength=len(counts))
                counts[END_ID] += len(sizes)
                ends = np.cumsum(sizes)
                ids = np.insert(ids.astype(kind), ends, END_ID)
                ends = (ends + np.arange(1, len(ends) + 1)).tolist()
                raw = memoryview(ids).cast("B")
                packed = [press.compress(raw[x * ids.itemsize : y * ids.itemsize]) for x, y in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(packed, pa.binary()), pa.nulls(len(packed), pa.binary())], names)
        at = np.flatnonzero(counts)
        seen = np.stack([at, counts[at]], 1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen], pa.binary())], names)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows.mapInArrow(run, "doc_id long, ids binary, counts binary").write.option("compression", "none").parquet(f"{folder}/encoded")
    return docs.sparkSession.read.parquet(f"{folder}/encoded")


def token_counts(encoded: DataFrame) -> DataFrame:
    """id, n over all documents, end ids included; ids that never occur are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                pairs = np.frombuffer(cell.as_py(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"id": pairs[:, 0].astype(np.int32), "n": pairs[:, 1]})

    return encoded.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the files and return their manifest (file, first, docs, tokens), itself written to the folder.

    A file's name is new for each attempt of a task; only files that the committed
    manifest names count, so what a lost or repeated task left behind is not read.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(TOKENIZER)
    encoded = encode_once(docs, folder, path, id_col, text_col)
    # one entry for each id of the vocabulary at most, whatever the input
    ranked = np.array([r["id"] for r in token_counts(encoded).orderBy(F.desc("n"), "id").select("id").collect()], np.int64)
    rest = np.setdiff1d(np.arange(max(int(ranked.max(initial=0)), END_ID) + 1), ranked)
    table = np.concatenate([ranked, rest])
    rank = np.empty(len(table), np.int64)
    rank[table] = np.arange(len(table))
    known = spark.sparkContext.broadcast((table, rank))
    target = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        kind, (table, rank), press = "<u4" if library(path).size > 1 << 16 else "<u2", known.value, zstandard.ZstdDecompressor()
        fs, place = split_uri(target)
        fs.create_dir(place, recursive=True)
        ids: list = []
        tokens: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(f"{place}/{name}") as f:
                f.write(file_bytes(ids, tokens, table, rank))
            row = {"file": [name], "first": [ids[0]], "docs": [len(ids)], "tokens": [sum(map(len, tokens))]}
            ids.clear()
            tokens.clear()
            return pa.RecordBatch.from_pydict(row, pa.schema([("file", pa.string()), ("first", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        held = 0
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens.append(np.frombuffer(press.decompress(packed.as_py()), kind))
                ids.append(k)
                held += len(tokens[-1])
                if held >= FILE_TOKENS:
                    yield out()
                    held = 0
        if ids:
            yield out()

    # rows with equal or null ids are parted by where they stand, so they need not fit one range
    placed = encoded.where("ids IS NOT NULL").select("doc_id", "ids", F.monotonically_increasing_id().alias("row"))
    ordered = placed.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "ids")
    written = ordered.mapInArrow(run, "file string, first long, docs long, tokens long")
    written = written.withColumn("part", F.spark_partition_id()).withColumn("turn", F.monotonically_increasing_id())
    written.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of each document, decoded from the files."""
    spark = manifest.sparkSession
    before = Window.orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    starts = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    if not manifest.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for name, ids in read_file(raw.as_py()):
                    rows.append((name, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    held += len(ids)
                    if held > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(f"{folder}/files").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(F.broadcast(starts) if manifest.count() <= BROADCAST_ROWS else starts, "file").select("start", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write all documents and read them back: doc_id, start, n_tokens, ids."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, id_col, text_col, path), folder)


def crc32_of(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

