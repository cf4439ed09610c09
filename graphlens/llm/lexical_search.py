"""Ranked lexical search with hashed max-sketches.

A term is a run of ASCII letters and digits and of characters beyond ASCII, its A to Z lower-cased. Scores are sums of weight
times impact (see ``search``). The steps, for a block of queries with a bounded number of terms:

1. fold: one scan of the texts gives for each document its number of terms and a sketch. Each term has one
   of COORDINATES places by a hash, and a place holds the most often that one of its terms occurs. As an impact grows
   with its count, the impact of that count is the coordinatewise maximum of the impacts. Only places in use are stored,
   some three bytes for each different term. The scan counts, too, in how many documents each term of the queries occurs;
2. bounds: over the sketches, a document's bound for a query is the sum of the weights of the query's terms times the
   maximum at each term's place, which is never below its score. All queries of the block are looked up
   together, as a product of matrices of whole numbers below 2^53, so bounds are exact;
3. the first documents by descending bound are scored from their whole texts; the least score that is needed to be among
   the best so far is the query's threshold;
4. every document whose bound reaches the threshold is scored from its whole text; nothing below it can be among the best.

Terms are compared as strings wherever a count or score is made, hashes only choose places. What is scored again is found by id and a
hash of its text; what shares both is scored, too, so that a collision changes nothing. Keys of those documents are broadcast if
counted few, else shuffled. Of each task the best of each query are kept, then of groups of tasks, then of all.

Null and blank texts have no terms: such documents are not counted, such queries have no rows. Each row is a document and each row
of the queries a query, so ids may repeat or be null (a null id stands before others in ties; rows that tie in id and score stand in any order). A text of any
length is one row of one task, which needs some 20 times its bytes. Other columns are not read, so their names cannot clash. Empty tables give an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_bytes, new_folder, reliable

#: A place is kept as two bytes, so that as many as these cost no more than fewer.
COORDINATES = 65_536
#: A count at a place is kept as a byte; this one stands for itself and all above.
FULL = 255
#: Queries are taken so many at a time, or fewer if they have so many terms together.
BLOCK_QUERIES, BLOCK_TERMS = 1000, 20_000
#: Documents whose bounds or scores are computed together.
TOGETHER = 512
#: Documents that are scored for each query in the first turn, for each one that is asked for.
AHEAD = 2
#: The best of tasks are brought together in so many groups before they meet.
GROUPS = 64

# bytes that stand between terms become a blank, A to Z lower case
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = 32
_BYTES[65:91] += 32


def terms_of(text: str | None) -> list[str]:
    return _BYTES[np.frombuffer((text or "").encode(), np.uint8)].tobytes().decode().split(" ")


class Counted:
    """The terms of a run of texts: for each text and different term of it (in the order of texts) the term's code and count; the terms by code."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = _BYTES[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        split = pc.split_pattern(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(raw)), " ")
        coded, places = split.values.dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
        codes, self.terms = coded.indices.to_numpy(), coded.dictionary
        text = np.repeat(np.arange(len(texts)), np.diff(places))
        some = codes != self.terms.index("").as_py()
        self.n = np.bincount(text[some], minlength=len(texts))
        both, self.count = np.unique(text[some] * max(1, len(self.terms)) + codes[some], return_counts=True)
        self.text, self.code = both // max(1, len(self.terms)), both % max(1, len(self.terms))


class Block:
    """Queries with their different terms, and, once these are counted, their weights."""

    def __init__(self, items: list, queries: list[list[str]]):
        self.items = items
        self.vocabulary = sorted({t for q in queries for t in q})
        at = {t: k for k, t in enumerate(self.vocabulary)}
        self.queries = [np.array([at[t] for t in q], np.int64) for q in queries]
        self.places = np.array([place(t) for t in self.vocabulary], np.int64)
        self.known = pa.array(self.vocabulary, pa.large_string())

    def weigh(self, documents: int, terms: int, found: np.ndarray) -> None:
        self.documents, self.total = documents, terms
        self.weights = np.array([floor(1000 * log((2 * documents + 2) / (2 * int(d) + 1))) for d in found], np.int64)
        # of each place in use, its weight in each query
        self.used, of = np.unique(self.places, return_inverse=True)
        self.table = np.zeros((len(self.used), len(self.queries)))
        for k, q in enumerate(self.queries):
            np.add.at(self.table[:, k], of[q], self.weights[q])

    def measure(self, n: np.ndarray) -> np.ndarray:
        """What lessens the impacts in documents with n terms; the product may pass 64 bits, so it is made of Python's numbers."""
        return np.array([50 + 50 * int(x) * self.documents // self.total for x in n], np.int64)


def impact(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * count // (1000 * count + 20 * m)


def place(term: str) -> int:
    return zlib.crc32(term.encode()) % COORDINATES


def _blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    items, held, terms = [], [], 0
    for row in queries.select(queries[f"`{id_col}`"], queries[f"`{text_col}`"]).toLocalIterator():
        some = sorted({*terms_of(row[1])} - {""})
        if items and (len(items) == BLOCK_QUERIES or terms + len(some) > BLOCK_TERMS):
            yield Block(items, held)
            items, held, terms = [], [], 0
        if some:
            items.append(row[0])
            held.append(some)
            terms += len(some)
    if items:
        yield Block(items, held)


def _scan(known: pa.Array, fold: bool):
    """Rows of documents (doc_id, text_hash, n, places, tops), if they are folded, and one for each task with what it counted of the known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(known), np.int64)
        names, kind = ["doc_id", "text_hash", "n", "places", "tops", "found"], None
        for batch in (b for whole in batches for b in by_bytes(whole, 2)):
            kind, c = batch.column(0).type, Counted(batch.column(2))
            at = pc.index_in(c.terms, known)
            code = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            found[at.drop_null().to_numpy().astype(np.int64)] += np.bincount(c.code, minlength=len(c.terms))[code]
            if not fold:
                continue
            spot = np.array([zlib.crc32(t) % COORDINATES for t in c.terms.cast(pa.large_binary()).to_pylist()], np.int64)
            key = np.sort((c.text * COORDINATES + spot[c.code]) << 8 | np.minimum(c.count, FULL)) if len(spot) else np.empty(0, np.int64)
            last = np.append(key[1:] >> 8 != key[:-1] >> 8, True)[: len(key)]
            key = key[last]
            ends = np.searchsorted(key >> 8, np.arange(batch.num_rows + 1) * COORDINATES)
            binary = lambda x, ends=ends: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]).cast(pa.binary())
            spots, tops = ((key >> 8) % COORDINATES).astype("<u2"), (key & FULL).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c.n, pa.int64()), binary(spots), binary(tops), pa.nulls(batch.num_rows, pa.binary())], names)
        if kind is not None:
            at = np.flatnonzero(found)
            seen = np.stack([at, found[at]], 1).astype("<i8").tobytes()
            empty = [pa.nulls(1, t) for t in (kind, pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([seen], pa.binary())], names)

    return run


def _counts(scanned: DataFrame, size: int) -> np.ndarray:
    """In how many documents each known term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                pairs = np.frombuffer(cell.as_py(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"term": pairs[:, 0].astype(np.int32), "n": pairs[:, 1]})

    out = np.zeros(size, np.int64)
    rows = scanned.where("found IS NOT NULL").select("found").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # one for each term of the block at most
        out[r["term"]] = r["n"]
    return out


def _bounds(block: Block, batch: pa.RecordBatch) -> np.ndarray:
    """Bounds of some sketches by queries."""
    sizes = pc.binary_length(batch.column("tops")).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(batch.num_rows), sizes)
    spots = np.frombuffer(b"".join(batch.column("places").to_pylist()), "<u2").astype(np.int64)
    tops = np.frombuffer(b"".join(batch.column("tops").to_pylist()), np.uint8).astype(np.int64)
    at = np.minimum(np.searchsorted(block.used, spots), len(block.used) - 1)
    known = block.used[at] == spots
    text, at, tops = text[known], at[known], tops[known]
    sketch = np.zeros((batch.num_rows, len(block.used)))
    sketch[text, at] = np.where(tops == FULL, 1_000_000, impact(tops, block.measure(batch.column("n").to_numpy())[text]))
    return sketch @ block.table


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(k, TOGETHER)


class Best:
    """For each query the k rows with the greatest values met so far, ties to the least ids (null first)."""

    def __init__(self, k: int):
        self.k, self.tables, self.rows = k, [], 0

    def add(self, table: pa.Table) -> None:
        if len(table):
            self.tables.append(table)
            self.rows += len(table)

    def cut(self) -> pa.Table:
        """The rows that remain, by query and place."""
        held = pa.concat_tables(self.tables).combine_chunks()
        held = held.take(pc.sort_indices(held, [("query", "ascending"), ("value", "descending"), ("doc_id", "ascending")], null_placement="at_start"))
        query = held["query"].to_numpy()
        held = held.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < self.k))
        self.tables, self.rows = [held], len(held)
        return held


def _highest(block, k: int):
    """Of a task's sketches, the k with the greatest bounds for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, best = block.value, Best(k)
        lowest = np.zeros(len(b.queries))  # what a bound must reach to be among the k
        for batch in _slices(batches):
            bounds = _bounds(b, batch)
            text, query = np.nonzero((bounds > 0) & (bounds >= lowest))
            best.add(pa.table({"query": query.astype(np.int32), "value": bounds[text, query].astype(np.int64), "doc_id": batch.column("doc_id").take(pa.array(text)), "text_hash": batch.column("text_hash").take(pa.array(text))}))
            if best.rows > 4 * k * len(b.queries):
                held = best.cut()
                query, value = held["query"].to_numpy(), held["value"].to_numpy()
                last = np.flatnonzero(np.append(query[1:] != query[:-1], True))
                full = np.bincount(query, minlength=len(lowest))[query[last]] == k
                lowest[query[last[full]]] = value[last[full]]
        if best.rows:
            yield from best.cut().to_batches()

    return run


def _reaching(block, least):
    """Of a task's sketches, those whose bound reaches a query's threshold, with these queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, lowest = block.value, np.maximum(least.value, 1)
        for batch in _slices(batches):
            hit = _bounds(b, batch) >= lowest
            text, query = np.nonzero(hit)
            rows = np.flatnonzero(hit.any(1))
            ends = np.searchsorted(text, np.append(rows, batch.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(query, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), batch.column("text_hash").take(pa.array(rows)), lists], ["doc_id", "text_hash", "queries"])

    return run


def _score(block, least, k: int):
    """Scores of whole texts for the queries of each; of a task the k best for each query, none below its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, lowest, best = block.value, np.maximum(least.value, 1), Best(k)
        for batch in (x for whole in batches for y in by_bytes(whole, "text") for x in _slices([y])):
            c = Counted(batch.column("text"))
            at = pc.fill_null(pc.index_in(c.terms, b.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = at[c.code] if len(at) else c.code
            text, term, count = c.text[term >= 0], term[term >= 0], c.count[term >= 0]
            value = np.zeros((batch.num_rows, len(b.vocabulary)), np.int64)
            value[text, term] = b.weights[term] * impact(count, b.measure(c.n)[text])
            asked = batch.column("queries")
            query = asked.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
            order = np.argsort(query, kind="stable")
            query, row = query[order], row[order]
            cuts = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)]).tolist()
            for x, y in zip(cuts, [*cuts[1:], len(query)], strict=True):
                q = int(query[x])
                score = value[row[x:y][:, None], b.queries[q]].sum(1)
                good = score >= lowest[q]
                best.add(pa.table({"query": np.full(int(good.sum()), q, np.int32), "value": score[good], "doc_id": batch.column("doc_id").take(pa.array(row[x:y][good]))}))
            if best.rows > 4 * k * len(b.queries):
                best.cut()
        if best.rows:
            yield from best.cut().to_batches()

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query (query, value, doc_id, ...), numbered; first within groups of tasks, so that none sees all."""
    order = [F.desc("value"), F.asc_nulls_first("doc_id")]
    some = rows.withColumn("_group", F.spark_partition_id() % GROUPS)
    some = some.withColumn("_at", F.row_number().over(Window.partitionBy("query", "_group").orderBy(*order))).where(F.col("_at") <= k).drop("_at", "_group")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each query the k documents with the highest scores above 0, ties to the least id.

    With N documents that have a term, L terms in all, n terms and tf of a term in a document and df documents with it:
    weight = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 50 + 50 n N div L, impact = 10^9 tf div (1000 tf + 20 m).
    """
    spark = docs.sparkSession
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.xxhash64(docs[f"`{doc_text}`"]).alias("text_hash"), docs[f"`{doc_text}`"].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = f"doc_id {kind}, text_hash long, n long, places binary, tops binary, found binary"
    item = queries.schema[query_id].dataType
    schema = f"item_id {item.simpleString()}, rank int, doc_id {kind}, score long"
    folder, out, sketches = new_folder(spark, "search"), [], None
    for at, block in enumerate(_blocks(queries, query_id, query_text)):
        found = rows.mapInArrow(_scan(block.known, sketches is None), scanned)
        if sketches is None:  # the first block's scan folds, too
            found.write.parquet(f"{folder}/sketches")
            found = spark.read.parquet(f"{folder}/sketches")
            sketches = found.where("n > 0").select("doc_id", "text_hash", "n", "places", "tops")
            documents, terms = sketches.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            break
        block.weigh(documents, terms, _counts(found, len(block.vocabulary)))
        shared = spark.sparkContext.broadcast(block)

        def scored(chosen: DataFrame, least: np.ndarray, shared=shared) -> DataFrame:
            few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
            few = few.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
            met = rows.join(few, rows["doc_id"].eqNullSafe(few["_id"]) & (rows["text_hash"] == few["_hash"])).select("doc_id", "text", "queries")
            return _best(met.mapInArrow(_score(shared, spark.sparkContext.broadcast(least), k), f"query int, value long, doc_id {kind}"), k)

        ahead = _best(sketches.mapInArrow(_highest(shared, AHEAD * k), f"query int, value long, doc_id {kind}, text_hash long"), AHEAD * k)
        ahead = reliable(ahead.groupBy("doc_id", "text_hash").agg(F.collect_set("query").alias("queries")))
        least = np.zeros(len(block.queries), np.int64)
        for r in scored(ahead, least).where(F.col("rank") == k).select("query", "value").collect():  # one for each query
            least[r["query"]] = r["value"]
        chosen = sketches.mapInArrow(_reaching(shared, spark.sparkContext.broadcast(least)), f"doc_id {kind}, text_hash long, queries array<int>")
        # rows that share id and hash stand once, for they meet each such row of the table
        chosen = reliable(chosen.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set("queries"))).alias("queries")))
        names = spark.createDataFrame(list(enumerate(block.items)), f"query int, item_id {item.simpleString()}")
        found = scored(chosen, least).join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("value").alias("score"))
        found.write.parquet(f"{folder}/found-{at}")
        out.append(f"{folder}/found-{at}")
    return spark.read.schema(schema).parquet(*out) if out else spark.createDataFrame([], schema)
