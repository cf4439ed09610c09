"""N-gram Jaccard join with Bayesian candidate pruning.

A text is the set of its runs of five words (a text of one to four words: the one run of
all of them; without words: none, and no link). Two texts are linked when the Jaccard
similarity of their sets is at least 0.8. Runs are
compared by hashes of 64 bits under a key that is drawn anew for each call (see substring_dedup), so that nobody can write down texts that collide. The steps:

1. each text gives a 128-bit digest (BLAKE2) of its sorted set and 128 MinHash values in 32 bands of four;
   rows with equal sets are one node from here on, with their number as its weight;
2. nodes that share a band meet in its bucket (a pair at 0.8 shares no band with
   probability 5e-8). There MinHash values, cut to a byte each, are compared 32 at a time, and a pair is dropped when
   the posterior probability that its similarity reaches the threshold falls below 1e-9. A
   bucket is walked like a graph: who stays with a node that was met need not be compared
   with what was met before, so copies cost one comparison each. It gives a forest, never pairs;
3. what the forests connect is a cluster. It is cut into chunks; each pair of chunks is compared in one
   task, eight whole MinHash values at a time with the same pruning, and the similarity
   of the rest is computed from their whole sets;
4. a task returns counts and a spanning forest of the links, one row for each node, never pairs;
   forests of clusters with several chunks are joined by connected components.

Rows with a null id take part like others; ids may repeat; null and blank texts have no words and
no links. Ties in the least id are one class id. A text of any length is one set of 8 bytes a word in two or more tasks.
Other columns are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_bytes, join_hot, reliable, row_key, unused, without
from .components import components
from .substring_dedup import _mix, hashes, new_key

WORDS = 5
THRESHOLD = Fraction(4, 5)
VALUES, BAND = 128, 4
STEP = 8
TOLERANCE = 1e-9
CHUNK = 256
#: Nodes of a bucket that are compared in one task; larger buckets are cut into chunks, each pair of which is a task.
BUCKET = 4096
_RANDOM = np.random.default_rng(7)
_TIMES = _RANDOM.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 2**32, VALUES, dtype=np.uint32)
_ODD = _RANDOM.integers(2**62, 2**63, BAND + 1, dtype=np.uint64) | np.uint64(1)


def least_matches(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 8, 16, ... values compared: the fewest matches with which a pair stays.

    With an even prior, the similarity after m of n matches is Beta(m + 1, n - m + 1), whose tail above t is the chance of at most m successes in n + 1 trials of t.
    """
    t, out = float(threshold), []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def shingles(text: bytes, key: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the set of runs of words."""
    by = hashes(key)
    w = by.words(text)
    return np.unique(by.runs(w, min(words, len(w)))) if len(w) else np.empty(0, np.uint64)


def _digest(s: np.ndarray) -> bytes:
    """A digest of a sorted set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _minhash(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(best, (x[k : k + 1024, None] * _TIMES + _PLUS).min(0), out=best)
    return best


def _bands(values: np.ndarray) -> np.ndarray:
    rows = values.astype(np.uint64).reshape(-1, BAND)
    return _mix((rows * _ODD[1:]).sum(1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64) * _ODD[0]).view(np.int64)


def _text(cell) -> bytes:
    return (cell.as_py() or "").encode()


def _sign(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_bytes(whole, 2)):
            nodes, bands, marks = [], [], []
            for cell in batch.column(2):
                s = shingles(_text(cell), key)
                values = _minhash(s) if len(s) else None
                nodes.append(_digest(s) if len(s) else None)
                bands.append(_bands(values) if len(s) else [])
                marks.append((values & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())], ["doc_id", "text_hash", "node", "bands", "marks"])

    return run


def forest(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of rows whose marks (bytes of MinHash values) do not rule out a link.

    A byte is equal if its value is, so that no pair is dropped which whole values would keep.
    """
    least = least_matches()
    cuts = [(k, least[(k + 32) // STEP - 1]) for k in range(0, VALUES, 32)]
    rest, a, b = np.arange(len(marks)), [], []
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near, match = np.arange(len(rest)), np.zeros(len(rest), np.int64)
            for k, need in cuts:
                match = match + (marks[rest[near], k : k + 32] == marks[at, k : k + 32]).sum(1)
                stay = match >= need
                near, match = near[stay], match[stay]
            if len(near):
                hit = rest[near]
                a += [at] * len(hit)
                b += hit.tolist()
                todo += hit.tolist()
                rest = np.delete(rest, near)
    return np.array(a, np.int64), np.array(b, np.int64)


def _pairs_of_two(marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of buckets with two rows (first, first + 1): those that may be linked."""
    least = least_matches()
    match = (marks[first] == marks[first + 1]).sum(1) if len(first) else np.empty(0, np.int64)
    return first[match >= least[-1]]


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests (a, b) of the buckets (band, i, j) of rows sorted by them; a bucket may go on in the next batch."""
    held: list[pa.Table] = []

    def tie(table: pa.Table) -> pa.RecordBatch:
        band, i, j = (table[c].to_numpy() for c in ("band", "i", "j"))
        node = table["node"].combine_chunks()
        marks = np.frombuffer(b"".join(table["marks"].to_pylist()), np.uint8).reshape(-1, VALUES)
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(band)))
        two = _pairs_of_two(marks, starts[sizes == 2])
        a, b = [two], [two + 1]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            x, y = forest(marks[at : at + n])
            a.append(x + at)
            b.append(y + at)
        return pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate(x))) for x in (a, b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = lambda t, k: tuple(t[c][k].as_py() for c in ("band", "i", "j"))
        table = pa.Table.from_batches([batch])
        if held and key(held[-1], 0) == key(table, len(table) - 1):
            held.append(table)
            continue
        n, last = len(table), key(table, len(table) - 1)
        same = np.logical_and.reduce([table[c].to_numpy() == v for c, v in zip(("band", "i", "j"), last, strict=True)])
        cut = n - int(same.sum())  # rows are sorted, so the last bucket is a tail
        done = pa.concat_tables([*held, table.slice(0, cut)])
        if len(done):
            yield tie(done)
        held = [table.slice(cut)]
    if held:
        yield tie(pa.concat_tables(held))


def _members(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_bytes(whole, "text")):
            out: dict[str, list] = {"set": [], "values": []}
            for cell, node in zip(batch.column("text"), batch.column("node"), strict=True):
                s = shingles(_text(cell), key)
                same = len(s) > 0 and _digest(s) == node.as_py()
                out["set"].append(s.tobytes() if same else None)
                out["values"].append(_minhash(s).tobytes() if same else None)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out["set"], pa.binary()), pa.array(out["values"], pa.binary())], [*kept, "set", "values"])

    return run


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = count[at] > 1
    column = np.cumsum(count > 1) - 1
    owner, at = owner[again], column[at[again]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    width = 4096
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        x, y = np.searchsorted(at, [start, start + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[x:y], at[x:y] - start] = 1
        total += (held @ held.T).astype(np.int64)
    return total[a, b]


def links(sets: list[np.ndarray], values: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: Fraction = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b), those whose similarity reaches the threshold."""
    match = np.zeros(len(a), np.int16)
    for k, least in enumerate(least_matches(threshold)):
        part = values[:, k * STEP : (k + 1) * STEP]
        match += (part[a] == part[b]).sum(1, dtype=np.int16)
        stay = match >= least
        a, b, match = a[stay], b[stay], match[stay]
    if not len(a):
        return a, b
    size = np.array([len(s) for s in sets])
    both = _common(sets, a, b)
    near = threshold.denominator * both >= threshold.numerator * (size[a] + size[b] - both)
    return a[near], b[near]


def _compare(table: pa.Table) -> pa.Table:
    first, other = table["i"][0].as_py(), table["j"][0].as_py()
    order = np.argsort(np.array([n.as_py() for n in table["node"]], object), kind="stable")
    table = table.take(pa.array(order))
    nodes = [n.as_py() for n in table["node"]]
    once = [k for k in range(len(nodes)) if k == 0 or nodes[k] != nodes[k - 1]]  # a row may stand twice in the input
    table = table.take(pa.array(once))
    nodes, weight, chunk = [nodes[k] for k in once], table["weight"].to_numpy(), table["chunk"].to_numpy()
    sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["set"]]
    values = np.stack([np.frombuffer(v.as_py(), np.uint32) for v in table["values"]])
    if first == other:
        a, b = np.triu_indices(len(nodes), 1)
    else:
        left, right = np.flatnonzero(chunk == first), np.flatnonzero(chunk == other)
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    a, b = links(sets, values, a, b)
    count = np.zeros(len(nodes), np.int64)
    np.add.at(count, a, weight[b])
    np.add.at(count, b, weight[a])
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pa.table({"chunks": table["chunks"], "node": table["node"], "links": count, "root": pa.array([nodes[r] for r in root], pa.binary())})


def candidates(signed: DataFrame) -> DataFrame:
    """(a, b): a forest of nodes that share a band and that their MinHash values do not rule out as linked."""
    nodes = reliable(signed.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("marks", "bands")).alias("_of")).select("node", "_of.marks", "_of.bands"))
    held = nodes.select("node", F.explode("bands").alias("band"))  # once for each node, however many rows share a text
    shared = held.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("band")
    company = reliable(held.join(shared, "band", "left_semi").select("band", "node").distinct())
    rows = company.join(nodes.select("node", "marks"), "node")
    large = reliable(company.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BUCKET).select("band", F.ceil(F.col("size") / BUCKET).cast("int").alias("chunks")))
    rows = rows.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "band", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("band", F.least("chunk", "_to").alias("i"), F.greatest("chunk", "_to").alias("j"), "node", "marks")
    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")
    return dealt.mapInArrow(_tie, "a binary, b binary")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, class_size.

    ``n_links`` is the number of other rows whose similarity is 0.8 or more, copies
    counted one by one; ``class_id`` is the least id of the rows that links connect.
    """
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.xxhash64(docs[f"`{text_col}`"]).alias("text_hash"), docs[f"`{text_col}`"].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    key = new_key()
    signed = reliable(rows.mapInArrow(_sign(key), f"doc_id {kind}, text_hash long, node binary, bands array<bigint>, marks binary"))
    per = signed.where("node IS NOT NULL").groupBy("node", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("again"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "again"))  # the row that stands for a node
    nodes = per.groupBy("node").agg(first.alias("first"), F.sum("again").alias("weight"))

    clusters = reliable(components(candidates(signed)).withColumnRenamed("root", "cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    count = clusters.count()
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    chosen = join_hot(clusters, sizes, ["cluster"], "size", count).join(nodes, "node")
    chosen = reliable(chosen.select("node", "cluster", "first", "weight", chunks.alias("chunks"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk")))
    few = chosen.select("node", "cluster", "weight", "chunks", "chunk", F.col("first.again").alias("again"), F.col("first.doc_id").alias("_first"), F.col("first.text_hash").alias("_hash"))
    few = F.broadcast(few) if count <= BROADCAST_ROWS else few
    # the row is met by its id and the hash of its text; of rows that share both, one is taken
    found = rows.join(few, rows["doc_id"].eqNullSafe(few["_first"]) & (rows["text_hash"] == few["_hash"]))
    found = found.select("text", "node", "cluster", "weight", "chunks", "chunk", "again")
    if chosen.where("first.again > 1").limit(1).count():
        found = found.where("again = 1").unionByName(found.where("again > 1").dropDuplicates(["node"]))
    found = found.drop("again").mapInArrow(_members(key), "node binary, cluster binary, weight long, chunks int, chunk int, set binary, values binary").where("set IS NOT NULL")
    dealt = found.withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("node", "cluster", "weight", "chunks", "chunk", "set", "values", F.least("chunk", "_to").alias("i"), F.greatest("chunk", "_to").alias("j"))
    compared = reliable(dealt.groupBy("cluster", "i", "j").applyInArrow(_compare, "chunks int, node binary, links long, root binary"))

    linked = compared.groupBy("node").agg(F.sum("links").alias("links"))
    whole = compared.where("chunks = 1").select("node", "root")
    parts = compared.where("chunks > 1 AND node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if parts.limit(1).count():
        whole = whole.unionByName(components(parts))
    known = nodes.select("node", F.col("first.doc_id").alias("first"), "weight").join(linked, "node", "left").join(whole, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = reliable(known.select("node", "first", "weight", F.coalesce("links", F.lit(0)).alias("links"), "root"))
    classes = known.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("weight").alias("class_size"), F.count(F.lit(1)).alias("_n"))
    total = signed.count()
    known = join_hot(known, classes, ["root"], "_n", total)
    known = known.select("node", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), "class_size", F.col("weight").alias("_n"))
    return join_hot(signed.select("doc_id", "node"), reliable(known), ["node"], "_n", total, "left").select(
        "doc_id",
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of ``docs``: the one with the smallest id (null last, ties by a digest of the row); rows without words all stay.

    Each row is judged by itself, so ids may repeat or be null; columns of any name may stand beside.
    """
    key, name = unused(docs, "_key"), unused(docs, "_id")
    marked = docs.withColumn(key, row_key(docs))
    named = marked.withColumn(name, F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(key).alias("key")))
    verdicts = reliable(jaccard_join(named, name, text_col))
    leads = F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone = verdicts.where(~leads).select(F.col("doc_id.key").alias(key)).distinct()
    again = verdicts.where(leads & (F.col("class_size") > 1)).groupBy(F.col("doc_id.key").alias(key)).count().where("count > 1").select(key)
    again = reliable(again)  # leaders that stand several times, the same in all columns
    kept = without(marked, gone, [key])
    if again.limit(1).count():
        kept = without(kept, again, [key]).unionByName(without(kept, again, [key], "left_semi").dropDuplicates([key]))
    return kept.select(*[f"`{c}`" for c in docs.columns])
