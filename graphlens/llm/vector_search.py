"""Exact top-k search by inner product with KD-trees over shards.

Vectors become integers, floor(64 x) by component. The top levels of the tree split space into cells at
medians of a bounded sample (SAMPLE_ROWS rows; it settles only how even the cells are, and every row is
dealt to its cell by the planes). The rows of a cell are cut into shards of bounded size by a hash. Each
shard gets a tree of its own: median splits of the widest dimension down to small leaves, and tight bounding boxes at
each node. Queries stand in blocks of one cell.

A block searches first one shard of its own cell: best first, by the greatest inner product that a node's
box allows, and a node is opened only for the queries whose kth result its bound can still beat. Then each
block is held against the boxes of all shards (a bounded number of them are broadcast at a time), and goes only
to those whose bound can beat the kth result of one of its queries, with just these queries. Blocks meet
shards by an equi-join on the shard; only what beats a query's kth result is sent on, at most k rows from each shard.

Ties in score go to the smaller id, so a vector that a third of all rows share costs no more
than others: a box whose bound equals the kth score is opened only if it holds a smaller id.
Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id; vectors of different
lengths do not meet; a query's own row is every row with its id. Vectors whose squared length in integers reaches
2**62 are an error, as scores could leave 64 bits. Other columns are not read, so their names cannot clash. Empty
tables give no rows. Blocks and shards are bounded in rows.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import reliable

SHARD_ROWS = 8192
BLOCK_QUERIES = 256
LEAF_ROWS = 128
#: Rows of the sample for the planes between cells, and cells at most.
SAMPLE_ROWS, MOST_CELLS = 20_000, 512
#: Boxes of shards that are broadcast at a time.
BOXES = 10_000
_NO_SCORE = -(1 << 62)
_NO_ID = (1 << 63) - 1


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    x = F.transform(vectors[f"`{vector_col}`"], lambda c: F.floor(c.cast("double") * scale).cast("double"))
    rows = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("vec_id"), vectors[f"`{vector_col}`"].alias("_v"), x.alias("x")).where("_v IS NOT NULL AND vec_id IS NOT NULL")
    rows = rows.where(F.forall("_v", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))))
    long = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c) >= float(1 << 62)
    held = F.when(long, F.raise_error(F.lit("a vector is too long for scores of 64 bits"))).otherwise(F.transform("x", lambda c: c.cast("long")))
    return rows.select("vec_id", held.cast("array<bigint>").alias("x"), F.size("x").alias("dim"))


def _matrix(table) -> np.ndarray:
    column = table["x"].combine_chunks() if isinstance(table, pa.Table) else table["x"]
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def planes(x: np.ndarray, cells: int) -> dict[str, np.ndarray]:
    """A tree of planes in the order of levels: node i splits ``axis[i]`` at ``at[i]`` (below: child 2i + 1, else 2i + 2); axis -1 splits nothing."""
    depth = max(0, (cells - 1).bit_length())
    axis, at = np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64)
    rows = {0: x}
    for i in range(len(axis)):
        points = rows.pop(i, x[:0])
        if len(points) > 1 and points.shape[1]:
            widest = int(np.argmax(points.max(0) - points.min(0)))
            middle = int(np.sort(points[:, widest])[len(points) // 2])
            if middle > points[:, widest].min():
                axis[i], at[i] = widest, middle
                below = points[:, widest] < middle
                rows[2 * i + 1], rows[2 * i + 2] = points[below], points[~below]
    return {"axis": axis, "at": at}


def cell_of(x: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """The cell of each row: the node in which its walk down the planes ends."""
    node = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    while len(live):
        live = live[node[live] < len(tree["axis"])]
        live = live[tree["axis"][node[live]] >= 0]
        at = node[live]
        node[live] = 2 * at + 1 + (x[live, tree["axis"][at]] >= tree["at"][at])
    return node


def build_tree(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Points in the order of the leaves, and the nodes: first and last point, boxes, least ids, children (0: a leaf)."""
    order = np.arange(len(ids))
    first, last, left = [0], [len(ids)], [0]
    for_now = 0
    while for_now < len(first):
        a, b = first[for_now], last[for_now]
        if b - a > leaf:
            points = x[order[a:b]]
            spread = points.max(0) - points.min(0) if points.shape[1] else np.zeros(1)
            if spread.max():
                by = np.argsort(points[:, int(np.argmax(spread))], kind="stable")
                order[a:b] = order[a:b][by]
            middle = (a + b) // 2
            left[for_now] = len(first)
            first += [a, middle]
            last += [middle, b]
            left += [0, 0]
        for_now += 1
    ids, x = ids[order], x[order]
    spans = list(zip(first, last, strict=True))
    box = lambda f: np.stack([f(x[a:b], axis=0) for a, b in spans]) if x.shape[1] else np.empty((len(spans), 0), np.int64)
    return {"ids": ids, "x": x, "first": np.array(first), "last": np.array(last), "left": np.array(left), "low": box(np.min), "high": box(np.max), "least": np.array([ids[a:b].min() for a, b in spans])}


def _exact(*arrays: np.ndarray) -> type:
    """Doubles hold all products and sums of the usual sizes exactly and multiply faster; else 64-bit integers."""
    most = [float(np.abs(a).max(initial=0)) for a in arrays]
    width = max(a.shape[1] for a in arrays)
    return np.float64 if most[0] * max(most[1:]) * max(1, width) < 2**52 else np.int64


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box, a number that no inner product with a point of the box is above (the greatest, where doubles hold it exactly)."""
    q, low, high = (a.astype(np.float64) for a in (q, low, high))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    out = up @ high.T + down @ low.T
    most = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
    return np.where(most < 2.0**52, out, out + most * 2.0**-44)


def search(tree: dict[str, np.ndarray], ids: np.ndarray, q: np.ndarray, scores: np.ndarray, found: np.ndarray) -> int:
    """Improve the k best (scores, found; sorted, best first) of each query by what the tree holds; returns how many leaves were opened."""
    kind = _exact(q, tree["low"], tree["high"])
    x, qs = tree["x"].astype(kind), q.astype(kind)
    k, opened = scores.shape[1], 0

    def live(node: int, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
        kth = scores[rows, -1]
        return (bound > kth) | ((bound == kth) & (tree["least"][node] < found[rows, -1]))

    every = np.arange(len(ids))
    heap: list = []

    def push(node: int, rows: np.ndarray) -> None:
        if len(rows):
            bound = bounds(q[rows], tree["low"][node : node + 1], tree["high"][node : node + 1])[:, 0]
            heapq.heappush(heap, (-float(bound.max()), node, rows, bound))

    push(0, every)
    while heap:
        _, node, rows, bound = heapq.heappop(heap)
        rows = rows[live(node, rows, bound)]  # kth results have risen since it was put there
        if not len(rows):
            continue
        if tree["left"][node]:
            push(int(tree["left"][node]), rows)
            push(int(tree["left"][node]) + 1, rows)
            continue
        opened += 1
        a, b = tree["first"][node], tree["last"][node]
        got = (qs[rows] @ x[a:b].T).astype(np.int64)
        names = np.broadcast_to(tree["ids"][a:b], got.shape)
        got = np.where(names == ids[rows, None], _NO_SCORE, got)
        beat = (got > scores[rows, -1:]) | ((got == scores[rows, -1:]) & (names < found[rows, -1:]))
        hit = np.flatnonzero(beat.any(1))
        if not len(hit):
            continue
        rows, names = rows[hit], np.where(beat[hit], names[hit], _NO_ID)
        all_scores = np.concatenate([scores[rows], np.where(beat[hit], got[hit], _NO_SCORE)], 1)
        all_names = np.concatenate([found[rows], names], 1)
        top = np.lexsort((all_names, -all_scores), axis=1)[:, :k]
        scores[rows], found[rows] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_names, top, 1)
    return opened


def _tree_row(table: pa.Table) -> pa.Table:
    tree = build_tree(table["vec_id"].to_numpy(), _matrix(table))
    box = {c: pa.array([tree[c][0].tolist()], pa.list_(pa.int64())) for c in ("low", "high")}
    return pa.table({"dim": table["dim"][:1], "shard": table["shard"][:1], **box, "least": pa.array([int(tree["least"][0])], pa.int64()), "tree": pa.array([_packed(**tree)], pa.binary())})


def _block_row(table: pa.Table) -> pa.Table:
    block = _packed(ids=table["vec_id"].to_numpy(), x=_matrix(table))
    return pa.table({"dim": table["dim"][:1], "part": table["part"][:1], "block": pa.array([block], pa.binary())})


def _search_home(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b, tree = (_unpacked(batch.column(c)[i].as_py()) for c in ("block", "tree"))
                scores, found = np.full((len(b["ids"]), k), _NO_SCORE), np.full((len(b["ids"]), k), _NO_ID)
                search(tree, b["ids"], b["x"], scores, found)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column("dim"), row.column("part"), row.column("shard"), pa.array([_packed(**b, scores=scores, found=found)], pa.binary())], ["dim", "part", "home", "block"])

    return run


def _rows(ids: np.ndarray, scores: np.ndarray, found: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    at = np.nonzero(new & (found != _NO_ID) & (scores != _NO_SCORE))
    return pa.RecordBatch.from_pydict({"query_id": ids[at[0]].astype(np.int64), "vec_id": found[at], "score": scores[at]})


def _found_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("block"):
            b = _unpacked(raw.as_py())
            yield _rows(b["ids"], b["scores"], b["found"], np.ones(b["scores"].shape, bool))


def _aim(boxes):
    """The blocks of a batch, once for each shard that can beat a kth result, with the queries for which it can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = boxes.value
        for batch in batches:
            for dim, home, raw in zip(*(batch.column(c).to_pylist() for c in ("dim", "home", "block")), strict=True):
                if dim not in of:
                    continue
                shards, low, high, least = of[dim]
                b = _unpacked(raw)
                bound = bounds(b["x"], low, high)
                kth, last = b["scores"][:, -1:], b["found"][:, -1:]
                live = ((bound > kth) | ((bound == kth) & (least[None] < last))) & (shards != home)[None]
                for s in np.flatnonzero(live.any(0)):
                    rows = np.flatnonzero(live[:, s])
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "shard": pa.array([int(shards[s])], pa.int64()), "block": pa.array([_packed(**{c: v[rows] for c, v in b.items()})], pa.binary())})

    return run


def _search_other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, tree in zip(batch.column("block"), batch.column("tree"), strict=True):
            b, t = _unpacked(raw.as_py()), _unpacked(tree.as_py())
            scores, found = b["scores"].copy(), b["found"].copy()
            search(t, b["ids"], b["x"], scores, found)
            new = np.ones(found.shape, bool)
            for i in np.flatnonzero((found != b["found"]).any(1)):
                new[i] = ~np.isin(found[i], b["found"][i])
            new[(found == b["found"]).all(1)] = False
            yield _rows(b["ids"], scores, found, new)


def with_cells(rows: DataFrame, cells: int) -> DataFrame:
    """Rows (vec_id, x, dim) with their cell; planes come from a sample of SAMPLE_ROWS rows at most, by a hash of the id, for all dims together."""
    spark = rows.sparkSession
    sample = rows.select("dim", "x", F.xxhash64("vec_id").alias("_h")).orderBy("_h").limit(SAMPLE_ROWS).drop("_h").toPandas() if cells > 1 else pd.DataFrame({"dim": [], "x": []})
    trees = {int(d): planes(np.stack([np.asarray(v, np.int64) for v in of["x"]]), cells) for d, of in sample.groupby("dim") if d}
    known = spark.sparkContext.broadcast(trees)  # two numbers for each plane

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                if d in known.value:
                    at = np.flatnonzero(dims == d)
                    x = batch.column("x").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                    cell[at] = cell_of(x, known.value[d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], [*batch.schema.names, "cell"])

    return rows.select("vec_id", "x", "dim").mapInArrow(run, "vec_id long, x array<bigint>, dim int, cell long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    rows = scaled(vectors, id_col, vector_col)
    total = rows.count()
    rows = reliable(with_cells(rows, min(MOST_CELLS, -(-total // SHARD_ROWS))))
    sizes = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))  # MOST_CELLS rows for each dim
    sizes = F.broadcast(sizes)
    piece = lambda n, most, *of: F.pmod(F.xxhash64(*of), F.ceil(F.col(n) / most).cast("long"))
    place = lambda part: F.col("cell") * F.lit(1 << 32) + part
    placed = rows.join(sizes, ["dim", "cell"]).withColumn("shard", place(piece("n", SHARD_ROWS, "vec_id", "x")))
    trees = placed.groupBy("dim", "shard").applyInArrow(_tree_row, "dim int, shard long, low array<bigint>, high array<bigint>, least long, tree binary")
    trees = reliable(trees)
    queries = rows.where(F.col("vec_id") % every == 0).join(sizes, ["dim", "cell"]).withColumn("part", place(piece("asked", BLOCK_QUERIES, "vec_id")))
    blocks = queries.select("vec_id", "x", "dim", "part").groupBy("dim", "part").applyInArrow(_block_row, "dim int, part long, block binary")
    # a block begins in one shard of its cell
    there = trees.select("dim", "shard", F.shiftright("shard", 32).alias("cell"), F.row_number().over(Window.partitionBy("dim", F.shiftright("shard", 32)).orderBy("shard")).alias("turn"))
    most = there.groupBy("dim", "cell").agg(F.max("turn").alias("shards"))
    homes = blocks.withColumn("cell", F.shiftright("part", 32)).join(F.broadcast(most), ["dim", "cell"]).withColumn("turn", F.pmod("part", "shards") + 1)
    homes = homes.join(there, ["dim", "cell", "turn"]).select("dim", "part", "block", "shard")
    seen = homes.join(trees.select("dim", "shard", "tree"), ["dim", "shard"]).select("dim", "part", "shard", "block", "tree").mapInArrow(_search_home(k), "dim int, part long, home long, block binary")
    seen = reliable(seen)
    found = seen.mapInArrow(_found_home, "query_id long, vec_id long, score long")
    shapes = trees.select("dim", "shard", "low", "high", "least").withColumn("_turn", F.pmod(F.xxhash64("dim", "shard"), F.lit(max(1, -(-trees.count() // BOXES)))))
    for turn in range(max(1, -(-trees.count() // BOXES))):
        boxes = {}
        for d, of in shapes.where(F.col("_turn") == turn).toPandas().groupby("dim"):  # some BOXES boxes
            boxes[int(d)] = (of["shard"].to_numpy(), *(np.stack([np.asarray(v, np.int64) for v in of[c]]) for c in ("low", "high")), of["least"].to_numpy())
        aimed = seen.mapInArrow(_aim(vectors.sparkSession.sparkContext.broadcast(boxes)), "dim int, shard long, block binary")
        more = aimed.repartition("dim", "shard").join(trees.select("dim", "shard", "tree"), ["dim", "shard"]).select("block", "tree")
        found = found.unionByName(more.mapInArrow(_search_other, "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
