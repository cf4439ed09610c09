"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code point order (null last) weigh 3, 1, 2, repeating. They share 150 % of all
words by weight; no target may pass twice its source's size, and what is above is shared
again by weight among the rest. A source takes each document once for every whole time its
size fits its target; the budget that remains is fitted by counts of exact lengths:
a proportional number of documents of each length first, and bounded-knapsack dynamic
programming for what is then left. Which documents of a length are taken is settled by
a seeded hash of the id, so reruns agree.

The plan of a source works on its histogram of lengths, never on its documents.
The documents of one (source, length) are ranked in slices of the hash, the more the larger the group, whose offsets
come from counts, so that no group is ranked in one task. Sources are ordered in ranges, so there may be many.
Null and blank texts have no words; documents without words are never taken. Rows with equal or null ids are
told apart by row. A text of any length is one count; the plan of a source needs memory for four times its longest.
Other columns are not read, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, join_hot, reliable, with_running

SEED = 42
#: Documents of a group are ranked in up to 2 ** MOST_SLICES slices of some SLICE_ROWS rows.
SLICE_ROWS, MOST_SLICES = 1024, 16
#: Bytes of reachability kept at once (for each level) while a plan is traced back; what is not kept is computed again.
TRACE_BYTES = 64_000_000


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take, so that the words come near to the budget."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or total <= 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    take = [max(0, c * budget // total - 1) for c in counts]  # one less, which leaves the search some room
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    # one more of the lengths whose share was cut most, largest first, while they fit
    longest = 4 * max(lengths)
    for _, i in sorted((-(c * budget % total), i) for i, c in enumerate(counts)):
        if left <= longest:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= lengths[i]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if left > longest and lengths[i]:
            more = min(counts[i] - take[i], (left - longest) // lengths[i])
            take[i] += max(0, more)
            left -= max(0, more) * lengths[i]
    # bounded knapsack: bit b of ``reach`` says that b more words can be made; counts are cut into powers of two
    spare = [c - t if n else 0 for n, c, t in zip(lengths, counts, take, strict=True)]
    limit = left + min(left, max((n for n, c in zip(lengths, spare, strict=True) if c > 0), default=0))  # what lies above may be nearer
    mask, reach, steps = (1 << (limit + 1)) - 1, 1, []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        part = 1
        while spare[i] > 0 and lengths[i] * part <= limit:
            part = min(part, spare[i])
            grown = (reach | reach << lengths[i] * part) & mask
            if grown != reach:
                steps.append((i, part))
                reach = grown
            spare[i] -= part
            part *= 2
        if reach >> left & 1:
            break
    at = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> left
    over = (above & -above).bit_length() - 1  # -1 if nothing above is reached
    if 0 <= over < left - at:
        at = left + over
    for i, part in _trace([(i, part, lengths[i] * part) for i, part in steps], 1, at, mask):
        take[i] += part
    return take


def _trace(steps: list[tuple[int, int, int]], start: int, at: int, mask: int) -> list[tuple[int, int]]:
    """The steps (length's number, count, words) that make ``at``; ``start`` is what was reachable before them.

    At most TRACE_BYTES of bitsets are kept for each level; longer lists are cut into runs that are computed again.
    """
    keep = max(2, TRACE_BYTES // (mask.bit_length() // 8 + 1))
    run = -(-len(steps) // keep)
    if run == 0:
        return []
    marks, reach = [], start
    for k, (_, _, words) in enumerate(steps):
        if k % run == 0:
            marks.append((k, reach))
        reach = (reach | reach << words) & mask
    used = []
    for k, before in reversed(marks):
        if run == 1:
            i, part, words = steps[k]
            took = [] if before >> at & 1 else [(i, part)]
        else:
            took = _trace(steps[k : k + run], before, at, mask)
        used += took
        of = {(i, part): words for i, part, words in steps[k : k + run]}
        at = at - sum(of[t] for t in took)
    return used


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")  # rows come in any order, and ties in the fit go by place
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    whole = min(2, int(target // size)) if size else 0
    extra = fit_budget(pdf["size"].astype(int).tolist(), pdf["n"].astype(int).tolist(), round(target - whole * size) if whole < 2 else 0)
    return pdf[["source", "size", "n", "source_size", "target"]].assign(whole=whole, extra=extra)


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple = (3, 1, 2), most: int = 2) -> DataFrame:
    """source, source_size, target of a table (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = with_running(per, [F.col("source").asc_nulls_last()], {"source_size": "_sizes"}, "_at")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    # a source is cut to its cap if, once all with a lower cap for their weight are cut, its part of the rest is above its own
    per = with_running(per, [F.col("_ratio"), F.col("source").asc_nulls_last()], {"_cap": "_caps", "_w": "_ws"}, "_turn")
    per = per.withColumn("_level", (F.col("_sizes_total") * F.lit(share) - F.col("_caps")) / (F.col("_ws_total") - F.col("_ws")))
    per = reliable(per.withColumn("_above", F.col("_w") * F.col("_level") > F.col("_cap")))
    level = per.where(~F.col("_above")).agg(F.min_by("_level", "_turn").alias("_level"))  # one row
    return per.drop("_level").crossJoin(F.broadcast(level)).select(
        "source", "source_size", F.when(F.col("_above"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_level")).alias("target")
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, times: the words and the times that the mix takes of each row."""
    words = F.regexp_count(F.coalesce(docs[f"`{text_col}`"], F.lit("")), F.lit(WORD)).cast("long")
    order = F.xxhash64(F.lit(seed), docs[f"`{id_col}`"])
    rows = reliable(docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{source_col}`"].alias("source"), words.alias("size"), order.alias("_h"), F.monotonically_increasing_id().alias("_row")))
    targets = reliable(source_targets(rows.select("source", "size")))
    lengths = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    same = lengths["source"].eqNullSafe(targets["source"])
    plan = lengths.join(targets, same).select(lengths["source"], "size", "n", "source_size", "target")
    plan = reliable(plan.groupBy("source").applyInPandas(_plan, "source string, size long, n long, source_size long, target double, whole int, extra long"))

    planned = join_hot(rows, plan, ["source", "size"], "n", rows.count())
    level = F.least(F.lit(MOST_SLICES), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / SLICE_ROWS)).cast("int")))
    open_rows = planned.where("extra > 0").withColumn("_level", level)
    open_rows = reliable(open_rows.withColumn("_slice", F.when(F.col("_level") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(_h, 64 - _level)"))))
    counts = open_rows.groupBy("source", "size", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # 2 ** MOST_SLICES rows at most
    offsets = counts.select("source", "size", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.col("_n").alias("_of_slice"))
    ranked = join_hot(open_rows, offsets, ["source", "size", "_slice"], "_of_slice", open_rows.count())
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("source", "size", "_slice").orderBy("_h", "doc_id", "_row"))
    ranked = ranked.withColumn("times", F.col("whole") + F.when(rank <= F.col("extra"), 1).otherwise(0))
    shared = ["doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times"]
    return ranked.select(*shared).unionByName(planned.where("extra <= 0").withColumn("times", F.col("whole")).select(*shared))
