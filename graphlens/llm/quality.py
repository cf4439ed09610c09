"""Quality rules whose cutoffs keep false rejection within a risk (DataFrame functions only).

Each text gives counts (words, characters in words, symbols, repeated lines, words in repeated runs of
three), and these give five scores, whole numbers from 0 to 1000, high where a text looks bad. A rule
rejects what lies above its cutoff. Cutoffs are chosen for each stratum (by default the language), from
labelled rows that pass the base rules, in these steps:

1. labelled rows are split by a digest of their id, a quarter for tuning and the rest as a holdout;
   of a stratum, rule and side only the histogram of the scores is kept (1001 numbers at most);
2. tuning: for each price of a good row in bad ones (64, then 16, then 4) a rule's cutoff is the one that
   gains most, bad rows rejected less price times good ones; a rule that gains nothing stays off.
   Lower prices give stricter cutoffs, so the three vectors of cutoffs are nested;
3. holdout: the vectors are tested from the most lenient on. A test holds if so few good rows are
   rejected by any of the rules that, were the true share ALPHA, the chance of so few or fewer (the exact binomial
   tail) would be at most DELTA / number of strata. The first test that fails ends the stratum's series,
   so that the series itself costs nothing (fixed-sequence testing), and strata share DELTA (Bonferroni);
4. a stratum takes the strictest vector that holds, or none: then no row of it is rejected by a rule.

With probability 1 - DELTA no stratum loses more than ALPHA of its good rows to the rules, provided that labels are
a fair draw of a stratum's rows. Cutoffs are whole numbers of a table with a row for each stratum.

Repeated runs are found by a hash of 33 bits beside the place, sorted in the row; what shares a hash is
compared by its words, so that no collision counts. A row is judged by itself in one task: null and blank
texts have no words and fail the base rules; a text of any length needs some 100 bytes a word. Ids may be null (no label), repeat
(each row is labelled) and tie; of labels that disagree the lowest quality holds, labels that are null are none. A stratum
may be null and hold any share of the rows: only counts by score are shuffled with it, and cutoffs of hot strata
are broadcast. Other columns are not read, so their names cannot clash. Empty tables give an empty result; without labels only the base rules hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, join_hot, reliable

ALPHA, DELTA = 0.05, 0.05
#: What a good row that is rejected costs, in bad rows, from the most lenient to the strictest.
PRICES = (64, 16, 4)
#: A base rule: too few words, or more than half of them in repeated runs.
LEAST_WORDS = 50
SCORES = ("symbols", "repeats", "lines", "long", "short")
_BLANK = " \t\n\x0b\x0c\r"
_SYMBOL = "[#*$%&|<>]"
_PLACE = 31


def _equal_neighbour(rows, key):
    """Those elements of a sorted array whose key is that of the element before or after."""
    return F.filter(rows, lambda x, j: (key(x) == key(F.get(rows, j + 1))) | (key(x) == key(F.get(rows, j - 1))))


def _run(words, i):
    return [words[i], words[i + 1], words[i + 2]]


def text_counts(docs: DataFrame, text_col: str, keep: list) -> DataFrame:
    """The columns ``keep`` and the counts of each row's text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    trimmed = F.btrim("_t", F.lit(_BLANK))
    rows = docs.select(*keep, text.alias("_t"))
    rows = rows.select("*", F.when(trimmed != "", F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "").alias("_l"))
    words, runs = F.col("_w"), F.size("_w") - 2
    hashed = F.zip_with(F.slice(words, 1, runs), F.slice(words, 2, runs), lambda a, b: F.xxhash64(a, b))
    hashed = F.zip_with(hashed, F.slice(words, 3, runs), lambda a, b: F.xxhash64(a, b))
    packed = F.transform(hashed, lambda x, i: F.shiftleft(x, _PLACE).bitwiseOR(i.cast("long")))
    rows = rows.select("*", F.when(runs > 1, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")).alias("_s"))
    mark = lambda x: F.shiftright(x, _PLACE)
    rows = rows.select("*", _equal_neighbour(F.col("_s"), mark).alias("_c"))
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")
    differs = lambda x, y: reduce(lambda a, b: a | b, [words[place(x) + k] != words[place(y) + k] for k in range(3)])
    clash = F.size(F.filter("_c", lambda x, j: (mark(x) == mark(F.get("_c", j + 1))) & differs(x, F.get("_c", j + 1)))) > 0
    rows = rows.select("*", clash.alias("_clash"))
    # where runs that share a hash differ, they are sorted by their words; those hold no blanks, so runs joined by a blank are equal only if their words are
    told = F.sort_array(F.transform("_c", lambda x: F.struct(F.concat_ws(" ", *_run(words, place(x))).alias("run"), place(x).alias("at"))))
    rows = rows.select("*", F.when(F.col("_clash"), told).alias("_r"))
    again = F.when(F.col("_clash"), F.transform(_equal_neighbour(F.col("_r"), lambda x: x["run"]), lambda x: x["at"])).otherwise(F.transform("_c", place))
    rows = rows.select("*", again.alias("_p"))
    covered = F.array_distinct(F.flatten(F.array("_p", F.transform("_p", lambda x: x + 1), F.transform("_p", lambda x: x + 2))))
    return rows.select(
        *[c for c in rows.columns if c not in ("_t", "_w", "_l", "_s", "_c", "_clash", "_r", "_p")],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.when(F.col("_t").rlike(_SYMBOL), F.size(F.split("_t", _SYMBOL)) - 1).otherwise(0).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
    )


def _share(part, whole):
    return F.when(whole > 0, F.floor(1000 * part / whole)).otherwise(0)


def scores() -> dict:
    """By rule: a whole number from 0 to 1000 from the counts. The mean length of words counts in hundredths, up to ten characters."""
    mean = F.least(_share(F.col("word_chars"), F.col("n_words")), F.lit(10_000)) / 10
    return {
        "symbols": _share(F.col("n_symbols"), F.col("word_chars")),
        "repeats": _share(F.col("n_repeat_words"), F.col("n_words")),
        "lines": _share(F.col("n_dup_lines"), F.col("n_lines")),
        "long": F.floor(mean),
        "short": 1000 - F.floor(mean),
    }


def binomial_tail(n, k, share: float):
    """The chance of at most k successes in n trials of ``share``; terms are made one from the other, in logarithms."""
    odds = share / (1 - share)
    start = F.struct((n * F.log1p(F.lit(-share))).alias("term"), F.lit(0.0).alias("total"))
    one = lambda s, i: F.when(i == 0, s["term"]).otherwise(s["term"] + F.log((n - i + 1) / i * odds))
    step = lambda s, i: F.struct(one(s, i).alias("term"), (s["total"] + F.exp(one(s, i))).alias("total"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda s: s["total"])


def _rejects(vector) -> object:
    return reduce(lambda a, b: a | b, [F.col(f"_score.{r}") > F.coalesce(vector[r], F.lit(1000)) for r in SCORES])


def risk_controlled(labelled: DataFrame, prices: tuple[int, ...] = PRICES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, n_good, cutoffs): the cutoffs of each stratum (a struct by rule; 1000 rejects nothing), null where no test held.

    ``labelled``: stratum, tuning (boolean), good (boolean), _score (a struct by rule). It is read twice, so it should be saved.
    """
    each = labelled.where("tuning").select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_score.{r}").cast("int").alias("score")) for r in SCORES])).alias("_e"))
    histogram = each.groupBy("stratum", F.col("_e.rule").alias("rule"), F.col("_e.score").alias("score")).agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    # a cutoff rejects the scores above it, so it is one less than a score that occurs (at most 1001 rows of a stratum and rule)
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    tried = histogram.select("stratum", "rule", (F.col("score") - 1).alias("cutoff"), F.sum("good").over(above).alias("good"), F.sum("bad").over(above).alias("bad"))
    best = [F.max(F.when(F.col("bad") > p * F.col("good"), F.struct((F.col("bad") - p * F.col("good")).alias("gain"), "cutoff")))["cutoff"].alias(f"v{k}") for k, p in enumerate(prices)]
    chosen = tried.groupBy("stratum", "rule").agg(*best)
    vector = lambda k: F.struct(*[F.coalesce(F.max(F.when(F.col("rule") == r, F.col(f"v{k}"))), F.lit(1000)).alias(r) for r in SCORES])
    vectors = reliable(chosen.groupBy("stratum").agg(F.array(*[vector(k) for k in range(len(prices))]).alias("vectors")))

    held = labelled.where("NOT tuning AND good")
    sizes = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    known = reliable(sizes.join(vectors.withColumnRenamed("stratum", "_of"), F.col("stratum").eqNullSafe(F.col("_of")), "left").drop("_of"))
    strata = known.count()  # each could be tested, whatever came of it
    judged = join_hot(held, known, ["stratum"], "_n", held.count())
    lost = [F.count(F.when(_rejects(F.col("vectors")[k]), 1)).alias(f"k{k}") for k in range(len(prices))]
    tests = judged.groupBy("stratum").agg(F.first("_n").alias("n"), F.first("vectors").alias("vectors"), *lost)
    # beyond the mean the chance is near a half at least, so the sum need not be made
    holds = [(F.col(f"k{k}") < F.col("n") * alpha) & (binomial_tail(F.col("n"), F.least(F.col(f"k{k}"), F.ceil(F.col("n") * alpha)), alpha) <= delta / max(1, strata)) for k in range(len(prices))]
    level = F.lit(-1)
    for k in reversed(range(len(prices))):  # the strictest before which none has failed
        level = F.when(reduce(lambda a, b: a & b, holds[: k + 1]) & (level < k), k).otherwise(level)
    tests = tests.withColumn("level", level)
    return tests.select("stratum", F.col("n").alias("n_good"), F.when(F.col("level") >= 0, F.get("vectors", F.col("level"))).alias("cutoffs"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA, prices: tuple[int, ...] = PRICES) -> DataFrame:
    """One row per input row: doc_id, stratum, the counts, base_failed, rejected_by (names of rules, empty if none), kept.

    ``labels``: a column of ids of the same name and quality (1 good, 0 bad).
    """
    counted = text_counts(docs, text_col, [docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{stratum_col}`"].alias("stratum")])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = reliable(counted.select("*", failed.alias("base_failed"), F.struct(*[s.cast("int").alias(r) for r, s in scores().items()]).alias("_score")))

    truth = labels.select(labels[f"`{id_col}`"].alias("_id"), labels["quality"].alias("_quality")).where("_id IS NOT NULL AND _quality IS NOT NULL").groupBy("_id").agg((F.min("_quality") > 0).alias("good"))
    tuning = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1).isin("0", "1", "2", "3")
    labelled = rows.where("NOT base_failed").join(truth, F.col("doc_id") == F.col("_id")).select("stratum", "good", tuning.alias("tuning"), "_score")
    cutoffs = risk_controlled(reliable(labelled), prices, alpha, delta).where("cutoffs IS NOT NULL").select("stratum", "cutoffs")
    times = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    cutoffs = reliable(cutoffs.join(times.withColumnRenamed("stratum", "_of"), F.col("stratum").eqNullSafe(F.col("_of"))).drop("_of"))
    out = join_hot(rows, cutoffs, ["stratum"], "_n", rows.count(), "left")
    by = F.filter(F.array(*[F.when(F.col(f"_score.{r}") > F.col(f"cutoffs.{r}"), F.lit(r)) for r in SCORES]), lambda x: x.isNotNull())
    return out.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", by.alias("rejected_by"), (~F.col("base_failed") & (F.size(by) == 0)).alias("kept"))
