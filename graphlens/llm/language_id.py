"""Language identification by Bayesian evidence fusion.

The evidence of a page is its text, the language its markup declares, the suffix of
its address, and its host. Text likelihoods come from byte trigrams (a table per
label, fitted on a bounded sample of labelled documents: SAMPLE_DOCS for each language,
SAMPLE_CHARS of each; whole texts are scored). The likelihood of a declared language
or suffix given the true language is estimated from all rows, by grouped sums of what the
texts say; so is the prior of a host, smoothed towards its domain and that towards all
rows, with a row's own share taken out. Sums are combined before each shuffle, so a host
with a third of all rows is a few partial rows.

Before that, the text alone is held against a background that makes all trigrams alike: what no
language explains better (an unknown language, noise, few letters that stand alone, null) is rejected
with language ``und``, whatever its label says, and adds nothing to the sums. So do sampled documents that the
rest of their label's sample does not explain; they are left out of the models.

The posterior is the normalised product. A row is accepted if its text is known and the best
posterior reaches ACCEPT; of equal posteriors the language first by name is said. Missing markup, suffix or
host is evidence of nothing. Ids may repeat or be null: each row gives a row. Texts of any length are scored
whole, in time linear in their length. Other columns are not read, so their names cannot clash. An empty table
gives no rows; without labels all is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, by_bytes, join_hot, reliable
from .markup import declared as declared_language
from .markup import html_text

SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 16
#: A text weighs as this many independent trigrams at most.
EVIDENCE = 40.0
SMOOTH = 0.5
#: Log likelihood of a trigram under the background.
BACKGROUND = -float(np.log(BUCKETS))
UNSEEN = 0.01
HOST_WEIGHT = 5.0
ACCEPT = 0.5

def _letters() -> np.ndarray:
    ok = np.zeros(256, bool)
    ok[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
    return ok


_LETTER = _letters()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the byte trigrams that lie within words or at their edges."""
    raw = np.frombuffer(b" " + text.encode() + b" ", np.uint8)
    ok = _LETTER[raw]
    b = np.where(ok, _LOWER[raw], 32).astype(np.uint32)
    code = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) if len(b) > 2 else b[:0]
    return ((code * np.uint32(2654435761)) >> np.uint32(16))[ok[1:-1]]


_WORD = re.compile(r"[^\W\d_]{2}")


def worded(text: str) -> bool:
    """Whether two letters stand together, or letters that stand alone are half of what is not blank."""
    return bool(_WORD.search(text)) or 2 * sum(c.isalpha() for c in text) >= sum(not c.isspace() for c in text)


class Model:
    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def score(self, text: str) -> tuple[list[float], int, bool]:
        """Tempered log likelihoods of a whole text, its trigrams, and whether a language explains it better than the background."""
        t = trigrams(text)
        if not len(t):
            return [0.0] * len(self.languages), 0, False
        total = np.zeros(len(self.languages))
        for k in range(0, len(t), 1 << 16):
            total += self.table[t[k : k + (1 << 16)]].sum(0, dtype=np.float64)
        known = bool(total.max() > BACKGROUND * len(t)) and worded(text)
        total *= min(1.0, EVIDENCE / len(t))
        return (total - total.max()).tolist(), len(t), known


def fit(texts: list[str]) -> np.ndarray:
    """Counts of the trigrams of texts, without those texts that the others explain worse than the background does."""
    found = [t for t in map(trigrams, texts) if len(t)]
    counts = np.zeros(BUCKETS)
    for t in found:
        np.add.at(counts, t, 1)
    whole, out = counts + UNSEEN, counts.copy()
    total = whole.sum()
    for t in found:
        of, n = np.unique(t, return_counts=True)
        if len(found) > 1 and (n * np.log((whole[of] - n) / (total - len(t)))).sum() <= BACKGROUND * len(t):
            out[of] -= n
    return out if out.any() else counts


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_DOCS) -> Model:
    """Fit on a seeded sample of at most ``per_language`` different texts for each label."""
    text = F.substring(text_col, 1, SAMPLE_CHARS)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), text.alias("t"))
    hashed = rows.select("lang", F.xxhash64("t").alias("h"))
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))  # cut in each partition before the shuffle
    chosen = reliable(hashed.withColumn("_k", rank).where(F.col("_k") <= per_language).select("lang", "h").distinct())
    sample = rows.withColumn("h", F.xxhash64("t")).join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])

    def counted(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        return pa.table({"lang": table["lang"][:1], "counts": pa.array([fit(table["t"].to_pylist()).astype(np.float32).tobytes()], pa.binary())})

    found = sample.groupBy("lang").applyInArrow(counted, "lang string, counts binary").collect()  # one table of BUCKETS numbers for each label
    found = sorted(found, key=lambda r: r["lang"])
    if not found:
        return Model(["und"], np.full((BUCKETS, 1), BACKGROUND, np.float32))
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in found], 1).astype(float) + UNSEEN
    return Model([r["lang"] for r in found], np.log(counts / counts.sum(0)).astype(np.float32))


def evidence(rows: DataFrame, model: Model, ids: list[str], markup: bool = False) -> DataFrame:
    """Score the column ``text`` (HTML if ``markup``) of rows that also hold declared, suffix, host and domain."""
    known = rows.sparkSession.sparkContext.broadcast(model)  # a table of BUCKETS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in (b for whole in batches for b in by_bytes(whole, "text")):
            got = [m.score(html_text(t.as_py() or "") if markup else t.as_py() or "") for t in batch.column("text")]
            logs = np.array([g[0] for g in got], float).reshape(len(got), -1)
            sure = np.array([g[2] for g in got], bool)
            says = np.where(sure[:, None], _normal(logs), 1.0 / logs.shape[1])
            kept = [c for c in batch.schema.names if c != "text"]
            new = [_lists(logs), _lists(says), pa.array([g[1] for g in got], pa.int64()), pa.array(sure)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], [*kept, "loglik", "says", "n_trigrams", "known"])

    rows = rows.select(*ids, "declared", "suffix", "host", "domain", "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{schema}, loglik array<double>, says array<double>, n_trigrams long, known boolean")


def _normal(logs: np.ndarray) -> np.ndarray:
    """Probabilities of rows of logarithms."""
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _rows_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a column of lists of n numbers, zeros for null, and which are there."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), n))
    out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out, there


def posteriors(loglik: np.ndarray, says: np.ndarray, known: np.ndarray, sums: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The posterior of each language (column) for each row.

    ``sums`` has, for all, declared, suffix, domain and host, what the texts of all rows with the same value say, and whether the
    row has a value for which any text says something. A row's own share is taken out of each.
    """
    n = loglik.shape[1]
    own = says * known[:, None]
    of = {k: np.maximum(s - own * there[:, None], 0.0) for k, (s, there) in sums.items()}
    total = {k: s.sum(1, keepdims=True) for k, s in of.items()}
    prior = (of["all"] + 1.0) / (total["all"] + n)
    for key in ("domain", "host"):
        prior = (of[key] + HOST_WEIGHT * prior) / (total[key] + HOST_WEIGHT)
    logs = np.log(prior) + loglik
    for key in ("declared", "suffix"):
        logs += np.where(sums[key][1][:, None], np.log((of[key] + SMOOTH) / (of["all"] + SMOOTH * 20)), 0.0)
    return _normal(logs)


def fuse(scored: DataFrame, languages: list[str], ids: list[str]) -> DataFrame:
    """ids, lang, confidence, text_lang, declared, suffix, host, accepted of scored rows."""
    n = len(languages)
    scored = reliable(scored)
    total = scored.count()
    vote = [F.sum(F.when(F.col("known"), F.get("says", F.lit(k))).otherwise(0.0)) for k in range(n)]
    out = scored.crossJoin(F.broadcast(scored.agg(F.array(*[F.coalesce(v, F.lit(0.0)) for v in vote]).alias("_all"))))  # one row
    for key in ("declared", "suffix", "domain", "host"):
        sums = scored.where(F.col(key).isNotNull()).groupBy(key).agg(F.when(F.bool_or("known"), F.array(*vote)).alias(f"_{key}"), F.count(F.lit(1)).alias("_times"))
        sums = reliable(sums)
        if sums.count() <= BROADCAST_ROWS:
            out = out.join(F.broadcast(sums.drop("_times")), key, "left")
        else:
            out = join_hot(reliable(out), sums, [key], "_times", total, "left").drop("_times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(languages, object)
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False)
            loglik, says = (_rows_of(batch.column(c), n)[0] for c in ("loglik", "says"))
            p = posteriors(loglik, says, known, {k: _rows_of(batch.column(f"_{k}"), n) for k in ("all", "declared", "suffix", "domain", "host")})
            best = p.max(1)
            said = lambda x: pa.array(np.where(known, names[x.argmax(1)], "und").tolist(), pa.string())
            cols = [*[batch.column(c) for c in ids], said(p), pa.array(np.where(known, best, 0.0)), said(says), *[batch.column(c) for c in ("declared", "suffix", "host")], pa.array(known & (best >= ACCEPT))]
            yield pa.RecordBatch.from_arrays(cols, [*ids, "lang", "confidence", "text_lang", "declared", "suffix", "host", "accepted"])

    schema = ", ".join(f"`{c}` {scored.schema[c].dataType.simpleString()}" for c in ids)
    out = out.select(*ids, "declared", "suffix", "host", "loglik", "says", "known", "_all", "_declared", "_suffix", "_domain", "_host")
    return out.mapInArrow(run, f"{schema}, lang string, confidence double, text_lang string, declared string, suffix string, host string, accepted boolean")


def page_columns(pages: DataFrame) -> DataFrame:
    """page_id, text (the HTML), declared, suffix, host, domain of a table (page_id, url, html)."""
    some = lambda c: F.when(c != "", c)
    host = some(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)))

    @F.pandas_udf("string")
    def found(page: pd.Series) -> pd.Series:  # by a scanner: a pattern takes quadratic time over comments that are not closed
        return page.map(lambda x: declared_language(x or "")[:3].partition("-")[0])

    declared = some(F.when(F.length(found("html")) >= 2, found("html")))
    return pages.select(
        F.col("page_id"), F.col("html").alias("text"), declared.alias("declared"), host.alias("host"), some(F.regexp_extract(host, r"\.([a-z]{2,24})$", 1)).alias("suffix"), some(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain")
    )


def document_columns(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The same of a table (doc_id, text, lang, source): the label is what is declared, the source is the host."""
    none = F.lit(None).cast("string")
    return docs.select(id_col, "text", F.lower("lang").alias("declared"), none.alias("suffix"), F.concat(F.lit("source:"), F.col("source")).alias("host"), none.alias("domain"))


def identify_documents(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    return fuse(evidence(document_columns(docs, id_col), model, [id_col]), model.languages, [id_col])


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    return fuse(evidence(page_columns(pages), model, ["page_id"], markup=True), model.languages, ["page_id"])
