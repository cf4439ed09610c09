"""Quality rules against plain Python: counts of each text, cutoffs from labels, verdicts."""

import hashlib
import re
from collections import Counter, defaultdict
from math import comb, floor

import numpy as np
import pytest
from graphlens.llm import quality
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = quality.SCORES


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def scores(c):
    n, chars, symbols, lines, dup, repeat = c
    share = lambda a, b: 1000 * a // b if b else 0
    mean = floor(min(share(chars, n), 10_000) / 10)
    return share(symbols, chars), share(repeat, n), share(dup, lines), mean, 1000 - mean


def failed(c):
    return c[0] < 50 or 100 * c[5] > 50 * c[0]


def cutoffs(rows, prices=quality.PRICES, alpha=quality.ALPHA, delta=quality.DELTA):
    """rows: stratum, tuning, good, scores; by stratum the vector that holds, or None."""
    strata = {s for s, tuning, good, _ in rows if not tuning and good}
    out = {}
    for s in strata:
        tune = [(good, x) for t, tuning, good, x in rows if t == s and tuning]
        hold = [x for t, tuning, good, x in rows if t == s and not tuning and good]
        taken = None
        for price in prices:
            vector = []
            for r in range(len(RULES)):
                gains = [(sum(1 if not good else -price for good, y in tune if y[r] > c), c) for c in {x[r] - 1 for _, x in tune}]
                gain, cut = max(gains, default=(0, 1000))
                vector.append(cut if gain > 0 else 1000)
            k = sum(any(x[r] > vector[r] for r in range(len(RULES))) for x in hold)
            if sum(comb(len(hold), i) * alpha**i * (1 - alpha) ** (len(hold) - i) for i in range(k + 1)) > delta / len(strata):
                break
            taken = vector
        out[s] = taken
    return out


def tuned(i):
    return hashlib.md5(str(i).encode()).hexdigest()[0] in "0123"


def verdicts(rows, labels):
    truth = {}
    for i, q in labels:
        if i is not None and q is not None:
            truth[i] = min(q, truth.get(i, q))
    known = [(s, tuned(i), truth[i] > 0, scores(counts(t))) for i, t, s in rows if i in truth and not failed(counts(t))]
    cut = cutoffs(known)
    out = []
    for i, t, s in rows:
        c = counts(t)
        by = [r for r, x, y in zip(RULES, scores(c), cut.get(s) or [1000] * 5, strict=True) if x > y]
        out.append((i, *c, failed(c), by, not failed(c) and not by))
    return out, cut


def result(docs, labels):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.base_failed, list(r.rejected_by), r.kept) for r in quality.quality_rules(docs, labels).collect()]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    plain = ["tree", "of", "a", "river", "stone", "éclair", "water", "hill", "x", "long", "winter", "snow", "field", "grass", "bird", "cloud"]
    out = []
    for k in range(700):
        w = [f"{a}{b}" for a, b in zip(rng.choice(plain, 90), rng.choice(plain, 90), strict=True)]
        bad = k % 5 == 0
        if bad:
            w = [x + "##" if k % 2 else x for x in w]
        text = " ".join(w[:45]) + "\n" + " ".join(w[45:]) + ("\n" + " ".join(w[:20]) + "\n" + " ".join(w[:20]) if bad and k % 3 == 0 else "")
        out.append((k, text, [None, "en", "en", "fr"][k % 4] if k < 650 else "rare", 0 if bad else 1))
    odd = [(None, "a b", "en"), (9001, None, "en"), (9002, " \t\n ", None), (9003, "a b a b a b a", "en"), (1, out[1][1], "en"), (9004, "x y z\n" * 40, "new"), (9005, "l " * 60 + "\r\nl\r\nl", "en")]
    return [r[:3] for r in out] + odd, [(r[0], r[3]) for r in out if r[0] % 7] + [(2, 0), (2, None), (None, 1), (99_999, 1)]


def test_against_plain_python(spark, rows):
    docs, labels = rows
    frame = spark.createDataFrame([(i, t, s, "_w", 1) for i, t, s in docs], "doc_id long, text string, lang string, _w string, stratum int")
    got = result(frame, spark.createDataFrame(labels, "doc_id long, quality int").withColumn("lang", F.lit("x")))
    want, cut = verdicts(docs, labels)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(cut.values()) and None in cut.values() and {r for x in want for r in x[8]} >= {"symbols"}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "é", "\n", "\r\n", " ", "#", "\x85", "c c", "d\n"]), max_size=40).map(" ".join), min_size=1, max_size=8))
def test_counts_of_any_text(spark, texts):
    got = quality.text_counts(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text", ["k"]).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [(c[0], c[1], c[2], c[3], c[4], c[5]) for c in map(counts, texts)]


def test_runs_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality, "_PLACE", 60)  # three bits of hash are left
    rng = np.random.default_rng(2)
    text = " ".join(rng.choice(list("abcdef"), 120))
    got = quality.text_counts(spark.createDataFrame([(text,)], "text string"), "text", []).first()
    assert got.n_repeat_words == counts(text)[5] and 0 < got.n_repeat_words < 120


def test_no_rows_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert result(spark.createDataFrame([], "doc_id long, text string, lang string"), labels) == []
    rows = [(1, "w " * 30 + "v " * 30, "en"), (2, " ".join(f"w{k}" for k in range(60)), None), (2, None, None)]
    assert sorted(x[-1] for x in result(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)) == [False, False, True]


def test_long_text(spark):
    text = "\n".join(f"w{k} v{k % 1000} u" for k in range(300_000))
    got = quality.text_counts(spark.createDataFrame([(text,)], "text string"), "text", []).first()
    assert tuple(got) == counts(text)


def test_binomial_tail(spark):
    df = spark.createDataFrame([(n, k) for n in (1, 10, 600) for k in (0, 1, 7, 30) if k <= n], "n long, k long")
    for r in df.select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.05).alias("p")).collect():
        assert r.p == pytest.approx(sum(comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1)), rel=1e-9)
