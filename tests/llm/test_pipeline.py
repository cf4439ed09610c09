"""Stages of the pipeline keep or drop each row by itself, over ids that repeat or are null."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from graphlens.llm import mixing

RNG = np.random.default_rng(11)
COLUMNS = "doc_id long, text string, lang string, source string"


def text(n: int) -> str:
    return " ".join(RNG.choice(["sta", "mor", "lin", "cade", "prun", "velt", "oss", "ira"], n))


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def near():
    """A document, near copies with a null id, with its own id and with another, a pair of null ids, and texts that are alone."""
    a, b = text(120), text(120)
    alone = [(None, text(50), "en", "s"), (None, text(60), "en", "s"), (1, text(70), "en", "s"), (2, text(55), "en", "s"), (None, None, "en", "s"), (None, "", "en", "s")]
    return [(1, a, "en", "s"), (None, a + " x", "en", "s"), (2, a + " y", "en", "s"), (1, a + " z w", "en", "s"), (None, b, "en", "s"), (None, b + " q", "en", "s"), (None, b, "en", "s")], alone


def test_near_copies_go_row_by_row(spark, near):
    copies, alone = near
    got = rows_of(corpus_pipeline.jaccard_join(spark, spark.createDataFrame(copies + alone, COLUMNS), ""))
    assert all(got[r] == 1 for r in alone)
    stay = {r for r in copies if got[r]}
    assert len(stay) == 2 and sum(got.values()) == len(alone) + 2
    assert {r[0] for r in stay} == {1, None}


def test_rejected_rows_leave_others_of_their_id(spark):
    clean = [(k % 3 or None, text(80 + k), "en", "s") for k in range(30)]
    junk = [(None, "12 34", "en", "s"), (1, None, "en", "s")]
    got = rows_of(corpus_pipeline.language_id(spark, spark.createDataFrame(clean + junk, COLUMNS), ""))
    assert got == Counter(clean)


def test_mix_meets_its_targets_with_null_and_repeated_ids(spark):
    rows = [(k % 7 or None, text(5 + k), "en", "ab"[k % 2]) for k in range(80)]
    rows += [rows[3]] * 2
    docs = spark.createDataFrame(rows, COLUMNS)
    got = rows_of(corpus_pipeline.mixing(spark, docs, ""))
    stands = Counter(rows)
    assert set(got) <= set(stands) and all(n <= 2 * stands[r] for r, n in got.items())
    targets = {r.target: r.source_size for r in mixing.mix_sources(docs).collect()}
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "ab"}
    for target, size in targets.items():
        source = next(s for s in "ab" if sizes[s] == size)
        assert abs(target - sum(len(r[1].split()) * n for r, n in got.items() if r[3] == source)) <= 3
