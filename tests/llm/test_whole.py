"""Budgets with very long documents, and markup that stands late in a page."""

import numpy as np

from graphlens.llm import language_id, mixing, warc


def test_budget_is_met_with_very_long_documents():
    lengths = [*range(20, 18_001, 20)][:900] + [2_000_000]
    counts = [1] * 900 + [3]
    budget = sum(n * c for n, c in zip(lengths, counts, strict=True)) // 2
    take = mixing.fit_budget(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
    assert abs(budget - sum(n * t for n, t in zip(lengths, take, strict=True))) <= 10


def test_trace_is_the_same_when_little_is_kept(monkeypatch):
    rng = np.random.default_rng(3)
    lengths = sorted(rng.choice(np.arange(50, 9000), 60, replace=False).tolist())
    counts = rng.integers(1, 6, 60).tolist()
    want = mixing.fit_budget(lengths, counts, 400_001)
    monkeypatch.setattr(mixing, "TRACE_BYTES", 20_000)
    got = mixing.fit_budget(lengths, counts, 400_001)
    words = lambda take: sum(n * t for n, t in zip(lengths, take, strict=True))
    assert words(got) == words(want) == 400_001 and all(0 <= t <= c for t, c in zip(got, counts, strict=True))


def test_language_is_declared_after_a_long_comment(spark):
    head = "<!DOCTYPE html><!-- <html lang=xx> " + "license " * 1250 + "-->" + " " * 5000
    pages = spark.createDataFrame([(1, "http://a.b/", head + "<html class=x lang='de-AT'><p>x</p></html>"), (2, "http://a.b/", "<html><p lang=fr>x</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.declared for r in language_id.page_columns(pages).collect()} == {1: "de", 2: None}
    made = warc.derivatives(warc.responses(pages)).where("record_type = 'metadata'").collect()
    assert {r.page_id: bytes(r.block).decode().split("language-declared: ")[1].split("\r\n")[0] for r in made} == {1: "de-at", 2: ""}
