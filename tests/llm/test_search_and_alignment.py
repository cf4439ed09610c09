"""Ranked search and cross-tokenizer alignment against plain Python versions."""

import hashlib
import json
import re
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from graphlens.llm import cross_tokenizer, lexical_search
from graphlens.llm.bpe import byte_characters
from tokenizers import Tokenizer

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    N, L = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            n, score = sum(c.values()), 0
            for t in set(terms(text)):
                df = sum(t in x for _, x in held)
                if c[t]:
                    score += floor(1000 * log((2 * N + 2) / (2 * df + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * N // L)))
            if score:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)] + ["Éa", "éa", "the", "THE", "x-y", "a1", "日本"]
    chance = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=chance / chance.sum()))
    docs = [(k, text(int(rng.integers(1, 60)))) for k in range(150)]
    docs += [(200 + k, docs[3][1]) for k in range(40)] + [(None, docs[3][1]), (None, docs[3][1]), (7, docs[7][1]), (7, "w1 w2"), (300, None), (301, " .. "), (302, "the " * 700 + "w59"), (303, "b\x00the\x7fw3")]
    items = [(k, text(12)) for k in range(8)] + [(8, docs[3][1]), (8, "w59 THE the"), (None, "éa"), (9, None), (10, "--"), (11, "unknown")]
    return docs, items


@pytest.mark.parametrize("block", [1000, 3])
def test_search(spark, corpus, monkeypatch, block):
    docs, items = corpus
    monkeypatch.setattr(lexical_search, "BLOCK_QUERIES", block)
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, queries int").repartition(5)
    got = lexical_search.search(frame, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int"), k=10)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, ranked(docs, items, 10)))


def test_search_of_few_places_and_without_rows(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical_search, "COORDINATES", 3)  # bounds are loose, results the same
    items_df, docs_df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = lexical_search.search(docs_df, items_df, k=4)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, ranked(docs, items, 4)))
    assert lexical_search.search(docs_df.limit(0), items_df).count() == lexical_search.search(docs_df, items_df.limit(0)).count() == 0
    assert lexical_search.search(docs_df.where("doc_id >= 300"), items_df).count() > 0


def test_search_in_a_long_text(spark):
    docs = [(1, "Alpha beta, " * 400_000), (2, "alpha gamma"), (3, "delta")]
    items = [(0, "alpha BETA"), (1, "gamma")]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(ranked(docs, items, 50))


def test_bounds_are_never_below_scores():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.3, 50) % 500) for _ in range(60)]
    block = lexical_search.Block([0, 1], [sorted({*lexical_search.terms_of(t)}) for t in texts[:2]])
    rows = [b for b in lexical_search._scan(block.known, True)(iter([pa.RecordBatch.from_pydict({"doc_id": range(60), "text_hash": range(60), "text": texts})]))]
    found = np.zeros(len(block.vocabulary), np.int64)
    pairs = np.frombuffer(rows[1]["found"][0].as_py(), "<i8").reshape(-1, 2)
    found[pairs[:, 0]] = pairs[:, 1]
    assert found.tolist() == [sum(t in x.split() for x in texts) for t in block.vocabulary]
    block.weigh(60, 3000, found)
    bounds = lexical_search._bounds(block, rows[0])
    score = {(q, d): s for q, _, d, s in ranked(list(enumerate(texts)), [(0, texts[0]), (1, texts[1])], 60)}
    assert all(bounds[d, q] >= s for (q, d), s in score.items())


def aligned(docs):
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {c: b for b, c in byte_characters().items()}
    a_bytes = {k: bytes(byte_of[c] for c in t) for t, k in json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"].items()}
    b_bytes = lambda k: bytes([int(b_lib.id_to_piece(k)[3:5], 16)]) if b_lib.is_byte(k) else b_lib.id_to_piece(k).replace("▁", " ").encode()
    found, count = [], Counter()
    for d, text in docs:
        groups, links = [], []
        want = (" " + (text or "")).encode()
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids if text else [], b_lib.encode(text) if text else []
        if not text or b"".join(a_bytes[k] for k in a) != want or b"".join(map(b_bytes, b)) != want:
            a, b = [], []
        spans = lambda ids, of: list(zip(np.cumsum([0] + [len(of(k)) for k in ids]).tolist(), np.cumsum([len(of(k)) for k in ids]).tolist(), ids))  # noqa: E731, B905
        sa, sb = spans(a, a_bytes.get), spans(b, b_bytes)
        ends = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        at = 0
        for e in ends:
            x, y = [s for s in sa if at < s[1] <= e], [s for s in sb if at < s[1] <= e]
            groups.append(",".join(str(s[2]) for s in x) + "|" + ",".join(str(s[2]) for s in y))
            links += [(p[2], q[2]) for p in x for q in y if p[0] < q[1] and q[0] < p[1]]
            at = e
        count.update(links)
        found.append((d, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(d, x, y, g, len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), sha) for d, x, y, g, ls, sha in found], count


TEXTS = [
    "Hello world, the internationalization of tokens!", "a  b\n\n c <|endoftext|> d", "", None, " lead", "trail ", "▁under", "a▁b c", "tab\tand\r\nline", "<s> </s> <unk> <0x41>", "日本語 \U0001f600 naïve ﬁ é", "x" * 300,
    "　wide \xa0 space", "\x00nul\x7f", "Hello world, the internationalization of tokens!", "don't can't I'll ...!!! (a) 12345 3.14", " ", "  ", "\n", "é", "Thnd*** iner*** ther***",
]


@pytest.mark.parametrize("known", [1 << 20, 5, 0])
def test_alignment(spark, known, monkeypatch):
    rng = np.random.default_rng(6)
    docs = [*enumerate(TEXTS), (None, "null id"), (3, "again")]
    docs += [(100 + k, " ".join("".join(rng.choice(["ing", "tion", "the", "er", "é", "Q", "7", ",", "an"], 3)) for _ in range(30))) for k in range(60)]
    monkeypatch.setattr(cross_tokenizer, "TOGETHER", 2000)
    frame = spark.createDataFrame([(d, t, b"") for d, t in docs], "doc_id long, text string, pairs binary").repartition(3)
    got = cross_tokenizer.align_tokenizers(frame, groups=True, known=known)
    rows = got.documents.collect()
    want, count = aligned(docs)
    assert sorted(repr(tuple(r)[:8]) for r in rows) == sorted(map(repr, want))
    assert all(hashlib.sha256(r.groups).hexdigest() == r.groups_sha256 for r in rows if r.n_a) and sum(r.n_a == 0 for r in rows) >= 3
    assert {(r.id_a, r.id_b): r.n for r in got.pairs.collect()} == count


def test_alignment_of_a_long_text_and_of_none(spark):
    docs = [(1, "alpha beta, gamma " * 280_000), (2, "alpha")]
    rows = {r.doc_id: r for r in cross_tokenizer.align_tokenizers(spark.createDataFrame(docs, "doc_id long, text string")).documents.collect()}
    one, _ = aligned([(2, "alpha beta, gamma alpha beta, gamma")])
    assert rows[1].n_links >= 280_000 * one[0][4] // 2 - 2 and rows[1].n_links == rows[1].n_a + rows[1].n_b - rows[1].n_groups
    assert cross_tokenizer.align_tokenizers(spark.createDataFrame([], "doc_id long, text string")).documents.collect() == []
