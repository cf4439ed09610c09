"""Each operator against a brute-force version, over texts with nulls, empties, ties and copies."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from graphlens.llm import bpe, exact_dedup, language_id, mixing, near_dup, sharding, substring_dedup, token_files, vector_search, warc
from graphlens.llm.common import table
from tokenizers import Tokenizer

RNG = np.random.default_rng(5)
WORDS = ["the", "and", "tion", "ren", "hed", "ing.", "éau", "x", "of,", "ble"]


def text(n: int) -> str:
    return " ".join(RNG.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    base, passage = text(90), text(50)
    out = [(1, base, "b"), (2, base, "b"), (3, base.replace("the", "a", 1), "b"), (4, None, None), (5, "", "a"), (6, f"{text(20)} {passage} {text(9)}", "a"), (7, f"{passage}\n\n{text(30)}", "c"), (8, " \t ", "c"), (9, "one two", "c"), (10, text(3000), "z"), (11, "a  b\n \n c <|endoftext|> d", "a"), (11, base, "a")]
    return out + [(20 + k, text(40 + k), "ab"[k % 2]) for k in range(30)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(a, b, c, "en", 7) for a, b, c in rows], "doc_id long, text string, source string, lang string, _row int")


def words(t):
    return (t or "").encode().split()


def test_substring_dedup(docs, rows):
    count = Counter(tuple(w[i : i + 35]) for w in (words(t) for _, t, _ in rows) for i in range(len(w) - 34))
    want = []
    for d, t, _ in rows:
        w = words(t)
        gone = {k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        want.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text)) for r in substring_dedup.repeated_windows(docs).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)


def test_exact_dedup(docs, rows):
    key = lambda t: " ".join([""] + (t or "").split() + [""]) if (t or "") != (t or "").strip() else " ".join((t or "").split())
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[key(t)].append(d)
    got = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted((d, min(g), len(g)) for g in groups.values() for d in g)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.drop_copies(docs).count() == len(groups)


def test_near_duplicates(docs, rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in (words(t) for _, t, _ in rows)]
    linked = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    n = sorted((rows[i][0], sum(linked(sets[i], sets[j]) for j in range(len(rows)) if j != i)) for i in range(len(rows)))
    got = near_dup.jaccard_join(docs).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == n
    assert {r.class_id for r in got if r.doc_id in (1, 2, 3)} == {1}


def test_pair_is_dropped_only_when_hopeless():
    assert near_dup.least_matches()[0] <= 2 and near_dup.least_matches()[-1] < 0.8 * near_dup.VALUES


def test_sharding(docs, rows):
    got = sorted(sharding.shard_by_bytes(docs, 4).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in got] == sorted(d for d, _, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    for shard in {r.shard for r in got}:
        assert [r.slot for r in got if r.shard == shard] == list(range(sum(r.shard == shard for r in got)))


def test_mixing(docs):
    got = mixing.mix_sources(docs).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    for target, of in got.groupby("target"):
        can = 1  # bit n: n words can be taken
        for n in of["size"].tolist():
            can |= can << n | can << 2 * n
        best = min(abs(target - n) for n in range(can.bit_length()) if can >> n & 1)
        assert abs(target - of.taken.sum()) <= best + 60
    assert sorted(mixing.mix_sources(docs).select("doc_id", "size", "taken").collect()) == sorted(map(tuple, got[["doc_id", "size", "taken"]].to_numpy().tolist()))


def test_budget_is_met_exactly_when_it_can_be():
    take = mixing.fit_budget([3, 5, 7], [4, 4, 4], 31)
    assert sum(a * b for a, b in zip([3, 5, 7], take, strict=True)) == 31 and all(t <= 4 for t in take)


def test_plan_does_not_depend_on_the_order_of_its_rows():
    n = np.arange(1, 301)
    pdf = pd.DataFrame({"source": "a", "size": n, "n": 1 + n % 3, "source_size": int((n * (1 + n % 3)).sum()), "target": 41234.0})
    plans = [mixing._plan(p).sort_values("size").to_numpy().tolist() for p in (pdf, pdf[::-1], pdf.sample(frac=1, random_state=3))]
    assert plans[0] == plans[1] == plans[2]


def test_encoding(docs, rows):
    lib = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    want = sorted((d, lib.encode(t or "", add_special_tokens=False).ids) for d, t, _ in rows)
    got = bpe.bpe_decode(bpe.bpe_encode(docs)).collect()
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert Counter(r.decoded for r in got) == Counter(lib.decode(i, skip_special_tokens=False) for _, i in want)


def test_token_files(docs, rows):
    lib = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    got = sorted(token_files.round_trip(docs).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((d, [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in rows)
    assert [r.doc_id for r in got] == sorted(d for d, _, _ in rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]


def test_codes():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1])
    control, data = token_files.pack(ranks)
    assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)) == ranks).all()


def test_top_k(spark):
    x = RNG.normal(size=(300, 6)).astype(np.float32)
    x[50:150] = x[0]
    data = [(k, x[k].tolist()) for k in range(300)] + [(400, None), (420, [float("nan")] * 6), (440, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    got = defaultdict(list)
    for r in sorted(vector_search.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>"), 20, 20).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    y = np.floor(x.astype(float) * 64).astype(int)
    for q in range(0, 300, 20):
        s = y @ y[q]
        assert got[q] == [(k, s[k]) for k in sorted(range(300), key=lambda k: (-s[k], k)) if k != q][:20]
    assert len(got) == 15


def test_language_is_right_on_held_out_pages(spark):
    d = "/root/testdata/sf0.001"
    model = language_id.train(table(spark, d, "documents"))
    got = language_id.identify_pages(table(spark, "/root/testdata/sf0.01", "pages"), model).toPandas()
    assert (got.text_lang == got.declared).mean() > 0.95
    none = spark.createDataFrame([(1, None, None, None), (2, "", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r.lang for r in language_id.identify_documents(none, model).collect()} == {"und"}


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/", "<html lang=en><title>T</title><p>x&amp;y</p><script>no</script></html>"), (2, None, None)], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages)).collect()
    assert [r.record_type for r in made] == ["metadata", "conversion"] * 2 and bytes(made[1].block).decode() == "T\nx&y"
    assert {r.refers_to for r in made} == {r.record_id for r in warc.responses(pages).collect()}
    warc.write_warc(warc.derivatives(warc.responses(pages)), f"file://{tmp_path}/w")
    back = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert {(r.record_id, bytes(r.block), r.block_digest) for r in back} == {(r.record_id, bytes(r.block), r.block_digest) for r in made}


def test_empty_tables(docs):
    none = docs.limit(0)
    for f in (substring_dedup.repeated_windows, exact_dedup.exact_dedup, near_dup.jaccard_join, sharding.shard_by_bytes, mixing.mix_sources, bpe.bpe_encode, token_files.round_trip):
        assert f(none).count() == 0, f


def test_new_pieces_are_encoded_together(monkeypatch):
    """Different words, marks, line ends, long words and special tokens, in parts and in texts taken whole, as the library has them; hardly a piece is taken by itself."""
    path = public_tokenizers.path(bpe.TOKENIZER)
    lib, encoder, alone = Tokenizer.from_file(path), bpe.Encoder(path), []
    one = encoder._encode_piece
    monkeypatch.setattr(encoder, "_encode_piece", lambda piece: alone.append(piece) or one(piece))
    letters = ["e", "t", "a", "the", "ing", "é", "ß", "日", "😀", "7", "12", "'s", "\n", "\r\n", ".", "!!", "ª", "́", " ", "_", "<|endoftext|>"]
    word = lambda: "".join(RNG.choice(letters[:6] if RNG.random() < 0.7 else letters, RNG.integers(1, 12)))
    texts = [" ".join(word() for _ in range(500)) for _ in range(12)]
    texts += [t.replace(" ", "  ", 2) for t in texts] + [None, "", " ", "<|endoftext|>", "y" * 64, "y" * 65, "z" * 3000, "a " + "ab" * 200 + " b"]
    made = list(encoder.chunks(pa.array(texts)))
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [n for _, _, _, counts in made for n in counts.tolist()] == [len(w) for w in want]
    assert [k for _, _, ids, _ in made for k in ids.tolist()] == [k for w in want for k in w]
    assert len(alone) < 100
    few = pa.array(["a b c", "q  q <|endoftext|>"])
    assert [k for _, _, ids, _ in encoder.chunks(few) for k in ids.tolist()] == [k for t in few.to_pylist() for k in lib.encode(t, add_special_tokens=False).ids]
