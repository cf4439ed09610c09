"""Cases that once went wrong, helper names, empty tables, long texts, and brute-force versions of what SQL cannot say."""

import base64
import hashlib
import math
import time
import uuid
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from graphlens.llm import bpe, common, components, exact_dedup, language_id, markup, mixing, near_dup, sharding, substring_dedup, token_files, vector_search, warc

RNG = np.random.default_rng(23)
COLUMNS = "doc_id long, text string, lang string, source string"


def text(n: int) -> str:
    return " ".join(RNG.choice(["sta", "mor", "lin", "cade", "prun", "velt", "oss", "ira", "und", "ge"], n))


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_share_polynomials_are_told_apart(spark):
    t = thue_morse(1024)
    c = t.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{t} {rest}", "en", "s"), (2, f"{c} {rest}", "en", "s")], COLUMNS)
    assert [r.n_removed for r in substring_dedup.repeated_windows(docs).collect()] == [0, 0]
    hashes = substring_dedup.Hashes(b"k" * 32).words(f"{t} {c} a ab abcdefgh abcdefghi {'x' * 32} {'x' * 33} {'x' * 34}".encode())
    assert len(set(hashes.tolist())) == 9


def colliding_words(by: substring_dedup.Hashes) -> tuple[str, str]:
    """Two words of 16 printable bytes that share their hash under a known key: the last eight bytes of one are solved for."""
    rng, first = np.random.default_rng(9), b"abcdefgh!@@!!!!@"
    start = lambda w: int(substring_dedup._mix(np.array([(int.from_bytes(w[:8], "little") ^ int(by.start)) + 16 * by.bases[0] & (1 << 64) - 1], np.uint64))[0])
    for _ in range(200_000):
        other = rng.integers(33, 127, 8, dtype=np.uint8).tobytes()
        turn = (start(first) * by.bases[4] ^ start(other) * by.bases[4]) & (1 << 64) - 1
        tail = (int.from_bytes(first[8:], "little") ^ turn).to_bytes(8, "little")
        if all(33 <= b < 127 for b in tail):
            return first.decode(), (other + tail).decode()
    raise AssertionError("no pair found")


def test_words_that_collide_under_a_known_key_are_told_apart(spark):
    by = substring_dedup.Hashes(bytes(32))
    pairs = [colliding_words(by), ("abcdefgh!@@!!!!@", "xdczzxhjFoty1w@q")]
    assert len(set(by.words(" ".join(pairs[0]).encode()).tolist())) == 1
    rest = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(2 * k + j, f"{w} {k} {rest} {k}", "en", "s") for k, pair in enumerate(pairs) for j, w in enumerate(pair)], COLUMNS)
    one = spark.createDataFrame([(j, f"{w} {rest}", "en", "s") for j, w in enumerate(pairs[0])], COLUMNS)
    assert [r.n_removed for r in substring_dedup.repeated_windows(one).collect()] == [0, 0]
    short = spark.createDataFrame([(2 * k + j, f"{w} {k} c d e", "en", "s") for k, pair in enumerate(pairs) for j, w in enumerate(pair)], COLUMNS)
    assert {r.n_links for r in near_dup.jaccard_join(short).collect()} == {0}
    assert {r.n_removed for r in substring_dedup.repeated_windows(docs).collect()} == {36}


def test_windows_are_found_by_content():
    w = RNG.integers(0, 2**63, 120, dtype=np.uint64)
    for width in (1, 2, 5, 15, 35):
        by = substring_dedup.Hashes(b"k" * 32)
        both = by.runs(np.concatenate([w, w]), width)
        assert (both[: 120 - width + 1] == both[120 : 120 + 120 - width + 1]).all()
        assert len(set(by.runs(w, width).tolist())) == 120 - width + 1


def test_near_dup_over_many_clusters_and_small_buckets(spark, monkeypatch):
    """All pairs by brute force, with buckets and chunks so small that they are cut, and hot rows joined the long way."""
    monkeypatch.setattr(near_dup, "BUCKET", 8)
    monkeypatch.setattr(near_dup, "CHUNK", 8)
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rows, k = [], 0
    for _ in range(12):
        words = text(60).split()
        for _ in range(int(RNG.integers(1, 14))):
            own = list(words)
            for at in RNG.integers(0, 60, int(RNG.integers(0, 4))):
                own[at] = f"z{k}"
            rows.append((k, " ".join(own), "en", "s"))
            k += 1
    rows += [(None, rows[0][1], "en", "s")] * 30 + [(None, None, "en", "s"), (k, " ", "en", "s"), (k, "one", "en", "s"), (k, "one", "en", "s")]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset() for _, t, _, _ in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(rows))]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = Counter((rows[i][0], least[root[i]] if sets[i] else rows[i][0], len(near[i]), root.count(root[i]) if sets[i] else 1) for i in range(len(rows)))
    assert Counter(map(tuple, near_dup.jaccard_join(spark.createDataFrame(rows, COLUMNS)).collect())) == want


def test_forest_of_marks_links_all_that_are_near():
    base = RNG.integers(0, 256, (3, 128), dtype=np.uint8)
    marks = np.repeat(base, 5, 0)
    for row in marks:
        row[RNG.integers(0, 128, 8)] = 255
    a, b = near_dup.forest(marks)
    assert len(a) == 12 and {(x // 5, y // 5) for x, y in zip(a, b, strict=True)} == {(k, k) for k in range(3)}


def test_components_raise_rather_than_stop(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.root for r in components.components(edges).collect()} == {0}
    monkeypatch.setattr(components, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components.components(edges)


def test_hot_keys_join_as_any_others(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    keys = ["a"] * 50 + [None] * 40 + ["b", "c", "d", "d"]
    rows = common.reliable(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int"))
    side = spark.createDataFrame([(k, n, f"v{k}") for k, n in Counter(keys).items() if k != "c"], "k string, n long, v string")
    got = common.join_hot(rows, side, ["k"], "n", len(keys), "left").collect()
    assert Counter((r.k, r.i, r.v) for r in got) == Counter((k, i, None if k == "c" else f"v{k}") for i, k in enumerate(keys))


def test_shards_are_where_their_bytes_say(spark):
    rows = [(k if k % 9 else None, text(1 + k % 30), "en", "s") for k in range(200)] + [(77, None, "en", "s"), (77, "", "en", "s"), (500, text(900), "en", "s")]
    got = sorted(sharding.shard_by_bytes(spark.createDataFrame(rows, COLUMNS), 8).collect(), key=lambda r: (r.shard, r.slot))
    total, start = sum(r["size"] for r in got), 0
    for r in got:
        assert r.shard == (2 * start + r["size"]) * 8 // (2 * total)
        start += r["size"]
    for s in range(8):
        assert abs(sum(r["size"] for r in got if r.shard == s) - total / 8) <= max(r["size"] for r in got)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_pages_take_linear_time():
    began = time.time()
    for page in ("<script>" * 125_000, "<!--" * 250_000, "<p" * 500_000, "<title>" * 140_000, "</script" + " " * 1_000_000, "<" * 1_000_000):
        markup.html_text(page), markup.title(page), markup.declared(page)
    assert time.time() - began < 10
    assert markup.html_text("a<script>x</script>b<!-- c -->d<p>e<style>f") == "a b d\nef"
    assert markup.title("<title>A <b>b</b></title>") == "A b" and markup.title("<title>A") == ""


def test_fusion_of_evidence(spark):
    """Posteriors by the formulas in plain Python, over pages and documents with nulls, ties and a hot host."""
    docs = [(k, " ".join(RNG.choice(words, 12)), lang, f"s{k % 3}") for k, (lang, words) in enumerate([("en", ["the", "and", "with", "house"]), ("de", ["der", "und", "haus", "nicht"]), ("fr", ["les", "dans", "maison", "avec"])] * 12)]
    model = language_id.train(spark.createDataFrame(docs, COLUMNS))
    n = len(model.languages)
    pages = [(k, f"http://{'www.a.fr' if k % 3 else 'b.c.de'}/{k}", f"<html{' lang=fr' if k % 2 else ''}><p>{docs[k % 36][1]}</p></html>") for k in range(40)]
    pages += [(40, None, None), (41, "http://b.c.de/", "<p>12 34</p>"), (None, "x", "<html lang=de><p>der und haus nicht</p>"), (None, "x", "<html lang=de><p>der und haus nicht</p>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = []
    for page, url, body in pages:
        t = language_id.trigrams(markup.html_text(body or ""))
        logs = [sum(float(model.table[b, j]) for b in t) for j in range(n)]
        known = bool(len(t)) and max(logs) > language_id.BACKGROUND * len(t)
        logs = [x * min(1.0, language_id.EVIDENCE / len(t)) if len(t) else 0.0 for x in logs]
        says = [math.exp(x - max(logs)) for x in logs]
        says = [x / sum(says) for x in says] if known else [1 / n] * n
        host = (url or "").split("/")[2] if url and "//" in url else None
        rows.append({"id": page, "logs": logs, "says": says, "known": known, "declared": markup.declared(body or "") or None, "host": host, "suffix": host and host.split(".")[-1], "domain": host and ".".join(host.split(".")[-2:])})

    def sums(of, key):
        same = [r for r in rows if r["known"] and (key is None or r[key] == of[key])]
        return [max(sum(r["says"][j] for r in same) - of["says"][j] * of["known"], 0.0) for j in range(n)] if key is None or (of[key] and same) else None

    want = []
    for r in rows:
        of = {k: sums(r, None if k == "all" else k) for k in ("all", "declared", "suffix", "domain", "host")}
        logs = []
        for j in range(n):
            prior = (of["all"][j] + 1) / (sum(of["all"]) + n)
            for key in ("domain", "host"):
                s = of[key] or [0.0] * n
                prior = (s[j] + language_id.HOST_WEIGHT * prior) / (sum(s) + language_id.HOST_WEIGHT)
            x = math.log(prior) + r["logs"][j]
            for key in ("declared", "suffix"):
                x += math.log((of[key][j] + language_id.SMOOTH) / (of["all"][j] + language_id.SMOOTH * 20)) if of[key] else 0.0
            logs.append(x)
        p = [math.exp(x - max(logs)) for x in logs]
        best = max(p) / sum(p)
        want.append((r["id"], model.languages[p.index(max(p))] if r["known"] else "und", round(best, 6) if r["known"] else 0.0, r["known"] and best >= 0.5))
    got = language_id.identify_pages(table, model).collect()
    assert Counter((r.page_id, r.lang, round(r.confidence, 6), r.accepted) for r in got) == Counter(want)


def test_records_of_pages(spark):
    """Both derivatives, byte for byte, from the page alone."""
    bodies = {1: ("http://a.b/1", "<html lang='de'><title>T&amp;U</title><body><p>eins</p>zwei<script>x</script></body></html>", "T&U", "de", "T&U\neins\nzwei"), 2: ("http://a.b/2", "", "", "", ""), 3: (None, "plain é", "", "", "plain é")}
    pages = spark.createDataFrame([(k, u, b) for k, (u, b, *_) in bodies.items()] + [(None, None, None)], "page_id long, url string, html string")
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    name = lambda *parts: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(repr, parts)))}>"
    got = defaultdict(dict)
    for r in warc.derivatives(warc.responses(pages)).collect():
        got[r.page_id][r.record_type] = r
    for k, (url, body, title, lang, plain) in {**bodies, None: (None, "", "", "", "")}.items():
        payload = body.encode()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        response = name(k, url, sha(payload))
        meta, conv = name(response, "metadata"), name(response, "conversion")
        fields = {"source-status": "HTTP/1.1 200 OK", "source-header-content-type": "text/html; charset=utf-8", "source-header-content-length": str(len(payload)), "source-payload-digest": sha(payload), "source-block-digest": sha(http), "title": title, "language-declared": lang, "conversion-record": conv, "conversion-characters": str(len(plain))}
        block = "".join(f"{a}: {b}\r\n" for a, b in fields.items()).encode()
        m, c = got[k]["metadata"], got[k]["conversion"]
        assert (m.record_id, m.refers_to, bytes(m.block), m.block_digest, m.payload_digest, m.target_uri) == (meta, response, block, sha(block), sha(payload), url)
        assert (c.record_id, c.refers_to, bytes(c.block).decode(), c.block_digest, c.payload_digest) == (conv, response, plain, sha(plain.encode()), sha(plain.encode()))


CLASHES = ["_key", "_sha", "_sha_of_text", "_twice", "_id", "_copy", "_row", "_doc", "_t", "_len", "_head", "_n", "node", "bands", "key", "times", "size", "known", "says", "host", "domain", "suffix", "declared", "block", "n_tokens", "ids", "h"]


@pytest.fixture(scope="module")
def clashing(spark):
    base = text(90)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base + " x", "en", "b"), (None, text(50), "en", None), (None, None, None, None), (5, "", "en", "a"), (6, text(40), "en", "b"), (7, text(45), "en", "c"), (7, text(45), "en", "c")]
    rows += [rows[6]] * 2
    return spark.createDataFrame([(*r, *["user"] * len(CLASHES)) for r in rows], f"{COLUMNS}, {', '.join(f'`{c}` string' for c in CLASHES)}")


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, clashing, stage):
    got = stage(spark, clashing, "")
    if stage is corpus_pipeline.bpe:
        assert got.count() == clashing.count()
    else:
        assert got.columns == clashing.columns and got.count() and got.select(*CLASHES).distinct().collect() == [tuple(["user"] * len(CLASHES))]
        plain = stage(spark, clashing.select("doc_id", "text", "lang", "source"), "")
        if stage is not corpus_pipeline.mixing:  # the choice among rows of a length goes by a digest of all columns
            order = lambda df: Counter(map(tuple, df.select("doc_id", "text").collect()))
            assert order(got) == order(plain)


def test_operators_take_columns_of_any_name(clashing, spark):
    n = clashing.count()
    for f in (substring_dedup.repeated_windows, exact_dedup.exact_dedup, near_dup.jaccard_join, sharding.shard_by_bytes, mixing.mix_sources, bpe.bpe_encode, token_files.round_trip):
        assert f(clashing).count() == n, f
    assert language_id.identify_documents(clashing, language_id.train(clashing)).count() == n
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", "user", "user")], "page_id long, url string, html string, text string, block string")
    assert warc.derivatives(warc.responses(pages)).count() == 2
    vectors = spark.createDataFrame([(k, [float(k), 1.0], "user", "user") for k in range(25)], "vec_id long, embedding array<float>, x string, cell string")
    assert vector_search.top_k(vectors).count() == 40


def test_empty_tables_give_empty_results(spark, clashing):
    none = clashing.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
    assert vector_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses(pages)).count() == 0
    assert language_id.identify_pages(pages, language_id.train(none)).count() == 0


def test_long_texts_are_taken_whole(spark):
    """A text of 5 MB, its near copy, and a word of 1 MB."""
    words = RNG.integers(0, 40_000, 800_000)
    long = " ".join(f"w{w:x}" for w in words)
    rows = [(1, long, "en", "s"), (2, long + " x", "en", "s"), (3, "y" * 1_000_000, "en", "s"), (4, text(60), "en", "s")]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(2)
    got = {r.doc_id: r for r in substring_dedup.repeated_windows(docs).collect()}
    assert (got[1].n_words, got[1].n_removed) == (800_000, 800_000) and (got[2].n_removed, bytes(got[2].kept_text)) == (800_000, b"x") and got[3].n_removed == 0
    assert {r.doc_id: r.class_id for r in near_dup.jaccard_join(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert sum(r.kept for r in exact_dedup.exact_dedup(docs).collect()) == 4
    assert {r.doc_id: r["size"] for r in mixing.mix_sources(docs).collect()} == {1: 800_000, 2: 800_001, 3: 1, 4: 60}
    assert {r.doc_id: r.decoded for r in bpe.bpe_decode(bpe.bpe_encode(docs)).select("doc_id", "decoded").collect()} == {r[0]: r[1] for r in rows}
    assert token_files.round_trip(docs).count() == 4 and sharding.shard_by_bytes(docs).count() == 4
    assert language_id.identify_documents(docs, language_id.train(docs)).count() == 4


def test_vectors_beyond_64_bits_are_an_error(spark):
    vectors = spark.createDataFrame([(0, [1e30, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        vector_search.top_k(vectors).collect()


def test_search_over_cells_and_shards(spark, monkeypatch):
    """Many small cells, shards and blocks, wide numbers, a vector that many share, and two lengths of vector."""
    for name, value in (("SHARD_ROWS", 30), ("BLOCK_QUERIES", 4), ("LEAF_ROWS", 4), ("BOXES", 7)):
        monkeypatch.setattr(vector_search, name, value)
    x = np.round(RNG.normal(size=(400, 3)) * 1e6)
    x[100:230] = x[7]
    rows = [(k, x[k].tolist()) for k in range(400)] + [(1000 + k, RNG.normal(size=2).tolist()) for k in range(60)]
    got = defaultdict(list)
    for r in sorted(vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    y = {k: np.floor(np.array(v) * 64).astype(int) for k, v in rows}
    for q in (k for k in y if k % 20 == 0):
        others = [(k, int(v @ y[q])) for k, v in y.items() if k != q and len(v) == len(y[q])]
        assert got[q] == sorted(others, key=lambda t: (-t[1], t[0]))[:20]


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows from plain Python; the models that are learned are held to planted rows."""
    base = text(120)
    rows = [(10, base, "en", "a"), (4, base.replace(" ", "  "), "en", "a"), (12, base + " z", "en", "b"), (None, base, "en", "b")]
    rows += [(20 + k, text(30 + k), "en", "ab"[k % 2]) for k in range(30)] + [(60, None, "en", "a"), (61, "12 34 56", "en", "a"), (62, "", "en", "b")]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if r[0] not in (60, 61, 62))
    once = corpus_pipeline.exact_dedup(spark, kept, "")
    want = {}
    for r in sorted((r for r in rows if r[0] not in (60, 61, 62)), key=lambda r: (r[0] is not None, r[0] or 0)):
        want.setdefault(" ".join(r[1].split()), r)
    assert Counter(map(tuple, once.collect())) == Counter(want.values())
    left = corpus_pipeline.jaccard_join(spark, once, "")
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    sets = {r: runs(r[1].split()) for r in want.values()}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    order = lambda r: (r[0] is None, r[0] or 0)
    stay = [r for r in sets if not any(near(r, s) and order(s) < order(r) for s in sets if s is not r)]
    assert Counter(map(tuple, left.collect())) == Counter(stay)
    mixed = Counter(map(tuple, corpus_pipeline.mixing(spark, left, "").collect()))
    targets = {r.source_size: r.target for r in mixing.mix_sources(left).collect()}
    for s in "ab":
        of = [r for r in stay if r[3] == s]
        size = sum(len(r[1].split()) for r in of)
        assert abs(sum(len(r[1].split()) * mixed[r] for r in of) - targets[size]) <= 40 and all(mixed[r] <= 2 for r in of)
    assert corpus_pipeline.bpe(spark, left, "").count() == len(stay)
