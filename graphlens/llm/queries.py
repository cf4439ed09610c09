"""The queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .common import table
from .cross_tokenizer import align_tokenizers
from .exact_dedup import exact_dedup
from .language_id import document_columns, evidence, fuse, page_columns, train
from .lexical_search import search
from .mixing import mix_sources
from .near_dup import jaccard_join
from .quality import quality_rules
from .sharding import shard_by_bytes
from .substring_dedup import repeated_windows
from .token_files import crc32_of, round_trip
from .vector_search import top_k
from .warc import derivatives, responses

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 8)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe_decode(bpe_encode(table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc32_of(round_trip(table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by all four kinds of evidence and documents by what they have; one of doc_id and page_id is null."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model, ids = train(docs), ["doc_id", "page_id"]
    of_docs = evidence(document_columns(docs).withColumn("page_id", F.lit(None).cast("long")), model, ids)
    of_pages = evidence(page_columns(pages).withColumn("doc_id", F.lit(None).cast("long")), model, ids, markup=True)
    return fuse(of_docs.unionByName(of_pages), model.languages, ids)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of each page's response."""
    made = derivatives(responses(table(spark, sf_dir, "pages")))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", F.length("block").cast("long").alias("length"), F.sha2("block", 256).alias("block_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents")).documents


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    of = [op1_substring_dedup, op2_sharding, op3_top_k, op4_bpe, op5_jaccard_join, op6_token_files, op7_mixing, op8_language_id, op9_warc, op10_exact_dedup, op11_cross_tokenizer, op12_lexical_search, op13_quality_rules, pipeline]
    return {f.__name__: f for f in of}


#: Components are read as doubles, floored and multiplied as integers.
OP3_SQL = r"""
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM again
), g AS (
  SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(d.w[k], ' ' ORDER BY k) AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d) d ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


#: CRC-32 goes byte by byte through the table of its polynomial; a document lies in the shard into whose share its middle falls.
OP2_SQL = r"""
WITH t AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))
), s AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, [CAST('0x' || b AS BIGINT) FOR b IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS b FROM documents
), c AS (
  SELECT doc_id, size, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(t.t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) AS text_crc32 FROM s, t
), r AS (
  SELECT *, CAST((2 * (sum(size) OVER (ORDER BY doc_id) - size) + size) * 8 // (2 * sum(size) OVER ()) AS INTEGER) AS shard FROM c
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, 1 + greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN link l ON l.a = r.b
)
SELECT a AS doc_id, min(b) AS class_id, (SELECT count(*) FROM link l WHERE l.a = reached.a) AS n_links, count(*) AS class_size FROM reached GROUP BY a
"""

OP12_SQL = r"""
WITH r AS (
  SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS large, 'abcdefghijklmnopqrstuvwxyz' AS small
), t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, large, small), term)) AS term FROM documents, r
), f AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term
), n AS (
  SELECT doc_id, sum(tf) AS n FROM f GROUP BY doc_id
), a AS (
  SELECT count(*) AS docs, sum(n) AS total FROM n
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, a GROUP BY term, docs
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, large, small), term)) AS term FROM benchmark, r
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * (1000000000 * tf // (1000 * tf + 20 * (50 + 50 * n * docs // total)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN n USING (doc_id), a GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50
"""

#: The cutoffs are chosen as in quality.py; the binomial tail is summed by logarithms of factorials.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM p) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM again) GROUP BY doc_id
), c AS (
  SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT doc_id, lang, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
), s AS (
  SELECT doc_id, lang, base_failed, unnest([
    {'o': 1, 'rule': 'symbols', 'score': CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END},
    {'o': 2, 'rule': 'repeats', 'score': CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END},
    {'o': 3, 'rule': 'lines', 'score': CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END},
    {'o': 4, 'rule': 'long', 'score': CASE WHEN n_words > 0 THEN least(1000 * word_chars // n_words, 10000) // 10 ELSE 0 END},
    {'o': 5, 'rule': 'short', 'score': 1000 - CASE WHEN n_words > 0 THEN least(1000 * word_chars // n_words, 10000) // 10 ELSE 0 END}], recursive := true) FROM f
), k AS (
  SELECT s.*, good, md5(CAST(doc_id AS VARCHAR))[1] IN ('0', '1', '2', '3') AS tuning
  FROM s JOIN (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed
), h AS (
  SELECT lang, rule, score - 1 AS cutoff, sum(count(*) FILTER (good)) OVER w AS good, sum(count(*) FILTER (NOT good)) OVER w AS bad
  FROM k WHERE tuning GROUP BY lang, rule, score WINDOW w AS (PARTITION BY lang, rule ORDER BY score DESC)
), v AS (
  SELECT lang, rule, level, max({'gain': bad - price * good, 'cutoff': cutoff}) FILTER (bad > price * good) AS best
  FROM h, (VALUES (0, 64), (1, 16), (2, 4)) AS r(level, price) GROUP BY lang, rule, level
), n AS (
  SELECT lang, count(DISTINCT doc_id) AS n, count(*) OVER () AS strata FROM k WHERE good AND NOT tuning GROUP BY lang
), lost AS (
  SELECT n.lang, level, n, strata, (SELECT count(DISTINCT k.doc_id) FROM k JOIN v ON v.lang IS NOT DISTINCT FROM k.lang AND v.rule = k.rule AND v.level = r.level
    WHERE good AND NOT tuning AND k.lang IS NOT DISTINCT FROM n.lang AND k.score > coalesce(v.best.cutoff, 1000)) AS lost FROM n, range(3) AS r(level)
), tail AS (
  SELECT lang, level, strata, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95))) AS p
  FROM (SELECT *, unnest(range(0, lost + 1)) AS i FROM lost) GROUP BY lang, level, strata
), held AS (
  SELECT lang, max(level) AS level FROM (SELECT lang, level, bool_and(p <= 0.05 / strata) OVER (PARTITION BY lang ORDER BY level) AS ok FROM tail) WHERE ok GROUP BY lang
), gone AS (
  SELECT s.doc_id, string_agg(s.rule, ',' ORDER BY s.o) AS rules FROM s JOIN held ON held.lang IS NOT DISTINCT FROM s.lang
  JOIN v ON v.lang IS NOT DISTINCT FROM s.lang AND v.rule = s.rule AND v.level = held.level WHERE s.score > coalesce(v.best.cutoff, 1000) GROUP BY s.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS rejected_by FROM f LEFT JOIN gone USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_sharding": OP2_SQL, "op3_top_k": OP3_SQL, "op5_jaccard_join": OP5_SQL, "op10_exact_dedup": OP10_SQL, "op12_lexical_search": OP12_SQL, "op13_quality_rules": OP13_SQL}
