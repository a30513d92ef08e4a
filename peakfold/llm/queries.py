"""The queries opN_<name> of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfold.llm import codes, decontaminate, jaccard, langid, mixing, passages, pii, ranking, repeats, sharding, topk, toxicity, warc
from peakfold.llm.common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(by: int):
    """crc32(doc_id as text) mod `by`; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=remainder(3) != 1, most_per_class=2000, threshold=0.7)
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document."""
    pairs = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), seed=5, threshold=0.5)
    named = F.format_string("%d:%.4f", "item_id", "coverage")
    return pairs.groupBy("doc_id").agg(F.max("coverage").alias("coverage"), F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_set(named)), ",").alias("items"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"), most_train=1000, least=0.8)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.language_id(table(spark, sf_dir, "documents"), learn=remainder(5) != 0, most=4000)
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0, block_words=64)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=80).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || '|' || len(w)] ELSE [] END AS s FROM w
), u AS (
  SELECT doc_id, hash(unnest(s)) AS h FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 80 * (len(x.s) + len(y.s) - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents"), least=50).drop("spans")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, k, hash(substr(h, CAST(2 * k + 1 AS BIGINT), 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS k FROM d)
), f AS (
  SELECT s, min(doc_id) AS first FROM w GROUP BY 1
), r AS (
  SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (s) WHERE first < doc_id
), i AS (
  SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM r
), s AS (
  SELECT doc_id, min(k) AS a, max(k) + 50 AS z FROM i GROUP BY doc_id, span
), t AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM s
)
SELECT doc_id, any_value(length(h) // 2) AS n_bytes, CAST(coalesce(sum(z - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans,
  sha256(unhex(coalesce(string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a), '') || substr(any_value(h), CAST(2 * coalesce(max(z), 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) GROUP BY doc_id
"""


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, cells=16, sample=4096)


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n AS q, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "archive").root
    warc.write_pages(table(spark, sf_dir, "pages"), path, shard_bytes=32 << 20, roll_bytes=8 << 20, least_bytes=0)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, octet_length(body) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


#: A round of training: pieces go to the entry of least distance (then least index), entries become the floor of the mean.
OP11_ROUND = """, a{k} AS (
  SELECT n, part, min(d * 64 + entry) AS best FROM (
    SELECT p.n, p.part, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{k} c USING (part)
  ) GROUP BY n, part
)"""
OP11_MEANS = """, s{k} AS (
  SELECT part, entry, i, sum(x)::BIGINT AS s, count(*) AS m FROM (SELECT p.part, CAST(a.best % 64 AS BIGINT) AS entry, unnest(p.x) AS x, unnest(range(len(p.x))) AS i FROM p JOIN a{j} a USING (n, part)) GROUP BY ALL
), c{k} AS (
  SELECT c.part, c.entry, coalesce(f.x, c.x) AS x FROM c{j} c LEFT JOIN (SELECT part, entry, list((s - ((s % m) + m) % m) // m ORDER BY i) AS x FROM s{k} GROUP BY part, entry) f ON f.part = c.part AND f.entry = c.entry
)"""
OP11_SQL = (
    """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT n, part, e[CAST(part * (len(e) // 16) + 1 AS BIGINT) : CAST((part + 1) * (len(e) // 16) AS BIGINT)] AS x FROM v, range(16) r(part)
), f AS (
  SELECT n, row_number() OVER (ORDER BY vec_id, n) - 1 AS entry FROM v QUALIFY entry < 64
), c0 AS (
  SELECT p.part, f.entry, p.x FROM p JOIN f USING (n)
)"""
    + OP11_ROUND.format(k=0) + OP11_MEANS.format(j=0, k=1) + OP11_ROUND.format(k=1) + OP11_MEANS.format(j=1, k=2) + OP11_ROUND.format(k=2)
    + """, h AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) AS sha FROM (SELECT part, entry, unnest(x) AS x, unnest(range(len(x))) AS i FROM c2)
), o AS (
  SELECT n, string_agg(printf('%02x', CAST(best % 64 AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY n
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM v JOIN o USING (n), h
"""
)


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP12_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, {OP12_TERMS} AS w FROM documents
), d AS (
  SELECT r, doc_id, len(w) AS n FROM t WHERE len(w) > 0
), c AS (
  SELECT count(*) AS n, sum(n)::BIGINT AS l FROM d
), f AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY ALL
), g AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * c.n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, c GROUP BY term, c.n
), i AS (
  SELECT k, item_id, unnest(list_distinct(w)) AS term FROM (SELECT row_number() OVER () AS k, item_id, {OP12_TERMS} AS w FROM benchmark)
), s AS (
  SELECT k, item_id, doc_id, d.r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * d.n * c.n) // c.l)))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN g USING (term) JOIN d USING (r), c GROUP BY k, item_id, doc_id, d.r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup(table(spark, sf_dir, "documents"), least=50).drop("spans")


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), k AS (
  SELECT r, doc_id, k, hash(array_to_string(w[k + 1 : k + 50], ' ')) AS s FROM (SELECT r, doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) AS k FROM d)
), f AS (
  SELECT s, min(doc_id) AS first FROM k GROUP BY 1
), n AS (
  SELECT r, k, CASE WHEN k - lag(k) OVER (PARTITION BY r ORDER BY k) <= 50 THEN 0 ELSE 1 END AS new FROM k JOIN f USING (s) WHERE first < doc_id
), i AS (
  SELECT r, k, sum(new) OVER (PARTITION BY r ORDER BY k) AS span FROM n
), s AS (
  SELECT r, min(k) AS a, max(k) + 50 AS z FROM i GROUP BY r, span
), t AS (
  SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM s
), g AS (
  SELECT r, sum(z - a) AS gone, max(z) AS z, flatten(list(w[p + 1 : a] ORDER BY a)) AS w FROM t JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN d.w ELSE list_concat(g.w, d.w[g.z + 1 :]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_decontaminate, op3_pii, op4_language, op5_mixing, op6_sharding, op7_jaccard, op8_repeats, op9_topk, op10_warc, op11_codes, op12_ranking, op13_passages)}


def oracle_sql() -> dict[str, str]:
    return {"op7_jaccard": OP7_SQL, "op8_repeats": OP8_SQL, "op9_topk": OP9_SQL, "op10_warc": OP10_SQL, "op11_codes": OP11_SQL, "op12_ranking": OP12_SQL, "op13_passages": OP13_SQL}
