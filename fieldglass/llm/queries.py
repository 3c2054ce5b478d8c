"""The opN_ queries over the supplied tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.exact_dedup import exact_groups
from fieldglass.llm.language_id import learn_and_identify
from fieldglass.llm.media import text_media
from fieldglass.llm.mixing import mix_sources
from fieldglass.llm.near_dedup import near_duplicates
from fieldglass.llm.packing import pack
from fieldglass.llm.repeats import repeated_passages
from fieldglass.llm.token_shards import token_shards
from fieldglass.llm.toxicity import learn_and_score
from fieldglass.llm.url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_identify(_table(spark, sf_dir, "documents"), parts=4, part=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), parts=3, part=1)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    """Where the box keeps the tokenizer file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), word_tokenizer(), end_id=2)


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(_table(spark, sf_dir, "documents"), word_tokenizer(), end_id=1).drop("ids_head")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_media": op2_media,
        "op3_language_id": op3_language_id,
        "op4_toxicity": op4_toxicity,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_repeats": op6_repeats,
        "op7_packing": op7_packing,
        "op8_url_filter": op8_url_filter,
        "op9_mixing": op9_mixing,
        "op10_token_shards": op10_token_shards,
    }


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY size DESC, doc_id NULLS LAST) AS keep_id FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

OP8_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(action, rule, rhost, rpath) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com',
 '/en/'),
         ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), fit AS (
  SELECT p.*, r.action, r.rule, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule,
  CASE WHEN action IS NOT NULL THEN action
    WHEN regexp_matches(lower(url), '(^|[^a-z0-9])casino([^a-z0-9])museum([^a-z0-9]|$)') THEN 'allow'
    WHEN regexp_matches(lower(url), '(^|[^a-z0-9])(spam-farm|casino|click.*bait)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM fit WHERE k = 1
"""

OP9_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk, len(regexp_extract_all(coalesce(text, ''),
 '[^\x20\x09-\x0D]+')) AS size,
    length(coalesce(text, '')) AS n FROM documents
), k AS (
  SELECT *, -ln((CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), 1,
 13)) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)
    / (0.5::DOUBLE + least(n / greatest(size, 1)::DOUBLE, 8.0::DOUBLE) / 8.0::DOUBLE) AS key FROM s
), src AS (
  SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY sk
), w AS (
  SELECT *, ([3.0, 1.0, 2.0])[CAST((row_number() OVER (ORDER BY sk) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM src
), lv AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 0))
    / sum(w) OVER (ORDER BY cap / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), op AS (
  SELECT max(level) AS lvl FROM (SELECT level FROM lv WHERE level * w < cap ORDER BY cap / w, sk LIMIT 1)
), tg AS (
  SELECT sk, source_size, CASE WHEN level * w >= cap THEN cap ELSE lvl * w END AS target FROM lv, op
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM tg
), c AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS remaining,
    sum(k.size) OVER (PARTITION BY k.sk ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM k JOIN e USING (sk)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * least(2, epochs + CASE WHEN cum - size / 2.0::DOUBLE <= remaining THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""


#: Words with A-Z lower-cased, as lists.
WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

OP1_SQL = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, {WORDS_SQL} AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM t
), k AS (
  SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS key, s FROM s
), c AS (
  SELECT key, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY key
), e AS (
  SELECT id, n, unnest(s) AS x FROM c
), p AS (
  SELECT a.id AS a, b.id AS b, count(*) AS i, any_value(a.n) AS m, any_value(b.n) AS n FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id
), l AS (
  SELECT a, b FROM p WHERE 100 * i >= 75 * (m + n - i) UNION ALL SELECT b, a FROM p WHERE 100 * i >= 75 * (m + n - i)
), r(a, b) AS (
  SELECT id, id FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), h AS (
  SELECT key, min(r.b) AS home FROM c JOIN r ON r.a = c.id GROUP BY key
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n > 0 THEN home ELSE doc_id END AS component_id,
  doc_id = CASE WHEN n > 0 THEN home ELSE doc_id END AS kept FROM k LEFT JOIN h USING (key)
"""

OP6_SQL = f"""
WITH t AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS least, max(doc_id) AS most, count(*) AS copies FROM documents GROUP BY ALL
), w AS (
  SELECT md5(text) AS k, least, most, copies, {WORDS_SQL} AS w FROM t
), g AS (
  SELECT k, least, i - 1 AS start, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(w) - 48)) u(i)
), m AS (
  SELECT *, count(*) OVER (PARTITION BY h) AS n, min(least) OVER (PARTITION BY h) AS lo, max(least) OVER (PARTITION BY h) AS hi FROM g
), f AS (
  SELECT k, start, CASE WHEN lo <> least THEN lo WHEN hi <> least THEN hi END AS other,
    CASE WHEN start > lag(start) OVER (PARTITION BY k ORDER BY start) + 50 THEN 1 ELSE 0 END AS new FROM m WHERE n > 1
), r AS (
  SELECT k, start, other, sum(new) OVER (PARTITION BY k ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM f
), i AS (
  SELECT k, min(start) AS start, max(start) + 50 AS stop, min(other) AS other FROM r GROUP BY k, run
), a AS (
  SELECT k, most, len(w) AS n, 0 AS start, len(w) AS stop, least AS other FROM w WHERE copies > 1 AND len(w) >= 50
  UNION ALL SELECT k, most, len(w), start, stop, other FROM w JOIN i USING (k) WHERE copies = 1
)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", CAST(stop - start AS INTEGER) AS n_words, CAST(n AS BIGINT) AS doc_words,
  coalesce(CASE WHEN other = doc_id THEN most ELSE other END, doc_id) AS other_doc_id
FROM documents JOIN a ON a.k = md5(coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op6_repeats": OP6_SQL, "op8_url_filter": OP8_SQL, "op9_mixing": OP9_SQL,
    }
