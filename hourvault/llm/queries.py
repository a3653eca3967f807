"""Queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hourvault.llm import (
    cotraining, decontaminate, extract, infill, jaccard, language, packing, personal, sharding, spelling, token_store, toxicity, voronoi,
)
from hourvault.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_table(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Words and windows of both tables; positions of windows in documents; then words inside any of them.
_OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, list_aggregate(w[p : p + least(len(w), 10) - 1], 'string_agg', ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, p, m, list_aggregate(w[p : p + m - 1], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p
        FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hits AS (SELECT DISTINCT doc_id, p, dw.m, item FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
words AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS s
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  coalesce(items.s, sha256('')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query(_OP10_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


#: Sets of n-grams, pairs by shared n-grams, and components over links.
_OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[p : p + 3], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.node WHERE r.c < e.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(c) AS c FROM r GROUP BY node) c USING (doc_id)
"""


@query(_OP8_SQL)
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"))[0]


#: A row's shard is its shortest hash prefix whose rows fit the limit.
_OP9_SQL = """
WITH h AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT d, h >> (60 - d) AS q, sum(n_bytes) AS b, count(*) AS r FROM h, range(0, 61) t(d) GROUP BY ALL),
f AS (
  SELECT doc_id, n_bytes, h, min(d) AS d FROM h JOIN s ON s.q = h.h >> (60 - s.d) AND s.b <= 1048576 GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN f.d = 0 THEN '' ELSE lpad(bin(s.q), CAST(f.d AS INTEGER), '0') END AS shard,
  CAST(f.d AS INTEGER) AS depth, CAST(s.b AS BIGINT) AS shard_bytes, s.r AS shard_rows
FROM f JOIN s ON s.d = f.d AND s.q = f.h >> (60 - f.d)
"""


@query(_OP9_SQL)
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


_OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query(_OP5_SQL)
def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_inner_products(table(spark, sf_dir, "embeddings"))


@query()
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.fit(documents))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


@query()
def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract.extract(pages, extract.fit(pages))


@query()
def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return cotraining.score(documents, cotraining.fit(documents, table(spark, sf_dir, "labels")))


#: Cuts by rank over code points; a text is put together again from its own output.
_OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS u, CAST('0x' || h[25:32] AS BIGINT) % 100 AS v FROM d),
c AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>')
    OR contains(t, '<M>') OR u >= 90 THEN 'plain' WHEN v < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a)
    || '<M>' || substring(t, a + 1, b - a) ELSE '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>'
    || substring(t, a + 1, b - a) END AS o FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""


@query(_OP11_SQL)
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(table(spark, sf_dir, "documents")))


@query()
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query()
def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(personal.find_personal(table(spark, sf_dir, "documents")))
