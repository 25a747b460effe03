"""One query per operator over its whole table; SQL twins where SQL can express the result."""
from pyspark.sql import functions as F

from fleetsieve.llm import (divergence, exact_dedup, html_extract, language_id, lexical, licenses, mixing, piece_codec, repeats, simhash,
                            token_counts, url_filter, vector_search)
from fleetsieve.llm.common import table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_mixing")
def op1_mixing(spark, sf_dir):
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), "target",
                       (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op5_license_scan")
def op5_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


@query("op6_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""")
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op7_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10""")
def op7_top_k(spark, sf_dir):
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op8_url_filter", r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM f""")
def op8_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op9_html_extract")
def op9_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op10_piece_codec")
def op10_piece_codec(spark, sf_dir):
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"))


@query("op11_suffix_dedup")
def op11_suffix_dedup(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op12_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
n AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT id) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(c) AS cl FROM n GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c, k.cl,
             sum(coalesce(n.c, 0)) OVER w AS size, sum(k.cl) OVER w AS lang_size, count(*) OVER w AS kept
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
      WINDOW w AS (PARTITION BY g.lang, g.source)),
p AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 5)::HUGEINT) // (size + 5 * kept)::HUGEINT AS p,
             1 + (1000000000 * (cl + 5)::HUGEINT) // (lang_size + 5 * kept)::HUGEINT AS q FROM x),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50""")
def op12_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query("op13_lexical_search", r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
f AS (SELECT row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
a AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM f),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM f) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t, a GROUP BY term, n_all),
m AS (SELECT row, doc_id, 100 - 50 + ((50 * n * n_all) // l_all) AS m FROM f, a),
s AS (SELECT q.item_id, t.row, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m))) AS score
      FROM q JOIN t ON q.term = t.term JOIN w ON w.term = t.term JOIN m ON m.row = t.row GROUP BY ALL)
SELECT s.item_id, CAST(row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, m.doc_id) AS INTEGER) AS rank, m.doc_id, CAST(s.score AS BIGINT) AS score
FROM s JOIN m ON s.row = m.row WHERE s.score > 0 QUALIFY rank <= 50""")
def op13_lexical_search(spark, sf_dir):
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
