"""Search, similarity and line queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.operators import text as T
from gantry.sources.tables import table

QUERY = ["cached", "resolver", "snapshot", "ledger"]


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text", "source")


def term_frequencies(spark, folder):
    return T.term_frequencies(_docs(spark, folder))


def bm25_search(spark, folder):
    return T.bm25(_docs(spark, folder), QUERY, 50)


def idf_relevance(spark, folder):
    return T.relevance(_docs(spark, folder), QUERY)


def secret_scan(spark, folder):
    return T.risky_lines(table(spark, folder, "source_text").select(F.concat_ws(":", "repository_id", "node_id").alias("file"), "text").distinct(), "file")


def log_templates(spark, folder):
    return T.log_templates(_docs(spark, folder).filter("source = 'issue_thread'"), "doc_id")


def substantive_text(spark, folder):
    return T.substance(_docs(spark, folder), "doc_id")


def token_savings(spark, folder):
    d = _docs(spark, folder)
    return d.filter("text is not null").select("doc_id", T.token_savings(F.col("text"), F.substring("text", 1, 400)).alias("saved"))


def quote_verify(spark, folder):
    """Every document's opening, against itself and against the next document."""
    d = _docs(spark, folder).filter("text is not null")
    opening = F.substring("text", 1, 80)
    quotes = d.select("doc_id", opening.alias("quote")).unionByName(d.select((F.col("doc_id") + 1).alias("doc_id"), opening.alias("quote")))
    return T.quote_check(quotes, _docs(spark, folder))


def jaccard_classes(spark, folder):
    return T.jaccard_classes(_docs(spark, folder))


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "embedding")


def _asked(spark, folder):
    return _vectors(spark, folder).filter("vec_id % 100 = 0")


def cosine_topk(spark, folder):
    return T.cosine_top(_asked(spark, folder), _vectors(spark, folder), 10)


def related_band(spark, folder):
    return T.cosine_top(_asked(spark, folder), _vectors(spark, folder), 25, 0.3, 0.83)


def rrf_fuse(spark, folder):
    near = T.cosine_top(_asked(spark, folder), _vectors(spark, folder), 10).groupBy(F.col("vec_id").alias("item")).agg(F.min("rank").alias("rank"))
    hits = T.bm25(_docs(spark, folder), QUERY, 50)
    ranked = hits.select(F.col("doc_id").alias("item"), F.expr("row_number() over (order by score desc, doc_id)").alias("rank"))
    return T.fuse([near, ranked], "item")


QUERIES = {f.__name__: f for f in (term_frequencies, bm25_search, idf_relevance, secret_scan, log_templates, substantive_text, token_savings, quote_verify, jaccard_classes, cosine_topk, related_band, rrf_fuse)}

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TERMS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), lambda w: len(w) > 1 AND w NOT IN ({_STOP}))"
_ASKED = ", ".join(f"'{w}'" for w in QUERY)
_BM25 = f"""WITH t AS (SELECT doc_id, {_TERMS} AS terms FROM documents), st AS (SELECT count(*) AS n, avg(len(terms)) AS avg_len FROM t),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS len, unnest(list_filter(terms, lambda w: w IN ({_ASKED}))) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
hits AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN df USING (term), st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50)"""


def _cosine(k: int, low: float, high: float) -> str:
    return f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p WHERE similarity >= {low} AND similarity < {high} QUALIFY rank <= {k})"""


def _sql_string(pattern: str) -> str:
    return pattern.replace("'", "''")


_MASKED = "content"
for _pattern, _mask in T.MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_sql_string(_pattern)}', '{_mask.replace('$1', chr(92) + '1')}', 'g')"

SQL = {
    "term_frequencies": f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TERMS}) AS term FROM documents) SELECT term, count(*) AS df, count(*) > 0.2 * (SELECT count(*) FROM documents) AS common FROM t GROUP BY term",
    "bm25_search": _BM25 + " SELECT * FROM hits",
    "idf_relevance": f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TERMS}) AS term FROM documents), f AS (SELECT * FROM t WHERE term IN ({_ASKED})), n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, n GROUP BY term), r AS (SELECT doc_id, round(sum(idf) / (SELECT sum(idf) FROM d), 6) AS relevance FROM f JOIN d USING (term) GROUP BY doc_id) SELECT * FROM r WHERE relevance >= 0.6",
    "secret_scan": "WITH l AS (SELECT DISTINCT repository_id || ':' || node_id AS file, text FROM source_text), p AS (SELECT file, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM l) " + " UNION ALL ".join(f"SELECT file, line, '{k}' AS kind, '{s}' AS severity, substr(trim(content, ' '), 1, 120) AS snippet FROM p WHERE regexp_matches(content, '{_sql_string(r)}')" for k, s, r in T.RISKS),
    "log_templates": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE source = 'issue_thread') SELECT doc_id, {_MASKED} AS template, count(*) AS n, min(pos) AS first FROM l WHERE len(trim(content, ' ')) > 0 GROUP BY ALL",
    "substantive_text": r"WITH b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(?s)```.*?(```|\z)', '', 'g') AS t FROM documents), k AS (SELECT doc_id, coalesce(list_sum([len(trim(x, ' ')) FOR x IN string_split(t, chr(10)) IF NOT regexp_matches(x, '^\s*(#|\||\*[^*]+\*\s*$)') AND len(trim(x, ' ')) > 0]), 0) AS kept_chars FROM b) SELECT doc_id, kept_chars, kept_chars >= 60 AS substantial FROM k",
    "token_savings": "SELECT doc_id, CASE WHEN len(text) // 4 > 0 THEN greatest(0, round(100.0 * (len(text) // 4 - least(len(text), 400) // 4) / (len(text) // 4), 2)) ELSE 0 END::DOUBLE AS saved FROM documents WHERE text IS NOT NULL",
    "quote_verify": f"""WITH q AS (SELECT doc_id, substr(text, 1, 80) AS quote FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id + 1, substr(text, 1, 80) FROM documents WHERE text IS NOT NULL),
x AS (SELECT q.doc_id, quote, d.text, list_distinct({_TERMS.replace('text', 'quote')}) AS said, {_TERMS.replace('text', 'd.text')} AS words FROM q LEFT JOIN documents d ON d.doc_id = q.doc_id)
SELECT doc_id, quote, CASE WHEN text IS NULL THEN 'unverified' WHEN contains(text, quote) THEN 'exact' WHEN len(list_intersect(said, words)) / greatest(len(said), 1) >= 0.6 THEN 'fuzzy' ELSE 'unverified' END AS verdict FROM x""",
    "cosine_topk": _cosine(10, -1.0, 2.0) + " SELECT * FROM near",
    "related_band": _cosine(25, 0.3, 0.83) + " SELECT * FROM near",
    "rrf_fuse": _cosine(10, -1.0, 2.0) + ", " + _BM25.split("WITH ", 1)[1] + ", v AS (SELECT vec_id AS item, min(rank) AS rank FROM near GROUP BY vec_id UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) FROM hits) SELECT item, round(sum(1 / (60 + rank)), 9) AS score FROM v GROUP BY item",
}
