"""Queries for summaries, percentiles, orders and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.functions.predicates import risk_type, risk_velocity, stem
from gantry.operators import history as H
from gantry.operators import summary as S
from gantry.plans import health as HP
from gantry.plans import history as P
from gantry.sources.frames import SQL as FRAMES
from gantry.sources.frames import changes, commits
from gantry.sources.tables import table


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text", "source")


def _texts(spark, folder):
    return table(spark, folder, "source_text").select(F.col("repository_id").alias("scope"), F.col("node_id").alias("file"), "text")


def _activity(spark, folder):
    return H.file_activity(changes(spark, folder))


def _owners(spark, folder):
    return H.ownership(changes(spark, folder), commits(spark, folder))


def _events(spark, folder):
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def entropy_percentile(spark, folder):
    return S.rank_share(H.change_entropy(changes(spark, folder), commits(spark, folder)), "path", "entropy")


def strict_percentile(spark, folder):
    return S.strict_percentile(_activity(spark, folder), "path", "commits")


def risk_cuts(spark, folder):
    """The least risk score at the percentiles 50, 80, 90 and 99."""
    return S.percentile_cut(P.risk_percentile(spark, folder), "risk", "percentile", [50, 80, 90, 99])


def order_page(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return S.paged(o, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 40, 20)


def findings_in_rounds(spark, folder):
    return S.spread_over_files(HP.biomarkers(spark, folder).select("path", "finding", "severity"), ["path", "finding"]).select("path", "finding", "severity", "place")


def change_sources(spark, folder):
    """Paths of returned, discounted and other lines; a path of several kinds counts for the first."""
    x = table(spark, folder, "lineitem").withColumnRenamed("l_partkey", "path")
    return S.first_mention([("returned", x.filter("l_returnflag = 'R'")), ("discounted", x.filter("l_discount > 0.05")), ("other", x)], "path")


def retired_pairs(spark, folder):
    """Pairs of path and supplier of the first years that the last don't have."""
    x = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("supplier"), F.year("l_shipdate").alias("y"))
    return S.retired(x.filter("y <= 1996"), x.filter("y > 1996"), ["path", "supplier"])


def knowledge_map(spark, folder):
    return S.knowledge_map(_owners(spark, folder))


def owner_profiles(spark, folder):
    return S.owner_profiles(changes(spark, folder), commits(spark, folder))


def module_composite(spark, folder):
    a = _activity(spark, folder).select("path", "idle_days", ((F.col("c90") >= 8) | ((F.col("c90") >= 3) & (F.col("temporal") >= 0.5))).alias("hot"))
    brand = table(spark, folder, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("module"))
    return S.module_composite(_owners(spark, folder).select("path", "owner_share", "bus_factor").join(a, "path").join(brand, "path"))


def commit_fix_density(spark, folder):
    return S.fix_density(changes(spark, folder), H.fix_history(changes(spark, folder), commits(spark, folder)))


def price_estimates(spark, folder):
    return S.price_estimates(_events(spark, folder), "event_type", "value")


def read_amplification(spark, folder):
    return S.amplification(_events(spark, folder), "user_id", "view", "click")


def repeated_reads(spark, folder):
    return S.repeats(_events(spark, folder).filter("event_type = 'view'").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["user_id", "day"])


def rationale_comments(spark, folder):
    return S.rationale_comments(_texts(spark, folder))


def reversals(spark, folder):
    return S.reversals(_docs(spark, folder))


def opening_frames(spark, folder):
    return S.opening_frames(_docs(spark, folder), "source")


def capped_lines(spark, folder):
    return S.capped_lines(_docs(spark, folder))


def line_classes(spark, folder):
    return S.line_classes(_docs(spark, folder))


def vocabulary(spark, folder):
    return S.vocabulary(_docs(spark, folder), "source")


def symbol_matches(spark, folder):
    return S.symbol_matches(table(spark, folder, "wiki_symbols").filter("name is not null"), ["frozen", "interval"])


def risk_types(spark, folder):
    """Paths by the kind of risk they carry; the number of suppliers stands in for dependents."""
    a = _activity(spark, folder).select("path", "c90", "c30", "commits", "temporal")
    share = S.rank_share(a, "path", "temporal", "churn_pct").select("path", "churn_pct")
    fixes = H.fix_history(changes(spark, folder), commits(spark, folder)).select("path", "prior_defects", "bug_magnet")
    used = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.countDistinct("l_suppkey").alias("dependents"))
    x = _owners(spark, folder).select("path", "bus_factor").join(a, "path").join(share, "path").join(fixes, "path").join(used, "path")
    kind = risk_type(F.col("bug_magnet"), F.col("prior_defects"), F.col("churn_pct"), F.col("bus_factor"), F.col("commits"), F.col("dependents"), F.lit(False), F.col("c90") >= 8)
    return x.select("path", kind.alias("risk"), risk_velocity(F.col("c30"), F.col("c90")).alias("velocity"))


def word_stems(spark, folder):
    """The words of stored documentation and their stems."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("docstring"), F.lit("[a-z]+"), F.lit(0)))
    return table(spark, folder, "wiki_symbols").filter("docstring is not null").select(F.explode(words).alias("word")).distinct().select("word", stem(F.col("word")).alias("stem"))


QUERIES = {q.__name__: q for q in (entropy_percentile, strict_percentile, risk_cuts, order_page, findings_in_rounds, change_sources, retired_pairs, knowledge_map, owner_profiles, module_composite, commit_fix_density, price_estimates, read_amplification, repeated_reads, rationale_comments, reversals, opening_frames, capped_lines, line_classes, vocabulary, symbol_matches, risk_types, word_stems)}

_C = f"{FRAMES['commits']}, {FRAMES['changes']}"
_RE = lambda p: p.replace("(?i)", "")
SQL = {
    "entropy_percentile": f"WITH e AS ({P.SQL['change_entropy'].replace('supplies', 'changes').replace('l_suppkey', 'l_partkey')}) SELECT path, entropy, CASE WHEN entropy > 0 THEN round((row_number() OVER (PARTITION BY entropy > 0 ORDER BY entropy, path) - 1) / count(*) OVER (PARTITION BY entropy > 0), 6) ELSE 0 END AS percentile FROM e",
    "strict_percentile": "WITH a AS (SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY ALL) SELECT path, commits, floor(100 * (rank() OVER (ORDER BY commits) - 1) / count(*) OVER () + 0.5)::INT AS percentile FROM a",
    "risk_cuts": f"WITH r AS ({P.SQL['risk_percentile']}) SELECT cut::DOUBLE AS cut, min(risk) FILTER (percentile >= cut) AS risk FROM r, (VALUES (50), (80), (90), (99)) c(cut) GROUP BY cut",
    "order_page": "SELECT o_orderkey, o_orderdate, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    "findings_in_rounds": f"WITH b AS (SELECT path, finding, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS s FROM ({HP.SQL['biomarkers']})), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s, path, finding) AS rnd FROM b) SELECT path, finding, severity, row_number() OVER (ORDER BY rnd, s, path, finding) AS place FROM r",
    "change_sources": "SELECT l_partkey AS path, CASE WHEN bool_or(l_returnflag = 'R') THEN 'returned' WHEN bool_or(l_discount > 0.05) THEN 'discounted' ELSE 'other' END AS source FROM lineitem GROUP BY ALL",
    "retired_pairs": "SELECT l_partkey AS path, l_suppkey AS supplier FROM lineitem WHERE year(l_shipdate) <= 1996 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE year(l_shipdate) > 1996",
    "knowledge_map": f"SELECT owner, count(*) AS files, count(*) FILTER (owner_share > 0.8) AS silos FROM ({P.SQL['ownership']}) GROUP BY ALL ORDER BY files DESC, owner LIMIT 10",
    "owner_profiles": f"WITH {_C}, x AS (SELECT c.*, author FROM changes c JOIN commits USING (sha)), m AS (SELECT path, author, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT path, count(*) AS total, sum(added + deleted) AS lines FROM x GROUP BY ALL) SELECT author, count(*) AS files, sum(n)::BIGINT AS commits, round(sum(lines * n / total), 3) AS lines FROM m JOIN t USING (path) GROUP BY ALL",
    "module_composite": f"WITH o AS ({P.SQL['ownership']}), a AS ({P.SQL['file_activity']}), x AS (SELECT p_brand AS module, (owner_share > 0.8)::INT AS silo, (c90 >= 8 OR (c90 >= 3 AND temporal >= 0.5))::INT AS hot, (idle_days > 365)::INT AS idle, CASE WHEN bus_factor >= 3 THEN 1 WHEN bus_factor = 1 THEN -1 ELSE 0 END AS bus FROM o JOIN a USING (path) JOIN part ON p_partkey = path) SELECT module, count(*) AS files, round(greatest(0, least(100, 100 - 25 * avg(silo) - 20 * avg(hot) - 25 * avg(idle) + 10 * avg(bus))), 4) AS health FROM x GROUP BY ALL",
    "commit_fix_density": f"WITH f AS (SELECT path, fix_share FROM ({P.SQL['fix_history']})), {FRAMES['changes']} SELECT sha, round(sum((added + deleted) * fix_share) / sum(added + deleted), 4) AS density FROM changes JOIN f USING (path) GROUP BY ALL",
    "price_estimates": "SELECT event_type, count(*) AS n, round(count(*) * quantile_cont(value, 0.1), 4) AS low, round(count(*) * quantile_cont(value, 0.5), 4) AS median, round(count(*) * quantile_cont(value, 0.9), 4) AS high FROM events GROUP BY ALL",
    "read_amplification": "WITH s AS (SELECT user_id, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS r, sum(value) FILTER (event_type = 'click') AS w FROM events GROUP BY ALL) SELECT count(*) AS sessions, round(quantile_cont(r / w, 0.5), 6) AS amplification FROM s WHERE w > 0",
    "repeated_reads": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS times, round(sum(value) - max(value), 4) AS avoidable FROM events WHERE event_type = 'view' GROUP BY ALL HAVING count(*) > 1",
    "rationale_comments": rf"WITH x AS (SELECT DISTINCT repository_id AS scope, node_id AS file, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\s*(#|//)')) AS c FROM source_text WHERE text IS NOT NULL) SELECT DISTINCT scope, file, len(c) AS comments, len(list_filter(c, lambda l: regexp_matches(l, '{_RE(S.REASONS)}', 'i'))) AS reasons FROM x WHERE len(list_filter(c, lambda l: regexp_matches(l, '{_RE(S.REASONS)}', 'i'))) > 0",
    "reversals": rf"SELECT doc_id, len(regexp_extract_all(text, '(?i){_RE(S.REVERSALS)}')) AS signals FROM documents WHERE len(regexp_extract_all(text, '(?i){_RE(S.REVERSALS)}')) > 0",
    "opening_frames": r"WITH x AS (SELECT source, array_to_string(list_slice(regexp_extract_all(regexp_replace(lower(text), '\d+', 'n', 'g'), '[a-z]+'), 1, 3), ' ') AS frame FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) SELECT source, frame, count(*) AS uses FROM x WHERE frame <> '' GROUP BY ALL HAVING count(*) > 1",
    "capped_lines": rf"WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, len(l) AS lines, list_filter(l, lambda x, i: i <= 5 OR i > len(l) - 5 OR regexp_matches(x, '{_RE(S.ERRORS)}', 'i')) AS kept FROM x) SELECT doc_id, lines, len(kept) AS kept, md5(array_to_string(kept, chr(10))) AS digest FROM k",
    "line_classes": rf"WITH x AS (SELECT unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL) SELECT CASE WHEN trim(x) = '' THEN 'blank' WHEN regexp_matches(x, '^#{{1,6}} ') THEN 'heading' WHEN regexp_matches(x, '^\s*([-*+]|\d+\.) ') THEN 'bullet' WHEN regexp_matches(x, '^(@@|\+\+\+|---) ') THEN 'diff' WHEN regexp_matches(x, '{_RE(S.ERRORS)}', 'i') THEN 'error' WHEN regexp_matches(x, '^\s*\|.*\|\s*$') THEN 'table' WHEN regexp_matches(x, '^(    |\t|```)') THEN 'code' ELSE 'prose' END AS class, count(*) AS lines FROM x GROUP BY ALL",
    "vocabulary": "WITH w AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS word FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), c AS (SELECT source, word, count(*) AS texts FROM w GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source ORDER BY texts DESC, word) AS place FROM c QUALIFY place <= 20",
    "symbol_matches": r"WITH h AS (SELECT DISTINCT symbol_id, name, list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> '') AS h FROM wiki_symbols WHERE name IS NOT NULL), s AS (SELECT symbol_id, name, round(len(list_intersect(['frozen', 'interval'], h)) / 2 + CASE WHEN h = ['frozen', 'interval'] THEN 1 ELSE 0 END, 6) AS score FROM h) SELECT * FROM s WHERE score > 0",
    "risk_types": f"WITH a AS ({P.SQL['file_activity']}), s AS (SELECT path, CASE WHEN temporal > 0 THEN round((row_number() OVER (PARTITION BY temporal > 0 ORDER BY temporal, path) - 1) / count(*) OVER (PARTITION BY temporal > 0), 6) ELSE 0 END AS churn_pct FROM a), o AS (SELECT path, bus_factor FROM ({P.SQL['ownership']})), f AS (SELECT path, prior_defects, bug_magnet FROM ({P.SQL['fix_history']})), u AS (SELECT l_partkey AS path, count(DISTINCT l_suppkey) AS dependents FROM lineitem GROUP BY ALL) SELECT path, CASE WHEN bug_magnet OR prior_defects >= 3 THEN 'bug-prone' WHEN churn_pct >= 0.7 THEN 'churn-heavy' WHEN bus_factor = 1 AND commits > 20 THEN 'bus-factor-risk' WHEN dependents >= 5 THEN 'high-coupling' ELSE 'stable' END AS risk, CASE WHEN c90 = 0 THEN 'stable' WHEN c90 = c30 THEN CASE WHEN c30 > 0 THEN 'increasing' ELSE 'stable' END WHEN (c30 / 30.0) / ((c90 - c30) / 60.0) > 1.5 THEN 'increasing' WHEN (c30 / 30.0) / ((c90 - c30) / 60.0) < 0.5 THEN 'decreasing' ELSE 'stable' END AS velocity FROM a JOIN s USING (path) JOIN o USING (path) JOIN f USING (path) JOIN u USING (path)",
    "word_stems": "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(docstring), '[a-z]+')) AS word FROM wiki_symbols WHERE docstring IS NOT NULL) SELECT word, CASE WHEN regexp_matches(word, '(ies|ss)$') THEN word WHEN len(word) > 4 AND regexp_matches(word, '(ches|shes|sses|xes|zes|ses)$') THEN word[:-3] WHEN len(word) > 3 AND word LIKE '%s' THEN word[:-2] ELSE word END AS stem FROM w",
}
