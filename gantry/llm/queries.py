"""Queries of the llm problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.conversations import channel_threads, rebuild_conversations
from gantry.llm.docs import code_pairs, documented_functions
from gantry.llm.mixing import mix_sources, size_sources
from gantry.llm.packing import pack_documents, packing_report
from gantry.llm.parsing import parse_files, parse_rates
from gantry.llm.provenance import mark_files, provenance_report
from gantry.llm.ranking import INDIFFERENT, STRICT, outranking
from gantry.llm.spam import _LINK, COLLOCATION_PAIRS, DEVIATIONS, FEW, LEAST_BIN, LEAST_GAP, LEAST_PAIRS, MARKED_DEVIATIONS, MARKED_SHARE, MOST_BIN, ONE_COLLOCATION, UNSEEN, judge_pages
from gantry.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return documented_functions(table(spark, folder, "source_text"), signatures=False).select("repository_id", "node_id", "start_line")


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Code-description pairs: symbol, signature, lines, code and documentation of each function."""
    return code_pairs(table(spark, folder, "source_text"))


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    return mark_files(table(spark, folder, "source_text"), table(spark, folder, "external_systems"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).filter("generated or minified or vendored or data").select("repository_id", "node_id")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return provenance_report(_marked(spark, folder), table(spark, folder, "graph_nodes"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return parse_files(table(spark, folder, "source_text")).filter("has_error").select("repository_id", "node_id")


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    return parse_rates(parse_files(table(spark, folder, "source_text")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return rebuild_conversations(table(spark, folder, "chat_messages"), table(spark, folder, "chat_conversations")).select("conversation_id", "turn_no", "message_id")


def p6_threads(spark: SparkSession, folder: str) -> DataFrame:
    """Threads found in each repository's interleaved messages without their conversation ids."""
    return channel_threads(table(spark, folder, "chat_messages"), table(spark, folder, "chat_conversations"))


def p7_rank(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "graph_nodes").filter("node_type = 'file'")
    columns = ["pagerank", "betweenness", "symbol_count"]
    # duplicate rows count once; of several rows of one key the latest
    one = nodes.groupBy("repository_id", "node_id").agg(F.max_by(F.struct(*columns), F.struct("created_at", F.xxhash64(*columns))).alias("x")).select("repository_id", "node_id", "x.*")
    return outranking(one, ["repository_id", "node_id"], "repository_id", {"pagerank": 1.0, "betweenness": 1.0, "symbol_count": 1.0})


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    windows = [(r["window_name"], r["capacity_tokens"]) for r in table(spark, folder, "pack_windows").distinct().orderBy("window_name").collect()]
    return pack_documents(table(spark, folder, "documents"), windows)


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing_report(_packed(spark, folder), table(spark, folder, "pack_windows"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """A mix as large as all documents, whose shares meet the targets as far as the repeats permit."""
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), full=True)[0]


def p9_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The largest mix that meets every target share exactly."""
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached by the exact mix and by one as large as all documents."""
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    sized = size_sources(documents, targets)
    exact, full = (mix_sources(documents, targets, full=f, sized=sized)[1].withColumn("budget_kind", F.lit(k)) for f, k in ((False, "exact"), (True, "full")))
    return exact.unionByName(full)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return judge_pages(table(spark, folder, "documents").select("doc_id", "text")).filter("spam").select("doc_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Information, repetition and list shares of every page, with the verdict."""
    scores = judge_pages(table(spark, folder, "documents").select("doc_id", "text"))
    return scores.select("doc_id", "pairs", "word_pairs", *[F.round(c, 6).alias(c) for c in ("normalised", "gap", "deviation", "repeated")], "spam")


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p2_found": p2_found, "p2_report": p2_report, "p4_found": p4_found, "p4_rates": p4_rates, "p6_found": p6_found, "p6_threads": p6_threads, "p7_rank": p7_rank, "p8_pack": p8_pack, "p8_report": p8_report, "p9_mix": p9_mix, "p9_exact": p9_exact, "p9_shares": p9_shares, "p10_found": p10_found, "p10_scores": p10_scores}

_P6 = r"""
WITH m AS (SELECT DISTINCT id, conversation_id, role, content_json, created_at FROM chat_messages WHERE conversation_id IS NOT NULL),
r AS (SELECT *, CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai') THEN 'assistant' WHEN lower(trim(role)) = 'system' THEN 'system' END AS who,
  CASE WHEN ltrim(content_json) LIKE '{%' AND json_valid(content_json) THEN content_json::JSON END AS j FROM m),
c AS (SELECT *, CASE WHEN j IS NULL THEN content_json ELSE j->>'text' END AS text, CASE WHEN j IS NULL THEN 0 ELSE coalesce(json_array_length(j, '$.tool_calls'), 0) END AS calls,
  CASE WHEN j IS NULL THEN 0 ELSE coalesce(len(list_filter(j->>'$.tool_calls[*].result', lambda x: x IS NOT NULL)), 0) END AS results FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at NULLS LAST, CASE who WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END, id) AS turn_no,
  count(*) FILTER (who = 'system') OVER (PARTITION BY conversation_id) AS systems, count(*) OVER (PARTITION BY conversation_id) AS n FROM c),
k AS (SELECT conversation_id FROM o GROUP BY conversation_id HAVING bool_and(coalesce(created_at IS NOT NULL AND who IS NOT NULL AND (trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' OR (who = 'assistant' AND calls > 0)) AND calls = results
  AND CASE WHEN turn_no <= systems THEN who = 'system' WHEN (turn_no - systems) % 2 = 1 THEN who = 'user' ELSE who = 'assistant' END, false)) AND max(n - systems) >= 2 AND max(n - systems) % 2 = 0)
SELECT conversation_id, turn_no::INT AS turn_no, id AS message_id FROM o WHERE conversation_id IN (SELECT conversation_id FROM k) AND conversation_id IN (SELECT id FROM chat_conversations)
"""

_P7 = f"""
WITH f AS (SELECT DISTINCT repository_id, node_id, pagerank, betweenness, symbol_count FROM graph_nodes WHERE node_type = 'file'),
l AS (SELECT * FROM (SELECT repository_id, node_id, 'p' AS metric, pagerank AS v FROM f UNION ALL SELECT repository_id, node_id, 'b', betweenness FROM f UNION ALL SELECT repository_id, node_id, 's', symbol_count FROM f) WHERE v IS NOT NULL AND NOT isnan(v)),
p AS (SELECT *, (2 * (rank() OVER (PARTITION BY repository_id, metric ORDER BY v) - 1) + count(*) OVER (PARTITION BY repository_id, metric, v)) / (2.0 * count(*) OVER (PARTITION BY repository_id, metric)) AS at_pct FROM l),
u AS (SELECT a.repository_id, a.node_id, a.metric, sum(greatest(0, least(1, (a.at_pct - b.at_pct - {INDIFFERENT}) / {STRICT - INDIFFERENT})) - greatest(0, least(1, (b.at_pct - a.at_pct - {INDIFFERENT}) / {STRICT - INDIFFERENT}))) / greatest(count(*) - 1, 1) AS flow
  FROM p a JOIN p b ON a.repository_id = b.repository_id AND a.metric = b.metric GROUP BY ALL),
o AS (SELECT a.repository_id, a.node_id, a.metric, sum(greatest(0, least(1, (a.at_pct - b.at_pct - {INDIFFERENT}) / {STRICT - INDIFFERENT})) - greatest(0, least(1, (b.at_pct - a.at_pct - {INDIFFERENT}) / {STRICT - INDIFFERENT}))) / greatest(count(*) - 1, 1) AS flow
  FROM p a JOIN p b ON a.metric = b.metric GROUP BY ALL),
us AS (SELECT repository_id, node_id, sum(flow) / 3 AS flow FROM u GROUP BY ALL), os AS (SELECT repository_id, node_id, sum(flow) / 3 AS flow FROM o GROUP BY ALL),
j AS (SELECT f.*, round(coalesce(us.flow, 0), 9) + 0 AS flow, round(coalesce(os.flow, 0), 9) + 0 AS overall_flow FROM f LEFT JOIN us USING (repository_id, node_id) LEFT JOIN os USING (repository_id, node_id))
SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY flow DESC, repository_id, node_id) AS unit_rank, row_number() OVER (ORDER BY overall_flow DESC, repository_id, node_id) AS overall_rank FROM j
"""

_P10 = f"""
WITH d AS (SELECT doc_id, text, md5(text) AS h FROM documents), t AS (SELECT DISTINCT h, text FROM d WHERE text IS NOT NULL),
w AS (SELECT h, regexp_extract_all(regexp_replace(lower(regexp_replace(text, '<[^>\n]*>', ' ', 'g')), '{_LINK.replace("++", "+")}', ' ' || chr(1) || ' ', 'g'), '\x01|#[\\p{{L}}\\p{{N}}_]+|[\\p{{L}}\\p{{N}}_]+') AS w FROM t),
m AS (SELECT h, list_transform(w, lambda x: CASE WHEN starts_with(x, '#') THEN chr(2) WHEN regexp_matches(x, '^\\p{{N}}') THEN chr(3) ELSE x END) AS w FROM w),
p AS (SELECT h, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM m WHERE len(w) > 1),
r AS (SELECT h, x, y, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT x, y, sum(n) AS c FROM r GROUP BY ALL),
cx AS (SELECT x, sum(c) AS cx FROM c GROUP BY ALL), cy AS (SELECT y, sum(c) AS cy FROM c GROUP BY ALL), tot AS (SELECT sum(c) AS m FROM c),
s AS (SELECT r.*, NOT (ord(r.x) < 4 OR ord(r.y) < 4) AS word, greatest(c - n, 0) + {UNSEEN} AS o, cx::DOUBLE AS cx, cy::DOUBLE AS cy, m::DOUBLE AS m FROM r JOIN c USING (x, y) JOIN cx USING (x) JOIN cy USING (y), tot),
f AS (SELECT h, sum(n)::BIGINT AS pairs, coalesce(sum(n) FILTER (word), 0)::BIGINT AS word_pairs, sum(n * ln(o * m / (cx * cy)) / -ln(o / m)) FILTER (word) / sum(n) FILTER (word) AS normalised, max(n) / sum(n) AS repeated FROM s GROUP BY ALL),
z AS (SELECT *, CASE WHEN word_pairs > 0 THEN greatest(least(floor(log2(word_pairs)), {MOST_BIN}), {LEAST_BIN}) END AS size FROM f),
j AS (SELECT * FROM z WHERE pairs >= {LEAST_PAIRS} AND size IS NOT NULL),
b AS (SELECT size, count(*) >= {FEW} AS enough, CASE WHEN count(*) >= {FEW} THEN quantile_disc(normalised, 0.5) ELSE (SELECT quantile_disc(normalised, 0.5) FROM j) END AS median FROM j GROUP BY size),
a AS (SELECT j.size, enough, abs(normalised - median) AS away FROM j JOIN b USING (size)),
k AS (SELECT size, 1.4826 * CASE WHEN any_value(enough) THEN quantile_disc(away, 0.5) ELSE (SELECT quantile_disc(away, 0.5) FROM a) END AS deviation FROM a GROUP BY size),
v AS (SELECT z.*, median - normalised AS gap, deviation FROM z LEFT JOIN b USING (size) LEFT JOIN k USING (size))
SELECT doc_id, coalesce(pairs, 0) AS pairs, coalesce(word_pairs, 0) AS word_pairs, round(normalised, 6) AS normalised, round(gap, 6) AS gap, round(deviation, 6) AS deviation, round(repeated, 6) AS repeated,
  coalesce(pairs >= {LEAST_PAIRS} AND (coalesce(gap > {LEAST_GAP} AND gap > deviation * CASE WHEN 1 - word_pairs / pairs > {MARKED_SHARE} THEN {MARKED_DEVIATIONS} ELSE {DEVIATIONS} END, false) OR (repeated > {ONE_COLLOCATION} AND pairs >= {COLLOCATION_PAIRS})), false) AS spam
FROM d LEFT JOIN v USING (h)
"""

#: The others can't be said in SQL; tests compare them with brute force.
SQL: dict[str, str] = {"p6_found": _P6, "p7_rank": _P7, "p10_scores": _P10, "p10_found": f"SELECT doc_id FROM ({_P10}) WHERE spam"}
