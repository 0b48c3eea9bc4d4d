"""Interval, ledger, streaming and source queries, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gantry.operators import intervals as I
from gantry.operators import ledger as L
from gantry.sources import readers as R
from gantry.sources.tables import table
from gantry.streaming import twins as S


def _events(spark, folder):
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _symbols(spark, folder):
    s = table(spark, folder, "wiki_symbols").filter("start_line is not null and end_line >= start_line")
    return s.select(F.concat_ws(":", "repository_id", "file_path").alias("file"), F.col("symbol_id").alias("span_id"), F.col("start_line").alias("lo"), F.col("end_line").alias("hi")).distinct()


def _fixes(spark, folder):
    """Call sites as the lines that something was reported at."""
    e = table(spark, folder, "graph_edges").filter("edge_type = 'calls'").select("id", "repository_id", "source_node_id", F.explode("call_lines").alias("line")).distinct()
    file = F.concat_ws(":", "repository_id", F.substring_index("source_node_id", "::", 1))
    return e.select(file.alias("file"), F.concat_ws("@", "id", "line").alias("range_id"), (F.col("line") - 1).alias("rlo"), (F.col("line") + 1).alias("rhi"))


def fix_attribution(spark, folder):
    return I.innermost(I.overlaps(_symbols(spark, folder), _fixes(spark, folder), ["file"])).select("file", "range_id", "span_id")


def symbol_lines(spark, folder):
    return I.union_length(_symbols(spark, folder), "file")


def asof_latest(spark, folder):
    """Each purchase with the user's latest view or click before it."""
    e = _events(spark, folder)
    left = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.filter("event_type in ('view', 'click')").select("user_id", "ts", F.col("event_id").alias("seen"))
    return I.as_of(left, right, ["user_id"], "ts", ["seen"]).select("event_id", "user_id", "seen")


def missing_tests(spark, folder):
    """Orders as changed files and suppliers as tests: shared lines of order and supplier."""
    x = table(spark, folder, "lineitem")
    changed = x.groupBy((F.col("l_orderkey") % 500).alias("file")).agg(F.collect_set(F.col("l_partkey") % 97).alias("lines"))
    cover = x.groupBy((F.col("l_suppkey") % 40).alias("test"), (F.col("l_orderkey") % 500).alias("file")).agg(F.collect_set(F.col("l_partkey") % 97).alias("lines"))
    return I.covered_tests(changed, cover)


def cost_rollup(spark, folder):
    return L.rollup(_events(spark, folder).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day", "event_type"], "value")


def savings_rollup(spark, folder):
    return L.rollup(_events(spark, folder).withColumn("k", F.get_json_object("props", "$.k").cast("double")), ["event_type"], "k")


def session_fold(spark, folder):
    return L.sessions(_events(spark, folder), "user_id", 120).select("user_id", "session_no", "events")


def rate_limit_windows(spark, folder):
    return L.rate_windows(_events(spark, folder), "user_id", 3600, 3)


def correction_pairs(spark, folder):
    return L.followed_by(_events(spark, folder), "user_id", "error", "purchase")


def question_demand(spark, folder):
    """Per user the five commonest types of event."""
    c = _events(spark, folder).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return L.top_per_group(c, ["user_id"], [F.col("n").desc(), "event_type"], 3)


def result_budget(spark, folder):
    """Each repository's symbols in order while their lines stay within a budget."""
    s = table(spark, folder, "wiki_symbols").filter("end_line >= start_line").select("repository_id", "id", (F.col("end_line") - F.col("start_line") + 1).alias("size")).distinct()
    return L.within_budget(s, "repository_id", "size", ["id"], 400).select("repository_id", "id", "used")


def stream_tumbling(spark, folder):
    return S.drain(S.tumbling(S.read_events(spark, folder), "1 day"), "tumbling_" + uuid.uuid4().hex, "complete")


def stream_sliding(spark, folder):
    return S.drain(S.sliding(S.read_events(spark, folder), "2 days", "1 day"), "sliding_" + uuid.uuid4().hex, "complete")


def stream_deduplicated(spark, folder):
    return S.drain(S.deduplicated(S.read_events(spark, folder)), "dedup_" + uuid.uuid4().hex, "append").select("event_id", "event_type")


def stream_answered(spark, folder):
    return S.drain(S.answered(S.read_events(spark, folder), "error", "purchase"), "answered_" + uuid.uuid4().hex, "append")


def import_scan(spark, folder):
    return R.imports(table(spark, folder, "source_text").select("repository_id", "node_id", "text").distinct()).distinct()


QUERIES = {f.__name__: f for f in (fix_attribution, symbol_lines, asof_latest, missing_tests, cost_rollup, savings_rollup, session_fold, rate_limit_windows, correction_pairs, question_demand, result_budget, stream_tumbling, stream_sliding, stream_deduplicated, stream_answered, import_scan)}

_S = "s AS (SELECT DISTINCT repository_id || ':' || file_path AS file, symbol_id AS span_id, start_line AS lo, end_line AS hi FROM wiki_symbols WHERE start_line IS NOT NULL AND end_line >= start_line)"
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"

_JS = r"""(?m)^\s*(?:(?:import|export)\b[^''"`;=()]*?\bfrom\s*|import\s*)[''"]([^''"]+)[''"]|\b(?:require|import)\(\s*[''"]([^''"]+)[''"]\s*\)"""

SQL = {
    "fix_attribution": f"WITH {_S}, e AS (SELECT DISTINCT id, repository_id, source_node_id, unnest(call_lines) AS line FROM graph_edges WHERE edge_type = 'calls'), r AS (SELECT repository_id || ':' || split_part(source_node_id, '::', 1) AS file, id || '@' || line AS range_id, line - 1 AS rlo, line + 1 AS rhi FROM e), p AS (SELECT s.file, range_id, span_id, hi - lo AS size FROM s JOIN r ON r.file = s.file AND lo <= rhi AND rlo <= hi) SELECT file, range_id, span_id FROM p QUALIFY size = min(size) OVER (PARTITION BY range_id)",
    "symbol_lines": f"WITH {_S}, l AS (SELECT DISTINCT file, unnest(range(lo, hi + 1)) AS line FROM s) SELECT file, count(*) AS lines FROM l GROUP BY file",
    "asof_latest": "WITH p AS (SELECT * FROM events WHERE event_type = 'purchase') SELECT p.event_id, p.user_id, (SELECT event_id FROM events v WHERE v.user_id = p.user_id AND v.event_type IN ('view', 'click') AND v.ts <= p.ts ORDER BY v.ts DESC, event_id DESC LIMIT 1) AS seen FROM p",
    "missing_tests": "WITH c AS (SELECT DISTINCT l_orderkey % 500 AS file, l_partkey % 97 AS line FROM lineitem), t AS (SELECT DISTINCT l_suppkey % 40 AS test, l_orderkey % 500 AS file, l_partkey % 97 AS line FROM lineitem) SELECT file, test, count(*) AS shared FROM c JOIN t USING (file, line) GROUP BY ALL",
    "cost_rollup": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS entries, round(sum(coalesce(value, 0)), 4) AS total, round(avg(coalesce(value, 0)), 4) AS mean FROM events GROUP BY ALL",
    "savings_rollup": "SELECT event_type, count(*) AS entries, round(sum(coalesce(k, 0)), 4) AS total, round(avg(coalesce(k, 0)), 4) AS mean FROM (SELECT event_type, json_extract_string(props, '$.k')::DOUBLE AS k FROM events) GROUP BY ALL",
    "session_fold": f"WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER {_W}) <= 7200000000 THEN 0 ELSE 1 END AS new FROM events), y AS (SELECT user_id, sum(new) OVER {_W} AS session_no FROM x) SELECT user_id, session_no::BIGINT AS session_no, count(*) AS events FROM y GROUP BY ALL",
    "rate_limit_windows": "WITH x AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM events) SELECT * FROM x WHERE recent >= 3",
    "correction_pairs": f"WITH x AS (SELECT user_id, event_type, lead(event_type) OVER {_W} AS next FROM events) SELECT user_id, count(*) AS times FROM x WHERE event_type = 'error' AND next = 'purchase' GROUP BY user_id",
    "question_demand": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM c QUALIFY rank <= 3",
    "result_budget": "WITH s AS (SELECT DISTINCT repository_id, id, end_line - start_line + 1 AS size FROM wiki_symbols WHERE end_line >= start_line), u AS (SELECT repository_id, id, (sum(size) OVER (PARTITION BY repository_id ORDER BY id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM s) SELECT * FROM u WHERE used <= 400",
    "stream_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": "WITH x AS (SELECT date_trunc('day', ts) AS start FROM events UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY FROM events) SELECT start::TIMESTAMP AS start, count(*) AS n FROM x GROUP BY ALL",
    "stream_deduplicated": "SELECT DISTINCT event_id, event_type FROM events",
    "import_scan": r"""WITH f AS (SELECT DISTINCT repository_id, node_id, text, regexp_extract(node_id, '\.(\w+)$', 1) AS ext FROM source_text),
g AS (SELECT repository_id, node_id, unnest(string_split(text, chr(10))) AS line FROM f WHERE ext = 'go'),
x AS (SELECT repository_id, node_id, unnest(CASE WHEN ext = 'py' THEN list_concat(regexp_extract_all(text, '(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))', 1), regexp_extract_all(text, '(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))', 2))
  WHEN ext = 'java' THEN regexp_extract_all(text, '(?m)^\s*import\s+(?:static\s+)?([\w.]+)()', 1)
  WHEN ext IN ('ts', 'tsx', 'mts', 'cts', 'js', 'jsx', 'mjs', 'cjs') THEN list_concat(regexp_extract_all(text, 'JS', 1), regexp_extract_all(text, 'JS', 2)) ELSE [] END) AS module FROM f
 UNION ALL SELECT repository_id, node_id, regexp_extract(rtrim(line, chr(13)), '^\s*(?:import\s*\(?\s*)?(?:[\w.]+\s+)?["`]([\w./~-]+)["`]\s*;?\s*\)?\s*(?://.*)?$', 1) FROM g WHERE NOT regexp_matches(line, '^\s*return\b'))
SELECT DISTINCT * FROM x WHERE len(module) > 0""".replace("JS", _JS),
    "stream_answered": "WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, lag(event_id) OVER w AS asked FROM events WHERE event_type IN ('error', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, asked, event_id AS answered FROM e WHERE event_type = 'purchase' AND before = 'error'",
}
