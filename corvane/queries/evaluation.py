"""Evaluation operators on ``orders``, ``lineitem``, ``events`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as e
from ..registry import register
from . import duck, rel

# Cases: what an order expects and gets, as article numbers made from its keys.
CASES = """SELECT o_orderkey AS id, o_orderpriority AS category, o_orderstatus AS question_type,
  CASE WHEN o_custkey % 19 = 0 THEN 'error' ELSE 'ok' END AS status,
  array(concat(CAST(o_custkey % 11 AS STRING), 'A(1)'), CAST(o_custkey % 7 AS STRING)) AS expected,
  array(CAST(o_orderkey % 5 AS STRING), concat(CAST(o_orderkey % 11 AS STRING), 'a'), CAST(o_orderkey % 7 AS STRING), CAST(o_orderkey % 5 AS STRING), '9z') AS retrieved,
  array(CAST(o_orderkey % 13 AS STRING), '3') AS expanded FROM {orders}"""
_CASES_DUCK = duck(CASES).replace("array(", "list_value(")
_NORM = "trim(regexp_replace(lower(trim(x)), '\\(.*$', ''))"
_FAM = "regexp_replace({0}, '^([0-9]+)[a-z]+$', '\\1')"


def _ordered(c: str) -> str:
    """A list without repeats, in order."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def _metrics(prefix: str, got: str) -> str:
    g, gf = _ordered(f"{got}_n"), f"list_transform({got}_n, lambda x: {_FAM.format('x')})"
    return f"""{prefix} AS (SELECT *, {g} AS g, list_distinct(e_n) AS e, {_ordered(gf)} AS gf, list_transform(e_n, lambda x: {_FAM.format("x")}) AS ef FROM normal),
{prefix}_m AS (SELECT *, list_has_any(g[1:1], e)::INTEGER AS hit_at_1, list_has_any(list_transform(g, lambda x: {_FAM.format("x")})[1:1], ef)::INTEGER AS hit_at_1_family,
 len(list_intersect(g[1:1], e))::DOUBLE / len(e) AS recall_at_1, len(list_intersect(g[1:3], e))::DOUBLE / len(e) AS recall_at_3, len(list_intersect(g[1:5], e))::DOUBLE / len(e) AS recall_at_5,
 coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(g, lambda x, i: CASE WHEN list_contains(e, x) THEN i END), lambda y: y IS NOT NULL)), 0) AS mrr,
 len(list_filter(g[1:3], lambda x: list_contains(e, x)))::DOUBLE / 3 AS precision_at_3, len(list_filter(g[1:5], lambda x: list_contains(e, x)))::DOUBLE / 5 AS precision_at_5 FROM {prefix})"""


_NORMAL = f"cases AS ({_CASES_DUCK}), normal AS (SELECT *, list_transform(retrieved, lambda x: {_NORM}) AS r_n, list_transform(list_concat(retrieved, expanded), lambda x: {_NORM}) AS x_n, list_transform(expected, lambda x: {_NORM}) AS e_n FROM cases)"
_ALL = ", ".join(e.METRICS)
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in e.METRICS)


def cases(spark, sf):
    return rel(spark, sf, CASES)


def _round(df, names=e.METRICS):
    return df.withColumns({m: F.round(m, 6) if not m.startswith("hit") else F.col(m) for m in names})


@register("hit_recall_mrr", f"WITH {_NORMAL}, {_metrics('a', 'r')} SELECT id, hit_at_1, hit_at_1_family, {', '.join(f'round({m}, 6) AS {m}' for m in e.METRICS[2:])} FROM a_m")
def hit_recall_mrr(spark, sf):
    return _round(e.with_metrics(cases(spark, sf)).select("id", *e.METRICS))


@register("metrics_with_expanded", f"WITH {_NORMAL}, {_metrics('a', 'x')} SELECT id, hit_at_1 AS hit_at_1_with_expanded, round(recall_at_3, 6) AS recall_at_3_with_expanded, round(recall_at_5, 6) AS recall_at_5_with_expanded, round(mrr, 6) AS mrr_with_expanded FROM a_m")
def metrics_with_expanded(spark, sf):
    names = ["recall_at_3_with_expanded", "recall_at_5_with_expanded", "mrr_with_expanded"]
    return _round(e.with_expanded(cases(spark, sf)).select("id", "hit_at_1_with_expanded", *names), names)


@register("family_hit", f"WITH {_NORMAL}, {_metrics('a', 'r')} SELECT category, sum(hit_at_1)::BIGINT AS hits, sum(hit_at_1_family)::BIGINT AS family_hits FROM a_m GROUP BY category")
def family_hit(spark, sf):
    return e.with_metrics(cases(spark, sf)).groupBy("category").agg(F.sum("hit_at_1").alias("hits"), F.sum("hit_at_1_family").alias("family_hits"))


_SHORT = ("hit_at_1", "recall_at_5", "mrr")


@register(
    "sliced_summary",
    f"""WITH {_NORMAL}, {_metrics("a", "r")}, ok AS (SELECT * FROM a_m WHERE status = 'ok'),
s AS (SELECT 'overall' AS dim, 'all' AS slice, * FROM ok UNION ALL SELECT 'category', category, * FROM ok UNION ALL SELECT 'question_type', question_type, * FROM ok),
g AS (SELECT dim, slice, count(*) AS n, avg(hit_at_1) AS hit_at_1, avg(recall_at_5) AS recall_at_5, avg(mrr) AS mrr FROM s GROUP BY ALL)
SELECT dim, slice, metric, round(value, 6) AS value, n FROM g UNPIVOT (value FOR metric IN (hit_at_1, recall_at_5, mrr))""",
)
def sliced_summary(spark, sf):
    measured = e.with_metrics(cases(spark, sf)).withColumn("hit_at_1", F.col("hit_at_1").cast("double"))
    return e.sliced_summary(measured, ["category", "question_type"], list(_SHORT)).withColumn("value", F.round("value", 6))


@register(
    "quantiles_exclusive",
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type),
n AS (SELECT *, len(v) AS n FROM s), q AS (SELECT *, unnest([50, 90, 99]) AS q FROM n),
j AS (SELECT *, greatest(1, least((n + 1) * q // 100, n - 1)) AS j FROM q),
r AS (SELECT event_type, n, q, (v[j] * (100 - ((n + 1) * q - j * 100)) + v[j + 1] * ((n + 1) * q - j * 100)) / 100.0::DOUBLE AS x FROM j)
SELECT event_type, n::BIGINT AS n, round(max(x) FILTER (WHERE q = 50 AND n >= 2), 6) AS p50, round(max(x) FILTER (WHERE q = 90 AND n >= 10), 6) AS p90, round(max(x) FILTER (WHERE q = 99 AND n >= 100), 6) AS p99 FROM r GROUP BY event_type, n""",
)
def quantiles_exclusive(spark, sf):
    return e.latency_quantiles(rel(spark, sf, "SELECT event_type, value FROM {events}"), "event_type", "value").select("event_type", "n", *(F.round(p, 6).alias(p) for p in ("p50", "p90", "p99")))


_RUN = "SELECT 'priority' AS dim, o_orderpriority AS slice, o_orderstatus AS metric, round(avg(o_totalprice) / 400000, 6) AS value FROM {{orders}} WHERE {} GROUP BY o_orderpriority, o_orderstatus"
_RUN_A, _RUN_B = _RUN.format("o_orderpriority <> '1-URGENT'"), _RUN.format("o_custkey % 2 = 0 AND o_orderstatus <> 'P'")


@register(
    "run_compare",
    f"""WITH a AS ({duck(_RUN_A)}), b AS ({duck(_RUN_B)}), j AS (SELECT dim, slice, metric, a.value AS value_a, b.value AS value_b, round(b.value - a.value, 4) AS delta FROM a FULL JOIN b USING (dim, slice, metric))
SELECT *, CASE WHEN value_a IS NULL THEN 'only in B' WHEN value_b IS NULL THEN 'only in A' WHEN delta < -0.01 THEN 'regression' WHEN delta > 0.01 THEN 'improvement' ELSE 'same' END AS verdict FROM j""",
)
def run_compare(spark, sf):
    return e.compare_runs(rel(spark, sf, _RUN_A), rel(spark, sf, _RUN_B))


_CONF_A = "SELECT n_name AS key, CAST(n_regionkey AS STRING) AS value FROM {nation}"
_CONF_B = "SELECT n_name AS key, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_nationkey % 5 AS STRING) END AS value FROM {nation} WHERE n_nationkey < 20"


@register("config_diff", f"WITH a AS ({duck(_CONF_A)}), b AS ({duck(_CONF_B)}) SELECT key, a.value AS value_a, b.value AS value_b FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value")
def config_diff(spark, sf):
    return e.config_diff(rel(spark, sf, _CONF_A), rel(spark, sf, _CONF_B))


_FLAGS = "SELECT l_orderkey AS id, l_shipmode_ AS check, l_returnflag AS category, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT *, concat('check_', CAST(l_suppkey % 4 AS STRING)) AS l_shipmode_ FROM {lineitem}) x"


@register("review_counts", f'WITH f AS ({duck(_FLAGS).replace("AS check", "AS chk")}) SELECT chk AS "check", category, count(*) AS n, count(DISTINCT id) AS cases, count(*) FILTER (WHERE severity IN (\'high\', \'medium\')) AS serious FROM f GROUP BY ALL')
def review_counts(spark, sf):
    return e.review_counts(rel(spark, sf, _FLAGS))


@register("pivot_heatmap", "SELECT source, round(avg(quality) FILTER (WHERE lang = 'en') * CASE WHEN count(quality) FILTER (WHERE lang = 'en') >= 2 THEN 1 END, 6) AS en, round(avg(quality) FILTER (WHERE lang = 'fr') * CASE WHEN count(quality) FILTER (WHERE lang = 'fr') >= 2 THEN 1 END, 6) AS fr FROM documents JOIN labels USING (doc_id) GROUP BY source")
def pivot_heatmap(spark, sf):
    rows = rel(spark, sf, "SELECT source, lang, quality FROM {documents} JOIN {labels} USING (doc_id)")
    return e.heat_map(rows, "source", "lang", ["en", "fr"], "quality").select("source", F.round("en", 6).alias("en"), F.round("fr", 6).alias("fr"))


@register("facet_failure_rate", f"WITH c AS ({_CASES_DUCK}) SELECT category, count(*) AS n, round(avg(CASE WHEN status <> 'ok' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate FROM c GROUP BY category")
def facet_failure_rate(spark, sf):
    return cases(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("status") != "ok", 1.0).otherwise(0.0)), 6).alias("failure_rate"))


@register("score_histogram", "SELECT least(floor((value - 0) / (100.0::DOUBLE / 25)) + 1, 25)::INTEGER AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def score_histogram(spark, sf):
    return e.histogram(rel(spark, sf, "SELECT value FROM {events}"), "value", 0.0, 100.0)


@register("empty_slices", "WITH spine AS (SELECT 'priority' AS dim, o_orderpriority AS slice, m AS metric FROM (SELECT DISTINCT o_orderpriority FROM orders), (VALUES ('F'), ('X')) t(m)), s AS (SELECT 'priority' AS dim, o_orderpriority AS slice, 'F' AS metric, count(*) AS n, round(avg(o_totalprice), 4) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) SELECT dim, slice, metric, value, coalesce(n, 0) AS n FROM spine LEFT JOIN s USING (dim, slice, metric)")
def empty_slices(spark, sf):
    spine = rel(spark, sf, "SELECT DISTINCT 'priority' AS dim, o_orderpriority AS slice, explode(array('F', 'X')) AS metric FROM {orders}")
    summary = rel(spark, sf, "SELECT 'priority' AS dim, o_orderpriority AS slice, 'F' AS metric, round(avg(o_totalprice), 4) AS value, count(*) AS n FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
    return e.with_empty_slices(summary, spine)
