"""Reports, viewers, formulas and run files on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..operators import context
from ..operators import reports as r
from ..registry import register
from ..sources import runs as run_files
from . import duck, rel
from .evaluation import _RUN_A, _RUN_B

_FAILED = "SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN o_custkey % 15 = 0 THEN NULL ELSE o_orderpriority END AS error_type, concat('failed in ', o_orderstatus) AS error_message FROM {orders}"


@register("error_breakdown", f"WITH c AS ({duck(_FAILED)}) SELECT error_type, count(*) AS n, min(error_message) AS sample FROM c WHERE status <> 'ok' AND error_type IS NOT NULL GROUP BY error_type")
def error_breakdown(spark, sf):
    return r.error_breakdown(rel(spark, sf, _FAILED))


@register("coverage_gaps", "SELECT DISTINCT p_size::VARCHAR AS article FROM part WHERE p_size NOT IN (SELECT o_custkey % 37 FROM orders UNION SELECT o_orderkey % 11 FROM orders)")
def coverage_gaps(spark, sf):
    cases = rel(spark, sf, "SELECT array(CAST(o_custkey % 37 AS STRING), CAST(o_orderkey % 11 AS STRING)) AS expected_articles FROM {orders}")
    return r.uncovered(rel(spark, sf, "SELECT DISTINCT CAST(p_size AS STRING) AS article FROM {part}"), cases)


@register("priority_articles", "WITH w AS (SELECT DISTINCT n_nationkey::VARCHAR AS article FROM nation), i AS (SELECT p_size::VARCHAR AS article, min(p_name) AS title FROM part GROUP BY ALL) SELECT article, title FROM w JOIN i USING (article) ORDER BY article::INT LIMIT 10")
def priority_articles(spark, sf):
    index = rel(spark, sf, "SELECT CAST(p_size AS STRING) AS article, p_name AS article_title FROM {part}")
    return r.priority_articles(rel(spark, sf, "SELECT CAST(n_nationkey AS STRING) AS article FROM {nation}"), index, 10)


_REVIEWS = "SELECT l_orderkey AS id, l_returnflag AS status, l_linenumber AS pos FROM {lineitem} WHERE l_quantity > 30"


@register("review_status", f"WITH l AS (SELECT id, max({{'p': pos, 's': status}}).s AS review FROM ({duck(_REVIEWS)}) GROUP BY id) SELECT o_orderkey AS id, coalesce(review, 'unreviewed') AS review FROM orders LEFT JOIN l ON id = o_orderkey")
def review_status(spark, sf):
    return r.with_review(rel(spark, sf, "SELECT o_orderkey AS id FROM {orders}"), rel(spark, sf, _REVIEWS))


@register("needs_review", "SELECT l_orderkey AS id, bool_or(l_quantity > 40) AS needs_review FROM lineitem GROUP BY l_orderkey")
def needs_review(spark, sf):
    flags = rel(spark, sf, "SELECT l_orderkey AS id, collect_list(named_struct('severity', CASE WHEN l_quantity > 45 THEN 'high' WHEN l_quantity > 40 THEN 'medium' ELSE 'low' END)) AS flags FROM {lineitem} GROUP BY l_orderkey")
    return flags.select("id", r.needs_review(F.col("flags")).alias("needs_review"))


_BOX = "SELECT l_returnflag AS k, CAST(l_quantity AS DOUBLE) * (1 + l_linenumber) AS v FROM {lineitem}"


@register(
    "box_figures",
    f"""WITH t AS ({duck(_BOX)}), q AS (SELECT k, count(*) AS n, min(v) AS least, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, max(v) AS greatest FROM t GROUP BY k)
SELECT k, n, least, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, greatest, min(v) AS whisker_low, max(v) AS whisker_high FROM q JOIN t USING (k) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""",
)
def box_figures(spark, sf):
    return r.box_figures(rel(spark, sf, _BOX), "k", "v").withColumns({c: F.round(c, 6) for c in ("q1", "q2", "q3")})


@register("metrics_melted", "SELECT doc_id, metric, value FROM (SELECT doc_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM labels) UNPIVOT (value FOR metric IN (quality, toxic))")
def metrics_melted(spark, sf):
    return r.melted(rel(spark, sf, "SELECT doc_id, quality, toxic FROM {labels}"), ["doc_id"], ["quality", "toxic"])


def _sized(run: str) -> str:
    return run.replace("AS value FROM", "AS value, count(*) AS n FROM")


@register(
    "scorecard_table",
    f"""WITH a AS ({duck(_sized(_RUN_A))}), b AS ({duck(_sized(_RUN_B))}), j AS (SELECT dim, slice, metric, a.n AS n_a, b.n AS n_b, a.value AS va, b.value AS vb, a.value - b.value AS d FROM a FULL JOIN b USING (dim, slice, metric))
SELECT dim, slice, metric, coalesce(n_a::VARCHAR, '—') AS n_a, coalesce(n_b::VARCHAR, '—') AS n_b, CASE WHEN va IS NULL THEN '—' WHEN metric = 'O' THEN printf('%.3f', va) ELSE printf('%.1f%%', va * 100) END AS a, CASE WHEN vb IS NULL THEN '—' WHEN metric = 'O' THEN printf('%.3f', vb) ELSE printf('%.1f%%', vb * 100) END AS b,
 CASE WHEN d IS NULL THEN '—' WHEN metric = 'O' THEN printf('%+.3f', d) ELSE printf('%+.1f%%', d * 100) END AS delta FROM j""",
)
def scorecard_table(spark, sf):
    return r.scorecard(rel(spark, sf, _sized(_RUN_A)), rel(spark, sf, _sized(_RUN_B)), ["O"])


@register("breakdown_table", f"WITH a AS ({duck(_sized(_RUN_A))}) SELECT dim, slice, max(n) AS n, printf('%.1f%%', 100 * max(value) FILTER (WHERE metric = 'F')) AS \"F\", printf('%.3f', max(value) FILTER (WHERE metric = 'O')) AS \"O\" FROM a GROUP BY dim, slice")
def breakdown_table(spark, sf):
    return r.breakdown(rel(spark, sf, _sized(_RUN_A)), ["F"], ["O"])


_NODES = "SELECT conv_id AS article, 'en' AS language, turn AS node_id, turn AS pos, text, concat('Title ', CAST(turn AS STRING)) AS article_title, role AS part, CAST(NULL AS STRING) AS title, CAST(NULL AS STRING) AS chapter, CAST(NULL AS STRING) AS section, concat(CAST(turn + 7 AS STRING), ' , ', role, ',') AS referenced_articles, CAST(NULL AS STRING) AS referenced_external FROM {conversations}"


@register(
    "article_view",
    f"""WITH n AS (SELECT DISTINCT * FROM ({duck(_NODES)})) SELECT article, language, arg_min(article_title, pos) AS article_title, arg_min(part, pos) AS part, md5(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE trim(text) <> '')) AS text,
array_to_string(list_filter(list_transform(string_split(arg_min(referenced_articles, pos), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS refs, 0::INTEGER AS n_external FROM n GROUP BY article, language""",
)
def article_view(spark, sf):
    seen = context.article_view(rel(spark, sf, _NODES))
    return seen.select("article", "language", "article_title", "part", F.md5("text").alias("text"), F.array_join("referenced_articles", "|").alias("refs"), F.size("referenced_external").alias("n_external"))


_MARKDOWN = "SELECT p_partkey AS id, concat('Let $K = ', CAST(p_size AS STRING), '$ and', chr(10), '$$', p_name, chr(10), '$$ so ', chr(92), '[x_', CAST(p_size AS STRING), chr(92), '] or $y$; it costs 5 euro.') AS text, concat('A [FORMULA_0] B [FORMULA_1] C [FORMULA_2] D [FORMULA_', CAST(p_size % 9 AS STRING), '].') AS marked FROM {part}"
_FOUND = r"regexp_extract_all(text, '(?s)\$\$.+?\$\$|\\\[.+?\\\]|\$[^$]+?\$')"


@register("formula_extract", f"SELECT id, array_to_string({_FOUND}, '|') AS formulas FROM ({duck(_MARKDOWN)})")
def formula_extract(spark, sf):
    return rel(spark, sf, _MARKDOWN).select("id", F.array_join(fm.formulas(F.col("text")), "|").alias("formulas"))


@register(
    "formula_enrich",
    f"""WITH f AS (SELECT id, marked, {_FOUND} AS f FROM ({duck(_MARKDOWN)})), p AS (SELECT id, f, string_split(marked, ' ') AS w FROM f)
SELECT id, array_to_string(list_transform(w, lambda x, i: CASE WHEN list_position(w, x) = i AND regexp_matches(x, '^\\[FORMULA_[0-9]\\]$') THEN coalesce(f[substr(x, 10, 1)::INT + 1], x)
 WHEN regexp_matches(x, '^\\[FORMULA_[0-9]\\]\\.$') AND list_position(w, rtrim(x, '.')) IS NULL THEN coalesce(f[substr(x, 10, 1)::INT + 1] || '.', x) ELSE x END), ' ') AS text FROM p""",
)
def formula_enrich(spark, sf):
    return rel(spark, sf, _MARKDOWN).select("id", fm.with_formulas(F.col("marked"), fm.formulas(F.col("text"))).alias("text"))


_CSV = "SELECT l_orderkey, l_linenumber, concat(CAST(l_partkey AS STRING), ', ', CAST(l_suppkey AS STRING), ',') AS csv, CAST(l_linenumber AS STRING) AS member FROM {lineitem}"


@register("csv_member", f"SELECT l_orderkey, l_linenumber FROM ({duck(_CSV)}) WHERE list_contains(list_transform(string_split(csv, ','), lambda x: trim(x)), member)")
def csv_member(spark, sf):
    return rel(spark, sf, _CSV).where(fm.lists(F.col("csv"), F.col("member"))).select("l_orderkey", "l_linenumber")


_LINES = "SELECT p_partkey AS id, concat('1. First of ', p_name, ': (a) one;  (ii) two', chr(10), chr(10), CAST(p_size AS STRING), '.', chr(10), ' (', substr(p_name, 1, 2), ') x; (IV) y', chr(10), 'See (b) here') AS text FROM {part}"


@register(
    "provision_lines",
    f"""WITH t AS (SELECT id, string_split(regexp_replace(text, '(?i)(?:;\\s*|:\\s+)(\\([a-z]{{1,4}}\\)\\s)', ';' || chr(10) || '\\1', 'g'), chr(10)) AS l FROM ({duck(_LINES)})),
u AS (SELECT id, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '') AS l FROM t), e AS (SELECT id, unnest(l) AS line, unnest(range(len(l)))::INTEGER AS pos FROM u)
SELECT id, pos, line, CASE WHEN regexp_matches(line, '(?i)^\\((i{{1,3}}|iv|vi{{0,3}})\\)\\s') THEN 'roman' WHEN regexp_matches(line, '(?i)^\\([a-z]+\\)\\s') THEN 'letter' WHEN regexp_matches(line, '^[0-9]+\\.(\\s|$)') THEN 'paragraph' ELSE 'plain' END AS kind FROM e""",
)
def provision_lines(spark, sf):
    lines = rel(spark, sf, _LINES).select("id", F.posexplode(fm.provision_lines(F.col("text"))).alias("pos", "l"))
    return lines.select("id", "pos", "l.line", "l.kind")


_PAGES = "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'it' WHEN 2 THEN 'pl' ELSE 'xx' END AS code, concat('0', CAST(n_nationkey AS STRING)) AS document FROM {nation}"


@register("page_address", f"SELECT id, CASE WHEN code <> 'xx' THEN 'https://eur-lex.europa.eu/legal-content/' || upper(code) || '/TXT/HTML/?uri=CELEX:' || document END AS address FROM ({duck(_PAGES)})")
def page_address(spark, sf):
    return rel(spark, sf, _PAGES).select("id", run_files.page_address(F.col("code"), F.col("document")).alias("address"))


_NAMES = "SELECT DISTINCT concat('run_', CAST(o_custkey % 50 AS STRING), CASE o_orderkey % 4 WHEN 0 THEN '_summary.json' WHEN 1 THEN '_cases.jsonl' WHEN 2 THEN '_state.json' ELSE '.json' END) AS name FROM {orders} WHERE o_custkey % 50 <> 3 OR o_orderkey % 4 > 1"


@register("run_discovery", f"WITH f AS ({duck(_NAMES)}), p AS (SELECT regexp_extract(name, '^run_[0-9]+') AS run, name FROM f), g AS (SELECT run, bool_or(name LIKE '%summary%') AS s, bool_or(name LIKE '%cases%') AS c, bool_or(name LIKE '%state%') AS t FROM p GROUP BY run) SELECT run, s AS complete FROM g WHERE (s AND c) OR (t AND NOT s)")
def run_discovery(spark, sf):
    return run_files.runs(rel(spark, sf, _NAMES))
