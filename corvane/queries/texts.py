"""Text, reference and context operators.

The driver's prose names no articles, so texts are made from keys of ``part``
and ``orders``, alike in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs, text
from ..operators import context as c
from ..plans import providers
from ..registry import register
from ..sources.legal_html import NAMESPACE
from . import duck, rel

REFS = """SELECT p_partkey AS id, concat('Institutions referred to in Article ', CAST(p_size AS STRING), ' shall apply Articles ', CAST(p_size + 1 AS STRING), ', ', CAST(p_size + 2 AS STRING), ' and ', CAST(p_size + 5 AS STRING),
  'a; see Article ', CAST(p_size + 3 AS STRING), ' of Regulation (EU) No ', CAST(p_partkey % 900 + 100 AS STRING), '/2012, Directive ', CAST(p_partkey % 20 + 2000 AS STRING), '/', CAST(p_partkey % 90 + 1 AS STRING), '/EU, Annex ',
  CASE p_partkey % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'III and IV' WHEN 2 THEN 'II' ELSE 'IV' END, ' and Part ', CASE p_size % 3 WHEN 0 THEN 'Three' WHEN 1 THEN 'II' ELSE '4' END, '.') AS text FROM {part}"""
_RUN = "Articles?\\s+[0-9]+[a-z]*(?:\\s*(?:,|and|or|to)\\s*[0-9]+[a-z]*)*"


@register(
    "ref_extract",
    f"""WITH t AS ({duck(REFS)}), own AS (SELECT id, regexp_replace(text, '{_RUN}\\s+of\\s+(?:Regulation|Directive)', ' ', 'g') AS text FROM t),
runs AS (SELECT id, unnest(regexp_extract_all(text, '{_RUN}')) AS run FROM own), nums AS (SELECT DISTINCT id, unnest(regexp_extract_all(run, '[0-9]+[a-z]*')) AS a FROM runs)
SELECT id, string_agg(a, ',' ORDER BY regexp_extract(a, '^([0-9]+)', 1)::INT, a) AS refs FROM nums GROUP BY id""",
)
def ref_extract(spark, sf):
    return rel(spark, sf, REFS).select("id", F.array_join(refs.article_refs(F.col("text")), ",").alias("refs"))


_RANGED = "SELECT o_orderkey AS id, concat('See Articles ', CAST(o_orderkey % 90 + 3 AS STRING), ' to ', CAST(o_orderkey % 90 + 1 + o_custkey % 24 AS STRING), ' for orders.') AS text, o_orderkey % 90 + 3 AS lo, o_orderkey % 90 + 1 + o_custkey % 24 AS hi FROM {orders}"


@register("ref_range_expand", f"WITH t AS ({duck(_RANGED)}) SELECT id, CASE WHEN hi > lo AND hi - lo <= 20 THEN 'See Article ' || array_to_string(range(lo, hi + 1), ' Article ') || ' for orders.' ELSE text END AS text FROM t")
def ref_range_expand(spark, sf):
    return rel(spark, sf, _RANGED).select("id", text.expand_ranges(F.col("text")).alias("text"))


@register("ref_range_extract", f"WITH t AS ({duck(_RANGED)}) SELECT id, CASE WHEN hi >= lo THEN array_to_string(range(lo, hi + 1), ',') ELSE array_to_string(list_sort(list_value(lo, hi)), ',') END AS refs FROM t")
def ref_range_extract(spark, sf):
    return rel(spark, sf, _RANGED).select("id", F.array_join(refs.article_refs(F.col("text")), ",").alias("refs"))


@register("ref_external", f"WITH t AS ({duck(REFS)}) SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'Directive\\s+[0-9]{{4}}/[0-9]+/\\w+|Regulation\\s+\\(EU\\)\\s+No\\s+[0-9/]+'))), ',') AS refs FROM t")
def ref_external(spark, sf):
    return rel(spark, sf, REFS).select("id", F.array_join(refs.external_refs(F.col("text")), ",").alias("refs"))


@register("annex_refs", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'III,IV' WHEN 2 THEN 'II' ELSE 'IV' END AS refs FROM part")
def annex_refs(spark, sf):
    return rel(spark, sf, REFS).select("id", F.array_join(refs.annex_refs(F.col("text")), ",").alias("refs"))


@register("struct_refs", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'III' WHEN 1 THEN 'II' ELSE 'IV' END AS refs FROM part")
def struct_refs(spark, sf):
    return rel(spark, sf, REFS).select("id", F.array_join(refs.structural_refs(F.col("text"), "Part", True), ",").alias("refs"))


_PLACE = """SELECT p_partkey AS id, concat('prt_', CASE p_size % 3 WHEN 0 THEN 'ONE' ELSE 'III' END, '.tis_I.cpt_', CAST(p_size % 9 AS STRING), CASE WHEN p_size % 2 = 0 THEN concat('.sct_', CAST(p_size % 4 AS STRING)) ELSE '' END) AS parent_id,
  concat(CAST(p_size AS STRING), CASE WHEN p_partkey % 5 = 0 THEN 'a' ELSE '' END) AS article, p_name AS article_title FROM {part}"""
_PARTS = f"p AS ({duck(_PLACE)}), h AS (SELECT *, nullif(regexp_extract(parent_id, 'prt_([^.]+)', 1), '') AS part, nullif(regexp_extract(parent_id, 'tis_([^.]+)', 1), '') AS title, nullif(regexp_extract(parent_id, 'cpt_([^.]+)', 1), '') AS chapter, nullif(regexp_extract(parent_id, 'sct_([^.]+)', 1), '') AS section FROM p)"


def placed(spark, sf):
    return rel(spark, sf, _PLACE).withColumns(refs.hierarchy(F.col("parent_id")))


@register("hierarchy_parse", f"WITH {_PARTS} SELECT id, part, title, chapter, section FROM h")
def hierarchy_parse(spark, sf):
    return placed(spark, sf).select("id", "part", "title", "chapter", "section")


@register("breadcrumb", f"WITH {_PARTS} SELECT id, concat_ws(' > ', 'Part ' || part, 'Title ' || title, 'Chapter ' || chapter, 'Section ' || section, 'Article ' || article || ' — ' || article_title) AS label, nullif(regexp_extract(article, '^([0-9]+)[a-z]+$', 1), '') AS sub_article_of FROM h")
def breadcrumb(spark, sf):
    cols = [F.col(x) for x in ("part", "title", "chapter", "section", "article", "article_title")]
    return placed(spark, sf).select("id", refs.breadcrumb(*cols).alias("label"), refs.sub_article_of(F.col("article")).alias("sub_article_of"))


@register("citation_string", f"WITH {_PARTS} SELECT id, CASE WHEN id % 11 = 0 THEN 'Annex II' ELSE concat_ws(', ', 'Part ' || part, 'Title ' || title, 'Chapter ' || chapter, 'Section ' || section, 'Article ' || article) END AS citation FROM h")
def citation_string(spark, sf):
    cols = [F.col(x) for x in ("part", "title", "chapter", "section", "article")]
    return placed(spark, sf).select("id", refs.citation(*cols, F.expr("CASE WHEN id % 11 = 0 THEN 'II' END"), F.col("id").cast("string")).alias("citation"))


_UUID = NAMESPACE


@register(
    "uuid5_key",
    f"""WITH h AS (SELECT doc_id, sha1(unhex('{_UUID.replace("-", "")}') || encode('art_' || doc_id || '_' || lang)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS key FROM h""",
)
def uuid5_key(spark, sf):
    named = rel(spark, sf, "SELECT doc_id, concat('art_', CAST(doc_id AS STRING), '_', lang) AS name FROM {documents}")
    return named.select("doc_id", refs.uuid5(F.col("name"), _UUID).alias("key"))


# Questions made from keys: each form that the text functions know.
ASKED = """SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'Hello!' WHEN 1 THEN concat('What is the LCR under art. ', CAST(o_custkey % 400 + 1 AS STRING), '?')
  WHEN 2 THEN concat('What are the requirements for own funds in Article ', CAST(o_custkey % 400 + 5 AS STRING), '?') WHEN 3 THEN 'What is a credit institution?'
  WHEN 4 THEN concat('See Article ', CAST(o_custkey % 9 + 10 AS STRING), ' and 93 on subordinated debt') WHEN 5 THEN concat('Article 4(', CAST(o_custkey % 128 + 1 AS STRING), ') please')
  WHEN 6 THEN concat('Explain article', CAST(o_custkey % 99 + 5 AS STRING), 'a as to SEC-SA and SA') WHEN 7 THEN 'Perché la società può?' WHEN 8 THEN 'difference between core capital and CET1, wymóg łączny'
  ELSE concat('Is it deducted under Article ', CAST(o_custkey % 50 + 30 AS STRING), '(1)(d) , or held?') END AS query, o_orderkey % 10 AS form, o_custkey FROM {orders}"""
_Q = f"q AS ({duck(ASKED)})"


@register(
    "normalise_query",
    f"""WITH {_Q} SELECT id, CASE form WHEN 1 THEN 'What is the LCR (Liquidity Coverage Ratio) under Article ' || (o_custkey % 400 + 1) || '?'
 WHEN 4 THEN query || ' (Tier 2 instruments)' WHEN 6 THEN 'Explain Article ' || (o_custkey % 99 + 5) || 'a as to SEC-SA (Securitisation Standardised Approach) and SA (Standardised Approach)'
 WHEN 8 THEN 'difference between core capital (Common Equity Tier 1) and CET1 (Common Equity Tier 1), wymóg łączny' ELSE query END AS query FROM q""",
)
def normalise_query(spark, sf):
    return rel(spark, sf, ASKED).select("id", text.normalise_query(F.col("query")).alias("query"))


@register(
    "classify_query",
    f"""WITH {_Q} SELECT id, CASE WHEN form = 0 THEN 'CONVERSATIONAL' WHEN form IN (3, 5) THEN 'DEFINITION' WHEN form IN (2, 6, 9) THEN 'DIRECT_ARTICLE' WHEN form = 1 THEN 'DIRECT_ARTICLE' ELSE 'SPECIFIC' END AS kind,
 CASE form WHEN 3 THEN 'credit institution' WHEN 5 THEN '#' || (o_custkey % 128 + 1) END AS signal,
 CASE WHEN form IN (1) THEN (o_custkey % 400 + 1)::VARCHAR WHEN form = 2 THEN (o_custkey % 400 + 5)::VARCHAR WHEN form = 5 THEN '4' WHEN form = 6 THEN (o_custkey % 99 + 5) || 'a' WHEN form = 9 THEN (o_custkey % 50 + 30)::VARCHAR END AS article, form = 8 AS multi_hop FROM q WHERE form <> 1
UNION ALL SELECT id, CASE WHEN o_custkey % 400 + 1 = 4 THEN 'DEFINITION' ELSE 'DIRECT_ARTICLE' END, NULL, (o_custkey % 400 + 1)::VARCHAR, false FROM q WHERE form = 1""",
)
def classify_query(spark, sf):
    q = F.col("query")
    read = rel(spark, sf, ASKED).select("id", text.classified(q).alias("c"), text.is_multi_hop(q).alias("multi_hop"))
    return read.select("id", "c.kind", "c.signal", "c.article", "multi_hop")


@register("detect_language", "SELECT doc_id, CASE WHEN regexp_matches(text, '[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]') THEN 'pl' WHEN regexp_matches(text, '[àèéìíîòóùúÀÈÉÌÍÎÒÓÙÚ]') THEN 'it' ELSE 'en' END AS language FROM documents")
def detect_language(spark, sf):
    return rel(spark, sf, "SELECT doc_id, text FROM {documents}").select("doc_id", text.detect_language(F.col("text")).alias("language"))


@register("strip_subordinate", f"WITH {_Q} SELECT id, CASE WHEN form = 9 THEN 'Is it, or held?' ELSE query END AS query FROM q")
def strip_subordinate(spark, sf):
    return rel(spark, sf, ASKED).select("id", text.strip_subordinate(F.col("query")).alias("query"))


@register("question_normalise", "SELECT item_id, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS question FROM benchmark")
def question_normalise(spark, sf):
    return rel(spark, sf, "SELECT item_id, text FROM {benchmark}").select("item_id", text.normalise_question(F.col("text")).alias("question"))


@register("article_normalise", f"WITH {_PARTS} SELECT id, lower(article) AS article, regexp_extract(article, '^([0-9]+)', 1) AS family FROM h")
def article_normalise(spark, sf):
    a = F.concat(F.upper("article"), F.lit("(1)(b)"))
    return placed(spark, sf).select("id", text.normalise_article(a).alias("article"), text.article_family(a).alias("family"))


# Contexts: sections of parts that a supplier offers.
_SECTIONS = """SELECT l_suppkey AS query_id, CAST(l_linenumber AS INT) + 10 * CAST(l_orderkey AS INT) AS rank, l_orderkey * 10 + l_linenumber AS node_id, CAST(l_partkey % 50 AS STRING) AS article, CAST(NULL AS STRING) AS article_title, 'en' AS language,
  concat('At least ', CAST(l_linenumber AS STRING), '.5% of EUR ', CAST(l_partkey AS STRING), ' million within ', CAST(l_suppkey % 90 + 1 AS STRING), ' days or ', CAST(l_linenumber * 5 AS STRING), ' basis points') AS text FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x"""
#: Lines that one task groups.
LINES = 1 << 19


def _tasks(lines):
    """As many tasks as the lines need, and one a core at least."""
    return max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // LINES))


def _sections(spark, sf):
    """The sections, and the tasks over which their lines are dealt before they are grouped: a task's share stays as it is when the table grows."""
    lines = rel(spark, sf, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem}")
    tasks = _tasks(lines)
    return spark.sql(_SECTIONS, lineitem=lines.repartition(tasks, "l_orderkey", "l_linenumber")), tasks


_TH = "list_sort(list_distinct(list_transform(list_concat(list_concat(regexp_extract_all({0}, '(?i)\\b[0-9][0-9,.]*%'), regexp_extract_all({0}, '(?i)\\b[0-9]+\\s*(?:calendar\\s+)?(?:days?|months?|years?|business\\s+days?)')), list_concat(regexp_extract_all({0}, '(?i)\\bEUR\\s*[0-9,.]+(?:\\s*(?:million|billion))?'), regexp_extract_all({0}, '(?i)\\b[0-9]+(?:\\.[0-9]+)?\\s*basis\\s+points?'))), lambda x: trim(x))))"


@register("threshold_extract", f"WITH s AS ({duck(_SECTIONS)}) SELECT node_id, array_to_string({_TH.format('text')}, '|') AS thresholds FROM s")
def threshold_extract(spark, sf):
    return _sections(spark, sf)[0].select("node_id", F.array_join(c.thresholds(F.col("text")), "|").alias("thresholds"))


@register(
    "missing_thresholds",
    f"""WITH s AS ({duck(_SECTIONS)}), a AS (SELECT *, 'Article ' || article || ' asks for ' || split_part(text, ' ', 3) || '.' AS answer FROM s)
SELECT node_id, CASE WHEN len(m) > 0 THEN 'Article ' || article || ': ' || array_to_string(m, ', ') ELSE '' END AS note FROM (SELECT *, list_filter({_TH.format("text")}, lambda x: NOT contains(answer, x)) AS m FROM a)""",
)
def missing_thresholds(spark, sf):
    s, _ = _sections(spark, sf)
    whole = F.concat(F.lit("Article "), "article", F.lit("\n\n"), "text")
    answer = F.concat(F.lit("Article "), "article", F.lit(" asks for "), F.get(F.split("text", " "), F.lit(2)), F.lit("."))
    return s.select("node_id", c.missing_thresholds(whole, answer).alias("note"))


_NOTED = f"""s AS ({duck(_SECTIONS)}), a AS (SELECT *, 'Article ' || article || ' asks for ' || split_part(text, ' ', 3) || '.' AS answer, {_TH.format('text')} AS th FROM s)"""


@register("key_facts", f"WITH {_NOTED} SELECT node_id, CASE WHEN len(th) > 0 THEN 'KEY NUMERICAL THRESHOLDS (extracted from retrieved articles — ensure ALL relevant ones are addressed in your answer):' || chr(10) || '- Article ' || article || ': ' || array_to_string(th, ', ') || chr(10) || chr(10) ELSE '' END AS facts FROM a")
def key_facts(spark, sf):
    return _sections(spark, sf)[0].select("node_id", c.key_facts(F.concat(F.lit("Article "), "article", F.lit("\n\n"), "text")).alias("facts"))


@register("completeness_note", f"WITH {_NOTED}, m AS (SELECT *, list_filter(th, lambda x: NOT contains(answer, x)) AS m FROM a) SELECT node_id, answer || CASE WHEN len(m) > 0 THEN chr(10) || chr(10) || '> **Completeness note:** The following numerical thresholds appear in the cited articles but were not explicitly stated above: Article ' || article || ': ' || array_to_string(m, ', ') || '.' ELSE '' END AS answer FROM m")
def completeness_note(spark, sf):
    whole = F.concat(F.lit("Article "), "article", F.lit("\n\n"), "text")
    answer = F.concat(F.lit("Article "), "article", F.lit(" asks for "), F.get(F.split("text", " "), F.lit(2)), F.lit("."))
    return _sections(spark, sf)[0].select("node_id", c.completed(whole, answer).alias("answer"))


@register("context_build", f"WITH s AS ({duck(_SECTIONS)}) SELECT query_id, md5(string_agg('Article ' || article || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context FROM s GROUP BY query_id")
def context_build(spark, sf):
    hits, tasks = _sections(spark, sf)
    return c.build_context(hits, tasks=tasks).select("query_id", F.md5("context").alias("context"))


@register("context_parents", f"WITH s AS ({duck(_SECTIONS)}), f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, article ORDER BY rank) = 1), j AS (SELECT f.*, CASE WHEN article::INT < 25 THEN 'whole article ' || article ELSE text END AS t FROM f) SELECT query_id, md5(string_agg('Article ' || article || chr(10) || chr(10) || t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context FROM j GROUP BY query_id")
def context_parents(spark, sf):
    parents = spark.range(25).select(F.col("id").cast("string").alias("article"), F.lit("en").alias("language"), F.concat(F.lit("whole article "), F.col("id").cast("string")).alias("text"))
    hits, tasks = _sections(spark, sf)
    return c.build_context(hits, parents, tasks).select("query_id", F.md5("context").alias("context"))


_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@register("context_truncate", f"WITH t AS (SELECT doc_id, replace(text, chr(10), {_SEP}) AS x FROM documents), w AS (SELECT doc_id, x, substr(x, 1, 1000) AS w FROM t) SELECT doc_id, md5(CASE WHEN len(x) <= 1000 THEN x WHEN instr(w, {_SEP}) > 1 THEN substr(w, 1, len(w) - instr(reverse(w), reverse({_SEP})) - 6) ELSE w END) AS context FROM w")
def context_truncate(spark, sf):
    x = F.replace("text", F.lit("\n"), F.lit(c.SEPARATOR))
    return rel(spark, sf, "SELECT doc_id, text FROM {documents}").select("doc_id", F.md5(c.truncate(x, 1000)).alias("context"))


@register(
    "history_window",
    """WITH p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, turn, text AS q, a FROM p WHERE role = 'user' AND r2 = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5)
SELECT conv_id, md5(string_agg('Q: ' || q || chr(10) || 'A: ' || a, chr(10) ORDER BY turn)) AS history FROM e GROUP BY conv_id""",
)
def history_window(spark, sf):
    turns = c.exchanges(rel(spark, sf, "SELECT conv_id, turn, role, text FROM {conversations}"))
    return c.history(turns).select("conv_id", F.md5("history").alias("history"))


@register("key_terms_map", "SELECT source AS article, array_to_string(list_filter(regexp_split_to_array(trim(m), '\\s+'), lambda x: true)[1:50], ' ') AS key_terms FROM (SELECT source, arg_min(text, doc_id) AS m FROM documents WHERE trim(text) <> '' GROUP BY source)")
def key_terms_map(spark, sf):
    return c.key_terms(rel(spark, sf, "SELECT source AS article, doc_id AS pos, text FROM {documents}"))


_ENTRIES = "SELECT 'en' AS language, p_partkey AS pos, p_brand AS part, CAST(p_partkey % 100 * 0 + p_size AS STRING) AS title, CAST(NULL AS STRING) AS chapter, '' AS section, p_partkey % 97 = 0 AS is_annex, CAST(p_partkey AS STRING) AS article, p_name AS article_title FROM {part}"


@register(
    "toc_outline",
    f"""WITH e AS ({duck(_ENTRIES)}), l AS (SELECT *, lag(part) OVER w AS p1, lag(title) OVER w AS t1, row_number() OVER w AS n FROM e WINDOW w AS (ORDER BY is_annex, pos))
SELECT language, pos, concat_ws(chr(10), CASE WHEN p1 IS DISTINCT FROM part THEN 'Part ' || part END, CASE WHEN p1 IS DISTINCT FROM part OR t1 IS DISTINCT FROM title THEN '  Title ' || title END, '        ' || CASE WHEN is_annex THEN 'Annex ' ELSE 'Article ' END || article || ' — ' || article_title) AS lines FROM l""",
)
def toc_outline(spark, sf):
    return c.outline(rel(spark, sf, _ENTRIES))


@register("article_text", "SELECT source AS article, lang AS language, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS text FROM documents GROUP BY ALL")
def article_text(spark, sf):
    n = rel(spark, sf, "SELECT source AS article, lang AS language, doc_id AS node_id, doc_id AS pos, text FROM {documents}")
    return c.article_text(n).withColumn("text", F.md5("text"))


@register("prompt_choice", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_totalprice / 500000 < 0.40 AND o_custkey % 3 <> 0 THEN 'fallback' WHEN o_custkey % 2 = 0 THEN 'with_history' ELSE 'default' END AS prompt FROM orders")
def prompt_choice(spark, sf):
    o = rel(spark, sf, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'SPECIFIC' ELSE 'DEFINITION' END AS kind, o_totalprice / 500000 AS confidence, CASE WHEN o_custkey % 3 = 0 THEN '92' END AS direct, o_custkey % 2 = 0 AS h FROM {orders}")
    return o.select("id", c.choose_prompt(F.col("kind"), F.col("confidence"), F.col("direct"), F.col("h")).alias("prompt"))


# Definitions: a text for each region, with as many entries as its nations.
_DEFS = "SELECT CASE n_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'it' ELSE concat('x', CAST(n_regionkey AS STRING)) END AS language, n_nationkey AS k, n_name FROM {nation}"


def _definitions(spark, sf):
    rows = rel(spark, sf, _DEFS)
    body = F.concat(F.lit("("), F.col("k") + 1, F.lit(") '"), "n_name", F.lit("' means the land of  "), F.lower("n_name"), F.lit(";"))
    texts = rows.groupBy("language").agg(F.concat(F.lit("For this text: (1) general words "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", body.alias("b")))), lambda r: r["b"]), " ")).alias("text"))
    return c.parse_definitions(texts)


@register("definition_parse", f"WITH d AS ({duck(_DEFS)}) SELECT language, (k + 1)::VARCHAR AS number, lower(n_name) AS term, '''' || n_name || ''' means the land of ' || lower(n_name) AS text FROM d")
def definition_parse(spark, sf):
    return _definitions(spark, sf)


@register(
    "definition_lookup",
    f"""WITH d AS ({duck(_DEFS)}), q AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 2 = 0 THEN '#' || (o_custkey % 26) ELSE 'kenya' END AS signal, CASE WHEN o_orderkey % 3 = 0 THEN 'it' ELSE 'en' END AS language FROM orders),
b AS (SELECT language, '#' || (k + 1) AS signal, (k + 1)::VARCHAR AS number, lower(n_name) AS term FROM d UNION ALL SELECT language, lower(n_name), (k + 1)::VARCHAR, lower(n_name) FROM d)
SELECT query_id, coalesce(o.number, f.number) AS number, coalesce(o.term, f.term) AS term FROM q LEFT JOIN b o USING (signal, language) LEFT JOIN b f ON f.signal = q.signal AND f.language = 'en' WHERE o.number IS NOT NULL OR f.number IS NOT NULL""",
)
def definition_lookup(spark, sf):
    q = rel(spark, sf, "SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 2 = 0 THEN concat('#', CAST(o_custkey % 26 AS STRING)) ELSE 'kenya' END AS signal, CASE WHEN o_orderkey % 3 = 0 THEN 'it' ELSE 'en' END AS language FROM {orders}")
    return c.lookup_definitions(q, _definitions(spark, sf)).select("query_id", "number", "term")


@register("sub_query_parse", "SELECT p_partkey AS id, 'first ' || p_name || '|second ' || p_brand || '|third' AS parts FROM part")
def sub_query_parse(spark, sf):
    t = rel(spark, sf, "SELECT p_partkey AS id, concat('1. first ', p_name, chr(10), '2) second ', p_brand, chr(10), chr(10), '- third', chr(10), '4. fourth') AS t FROM {part}")
    return t.select("id", F.array_join(providers.parse_sub_questions(F.col("t")), "|").alias("parts"))


@register("toc_json_parse", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size || ',' || (p_size + 1) || 'a' ELSE p_size || ',7' END AS articles FROM part")
def toc_json_parse(spark, sf):
    t = rel(spark, sf, "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat('```json{\"articles\": [\"', CAST(p_size AS STRING), '\", \"', CAST(p_size + 1 AS STRING), 'a\", \"Annex\"]}```') ELSE concat('Look at ', CAST(p_size AS STRING), ' and 7.') END AS t FROM {part}")
    return t.select("id", F.array_join(providers.parse_routes(F.col("t")), ",").alias("articles"))


@register("citation_type_check", f"WITH {_Q} SELECT id, form IN (1, 2, 4, 5, 6, 9) AS cites, (form IN (1, 2, 4, 5, 6, 9)) <> (o_custkey % 2 = 0) AS mismatch FROM q")
def citation_type_check(spark, sf):
    own = F.regexp_replace("query", text.FOREIGN, "")
    cites = own.rlike(text.CITED)
    return rel(spark, sf, ASKED).select("id", cites.alias("cites"), (cites != F.expr("o_custkey % 2 = 0")).alias("mismatch"))
