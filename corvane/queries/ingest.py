"""Sources, upserts, diagnostics, streams' batch forms, and the whole answer plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans import answer as plan
from ..plans.providers import Providers
from ..registry import register
from ..sources import case_files, index_table, legal_html
from ..sources.workspace import shared_folder
from ..streaming import ingest as streams
from . import duck, rel, spread, stored_once

_NOISE = "regexp_replace({0}, '(?is)<{1}\\b.*?</{1}\\s*>', ' ', 'g')"
_BARE = "html"
for _tag in ("script", "style", "nav", "footer"):
    _BARE = _NOISE.format(_BARE, _tag)


@register("html_text_extract", f"SELECT page_id, md5(trim(regexp_replace(regexp_replace({_BARE}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text FROM pages")
def html_text_extract(spark, sf):
    return rel(spark, sf, "SELECT page_id, html FROM {pages}").select("page_id", F.md5(legal_html.strip_tags(F.col("html"))).alias("text"))


# A legal page for each part.
_PAGE = """SELECT p_partkey AS page_id, 'en' AS language, p_name, p_size, concat('<!DOCTYPE html><html><body><nav>menu</nav><div id="prt_III.tis_I.cpt_', CAST(p_size % 9 AS STRING), '.sct_1"><div id="art_', CAST(p_size AS STRING), '"><p class="title-article-norm">Article</p><div class="eli-title"><p class="stitle-article-norm">',
  p_name, '</p></div><div class="norm"><span class="no-parag">1.</span>Text of ', p_name, ' under Article ', CAST(p_size + 1 AS STRING), '.</div><p class="modref">M2</p><div class="grid-container grid-list"><div class="grid-row"><div>(a)</div><div>first point</div></div></div><table class="borderOj"><tr><th>Item</th><th>Value</th></tr><tr><td>A|B</td><td>',
  CAST(p_size AS STRING), '%</td></tr></table><img src="data:image/png;base64,x"></div></div><div id="anx_II"><p class="title-annex-1">ANNEX II</p><p class="title-annex-2">Listing</p><p>Annex text of ', p_name, '.</p></div></body></html>') AS html FROM {part}"""


@register(
    "html_table_markdown",
    f"""WITH p AS ({duck(_PAGE)}), a AS (SELECT page_id, 'ARTICLE' AS level, 'art_' || p_size || '_en' AS node_id, p_name AS title, (p_size % 9)::VARCHAR AS chapter, 'Article' AS kind, (p_size + 1)::VARCHAR AS refs,
 '1. Text of ' || p_name || ' under Article ' || (p_size + 1) || '.' || chr(10) || '  (a) first point' || chr(10) || '[TABLE]' || chr(10) || '| Item | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| A\\|B | ' || p_size || '% |' || chr(10) || '[FORMULA_0]' AS text FROM p
 UNION ALL SELECT page_id, 'ANNEX', 'anx_II_en', 'Listing', NULL, 'Annex', '', 'Listing' || chr(10) || 'Annex text of ' || p_name || '.' FROM p)
SELECT page_id, level, node_id, title, chapter, refs, text, level = 'ARTICLE' AS has_table, level = 'ARTICLE' AS has_formula FROM a WHERE NOT (level = 'ANNEX' AND false)""",
)
def html_table_markdown(spark, sf):
    n = legal_html.nodes(spread(rel(spark, sf, _PAGE).select("page_id", "language", "html")))
    return n.select("page_id", "level", "node_id", F.coalesce("article_title", "annex_title").alias("title"), "chapter", F.array_join("referenced_articles", ",").alias("refs"), "text", "has_table", "has_formula")


@register("paragraph_chunk", "WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS p, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM documents) SELECT doc_id, 0 AS para, 'ARTICLE' AS chunk_type FROM p UNION ALL SELECT doc_id, unnest(range(1, len(p) + 1))::INTEGER, 'PARAGRAPH' FROM p WHERE len(p) >= 2 AND n >= 100")
def paragraph_chunk(spark, sf):
    docs = rel(spark, sf, "SELECT doc_id, text FROM {documents}")
    parts = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    split = docs.select("doc_id", parts.alias("p"), F.size(F.split(F.trim("text"), r"\s+")).alias("n"))
    kinds = F.when((F.size("p") >= 2) & (F.col("n") >= 100), F.sequence(F.lit(0), F.size("p"))).otherwise(F.array(F.lit(0)))
    return split.select("doc_id", F.explode(kinds).alias("para")).withColumn("chunk_type", F.when(F.col("para") == 0, "ARTICLE").otherwise("PARAGRAPH"))


@register("upsert_latest", "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_latest(spark, sf):
    rows = rel(spark, sf, "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM {events}")
    return index_table.latest(rows, "user_id", "event_id")


_INDEX = "SELECT lang AS language, md5(text) AS node_id, CASE WHEN doc_id % 50 = 0 THEN 'ANNEX' ELSE 'ARTICLE' END AS level FROM {documents}"


@register("duplicate_keys", f"WITH n AS ({duck(_INDEX)}) SELECT node_id, count(*) AS n FROM n GROUP BY node_id HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return rel(spark, sf, _INDEX).groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1")


@register("index_diagnostics", "WITH n AS (SELECT lang AS language, md5(text) AS node_id FROM documents), k AS (SELECT language, node_id, count(*) AS c FROM n GROUP BY ALL) SELECT language, sum(c)::BIGINT AS nodes, count(*) FILTER (WHERE c > 1) AS duplicate_keys FROM k GROUP BY language")
def index_diagnostics(spark, sf):
    return index_table.diagnostics(rel(spark, sf, _INDEX)).select("language", "nodes", "duplicate_keys")


@register("index_difference", "SELECT coalesce(d.doc_id, l.doc_id)::VARCHAR AS node_id, CASE WHEN d.doc_id IS NULL THEN 'index' ELSE 'parser' END AS only_in FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def index_difference(spark, sf):
    d, s = (rel(spark, sf, f"SELECT DISTINCT CAST(doc_id AS STRING) AS node_id FROM {{{t}}}") for t in ("documents", "labels"))
    return index_table.difference(d, s)


@register("patch_changed", "SELECT doc_id, lang AS old, upper(substr(source, 4, 1)) AS new FROM documents WHERE lang IS DISTINCT FROM upper(substr(source, 4, 1))")
def patch_changed(spark, sf):
    rows = rel(spark, sf, "SELECT doc_id, lang, source FROM {documents}")
    return index_table.changed(rows, "lang", F.upper(F.substring("source", 4, 1))).select("doc_id", "old", "new")


@register("jsonl_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS pos FROM events GROUP BY user_id")
def jsonl_last_wins(spark, sf):
    return case_files.last_wins(rel(spark, sf, "SELECT user_id, event_id, event_type FROM {events}"), "user_id", "event_id")


@register("id_counts", "WITH g AS (SELECT l_orderkey AS id, coalesce(CASE WHEN l_returnflag = 'R' THEN 'ok' WHEN l_returnflag = 'A' THEN 'error' END, 'error') AS s FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) = 1) SELECT count(*) AS cases, count(*) FILTER (WHERE s = 'ok') AS ok, count(*) FILTER (WHERE s <> 'ok') AS error FROM g")
def id_counts(spark, sf):
    rows = rel(spark, sf, "SELECT CAST(l_orderkey AS STRING) AS id, CASE WHEN l_returnflag = 'R' THEN 'ok' WHEN l_returnflag = 'A' THEN 'error' END AS status, struct(l_linenumber, l_returnflag) AS line FROM {lineitem}")
    return case_files.id_counts(rows, "line")


# The stored table: nine tenths of the documents, then an upsert of the rest with new texts for each eleventh one, then a patch.
_STORED = "SELECT doc_id AS key, lang AS language, CASE WHEN doc_id % 3 = 0 THEN 'PARAGRAPH' ELSE 'ARTICLE' END AS chunk_type, md5(text) AS text FROM {documents} WHERE doc_id % 10 <> 9"
_UPSERTED = "SELECT doc_id AS key, lang AS language, 'ARTICLE' AS chunk_type, concat('new ', source) AS text FROM {documents} WHERE doc_id % 10 = 9 OR doc_id % 11 = 0"
_TABLE = f"""t AS (SELECT * FROM ({duck(_UPSERTED)}) UNION ALL SELECT * FROM ({duck(_STORED)}) WHERE key % 11 <> 0)"""


@register("index_upsert", f"WITH {_TABLE} SELECT key, language, chunk_type, text FROM t WHERE language = 'en'")
def index_upsert(spark, sf):
    """A scan by language after an upsert into the versioned table."""
    path = shared_folder(spark, "table")
    index_table.create(rel(spark, sf, _STORED), path, buckets=8)
    index_table.upsert(spark, path, rel(spark, sf, _UPSERTED))
    return index_table.scan(spark, path, language="en")


@register("index_patch", f"WITH {_TABLE} SELECT key, language, chunk_type, CASE WHEN chunk_type = 'PARAGRAPH' AND key % 4 = 0 THEN upper(text) ELSE text END AS text FROM t")
def index_patch(spark, sf):
    """All rows after a patch in place of the upserted table."""
    path = shared_folder(spark, "table")
    index_table.create(rel(spark, sf, _STORED), path, buckets=8)
    index_table.upsert(spark, path, rel(spark, sf, _UPSERTED))
    index_table.patch(spark, path, {"text": F.upper("text")}, F.expr("chunk_type = 'PARAGRAPH' and key % 4 = 0"))
    return index_table.scan(spark, path)


@register("resume_pending", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_pending(spark, sf):
    results = rel(spark, sf, "SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN 'ok' ELSE 'error' END AS status FROM {lineitem}")
    return case_files.pending(rel(spark, sf, "SELECT o_orderkey AS id FROM {orders}"), results)


_OLD = "SELECT concat('case_', lpad(CAST(item_id + 1 AS STRING), 3, '0')) AS id, text AS question, array('1') AS expected_articles FROM {benchmark}"
_NEW = "SELECT CAST(NULL AS STRING) AS id, concat('  ', text, ' ') AS question, array('2') AS expected_articles FROM {benchmark} UNION ALL SELECT NULL, concat('What about ', n_name, '?'), array('3') FROM {nation}"


@register("case_append", "WITH m AS (SELECT max(item_id) + 1 AS m FROM benchmark), q AS (SELECT DISTINCT lower('What about ' || n_name || '?') AS k, 'What about ' || n_name || '?' AS question FROM nation) SELECT printf('case_%03d', m + row_number() OVER (ORDER BY k)) AS id, question FROM q, m")
def case_append(spark, sf):
    return case_files.append_cases(rel(spark, sf, _OLD), rel(spark, sf, _NEW)).select("id", "question")


@register("text_or_blob", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END, ''), json_extract_string(props, '$.k'), '') AS text FROM events")
def text_or_blob(spark, sf):
    e = rel(spark, sf, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS t, replace(props, '\"k\"', '\"text\"') AS props FROM {events}")
    return e.select("event_id", index_table.text_or_blob(F.col("t"), F.col("props")).alias("text"))


@register("window_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, sf):
    return streams.windowed(rel(spark, sf, "SELECT * FROM {events}"))


@register(
    "window_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, s""",
)
def window_session(spark, sf):
    return streams.sessions(rel(spark, sf, "SELECT * FROM {events}"))


@register("answer_batch")
def answer_batch(spark, sf):
    """The whole plan over all passages and documents, with the offline providers; sources that follow each other in a language refer to each other."""
    docs = rel(spark, sf, "SELECT doc_id AS node_id, text, CAST(NULL AS STRING) AS language, source AS article, CAST(NULL AS STRING) AS article_title, 'ARTICLE' AS chunk_type, 'ARTICLE' AS level, lang AS section, doc_id AS pos FROM {documents}")
    asked = rel(spark, sf, "SELECT item_id AS query_id, text AS query FROM {benchmark}")
    edges = rel(spark, sf, "SELECT src, dst, 'general' AS kind, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS INT) AS pos FROM (SELECT DISTINCT source AS src, lead(source) OVER (PARTITION BY lang ORDER BY source) AS dst FROM (SELECT DISTINCT source, lang FROM {documents} WHERE source IS NOT NULL)) WHERE dst IS NOT NULL AND dst <> src")
    corpus = stored_once(spark, sf, "corpus", lambda path: plan.Corpus.build(docs, Providers(), edges, path=path))
    return plan.answer(asked, corpus)


@register("question_tokens", "SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::INTEGER AS n FROM benchmark")
def question_tokens(spark, sf):
    return rel(spark, sf, "SELECT item_id, text FROM {benchmark}").select("item_id", F.size(F.array_distinct(tx.tokens(F.col("text")))).alias("n"))
