"""Retrieval operators on ``embeddings`` (each hundredth vector asks) and ``benchmark`` (each passage asks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import retrieval as r
from ..plans.providers import Providers, overlap_score
from ..registry import register
from ..sources.dense_index import DenseIndex
from ..sources.postings import Postings, of_texts, of_weights
from ..sources.workspace import shared_folder
from . import duck, rel, stored_once

NODES = """SELECT vec_id AS node_id, concat(CAST(vec_id % 37 + 1 AS STRING), CASE WHEN vec_id % 5 = 0 THEN 'a' ELSE '' END) AS article,
  CASE WHEN vec_id % 3 = 0 THEN 'PARAGRAPH' ELSE 'ARTICLE' END AS chunk_type, CASE vec_id % 4 WHEN 0 THEN 'it' WHEN 1 THEN 'pl' ELSE 'en' END AS language,
  concat('Own funds group ', CAST(vec_id % 7 AS STRING), ' of the label ', CAST(label AS STRING)) AS title,
  CAST(vec_id * 37 % 101 AS DOUBLE) / 10 AS model FROM {embeddings}"""
VECTORS = "SELECT vec_id AS node_id, embedding AS vector FROM {embeddings}"
ASKED = "SELECT vec_id AS query_id, embedding AS vector FROM {embeddings} WHERE vec_id % 100 = 0"
TEXTS = "SELECT doc_id AS node_id, text, lang AS language FROM {documents}"
PASSAGES = "SELECT item_id AS query_id, text FROM {benchmark}"
K = 12

SIM = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v),
sim AS (SELECT q.vec_id AS query_id, n.vec_id AS node_id, round(list_dot_product(q.u, n.u), 6) AS score FROM u q JOIN u n ON q.vec_id <> n.vec_id WHERE q.vec_id % 100 = 0)"""
HITS = f"""{SIM},
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INTEGER AS rank FROM sim QUALIFY rank <= {K}),
nodes AS ({duck(NODES)}),
h AS (SELECT query_id, rank, score, nodes.* FROM hits JOIN nodes USING (node_id))"""
TERMS = """w AS (SELECT doc_id AS node_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
t AS (SELECT node_id, len(w) AS length, unnest(w) AS term FROM w),
tf AS (SELECT term, node_id, length, count(*) AS tf FROM t GROUP BY ALL),
figures AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS m FROM w),
qt AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * length / m))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), figures GROUP BY query_id, node_id),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INTEGER AS rank FROM bm QUALIFY rank <= 12)"""


def vectors(spark: SparkSession, sf: str) -> DenseIndex:
    """The stored index of all vectors; language and kind of chunk are keys that a search can filter by."""
    nodes = rel(spark, sf, VECTORS).join(rel(spark, sf, NODES).select("node_id", "language", "chunk_type"), "node_id")
    return stored_once(spark, sf, "vectors", lambda path: DenseIndex.build(nodes, path, keys=("language", "chunk_type")))


def words(spark: SparkSession, sf: str) -> Postings:
    return stored_once(spark, sf, "words", lambda path: Postings.create(of_texts(rel(spark, sf, TEXTS)), path))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    top = vectors(spark, sf).search(rel(spark, sf, ASKED), K)[0]
    return top.join(rel(spark, sf, NODES), "node_id")


def sparse_hits(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).bm25(rel(spark, sf, PASSAGES), K)


@register("cosine_topk", f"WITH {HITS} SELECT query_id, node_id, score, rank FROM hits")
def cosine_topk(spark, sf):
    return vectors(spark, sf).search(rel(spark, sf, ASKED), K)[0]


@register("cosine_reads")
def cosine_reads(spark, sf):
    """How many cells and vectors each query's search read; SQL knows no cells."""
    return vectors(spark, sf).search(rel(spark, sf, ASKED), K)[1]


@register("sparse_bm25_topk", f"WITH {TERMS} SELECT query_id, node_id, score, rank FROM sparse")
def sparse_bm25_topk(spark, sf):
    return sparse_hits(spark, sf)


# The last tenth of the documents comes as an upsert that also puts new texts in the place of each seventh one before.
_BEFORE = "SELECT doc_id AS node_id, text FROM {documents} WHERE doc_id < (SELECT max(doc_id) * 0.9 FROM {documents})"
_BATCH = "SELECT doc_id AS node_id, CASE WHEN doc_id < (SELECT max(doc_id) * 0.9 FROM {documents}) THEN concat(substr(text, 1, 200), ' the thin') ELSE text END AS text FROM {documents} WHERE doc_id >= (SELECT max(doc_id) * 0.9 FROM {documents}) OR doc_id % 7 = 0"


@register(
    "bm25_after_upsert",
    "WITH "
    + TERMS.replace(
        "FROM documents)",
        f"FROM (SELECT node_id AS doc_id, text FROM ({duck(_BATCH)}) UNION ALL SELECT doc_id, text FROM documents WHERE doc_id < (SELECT max(doc_id) * 0.9 FROM documents) AND doc_id % 7 <> 0))",
        1,
    )
    + " SELECT query_id, node_id, score, rank FROM sparse",
)
def bm25_after_upsert(spark, sf):
    """A search after an upsert into the stored index: two segments, with the replaced rows left out."""
    index = Postings.create(of_texts(rel(spark, sf, _BEFORE)), shared_folder(spark, "upserted"))
    index.upsert(of_texts(rel(spark, sf, _BATCH)))
    return index.bm25(rel(spark, sf, PASSAGES), K)


_LEARNED = """{0}w AS (SELECT {1} AS node_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {2}),
{0}t AS (SELECT node_id, unnest(w) AS word FROM {0}w), {0}c AS (SELECT node_id, word, count(*) AS c FROM {0}t GROUP BY ALL),
{0}h AS (SELECT node_id, ('0x' || substr(md5(word), 1, 7))::BIGINT AS term, max(ln(1 + c)) AS v FROM {0}c GROUP BY ALL),
{0} AS (SELECT node_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY node_id)), 4) AS weight FROM {0}h)"""


@register(
    "sparse_dot_topk",
    f"""WITH {_LEARNED.format("d", "doc_id", "documents")}, {_LEARNED.format("q", "item_id", "benchmark")},
s AS (SELECT q.node_id AS query_id, d.node_id, round(sum(q.weight * d.weight), 8) AS score FROM q JOIN d USING (term) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INTEGER AS rank FROM s QUALIFY rank <= {K}""",
)
def sparse_dot_topk(spark, sf):
    """Products of learned term weights, by the provider's sparse vectors and a stored index of them."""
    encode = Providers().encode

    def build(path: str) -> Postings:
        return Postings.create(of_weights(rel(spark, sf, TEXTS).select("node_id", encode(F.col("text"))["sparse"].alias("sparse"))), path)

    asked = rel(spark, sf, PASSAGES).select("query_id", encode(F.col("text"))["sparse"].alias("sparse"))
    return stored_once(spark, sf, "weights", build).dot(asked, K)


# Two legs over the same nodes: cosine scores, and a second model's for the same candidates.
_SECOND = "CAST(abs(node_id * 31 + query_id * 17) % 997 AS DOUBLE) / 100"
_SCALED = "CASE WHEN max({0}) OVER w = min({0}) OVER w THEN 0.0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


@register(
    "hybrid_fusion",
    f"""WITH {HITS}, second AS (SELECT query_id, node_id, {_SECOND} AS score FROM h WHERE rank % 3 <> 1 UNION ALL SELECT query_id, node_id + 1000000, 5.0 FROM h WHERE rank <= 2),
d AS (SELECT query_id, node_id, {_SCALED.format("score")} AS d FROM hits WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT query_id, node_id, {_SCALED.format("score")} AS s FROM second WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.node_id, s.node_id) AS node_id, round(0.5 * coalesce(d, 0) + 0.5 * coalesce(s, 0), 6) AS score FROM d FULL JOIN s ON d.query_id = s.query_id AND d.node_id = s.node_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INTEGER AS rank FROM f QUALIFY rank <= 10""",
)
def hybrid_fusion(spark, sf):
    h = hits(spark, sf)
    second = h.where("rank % 3 <> 1").selectExpr("query_id", "node_id", f"{_SECOND} AS score").unionByName(h.where("rank <= 2").selectExpr("query_id", "node_id + 1000000 AS node_id", "5.0D AS score"))
    return r.hybrid_fusion(h.select("query_id", "node_id", "score"), second, 0.5, 10)


@register(
    "rrf_merge",
    f"""WITH {HITS}, second AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY {_SECOND} DESC, node_id) AS rank FROM h),
l AS (SELECT query_id, node_id, rank, 0 AS list FROM hits WHERE rank <= 8 UNION ALL SELECT query_id, node_id, rank, 1 FROM second WHERE rank <= 8),
m AS (SELECT query_id, node_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(list * 1000 + rank) AS seen FROM l GROUP BY ALL),
n AS (SELECT query_id, node_id, seen, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM m)
SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INTEGER AS rank FROM n QUALIFY rank <= 6""",
)
def rrf_merge(spark, sf):
    h = hits(spark, sf)
    second = r.best(h.drop("rank").withColumn("s", F.expr(_SECOND)), 8, F.col("s").desc(), F.col("node_id"))
    return r.rrf_merge(h.where("rank <= 8"), second, 6)


@register(
    "article_dedup_margin",
    f"""WITH {HITS}, b AS (SELECT query_id, article, chunk_type, node_id, score, row_number() OVER (PARTITION BY query_id, article, chunk_type ORDER BY score DESC, node_id) AS n FROM h),
a AS (SELECT * FROM b WHERE n = 1 AND chunk_type = 'ARTICLE'), p AS (SELECT * FROM b WHERE n = 1 AND chunk_type = 'PARAGRAPH'),
j AS (SELECT coalesce(a.query_id, p.query_id) AS query_id, CASE WHEN p.node_id IS NULL OR (a.node_id IS NOT NULL AND round(p.score - a.score, 9) <= 0.02) THEN a.node_id ELSE p.node_id END AS node_id,
  CASE WHEN p.node_id IS NULL OR (a.node_id IS NOT NULL AND round(p.score - a.score, 9) <= 0.02) THEN a.score ELSE p.score END AS score FROM a FULL JOIN p ON a.query_id = p.query_id AND a.article = p.article)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INTEGER AS rank FROM j""",
)
def article_dedup_margin(spark, sf):
    return r.dedup_by_article(hits(spark, sf))


_BLEND = f"b AS (SELECT query_id, node_id, round(0.3 * score + 0.7 * ({_SCALED.format('model')}), 6) AS score FROM h WINDOW w AS (PARTITION BY query_id))"


@register("blended_rerank", f"WITH {HITS}, {_BLEND} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INTEGER AS rank FROM b QUALIFY rank <= 6")
def blended_rerank(spark, sf):
    return r.blended_rerank(hits(spark, sf), "model", 0.3, 6).select("query_id", "node_id", "score", "rank")


@register(
    "global_rerank",
    f"""WITH {HITS}, {_BLEND}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM b QUALIFY rank <= 6),
both_ AS (SELECT query_id, node_id, score, rank, 0 AS part FROM top UNION ALL SELECT query_id, node_id, score, rank, 1 FROM hits ANTI JOIN top USING (query_id, node_id))
SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY part, rank)::INTEGER AS rank FROM both_""",
)
def global_rerank(spark, sf):
    h = hits(spark, sf)
    return r.global_rerank(r.blended_rerank(h, "model", 0.3, 6), h)


_QTITLE = "concat('What is group ', CAST(query_id % 7 AS STRING), ' and label ', CAST(query_id % 10 AS STRING), ' for own funds?')"


def _titled(h: DataFrame) -> DataFrame:
    return h.withColumn("query", F.expr(_QTITLE))


_STOP = "['requirements','requirement','article','articles','institution','institutions','regulation','regulations','general','specific','provisions','provision','the','of','for','and','or','in','to','a','an','on','by','with','that','this','is','are','be','been','have','has','not','which','from','at','as','its','their','it','shall','may','must']"
_TOK = lambda c: f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')), lambda x: NOT list_contains({_STOP}, x))"
_FIT = f"tk AS (SELECT *, {_TOK(_QTITLE)} AS q, {_TOK('title')} AS t FROM h), fit AS (SELECT *, len(list_intersect(q, t)) AS f FROM tk)"


@register("title_boost", f"WITH {HITS}, {_FIT}, b AS (SELECT query_id, node_id, round(score + 0.15 * f / least(len(q), len(t)), 6) AS score FROM fit) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INTEGER AS rank FROM b QUALIFY rank <= 6")
def title_boost(spark, sf):
    return r.title_boost(_titled(hits(spark, sf)), 0.15, 6).select("query_id", "node_id", "score", "rank")


@register(
    "adjacent_tiebreak",
    f"""WITH {HITS}, {_FIT}, o AS (SELECT query_id, node_id, score, rank, article, f, regexp_extract(article, '^([0-9]+)', 1)::BIGINT AS n FROM fit),
pair AS (SELECT a.query_id FROM o a JOIN o b ON a.query_id = b.query_id AND a.rank = 1 AND b.rank = 2 WHERE abs(round(a.score - b.score, 9)) <= 0.5 AND abs(a.n - b.n) <= 1 AND b.f > a.f)
SELECT query_id, node_id, score, (CASE WHEN rank <= 2 AND query_id IN (SELECT query_id FROM pair) THEN 3 - rank ELSE rank END)::INTEGER AS rank FROM o""",
)
def adjacent_tiebreak(spark, sf):
    return r.adjacent_tiebreak(_titled(hits(spark, sf)), 0.5).select("query_id", "node_id", "score", "rank")


@register("similarity_cutoff", f"WITH {HITS} SELECT query_id, node_id, score, rank FROM hits WHERE score >= 0.3")
def similarity_cutoff(spark, sf):
    return r.similarity_cutoff(hits(spark, sf)).select("query_id", "node_id", "score", "rank")


@register(
    "multi_query_max_merge",
    f"""WITH {HITS}, s AS (SELECT query_id % 300 AS query_id, query_id // 300 AS sub, node_id % 200 AS node_id, score FROM hits),
m AS (SELECT query_id, node_id, score, sub, row_number() OVER (PARTITION BY query_id, node_id ORDER BY score DESC, sub) AS n FROM s QUALIFY n = 1)
SELECT query_id, node_id, score, sub, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INTEGER AS rank FROM m""",
)
def multi_query_max_merge(spark, sf):
    subs = hits(spark, sf).selectExpr("query_id % 300 AS parent_id", "query_id div 300 AS sub", "node_id % 200 AS node_id", "score")
    return r.multi_query_merge(subs)


@register("majority_language", f"WITH {HITS}, c AS (SELECT query_id, language, count(*) AS n, min(rank) AS f FROM h GROUP BY ALL) SELECT query_id, language, n FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) = 1")
def majority_language(spark, sf):
    return r.majority_language(hits(spark, sf))


_LANG = "CASE WHEN query_id % 200 = 0 THEN 'it' ELSE 'xx' END"


@register("lang_filtered_retrieve", f"WITH {SIM}, nodes AS ({duck(NODES)}), f AS (SELECT query_id, node_id, score FROM sim JOIN nodes USING (node_id) WHERE language = 'en' AND chunk_type = 'ARTICLE') SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INTEGER AS rank FROM f QUALIFY rank <= 12")
def lang_filtered_retrieve(spark, sf):
    return vectors(spark, sf).search(rel(spark, sf, ASKED), K, where=F.expr("language = 'en' and chunk_type = 'ARTICLE'"))[0]


@register("crosslingual_fallback", f"WITH {HITS}, own AS (SELECT query_id, node_id, score FROM h WHERE language = {_LANG}) SELECT * FROM own UNION ALL SELECT query_id, node_id, score FROM h WHERE query_id NOT IN (SELECT query_id FROM own)")
def crosslingual_fallback(spark, sf):
    h = hits(spark, sf)
    own = h.where(F.col("language") == F.expr(_LANG)).select("query_id", "node_id", "score")
    return r.with_fallback(own, h.select("query_id", "node_id", "score"))


@register("direct_lookup", f"WITH nodes AS ({duck(NODES)}), q AS (SELECT vec_id AS query_id, concat((vec_id % 37 + 1)::VARCHAR, 'a') AS article FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, node_id, article, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY node_id)::INTEGER AS rank FROM q JOIN nodes USING (article) QUALIFY rank <= 50")
def direct_lookup(spark, sf):
    q = rel(spark, sf, "SELECT vec_id AS query_id, concat(CAST(vec_id % 37 + 1 AS STRING), 'a') AS article FROM {embeddings} WHERE vec_id % 100 = 0")
    return r.direct_retrieve(q, rel(spark, sf, NODES)).select("query_id", "node_id", "article", "score", "rank")


@register(
    "toc_retrieve",
    f"""WITH {HITS}, routes AS (SELECT query_id, article, min(rank) AS pos FROM h WHERE rank % 2 = 0 GROUP BY ALL),
m AS (SELECT query_id, node_id, article, score, pos, row_number() OVER (PARTITION BY query_id, pos ORDER BY score DESC, node_id) AS place FROM h JOIN routes USING (query_id, article) QUALIFY place <= 3)
SELECT query_id, node_id, article, score, row_number() OVER (PARTITION BY query_id ORDER BY pos, place)::INTEGER AS rank FROM m""",
)
def toc_retrieve(spark, sf):
    h = hits(spark, sf)
    routes = h.where("rank % 2 = 0").groupBy("query_id", "article").agg(F.min("rank").alias("pos"))
    return r.toc_retrieve(routes, h)


@register("max_confidence", f"WITH {HITS}, c AS (SELECT query_id, max(score) FILTER (WHERE rank % 4 <> 1) AS confidence FROM hits GROUP BY query_id) SELECT query_id, confidence, coalesce(confidence, 0) < 0.55 AS use_toc, coalesce(confidence, 0) < 0.40 AS use_fallback FROM c")
def max_confidence(spark, sf):
    return r.max_confidence(hits(spark, sf).withColumn("expanded", F.expr("rank % 4 = 1")))


@register("source_record", f"WITH {TERMS} SELECT query_id, node_id, substr(text, 1, 500) AS snippet, round(score, 4) AS score FROM sparse JOIN documents ON doc_id = node_id")
def source_record(spark, sf):
    h = sparse_hits(spark, sf).join(rel(spark, sf, TEXTS), "node_id").withColumn("display_text", F.lit(""))
    return r.source_record(h)


_SHOWN = "CASE query_id % 300 WHEN 0 THEN 'en' WHEN 100 THEN 'it' END"


@register("source_chips", f"WITH {HITS}, s AS (SELECT *, {_SHOWN} AS ql FROM h), f AS (SELECT query_id, article, min([rank, node_id]) AS m FROM s WHERE ql IS NULL OR language = ql GROUP BY ALL) SELECT query_id, article, m[2]::BIGINT AS node_id, row_number() OVER (PARTITION BY query_id ORDER BY m)::INTEGER AS rank FROM f")
def source_chips(spark, sf):
    return r.source_chips(hits(spark, sf).withColumn("query_language", F.expr(_SHOWN)))


@register(
    "paragraph_windows",
    """WITH p AS (SELECT doc_id AS node_id, text, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+'), lambda x: trim(x)), lambda x: len(x) >= 30) AS p FROM documents),
c AS (SELECT node_id, CASE WHEN len(p) = 0 THEN [replace(text, chr(10), chr(10) || chr(10))] WHEN len(p) <= 4 THEN p ELSE list_transform(range(0, 4), lambda i: p[(i * len(p)) // 4 + 1]) END AS c FROM p)
SELECT node_id, (generate_subscripts(c, 1) - 1)::INTEGER AS "window", unnest(c) AS text FROM c""",
)
def paragraph_windows(spark, sf):
    return r.paragraph_windows(rel(spark, sf, TEXTS).withColumn("text", F.regexp_replace("text", "\n", "\n\n")))


_WINDOWED = """p AS (SELECT query_id, node_id, score, replace(documents.text, chr(10), chr(10) || chr(10)) AS text, benchmark.text AS query FROM sparse JOIN documents ON doc_id = node_id JOIN benchmark ON item_id = query_id),
ps AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\\n\\n+'), lambda x: trim(x)), lambda x: len(x) >= 30) AS ps FROM p),
cs AS (SELECT *, CASE WHEN len(ps) = 0 THEN [text] WHEN len(ps) <= 4 THEN ps ELSE list_transform(range(0, 4), lambda i: ps[(i * len(ps)) // 4 + 1]) END AS cs FROM ps),
ws AS (SELECT query_id, node_id, score, query, generate_subscripts(cs, 1) AS i, unnest(cs) AS w FROM cs),
qw AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(w), '[a-z0-9]+')) AS t FROM ws),
raw AS (SELECT *, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q)::DOUBLE ELSE 0.0 END AS raw FROM qw),
sc AS (SELECT *, (raw - min(raw) OVER z) / CASE WHEN max(raw) OVER z > min(raw) OVER z THEN max(raw) OVER z - min(raw) OVER z ELSE 1.0 END AS s FROM raw WINDOW z AS (PARTITION BY query_id)),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY raw DESC, i) = 1),
bl AS (SELECT query_id, node_id, md5(w) AS best_paragraph, round(0.3::DOUBLE * score + 0.7::DOUBLE * s, 6) AS score FROM top)"""


@register("window_rerank", f"WITH {TERMS}, {_WINDOWED} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INTEGER AS rank FROM bl QUALIFY rank <= 6")
def window_rerank(spark, sf):
    h = sparse_hits(spark, sf).drop("rank").join(rel(spark, sf, TEXTS).withColumn("text", F.regexp_replace("text", "\n", "\n\n")), "node_id")
    asked = h.join(rel(spark, sf, PASSAGES).withColumnRenamed("text", "query"), "query_id")
    return r.window_rerank(asked, overlap_score, 0.3, 6).select("query_id", "node_id", F.md5("best_paragraph").alias("best_paragraph"), "score", "rank")


_REFERRED = """SELECT *, concat(CAST(node_id % 50 + 1 AS STRING), ' ,', CASE WHEN node_id % 6 = 0 THEN '' ELSE concat(CAST(node_id % 9 + 1 AS STRING), 'a') END, ',4') AS refs,
  CASE node_id % 5 WHEN 0 THEN 'iv,I' WHEN 1 THEN 'II' WHEN 2 THEN 'VII, iii' ELSE '' END AS annex_refs, CASE WHEN node_id % 7 = 0 THEN 'II' END AS annex_id FROM {h}"""


def _referring(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_REFERRED, h=hits(spark, sf))


@register(
    "listed_expansion",
    f"""WITH {HITS}, x AS ({_REFERRED.replace("{h}", "h")}), n AS (SELECT DISTINCT query_id, trim(unnest(string_split(refs, ','))) AS article FROM x WHERE rank <= 3)
SELECT query_id, article, row_number() OVER (PARTITION BY query_id ORDER BY regexp_extract(article, '^([0-9]+)', 1)::INT, article)::INTEGER AS rank FROM n ANTI JOIN x USING (query_id, article) WHERE article NOT IN ('', '4') QUALIFY rank <= 3""",
)
def listed_expansion(spark, sf):
    return g.listed_expansion(_referring(spark, sf))


@register(
    "annex_expansion",
    f"""WITH {HITS}, x AS ({_REFERRED.replace("{h}", "h")}), n AS (SELECT DISTINCT query_id, upper(trim(unnest(string_split(annex_refs, ',')))) AS annex_id FROM x WHERE rank <= 3)
SELECT query_id, annex_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE annex_id WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 ELSE 4 END)::INTEGER AS rank FROM n
ANTI JOIN (SELECT * FROM x WHERE annex_id IS NOT NULL) y USING (query_id, annex_id) WHERE annex_id IN ('I', 'II', 'III', 'IV') QUALIFY rank <= 3""",
)
def annex_expansion(spark, sf):
    return g.annex_expansion(_referring(spark, sf))


@register(
    "expanded_fetch",
    f"""WITH {HITS}, x AS ({_REFERRED.replace("{h}", "h")}), n AS (SELECT DISTINCT query_id, trim(unnest(string_split(refs, ','))) AS article FROM x WHERE rank <= 3),
e AS (SELECT query_id, article, 'en' AS language, row_number() OVER (PARTITION BY query_id ORDER BY regexp_extract(article, '^([0-9]+)', 1)::INT, article)::INTEGER AS rank FROM n ANTI JOIN x USING (query_id, article) WHERE article NOT IN ('', '4') QUALIFY rank <= 3),
o AS (SELECT article, language, min(node_id) AS node_id FROM nodes WHERE chunk_type = 'ARTICLE' GROUP BY ALL)
SELECT query_id, article, language, rank, node_id FROM e JOIN o USING (article, language)""",
)
def expanded_fetch(spark, sf):
    wanted = g.listed_expansion(_referring(spark, sf)).withColumn("language", F.lit("en"))
    return g.fetch(wanted, rel(spark, sf, NODES).withColumn("level", F.lit("ARTICLE")))
