"""Graph operators: each part is an article that cites three others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..registry import register
from . import duck, rel

_R = [f"CAST(p_partkey * {a} % {m} + 1 AS STRING)" for a, m in ((7, 97), (3, 53), (11, 89))]
_GAP = "repeat('- ', 80)"
NODES = f"""SELECT CAST(p_partkey AS STRING) AS article, p_partkey AS pos, {_R[0]} AS r1, {_R[1]} AS r2, {_R[2]} AS r3,
  CAST(p_size % 6 AS STRING) AS section, CAST(p_size % 2 AS STRING) AS chapter, 'I' AS title, 'II' AS part,
  concat(CASE WHEN p_size % 3 = 0 THEN 'Subject to Article ' ELSE 'Note Article ' END, {_R[0]}, {_GAP}, 'calculated pursuant to Article ', {_R[1]}, {_GAP}, CASE WHEN p_size % 2 = 0 THEN 'referred to in Article ' ELSE 'as defined in Article 4, and Article ' END, {_R[2]}, '.') AS text, p_size FROM {{part}}"""
_E = f"""n AS ({duck(NODES)}),
k AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'prerequisite' END AS k1, 'procedural' AS k2, CASE WHEN p_size % 2 = 0 THEN 'back_reference' ELSE 'definition' END AS k3 FROM n),
e AS (SELECT article AS src, r1 AS dst, 0 AS pos, coalesce(k1, CASE WHEN r2 = r1 THEN k2 END, CASE WHEN r3 = r1 THEN k3 END, CASE WHEN r1 = '4' AND p_size % 2 = 1 THEN 'definition' END, 'general') AS kind FROM k
 UNION ALL SELECT article, r2, 1, coalesce(CASE WHEN r1 = r2 THEN k1 END, k2) FROM k
 UNION ALL SELECT article, r3, 2, coalesce(CASE WHEN r1 = r3 THEN k1 END, CASE WHEN r2 = r3 THEN k2 END, CASE WHEN r3 = '4' AND p_size % 2 = 1 THEN 'definition' END, k3) FROM k),
edges AS (SELECT * FROM e WHERE src <> dst)"""
_SEEDS = "SELECT s_suppkey AS query_id, CAST(s_suppkey % 97 + 1 AS STRING) AS article, 1 AS pos FROM {supplier} UNION ALL SELECT s_suppkey, CAST(s_suppkey * 13 % 997 + 1000 AS STRING), 2 FROM {supplier}"
_PRIORITY = "CASE kind WHEN 'prerequisite' THEN 0 WHEN 'procedural' THEN 1 WHEN 'general' THEN 2 WHEN 'back_reference' THEN 3 WHEN 'definition' THEN 4 ELSE 99 END"


def nodes(spark, sf):
    return rel(spark, sf, NODES).withColumn("refs", F.array("r1", "r2", "r3"))


def edges(spark, sf):
    return g.build_edges(nodes(spark, sf))


def seeds(spark, sf):
    return rel(spark, sf, _SEEDS)


@register("edge_build", f"WITH {_E} SELECT src, dst, pos FROM edges")
def edge_build(spark, sf):
    return edges(spark, sf).select("src", "dst", "pos")


@register("edge_classify", f"WITH {_E} SELECT src, dst, kind, pos FROM edges")
def edge_classify(spark, sf):
    return edges(spark, sf)


def _walk(edge: str, budget: int) -> str:
    return f"""seeds AS ({duck(_SEEDS)}), o AS (SELECT src, dst, {_PRIORITY} AS p, pos AS e FROM {edge} WHERE dst <> '4'),
l1 AS (SELECT query_id, dst, min([pos, p, e]) AS path FROM seeds JOIN o ON article = src ANTI JOIN seeds s2 ON s2.query_id = seeds.query_id AND s2.article = dst GROUP BY query_id, dst),
l2 AS (SELECT l1.query_id, o.dst, min(list_concat(path, [p, e])) AS path FROM l1 JOIN o ON l1.dst = src ANTI JOIN seeds s2 ON s2.query_id = l1.query_id AND s2.article = o.dst ANTI JOIN l1 x ON x.query_id = l1.query_id AND x.dst = o.dst GROUP BY l1.query_id, o.dst),
w AS (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2)
SELECT query_id, dst AS article, depth, row_number() OVER (PARTITION BY query_id ORDER BY depth, path, dst)::INTEGER AS rank FROM w QUALIFY rank <= {budget}"""


@register("bfs_forward", f"WITH {_E}, {_walk('edges', 5)}")
def bfs_forward(spark, sf):
    return g.walk(seeds(spark, sf), edges(spark, sf), 2, F.lit(5))


_BACK = "back AS (SELECT dst AS src, src AS dst, 'back_reference' AS kind, pos FROM edges)"


@register(
    "bfs_reverse",
    f"""WITH {_E}, {_BACK}, seeds AS ({duck(_SEEDS)}), l1 AS (SELECT query_id, dst, min([seeds.pos, 3, back.pos]) AS path FROM seeds JOIN back ON article = src AND dst <> '4' ANTI JOIN seeds s2 ON s2.query_id = seeds.query_id AND s2.article = dst GROUP BY query_id, dst)
SELECT query_id, dst AS article, 1 AS depth, row_number() OVER (PARTITION BY query_id ORDER BY path, dst)::INTEGER AS rank FROM l1 QUALIFY rank <= 2""",
)
def bfs_reverse(spark, sf):
    return g.walk(seeds(spark, sf), g.reversed_edges(edges(spark, sf)), 1, F.lit(2))


@register(
    "bfs_general",
    f"""WITH RECURSIVE {_E}, seeds AS ({duck(_SEEDS)}), r AS (SELECT query_id, article, 0 AS depth FROM seeds UNION SELECT query_id, dst, depth + 1 FROM r JOIN edges ON article = src WHERE depth < 3)
SELECT query_id, article, min(depth)::INTEGER AS depth FROM r GROUP BY ALL""",
)
def bfs_general(spark, sf):
    return g.reach(seeds(spark, sf).select("query_id", "article").distinct(), edges(spark, sf), 3)


@register(
    "bfs_deep",
    f"""WITH RECURSIVE {_E}, seeds AS (SELECT query_id, article FROM ({duck(_SEEDS)})), r AS (SELECT query_id, article, 0 AS depth FROM seeds UNION SELECT query_id, dst, depth + 1 FROM r JOIN edges ON article = src WHERE depth < 8)
SELECT query_id, article, min(depth)::INTEGER AS depth FROM r GROUP BY ALL""",
)
def bfs_deep(spark, sf):
    """Eight levels: the plan of a level doesn't grow with those before it."""
    return g.reach(seeds(spark, sf).select("query_id", "article"), edges(spark, sf), 8)


_OUT = "SELECT s_suppkey AS query_id, CAST(s_suppkey * 7 % 97 + 1 AS STRING) AS article FROM {supplier} UNION ALL SELECT s_suppkey, CAST(s_suppkey % 53 + 1 AS STRING) FROM {supplier}"


@register(
    "bfs_excluding",
    "WITH "
    + _E
    + ", x AS ("
    + duck(_OUT)
    + "), "
    + _walk("edges", 4)
    .replace("ANTI JOIN seeds s2 ON s2.query_id = seeds.query_id AND s2.article = dst", "ANTI JOIN seeds s2 ON s2.query_id = seeds.query_id AND s2.article = dst ANTI JOIN x ON x.query_id = seeds.query_id AND x.article = dst")
    .replace("ANTI JOIN seeds s2 ON s2.query_id = l1.query_id AND s2.article = o.dst", "ANTI JOIN seeds s2 ON s2.query_id = l1.query_id AND s2.article = o.dst ANTI JOIN x ON x.query_id = l1.query_id AND x.article = o.dst"),
)
def bfs_excluding(spark, sf):
    """A walk that never reaches a query's excluded articles."""
    return g.traverse(seeds(spark, sf), edges(spark, sf), 2, F.lit(4), exclude=rel(spark, sf, _OUT))


@register(
    "graph_expansion",
    f"""WITH {_E}, {_BACK}, {_walk('edges', 2)[:_walk('edges', 2).rindex('SELECT query_id, dst AS article')].rstrip()},
f AS (SELECT query_id, dst AS article, row_number() OVER (PARTITION BY query_id ORDER BY depth, path, dst)::INTEGER AS rank FROM w QUALIFY rank <= 2),
sb AS (SELECT query_id, article, pos, 2 + query_id % 5 AS budget FROM seeds), fn AS (SELECT query_id, count(*) AS n FROM f GROUP BY ALL),
r0 AS (SELECT sb.query_id, dst, min([sb.pos, 3, back.pos]) AS path, any_value(least(2, budget - coalesce(n, 0))) AS b FROM sb LEFT JOIN fn USING (query_id) JOIN back ON article = src AND dst <> '4'
  ANTI JOIN seeds s2 ON s2.query_id = sb.query_id AND s2.article = dst ANTI JOIN f ON f.query_id = sb.query_id AND f.article = dst GROUP BY sb.query_id, dst),
r AS (SELECT query_id, dst AS article, row_number() OVER (PARTITION BY query_id ORDER BY path, dst)::INTEGER AS k FROM r0 QUALIFY k <= b),
fr AS (SELECT query_id, article, rank FROM f UNION ALL SELECT query_id, r.article, coalesce(n, 0) + k FROM r LEFT JOIN fn USING (query_id)), frn AS (SELECT query_id, count(*) AS n FROM fr GROUP BY ALL),
nd AS (SELECT * FROM n WHERE article <> '4'),
s0 AS (SELECT sb.query_id, m.article, min([sb.pos, m.pos]) AS o, any_value(least(3, budget - coalesce(frn.n, 0))) AS b FROM sb LEFT JOIN frn USING (query_id) JOIN nd z ON z.article = sb.article JOIN nd m ON m.section = z.section AND m.chapter = z.chapter
  ANTI JOIN seeds s2 ON s2.query_id = sb.query_id AND s2.article = m.article ANTI JOIN fr ON fr.query_id = sb.query_id AND fr.article = m.article GROUP BY sb.query_id, m.article),
s AS (SELECT query_id, article, row_number() OVER (PARTITION BY query_id ORDER BY o, article)::INTEGER AS k FROM s0 QUALIFY k <= b)
SELECT query_id, article, rank::INTEGER AS rank FROM fr UNION ALL SELECT query_id, s.article, (coalesce(n, 0) + k)::INTEGER FROM s LEFT JOIN frn USING (query_id)""".replace("rank FROM w QUALIFY rank <= 2)", "rank FROM w QUALIFY rank <= 2 + query_id % 5)"),
)
def graph_expansion(spark, sf):
    """References, then citing articles and siblings within what is left of each query's budget."""
    return g.expansion(seeds(spark, sf).withColumn("budget", (2 + F.col("query_id") % 5).cast("int")), edges(spark, sf), nodes(spark, sf))


@register(
    "siblings",
    f"""WITH n AS ({duck(NODES)}), seeds AS ({duck(_SEEDS)}), a AS (SELECT query_id, n.article, min([seeds.pos, n.pos]) AS o FROM seeds JOIN n s ON s.article = seeds.article JOIN n ON n.section = s.section AND n.chapter = s.chapter
  ANTI JOIN seeds s2 ON s2.query_id = seeds.query_id AND s2.article = n.article GROUP BY ALL)
SELECT query_id, article, row_number() OVER (PARTITION BY query_id ORDER BY o, article)::INTEGER AS rank FROM a QUALIFY rank <= 3""",
)
def siblings(spark, sf):
    return g.siblings(seeds(spark, sf), nodes(spark, sf))


_FAMILY = "SELECT concat(CAST(p_partkey % 400 AS STRING), CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'aa' END) AS article FROM {part}"


@register("family", f"WITH n AS (SELECT DISTINCT article, regexp_extract(article, '^([0-9]+)', 1) AS root FROM ({duck(_FAMILY)})), q AS (SELECT s_suppkey AS query_id, (s_suppkey % 400) || 'a' AS seed, (s_suppkey % 400)::VARCHAR AS root FROM supplier) SELECT query_id, article FROM q JOIN n USING (root) WHERE article <> seed")
def family(spark, sf):
    asked = rel(spark, sf, "SELECT s_suppkey AS query_id, concat(CAST(s_suppkey % 400 AS STRING), 'a') AS article FROM {supplier}")
    return g.family(asked, rel(spark, sf, _FAMILY))


@register("citing_articles", f"WITH n AS ({duck(NODES)}), r AS (SELECT article, unnest([r1, r2, r3]) AS target FROM n) SELECT DISTINCT target, article FROM r WHERE target IN (SELECT (s_suppkey % 97 + 1)::VARCHAR FROM supplier)")
def citing_articles(spark, sf):
    asked = rel(spark, sf, "SELECT DISTINCT CAST(s_suppkey % 97 + 1 AS STRING) AS article FROM {supplier}")
    return g.citing(asked, nodes(spark, sf))


@register("edge_counts", f"WITH {_E} SELECT kind, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY kind")
def edge_counts(spark, sf):
    return edges(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))
