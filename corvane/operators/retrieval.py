"""Ranking: top-k, fusion, rerank and the rules between them, over batches of queries.

``hits`` is (query_id, node_id, score, ...); every order is made total by the
node's id. Queries are the small side throughout; nodes are never sorted whole:
per-query limits become group limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_tokens
from ..sources.dense_index import DenseIndex
from ..sources.workspace import shared_folder


def _ranked(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    return _ranked(hits, "query_id", *(order or (F.col("score").desc(), F.col("node_id")))).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, nodes: DataFrame, k: int, keep_self: bool = False) -> DataFrame:
    """Cosine top-k of (query_id, vector) among (node_id, vector), by an index that is built for this call.

    Where nodes are searched more than once, keep a ``DenseIndex``.
    """
    index = DenseIndex.build(nodes, shared_folder(nodes.sparkSession, "dense"))
    return index.search(queries, k, keep_self=keep_self)[0]


def min_max(df: DataFrame, score: str, key: str = "query_id") -> Column:
    """The score scaled to 0..1 among its query's; a flat list gives 0."""
    w = Window.partitionBy(key)
    low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    return (F.col(score) - low) / F.when(span == 0, F.lit(1.0)).otherwise(span)


def hybrid_fusion(dense: DataFrame, sparse: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse, each scaled within its list; a missing leg counts 0."""
    d = dense.select("query_id", "node_id", min_max(dense, "score").alias("d"))
    s = sparse.select("query_id", "node_id", min_max(sparse, "score").alias("s"))
    both = d.join(s, ["query_id", "node_id"], "full")
    fused = F.round(alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0)), 6)
    return best(both.select("query_id", "node_id", fused.alias("score")), k)


def rrf_merge(first: DataFrame, second: DataFrame, cap: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion, scaled to at most 1; ties keep the first list's order, then the second's."""
    lists = first.select("query_id", "node_id", "rank", F.lit(0).alias("list")).unionByName(second.select("query_id", "node_id", "rank", F.lit(1).alias("list")))
    merged = lists.groupBy("query_id", "node_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("s"), F.min(F.struct("list", "rank")).alias("seen"))
    scaled = merged.withColumn("score", F.round(F.col("s") / F.max("s").over(Window.partitionBy("query_id")), 6))
    return best(scaled, cap, F.col("score").desc(), F.col("seen.list"), F.col("seen.rank")).select("query_id", "node_id", "score", "rank")


def dedup_by_article(hits: DataFrame, margin: float = 0.02) -> DataFrame:
    """One hit an article: its best whole-article chunk, unless a paragraph beats it by more than ``margin``."""
    key = F.coalesce(F.nullif("article", F.lit("")), F.col("node_id").cast("string"))
    # The greatest score, then the smallest id: ids may be text, so it is the score that is negated.
    place = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("less"), "node_id", "score")
    top = lambda kind: F.min(F.when((F.col("chunk_type") == "PARAGRAPH") == F.lit(kind == "PARAGRAPH"), place))
    grouped = hits.withColumn("_key", key).groupBy("query_id", "_key").agg(top("ARTICLE").alias("a"), top("PARAGRAPH").alias("p"))
    whole = F.col("p").isNull() | (F.col("a").isNotNull() & (F.round(F.col("p.score") - F.col("a.score"), 9) <= margin))
    won = F.when(whole, F.col("a")).otherwise(F.col("p"))
    out = grouped.select("query_id", won["node_id"].alias("node_id"), won["score"].alias("score"))
    return _ranked(out, "query_id", F.col("score").desc(), F.col("node_id"))


def blended_rerank(hits: DataFrame, model_score: str, weight: float, top_n: int) -> DataFrame:
    """weight * retrieval score + (1 - weight) * model score scaled within the query."""
    blended = hits.withColumn("score", F.round(weight * F.col("score") + (1 - weight) * min_max(hits, model_score), 6))
    return best(blended, top_n)


def paragraph_windows(nodes: DataFrame, most: int = 4, least_chars: int = 30) -> DataFrame:
    """(node_id, window, text): paragraphs of enough characters, evenly chosen; the whole text if there are none."""
    parts = F.filter(F.transform(F.split("text", r"\n\n+"), lambda p: F.trim(p)), lambda p: F.length(p) >= least_chars)
    n = F.size("_p")
    chosen = F.when(n == 0, F.array("text")).when(n <= most, F.col("_p")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get("_p", F.floor(i * n / most).cast("int"))))
    return nodes.withColumn("_p", parts).select("node_id", F.posexplode(chosen).alias("window", "text"))


def window_rerank(hits: DataFrame, model, weight: float, top_n: int, most: int = 4) -> DataFrame:
    """A rerank by each text's best window, with it as ``best_paragraph``.

    ``model`` scores (query, window); its scores are scaled over all windows of a
    query. ``hits`` has query_id, node_id, query, text and score.
    """
    windows = paragraph_windows(hits.select(F.struct("query_id", "node_id").alias("node_id"), "text"), most)
    scored = windows.select("node_id.*", "window", F.col("text").alias("best_paragraph")).join(hits.select("query_id", "node_id", "query"), ["query_id", "node_id"])
    scored = scored.withColumn("raw", model(F.col("query"), F.col("best_paragraph")).cast("double"))
    per_query = Window.partitionBy("query_id")
    span = F.max("raw").over(per_query) - F.min("raw").over(per_query)
    scaled = scored.withColumn("_s", (F.col("raw") - F.min("raw").over(per_query)) / F.when(span > 0, span).otherwise(1.0))
    top = scaled.groupBy("query_id", "node_id").agg(F.max_by(F.struct("_s", "best_paragraph"), F.struct("raw", -F.col("window"))).alias("b"))
    blended = hits.join(top, ["query_id", "node_id"]).withColumn("score", F.round(weight * F.coalesce("score", F.lit(0.0)) + (1 - weight) * F.col("b._s"), 6))
    return best(blended.withColumn("best_paragraph", F.col("b.best_paragraph")).drop("b"), top_n)


def title_boost(hits: DataFrame, weight: float, top_n: int) -> DataFrame:
    """A bonus for titles that share words with the query (columns ``query`` and ``title``)."""
    q, t = title_tokens(F.col("query")), title_tokens(F.col("title"))
    small = F.least(F.size(q), F.size(t))
    share = F.when(small > 0, F.size(F.array_intersect(q, t)) / small).otherwise(0.0)
    return best(hits.withColumn("score", F.round(F.col("score") + weight * share, 6)), top_n)


def adjacent_tiebreak(hits: DataFrame, delta: float) -> DataFrame:
    """The first two change places if they are close, of neighbouring articles, and the second's title fits the query better."""
    w = Window.partitionBy("query_id").orderBy("rank")
    number = F.regexp_extract("article", r"^(\d+)", 1).try_cast("long")
    fit = F.size(F.array_intersect(title_tokens(F.col("query")), title_tokens(F.col("title"))))
    state = hits.withColumns({"_n": number, "_f": fit})
    other = state.withColumns({c + s: f(c).over(w) for c in ("_n", "_f", "score") for s, f in (("_next", F.lead), ("_prev", F.lag))})

    def close(side: str) -> Column:
        return (F.abs(F.round(F.col("score") - F.col(f"score{side}"), 9)) <= delta) & (F.abs(F.col("_n") - F.col(f"_n{side}")) <= 1) & F.lit(delta > 0)

    down = (F.col("rank") == 1) & close("_next") & (F.col("_f_next") > F.col("_f"))
    up = (F.col("rank") == 2) & close("_prev") & (F.col("_f") > F.col("_f_prev"))
    rank = F.when(F.coalesce(down, F.lit(False)), 2).when(F.coalesce(up, F.lit(False)), 1).otherwise(F.col("rank"))
    return other.withColumn("rank", rank.cast("int")).select(*hits.columns)


def similarity_cutoff(hits: DataFrame, least: float = 0.3) -> DataFrame:
    return hits.where(F.col("score") >= least)


def multi_query_merge(hits: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Best score of each node over a question and its sub-questions (``sub`` 0 is the question itself); ties keep the earliest."""
    merged = hits.groupBy(parent, "node_id").agg(F.max(F.struct("score", (-F.col("sub")).alias("m"))).alias("b"))
    out = merged.select(F.col(parent).alias("query_id"), "node_id", F.col("b.score").alias("score"), (-F.col("b.m")).alias("sub"))
    return _ranked(out, "query_id", F.col("score").desc(), F.col("node_id"))


def majority_language(hits: DataFrame) -> DataFrame:
    """Each query's most frequent language of hits; the one seen first wins ties."""
    counted = hits.groupBy("query_id", "language").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return _ranked(counted, "query_id", F.col("n").desc(), F.col("first")).where("rank = 1").select("query_id", "language", "n")


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first list's hits, and the second's for queries that have none there."""
    missing = second.join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.unionByName(missing)


def direct_retrieve(queries: DataFrame, nodes: DataFrame, k: int = 50) -> DataFrame:
    """All nodes of the article that a query names, with score 1."""
    return best(nodes.join(queries.select("query_id", "article"), "article").withColumn("score", F.lit(1.0)), k, F.col("node_id"))


def toc_retrieve(routes: DataFrame, hits: DataFrame, each: int = 3) -> DataFrame:
    """The best hits of each routed article (query_id, article, pos), in the routes' order, once each."""
    met = hits.join(routes, ["query_id", "article"])
    top = _ranked(met, ["query_id", "pos"], F.col("score").desc(), F.col("node_id")).where(F.col("rank") <= each)
    once = _ranked(top.withColumnRenamed("rank", "place"), ["query_id", "node_id"], F.col("pos"), F.col("place")).where("rank = 1")
    return _ranked(once.drop("rank"), "query_id", F.col("pos"), F.col("place")).select("query_id", "node_id", "article", "score", "rank")


def global_rerank(ranked: DataFrame, pool: DataFrame) -> DataFrame:
    """The reranked hits, then those of the pool that the rerank dropped, in their own order."""
    left = pool.join(ranked.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    both = ranked.select("query_id", "node_id", "score", "rank", F.lit(0).alias("part")).unionByName(left.select("query_id", "node_id", "score", "rank", F.lit(1).alias("part")))
    w = Window.partitionBy("query_id").orderBy("part", "rank")
    return both.withColumn("rank", F.row_number().over(w)).drop("part")


def max_confidence(hits: DataFrame) -> DataFrame:
    """The best score of each query's own hits (not of those added by expansion), and the gates it passes."""
    top = hits.groupBy("query_id").agg(F.max(F.when(~F.col("expanded"), F.col("score"))).alias("confidence"))
    c = F.coalesce("confidence", F.lit(0.0))
    return top.select("query_id", "confidence", (c < 0.55).alias("use_toc"), (c < 0.40).alias("use_fallback"))


def source_record(hits: DataFrame) -> DataFrame:
    """Hits as they are shown: 500 characters of the text to display and a rounded score."""
    text = F.coalesce(F.nullif("display_text", F.lit("")), "text")
    return hits.select("query_id", "node_id", F.substring(text, 1, 500).alias("snippet"), F.round("score", 4).alias("score"))


def source_chips(sources: DataFrame) -> DataFrame:
    """The first source of each article, in order of rank; a query's own ``query_language``, if it has one, leaves out sources in another."""
    own = F.col("query_language").isNull() | (F.coalesce("language", F.lit("")) == "") | (F.col("language") == F.col("query_language"))
    named = sources.where(own & (F.coalesce("article", F.lit("")) != ""))
    first = named.groupBy("query_id", "article").agg(F.min(F.struct("rank", "node_id")).alias("m"))
    return _ranked(first.select("query_id", "article", "m.node_id", F.col("m.rank").alias("_r")), "query_id", F.col("_r"), F.col("node_id")).drop("_r")
