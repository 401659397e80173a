"""A batch of questions, from text to answers: classify, retrieve, rank, expand, assemble.

Every route is a disjoint part of the batch; routes meet in one union, so a
question passes exactly one of them. Results that several steps use are written to
the shared folder, so that none is worked out again and nothing stays cached.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.language import of_question
from ..operators import context as cx
from ..operators import graph, retrieval
from ..sources.dense_index import DenseIndex
from ..sources.postings import Postings, of_texts
from ..sources.workspace import shared_folder, stored
from .providers import Providers, clamp, coalesced, parse_passage, valid_hints, with_hints

GREETING = "Hello! Ask me about the document."
#: Columns of nodes that a corpus may lack, with their kinds; lists are texts with commas.
OPTIONAL = {"refs": "string", "annex_refs": "string", "annex_id": "string", "part": "string", "title": "string", "chapter": "string", "section": "string", "pos": "long"}
HIT = ["query_id", "node_id", "article", "article_title", "language", "text", "score", "rank"]


@dataclass
class Settings:
    top_k: int = 12
    top_n: int = 6
    alpha: float = 0.5
    rerank_weight: float = 0.3
    title_weight: float = 0.15
    tie_delta: float = 0.05
    cutoff: float = 0.3
    #: Articles that expansion adds; at least ``wide`` for questions of several steps or over several articles.
    expand: int = 3
    wide: int = 5
    #: Below this confidence a routed table of contents adds hits.
    toc_below: float = 0.55
    #: Whether expanded nodes compete with the question's own hits for their places.
    global_rerank: bool = False
    providers: Providers = field(default_factory=Providers)


@dataclass
class Corpus:
    """Nodes with their stored indexes, the graph's edges and the definitions: built once, asked often."""

    nodes: DataFrame
    dense: DenseIndex
    words: Postings
    edges: DataFrame | None = None
    definitions: DataFrame | None = None

    @staticmethod
    def build(nodes: DataFrame, providers: Providers, edges: DataFrame | None = None, definitions: DataFrame | None = None, path: str | None = None) -> Corpus:
        path = path or shared_folder(nodes.sparkSession, "corpus")
        whole = nodes.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in nodes.columns})
        whole = stored(whole, f"{path}/nodes")
        # What is embedded is the text with its place, where nodes have one, and no other column.
        embedded = F.coalesce("embedding_text", "text") if "embedding_text" in nodes.columns else F.col("text")
        dense = DenseIndex.build(whole.select("node_id", providers.embed(embedded).alias("vector"), "language"), f"{path}/dense", keys=("language",))
        return Corpus(whole, dense, Postings.create(of_texts(whole), f"{path}/words"), edges, definitions)


def classify(queries: DataFrame, providers: Providers) -> DataFrame:
    """The questions' kinds and forms; what is searched for is the rewritten question, or the question where there is none.

    A question with a ``history`` is first made one that stands alone. Open
    questions are rewritten in the domain's words, or else by a hypothetical passage
    or article hints. References that only support a question aren't what it asks
    for: such a question is searched, and reranked without them.
    """
    q = F.col("query")
    if "history" in queries.columns:
        alone = F.when(F.coalesce("history", F.lit("")) != "", coalesced(providers.follow_up(q, F.col("history")), q)).otherwise(q)
        queries = queries.withColumn("query", alone)
    own = coalesced(providers.rewrite(q), q)
    asked = queries.withColumns({"normalised": tx.normalise_query(own), "kind": tx.classify(q), "language": of_question(q), "signal": tx.definition_signal(tx.normalise_query(own)), "multi_hop": tx.is_multi_hop(q)})
    asked = asked.withColumn("article", tx.direct_article(F.col("normalised")))
    bare = tx.strip_subordinate(F.col("normalised"))
    asked = asked.withColumns({"reranked_by": bare, "supported": F.col("article").isNotNull() & (bare != F.col("normalised"))})
    is_open = (F.col("kind") == "SPECIFIC") & F.col("article").isNull()
    if providers.hypothesis is not None:
        written = parse_passage(providers.hypothesis(q))
        asked = asked.withColumn("normalised", F.when(is_open & (written["passage"] != ""), with_hints(written["passage"], written["hints"])).otherwise(F.col("normalised")))
    elif providers.hints is not None:
        asked = asked.withColumn("normalised", F.when(is_open, with_hints(F.col("normalised"), valid_hints(providers.hints(q)))).otherwise(F.col("normalised")))
    return asked


def fan_out(asked: DataFrame, sub_questions) -> DataFrame:
    """Questions with several steps and the sub-questions they are taken apart into, as (parent, sub) in ``query_id``; 0 is the question."""
    parts = F.when(F.col("multi_hop"), F.filter(sub_questions(F.col("query")), lambda s: F.trim(s) != ""))
    each = asked.select("*", F.posexplode(F.concat(F.array("normalised"), F.coalesce(parts, F.array().cast("array<string>")))).alias("sub", "part"))
    form = F.when(F.col("sub") == 0, F.col("part")).otherwise(tx.normalise_query(F.col("part")))
    by = F.when(F.col("sub") == 0, F.col("reranked_by")).otherwise(form)
    return each.withColumns({"normalised": form, "reranked_by": by, "query_id": F.struct(F.col("query_id").alias("parent"), "sub")}).drop("part", "sub")


def _corpus(nodes: DataFrame | Corpus, settings: Settings) -> Corpus:
    return nodes if isinstance(nodes, Corpus) else Corpus.build(nodes, settings.providers)


def rank_parts(asked: DataFrame, nodes: DataFrame | Corpus, settings: Settings) -> DataFrame:
    """Ranked hits; those of a question and its sub-questions are merged, each node with its best score."""
    corpus = _corpus(nodes, settings)
    if settings.providers.sub_questions is None:
        return rank(asked, corpus, settings)
    base = shared_folder(asked.sparkSession, "parts")
    parts = stored(fan_out(asked, settings.providers.sub_questions), f"{base}/asked")
    found = stored(rank(parts, corpus, settings).select("*", "query_id.parent", "query_id.sub"), f"{base}/found")
    several = parts.where("query_id.sub = 1").select("query_id.parent")
    whole = found.join(several, "parent", "left_anti").withColumn("query_id", F.col("parent"))
    merged = retrieval.multi_query_merge(found.join(several, "parent", "left_semi"), "parent").withColumnRenamed("query_id", "parent")
    best = found.drop("score", "rank", "query_id").join(merged, ["parent", "node_id", "sub"]).withColumn("query_id", F.col("parent"))
    return whole.unionByName(best.select(*whole.columns)).drop("parent", "sub")


def retrieve(queries: DataFrame, corpus: Corpus, settings: Settings, filtered: bool = True) -> DataFrame:
    """Fused dense and sparse hits of (query_id, normalised, language), at least the cutoff; ``filtered`` searches a question's own language only."""
    asked = queries.select("query_id", "normalised", "language", settings.providers.embed(F.col("normalised")).alias("vector"))
    asked = stored(asked, shared_folder(queries.sparkSession, "asked"))
    own = lambda language: (F.col("language") == language) | F.col("language").isNull()
    words = asked.select("query_id", F.col("normalised").alias("text"), "language")
    languages = [x for (x,) in asked.select("language").distinct().collect()] if filtered else []
    if languages:
        legs = [corpus.dense.search(asked.where(F.col("language").eqNullSafe(x)), settings.top_k, own(x), keep_self=True)[0] for x in languages]
        # A language's questions meet its own nodes' postings only: no row is made for a question and a node of another.
        sparse_legs = [corpus.words.bm25(words.where(F.col("language").eqNullSafe(x)).drop("language"), settings.top_k, among=corpus.nodes.where(own(x))) for x in languages]
    else:
        legs, sparse_legs = [corpus.dense.search(asked, settings.top_k, keep_self=True)[0]], [corpus.words.bm25(words.drop("language"), settings.top_k)]
    dense, sparse = legs[0], sparse_legs[0]
    for leg, sparse_leg in zip(legs[1:], sparse_legs[1:]):
        dense, sparse = dense.unionByName(leg), sparse.unionByName(sparse_leg)
    return retrieval.similarity_cutoff(retrieval.hybrid_fusion(dense, sparse, settings.alpha, settings.top_k), settings.cutoff)


def rank(queries: DataFrame, nodes: DataFrame | Corpus, settings: Settings) -> DataFrame:
    """Hybrid hits of each query in its language: fused, one an article, reranked by windows, boosted, close ones settled.

    Questions without any hit are searched once more without the language's filter; of what that finds, rows in their language stay.
    """
    corpus, p = _corpus(nodes, settings), settings.providers
    base = shared_folder(queries.sparkSession, "rank")
    if "reranked_by" not in queries.columns:
        queries = queries.withColumn("reranked_by", F.col("normalised"))
    asked = stored(queries.select("query_id", "normalised", "reranked_by", "language"), f"{base}/asked")
    first = stored(retrieve(asked, corpus, settings), f"{base}/first")
    missing = stored(asked.join(first.select("query_id"), "query_id", "left_anti"), f"{base}/missing")
    fused = first if missing.isEmpty() else retrieval.with_fallback(first, retrieve(missing, corpus, settings, filtered=False).select(*first.columns))
    rich = fused.drop("rank").join(corpus.nodes, "node_id").join(asked.select("query_id", F.col("normalised").alias("query"), "reranked_by", F.col("language").alias("_l")), "query_id")
    # At most top_k rows a query; the joins below use them twice.
    scored = stored(rich.where("language = _l or language is null").drop("_l"), f"{base}/scored")
    once = retrieval.dedup_by_article(scored).drop("rank", "score").join(scored, ["query_id", "node_id"])
    ranked = retrieval.window_rerank(once.withColumn("query", F.col("reranked_by")), p.score, settings.rerank_weight, settings.top_n).drop("rank", "query", "best_paragraph")
    asked_again = ranked.join(asked.select("query_id", F.col("normalised").alias("query")), "query_id").drop("title")
    boosted = retrieval.title_boost(asked_again.withColumn("title", F.coalesce("article_title", F.lit(""))), settings.title_weight, settings.top_n)
    settled = retrieval.adjacent_tiebreak(boosted, settings.tie_delta)
    return settled.drop("title", "reranked_by", *(c for c in OPTIONAL if c in settled.columns))


def expand(hits: DataFrame, asked: DataFrame, corpus: Corpus, settings: Settings) -> DataFrame:
    """Nodes (as HIT, without score) that a question's hits lead to, in order of evidence.

    Over two articles or more the graph is walked from the first four hits, two
    levels deep; else, or without a graph, what the first hits refer to by number is
    listed, and for questions of several steps what that refers to in turn. Annexes
    that the first hits refer to take what is left.
    """
    base, p = shared_folder(hits.sparkSession, "expand"), settings.providers
    placed = hits.join(asked.select("query_id", "multi_hop", F.col("language").alias("_asked")), "query_id").join(corpus.nodes.select("node_id", "refs", "annex_refs", "annex_id"), "node_id")
    shape = placed.where("article is not null and article <> ''").groupBy("query_id").agg((F.count_distinct("article") >= 2).alias("several"), F.first("multi_hop").alias("_m"))
    wide = F.coalesce("several", F.lit(False)) | F.col("multi_hop")
    rows = placed.join(shape.drop("_m"), "query_id", "left").withColumns({"wide": wide, "sources": F.when(wide, 4).otherwise(2), "budget": F.when(wide, max(settings.expand, settings.wide)).otherwise(settings.expand)})
    rows = stored(rows, f"{base}/rows")
    known = rows.where("article is not null").select("query_id", "article").distinct()
    first = rows.where("rank <= sources")
    listed_only = rows if corpus.edges is None else rows.where("not coalesce(several, false)")
    parts = []
    if corpus.edges is not None:
        seeds = first.where("several and article is not null and article <> ''").groupBy("query_id", "article").agg(F.min("rank").alias("pos"), F.max("budget").cast("int").alias("budget"))
        seeds = stored(seeds, f"{base}/seeds")
        parts.append(seeds.select("query_id", "article", F.lit(0).alias("rank")).limit(0) if seeds.isEmpty() else graph.expansion(seeds, corpus.edges, corpus.nodes.where("article is not null"), exclude=known))
    by_article = corpus.nodes.where("article is not null and refs is not null and chunk_type = 'ARTICLE'").groupBy("article").agg(F.min(F.struct("node_id", "refs")).alias("m")).select("article", "m.refs")
    for deep in (True, False):
        mine = listed_only.where(F.col("wide") if deep else ~F.col("wide"))
        listed = graph.listed_expansion(mine, max(settings.expand, settings.wide) if deep else settings.expand, 4 if deep else 2, by_article if deep else None)
        parts.append(listed.select("query_id", "article", "rank"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    # In the question's language, or where that is unknown, in most of its hits'.
    most = retrieval.majority_language(rows.where("language is not null")).select("query_id", F.col("language").alias("_most"))
    language = asked.select("query_id", F.col("language").alias("_asked")).join(most, "query_id", "left").select("query_id", F.coalesce("_most", "_asked").alias("language"))
    every = corpus.nodes.withColumn("language", F.coalesce("language", F.lit("")))
    tongue = every.select("language").distinct()
    own = language.join(tongue, "language", "left_semi").unionByName(language.join(tongue, "language", "left_anti").withColumn("language", F.lit("")))
    fetched = stored(graph.fetch(found.join(own, "query_id"), every).select("query_id", "node_id", "rank"), f"{base}/fetched")
    room = rows.groupBy("query_id").agg(F.max("budget").alias("budget")).join(fetched.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", (F.col("budget") - F.coalesce("n", F.lit(0))).alias("room"))
    annexes = graph.annex_expansion(first.withColumn("annex_refs", F.coalesce("annex_refs", F.lit(""))), max(settings.expand, settings.wide), 4).join(room, "query_id").where("rank <= room")
    met = graph.fetch(annexes.join(own, "query_id"), every, "annex_id").select("query_id", "node_id", (F.col("rank") + 500).alias("rank"))
    new = fetched.unionByName(met).join(hits.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    rich = new.join(corpus.nodes, "node_id").join(asked.select("query_id", "normalised"), "query_id").withColumn("_model", p.score(F.col("normalised"), F.col("text")))
    w = Window.partitionBy("query_id").orderBy(F.col("_model").desc(), F.col("rank"), F.col("node_id"))
    in_order = rich.withColumns({"rank": F.row_number().over(w), "score": F.col("_model").cast("double")})
    return stored(in_order.select(*HIT), f"{base}/expanded")


def supplemented(hits: DataFrame, asked: DataFrame, corpus: Corpus, settings: Settings) -> DataFrame:
    """Hits of little confidence, fused with those of the articles that the table of contents suggests."""
    p = settings.providers
    if p.route is None:
        return hits
    base = shared_folder(hits.sparkSession, "toc")
    weak = asked.join(hits.groupBy("query_id").agg(F.max("score").alias("_c")), "query_id", "left").where((F.coalesce("_c", F.lit(0.0)) < settings.toc_below) & (F.col("kind") == "SPECIFIC") & ~F.col("multi_hop") & F.col("article").isNull())
    weak = stored(weak.drop("_c"), f"{base}/weak")
    routes = weak.select("query_id", F.posexplode(p.route(F.col("query"))).alias("pos", "article"))
    near = corpus.nodes.join(routes.select("article").distinct(), "article", "left_semi").join(routes, "article").join(weak.select("query_id", "normalised"), "query_id")
    routed = retrieval.toc_retrieve(routes, near.withColumn("score", p.score(F.col("normalised"), F.col("text")).cast("double")).select("query_id", "node_id", "article", "score"))
    merged = stored(retrieval.rrf_merge(hits.join(routed.select("query_id").distinct(), "query_id", "left_semi"), routed, settings.top_k), f"{base}/merged")
    fresh = merged.join(corpus.nodes.select("node_id", *(c for c in HIT if c in corpus.nodes.columns and c != "node_id")), "node_id").select(*HIT)
    return hits.join(merged.select("query_id").distinct(), "query_id", "left_anti").select(*HIT).unionByName(fresh)


def answer(queries: DataFrame, nodes: DataFrame | Corpus, edges: DataFrame | None = None, settings: Settings | None = None, definitions: DataFrame | None = None) -> DataFrame:
    """(query_id, kind, prompt, context, answer, confidence) for (query_id, query), and each question's ``history`` if there is one."""
    settings = settings or Settings()
    p = settings.providers
    corpus = nodes if isinstance(nodes, Corpus) else Corpus.build(nodes, p, edges, definitions)
    base = shared_folder(queries.sparkSession, "answer")
    asked = stored(classify(queries, p), f"{base}/asked")
    told = asked.sparkSession.createDataFrame([], asked.select("query_id", "query").schema).withColumnRenamed("query", "told")
    if corpus.definitions is not None:
        defined = asked.where("kind = 'DEFINITION'")
        named = cx.definition_answer(cx.lookup_definitions(defined.where("signal is not null").select("query_id", "language", "signal"), corpus.definitions))
        whole = defined.where("signal is null").join(cx.definition_summary(corpus.definitions), "language").select("query_id", "answer")
        told = named.unionByName(whole).withColumnRenamed("answer", "told")
    told = stored(told, f"{base}/told")
    # What no definition answers is searched, and so is an article that isn't there or only supports the question.
    left = asked.where("kind <> 'CONVERSATIONAL'").join(told.select("query_id"), "query_id", "left_anti")
    direct = retrieval.direct_retrieve(left.where("kind = 'DIRECT_ARTICLE' and not supported"), corpus.nodes.drop("score", "rank")).select(*HIT)
    direct = stored(direct, f"{base}/direct")
    search = left.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    searched = rank_parts(search, corpus, settings).select(*HIT)
    hits = stored(supplemented(stored(direct.unionByName(searched), f"{base}/found"), asked, corpus, settings), f"{base}/hits")
    expanded = expand(hits, asked, corpus, settings)
    if settings.global_rerank:
        pool = hits.unionByName(expanded)
        rescored = pool.drop("score", "rank").join(asked.select("query_id", "normalised"), "query_id").withColumn("score", p.score(F.col("normalised"), F.col("text")).cast("double"))
        top = retrieval.best(rescored, settings.top_n).select("query_id", "node_id", "score", "rank")
        both = retrieval.global_rerank(top, hits.unionByName(expanded.withColumn("rank", F.col("rank") + 1000)))
        shown = pool.drop("score", "rank").join(both, ["query_id", "node_id"]).select(*HIT)
    else:
        shown = hits.unionByName(expanded.withColumn("rank", F.col("rank") + 1000))
    context = cx.build_context(shown)
    confidence = retrieval.max_confidence(hits.withColumn("expanded", F.lit(False))).select("query_id", "confidence")
    out = asked.join(context, "query_id", "left").join(confidence, "query_id", "left").join(told, "query_id", "left")
    has_history = F.coalesce("history", F.lit("")) != "" if "history" in queries.columns else F.lit(False)
    prompt = F.when(F.col("kind") == "CONVERSATIONAL", "conversational").when(F.col("told").isNotNull(), "definition").otherwise(cx.choose_prompt(F.col("kind"), F.col("confidence"), F.col("article"), has_history))
    given = F.coalesce("context", F.lit(""))
    said = F.when(F.col("kind") == "CONVERSATIONAL", GREETING).when(F.col("told").isNotNull(), F.col("told")).otherwise(cx.completed(given, p.answer(F.col("query"), F.concat(cx.key_facts(given), "context"))))
    return out.select("query_id", "kind", prompt.alias("prompt"), cx.truncate(F.col("context")).alias("context"), said.alias("answer"), "confidence")


def judged(answers: DataFrame, references: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The answers with (query_id, reference)'s judgement from 0 to 1; NULL where there is no reference or no judgement."""
    judge = (settings or Settings()).providers.judge
    score = F.when(F.col("answer").isNotNull() & F.col("reference").isNotNull(), clamp(judge(F.col("answer"), F.col("reference"))))
    return answers.join(references.select("query_id", "reference"), "query_id", "left").withColumn("judgement", score).drop("reference")
