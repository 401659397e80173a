"""The citation graph as an edge table (src, dst, kind, pos), and walks over it by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import ROMAN
from ..functions.text import article_order
from ..sources.workspace import shared_folder, stored

#: The article of definitions is never walked to.
SKIPPED = "4"
# Order in which kinds of reference are followed.
PRIORITY = {"prerequisite": 0, "procedural": 1, "general": 2, "back_reference": 3, "definition": 4}
# Wording that tells the kind of a reference, tried in this order.
WORDING = (
    ("definition", (r"\bas defined in (?:Article\s+4|point \(\d+\) of Article\s+4)",)),
    (
        "prerequisite",
        (
            r"\bsubject to (?:Articles?|the requirements of Article)\s+(\d+\w*)",
            r"\bshall (?:comply|meet the requirements?|satisfy the (?:conditions?|requirements?))\b.{0,80}Article\s+(\d+\w*)",
            r"\bin compliance with (?:Article|paragraph)\s+(\d+\w*)",
            r"\bprovided (?:that|for) in Article\s+(\d+\w*)",
        ),
    ),
    (
        "procedural",
        (
            r"\bin accordance with (?:Article|paragraph|point)\s+(\d+\w*)",
            r"\bcalculated (?:in accordance with|pursuant to|as set out in) Article\s+(\d+\w*)",
            r"\bas laid down in Article\s+(\d+\w*)",
            r"\bas (?:provided|specified|set out) in Article\s+(\d+\w*)",
            r"\bpursuant to Article\s+(\d+\w*)",
        ),
    ),
    ("back_reference", (r"\breferred to in Article\s+(\d+\w*)", r"\bmentioned in Article\s+(\d+\w*)")),
)
BEFORE, AFTER = 120, 30
MENTION = r"(?iU)Articles?\s+(\d\w*)\b"


def priority(kind: Column) -> Column:
    out = F.lit(99)
    for name, p in PRIORITY.items():
        out = F.when(kind == name, p).otherwise(out)
    return out


def told_mentions(text: Column) -> Column:
    """(target, kind) of each mention of an article whose surroundings tell its kind, in order: a text is searched once for all of them.

    Contexts may overlap: places are those after each piece of the text that a
    mention ends, and each context is cut from the whole text.
    """
    pieces, found = F.split(text, MENTION, -1), F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))
    # The running length of pieces and mentions gives each mention's place.
    places = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, i: F.struct((s["at"] + F.length(F.get(pieces, i)) + F.length(F.get(found, i))).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(F.get(pieces, i)))).alias("out")),
    )["out"]

    def kind(context: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, forms in reversed(WORDING):
            hit = F.lit(False)
            for f in forms:
                hit = hit | context.rlike("(?iU)" + f)
            out = F.when(hit, name).otherwise(out)
        return out

    contexts = F.zip_with(places, found, lambda at, m: F.substring(text, F.greatest(F.lit(1), at - BEFORE), F.least(at - 1, F.lit(BEFORE)) + F.length(m) + AFTER))
    told = F.zip_with(found, contexts, lambda m, c: F.struct(F.lower(F.regexp_extract(m, MENTION, 1)).alias("target"), kind(c).alias("kind")))
    return F.filter(told, lambda x: x["kind"].isNotNull())


def classify_reference(text: Column, target: Column) -> Column:
    """The kind of the first mention of an article whose surroundings tell it; ``general`` if none does."""
    return kind_of(told_mentions(text), target)


def kind_of(told: Column, target: Column) -> Column:
    return F.coalesce(F.get(F.filter(told, lambda x: x["target"] == F.lower(target)), F.lit(0))["kind"], F.lit("general"))


def build_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, kind, pos) from (article, refs, text) rows; no blanks, no self-loops."""
    told = nodes.select("article", "refs", told_mentions(F.col("text")).alias("told"))
    e = told.select(F.col("article").alias("src"), "told", F.posexplode("refs").alias("pos", "dst")).where("dst <> '' and dst <> src")
    return e.select("src", "dst", kind_of(F.col("told"), F.col("dst")).alias("kind"), "pos")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("back_reference").alias("kind"), "pos")


def _most_met(front: DataFrame, outside: DataFrame | None) -> int:
    """The most nodes that one query's walk reaches, begins with and leaves out."""
    asked = front.groupBy("query_id").agg((F.count("*") + F.max("budget")).alias("n"))
    if outside is not None:
        left_out = outside.groupBy("query_id").agg(F.count("*").alias("o"))
        asked = asked.join(left_out, "query_id", "left").withColumn("n", F.col("n") + F.coalesce("o", F.lit(0)))
    return asked.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _first_edges(edges: DataFrame, most: int) -> DataFrame:
    """Of each node's edges (src, dst, p, e) those to its first ``most`` nodes, each by its first edge.

    A walk takes a node's edges in this order, whichever query walks. A node that
    is not among them has ``most`` before it, of which a query can have seen or left
    out some and takes the others first: it is reached from elsewhere or not at all.
    """
    once = edges.groupBy("src", "dst").agg(F.min(F.struct("p", "e")).alias("at"))
    in_order = Window.partitionBy("src").orderBy("at", "dst")
    return once.withColumn("_n", F.row_number().over(in_order)).where(F.col("_n") <= most).select("src", "dst", "at.p", "at.e")


def traverse(seeds: DataFrame, edges: DataFrame, depth: int, budget: Column, exclude: DataFrame | None = None, direction: str = "forward") -> DataFrame:
    """(query_id, article, depth, rank): articles reached from the seeds (query_id, article, pos), nearest first.

    Semi-naive: a level joins only the level before with the edges, and is written
    to the shared folder with its ranks, so that no level's plan holds another's.
    A node's out-edges come by priority and place, after those of nodes that rank
    before it; a node counts where it is first met. Seeds, rows of ``exclude``
    (query_id, article) and the article of definitions are never reached. ``budget``,
    a column of the seeds, is the most that a query reaches; a query that has it
    is walked no further. The walk ends with the first level that reaches nothing.
    """
    spark, base = seeds.sparkSession, shared_folder(seeds.sparkSession, "walk")
    if direction == "reverse":
        edges = reversed_edges(edges)
    # Ranks of seeds come before all others: 1 - their number and up to 0.
    own = seeds.groupBy("query_id", "article").agg(F.min("pos").alias("pos"), F.max(budget).alias("budget"))
    in_order = Window.partitionBy("query_id").orderBy(F.col("pos").desc(), F.col("article").desc())
    front = stored(own.select("query_id", "article", F.lit(0).alias("depth"), (1 - F.row_number().over(in_order)).alias("rank"), "budget"), f"{base}/seen/level=0")
    columns = front.schema
    outside = None if exclude is None else stored(exclude.select("query_id", "article").distinct(), f"{base}/exclude")
    every = edges.where(F.col("dst") != SKIPPED).select("src", "dst", priority(F.col("kind")).alias("p"), F.col("pos").alias("e"))
    out = stored(_first_edges(every, _most_met(front, outside)), f"{base}/edges")
    for d in range(1, depth + 1):
        seen = spark.read.schema(columns).parquet(f"{base}/seen")
        met = front.join(out, front["article"] == out["src"]).groupBy("query_id", F.col("dst").alias("article")).agg(F.min(F.struct("rank", "p", "e")).alias("at"))
        new = met.join(seen.select("query_id", "article"), ["query_id", "article"], "left_anti")
        if outside is not None:
            new = new.join(outside, ["query_id", "article"], "left_anti")
        so_far = seen.groupBy("query_id").agg(F.max("rank").alias("n"), F.max("budget").alias("budget")).where("n < budget")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "article"))
        ranked = new.join(so_far, "query_id").withColumn("rank", F.col("n") + place).where("rank <= budget")
        front = stored(ranked.select("query_id", "article", F.lit(d).alias("depth"), "rank", "budget"), f"{base}/seen/level={d}")
        if front.isEmpty():
            break
    return spark.read.schema(columns).parquet(f"{base}/seen").where("depth > 0").select("query_id", "article", "depth", "rank")


def walk(seeds: DataFrame, edges: DataFrame, depth: int, budget: Column) -> DataFrame:
    """``traverse`` without exclusions."""
    return traverse(seeds, edges, depth, budget)


def expansion(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2, most_citing: int = 2, most_siblings: int = 3, exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, article, rank): what the graph adds to seeds (query_id, article, pos, budget), but for those of ``exclude`` (query_id, article).

    First what they refer to; then, within what is left of the budget, up to two
    articles that refer to them, and up to three of the first two seeds' section.
    """
    base = shared_folder(seeds.sparkSession, "expansion")
    seeds = stored(seeds, f"{base}/seeds")
    # Edges are found by searching texts: once for both walks.
    edges = stored(edges.select("src", "dst", "kind", "pos"), f"{base}/edges")
    outside = stored((exclude if exclude is not None else seeds).select("query_id", "article").distinct(), f"{base}/outside")
    taken = lambda: outside.unionByName(found.select("query_id", "article"))
    found = stored(traverse(seeds, edges, depth, F.col("budget"), exclude=outside).select("query_id", "article", "rank"), f"{base}/found/part=0")

    def left(most: int) -> DataFrame:
        """The seeds of queries that may still take some, with how many."""
        n = found.groupBy("query_id").agg(F.count("*").alias("n"))
        return seeds.join(n, "query_id", "left").withColumn("budget", F.least(F.lit(most), F.col("budget") - F.coalesce("n", F.lit(0)))).where("budget > 0").drop("n")

    def add(part: int, rows: DataFrame) -> DataFrame:
        n = found.groupBy("query_id").agg(F.max("rank").alias("n"))
        stored(rows.join(n, "query_id", "left").select("query_id", "article", (F.col("rank") + F.coalesce("n", F.lit(0))).cast("int").alias("rank")), f"{base}/found/part={part}")
        return seeds.sparkSession.read.schema(found.schema).parquet(f"{base}/found").select(*found.columns)

    found = add(1, traverse(left(most_citing), edges, 1, F.col("budget"), exclude=taken(), direction="reverse"))
    more = left(most_siblings)
    near = siblings(more, nodes, most_siblings, exclude=taken()).join(more.groupBy("query_id").agg(F.max("budget").alias("budget")), "query_id").where(F.col("rank") <= F.col("budget"))
    return add(2, near)


def siblings(seeds: DataFrame, nodes: DataFrame, most: int = 3, of_first: int = 2, exclude: DataFrame | None = None) -> DataFrame:
    """Other articles of the first seeds' section (within its chapter), or else chapter, title and part.

    With ``exclude`` (query_id, article), these and the article of definitions are left out as well as the seeds.
    """
    out = seeds.select("query_id", "article")
    if exclude is not None:
        out = out.unionByName(exclude.select("query_id", "article"))
        nodes = nodes.where(F.col("article") != SKIPPED)
    place = F.when(F.nullif("section", F.lit("")).isNotNull(), F.concat_ws("|", F.lit("s"), "section", F.coalesce("chapter", F.lit("")))).otherwise(F.concat_ws("|", F.lit("c"), F.coalesce("chapter", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("part", F.lit(""))))
    at = nodes.groupBy("article", place.alias("place")).agg(F.min("pos").alias("pos"))
    # Of each place, its first articles are enough: ``most`` besides all that one query leaves out.
    many = out.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    in_order = Window.partitionBy("place").orderBy("pos", "article")
    firsts = at.withColumn("_n", F.row_number().over(in_order)).where(F.col("_n") <= most + many).drop("_n")
    own = seeds.where(F.col("pos") <= of_first).join(at.select("article", "place"), "article").select("query_id", F.col("pos").alias("seed_pos"), "place")
    near = own.join(firsts, "place").join(out, ["query_id", "article"], "left_anti")
    once = near.groupBy("query_id", "article").agg(F.min(F.struct("seed_pos", "pos")).alias("o"))
    w = Window.partitionBy("query_id").orderBy("o", "article")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "article", "rank")


def listed_expansion(hits: DataFrame, limit: int = 3, sources: int = 3, nodes: DataFrame | None = None) -> DataFrame:
    """(query_id, article, rank): without a graph, articles that the first hits refer to, by number.

    ``hits`` has query_id, rank, article and ``refs``, a list with commas. The
    hits' own articles and the article of definitions are left out. With ``nodes``
    (article, refs), what is left of the limit goes to articles that those found
    refer to in turn.
    """

    def listed(rows: DataFrame, known: DataFrame) -> DataFrame:
        named = rows.select("query_id", F.explode(F.split("refs", ",")).alias("article")).select("query_id", F.trim("article").alias("article")).where("article <> ''").distinct()
        return named.join(known, ["query_id", "article"], "left_anti").where(F.col("article") != SKIPPED)

    known = hits.select("query_id", "article").distinct()
    w = Window.partitionBy("query_id").orderBy(*article_order(F.col("article")))
    first = listed(hits.where(F.col("rank") <= sources), known).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    if nodes is None:
        return first
    first = stored(first, shared_folder(hits.sparkSession, "listed"))
    again = listed(first.join(nodes.select("article", "refs"), "article"), known.unionByName(first.select("query_id", "article")))
    n = first.groupBy("query_id").agg(F.count("*").alias("n"))
    second = again.join(n, "query_id").withColumn("rank", F.row_number().over(w) + F.col("n").cast("int")).where(F.col("rank") <= limit).drop("n")
    return first.unionByName(second)


def annex_expansion(hits: DataFrame, limit: int = 3, sources: int = 3) -> DataFrame:
    """(query_id, annex_id, rank): annexes that the first hits refer to and no hit is, in their own order."""
    named = hits.where(F.col("rank") <= sources).select("query_id", F.explode(F.split("annex_refs", ",")).alias("a")).select("query_id", F.upper(F.trim("a")).alias("annex_id")).distinct()
    known = F.create_map(*(F.lit(x) for i, r in enumerate(ROMAN[:4]) for x in (r, i)))
    new = named.withColumn("_i", F.try_element_at(known, "annex_id")).where("_i is not null").join(hits.where("annex_id is not null").select("query_id", "annex_id").distinct(), ["query_id", "annex_id"], "left_anti")
    return new.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_i"))).where(F.col("rank") <= limit).drop("_i")


def fetch(wanted: DataFrame, nodes: DataFrame, key: str = "article") -> DataFrame:
    """The node of each wanted article or annex (query_id, language, ``key``, rank) in the query's language: a whole one, the first where there are several."""
    level = "ANNEX" if key == "annex_id" else "ARTICLE"
    whole = nodes.where((F.col("level") == level) & (F.col("chunk_type") == "ARTICLE"))
    one = whole.groupBy(key, "language").agg(F.min("node_id").alias("node_id"))
    return wanted.join(one, [key, "language"]).select("query_id", key, "language", "rank", "node_id")


def family(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Articles of the same family: 429, 429a, 429b ..."""
    root = F.regexp_replace("article", r"^(\d+)[A-Za-z]+$", "$1")
    members = nodes.select("article").distinct().withColumn("root", root)
    asked = seeds.select("query_id", F.col("article").alias("seed"), F.regexp_replace("article", r"^(\d+)[A-Za-z]+$", "$1").alias("root"))
    return asked.join(members, "root").where("article <> seed").select("query_id", "article").distinct()


def citing(articles: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, article): articles whose references hold the target as a whole token."""
    refs = nodes.select("article", F.explode("refs").alias("target"))
    return refs.join(articles.select(F.col("article").alias("target")), "target").select("target", "article").distinct()


def reach(seeds: DataFrame, edges: DataFrame, most_depth: int) -> DataFrame:
    """(query_id, article, depth) for any depth, each node where it is first met; levels are stored as in ``traverse``."""
    spark, base = seeds.sparkSession, shared_folder(seeds.sparkSession, "reach")
    edges = stored(edges.select("src", "dst").distinct(), f"{base}/edges")
    front = stored(seeds.select("query_id", "article", F.lit(0).alias("depth")).distinct(), f"{base}/seen/level=0")
    columns = front.schema
    for d in range(1, most_depth + 1):
        seen = spark.read.schema(columns).parquet(f"{base}/seen")
        met = front.join(edges, front["article"] == edges["src"]).select("query_id", F.col("dst").alias("article")).distinct()
        front = stored(met.join(seen.select("query_id", "article"), ["query_id", "article"], "left_anti").withColumn("depth", F.lit(d)), f"{base}/seen/level={d}")
        if front.isEmpty():
            break
    return spark.read.schema(columns).parquet(f"{base}/seen").select(*columns.names)
