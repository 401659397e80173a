"""Context assembly and what is done to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import listed
from ..functions.text import let

SEPARATOR = "\n\n---\n\n"
MOST_CHARS = 100_000
#: Places of a table of contents that one task orders.
BLOCK = 10_000
# Forms of numerical thresholds.
THRESHOLDS = (
    r"(?iU)\b\d[\d,.]*%",
    r"(?iU)\b\d+\s*(?:calendar\s+)?(?:days?|months?|years?|business\s+days?)",
    r"(?iU)\bEUR\s*[\d,.]+(?:\s*(?:million|billion))?",
    r"(?iU)\b\d+(?:\.\d+)?\s*basis\s+points?",
)


def thresholds(text: Column) -> Column:
    """All thresholds of a text: distinct, trimmed, in order."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in THRESHOLDS)))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.trim(x))))


def _header(section: Column) -> Column:
    return F.get(F.split(F.trim(section), "\n"), F.lit(0))


# What stands before the list of thresholds, and before those that an answer leaves out.
FACTS = "KEY NUMERICAL THRESHOLDS (extracted from retrieved articles — ensure ALL relevant ones are addressed in your answer):\n"
NOTE = "\n\n> **Completeness note:** The following numerical thresholds appear in the cited articles but were not explicitly stated above: "


def key_facts(context: Column) -> Column:
    """A heading and a line with its thresholds for each section that has any; empty if none has."""

    def line(s: Column) -> Column:
        return let(thresholds(s), lambda t: F.when(F.size(t) > 0, F.concat(F.lit("- "), _header(s), F.lit(": "), F.array_join(t, ", "))))

    lines = F.filter(F.transform(F.split(context, SEPARATOR), line), lambda x: x.isNotNull())
    return let(lines, lambda n: F.when(F.size(n) > 0, F.concat(F.lit(FACTS), F.array_join(n, "\n"), F.lit("\n\n"))).otherwise(""))


def missing_thresholds(context: Column, answer: Column) -> Column:
    """``Article N: a, b`` for each cited article's thresholds that the answer doesn't state."""
    cited = F.regexp_extract_all(answer, F.lit(r"(?iU)Article\s+(\w+)"), F.lit(1))

    def note(s: Column) -> Column:
        def told(article: Column) -> Column:
            absent = F.filter(thresholds(s), lambda t: F.instr(answer, t) == 0)
            listed_ = let(absent, lambda a: F.when(F.size(a) > 0, F.concat(F.lit("Article "), article, F.lit(": "), F.array_join(a, ", "))))
            return F.when((article != "") & F.array_contains(cited, article), listed_)

        # Each section's header and thresholds are searched once, and thresholds only of articles that are cited.
        return let(F.regexp_extract(_header(s), r"(?iU)^Article\s+(\w+)", 1), told)

    return F.array_join(F.filter(F.transform(F.split(context, SEPARATOR), note), lambda x: x.isNotNull()), "; ")


def completed(context: Column, answer: Column) -> Column:
    """The answer, with a note of its cited articles' thresholds that it doesn't state."""
    return let(missing_thresholds(context, answer), lambda m: F.when(m == "", answer).otherwise(F.concat(answer, F.lit(NOTE), m, F.lit("."))))


def build_context(hits: DataFrame, parents: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(query_id, context): a section for each hit in order of rank.

    With ``parents`` (article, language, text), there is one section an article,
    where it first appears, with the parent's whole text where it has one. Many
    hits are dealt over as many ``tasks`` as keep one task's share bounded; the
    session's number of partitions doesn't grow with them.
    """

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        return rows if tasks is None else rows.repartition(tasks, *by)

    if parents is not None:
        hits = dealt(hits.withColumn("_a", F.coalesce(F.nullif("article", F.lit("")), F.col("node_id").cast("string"))), "query_id", "_a")
        w = Window.partitionBy("query_id", "_a").orderBy("rank", "node_id")
        first = hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_a")
        whole = parents.select("article", "language", F.col("text").alias("_whole"))
        hits = first.join(whole, ["article", "language"], "left").withColumn("text", F.coalesce("_whole", "text")).drop("_whole")
    head = F.concat_ws(" — ", F.concat(F.lit("Article "), F.col("article")), F.nullif("article_title", F.lit("")))
    sections = dealt(hits.select("query_id", "rank", F.concat(head, F.lit("\n\n"), "text").alias("s")), "query_id")
    rows = F.array_sort(F.collect_list(F.struct("rank", "s")))
    return sections.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["s"]), SEPARATOR).alias("context"))


def truncate(context: Column, most: int = MOST_CHARS) -> Column:
    """At most so many characters, cut before the last separator among them if there is one."""
    window = F.substring(context, 1, most)
    last = F.instr(F.reverse(window), SEPARATOR[::-1])
    at = F.char_length(window) - last - len(SEPARATOR) + 1
    return F.when(F.char_length(context) <= most, context).when((last > 0) & (at > 0), F.substring(window, F.lit(1), at)).otherwise(window)


def history(turns: DataFrame, last: int = 5) -> DataFrame:
    """(conv_id, history): the last exchanges as Q/A lines, oldest first."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    line = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer")
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("s")))), lambda r: r["s"]), "\n").alias("history"))


def exchanges(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): a user's turn and the assistant's after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = conversations.withColumns({"_role": F.lead("role").over(w), "_text": F.lead("text").over(w)})
    return paired.where("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), F.col("_text").alias("answer"))


def key_terms(nodes: DataFrame, words: int = 50) -> DataFrame:
    """(article, key_terms): the first words of an article's first text."""
    text = nodes.where("trim(text) <> ''").groupBy("article").agg(F.min(F.struct("pos", "text")).alias("m"))
    return text.select("article", F.array_join(F.slice(F.split(F.trim("m.text"), r"\s+"), 1, words), " ").alias("key_terms"))


def outline(entries: DataFrame) -> DataFrame:
    """Lines of a table of contents: a heading where it changes, then the article, indented by depth; annexes last.

    Rows are handled in blocks of BLOCK places of a language, so that no task gets a
    whole language; a block is told the last row before it, for its first heading.
    Entries with ``key_terms`` show up to 50 words of them.
    """
    levels = [("Part", "part"), ("Title", "title"), ("Chapter", "chapter"), ("Section", "section")]
    names = [c for _, c in levels]
    blocks = entries.withColumn("_b", F.floor(F.col("pos") / BLOCK))
    here = ["language", "is_annex", "_b"]
    place = F.struct(*names)
    lasts = blocks.groupBy(*here).agg(F.max_by(place, "pos").alias("_p"))
    # A row for each block, few enough to be ordered within a language.
    before = lasts.withColumn("_before", F.lag(F.struct(F.col("_p").alias("p"))).over(Window.partitionBy("language").orderBy("is_annex", "_b"))).select(*here, "_before")
    w = Window.partitionBy(*here).orderBy("pos")
    told = blocks.join(before, here).withColumn("_prev", F.coalesce(F.lag(F.struct(place.alias("p"))).over(w), F.col("_before")))
    lines, changed = [], F.col("_prev").isNull()
    for depth, (name, c) in enumerate(levels):
        has = F.nullif(F.col(c), F.lit("")).isNotNull()
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_prev.p.{c}"))
        lines.append(F.when(has & changed, F.concat(F.lit("  " * depth + name + " "), F.col(c))))
    article = F.concat(F.lit("  " * len(levels)), F.when(F.col("is_annex"), "Annex ").otherwise("Article "), "article", F.lit(" — "), "article_title")
    if "key_terms" in entries.columns:
        terms = F.array_join(F.slice(F.split(F.trim(F.coalesce("key_terms", F.lit(""))), r"\s+"), 1, 50), " ")
        article = F.when(terms != "", F.concat(article, F.lit(" | Key terms: "), terms)).otherwise(article)
    return told.select("language", "pos", F.array_join(F.array_compact(F.array(*lines, article)), "\n").alias("lines"))


def article_text(nodes: DataFrame) -> DataFrame:
    """(article, language, text): an article's chunks joined in order, each node once; the article of definitions is left out."""
    once = nodes.where("article <> '4'").groupBy("article", "language", "node_id").agg(F.min(F.struct("pos", "text")).alias("m"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("m.pos").alias("pos"), "node_id", F.col("m.text").alias("text"))))
    return once.groupBy("article", "language").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("text"))


def article_view(nodes: DataFrame) -> DataFrame:
    """What a reader of an article sees, by article and language: its first node's place, its text, and what it refers to.

    Nodes come in order of ``pos``, each id once; blank texts are left out.
    """
    of = ["article", "language"]
    place = ["article_title", "part", "title", "chapter", "section", "referenced_articles", "referenced_external"]
    once = nodes.where("article is not null").groupBy(*of, "node_id").agg(F.min(F.struct("pos", "text", *place)).alias("m"))
    in_order = F.array_sort(F.collect_list(F.struct(F.col("m.pos").alias("pos"), "node_id", F.col("m.text").alias("text"))))
    first = F.min_by("m", F.struct("m.pos", "node_id"))
    seen = once.groupBy(*of).agg(F.filter(F.transform(in_order, lambda r: r["text"]), lambda t: F.trim(t) != "").alias("texts"), first.alias("f"))
    return seen.select(*of, *(F.col(f"f.{c}").alias(c) for c in place[:5]), *(listed(F.col(f"f.{c}")).alias(c) for c in place[5:]), F.array_join("texts", "\n\n").alias("text"))


def choose_prompt(kind: Column, confidence: Column, direct: Column, has_history: Column) -> Column:
    weak = (kind == "SPECIFIC") & (F.coalesce(confidence, F.lit(0.0)) < 0.40) & direct.isNull()
    return F.when(weak, "fallback").when(has_history, "with_history").otherwise("default")


def parse_definitions(texts: DataFrame) -> DataFrame:
    """(language, number, term, text): numbered definitions that begin with a quoted term; a number's last one stays."""
    plain = F.regexp_replace(F.trim("text"), r"\s+", " ")
    opening = F.instr(F.substring(plain, 1, 500), "(1) ") > 0
    # Two splitters; the text tells which holds.
    cut = lambda p: F.arrays_zip(F.regexp_extract_all("_t", F.lit(p), F.lit(1)).alias("number"), F.slice(F.split("_t", p), F.lit(2), F.size(F.split("_t", p))).alias("body"))
    both = F.when(opening, cut(r"\((\d+[a-z]?(?: bis| ter)?)\) ")).otherwise(cut(r"(?<![(\w])(\d+[a-z]?(?: bis| ter)?)\) "))
    rows = texts.withColumn("_t", plain).select("language", F.posexplode(both).alias("pos", "d")).select("language", "pos", "d.number", F.trim("d.body").alias("body"))
    term = F.regexp_extract("body", "^['‘“«\"]([^'’”»\"]+)['’”»\"]", 1)
    good = rows.withColumn("term", F.lower(F.trim(term))).where("term <> ''")
    last = good.groupBy("language", "number").agg(F.max_by(F.struct("term", "body"), "pos").alias("m"))
    return last.select("language", "number", "m.term", F.regexp_replace("m.body", r"[;. ]+$", "").alias("text"))


def lookup_definitions(signals: DataFrame, definitions: DataFrame, fallback: str = "en") -> DataFrame:
    """(query_id, number, term, text) for signals ``#N`` or a term, in the query's language or else the fallback's."""
    key = F.explode(F.array(F.concat(F.lit("#"), "number"), "term"))
    book = definitions.select("language", key.alias("signal"), "number", "term", "text").dropDuplicates(["language", "signal"])
    own = signals.join(book, ["language", "signal"], "left")
    other = book.where(F.col("language") == fallback).select("signal", *(F.col(c).alias(f"_{c}") for c in ("number", "term", "text")))
    both = own.join(other, "signal", "left")
    return both.select("query_id", *(F.coalesce(c, f"_{c}").alias(c) for c in ("number", "term", "text"))).where("text is not null")


def definition_answer(found: DataFrame) -> DataFrame:
    """(query_id, answer) of looked-up definitions."""
    head = F.concat(F.lit("**Article 4("), "number", F.lit(") — Definition of '"), "term", F.lit("'**\n\n"))
    return found.select("query_id", F.concat(head, F.col("text")).alias("answer"))


def definition_summary(definitions: DataFrame, terms: int = 10) -> DataFrame:
    """(language, answer): what the article of definitions holds, for questions about it as a whole.

    The first terms are those of the least numbers; a language has a bounded list, of which only these are gathered.
    """
    number = F.regexp_extract("number", r"^(\d+)", 1).try_cast("long")
    w = Window.partitionBy("language").orderBy(number, "number")
    first = definitions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= terms).groupBy("language").agg(F.array_sort(F.collect_list(F.struct("_n", "term"))).alias("t"))
    counted = definitions.groupBy("language").agg(F.count("*").alias("n")).join(first, "language")
    said = F.concat(F.lit("Article 4 is the article of definitions. It contains "), "n", F.lit(" definitions including: "), F.array_join(F.transform("t", lambda x: x["term"]), ", "), F.lit(". Ask about a specific term."))
    return counted.select("language", said.alias("answer"))
