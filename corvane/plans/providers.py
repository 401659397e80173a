"""Where models plug in: each provider adds columns to a DataFrame; the defaults are offline and deterministic.

A model that needs Python comes as an iterator pandas UDF, loaded once a worker
(see ``batched``); nothing else in the engine knows which provider is used.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, tokens

WIDTH = 64


def batched(load: Callable[[], Callable[[pd.Series], pd.Series]], kind: str):
    """A text model as an iterator pandas UDF: loaded once a worker, fed in Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield model(batch)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def _load_hashing() -> Callable[[pd.Series], pd.Series]:
    word = re.compile("[a-z0-9]+")

    def vector(text: str | None) -> list[float]:
        marks = np.fromiter((zlib.crc32(w.encode()) for w in word.findall((text or "").lower())), np.int64)
        return np.bincount(marks % WIDTH, weights=1.0 - 2.0 * ((marks >> 16) & 1), minlength=WIDTH).tolist()

    return lambda texts: texts.map(vector)


def hashed_vector(text: Column) -> Column:
    """Signed counts of hashed words: the offline stand-in for an embedding model."""
    return batched(_load_hashing, "array<double>")(text)


#: What an encoder gives for a text: a dense vector, and the weights that it has learned for terms.
ENCODED = "struct<dense:array<double>,sparse:map<bigint,double>>"


def lexical_weights(text: Column) -> Column:
    """The offline stand-in for learned term weights: of each hashed word, the logarithm of its count, scaled to length 1.

    Terms of one hash keep the greatest weight, as repeated tokens of a model do. A text without words has no weight.
    """
    words = F.sort_array(F.coalesce(tokens(text), F.array().cast("array<string>")))

    def weigh(w: Column) -> Column:
        edges = F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: (i == 0) | (i == F.size(w)) | (F.get(w, i) != F.get(w, i - 1)))

        def runs(e: Column) -> Column:
            counted = F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(e) - 2, F.lit(0))),
                lambda j: F.struct(F.conv(F.substring(F.md5(F.get(w, F.get(e, j))), 1, 7), 16, 10).cast("bigint").alias("term"), F.log1p((F.get(e, j + 1) - F.get(e, j)).cast("double")).alias("v")),
            )
            return let(F.sort_array(counted), scaled)

        return F.when(F.size(w) > 0, let(edges, runs)).otherwise(F.create_map().cast("map<bigint,double>"))

    def scaled(c: Column) -> Column:
        # In order of terms and weights: of equal terms the last one, with the greatest weight, stays.
        once = F.filter(c, lambda x, i: (i == F.size(c) - 1) | (F.get(c, i + 1)["term"] != x["term"]))
        norm = lambda o: F.sqrt(F.aggregate(o, F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))
        return let(once, lambda o: let(norm(o), lambda n: F.map_from_entries(F.transform(o, lambda x: F.struct(x["term"], F.round(x["v"] / n, 4))))))

    return let(words, weigh)


def encode_both(text: Column) -> Column:
    """Dense and sparse vector of a text, as ENCODED."""
    return F.struct(hashed_vector(text).alias("dense"), lexical_weights(text).alias("sparse"))


def overlap_score(query: Column, text: Column) -> Column:
    """The share of the query's words that the text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def extract_answer(context: Column, sections: int = 1) -> Column:
    """The first sections of the context, without the list of thresholds before them."""
    return F.substring_index(F.regexp_replace(context, r"(?s)^KEY NUMERICAL THRESHOLDS.*?\n\n", ""), "\n\n---\n\n", sections)


@dataclass
class Providers:
    """Embedding, pair scoring, query rewriting, sub-questions, synthesis and judging, as Column functions."""

    embed: Callable[[Column], Column] = hashed_vector
    #: Both vectors at once, as a model with two heads gives them.
    encode: Callable[[Column], Column] = encode_both
    score: Callable[[Column, Column], Column] = overlap_score
    rewrite: Callable[[Column], Column] = lambda q: q
    #: A question that follows others, from it and its conversation's history; null keeps it as it is.
    follow_up: Callable[[Column, Column], Column] = lambda q, history: q
    #: A written passage with article hints (see ``parse_passage``), or article hints alone, for open questions; None: neither.
    hypothesis: Callable[[Column], Column] | None = None
    hints: Callable[[Column], Column] | None = None
    #: Articles that the table of contents suggests for a question, as ``parse_routes`` gives them; None: no routing.
    route: Callable[[Column], Column] | None = None
    #: None: questions aren't taken apart.
    sub_questions: Callable[[Column], Column] | None = None
    answer: Callable[[Column, Column], Column] = lambda q, c: extract_answer(c)
    judge: Callable[[Column, Column], Column] = lambda a, ref: F.lit(None).cast("double")


def coalesced(primary: Column, fallback: Column) -> Column:
    """The provider's answer, or the fallback where it gave none."""
    return F.coalesce(primary, fallback)


def clamp(score: Column) -> Column:
    """The score within 0 and 1; NULL stays NULL."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def parse_sub_questions(text: Column, most: int = 3) -> Column:
    """Lines without their numbering, the first three."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[\d.\-) ]+", "")))
    return F.slice(F.filter(lines, lambda s: s != ""), 1, most)


def parse_passage(text: Column) -> dict[str, Column]:
    """The passage and the article hints of a written hypothetical answer."""
    hints = F.trim(F.regexp_extract(text, r"(?i)ARTICLES\s*:\s*([^\n]*)", 1))
    return {"passage": F.trim(F.regexp_extract(text, r"(?is)PASSAGE\s*:\s*(.*?)(?:\n\s*ARTICLES\s*:|\z)", 1)), "hints": F.when(hints.rlike(r"^[\w,\s]+$"), hints)}


def valid_hints(text: Column) -> Column:
    """Hints that look like article numbers; else null."""
    return F.when(F.trim(text).rlike(r"^[\w,\s]+$"), F.trim(text))


def with_hints(text: Column, hints: Column) -> Column:
    """A question or passage with article hints behind it."""
    return F.when(F.coalesce(hints, F.lit("")) != "", F.concat(text, F.lit(" [Relevant CRR articles: "), hints, F.lit("]"))).otherwise(text)


def parse_routes(text: Column, most: int = 6) -> Column:
    """Article numbers of a JSON answer, or else any in the text."""
    bare = F.trim(F.regexp_replace(text, r"```(?:json)?", ""))
    listed = F.coalesce(F.from_json(F.get_json_object(bare, "$.articles"), "array<string>"), F.from_json(F.when(bare.startswith("["), bare), "array<string>"), F.regexp_extract_all(bare, F.lit(r"\b\d+[a-z]*\b"), F.lit(0)))
    return F.slice(F.filter(listed, lambda a: a.rlike(r"^\d+[a-z]*$")), 1, most)


def salvage_json(text: Column, schema: str) -> Column:
    """Objects of a JSON answer: fences off, the whole, its list, or each object apart."""
    bare = F.trim(F.regexp_replace(text, r"```(?:json)?", ""))
    whole = F.from_json(F.when(bare.startswith("["), bare), f"array<{schema}>")
    part = F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.lit("")), f"array<{schema}>")
    each = F.filter(F.transform(F.regexp_extract_all(bare, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda s: F.from_json(s, schema)), lambda x: x.isNotNull())
    return F.coalesce(whole, part, each)
