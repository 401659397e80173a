"""Language identification by profiles of character trigrams, scored by kernels over batches of texts or by one expression.

A profile holds, for each language, its most frequent trigrams with the logarithm of
their smoothed share; a text's score is the sum over its own trigrams, those outside
the profile counting as unseen. Profiles are learned from labelled texts; without
any, those of three short passages in each language serve questions.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.workspace import shared_folder, stored
from .text import LETTERS, let

#: Trigrams that a language's profile keeps.
MOST_GRAMS = 500
#: Characters that a task handles at once, whatever the length of a text.
CHARS = 1 << 20
#: Bits of a character; three of them are a trigram's number.
BITS = 21
#: Weights are whole millionths, so that sums are exact in any order.
MILLION = 1_000_000
#: How far the best language of a question must be before the next one, for each trigram.
LEAST_MARGIN = 0.02
# The first articles of the Universal Declaration of Human Rights, as published by the United Nations.
SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. "
    "Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion, national or social origin, property, birth or other status. "
    "Everyone has the right to life, liberty and security of person. What is the requirement and which institutions shall apply it?",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. "
    "Ad ogni individuo spettano tutti i diritti e tutte le libertà enunciate nella presente Dichiarazione, senza distinzione alcuna, per ragioni di razza, di colore, di sesso, di lingua, di religione, di opinione politica o di altro genere, di origine nazionale o sociale, di ricchezza, di nascita o di altra condizione. "
    "Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. Qual è il requisito e quali enti devono applicarlo?",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    "Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej Deklaracji bez względu na jakiekolwiek różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych, narodowości, pochodzenia społecznego, majątku, urodzenia lub jakiegokolwiek innego stanu. "
    "Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swojej osoby. Jaki jest wymóg i które instytucje muszą go stosować?",
}


def plain(text: Column) -> Column:
    """Lower case, with one blank for each run of what isn't a letter, and one at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def grams(text: Column) -> Column:
    """A text's trigrams, with repeats, in one pass: each place where three characters lie ahead. A null text has none."""
    return F.coalesce(F.regexp_extract_all(plain(text), F.lit("(?s)(?=(...))"), F.lit(1)), F.array().cast("array<string>"))


def _numbered(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, rows, starts): the trigrams of some texts as numbers, in order, the texts' places, and where each one's trigrams begin. A long text comes in pieces."""
    rows: list[int] = []
    pieces: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        for i in range(0, len(text or "") - 2, CHARS):
            rows.append(row)
            pieces.append(text[i : i + CHARS + 2])
            held += len(pieces[-1])
            if held >= CHARS:
                yield _together(rows, pieces)
                rows, pieces, held = [], [], 0
    if pieces:
        yield _together(rows, pieces)


def _together(rows: list[int], pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    numbers = points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:]
    ends = np.cumsum([len(p) for p in pieces])
    # The last two places of a piece reach into the next one.
    inside = np.ones(len(numbers), dtype=bool)
    inside[ends[:-1] - 1] = inside[ends[:-1] - 2] = False
    return numbers[inside], np.array(rows), np.concatenate([[0], ends[:-1] - 2 * np.arange(1, len(ends))])


def _as_grams(numbers: np.ndarray) -> list[str]:
    points = np.stack([numbers >> 2 * BITS, numbers >> BITS & (1 << BITS) - 1, numbers & (1 << BITS) - 1], axis=1)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + 3] for i in range(0, len(text), 3)]


def _as_numbers(grams: Sequence[str]) -> np.ndarray:
    return np.array([ord(g[0]) << 2 * BITS | ord(g[1]) << BITS | ord(g[2]) for g in grams], dtype=np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, gram, c) of (language, t), summed within some texts."""
    for batch in batches:
        of: dict[str, list[str | None]] = {}
        for language, text in zip(batch.column("language").to_pylist(), batch.column("t").to_pylist(), strict=True):
            of.setdefault(language, []).append(text)
        for language, texts in of.items():
            for numbers, _, _ in _numbered(texts):
                found, c = np.unique(numbers, return_counts=True)
                yield pa.RecordBatch.from_pydict({"language": pa.array([language] * len(found), pa.string()), "gram": pa.array(_as_grams(found), pa.string()), "c": pa.array(c, pa.int64())})


def fit(texts: DataFrame, most: int = MOST_GRAMS) -> DataFrame:
    """(language, gram, weight) from (language, text), in millionths; the empty gram has the weight of all that are unseen."""
    some = texts.where("language is not null").select("language", plain(F.col("text")).alias("t")).mapInArrow(_counted, "language string, gram string, c long")
    counts = some.groupBy("language", "gram").agg(F.sum("c").alias("c"))
    # Texts are read once: the counts, a row for each language and trigram, are used twice.
    counts = stored(counts, shared_folder(texts.sparkSession, "grams"))
    total = counts.groupBy("language").agg(F.sum("c").alias("total"))
    w = Window.partitionBy("language").orderBy(F.col("c").desc(), "gram")
    top = counts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    every = top.unionByName(total.select("language", F.lit("").alias("gram"), F.lit(0).cast("long").alias("c")))
    return every.join(total, "language").select("language", "gram", F.round(MILLION * F.log((F.col("c") + 1) / (F.col("total") + most))).cast("long").alias("weight"))


def _gains(numbers: np.ndarray, starts: np.ndarray, known: np.ndarray, gains: np.ndarray) -> list[np.ndarray]:
    """For each language, the sums of its gains from each start to the next; the last of a row of gains is that of trigrams in no profile."""
    at = np.searchsorted(known, numbers)
    at[np.append(known, -1)[at] != numbers] = len(known)
    return [np.add.reduceat(of.take(at), starts) for of in gains]


def identify(texts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, language, score) of each (doc_id, text) with a trigram: the language with the greatest sum of weights, the first by name among equals.

    Profiles are a few hundred rows for each language and go to all tasks. A text's
    trigrams are numbers, which meet them where they are made and are summed there:
    none becomes a row, and what is shuffled is a row for each text.
    """
    rows = profiles.collect()
    unseen = {r["language"]: r["weight"] for r in sorted((r for r in rows if r["gram"] == ""), key=lambda r: r["language"])}
    if not unseen:
        return texts.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("long").alias("score")).limit(0)
    names = sorted({r["gram"] for r in rows if r["gram"]})
    known = _as_numbers(names)
    place, order = {g: i for i, g in enumerate(names)}, {x: i for i, x in enumerate(unseen)}
    gains = np.zeros((len(unseen), len(names) + 1), dtype=np.int64)
    for r in rows:
        if r["gram"] and r["language"] in order:
            gains[order[r["language"]], place[r["gram"]]] = r["weight"] - unseen[r["language"]]
    assert (np.diff(known) > 0).all()  # code points order trigrams as their numbers do

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, at, starts in _numbered(batch.column("t").to_pylist()):
                n, g = np.diff(np.append(starts, len(numbers))), _gains(numbers, starts, known, gains)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(n), *map(pa.array, g)], ["doc_id", "n", *(f"g{i}" for i in range(len(unseen)))])

    keyed = texts.select("doc_id", plain(F.col("text")).alias("t"))
    sums = [f"g{i}" for i in range(len(unseen))]
    schema = StructType([keyed.schema["doc_id"], *(StructField(c, LongType()) for c in ["n", *sums])])
    each = keyed.mapInArrow(run, schema).groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ["n", *sums]))
    scored = [F.struct((-(F.col("n") * F.lit(w) + F.col(f"g{i}"))).alias("less"), F.lit(x).alias("language")) for i, (x, w) in enumerate(unseen.items())]
    best = each.withColumn("b", F.array_min(F.array(*scored)))
    return best.select("doc_id", "b.language", (-F.col("b.less")).alias("score"))


def _sample_profiles() -> dict[str, tuple[dict[str, float], float]]:
    out = {}
    for language, text in SAMPLES.items():
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        t = f" {' '.join(letters.split())} "
        counts = Counter(t[i : i + 3] for i in range(len(t) - 2))
        total = sum(counts.values())
        out[language] = ({g: math.log((c + 1) / (total + MOST_GRAMS)) for g, c in counts.most_common(MOST_GRAMS)}, math.log(1 / (total + MOST_GRAMS)))
    return out


def of_question(text: Column) -> Column:
    """A question's language among those of SAMPLES: by trigrams where one is clearly ahead, else by letters that only one has, else English."""
    out = F.lit("en")
    for language in reversed(list(LETTERS)):
        out = F.when(text.rlike(f"[{LETTERS[language]}]"), F.lit(language)).otherwise(out)
    profiles = _sample_profiles()

    def decide(g: Column) -> Column:
        scored = []
        for language, (weights, unseen) in profiles.items():
            book = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
            total = F.aggregate(g, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(book, x), F.lit(unseen)))  # noqa: B023
            scored.append(F.struct((total / F.size(g)).alias("score"), F.lit(language).alias("language")))
        return let(F.sort_array(F.array(*scored), asc=False), lambda s: F.when(F.get(s, F.lit(0))["score"] - F.get(s, F.lit(1))["score"] >= LEAST_MARGIN, F.get(s, F.lit(0))["language"]))

    return F.coalesce(F.when(F.size(grams(text)) > 0, let(grams(text), decide)), out)
