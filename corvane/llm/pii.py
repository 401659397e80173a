"""Personal data: fixed patterns, and a semi-Markov conditional random field for the rest.

Base spans follow exact patterns and always stay. Around them, stretches of
text that could hold more (digits enough, or an at-sign in some form) are cut
into atoms, and a semi-Markov conditional random field scores whole candidate
spans (digit grouping, separators, check sums, shape, neighbours); dynamic
programming over segments of bounded length chooses boundaries and types
jointly. The field is trained here, by maximum likelihood on stretches that a
seeded generator writes; it never sees the corpus.

Defined results: a null or empty text has no spans; repeated rows are scanned
each on its own; further columns are ignored; texts are scanned whole, in
their own row, so nothing is shuffled or gathered.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match begins where its digits do: later starts in them fail alike.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Every base match but an address lies in one run of these, from a digit or a plus on.
_RUN = re.compile(r"[0-9+][0-9 ().+\-]*")
_NOT_DIGIT = re.compile(r"[^0-9]+")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _ip_ok(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def _card_ok(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(text: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", text)) <= 15


_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """What EMAIL finds, from its at-signs: a local part holds none, so each is looked at once, however long a word is."""
    done, at = 0, text.find("@")
    while at >= 0:
        # The local part can't reach over the last match, nor over the last at-sign.
        lead = text[done:at]
        n = len(lead) - len(lead.rstrip(_LOCAL))
        if n and (m := _DOMAIN.match(text, at + 1)):
            yield at - n, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind and then start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    found["email"] = [("email", a, b) for a, b in addresses(text)]
    for run in _RUN.finditer(text):
        s, a = run.group(), run.start()
        if len(s) < 7:
            continue
        for kind, pattern, ok in (("ip", IP, _ip_ok), ("card", CARD, _card_ok), ("phone", PHONE, _phone_ok)):
            found[kind] += [(kind, a + m.start(), a + m.end()) for m in pattern.finditer(s) if ok(m.group())]
    return [x for k in KINDS for x in found[k]]


# Stretches that may hold more.
_NUMBERS = re.compile(r"\(?[0-9+][0-9 ().+\-/:\[\]]*")
_AT = re.compile(r"@|[\[(](?:at|AT)[\])]")
_AFTER_AT = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]+)*")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+| +|.", re.S)
#: Atoms in a segment at most.
MOST_ATOMS = 16
_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+ ?(@|[\[(](at|AT)[\])]) ?[A-Za-z0-9-]+( ?(\.|[\[(](dot|DOT)[\])]) ?[A-Za-z0-9-]+)+")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\s:.#]*$")
# Words before a span that say what it is (fixed values).
_CUES = {"phone": "phone", "tel": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "telefon": "phone", "card": "card", "visa": "card", "email": "email", "mail": "email", "ip": "ip", "host": "ip", "server": "ip"}


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches of numbers, and of addresses around each at-sign; those that overlap are one."""
    found = [m.span() for m in _NUMBERS.finditer(text) if sum(map(str.isdigit, m.group())) >= 4]
    done = 0
    for m in _AT.finditer(text):
        lead = text[done : m.start()]
        lead = lead[:-1] if lead.endswith(" ") else lead
        word = len(lead) - len(lead.rstrip(_LOCAL))
        if word and (after := _AFTER_AT.match(text, m.end())):
            found.append((done + len(lead) - word, after.end()))
        done = m.end()
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _class(ch: str) -> str:
    if not ch:
        return "edge"
    if ch.isalpha():
        return "letter"
    if ch.isdigit():
        return "digit"
    return "space" if ch.isspace() else "punct"


def _span_features(text: str, a: int, b: int) -> list[str]:
    """What a whole candidate span looks like, inside and just outside."""
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    n = sum(map(len, groups))
    seps = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", s))))
    out = [f"n={n if n < 20 else 20}", f"groups={'-'.join(str(len(g)) for g in groups[:6])}", f"seps={seps}", f"left={_class(text[a - 1 : a])}", f"right={_class(text[b : b + 1])}", f"first={s[0] if not s[0].isalnum() else _class(s[0])}", f"letters={any(c.isalpha() for c in s)}"]
    if text[b : b + 2].strip(".,;") and text[b : b + 1] in ".-/:" and text[b + 1 : b + 2].isdigit():
        out.append("goes on after")
    if text[a - 1 : a] in ("-", ".", "/", ":") and text[a - 2 : a - 1].isdigit():
        out.append("went on before")
    if n in range(13, 20):
        out.append(f"luhn={luhn(''.join(groups))}")
    if len(groups) == 4 and n <= 12:
        out.append(f"quad={_ip_ok('.'.join(groups))}")
    if s.count("(") != s.count(")") or s.count("[") != s.count("]"):
        out.append("unbalanced")
    if _SHAPE.fullmatch(s):
        out.append("address")
    if re.fullmatch(r"(19|20)\d\d[-/.]\d\d?[-/.]\d\d?.*|\d\d?[-/.]\d\d?[-/.](19|20)?\d\d", s):
        out.append("date")
    if re.fullmatch(r"\(\d{2,4}\) ?\d{3,4}[ -]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|00\d{1,3}[ -].*", s):
        out.append("dialled")
    before = _WORD_BEFORE.search(text[max(0, a - 16) : a])
    if before and (cue := _CUES.get(before.group(1).lower())):
        out.append(f"cue={cue}")
    return out


def _ends(text: str, edges: Sequence[int], i: int) -> Iterator[int]:
    """The edges at which a span from edge ``i`` on could end as an entity."""
    if not (text[edges[i]].isalnum() or text[edges[i]] in "+("):
        return
    digits, at = 0, False
    for j in range(i, min(i + MOST_ATOMS, len(edges) - 1)):
        atom = text[edges[j] : edges[j + 1]]
        digits += len(atom) if atom[0].isdigit() else 0
        at |= atom == "@" or atom.lower() == "at"
        if digits > 19 and not at:
            break
        if atom[0].isalnum() and (digits >= 7 or at or (digits >= 4 and atom[0].isdigit() and j - i >= 6)):
            yield j + 1


def _edges(text: str, a: int, b: int) -> Iterator[int]:
    """Atom edges of a stretch."""
    yield from (m.start() for m in _ATOM.finditer(text, a, b))
    yield b


class Field:
    """Weights by (label, feature); labels are KINDS, and 0 for an atom outside."""

    def __init__(self) -> None:
        self.index: dict[tuple[int, str], int] = {}
        self.weights = np.zeros(0)

    def _ids(self, label: int, features: list[str], grow: bool) -> list[int]:
        if grow:
            return [self.index.setdefault((label, f), len(self.index)) for f in features]
        return [i for f in features if (i := self.index.get((label, f))) is not None]

    def _outside(self, text: str, a: int, grow: bool = False) -> list[int]:
        return self._ids(0, ["digits" if text[a].isdigit() else "other"], grow)

    def _inside(self, text: str, a: int, b: int, grow: bool = False) -> Iterator[tuple[int, list[int]]]:
        features = ["any", *_span_features(text, a, b)]
        for k in range(1, len(KINDS) + 1):
            yield k, self._ids(k, features, grow)

    def segments(self, text: str, a: int, b: int, grow: bool = False):
        edges = list(_edges(text, a, b))
        out = [(i, i + 1, 0, self._outside(text, edges[i], grow)) for i in range(len(edges) - 1)]
        for i in range(len(edges) - 1):
            for j in _ends(text, edges, i):
                out += [(i, j, k, ids) for k, ids in self._inside(text, edges[i], edges[j], grow)]
        return edges, sorted(out, key=lambda s: s[1])

    def best(self, text: str, a: int, b: int) -> list[Span]:
        """The best segmentation of a whole stretch: segments are made as the search comes to them and held until their end."""
        edges = array("q", _edges(text, a, b))
        n = len(edges) - 1
        score, length, label = array("d", bytes(8 * (n + 1))), bytearray(n + 1), bytearray(n + 1)
        value = lambda ids: sum(self.weights[x] for x in ids)
        open_: dict[int, list[tuple[float, int, int]]] = {}
        for j in range(1, n + 1):
            i = j - 1
            for end in _ends(text, edges, i):
                open_.setdefault(end, []).extend((score[i] + value(ids), i, k) for k, ids in self._inside(text, edges[i], edges[end]))
            top = (score[i] + value(self._outside(text, edges[i])), i, 0)
            for s in open_.pop(j, ()):
                if s[0] > top[0]:
                    top = s
            score[j], length[j], label[j] = top[0], j - top[1], top[2]
        out, at = [], n
        while at:
            i = at - length[at]
            if label[at]:
                out.append((KINDS[label[at] - 1], edges[i], edges[at]))
            at = i
        return out[::-1]

    def train(self, examples: list[tuple[str, list[Span]]], rounds: int = 90, rate: float = 0.15, decay: float = 0.01) -> None:
        """Maximum likelihood by exact forward-backward sums, with a quadratic penalty."""
        data = []
        for text, spans in examples:
            edges, segments = self.segments(text, 0, len(text), grow=True)
            gold = {(edges.index(a), edges.index(b), KINDS.index(k) + 1) for k, a, b in spans}
            inside = [(i, j) for i, j, _ in gold]
            right = [s for s in segments if s[:3] in gold or (s[2] == 0 and not any(i <= s[0] < j for i, j in inside))]
            if len([s for s in right if s[2]]) == len(gold):
                data.append((len(edges) - 1, segments, [x for s in right for x in s[3]]))
        w = np.zeros(len(self.index))
        seen = np.zeros(len(w)) + 1e-6
        for _ in range(rounds):
            slope = -decay * w
            for n, segments, right in data:
                value = [sum(w[x] for x in s[3]) for s in segments]
                up, down = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                up[0] = down[n] = 0.0
                for s, v in zip(segments, value, strict=True):
                    up[s[1]] = np.logaddexp(up[s[1]], up[s[0]] + v)
                for s, v in sorted(zip(segments, value, strict=True), key=lambda p: -p[0][0]):
                    down[s[0]] = np.logaddexp(down[s[0]], down[s[1]] + v)
                np.add.at(slope, right, 1.0)
                for s, v in zip(segments, value, strict=True):
                    p = math.exp(min(0.0, up[s[0]] + v + down[s[1]] - up[n]))
                    if p > 1e-4:
                        for x in s[3]:
                            slope[x] -= p
            seen += slope**2
            w += rate * len(data) ** 0.5 * slope / np.sqrt(seen)
        self.weights = w


def _with_check(rng: random.Random, n: int) -> str:
    body = "".join(rng.choices("0123456789", k=n - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def examples(seed: int = 7, rounds: int = 8) -> list[tuple[str, list[Span]]]:
    """Written stretches with their spans: forms that the base patterns leave out, and look-alikes."""
    rng, out = random.Random(seed), []
    d = lambda n: str(rng.randint(1, 9)) + "".join(rng.choices("0123456789", k=n - 1))
    w = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 8)))
    for _ in range(rounds):
        c = _with_check(rng, 16)
        octets = [str(rng.randint(1, 255)) for _ in range(4)]
        bad = c[:-1] + str((int(c[-1]) + 1) % 10)
        positive = [
            ("phone", f"({d(3)}) {d(3)}-{d(4)}"),
            ("phone", f"{d(3)}-{d(3)}-{d(4)}"),
            ("phone", f"{d(3)}.{d(3)}.{d(4)}"),
            ("phone", f"00{d(2)} {d(3)} {d(7)}"),
            ("card", ".".join(c[i : i + 4] for i in (0, 4, 8, 12))),
            ("card", "/".join(c[i : i + 4] for i in (0, 4, 8, 12))),
            ("card", "  ".join(c[i : i + 4] for i in (0, 4, 8, 12))),
            ("ip", " . ".join(octets)),
            ("ip", "[.]".join(octets)),
            ("email", f"{w()} @ {w()}.{w()[:3]}"),
            ("email", f"{w()}.{w()} (at) {w()}.{w()[:3]}"),
            ("email", f"{w()}[at]{w()}[dot]{w()[:3]}"),
        ]
        negative = [
            f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}/0{d(1)}/20{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", d(7), d(8), d(9), d(10), d(12), bad, d(14), f"{d(1)}.{d(1)}.{d(2)}", f"{d(3)}.{d(7)}",
            f"{d(2)}.{d(2)}.{d(4)}", ".".join(bad[i : i + 4] for i in (0, 4, 8, 12)), f"{d(4)}-{d(4)}", f"{d(2)} {d(3)} {d(3)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(4)} {d(4)} {d(4)} {d(4)} {d(4)}",
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(1)} + {d(3)} - {d(3)} / {d(2)}", f"{w()}@{w()}", f"@{w()}", f"{d(3)} {d(3)} {d(3)} {d(3)}", " . ".join([d(3), "999", d(2), d(4)]), "2023 2024 2025 2026", f"{d(4)}.{d(2)}.{d(2)} {d(2)}:{d(2)}",
        ]
        lead = lambda: rng.choice(["", f"{w()} ", f"{w()}, ", "no ", "from ", "("])
        tail = lambda: rng.choice(["", ".", ",", f" {w()}", ")", "\n"])
        for kind, s in positive:
            a = lead()
            out.append((a + s + tail(), [(kind, len(a), len(a) + len(s))]))
        out += [(lead() + s + tail(), []) for s in negative]
    return out


@cache
def trained() -> Field:
    field = Field()
    field.train(examples())
    return field


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans, each by kind and then start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added: list[Span] = []
    if field is not None:
        first = 0
        for at, end in zones(text):
            # Base spans come in order of their starts, but those of two kinds may overlap.
            while first < len(taken) and taken[first][1] <= at:
                first += 1
            cuts = []
            for k in range(first, len(taken)):
                a, b = taken[k]
                if a >= end:
                    break
                if b > at:
                    cuts.append((a, b))
            for a, b in [*cuts, (end, end)]:
                if at < a:
                    added += field.best(text, at, a)
                at = max(at, b)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted({*base, *added}, key=lambda x: (order[x[0]], x[1], x[2]))


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches):
        field = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text or "", field)
                count = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*count, hashlib.sha256(_said(base).encode()).hexdigest(), _said(every)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_arrow, run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """The rows with each span replaced by its kind in angle brackets, and ``n_chars`` counted anew where there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    place = docs.columns.index("text")

    def cleaned(text: str | None, field: Field) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for kind, a, b in sorted(all_spans(text, field)[1], key=lambda x: (x[1], -x[2])):
            if a < at:  # spans of two kinds may overlap: one mark for both
                at = max(at, b)
                continue
            out += [text[at:a], f"<{kind}>"]
            at = b
        return "".join([*out, text[at:]]) if out else text

    def run(batches):
        for batch in batches:
            texts = [cleaned(t, shared.value) for t in batch.column(place).to_pylist()]
            cols = list(batch.columns)
            cols[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    out = docs.transform(in_arrow, run, T.StructType(docs.schema.fields))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
