"""Texts to token ids with a given vocabulary, a stretch of text at a time.

The vocabulary's splitter never joins characters across a space or a line
break, nor a letter with the punctuation after it, so a text's ids are those of
its stretches, one after the other. Each distinct stretch of a batch is encoded
once; a worker remembers a bounded number of them from task to task. A dotted
capital I folds to two characters, the second no letter: texts with one are only
cut at blanks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES

#: Stretches that a worker remembers at most.
REMEMBERED = 200_000
#: Bytes of text in the slices that are encoded at once.
SLICE_BYTES = 4 << 20
#: The cache that a task of tokens keeps.
KEPT = "tokens"
_CUT = r"(\p{L})([!-&(-/:-@\[-`{-~]+) "


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    state = CACHES.setdefault(KEPT, {})
    if state.get("path") != path:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocab = tokenizer.get_vocab()
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        state.update(path=path, tokenizer=tokenizer, known={}, last=last)
    return state["tokenizer"], state["known"]


def _learn(words: list[str], tokenizer, known: dict[str, bytes]) -> None:
    """Encode stretches; those of letters only go together, as each ends with a word-end id."""
    plain = [w for w in words if w.isalpha()]
    for i in range(0, len(plain), 64):
        part = plain[i : i + 64]
        ids = np.asarray(tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.int32)
        ends = np.flatnonzero(CACHES[KEPT]["last"][ids]) + 1
        if len(ends) == len(part) and ends[-1] == len(ids):
            raw, at = ids.tobytes(), 0
            for w, e in zip(part, (ends * 4).tolist(), strict=True):
                known[w] = raw[at:e]
                at = e
    rest = [w for w in words if w not in known]
    for i in range(0, len(rest), 20_000):
        part = rest[i : i + 20_000]
        for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            known[w] = np.asarray(e.ids, dtype=np.int32).tobytes()


def _encode_distinct(words: list[str], path: str) -> list[bytes]:
    tokenizer, known = _tokenizer(path)
    fresh = [w for w in words if w not in known]
    if fresh and len(known) + len(fresh) > REMEMBERED:
        # Frequent stretches came early and stay; these are forgotten again.
        more: dict[str, bytes] = {}
        _learn(fresh, tokenizer, more)
        return [known.get(w) if w in known else more[w] for w in words]
    if fresh:
        _learn(fresh, tokenizer, known)
    return [known[w] for w in words]


def encode_column(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by ``end_id``, and where each text's begin."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(text):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    flat = pc.replace_substring(text, "\n", " ")
    # "<|" may begin a special token, which is found before any folding.
    whole = pc.or_(pc.match_substring(flat, "<|"), pc.match_substring(flat, "\u0130"))
    flat = pc.if_else(whole, flat, pc.replace_substring_regex(pc.ascii_lower(flat), _CUT, r"\1 \2 "))
    parts = pc.split_pattern(flat, " ")
    counts = np.diff(np.asarray(parts.offsets, dtype=np.int64))
    coded = parts.flatten().dictionary_encode()
    which = np.asarray(coded.indices, dtype=np.int64)
    known = _encode_distinct(coded.dictionary.to_pylist(), path)
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    ids = np.frombuffer(b"".join(known), np.int32)
    first = np.concatenate([[0], np.cumsum(size)])
    lengths = size[which]
    where = np.concatenate([[0], np.cumsum(lengths)])
    text_ends = where[np.cumsum(counts)]
    starts = np.concatenate([[0], text_ends + np.arange(1, len(counts) + 1)])
    body = ids[np.repeat(first[which] - where[:-1], lengths) + np.arange(where[-1])]
    out = np.full(len(body) + len(counts), end_id, dtype=np.int32)
    keep = np.ones(len(out), bool)
    keep[starts[1:] - 1] = False
    out[keep] = body
    return out, starts
