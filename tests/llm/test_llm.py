"""The training-data operators: brute force, round trips, and the odd rows that each defines a result for."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import licences, maxscore, mixing, neardup, packing, pii, quality, queries, repeats, token_store, tokens, toxicity
from corvane.llm.common import Scratch, table
from corvane.llm.run_index import RunIndex

from ..conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int, marks string, kept string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def make_docs(spark, texts, **more):
    rows = [(i if i != more.get("null_id") else None, t, None if i % 3 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", len(t or ""), 0.5, 7, "m", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts(seed=1):
    rng = random.Random(seed)
    long = " ".join(rng.choices(WORDS, k=3000))
    passage = " ".join(rng.choices(WORDS, k=30))
    out = ["", None, " \n\t", "one", "two words", "é́ ñ ΣΑΣ 한국어", long, long + " tail", long, passage + " x", "y " + passage + "\nz", "a" * 200, "b" + "a" * 120, "<|endoftext|> in, text. 12.5", "\u0130, x. abc\u0130. , y"]
    return out + [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) for _ in range(20)]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1: repeats


def brute_repeats(texts, length=50):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone, mine = bytearray(len(b)), []
        for k in range(len(b) - length + 1):
            mine.append(b[k : k + length])
            if mine[-1] in seen:
                gone[k : k + length] = b"\1" * length
        seen.update(mine)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b))), hashlib.sha256(kept).hexdigest())
    return out


# As it runs, and with blocks, segments, buckets and indexes far smaller than the texts.
@pytest.mark.parametrize("sizes", [repeats.Sizes(), repeats.Sizes(1, 100, 300, 2000, 150), repeats.Sizes(2, 64, 1000, 5000, 1)])
def test_repeats_brute_force(spark, sizes):
    rng = random.Random(31)
    line = "a common line of a little over fifty bytes, as pages have"
    crowded = ["".join(rng.choices("xyz ", k=rng.randint(0, 9))) + line + "".join(rng.choices("xyz ", k=rng.randint(0, 60))) for _ in range(60)]
    texts = odd_texts() + crowded
    got = by_id(repeats.remove_repeats(spark, make_docs(spark, texts), sizes))
    want = brute_repeats(texts)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    assert repeats.remove_repeats(spark, make_docs(spark, texts).limit(0)).count() == 0


def test_repeats_same_id(spark):
    text = " ".join(WORDS * 3)
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in repeats.remove_repeats(spark, docs).collect())
    assert got == [("1", 0), ("1", 0), ("2", len(text)), ("None", 0)]


def test_run_index():
    rng = random.Random(3)
    for trial in range(40):
        length, letters = rng.choice([2, 3, 5]), b"ab" if trial % 2 else b"abc\0"
        base = bytes(rng.choice(letters) for _ in range(30))
        texts = [base[rng.randint(0, 10) : rng.randint(12, 30)] for _ in range(rng.randint(1, 5))] + [bytes(rng.choice(letters) for _ in range(9))]
        owners = np.array([rng.randint(0, 9) for _ in texts])
        patterns = [bytes(rng.choice(letters + b"z") for _ in range(rng.randint(0, 20))) for _ in range(3)] + texts
        match, where, least = RunIndex(texts, owners, length).stream(patterns)
        at = 0
        for p in patterns:
            for i in range(len(p)):
                assert match[at] == max(k for k in range(len(p) - i + 1) if any(p[i : i + k] in t for t in texts))
                assert least[at] == min((o for t, o in zip(texts, owners, strict=True) if len(p) - i >= length and p[i : i + length] in t), default=-1)
                at += 1


# 2 and 9: tokens


def encoded(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files(spark):
    texts = odd_texts()
    want, at = {}, 0
    for i, ids in enumerate(encoded(texts, 1)):
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    got = by_id(token_store.token_digests(spark, make_docs(spark, texts)))
    assert {i: (r["start"], r["n_tokens"], r["ids_crc32"]) for i, r in got.items()} == want
    assert token_store.token_digests(spark, make_docs(spark, texts).limit(0)).count() == 0


def test_token_lookup(spark):
    texts = odd_texts()
    path = Scratch(spark, "test").path("orc")
    token_store.write_token_orc(make_docs(spark, texts), path)
    found = token_store.lookup(spark, path, [3, 13])
    assert {r["doc_id"]: list(r["ids"]) for r in found.collect()} == {i: encoded(texts, 1)[i] for i in (3, 13)}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString().replace("IsNotNull(part), ", "").replace("IsNotNull(doc_id), ", "")


def test_packing(spark):
    texts = [*odd_texts(), *["same row"] * 3]
    rows = packing.pack_documents(spark, make_docs(spark, texts), capacity=64).collect()
    ids = encoded(texts, 0)
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows) == sum(-(-len(x) // 64) for x in ids)
    for (d, k), r in pieces.items():
        part = ids[d][64 * k : 64 * k + 64]
        assert (r["start"], r["length"], r["ids_crc32"]) == (64 * k, len(part), crc(part))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(spark, make_docs(spark, texts).limit(0)).count() == 0


def test_packing_is_tight():
    rng = np.random.default_rng(5)
    for low in (1, 20, 34):
        counts = np.zeros(101, np.int64)
        np.add.at(counts, rng.integers(low, 101, 500), 1)
        plan, used = packing.pack_histogram(counts, 100)
        least = max(-(-int((counts * np.arange(101)).sum()) // 100), int(counts[51:].sum()))
        bins = np.zeros(used, np.int64)
        ends = {}
        for w, r, *_ in zip(*plan.values(), strict=True):
            ends.setdefault(int(w), []).append(int(r))
        for w, r, s, per, _ in zip(*(v.tolist() for v in plan.values()), strict=True):
            after = [x for x in ends[w] if x > r]
            for i in range((min(after) if after else int(counts[w])) - r):
                bins[s + i // per] += w
        assert bins.max() <= 100 and bins.sum() == (counts * np.arange(101)).sum()
        assert used <= least * 1.06 + 1


# 3: mixing


def test_mixing(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'big' WHEN id % 50 = 1 THEN NULL ELSE 'rest' END AS source", "'t' AS text", "1 AS copies")
    out = mixing.replicate(spark, docs, {"big": 1.0, "rest": 1.0, None: 2.0}, 8000)
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["big"] - 2000) < 250 and abs(n["rest"] - 2000) < 250 and abs(n[None] - 4000) < 400
    keys = [r["shuffle_key"] for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    per = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("c"), F.max("copy").alias("k")).where("n <> c or n <> k")
    assert per.count() == 0
    assert mixing.replicate(spark, docs.limit(0)).count() == 0
    few = mixing.MOST_SENT
    try:
        mixing.MOST_SENT = 0
        assert mixing.replicate(spark, docs, {"big": 1.0, "rest": 1.0, None: 2.0}, 8000).count() == out.count()
    finally:
        mixing.MOST_SENT = few


def test_mixing_of_great_rates(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "CASE WHEN id = 0 THEN 'rare' ELSE 'rest' END AS source")
    out = mixing.replicate(spark, docs, {"rare": 1.0, "rest": 1.0}, 5000).groupBy("source").agg(F.count("*").alias("n")).collect()
    n = {r["source"]: r["n"] for r in out}
    assert abs(n["rare"] - 2500) < 250 and abs(n["rest"] - 2500) < 250


# 4: licences


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    got = by_id(licences.scan(make_docs(spark, [mit, "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "plain", None, "", "Released under the MIT License. Released under the MIT License."])))
    assert [got[i]["licences"] for i in range(6)] == ["MIT", "Apache-2.0,LicenseRef-all-rights-reserved", "", "", "", "MIT"]
    assert (got[0]["rule_ids"], got[5]["sentence_ids"], got[3]["n_sentences"]) == ("3", "1,1", 0)


def test_published_licences(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"""
    gpl = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    apache = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n'
    comment = lambda text, mark: "\n".join(f"{mark} {x}" for x in text.split("\n"))
    apart = ["Released under the\n\nMIT License", "Released under the.\nMIT License", "# Released under the\n#\n# MIT License", "Not released under the\nMIT License"]
    bsd3 = bsd + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER"""
    lgpl = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU"""
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE"""
    agpl = gpl.replace("GNU General", "GNU Affero General")
    title = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright"
    texts = [mit, gpl, bsd, apache, comment(mit, "//"), "/*\n" + comment(gpl, " *") + "\n */", comment(bsd, "#"), bsd.replace("\n", "\r\n"), *apart, bsd3, lgpl, mpl, isc, agpl, title, comment(bsd3, "//"), mpl + "\n\n" + isc]
    got = by_id(licences.scan(make_docs(spark, texts)))
    assert [got[i]["rule_ids"] for i in range(12)] == ["3", "5", "9", "7", "3", "5", "9", "9", "", "", "", ""]
    assert [got[i]["licences"] for i in range(12, len(texts))] == ["BSD-3-Clause", "LGPL-2.1-or-later", "MPL-2.0", "ISC", "AGPL-3.0-or-later", "GPL-3.0", "BSD-3-Clause", "ISC,MPL-2.0"]


def test_licences_as_sql(spark):
    import duckdb

    texts = ["Released under the MIT License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: nothing", None, "", "All rights reserved. Licensed under CC BY-SA 4.0. Released under the MIT License.\nLicensed under CC BY 4.0."]
    texts.append(". ".join(licences.SENTENCES[i] for i in (10, 11, 12, 13, 10, 11, 12, 6, 16, 17, 16)) + ".")
    docs = make_docs(spark, texts)
    documents = docs.toPandas()  # noqa: F841
    want = {r["doc_id"]: r for r in duckdb.sql(licences.oracle()).fetchdf().to_dict("records")}
    got = by_id(licences.scan(docs))
    assert {i: r.asDict() for i, r in got.items()} == want
    assert got[5]["rule_ids"] == "5,8,9,14,47"


# 5: toxicity


def test_toxicity(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(20, 60)) + (["nastyword"] if i % 4 == 0 else [])) for i in range(400)] + ["", None]
    docs = make_docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(401, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.scored_documents(docs, labels))
    assert len(got) == 402
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and sum(r["held_out"] for r in got.values()) == len([i for i in range(402) if zlib.crc32(str(i).encode()) % 5 == 0])
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert 0 <= got[400]["score"] == got[401]["score"] < 0.5
    none = toxicity.scored_documents(docs.limit(3), labels.limit(0)).collect()
    assert [r["predicted"] for r in none] == [0, 0, 0]
    assert toxicity.scored_documents(docs.limit(0), labels).count() == 0


# 6: quality


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, t in enumerate(three) if three.count(t) > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_statistics(spark):
    texts = [*odd_texts(), "a b\na b\n\n a b\nc", "x y z x y z q", "### é |<> $%&*"]
    texts[6] = texts[6][:2000]
    texts[7], texts[8] = texts[6], None
    got = by_id(quality.judged(spark, make_docs(spark, texts)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, t in enumerate(texts):
        want = brute_statistics(t)
        assert tuple(got[i][n] for n in names) == want, t
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality.judged(spark, make_docs(spark, texts).limit(0)).count() == 0


def test_quality_outliers(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(60, 400))) for _ in range(300)]
    for i in range(0, 300, 20):
        texts[i] = " ".join(w + "###" for w in texts[i].split())
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = by_id(quality.judged(spark, docs))
    rejected = {i for i, r in got.items() if not r["kept"] and not r["base_failed"]}
    assert rejected == set(range(0, 300, 20)) - {i for i in got if got[i]["base_failed"]}


def brute_verdicts(rows):
    """Row numbers that pass, from (lang, source, base_failed, vector), on whole arrays and without tables."""
    x = np.array([r[3] for r in rows], float).reshape(-1, 5)
    passed = np.array([not r[2] for r in rows], bool)
    unit, dims = quality.UNIT, range(5)
    floor = np.diag((np.array(quality.FLOOR) * unit) ** 2)

    def estimate(mine):
        v, n, best = x[mine], int(mine.sum()), None
        lo, mid, hi = np.percentile(v, [25, 50, 75], axis=0)
        for spread in (((hi - lo) / 1.349) ** 2, np.zeros(5)):
            mean, cov = mid, np.diag(spread) + floor
            for _ in range(quality.STEPS):
                d = np.einsum("ni,ij,nj->n", v - mean, np.linalg.inv(cov), v - mean)
                bins = np.floor(32 * np.log2(1 + np.clip(d, 0, 2.0**40)))
                edge = np.sort(bins)[int(np.ceil(quality.KEEP * n)) - 1]
                near = v[bins <= edge]
                mean = near.mean(axis=0)
                few = max(0.0, 1 - n / quality.LEAST_ROWS) * np.diag((np.array(quality.WIDE) * unit) ** 2)
                cov = ((near.T @ near) / len(near) - np.outer(mean, mean)) / 0.55 + few + floor
            det = np.linalg.slogdet(cov)[1]
            if best is None or det < best[0]:
                best = (det, mean, np.linalg.inv(cov))
        return n, best

    out = set()
    for k, (lang, source, failed, _) in enumerate(rows):
        if failed:
            continue
        wider = [lambda r: r[:2] == (lang, source), lambda r: r[0] == lang, lambda r: True]
        for level, same in enumerate(wider):
            mine = np.array([same(r) for r in rows]) & passed
            if mine.sum() >= quality.LEAST_ROWS or level == 2:
                _, (_, mean, inverse) = estimate(mine)
                if (x[k] - mean) @ inverse @ (x[k] - mean) <= quality.LIMIT:
                    out.add(k)
                break
    return out


# As parameters are sent to all tasks, and as rows are dealt by group and salt.
@pytest.mark.parametrize("sent", [quality.SENT_BYTES, 0])
def test_quality_verdicts_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(quality, "SENT_BYTES", sent)
    rng = random.Random(41)
    lines = lambda n: "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(5, 9))) for _ in range(n))
    texts = [lines(rng.randint(8, 60)) for _ in range(150)] + ["", None, "few words"] * 2
    for i in range(0, 150, 11):
        texts[i] = re.sub(r"\b", "#" if i % 2 else "", texts[i]) + ("\n" + texts[i][:200]) * (i % 4)
    place = lambda i: (("en", "fr", None)[i % 7 % 3], (None, "a", "b", "a")[i % 4])
    docs = spark.createDataFrame([(i, t, *place(i)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    vectors = {r["doc_id"]: r for r in quality.statistics(docs).select("doc_id", quality.base_failed().alias("failed"), F.array(*quality._vector()).alias("x")).collect()}
    rows = [(*place(i), vectors[i]["failed"], vectors[i]["x"]) for i in range(len(texts))]
    got = quality.judged(spark, docs).collect()
    assert len(got) == len(texts)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == brute_verdicts(rows)
    assert 0 < len(kept) < sum(not r[2] for r in rows)


def test_quality_small_groups(spark):
    rng = random.Random(14)
    clean = [" ".join(rng.choices(WORDS, k=rng.randint(60, 400))) for _ in range(120)]
    junk = lambda k: " ".join(w + "###" for w in clean[k].split())
    rows = [(i, t, "en", f"s{i % 10}") for i, t in enumerate(clean)]
    # Groups of 12 in one language, and languages of one and two rows.
    rows += [(200, junk(0), "en", "s1"), (201, junk(1), None, None), (202, junk(2), "xx", "s"), (203, clean[3], "xx", "s")]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string, lang string, source string")
    rejected = lambda r: {x["doc_id"] for x in quality.judged(spark, frame(r)).collect() if not x["kept"] and not x["base_failed"]}
    assert rejected(rows) == {200, 201, 202}
    assert rejected([*rows[:9], rows[120]]) == {200}


def test_quality_outliers_in_each_statistic(spark):
    assert abs(quality._chi_squared_limit(0.05) - 11.0705) < 1e-3
    rng = random.Random(15)
    words = [f"{w}{k}" for w in WORDS for k in range(40)]
    line = lambda: " ".join(rng.choices(words, k=8))
    texts = ["\n".join(line() for _ in range(rng.randint(30, 50))) for _ in range(300)]
    planted = {
        300: "\n".join(line() for _ in range(2000)),
        301: " ".join(w + "internationalisation" for w in texts[0].split(" ")),
        302: texts[1].replace("a", "a#"),
        303: "\n".join([*texts[2].split("\n"), *["one"] * 20]),
        304: texts[3] + "\n" + (" ".join(texts[3].split()[:80]) + " x ") + "\n",
    }
    rows = [(i, t, "en", "s") for i, t in [*enumerate(texts), *planted.items()]]
    got = by_id(quality.judged(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert not any(got[i]["base_failed"] for i in planted)
    assert {i for i, r in got.items() if not r["kept"]} == set(planted)


# 7: near duplicates


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_near_duplicates(spark):
    rng = random.Random(6)
    texts = odd_texts()[:16]
    for _ in range(6):
        base = [f"{rng.choice(WORDS)}{rng.randint(0, 999)}" for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "Edited"
            texts.append(" ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    rng.shuffle(texts)
    got = by_id(neardup.near_duplicates(spark, make_docs(spark, texts)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(texts)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    left = neardup.deduplicated(spark, make_docs(spark, texts))
    assert left.count() == sum(r["kept"] for r in got.values()) and left.columns == make_docs(spark, texts).columns
    assert neardup.near_duplicates(spark, make_docs(spark, texts).limit(0)).count() == 0


def test_near_duplicate_threshold(spark):
    assert neardup.limits(85) == (85, 26, 5, 85)
    link = neardup.limits(80)
    assert (1 - 0.8**link.rows) ** link.bands < 2.5e-7
    # 100 words are 96 shingles; one changed word inside takes five: 2 apart share 86/106 (0.811), 4 apart 76/116.
    base = [f"w{i}" for i in range(100)]
    edited = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(base))
    docs = make_docs(spark, [edited(), edited(20, 60), edited(10, 30, 50, 70), *(" ".join(f"{i}x{j}" for j in range(90)) for i in range(20))])
    gone = lambda df: {r["doc_id"] for r in docs.join(df, "doc_id", "left_anti").collect()}
    assert gone(neardup.deduplicated(spark, docs)) == set()
    pipeline = pytest.importorskip("corpus_pipeline")
    assert gone(pipeline.drop_near_duplicates(spark, docs, DATA)) == {1}


def test_near_duplicates_of_an_id_with_two_texts(spark):
    rng = random.Random(41)
    a, b = (" ".join(f"{w}{rng.randint(0, 99)}" for w in rng.choices(WORDS, k=200)) for _ in range(2))
    rows = [(5, a), (5, b), (1, a + " more"), (2, b + " more"), (5, a), (7, None), (None, a), (9, "")]
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 1), ("2", 1), ("5", 1), ("5", 1), ("5", 1), ("7", 7), ("9", 9), ("None", None)]


def test_no_hash_joins_unlike_texts(spark):
    """Thue-Morse words have equal sums modulo 2**64 for any base."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word, "en", "s"), (2, other, "en", "s"), (3, f"{word}\n{other}", "en", "s"), (4, f"{word} {other}", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r["component_id"] for r in neardup.near_duplicates(spark, docs).collect()} == {1, 2, 3}
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.judged(spark, docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


# 8: search


def test_search(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(0, 0.3, (400, 16)).astype(np.float32)
    data[7] = data[9]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(400, None), (401, [1.0] * 15 + [None]), (402, [float("nan")] * 16), (450, [0.5] * 3), (None, [0.1] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in maxscore.top_k(spark, df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = np.floor(256 * data.astype(np.float64)).astype(np.int64)
    for q in range(0, 400, 50):
        score = whole @ whole[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:5]
        assert got[q] == [(i, score[i]) for i in want]
    assert set(got) == set(range(0, 400, 50))
    assert maxscore.top_k(spark, df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_search_of_huge_values():
    rng = np.random.default_rng(1)
    for scale in (10, 1e6, 1e15, 1e30):
        rows, ids = np.floor(rng.normal(size=(100, 6)) * scale), rng.permutation(100).astype(np.int64)
        rows[50:] = rows[:50]
        query, found, score = maxscore.search_shard(rows[:7], ids[:7], rows, ids, 5, {})
        for i in range(7):
            exact = sorted((-sum(int(a) * int(b) for a, b in zip(rows[i], r, strict=True)), int(k)) for r, k in zip(rows, ids, strict=True) if k != ids[i])[:5]
            mine = query == ids[i]
            assert list(zip(found[mine].tolist(), score[mine].tolist(), strict=True)) == [(k, min(max(-s, -(2**63)), 2**63 - 1)) for s, k in exact]


# 10: personal data


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in pii.EMAIL.finditer(t)]
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    out += [("ip", m.start(), m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", m.start(), m.end()) for m in pii.CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in pii.PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_personal_data(spark):
    rng = random.Random(9)
    bits = ["a.b@c.example.com", "1.2.3.4", "999.1.1.1", "4381893557741609", "4381 8935 5774 1609", "+1 (743) 555-3824", "+12", "x@y", "@", "12-34", "é", "\n", "(", "0000001.2.3.4", "word,"]
    texts = [None, "", "plain", "1" * 5000] + ["".join(rng.choices(bits + [" ", " "], k=rng.randint(1, 12))) for _ in range(200)]
    got = by_id(pii.scan(make_docs(spark, texts)))
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i]["spans"].split(",")) | {""} or not base
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
    assert pii.scan(make_docs(spark, texts).limit(0)).count() == 0


def test_field_learns_and_redacts(spark):
    field = pii.trained()
    fresh = pii.examples(seed=123, rounds=4)
    right = sum(field.best(t, 0, len(t)) == spans for t, spans in fresh)
    assert right >= 0.9 * len(fresh)
    docs = make_docs(spark, ["mail a@b.org or (743) 555-3824 now", None, "clean"])
    got = by_id(pii.redact(docs))
    assert got[0]["text"] == "mail <email> or <phone> now" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] is None and got[2]["text"] == "clean"


def test_long_stretches_are_searched_whole(spark):
    rng = random.Random(12)
    d = lambda n: "".join(rng.choices("23456789", k=n))
    numbers = [f"({d(3)}) {d(3)}-{d(4)}" for _ in range(600)]
    for shift in range(0, 15, 7):
        text = "x" * shift + " " + " ".join(numbers)
        want = [("phone", m.start(), m.end()) for m in re.finditer(r"\(\d+\) [\d-]+", text)]
        assert len(want) == 600 and pii.all_spans(text, pii.trained()) == ([], want)
    text = " ".join(numbers[:60])
    docs = make_docs(spark, [text, "log " + text])
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()] == [" ".join(["<phone>"] * 60), " ".join(["log", *["<phone>"] * 60])]


# the pipeline


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, DATA, "documents")
    scratch = Scratch(spark, "test-pipeline")
    for name, stage in pipeline.STAGES:
        out = scratch.cut(stage(spark, docs, DATA), name)
        if name != "packing":
            assert out.columns == docs.columns
        if name in ("toxicity", "near_dedup"):
            assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() >= 0.7 * docs.count()
        if name == "pii":
            assert out.count() == docs.count()
        docs = out
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_every_operator_is_registered():
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES}
    assert numbers == set(range(1, 11))
