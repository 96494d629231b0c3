"""Every operator of the subpackage against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and
extra columns whose names clash; and on an empty table."""

import collections
import functools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinspark.llm import bpe, licenses, lm, near_dedup, quality, suffix_dedup, topk, toxicity, util, wordhash
from kinspark.llm import lm_model as M
from kinspark.llm.exact_dedup import exact_duplicates
from kinspark.llm.mixing import mix, source_targets
from kinspark.llm.queries import TOKENIZER

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, b int, key string, label int, copy_of string, ids string"
rng = np.random.default_rng(11)
LEXICON = ["".join(rng.choice(list("abcdeéß"), int(rng.integers(1, 6)))) for _ in range(60)]


def prose(n):
    return " ".join(rng.choice(LEXICON, n)) + "."


PASSAGE = prose(40)
LONG = " ".join(prose(12) for _ in range(600))
TEXTS = [None, "", "   \n\t", "a", "word", "same text here", "same text here", "same text here", "x" * 3000, PASSAGE, PASSAGE + " tail one", "head " + PASSAGE, LONG, LONG, LONG[:-30] + " other words at its end", "y" * 120, "z" + "y" * 130,
         "<|endoftext|> mid <|endoftext|>", "It's ½ 漢字 \U0001f600  end ", "Released under the MIT License. All rights reserved.", "Licensed under the Apache License, Version 2.0.\nThis License is strange."]
TEXTS += [prose(int(n)) for n in rng.integers(5, 200, 40)]
TEXTS += [TEXTS[25].replace(" ", "  ", 1), TEXTS[26] + " more"]
ROWS = [(i, t, "en", [None, "", "s1", "s2", "big", "big", "big"][i % 7], None, "r", 1, 2, "k", 3, "c", "i") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[5], ROWS[9], (None, "same text here", None, None, None, *ROWS[0][5:]), (None, None, None, None, None, *ROWS[0][5:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


@pytest.mark.parametrize("keep, best", [("largest", max), ("smallest", min)])
def test_exact(docs, empty, keep, best):
    rows = exact_duplicates(docs, keep=keep).collect()
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    text = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(rows) == len(ROWS)
    for r in rows:
        group = groups[text[r.text_sha256]]
        known = [i for i in group if i is not None]
        assert (r.group_size, r.keep_id) == (len(group), best(known) if known else None) and r.kept == (r.doc_id == r.keep_id)
    assert exact_duplicates(empty).count() == 0


def test_exact_groups_that_ranges_cut(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 17}") for i in range(3000)]
    out = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), keep="largest")
    sizes = collections.Counter(t for _, t in rows)
    assert out.where("kept").count() == len(sizes) and sorted(r[0] for r in out.where("kept").select("group_size").collect()) == sorted(sizes.values())


def test_mix(spark, docs, empty):
    rows = mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs).collect())) and len(rows) == len(ROWS)
    size = {i: len(SPLIT.findall(t or "")) for i, t in enumerate(TEXTS)}
    assert all(r["size"] == size[r.doc_id] for r in rows if r.doc_id is not None)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
    for r in rows:
        assert r.taken == r.copies * r["size"] <= 3 * r["size"] and r.target <= 3 * r.source_size + 1e-9
    assert mix(empty).count() == 0
    many = spark.createDataFrame([(i, "w " * int(n), f"s{i % 3}") for i, n in enumerate(np.random.default_rng(3).integers(1, 300, 900))], "doc_id long, text string, source string")
    for s in mix(many).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert s.n == pytest.approx(s.t, rel=0.01)


def test_mix_meets_targets_with_ids_that_repeat(spark):
    r = np.random.default_rng(5)
    rows = [(None if i % 3 else 7, "w " * int(n), "null ids") for i, n in enumerate(r.integers(1, 30, 900))]
    rows += [(5, "one text that many rows share", "repeats")] * 500 + [(i, "w " * int(n), "plain") for i, n in enumerate(r.integers(1, 300, 600))]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert len(got) == len(rows) and all(x.taken <= 3 * x["size"] for x in got)
    for s in ("null ids", "repeats", "plain"):
        own = [x for x in got if x.source == s]
        assert sum(x.taken for x in own) == pytest.approx(own[0].target, rel=0.01)
    plain = [x for x in got if x.source == "plain"]
    more = [x.copies > min(y.copies for y in plain) for x in plain]
    short, long = (np.mean([m for m, x in zip(more, plain, strict=True) if (x["size"] < 60) == small]) for small in (True, False))
    assert short > long  # chances are unequal


def test_targets_stop_and_are_dealt_again(spark):
    got = {r.source: r.target for r in source_targets(spark.createDataFrame([("a", 100), ("b", 1), ("c", 10), (None, 100)], "source string, source_size long")).collect()}
    free = 211 - 3 - 30
    assert got == {"a": pytest.approx(free / 2), "b": 3.0, "c": 30.0, None: pytest.approx(free / 2)}


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    got, coded = by_id(bpe.round_trip(docs, TOKENIZER)), bpe.encode(docs, TOKENIZER)
    texts = by_id(bpe.decode(coded, TOKENIZER))
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert texts[i].text == decoded == (t or "")
    assert bpe.round_trip(empty, TOKENIZER).count() == bpe.encode(empty, TOKENIZER).count() == 0


def test_bpe_trees_agree():
    own = bpe.codec(open(TOKENIZER).read())
    r = np.random.default_rng(5)
    for _ in range(50):
        word = bytes(r.choice(list(b"aabcdeth ing"), int(r.integers(1, 200))).astype(np.uint8))
        width = max(2, 1 << (len(word) - 1).bit_length())
        assert own.merge_rows([word], width)[0] == own.merge_long(word)


def passages(texts):
    seen, out = {}, {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        hit = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if seen.get(b[p : p + 50], i) < i:
                hit[p : p + 50] = True
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], i)
        hit = hit[:-1]
        out[i] = len(b), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest()
    return out


def test_passages(spark, docs, empty):
    rows = suffix_dedup.repeated_passages(docs).collect()
    want = passages(TEXTS)
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
            assert sum(b - a for a, b in zip(r.span_starts, r.span_ends, strict=True)) == r.n_removed
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_passages_that_repeat_inside_a_document(spark):
    line, passage = prose(12), prose(90)
    whole = [(0, f"{passage[:150]} {line}"), (1, f"{line} {passage}")]
    twice = [(i, f"{prose(9)} {passage} {prose(7)} {passage}{prose(5)} {line} {prose(4)} {line} {line} {passage[40:]}") for i in range(2, 9)]
    twice += [(i, f"{prose(6)}{passage[100:300]} {prose(5)}{passage[100:300]} {prose(3)}") for i in range(9, 14)]
    twice += [(i, f"{prose(3)} {line} {prose(2)} {line} {prose(1)}") for i in range(14, 100)]  # hot
    want = passages([t for _, t in whole + twice])
    rdd = spark.sparkContext.parallelize(range(4), 4).flatMap(lambda p: twice[p::3] if p < 3 else whole)  # the smaller holders are in another task
    got = by_id(suffix_dedup.repeated_passages(spark.createDataFrame(rdd, "doc_id long, text string")))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want


def test_passages_around_a_hot_line(spark, monkeypatch):
    line = prose(12)
    texts = [prose(8) + line + prose(8) for _ in range(150)]
    rows = suffix_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = passages(texts)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in rows)


def test_suffix_array():
    r = np.random.default_rng(7)
    for _ in range(200):
        t = np.append(r.choice([97, 98, 98, 99, 255], int(r.integers(0, 60))), 255).astype(np.uint8)
        padded = t.tobytes() + b"\xff" * 200
        sa = suffix_dedup.two_stage_suffix_array(t, 128)
        assert sorted(sa.tolist()) == list(range(len(t)))
        upto = lambda a: padded[a : padded.index(b"\xff", a) + 1]  # noqa: E731  what follows a border doesn't count
        assert all(upto(a) <= upto(b) for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True))
        words = suffix_dedup.eight_bytes(t, 72)
        for a, b, n in zip(sa[:-1], sa[1:], suffix_dedup.common_prefixes(words, sa[:-1], sa[1:]), strict=True):
            x, y = padded[a : a + 56], padded[b : b + 56]
            assert n == next((k for k in range(56) if x[k] != y[k]), 56)


def shingle_counts(t):
    w = [x.encode() for x in SPLIT.findall(t or "")]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def probability_jaccard(a, b):
    both = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in both) for d in set(a) & set(b))


def classes(texts, threshold=0.8):
    label = list(range(len(texts)))
    sets = [shingle_counts(t) for t in texts]
    for j in range(len(texts)):
        for i in range(j):
            if (texts[i] or "") == (texts[j] or "") or (sets[i].keys() & sets[j].keys() and probability_jaccard(sets[i], sets[j]) >= threshold - 1e-12):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_near(docs, empty):
    rows = near_dedup.near_duplicates(docs).collect()
    want = classes(TEXTS)
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.class_id == (None if r.doc_id is None else want[r.doc_id]) and r.kept == (r.doc_id == r.class_id)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_large_loose_group(spark):
    r = np.random.default_rng(9)
    base = list(r.choice(LEXICON, 150))
    texts = []
    for _ in range(90):
        w = list(base)
        for p in r.integers(0, 150, int(r.integers(1, 9))):
            w[p] = f"e{r.integers(1000)}"
        texts.append(" ".join(w))
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(90)] == classes(texts)


def test_probability_jaccard_is_estimated():
    r = np.random.default_rng(4)
    names = r.integers(1, 2**62, 300).astype(np.uint64)
    a, b = names[:220], names[60:]
    wa, wb = r.integers(1, 5, 220), r.integers(1, 5, 240)
    text = np.repeat([0, 1], [220, 240])
    m = near_dedup.prob_minhash(text, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4096)
    exact = probability_jaccard(collections.Counter(dict(zip(a.tolist(), wa.tolist(), strict=True))), collections.Counter(dict(zip(b.tolist(), wb.tolist(), strict=True))))
    oa, ob = np.argsort(a), np.argsort(b)
    assert near_dedup.similarity((a[oa], wa[oa]), (b[ob], wb[ob])) == pytest.approx(exact)
    assert (m[0] == m[1]).mean() == pytest.approx(exact, abs=0.03)


def test_toxicity(spark, docs, empty):
    r = np.random.default_rng(6)
    texts, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        s = [prose(8) for _ in range(int(r.integers(1, 6)))]
        if bad:
            s[int(r.integers(len(s)))] = prose(3)[:-1] + " zqx" + "abc"[i % 3] + " " + prose(3)
        texts.append(" ".join(s))
        labels.append(int(bad))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    y = spark.createDataFrame([*enumerate(labels), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(d, y).collect()
    out = [x for x in rows if x.held_out]
    assert {x.doc_id for x in out} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([x.predicted == labels[x.doc_id] for x in out]) > 0.97
    for x in out:
        if labels[x.doc_id] and x.predicted:
            assert b"zqx" in texts[x.doc_id].encode()[x.worst_start : x.worst_end]
    model = toxicity.fit(d, y)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) and x.n_sentences >= 1 for x in got)
    assert toxicity.toxicity(empty, y).count() == 0 and toxicity.toxicity(docs, y.limit(0)).where("predicted = 1").count() == 0


def test_top_k(spark):
    r = np.random.default_rng(8)
    x = r.normal(0, 0.2, (700, 9)).astype(np.float32)
    x[300:420] = x[300]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (1000, [1.0, float("nan")] + [0.0] * 7, 1), (1100, [1.0, None] + [0.0] * 7, 1), (1200, [float("inf")] * 9, 1), (None, [1.0] * 9, 1), (1300, [], 1)]
    got = collections.defaultdict(list)
    for g in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")).orderBy("query_id", "rank").collect():
        got[g.query_id].append((g.vec_id, g.score))
    n = np.floor(1024 * x.astype(float)).astype(int)
    want = {}
    for q in range(0, 700, 100):
        s = n @ n[q]
        want[q] = [(int(i), int(s[i])) for i in sorted(range(700), key=lambda i: (-s[i], i)) if i != q][:10]
    assert dict(got) == want
    mixed = spark.createDataFrame([(0, [1e9, 2.0]), (1, [1e9, 1.0]), (2, [1e9, 1.0]), (3, [1.0]), (100, [2.0]), (5, [-1e9, 0.0])], "vec_id long, embedding array<double>")
    want = [(0, 1, 1, topk.LONG), (0, 2, 2, topk.LONG), (0, 3, 5, -topk.LONG), (100, 1, 3, 2 << 20)]
    assert [tuple(x) for x in topk.top_k(mixed).orderBy("query_id", "rank").collect()] == want
    large = spark.createDataFrame([(0, [1e5, 1.0]), (1, [9e4, 1.0]), (2, [9e4, 1.001])], "vec_id long, embedding array<double>")
    exact = lambda x: 102400000 * 92160000 + 1024 * int(np.floor(1024 * x))
    assert [(x.vec_id, x.score) for x in topk.top_k(large).orderBy("rank").collect()] == [(2, exact(1.001)), (1, exact(1.0))]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(few).collect() == [(0, 1, 1, 1024 * 2048)] and topk.top_k(few.limit(0)).count() == 0


def test_licences(docs, empty):
    got = by_id(licenses.scan_licences(docs))
    assert got[19].licences == "MIT,all-rights-reserved" and got[20].licences == "Apache-2.0" and got[20].n_unknown == 1 and got[0].licences == ""
    assert len(got) == len(TEXTS) and licenses.scan_licences(empty).count() == 0


GPL = "This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{b} either version {v} of the License, or (at your option) any later version."
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{more}
THIS SOFTWARE IS PROVIDED BY THE AUTHOR ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
THIRD = """
3. Neither the name of Example University, Inc nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
NOTICES = [
    (GPL.format(what="program", a=";", b=";", name="", v="2"), "GPL-2.0-or-later"),
    (GPL.format(what="program", a=":", b=",", name="", v="3"), "GPL-3.0-or-later"),
    (GPL.format(what="library", a=";", b=";", name="Lesser ", v="2.1"), "LGPL-2.1-or-later"),
    (GPL.format(what="library", a=":", b=",", name="Lesser ", v="3"), "LGPL-3.0-or-later"),
    (GPL.format(what="program", a=":", b=",", name="Affero ", v="3"), "AGPL-3.0-or-later"),
    ("MIT License\n\nCopyright (c) 2019 Some Body\n\n" + MIT, "MIT"),
    (MIT, "MIT"),
    (BSD.format(more=""), "BSD-2-Clause"),
    (BSD.format(more=THIRD), "BSD-3-Clause"),
    (APACHE, "Apache-2.0"),
    (MPL, "MPL-2.0"),
]


def licence_forms():
    import textwrap

    for text, want in NOTICES:
        blocks = text.split("\n\n")
        wrapped = "\n\n".join(textwrap.fill(" ".join(b.split()), 64) for b in blocks)
        yield from ((x, want) for x in (text, " ".join(text.split()), wrapped, "\n".join(f" * {x}".rstrip() for x in ["/*", *wrapped.split("\n"), "*/"]), "\n".join(f"# {x}" for x in wrapped.split("\n")), f"Some words first.\n\n{wrapped}\n\nAnd some after it."))
    for title, want in (("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-3.0-only"), ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", "GPL-2.0-only"), ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "LGPL-3.0-only"), ("Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/", "Apache-2.0"), ("Mozilla Public License Version 2.0\n==================================", "MPL-2.0")):
        yield f"   {title}\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n   Preamble\n\n" + " ".join([prose(9)] * 3), want
    yield "licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", "CC-BY-NC-4.0,CC-BY-4.0"
    yield "Licensed under CC BY 4.0\nwith words on the next line", "CC-BY-4.0"
    clauses = BSD.format(more="").split("\n\n")
    yield "\n\n".join(clauses[:2]), ""
    yield "\n\n".join([clauses[0], "This sentence has nothing to do with it.", *clauses[1:]]), ""  # pieces far apart are no licence
    yield "\n\n".join([clauses[0], "This license is another one.", *clauses[1:]]), ""


def test_licence_forms(spark):
    forms = list(licence_forms())
    got = by_id(licenses.scan_licences(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(forms)], "doc_id long, text string")))
    assert [(i, got[i].licences, got[i].sequence) for i, (_, want) in enumerate(forms) if got[i].licences != want] == []


def test_quality(spark, docs, empty):
    r = np.random.default_rng(10)
    good, bad = LEXICON[:25], LEXICON[35:]
    texts = [" ".join(r.choice(good if i % 2 else bad, 60)) for i in range(400)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality.resample(d, d.where("doc_id % 2 = 1 and doc_id < 100").select("doc_id"), share=0.3).collect()
    assert sum(x.selected for x in rows) == 120 and all(x.doc_id % 2 for x in rows if x.selected)
    low = min(x.key for x in rows if x.selected)
    assert all(x.key <= low for x in rows if not x.selected)
    got = quality.resample(docs, d.select("doc_id").limit(0)).collect()
    assert len(got) == len(ROWS) and quality.resample(empty, d.select("doc_id")).count() == 0


def test_gumbel_top_k_samples_in_proportion(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.log(F.lit(3.0))).otherwise(0.0).alias("log_ratio"))
    x = d.withColumn("key", F.col("log_ratio") + quality.gumbel(F.col("doc_id"), 1)).cache()
    even = x.where(quality.largest(x, 400)).where("doc_id % 2 = 0").count()
    assert x.where(quality.largest(x, 400)).count() == 400 and even / 400 == pytest.approx(0.75, abs=0.07)


def test_language_model(docs, empty):
    rows = [x for x in lm.lm_scores(docs, TOKENIZER).collect()]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {i: SPLIT.findall((t or "").translate(lower)) + [None] for i, t in enumerate(TEXTS)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = collections.Counter()
    for r in ROWS:
        if r[0] is None or not held[r[0]]:
            count.update(SPLIT.findall((r[1] or "").translate(lower)) + [None])
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(ROWS)
    for x in rows:
        if x.doc_id is not None:
            w = words[x.doc_id]
            assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[x.doc_id], len(w), sum(count[y] > 0 for y in w), n)
            assert x.base_score == pytest.approx(sum(np.log10((count[y] + 1) / (n + v + 1)) for y in w))
            assert x.score < 0
    assert lm.lm_scores(empty, TOKENIZER).count() == 0


def test_lm_counts_every_word(docs, monkeypatch):
    scores = []
    for most in (50_000, 0):  # whatever the sample shows to be frequent, each word's count takes part
        monkeypatch.setattr(lm, "FREQUENT", most)
        scores.append(by_id(lm.lm_scores(docs, TOKENIZER)))
    for i, r in scores[0].items():
        assert (r.score, r.base_score, r.n_known) == (pytest.approx(scores[1][i].score), pytest.approx(scores[1][i].base_score), scores[1][i].n_known)


def small_model(monkeypatch, seed=1):
    """A model of 12 classes, six of which open words (the end among them), with weights that aren't 0."""
    monkeypatch.setattr(M, "CLASSES", 12)
    r = np.random.default_rng(seed)
    opens = np.arange(12) < 6
    pairs = r.integers(1, 60, (12, 12)).astype(float)
    pairs[:, opens] *= 3
    pairs[M.END_CLASS, ~opens] = 0
    tables = M.Tables(pairs, opens)
    w = M.start_weights(tables)
    return r, opens, tables, {k: (x + r.normal(0, 0.3, x.shape)).astype(np.float32) for k, x in w.items()}


def test_attention_gradients(monkeypatch):
    r, opens, tables, w = small_model(monkeypatch)
    w = {k: x.astype(float) for k, x in w.items()}
    x, before, target = (r.integers(0, 12, (5, M.BLOCK)) for _ in range(3))
    x[target >= 6] = np.maximum(x[target >= 6], 1)  # nothing goes on with the end
    target[1, 9:] = -1
    opening = np.array([True, False, False, True, False])
    _, g = M.gradients(w, tables, x, before, target, opening)
    for k in w:
        at = np.unravel_index(int(np.argmax(np.abs(g[k]))), w[k].shape)
        losses = []
        for step in (1e-5, -1e-5):
            moved = {**w, k: w[k].copy()}
            moved[k][at] += step
            losses.append(M.gradients(moved, tables, x, before, target, opening)[0])
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[k][at], rel=1e-3, abs=1e-7)


def test_training_steps_equal_plain_adam(monkeypatch):
    """Steps that are prepared together, sums by slices and powers of the averages kept apart change nothing."""
    r, opens, tables, w = small_model(monkeypatch)
    w = {k: x.astype(float) for k, x in w.items()}
    monkeypatch.setattr(M, "PREPARED", 3)
    classes = r.integers(1, 12, 1300)
    classes[r.random(1300) < 0.5] = 4  # frequent beyond APART
    ends = np.array([500, 517, 1300])
    classes[ends - 1] = M.END_CLASS
    windows = M.windows_of(classes, ends, np.array([-1, 3, -1]))
    order = np.random.default_rng(1).permutation(len(windows))
    before, x, target, opening = M.unpacked(windows[order])
    steps = M.Steps(tables, x[:60], before[:60], target[:60], opening[:60], 20, float)
    assert all(len(late) for late in steps.late)
    want, m, s = {k: v.copy() for k, v in w.items()}, {k: 0 for k in w}, {k: 0 for k in w}
    tail = np.zeros(sum(w[k].size for k in ("first", "rest", "on", "r")))
    total = -(-len(order) // 20)
    assert total > 6 and len(order) % 20
    for i in range(total):
        at = slice(i * 20, i * 20 + 20)
        _, g = M.gradients(want, tables, x[at], before[at], target[at], opening[at])
        if i < 3:
            met, rows, _ = steps.run(i, M._views(M._packed(want), tables), tail)
            assert sorted(met) == sorted(set(np.concatenate([x[at], before[at]]).ravel())) and np.allclose(rows, np.concatenate([g[k] for k in "qkv"], 1)[met])
            assert np.allclose(tail, np.concatenate([g[k].ravel() for k in ("first", "rest", "on", "r")]))
        for k in w:
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * s[k] + 0.01 * g[k] ** 2
            rate = 0.03 * (1 - i / total) + 0.03 * 0.05
            want[k] -= rate * (m[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(s[k] / (1 - 0.99 ** (i + 1))) + 1e-8)
    got = M.train(w, tables, windows, 0.03, batch=20)
    assert all(np.allclose(got[k], want[k], atol=1e-4) for k in w)


def test_hashes_are_found_among_sorted_ones():
    r = np.random.default_rng(4)
    known = np.unique(np.concatenate([r.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2), np.arange(40, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(9, dtype=np.uint64)]))
    names = np.concatenate([known, known + np.uint64(1), r.integers(0, 2**63, 300, dtype=np.uint64)])
    hit = known[lm.found(known, names, lm.begins_of(known))] == names
    assert (hit == np.isin(names, known)).all() and hit.sum() >= len(known)


def direct(w, tables, classes):
    """log chances of one text's classes, place by place."""
    out, inputs = [], [M.END_CLASS, *classes[:-1]]
    for i, c in enumerate(classes):
        seen = range(max(0, i // M.BLOCK * M.BLOCK - M.BLOCK), i + 1)
        s = np.array([w["q"][inputs[i]] @ w["k"][inputs[j]] / np.sqrt(M.WIDTH) + w["r"][i - j] for j in seen])
        p = np.exp(s - s.max())
        context = (p / p.sum()) @ w["v"][[inputs[j] for j in seen]]
        odds = tables.on[inputs[i]] + context @ w["on"]
        ends = tables.opens[c]
        on = 0 if inputs[i] == M.END_CLASS else -np.log1p(np.exp(odds if ends else -odds))
        z = (tables.first if ends else tables.rest)[inputs[i]] + (w["first"] if ends else w["rest"]) @ context
        out.append((z[tables.group[c]] - np.log(np.exp(z).sum()) + tables.inside[inputs[i], c], on))
    return np.array(out)


def test_windows_score_as_the_whole_text_would(monkeypatch):
    r, opens, tables, w = small_model(monkeypatch)
    texts = []
    for n in (1, 15, 16, 17, 70, 120):
        t = r.integers(1, 12, n)
        t[0], t[-1] = 3 if n > 1 else 0, 0
        texts.append(t)
    classes, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    x, target, opening = M.blocks(classes, offsets)
    assert (target.ravel() >= 0).sum() == len(classes)  # each is scored once
    got = np.stack([v[target.ravel() >= 0] for v in M.log_chances(w, tables, x, target, opening)], 1)
    assert np.allclose(got, np.concatenate([direct(w, tables, t.tolist()) for t in texts]), atol=2e-4)
    monkeypatch.setattr(M, "SEGMENT", 4 * M.BLOCK)
    start, end, text, number = M.segments(offsets)
    leads = np.where(number > 0, np.where(start > offsets[text], classes[start - 1], M.END_CLASS), -1)
    rows = M.windows_of(np.concatenate([classes[a:b] for a, b in zip(start, end, strict=True)]), np.cumsum(end - start), leads)
    before, x2, target2, opening2 = M.unpacked(rows)
    assert (before == M.befores(x, opening)).all() and (target2 == target).all() and (opening2 == opening).all() and (x2[target >= 0] == x[target >= 0]).all()


def test_token_chances_add_up_to_one(monkeypatch):
    r, opens, tables, w = small_model(monkeypatch)
    ids = np.arange(12)  # each class has one subword; 0 is the end
    spelt = [[a] for a in range(1, 6)]
    layers = [spelt]
    for _ in range(4):
        layers.append([x + [b] for x in layers[-1] for b in range(6, 12)])
    every = [[0], *[x for layer in layers for x in layer]]
    known = [x for x in every[1:] if r.random() < 0.3 and len(x) < 4]
    counts = r.integers(1, 9, len(known))
    name = lambda x: lm.words(np.array([*x, 0]), np.array([0, len(x) + 1]), opens)[1][0]
    names = np.array([name(x) for x in known])
    order = np.argsort(names)
    first = np.array([x[0] for x in known])
    scorer = lm.Scorer(ids, np.zeros(12), w, tables, opens, names[order], counts[order], [int(counts.sum()), len(known), 5, 2], np.bincount(first, counts, 12), np.bincount(first, minlength=12))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for history in ([], [2, 7, 8, 3, 1, 9, 2, 7, 8], list(r.integers(1, 6, 40))):
        begin = len(history)
        texts = [[*history, *x, *([0] if x != [0] else [])] for x in every]
        joined, offsets = np.concatenate(texts).astype(int), np.cumsum([0, *map(len, texts)])
        of, logs, _ = scorer.tokens(joined, offsets, *none)
        places = np.concatenate([np.flatnonzero(opens[t]) for t in texts])
        chances = np.exp(logs[places == begin])
        assert len(chances) == len(every) and 0.9 < chances.sum() <= 1 + 1e-4  # words of more than five subwords have the rest
        missing = 1 - chances.sum()
        assert missing < 4 * chances[[len(x) == 5 for x in every]].sum()


def test_held_out_texts_and_partitions_move_no_score(spark):
    texts = [prose(int(n)) for n in np.random.default_rng(2).integers(5, 90, 160)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(160)]
    table = lambda t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    score = lambda d: {r.doc_id: r.score for r in lm.lm_scores(d, TOKENIZER).collect()}
    first, other = score(table(texts)), score(table([f"{t} {LONG} new" if h else t for t, h in zip(texts, held, strict=True)]))
    assert all(other[i] == pytest.approx(first[i], abs=1e-6) for i in range(160) if not held[i])
    dealt = score(table(texts).repartition(3, "text"))
    assert dealt == {i: pytest.approx(x, abs=1e-6) for i, x in first.items()}


def test_lexicon_equals_word_by_word(monkeypatch):
    own = bpe.codec(open(TOKENIZER).read())
    monkeypatch.setattr(lm, "REMEMBERED", 40)
    lexicon = lm.Lexicon(open(TOKENIZER).read())
    odd = ["a\u2003 \u2003b \u00a0 c\u00a0", "\u3000x y\u3000\u3000 z", "<|endoftext|> 12\u20034.", ""]
    for part in (TEXTS[:12], odd, TEXTS[12:30], TEXTS[:5], odd + TEXTS[30:]):
        raw = [(t or "").encode() for t in part]
        ids, ends, n = lexicon.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for i, t in enumerate(part):
            found = SPLIT.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
            pieces = [p for w in found for p in own.words.findall(" " + w)]
            own.learn(pieces)
            assert ids[ends[i] : ends[i + 1]].tolist() == [x for p in pieces for x in np.frombuffer(own.known[p], "<u4").tolist()] + [lm.END] and n[i] == len(found) + 1


def test_hashes_don_t_depend_on_place():
    data = np.frombuffer("one two  one\ttwo one".encode(), np.uint8)
    first, last, begin = wordhash.words(data, np.array([0, 8, len(data)]))
    names = wordhash.spans(wordhash.running(data), first, last)
    assert begin.tolist() == [0, 2, 5] and names[0] == names[2] == names[4] and names[1] == names[3] and names[0] != names[1]
    assert pa.array([1]).to_pylist() == [1]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("n", [None, "n"])
def test_join_with_hot_keys(spark, how, n):
    keys = ["hot"] * 60 + [None, None] + [f"k{i % 15}" for i in range(45)] + ["alone"]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    held = collections.Counter(k for k in keys if k and k != "alone")
    table = spark.createDataFrame([(k, k.upper(), c) for k, c in held.items()], "key string, value string, n long")
    got = util.by_key(rows, table, "key", how, n=n, limit=0, hot_keys=10).select("id", "key", "value").collect()
    want = [(i, k, k.upper() if k in held else None) for i, k in enumerate(keys) if how == "left" or k in held]
    assert sorted(tuple(r) for r in got) == want


def test_dedup_with_hot_keys(docs, monkeypatch):
    """The way for large tables gives what broadcasts give."""
    near, passages = (sorted(map(str, f(docs).collect())) for f in (near_dedup.near_duplicates, suffix_dedup.repeated_passages))
    for module in (near_dedup, suffix_dedup):
        monkeypatch.setattr(module, "by_key", functools.partial(util.by_key, limit=0, hot_keys=12))
        monkeypatch.setattr(module, "small", lambda df: df)
    monkeypatch.setattr(near_dedup, "DEAL", 2)
    assert sorted(map(str, near_dedup.near_duplicates(docs).collect())) == near
    assert sorted(map(str, suffix_dedup.repeated_passages(docs).collect())) == passages


def test_attention_learns_from_every_training_block():
    class Shared:
        value = np.arange(65536) % M.CLASSES

    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 900, n).astype(np.uint16).tobytes() for n in rng.integers(1, 3000, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["ids"])
    got = [x for i in range(lm.ROUNDS) for x in lm._segments(Shared, i, 4)(iter([batch]))]
    start, end, *_ = M.segments(np.cumsum([0, *(len(t) // 2 for t in texts)]))
    assert sum(len(v.as_py()) // 2 for x in got for v in x.column("classes")) == int((end - start).sum()) >= sum(len(t) // 2 for t in texts)
