"""Stages of corpus_pipeline and the whole of it, on rows with nulls, empty texts, repeats and columns whose names the stages use
themselves, against brute force; and on an empty table."""

import collections
import hashlib

import numpy as np
import pytest
from test_operators import SPLIT, classes, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")

CLASHES = ["score", "predicted", "__text", "text_sha256", "gone_id", "gone_text", "row", "copy", "copies", "kept", "size", "u", "class_id", "source_size"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
r = np.random.default_rng(21)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, texts, labels = tmp_path_factory.mktemp("tables"), [], []
    for i in range(500):
        words = prose(int(r.integers(30, 90)))
        bad = i % 6 == 0
        texts.append(words + (" zqxvile words here." if bad else ""))
        labels.append((i, 1, int(bad)))
    texts[1], texts[3], texts[5] = None, "", "  \n"
    for i, j in ((40, 200), (41, 201), (41, 202), (44, 203)):
        texts[j] = texts[i]
    for i, j in ((50, 210), (51, 211)):
        texts[j] = texts[i] + " tail"
    rows = [(i, t, "en", [None, "a", "b", "b", "b"][i % 5], None) for i, t in enumerate(texts)]
    rows += [rows[40], (None, texts[50], None, None, None), (None, None, None, None, None), (None, "words of its own", None, "a", 1)]
    spark.createDataFrame([(*x, *range(len(CLASHES))) for x in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def kinds(df):
    return collections.Counter((x.doc_id, x.text) for x in df.collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, folder)
        if name == "BPE":
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == left.count()
            decoded = collections.Counter((x.doc_id, x.decoded_sha256) for x in out.collect())
            assert decoded == collections.Counter({(i, hashlib.sha256((t or "").encode()).hexdigest()): 0 for i, t in kinds(left)} | collections.Counter((x.doc_id, hashlib.sha256((x.text or "").encode()).hexdigest()) for x in left.collect()))
            break
        out = out.cache()
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        before, after = kinds(left), kinds(out)
        if name == "toxicity":
            assert all("zqx" not in (t or "") for _, t in after) and all(n == after[k] for k, n in before.items() if "zqx" not in (k[1] or ""))
        if name == "exact dedup":
            best = {}
            for i, t in before:
                if i is not None:
                    best[t or ""] = min(i, best.get(t or "", i))
            assert after == {(i, t): n for (i, t), n in before.items() if i == best.get(t or "")}
        if name == "near dedup":
            known = sorted((i, t) for i, t in before if i is not None)
            label = classes([t for _, t in known])
            assert after == {k: before[k] for k, x in zip(known, label, strict=True) if known[x] == k} | {k: n for k, n in before.items() if k[0] is None}
        if name == "mix sources":
            assert all(n <= 3 * before[k] for k, n in after.items())
            words = lambda rows: collections.Counter({s: sum(len(SPLIT.findall(x.text or "")) for x in rows if x.source == s) for s in {x.source for x in rows}})
            had, has = words(left.collect()), words(out.collect())
            level = dict(zip(sorted(had, key=lambda s: (s is None, s)), (1, 2, 3), strict=False))
            want = {s: min(3 * had[s], sum(had.values()) * level[s] / sum(level.values())) for s in had}
            if all(want[s] < 3 * had[s] for s in had):
                assert all(has[s] == pytest.approx(want[s], rel=0.02) for s in had)
        left = out


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(docs.collect(), key=str) == sorted(corpus_pipeline.run(spark, folder).collect(), key=str)


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
