"""Worked example, layouts, linkage, splits, sources and the entry points."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.config import Config
from kinspark.operators import blocking as B
from kinspark.operators import cluster
from kinspark.operators import evaluate as E
from kinspark.operators import scored as R
from kinspark.operators import tokens as K
from kinspark.operators.cluster import complete_linkage, components, link
from kinspark.operators.pairs import attribute_matches, comparable, profiles, score_pairs
from kinspark.plans import studies
from kinspark.sources import catalogue as C
from kinspark.streaming.blocks import incremental_candidates

CATALOGUE = {
    "M1": [
        {"modelID": "M1", "title": 'Acme 32" LED 1080p', "shop": "A", "url": " u ", "featuresMap": {"Refresh Rate": "60 hz", "Size": "32 inch", "Ratio": "16:9"}},
        {"title": "Acme 32-inch LED TV 1080p", "shop": "B", "featuresMap": {"Refresh Rates": "60 hz", "Screen Size": "32 inches"}},
    ],
    "junk": "not a list",
    "M2": [{"modelID": "M2", "title": None, "shop": "C"}],
}


@pytest.fixture(scope="module")
def products(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "c.json"
    path.write_text(json.dumps(CATALOGUE))
    return C.load_catalogue(spark, str(path)).cache()


def test_catalogue(products):
    rows = products.orderBy("pid").collect()
    assert [(r.pid, r.model_id, r.shop, r.title, r.url) for r in rows] == [(0, "M1", "A", 'Acme 32" LED 1080p', "u"), (1, "M1", "B", "Acme 32-inch LED TV 1080p", ""), (2, "M2", "C", "None", "")]
    assert [f.key for f in rows[0].features] == ["Refresh Rate", "Size", "Ratio"] and rows[2].features == []


def test_top_level_must_be_an_object(spark, tmp_path):
    (tmp_path / "x.json").write_text("[]")
    with pytest.raises(Exception, match="must be an object"):
        C.load_catalogue(spark, str(tmp_path / "x.json")).collect()


def test_worked_example(products):
    got = {r.pid: r for r in K.token_arrays(products).collect()}
    assert set(got[0].base) == {"1080p", "32", "32inch", "60"} and set(got[1].base) == {"1080p", "32inch", "60"}
    assert set(got[0].typed) == {"16:9_ratio", "32inch", "32_inch", "1080p", "1080_res", "60_hz"}
    assert set(got[0].combined) == set(got[0].typed) | {"60"} and got[2].base == []
    vocab = {r.token: r.fid for r in K.vocabulary(K.tokens(products)).collect()}
    assert vocab == {"1080p": 0, "32": 1, "32inch": 2, "60": 3}
    two = products.where("pid < 2")
    sets = K.feature_sets(two, K.tokens(two))
    assert {r.pid: r.fids for r in sets.collect()} == {0: [0, 1, 2, 3], 1: [0, 2, 3]} and K.universe_size(sets) == 4
    want = {0: [159104943, 352417353, 86939546, 481855900], 1: [159104943, 352417353, 86939546, 1037875386]}
    for make in (B.signatures, B.signatures_by_expression):
        assert {r.pid: list(r.sig) for r in make(sets, 4, 4, 0).collect()} == want
    sigs = B.signatures(sets, 4, 4, 0)
    assert [B.candidates(sigs, 4, r, b).count() for r, b in ((4, 1), (2, 2), (1, 4))] == [0, 1, 1]
    pairs = B.candidates(sigs, 4, 2, 2)
    assert E.blocking_metrics(pairs, two).first().asDict() == {"candidate_pairs": 1.0, "duplicates_found": 1.0, "pq": 1.0, "pc": 1.0, "f1_star": 1.0, "t": 1.0}
    assert E.blocking_metrics(pairs.where("false"), two).first().asDict() == dict.fromkeys(("candidate_pairs", "duplicates_found", "pq", "pc", "f1_star", "t"), 0.0)
    scored = score_pairs(two, pairs)
    row = scored.first()
    assert (row.n_matches, row.avg_sim, row.title_sim) == (1, 1.0, 1.0) and row.model_sim == pytest.approx(1 / 3) and row.dist == pytest.approx(0.116667, abs=1e-6)
    assert E.cluster_metrics(link(two, scored, [0.25]), two, ["eps"]).first().f1 == 1.0
    assert score_pairs(products, B.all_pairs(products)).count() == 1  # no attributes: never compared


def test_text_work_is_done_once(spark, products):
    more = products.unionByName(products.withColumn("pid", F.col("pid") + 10)).unionByName(products.where("pid = 1").withColumn("pid", F.lit(30)).withColumn("title", F.lit(None).cast("string")))
    got = {r.pid: set(r.combined) for r in K.token_arrays(more).collect()}
    assert set(got) == {0, 1, 2, 10, 11, 12, 30} and all(got[x] == got[x + 10] for x in (0, 1, 2)) and got[30] != got[1]
    plan = K.tokens(more, "combined")._jdf.queryExecution().optimizedPlan().toString()
    assert "pids" in plan and not any("array_union" in x for x in plan.splitlines() if "Filter" in x)  # no filter into which the text work is copied


def test_empty_sets_collide(spark):
    sets = spark.createDataFrame([(0, []), (1, []), (2, [5])], "pid long, fids array<long>")
    assert B.candidates(B.signatures(sets, 6, 10), 6, 2, 3).collect() == [(0, 1)]


def test_layouts():
    assert len(B.layouts(840)) == 33 and (29, 29) in B.layouts(840) and B.layouts(4) == [(1, 4), (2, 2), (4, 1)]
    assert B.band_slices(5, 2, 3) == [(0, 2), (2, 2), (4, 1)] and B.band_slices(5, 5, 1) == [(0, 5)]
    with pytest.raises(ValueError):
        B.band_slices(5, 2, 2)
    with pytest.raises(ValueError):
        B.band_slices(5, 1, 6)
    assert B.hash_parameters(2, 4, 0) == ([(1813382119, 827307999), (1627694679, 1911784257)], 2147483647)


def test_counted_pairs_agree_with_joined_ones(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n, layouts = 90, B.layouts(12)
    sigs = spark.createDataFrame([(i, rng.integers(0, 4, 12).tolist()) for i in range(n)] + [(n, [B.NO_FEATURE] * 12), (n + 1, [B.NO_FEATURE] * 12)], "pid long, sig array<long>")
    products = spark.createDataFrame([(i, None if i == 7 or i == 8 else str(i % 20)) for i in range(n + 2)], "pid long, model_id string")
    joined = {(r, b): E.blocking_metrics(B.candidates(sigs, 12, r, b), products).first().asDict() for r, b in layouts}
    monkeypatch.setattr(B, "COUNTED_ROWS", 25)
    monkeypatch.setattr(B, "COUNTED_STEP", 16)
    for dense in (0.0, 0.05, 2.0):
        monkeypatch.setattr(studies, "DENSE", dense)
        got = {(x.r, x.b): x.asDict() for x in studies.blocking_grid(products, sigs, 12).collect()}
        assert got == {(r, b): {"r": r, "b": b, **m} for (r, b), m in joined.items()}
    monkeypatch.setattr(B, "LARGE_BUCKET", 3)
    assert {(r, b): B.candidates(sigs, 12, r, b).count() for r, b in layouts} == {k: m["candidate_pairs"] for k, m in joined.items()}


def test_no_pair_is_made_to_count_partners(spark):
    p = spark.createDataFrame([(x,) for x in (5, 1, 9, 30, 7)], "pid long")
    assert {(r.i, r.partners) for r in B.partner_counts(p).collect()} == {(1, 4), (5, 3), (7, 2), (9, 1)}
    assert "Join" not in B.partner_counts(p)._jdf.queryExecution().executedPlan().toString()


def test_counting_makes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, str(i % 9), str(i % 3), "sony tv" if i % 4 else "lg tv", [] if i % 5 == 0 else [(0, "k", "v")], rng.integers(0, 3, 12).tolist()) for i in range(160)]
    p = spark.createDataFrame(rows + [(200 + i, *rows[0][1:]) for i in range(70)], "pid long, model_id string, shop string, title string, features array<struct<pos:int,key:string,value:string>>, sig array<long>")
    sigs, pairs = p.select("pid", "sig"), B.candidates(p.select("pid", "sig"), 12, 3, 4).cache()
    want = (pairs.count(), score_pairs(p, pairs).count())
    metrics = {(r, b): E.blocking_metrics(B.candidates(sigs, 12, r, b), p).first().asDict() for r, b in ((3, 4), (6, 2))}
    for name in ("candidates", "bucket_pairs"):
        monkeypatch.setattr(B, name, None)
    assert tuple(studies.filter_counts(p, sigs, 12, 3, 4).first()) == want
    for (r, b), m in metrics.items():
        assert studies.blocking_grid(p, sigs, 12, [(r, b)]).first().asDict() == {"r": r, "b": b, **m}
    monkeypatch.setattr(B, "CODED_VALUES", 3)  # values as they are
    assert tuple(studies.filter_counts(p, sigs, 12, 3, 4).first()) == want


def test_pairs_are_made_once_without_a_shuffle_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    sig = rng.integers(0, 3, (120, 12))
    sigs = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sig)], "pid long, sig array<long>")
    want = sorted((i, j) for i, j in itertools.combinations(range(120), 2) if (sig[i] == sig[j]).reshape(4, 3).all(1).any())
    got = B.candidates(sigs, 12, 3, 4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want and "Aggregate" not in plan
    labels = sigs.where("pid <> 3").select("pid", F.struct((F.col("pid") % 3).alias("shop"), F.lit("").alias("brands")).alias("own"))
    told = B.candidates(sigs, 12, 3, 4, labels, "own.shop <> own2.shop and own.brands = own2.brands")
    assert sorted(map(tuple, told.collect())) == [(i, j) for i, j in want if 3 not in (i, j) and i % 3 != j % 3]
    monkeypatch.setattr(B, "FIRST_BANDS", 1)
    assert sorted(map(tuple, B.candidates(sigs, 12, 3, 4).collect())) == want


def test_products_of_one_signature_meet_as_one(spark, monkeypatch):
    rng = np.random.default_rng(9)
    kinds = rng.integers(0, 3, (6, 6)).tolist()
    rows = [(i, kinds[i % 6], ["A", "B", None][i % 3]) for i in range(90)]
    x = spark.createDataFrame(rows, "pid long, sig array<long>, shop string")
    labels = x.where("pid <> 4").select("pid", F.struct("shop", F.lit("").alias("brands")).alias("own"))
    agree = lambda i, j: any(rows[i][1][k : k + 2] == rows[j][1][k : k + 2] for k in (0, 2, 4))
    want = [(i, j) for i, j in itertools.combinations(range(90), 2) if agree(i, j)]
    told = [(i, j) for i, j in want if 4 not in (i, j) and {rows[i][2], rows[j][2]} == {"A", "B"}]
    plan = B.candidates(x, 6, 2, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("Join")  # products are spelled out after the join of signatures
    assert B._pieces(B.coded(x, 6)[0]).count() == 6
    for piece, large, first in ((256, 4096, 64), (4, 3, 64), (4, 3, 1)):
        for name, value in (("PIECE", piece), ("LARGE_BUCKET", large), ("FIRST_BANDS", first)):
            monkeypatch.setattr(B, name, value)
        assert sorted(map(tuple, B.candidates(x, 6, 2, 3).collect())) == want
        assert sorted(map(tuple, B.candidates(x, 6, 2, 3, labels, "own.shop <> own2.shop and own.brands = own2.brands").collect())) == told


@pytest.mark.parametrize("small", [False, True])
def test_scores_are_made_in_buckets(spark, monkeypatch, small):
    rng = np.random.default_rng(8)
    word = lambda *xs: str(rng.choice(xs))
    kinds = []
    for _ in range(40):
        names = list(rng.permutation(["Size", "Sizes", "Rate", "Width"]))[: rng.integers(0, 5)]
        feats = [(n, k, word("32 inch", "32 inches", "60hz x1", "", "7")) for n, k in enumerate(names)]
        kinds.append((word("A", "B", "C"), word("sony tv a1", "tv a1 b2", "Tv A1", ""), feats, rng.integers(0, 2, 6).tolist()))
    kinds += [(None, "tv a1", kinds[0][2], kinds[0][3]), ("A", None, [(0, "Size", None)], kinds[0][3])]
    rows = [(int(i), "m", *kinds[k]) for i, k in zip(rng.permutation(100), rng.integers(0, len(kinds), 100), strict=True)]  # with copies
    p = spark.createDataFrame(rows, "pid long, model_id string, shop string, title string, features array<struct<pos:int,key:string,value:string>>, sig array<long>")
    sigs, cfg = p.select("pid", "sig"), Config()
    pairs = B.candidates(sigs, 6, 2, 3).cache()
    want = sorted(tuple(r) for r in score_pairs(p, pairs, cfg).collect())
    if small:
        for name, value in (("BLOCK", 5), ("STEP", 7), ("TABLE", 0), ("BITS", 0)):
            monkeypatch.setattr(R, name, value)
    got = R.scored_candidates(p, sigs, 6, 2, 3, cfg)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100 and len({r[3] for r in want}) > 5
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.splitlines()[0]  # what comes out of the buckets goes nowhere else
    assert sorted(map(tuple, R.scored_candidates(p, sigs, 6, 2, 3, cfg, 0.6).collect())) == [r for r in want if r[6] < 0.6]
    assert sorted(map(tuple, R.title_candidates(p, sigs, 6, 2, 3, cfg).collect())) == sorted((r[0], r[1], r[5]) for r in want)
    x = comparable(pairs, profiles(p)).select("i", "j", attribute_matches(F.col("a.attrs"), F.col("b.attrs"), cfg.gamma).alias("m"))
    flat = lambda x: sorted((r.i, r.j, *m) for r in x.collect() for m in r.m)
    assert flat(R.matched_candidates(p, sigs, 6, 2, 3, cfg)) == flat(x)


def test_signatures_with_a_wide_universe(spark):
    ids = [0, 5, 2**33, 2**33 + 7]
    ab, p = B.hash_parameters(8, 2**33 + 8, 3)
    got = B.signatures(spark.createDataFrame([(1, ids)], "pid long, fids array<long>"), 8, 2**33 + 8, 3).first().sig
    assert p * (2**33 + 9) >= 2**64 and list(got) == [min((a * x + b) % p for x in ids) for a, b in ab]


def naive_linkage(n, dist, eps):
    clusters = [{i} for i in range(n)]
    while True:
        best = None
        for a, b in itertools.combinations(range(len(clusters)), 2):
            d = max(dist.get((min(i, j), max(i, j)), np.inf) for i in clusters[a] for j in clusters[b])
            if d < eps and (best is None or d < best[0]):
                best = (d, a, b)
        if best is None:
            return sorted(map(sorted, clusters))
        clusters[best[1]] |= clusters.pop(best[2])


def test_linkage_agrees_with_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        dist = {p: float(rng.normal(0.4, 0.4)) for p in itertools.combinations(range(n), 2) if rng.random() < 0.6}
        i, j = (np.array([p[k] for p in dist], int) for k in (0, 1))
        for eps, labels in zip((0.25, 0.38, 0.52), complete_linkage(n, i, j, np.array(list(dist.values())), [0.25, 0.38, 0.52]), strict=True):
            groups = {}
            for x, g in enumerate(labels):
                groups.setdefault(int(g), []).append(x)
            assert sorted(groups.values()) == naive_linkage(n, dist, eps)


def test_linkage_reads_pairs_in_order(spark, monkeypatch):
    rng, levels = np.random.default_rng(10), [0.25, 0.38, 0.52]
    n, shop = 60, rng.integers(0, 4, 60)
    dist = {p: float(rng.choice([-0.5, 0.1, 0.2, 0.25, 0.3, 0.4, 0.6])) for p in itertools.combinations(range(n), 2) if shop[p[0]] != shop[p[1]] and rng.random() < 0.8}
    products = spark.createDataFrame([(10 * i, str(shop[i])) for i in range(n)] + [(5, None)], "pid long, shop string")
    scored = spark.createDataFrame([(10 * i, 10 * j, d) for (i, j), d in dist.items()], "i long, j long, dist double").repartition(4)
    want = {(e, 10 * x): 10 * g for e in levels for group in naive_linkage(n, dist, e) for g in [min(group)] for x in group} | {(e, 5): 5 for e in levels}
    sizes = []
    for streamed, apart in ((10**6, None), (100, "shop")):
        monkeypatch.setattr(cluster, "STREAMED", streamed)
        keep = cluster.stored
        monkeypatch.setattr(cluster, "stored", lambda df, keep=keep: (lambda out: (sizes.append(out.count()) if out.columns == ["i", "j", "dist"] else None, out)[1])(keep(df)))
        got = {(r.eps, r.pid): r.cluster_id for r in link(products, scored, levels, apart).collect()}
        assert {k: {x for x in want if want[x] == want[k] and x[0] == k[0]} for k in want} == {k: {x for x in got if got[x] == got[k] and x[0] == k[0]} for k in got}
        monkeypatch.setattr(cluster, "stored", keep)
    assert len(sizes) > 3 and sizes[-1] < sizes[0] / 4  # pairs that can't matter any more are left out
    assert "Pandas" not in link(products, scored, levels)._jdf.queryExecution().optimizedPlan().toString()


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(10, 25)] + [(1, 2)], "i long, j long")
    assert {(r.pid, r.component) for r in components(chain).collect()} == {(i, 10) for i in range(10, 26)} | {(1, 1), (2, 1)}


def test_bootstrap(spark):
    rows = E.bootstrap(spark, 10, 0, 1).collect()
    assert {r.pid for r in rows if r.part == "train"} == {0, 1, 2, 3, 5, 6, 8} and {r.pid for r in rows if r.part == "test"} == {4, 7, 9}


def test_best_eps_takes_the_first_of_equals(spark):
    x = spark.createDataFrame([(1, 0.25, 0, 0.5), (1, 0.38, 1, 0.7), (1, 0.52, 2, 0.7)], "k int, eps double, ord int, f1 double")
    assert E.best_eps(x, ["k"]).first().eps == 0.38


def test_cluster_metrics_add_up(spark):
    rng = np.random.default_rng(2)
    p = spark.createDataFrame([(i, str(rng.integers(4)), int(rng.integers(5))) for i in range(30)], "pid long, model_id string, cluster_id long")
    m = E.cluster_metrics(p.select("pid", "cluster_id"), p).first()
    assert m.TP + m.FP + m.TN + m.FN == 30 * 29 / 2


def test_results_and_curves(spark, tmp_path):
    rows = [(v, r, 1, 0.1, c, 1.0, q, q, q, 0.5, 0.5, 0.5) for v, r, c, q in (("base", 1, 0.0, 0.0), ("base", 2, 187578.0, 1.0), ("typed", 1, 0.0, 0.5), ("typed", 2, 187578.0, 1.0))]
    C.write_results(spark.createDataFrame(rows, C.RESULT_SCHEMA), str(tmp_path / "r"))
    results = C.load_results(spark, str(tmp_path / "r"))
    assert [r.frac_comp for r in results.collect()] == [0.0, 0.0, 1.0, 1.0]
    gain = {r.variant: (r.auc, r.gain) for r in E.relative_area(E.series(results, "PC_lsh"), "base").collect()}
    assert gain == {"base": (0.5, 0.0), "typed": (0.75, 50.0)}
    assert E.series(results, "F1star_lsh").count() == 3


def test_token_dump(spark, products, tmp_path):
    C.write_tokens(K.tokens(products), products, str(tmp_path / "t"))
    rows = spark.read.json(str(tmp_path / "t")).orderBy("index").collect()
    assert rows[0].tokens == ["1080p", "32", "32inch", "60"] and rows[2].tokens == []


def test_evaluation(spark, products):
    with pytest.raises(ValueError):
        studies.evaluation(products, Config(n_hashes=4, rows=3, bands=2))
    with pytest.raises(ValueError):
        K.tokens(products, "other")
    out = studies.evaluation(products, Config(n_hashes=4, rows=2, bands=2, bootstraps=2))
    assert out["blocking"].first().pc == 1.0 and {r.pid: r.cluster_id for r in out["clusters"].collect()} == {0: 0, 1: 0, 2: 2}


def test_stream(spark, tmp_path):
    schema = "pid long, sig array<long>"
    source = tmp_path / "in"
    for rows in ([(0, [1, 2, 3, 4]), (1, [1, 2, 9, 9])], [(2, [7, 7, 3, 4]), (3, [8, 8, 8, 8])]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        incremental_candidates(stream, 4, 2, 2, str(tmp_path / "bands"), str(tmp_path / "pairs"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.i, r.j) for r in spark.read.parquet(str(tmp_path / "pairs")).collect()} == {(0, 1), (0, 2)}
