"""Near-duplicates by ProbMinHash on weighted word shingles, banding and exact verification.

Each shingle's arrivals are a Poisson process whose rate is its weight (its count in the text); each arrival hits a random
register, and a register keeps the shingle that hits it first. Two texts agree in a register with the chance of their
probability Jaccard similarity. A text's processes stop once no later arrival can come first anywhere.

Identical texts are one class before anything else. Texts that share a band are compared with the first of their bucket, at
first only with the least of these, and with the others where that has linked them to something else.
Larger buckets then join into groups, by the members they have in common. What is linked to a group's largest component
is done; the others are compared with the whole group, in blocks: first by registers, then in full those that registers
leave possible and that aren't linked yet. Members of small buckets outside of groups are compared pair by pair. So no
bucket, however large, is expanded into all its pairs, and none is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as H
from .util import as_bytes, binary_rows, by_key, chunks, discard, release, small, stored

SHINGLE_WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6  # a pair at 0.8 meets in some band with chance 0.99994
SMALL_BUCKET = 6  # buckets of more members are compared in blocks
BLOCK_ROWS = 256
DEAL = 4096  # pairs of one text that meet in a task
LEAST_AGREEMENT = 0.66  # of registers; at 0.8 as many agree but for one pair in a million
_PLACES = H.CODES[:64]


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of k words of each text: text, hash, count; ordered by text, then hash. A text of fewer words has
    all of them as its one shingle; one without words has none. Words are separated by ASCII white space."""
    first, last, begin = H.words(data, offsets)
    names = H.spans(H.running(data), first, last)
    n = np.diff(begin)
    out = np.zeros(len(names), np.uint64)
    for i in range(k):
        out[: len(names) - i] += H.mixed(names[i:] * _PLACES[i] + np.uint64(i + 1))
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(names)) - begin[:-1][text]
    full = place <= n[text] - k
    for t in np.flatnonzero((n > 0) & (n < k)):
        s = slice(begin[t], begin[t + 1])
        out[begin[t]] = sum((H.mixed(names[s] * _PLACES[: n[t]] + np.arange(1, n[t] + 1).astype(np.uint64))).tolist()) % 2**64
        full[begin[t]] = True
    text, out = text[full], H.mixed(out[full])
    order = np.lexsort((out, text))
    text, out = text[order], out[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (out[1:] != out[:-1])
    at = np.flatnonzero(new)
    return text[at], out[at], np.diff(np.append(at, len(text)))


def prob_minhash(text: np.ndarray, names: np.ndarray, weights: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n x m registers, each the hash of the element that came first; 0 for texts without elements."""
    best, element = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    time, at, turn = np.zeros(len(text)), np.arange(len(text)), 0
    while len(at):
        turn += 1
        draw = H.mixed(names[at] + np.uint64(turn * int(H.BASE) % 2**64))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weights[at]
        register = text[at] * m + (H.mixed(draw ^ H.BASE) % np.uint64(m)).astype(np.int64)
        earlier = np.flatnonzero(time < best[register])
        earlier = earlier[np.argsort(-time[earlier], kind="stable")]  # of several, the last written is the earliest
        best[register[earlier]] = time[earlier]
        element[register[earlier]] = names[at[earlier]]
        limit = best.reshape(n, m).max(1)
        on = time < limit[text[at]]
        at, time = at[on], time[on]
    return element.reshape(n, m)


def band_keys(registers: np.ndarray) -> np.ndarray:
    n = len(registers)
    parts = registers.reshape(n, BANDS, ROWS)
    key = np.full((n, BANDS), 0, np.uint64) + np.arange(1, BANDS + 1).astype(np.uint64)
    for i in range(ROWS):
        key = H.mixed(key * H.BASE + parts[:, :, i])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets, each as sorted hashes and weights: the sum, over common elements d, of
    1 / sum of max(a'/a, b'/b) over all elements. Elements with the same b/a share that inner sum. Two empty sets: 0."""
    (x, v), (y, w) = a, b
    if not len(x) or not len(y):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    common_a, common_b = v[i].astype(float), w[j].astype(float)
    only_a, only_b = v.sum() - common_a.sum(), w.sum() - common_b.sum()
    ratio, group = np.unique(common_b / common_a, return_inverse=True)
    share = np.bincount(group, common_a)
    return float(sum(s / (np.maximum(common_a, common_b / r).sum() + only_a + only_b / r) for r, s in zip(ratio, share, strict=True)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        for a, b in chunks(offsets, 1 << 18):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            text, names, counts = shingles(part, own)
            keys = band_keys(prob_minhash(text, names, counts, b - a))
            some = np.bincount(text, minlength=b - a) > 0
            raw = part.tobytes()
            digest = [hashlib.sha256(raw[s:e]).digest()[:16] for s, e in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(keys[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(digest, pa.binary()), lists], names=["doc_id", "digest", "bands"])
        release()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        for a, b in chunks(offsets, 1 << 18):
            text, names, counts = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ends = np.cumsum(np.bincount(text, minlength=b - a))
            low = prob_minhash(text, names, counts, b - a).astype(np.uint32)
            registers = binary_rows(low.ravel(), np.arange(1, b - a + 1) * low.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), binary_rows(names, ends), binary_rows(counts.astype(np.uint32), ends), registers], names=["doc_id", "names", "counts", "registers"])
        release()


def _compare_blocks(threshold: float):
    """Links between the two blocks of a pair (or within one) that join what isn't linked: pairs in the order of agreeing
    registers, each compared in full unless others have linked its two texts already."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("second", "ascending"), ("doc_id", "ascending")])
        ids, labels = table["doc_id"].to_numpy(), table["label"].to_numpy()
        second = np.asarray(table["second"].to_pylist(), bool)
        m = np.stack([np.frombuffer(x.as_py(), np.uint32) for x in table["registers"]])
        names, counts = table["names"].to_pylist(), table["counts"].to_pylist()
        sets: dict = {}

        def of(i):
            if i not in sets:
                sets[i] = np.frombuffer(names[i], np.uint64), np.frombuffer(counts[i], np.uint32)
            return sets[i]

        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        within = not len(right)
        right = left if within else right
        pairs = []
        for i in left:
            agree = (m[right] == m[i]).mean(1)
            ok = (agree >= LEAST_AGREEMENT) & (labels[right] != labels[i]) & (right > i if within else True)
            pairs += [(-a, i, j) for a, j in zip(agree[ok].tolist(), right[ok].tolist(), strict=True)]
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        a, b, sim = [], [], []
        for _, i, j in sorted(pairs):
            x, y = find(labels[i]), find(labels[j])
            if x != y and (got := similarity(of(i), of(j))) >= threshold:
                root[x] = y
                a.append(min(ids[i], ids[j]))
                b.append(max(ids[i], ids[j]))
                sim.append(got)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(sim, pa.float64())})

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sets(batch, side, i):
        return np.frombuffer(batch.column(f"names_{side}")[i].as_buffer(), np.uint64), np.frombuffer(batch.column(f"counts_{side}")[i].as_buffer(), np.uint32)

    for batch in batches:
        sim = [similarity(sets(batch, "a", i), sets(batch, "b", i)) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])
        release()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with their similarity. A text that is a of very many pairs, a hub, meets them in several tasks, DEAL at a time."""
    pairs = stored(pairs.select("a", "b"), "near-candidates")
    counts = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("deals")), "near-deals")
    dealt = by_key(pairs, counts, "a").withColumn("deal", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int")).drop("deals")
    side = lambda s: sets.select(F.col("doc_id").alias(s), F.col("names").alias(f"names_{s}"), F.col("counts").alias(f"counts_{s}"))
    copies = side("a").join(small(counts), "a").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    both = dealt.join(copies, ["a", "deal"]).join(side("b"), "b").select("a", "b", "names_a", "counts_a", "names_b", "counts_b")
    out = stored(both.mapInArrow(_compare, "a long, b long, similarity double"), "near-pairs")
    discard(pairs, counts)
    return out


def components(links: DataFrame) -> DataFrame:
    """doc_id, label for the ends of links (a, b): the least id that can be reached. Labels spread to neighbours, then to
    where their own label points, until nothing changes; each round is a stored table, and goes once the next is there."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-edges")
    labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "doc_id"), "near-labels")
    while True:
        heard = by_key(edges, labels.select(F.col("doc_id").alias("b"), F.col("label").alias("other"), "degree"), "b", n="degree").groupBy("a").agg(F.min("other").alias("other"))
        nearer = labels.join(heard.withColumnRenamed("a", "doc_id"), "doc_id").select("doc_id", F.least("label", "other").alias("label"), F.col("label").alias("was"), "degree")
        nearer = stored(nearer, "near-labels")
        up = nearer.select(F.col("doc_id").alias("label"), F.col("label").alias("root"))
        new = stored(by_key(nearer, up, "label").select("doc_id", F.least("label", F.coalesce("root", "label")).alias("label"), "was", "degree"), "near-labels")
        discard(labels, nearer)
        labels = new
        if new.where("label <> was").limit(1).count() == 0:
            discard(edges)
            return labels.select("doc_id", "label")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, copy_of (smallest id with the same text), class_id (smallest id of all that are
    linked, by copies or by a similarity of threshold or more, directly or through others), n_links (links that were verified
    for the text of copy_of; links inside a class that is connected without them need no verification), kept (doc_id is class_id).

    Null counts as an empty text; texts without words are linked to exact copies only. A null id: the row stands alone, with
    null copy_of and class_id, and is kept. Rows that repeat an id share its class; if their texts differ, they link what their texts are
    linked to. Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = stored(rows.mapInArrow(_sign, "doc_id long, digest binary, bands array<long>"), "near-signed")
    first = stored(signed.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-copies")
    copy_of = F.when(F.col("doc_id").isNotNull(), F.coalesce("copy_of", "doc_id")).alias("copy_of")
    member = stored(by_key(signed, first, "digest", n="n").select("doc_id", copy_of, "bands"), "near-members")
    discard(signed, first)
    keys = member.where("doc_id = copy_of").select("doc_id", "bands").distinct().select("doc_id", F.explode(F.array_distinct("bands")).alias("key"))
    hubs = stored(keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-hubs")
    buckets = stored(by_key(keys, hubs, "key", "inner", n="n"), "near-buckets")

    involved = stored(buckets.select("doc_id").distinct(), "near-involved")
    own = rows.where("doc_id is not null").join(small(involved), "doc_id").join(small(stored(member.where("doc_id <> copy_of").select("doc_id").distinct(), "near-others")), "doc_id", "left_anti")
    sets = stored(own.dropDuplicates(["doc_id"]).mapInArrow(_sets, "doc_id long, names binary, counts binary, registers binary"), "near-sets")

    # each text first meets the least hub of its buckets, then only those hubs that this hasn't linked it to
    linked = buckets.where("doc_id <> hub").groupBy(F.col("doc_id").alias("b")).agg(F.min("hub").alias("a"))
    tested = _verified(linked, sets)
    labels = small(stored(components(tested.where(F.col("similarity") >= threshold)), "near-linked"))
    named = stored(buckets.select("key", "doc_id").join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label")), "near-named")
    hubs = named.groupBy("key").agg(F.min(F.struct("doc_id", "label")).alias("hub"), F.max("label").alias("high"), F.min("label").alias("low"), F.count(F.lit(1)).alias("n")).where("high <> low").select("key", "hub", "n")
    more = by_key(named, stored(hubs, "near-open"), "key", "inner", n="n").where("label <> hub.label").select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    tested = stored(tested.unionByName(_verified(more, sets)), "near-tested")
    links = tested.where(F.col("similarity") >= threshold)

    # groups of large buckets, in blocks
    groups = components(buckets.where((F.col("n") > SMALL_BUCKET) & (F.col("doc_id") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()).withColumnRenamed("label", "grp")
    placed = stored(groups.join(components(links), "doc_id", "left").select("doc_id", "grp", F.coalesce("label", "doc_id").alias("label")), "near-placed")
    sizes = placed.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    x = by_key(placed, stored(main, "near-main"), "grp", "inner", n="n_all").withColumn("inside", F.col("label") == F.col("main"))
    x = x.withColumn("outer_blocks", blocks(F.col("n_all") - F.col("n_main"))).withColumn("inner_blocks", blocks(F.col("n_main")))
    x = x.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("inside"), F.col("inner_blocks")).otherwise(F.col("outer_blocks"))).cast("int"))
    # a text outside meets its own block, the other outer ones, and the inner ones, whose numbers follow; one inside meets the outer ones
    x = x.withColumn("block", F.when(F.col("inside"), F.col("block") + F.col("outer_blocks")).otherwise(F.col("block")))
    meets = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("outer_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer_blocks") + F.col("inner_blocks") - 1))
    x = x.select("doc_id", "grp", "label", "block", F.explode(meets).alias("other"))
    x = x.select("doc_id", "label", "grp", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), (F.col("block") > F.col("other")).alias("second"))
    x = x.join(sets, "doc_id").groupBy("grp", "one", "two")
    links = stored(links.unionByName(x.applyInArrow(_compare_blocks(threshold), "a long, b long, similarity double")).dropDuplicates(["a", "b"]), "near-links")

    # small buckets, unless a group holds all their members
    labels = components(links).join(groups, "doc_id", "full")
    near = buckets.where(F.col("n") <= SMALL_BUCKET).join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"), "grp")
    open_ = near.groupBy("key").agg((F.max("label") > F.min("label")).alias("apart"), (F.coalesce(F.max("grp") > F.min("grp"), F.lit(True)) | (F.count("grp") < F.count(F.lit(1)))).alias("mixed")).where("apart and mixed").select("key")
    near = stored(near.join(open_, "key"), "near-small")
    left, right = near.select("key", F.col("doc_id").alias("a"), F.col("label").alias("la")), near.select("key", F.col("doc_id").alias("b"), F.col("label").alias("lb"))
    pairs = left.join(right, "key").where("a < b and la <> lb").select("a", "b").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    links = stored(links.unionByName(_verified(pairs, sets).where(F.col("similarity") >= threshold)), "near-links")

    labels = components(links).select(F.col("doc_id").alias("copy_of"), "label")
    degree = links.select(F.explode(F.array("a", "b")).alias("copy_of")).groupBy("copy_of").agg(F.count(F.lit(1)).alias("n_links"))
    classes = stored(labels.join(degree, "copy_of", "left"), "near-classes")
    discard(buckets, involved, sets, named, tested, placed, near)
    out = member.select("doc_id", "copy_of").join(small(classes), "copy_of", "left")
    class_id = F.coalesce("label", "copy_of")
    return out.select("doc_id", "copy_of", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(class_id)).alias("kept"))
