"""Toxicity by multiple-instance learning: only documents have labels, sentences get the scores.

A sentence's chance is a logistic function of the words and word beginnings in it; a document is toxic unless none of
its sentences is (noisy-or). Training follows the gradient of the document's log loss through the noisy-or, on a bounded
sample of labelled documents; scoring is one pass without a shuffle over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import wordhash as H
from .util import as_bytes, chunks, discard, release, stored

TRAINING_ROWS, TRAINING_BYTES = 5000, 64 << 20  # labelled documents that training takes at most, in the order of a hash of their ids
MOST_FEATURES = 50_000  # weights that a model keeps at most, the largest ones
LEAST_EVIDENCE = 12.0  # log-likelihood ratio that a feature needs to be used
OFTEN = 50  # documents from which a feature counts as frequent in training
BEGINNINGS = (3, 4, 5, 6, 7, 8)  # bytes of a word's beginning that count as a feature besides the whole word
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?\n"]] = True
LOWER_CODES = H.CODES[H.LOWER]
BLOOM_BITS = 22


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each sentence begins, and the text it belongs to. A text has one sentence at least, an empty one if need be;
    a sentence ends behind . ! ? or a line feed."""
    ends = np.flatnonzero(STOPS[data]) + 1
    inside = ends[ends < len(data)]
    starts = np.unique(np.concatenate([offsets[:-1][offsets[1:] > offsets[:-1]], inside]))
    texts = np.searchsorted(offsets, starts, side="right") - 1
    empty = np.flatnonzero(offsets[1:] == offsets[:-1])
    starts, texts = np.concatenate([starts, offsets[empty]]), np.concatenate([texts, empty])
    order = np.lexsort((starts, texts))
    return starts[order], texts[order]


def features(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays: the sentence, and the feature's hash. Empty sentences have none."""
    sums = H.running(data, LOWER_CODES)
    first, last, _ = H.words(data, offsets, H.NOT_WORD)
    full = np.flatnonzero(offsets[texts + 1] > offsets[texts])
    sentence = full[np.searchsorted(starts[full], first, side="right") - 1] if len(full) else first
    yield sentence, H.spans(sums, first, last)
    for k in BEGINNINGS:
        long = last - first > k
        yield sentence[long], H.spans(sums, first[long], first[long] + k) + np.uint64(k)


@dataclass
class Model:
    names: np.ndarray  # sorted hashes of features
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.bloom = np.zeros(1 << BLOOM_BITS, bool)
        self.bloom[self.names & np.uint64((1 << BLOOM_BITS) - 1)] = True

    def sums(self, data, offsets, starts, texts) -> np.ndarray:
        z = np.full(len(starts), self.bias)
        for sentence, names in features(data, offsets, starts, texts):
            if not len(self.names):
                break
            may = np.flatnonzero(self.bloom[names & np.uint64((1 << BLOOM_BITS) - 1)])
            at = np.minimum(np.searchsorted(self.names, names[may]), len(self.names) - 1)
            known = self.names[at] == names[may]
            pairs = np.unique(np.stack([sentence[may[known]], at[known]], 1), axis=0) if known.any() else np.zeros((0, 2), np.int64)
            z += np.bincount(pairs[:, 0], self.weights[pairs[:, 1]], len(z))
        return z

    def score(self, data, offsets):
        """For each text: its score, its number of sentences, and the worst sentence's number, start, end and chance."""
        n = len(offsets) - 1
        starts, texts = sentences(data, offsets)
        z = np.clip(self.sums(data, offsets, starts, texts), -30, 30)
        chance = 1 / (1 + np.exp(-z))
        begin = np.searchsorted(texts, np.arange(n))
        score = -np.expm1(np.add.reduceat(-np.logaddexp(0, z), begin)) if n else np.zeros(0)
        count = np.diff(np.concatenate([begin, [len(texts)]]))
        worst = np.lexsort((starts, -chance, texts))[begin] if n else begin
        ends = np.concatenate([starts[1:], [len(data)]]) if n else starts
        end = np.minimum(np.where(worst + 1 < begin + count, ends[worst], offsets[1:]), offsets[1:])
        return score, count, worst - begin, starts[worst] - offsets[:-1], end - offsets[:-1], chance[worst]


def evidence(having: np.ndarray, toxic_having: np.ndarray, n: int, toxic: float) -> np.ndarray:
    """Log-likelihood ratio of each feature and the label, over documents."""

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    other, clean = n - having, n - toxic
    return 2 * (part(toxic_having, having * toxic / n) + part(having - toxic_having, having * clean / n) + part(toxic - toxic_having, other * toxic / n) + part(clean - having + toxic_having, other * clean / n))


def train(texts: pa.Array, labels: np.ndarray, rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> Model:
    """Adagrad over the whole sample. Features with little evidence for or against the label are left out: of so many
    rare ones, some follow the labels by chance."""
    data, offsets = as_bytes(texts)
    y = np.asarray(labels, float)
    if not len(y):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0)

    def pieces():
        for a, b in chunks(offsets):
            piece, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, of = sentences(piece, own)
            yield starts, of + a, features(piece, own, starts, of)

    # counts by the hash's low bits, never below a feature's own, rule out what can't have the evidence; so memory stays small
    having, toxic_having = np.zeros((2, 1 << BLOOM_BITS), np.int32)
    low = np.uint64((1 << BLOOM_BITS) - 1)
    for _, of, found in pieces():
        for sentence, names in found:
            pairs = np.unique((of[sentence] << BLOOM_BITS) | (names & low).astype(np.int64))
            bucket = pairs & ((1 << BLOOM_BITS) - 1)
            np.add.at(having, bucket, 1)
            np.add.at(toxic_having, bucket[y[pairs >> BLOOM_BITS] > 0], 1)
    n, toxic = len(y), y.sum()
    alone = np.arange(n + 1.0)
    enough = lambda seen: int(np.argmax(np.append(seen >= LEAST_EVIDENCE, True)))
    least_toxic, least_clean = enough(evidence(alone, np.minimum(alone, toxic), n, toxic)), enough(evidence(alone, np.maximum(alone - (n - toxic), 0), n, toxic))
    possible = (toxic_having >= max(1, least_toxic)) | (having >= max(1, least_clean))
    often = having >= OFTEN  # features of such buckets are counted one by one
    exact = np.zeros(0, np.uint64), np.zeros((0, 2))
    for _, of, found in pieces():
        for sentence, names in found:
            at = np.flatnonzero(often[names & low])
            order = at[np.lexsort((of[sentence[at]], names[at]))]
            mine, docs = names[order], of[sentence[order]]
            new = np.ones(len(mine), bool)
            new[1:] = (mine[1:] != mine[:-1]) | (docs[1:] != docs[:-1])
            mine, docs = mine[new], docs[new]
            every, group = np.unique(np.concatenate([exact[0], mine]), return_inverse=True)
            seen = np.concatenate([exact[1], np.stack([np.ones(len(mine)), y[docs]], 1)])
            exact = every, np.stack([np.bincount(group, c, len(every)) for c in seen.T], 1)
    frequent = exact[0][evidence(exact[1][:, 0], exact[1][:, 1], n, toxic) >= LEAST_EVIDENCE]
    parts, base, owner = [], 0, []
    for starts, of, found in pieces():
        for sentence, names in found:
            may = np.flatnonzero(possible[names & low])
            one = often[names[may] & low]
            may = may[~one | np.isin(names[may], frequent)]
            parts.append((names[may], (sentence[may] + base).astype(np.int32)))
        base += len(starts)
        owner.append(of)
    owner = np.concatenate(owner)
    names, sentence = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((sentence, names))
    names, sentence = names[order], sentence[order]
    keep = np.ones(len(names), bool)
    keep[1:] = (names[1:] != names[:-1]) | (sentence[1:] != sentence[:-1])
    names, sentence = names[keep], sentence[keep]
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    new_doc = new.copy()
    new_doc[1:] |= owner[sentence[1:]] != owner[sentence[:-1]]
    group = np.cumsum(new) - 1
    often = evidence(np.bincount(group, new_doc), np.bincount(group, new_doc * y[owner[sentence]]), len(y), y.sum()) >= LEAST_EVIDENCE
    kept = often[group]
    vocabulary, group, sentence = names[new][often], (np.cumsum(often) - 1)[group[kept]], sentence[kept]

    begin = np.searchsorted(owner, np.arange(len(y)))
    prior = np.clip(y.mean(), 1e-3, 0.5)
    bias, w = float(np.log(prior / max(1.0, len(owner) / len(y)))), np.zeros(len(vocabulary))
    seen_w, seen_b = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.clip(bias + np.bincount(sentence, w[group], len(owner)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_none = np.add.reduceat(-np.logaddexp(0, z), begin)
        none = np.exp(log_none)
        pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)  # d loss / d z, by its chance
        g = pull[owner] * p / len(y)
        gw, gb = np.bincount(group, g[sentence], len(w)) + l2 * w / len(y), g.sum()
        seen_w += gw * gw
        seen_b += gb * gb
        w -= rate * gw / np.sqrt(seen_w)
        bias -= 0.1 * gb / np.sqrt(seen_b)
    top = np.sort(np.argsort(-np.abs(w))[:MOST_FEATURES])
    return Model(vocabulary[top], w[top], bias)


def held_out(doc_id: Column, fold: int, of: int) -> Column:
    """Whether crc32 of the id's text leaves fold when divided by of; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)) == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", rows: int = TRAINING_ROWS, size: int = TRAINING_BYTES) -> Model:
    """Model from labelled documents that are not held out (crc32 mod 5 is 0): whole texts in the order of a hash of the id, at most rows,
    and of those at most size bytes. Null labels and ids don't count; of labels that repeat an id, the largest counts, of texts that
    do, the first in order. Without labels, the model gives every text a low score."""
    ids = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id"), 0, 5))
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    took = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    took = stored(took.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")), "toxicity-training")
    sizes = took.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).toPandas().sort_values(["h", "doc_id"])
    small = F.broadcast(docs.sparkSession.createDataFrame([(int(i),) for i in sizes["doc_id"][sizes["n"].cumsum() <= size]], "small_id long"))
    got = took.join(small, F.col("doc_id") == F.col("small_id"), "left_semi").toArrow().sort_by("doc_id")
    discard(took)
    return train(got["text"].combine_chunks() if got.num_rows else pa.array([], pa.string()), (got["y"].to_numpy() > 0).astype(float))


ARROW = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}
FIELDS = "score double, predicted int, n_sentences long, worst_sentence long, worst_start long, worst_end long, worst_score double"


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs with score (0 to 1), predicted (1 from 0.5), and the sentence most likely to offend: its
    number from 0, its first byte and the byte behind it, and its own score. Null and empty texts are one empty sentence
    that gets the bias alone. Columns of docs with clashing names do no harm unless they are in keep."""
    out = docs.sparkSession.sparkContext.broadcast(model)
    own_text = text if text in keep else "__text"
    mine = docs.select(*keep, *([] if text in keep else [F.col(text).alias(own_text)]))
    fields = StructType.fromDDL(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(own_text))
            for a, b in chunks(offsets, 1 << 18):
                s, *rest = out.value.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = [s, (s >= 0.5).astype(np.int32), *rest]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array(c, ARROW[f.dataType.simpleString()]) for c, f in zip(columns, fields, strict=True))], names=[*keep, *fields.names])
            del batch, data
            release()

    return mine.mapInArrow(run, StructType([*(f for f in mine.schema if f.name in keep), *fields]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """fit, then score, for each row of docs: doc_id, held_out and what score gives."""
    return score(docs, fit(docs, labels)).withColumn("held_out", held_out(F.col("doc_id"), 0, 5))
