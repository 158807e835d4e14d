"""Language-model scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

P(word | history) = P(class | history) P(word | class). A word's kind is the hash of
its last three bytes, so that words never seen have one; the end of a text is a kind
of its own. Kinds fall into classes by the company they keep: their counts beside
other kinds, over all training tokens, are clustered, so that a class holds words of
one language or trade. The class softmax has hashed features: the word before, the
word before that (skip), and the three classes before together. It is trained by
minibatch gradient steps in every task at once, in `rounds` passes over all training
tokens; after each pass the tasks' weights are averaged by how often a task saw each
feature. P(word | class) and the base score are add-one estimates over exact counts.

The rows of the feature table grow with the square root of the different training
words. Counts of frequent words (at most `frequent`, by a threshold on counts) and
the weights are broadcast; all other words meet their counts in a join, in which no
word is frequent.

Counts, classes and base scores do not depend on how rows lie in files and tasks.
Weights do, as each task takes steps in the order of its rows: another layout of
the same rows gives scores that differ by about a hundredth of a digit a token.

Defined results: a null or empty text is its end token alone; without training
rows every word is unknown; repeated rows count as often as they stand; rows with
null ids are trained on or held out as crc32 of the empty text says; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Texts, as_long, chunks, materialize, mix, seeds, summed_vectors

END = np.uint64(0x5DEECE66D1234567)


@dataclass(frozen=True)
class Params:
    """classes: all classes, the end's among them; kinds: hashed word endings; contexts: hashed neighbours that classes follow from. share, least_rows, most_rows: hashed features are `share` times the root of the number of words, within bounds of memory."""

    classes: int = 32
    kinds: int = 2048
    contexts: int = 128
    share: int = 8
    least_rows: int = 1 << 13
    most_rows: int = 1 << 17
    rounds: int = 2
    frequent: int = 1 << 17
    batch: int = 8192
    rate: float = 1.0
    damping: float = 8.0


@dataclass
class Model:
    """hashes (sorted) and counts of frequent words; the class of each kind; logs of class totals; weights."""

    hashes: np.ndarray
    counts: np.ndarray
    class_of: np.ndarray
    log_total: np.ndarray
    prior: np.ndarray
    weights: np.ndarray
    tokens: int
    types: int
    table: DataFrame


def _ending_kind(texts: Texts, starts: np.ndarray, ends: np.ndarray, p: Params) -> np.ndarray:
    """1 and up: the hash of a word's last three bytes, A-Z lower-cased."""
    code = np.zeros(len(ends), np.uint64)
    for k in (3, 2, 1):
        there = ends - starts >= k
        b = np.where(there, texts.data[np.maximum(ends - k, 0)] if len(ends) else 0, 0).astype(np.uint64)
        code = code * np.uint64(256) + b + np.uint64(32) * ((b >= 65) & (b <= 90)).astype(np.uint64)
    return 1 + (mix(code + np.uint64(77)) % np.uint64(p.kinds - 1)).astype(np.int64)


def _sequence(texts: Texts, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each document, their kinds (end: 0), tokens before each document."""
    starts, ends, before = texts.words()
    words, own = texts.hashes(starts, ends, lower=True), _ending_kind(texts, starts, ends, p)
    at = np.arange(len(words)) + np.repeat(np.arange(len(texts)), np.diff(before))
    n = len(words) + len(texts)
    tokens, kinds = np.full(n, END, np.uint64), np.zeros(n, np.int64)
    tokens[at], kinds[at] = words, own
    return tokens, kinds, before + np.arange(len(texts) + 1)


def _count(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    def row(held: list) -> pa.RecordBatch:
        tokens = np.concatenate([h[0] for h in held])
        values, first, times = np.unique(tokens, return_index=True, return_counts=True)
        kinds = np.concatenate([h[1] for h in held])[first]
        return pa.RecordBatch.from_arrays([pa.array(as_long(values)), pa.array(kinds.astype(np.int32)), pa.array(times.astype(np.int64))], names=["h", "kind", "c"])

    held, size = [], 0
    with np.errstate(over="ignore"):
        for batch in batches:
            for _, _, texts in chunks(batch.column(0)):
                held.append(_sequence(texts, p)[:2])
                size += len(held[-1][0])
                if size > 2_000_000:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)


def _lookup(tokens: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of frequent tokens, 0 for others."""
    if not len(hashes) or not len(tokens):
        return np.zeros(len(tokens), np.int64)
    values, back = np.unique(tokens, return_inverse=True)
    at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
    return np.where(hashes[at] == values, counts[at], 0)[back]


def _blocks(data: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of an array as 16 blocks for summed_vectors()."""
    step, part = len(data) // 16, TaskContext.get().partitionId()
    for b in range(16):
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part % 16], pa.int32()), pa.array([data[b * step : (b + 1) * step].astype(np.float64).tobytes()], pa.binary())], names=["block", "salt", "data"])


def _company(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """How often each kind stands within two words of each context, a hash of kinds."""
    total = np.zeros(p.kinds * p.contexts)
    with np.errstate(over="ignore"):
        context_of = (mix(np.arange(p.kinds, dtype=np.uint64) + np.uint64(5)) % np.uint64(p.contexts)).astype(np.int64)
        for batch in batches:
            for _, _, texts in chunks(batch.column(0)):
                _, kinds, before = _sequence(texts, p)
                owner = np.repeat(np.arange(len(texts)), np.diff(before))
                for k in (1, 2):
                    a, b = kinds[:-k], kinds[k:]
                    same = (owner[:-k] == owner[k:]) & (b > 0)
                    a, b = a[same], b[same]
                    for own, other in ((a, b), (b, a)):
                        total += np.bincount(own * p.contexts + context_of[other], minlength=len(total))
    if total.any():
        yield from _blocks(total.reshape(p.kinds, p.contexts))


def classes_of(company: np.ndarray, p: Params) -> np.ndarray:
    """The class of each kind: 0 for the end, else a cluster of its shares of contexts (square roots, weighted by counts), by fixed starts."""
    out = np.ones(p.kinds, np.int64)
    out[0] = 0
    weight = company.sum(axis=1)
    known = np.flatnonzero(weight[1:]) + 1
    if not len(known):
        return out
    every = company[known].sum(axis=0)
    shares = (company[known] + 8 * every / every.sum()) / (weight[known] + 8)[:, None]
    x, w = np.sqrt(shares), weight[known]
    centres = x[[int(w.argmax())]]
    apart = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(p.classes - 1, len(known)):
        centres = np.concatenate((centres, x[[int((apart * w).argmax())]]))
        apart = np.minimum(apart, ((x - centres[-1]) ** 2).sum(axis=1))
    for _ in range(30):
        own = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        for k in range(len(centres)):
            if (own == k).any():
                centres[k] = np.average(x[own == k], axis=0, weights=w[own == k])
    out[known] = 1 + own
    return out


def _features(tokens: np.ndarray, kinds: np.ndarray, before: np.ndarray, count: int) -> np.ndarray:
    """Three hashed features of each token, from the tokens before it in its document."""
    n = len(tokens)
    place = np.arange(n) - np.repeat(before[:-1], np.diff(before))
    salt = seeds(3, 41)

    def back(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, x.dtype)
        out[k:] = x[:-k] if n > k else x[:0]
        return np.where(place >= k, out, x.dtype.type(0))

    k64 = kinds.astype(np.uint64) + np.uint64(1)
    trio = back(k64, 1) * np.uint64(4096) + back(k64, 2) * np.uint64(64) + back(k64, 3)
    rows = np.uint64(count)
    return np.stack([(mix(x ^ s) % rows).astype(np.int64) for x, s in zip((back(tokens, 1), back(tokens, 2), trio), salt, strict=True)])


def _probabilities(w: np.ndarray, prior: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = w[f[0]]
    z += w[f[1]]
    z += w[f[2]]
    z += prior
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _train(batches: Iterator[pa.RecordBatch], p: Params, rows: int, class_of: np.ndarray, prior: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    w, seen = start.astype(np.float32), np.zeros(rows)
    with np.errstate(over="ignore"):
        for batch in batches:
            for _, _, texts in chunks(batch.column(0)):
                tokens, kinds, before = _sequence(texts, p)
                kinds = class_of[kinds]
                f = _features(tokens, kinds, before, rows)
                for lo in range(0, len(tokens), p.batch):
                    part, truth = f[:, lo : lo + p.batch], kinds[lo : lo + p.batch]
                    g = -_probabilities(w, prior, part)
                    g[np.arange(len(truth)), truth] += 1
                    for feature in part:
                        order = np.argsort(feature, kind="stable")
                        sorted_ = feature[order]
                        cut = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
                        own, times = sorted_[cut], np.diff(np.concatenate((cut, [len(order)])))
                        w[own] += (p.rate / (times + p.damping))[:, None].astype(np.float32) * np.add.reduceat(g[order], cut, axis=0)
                        seen[own] += times
    if seen.any():
        yield from _blocks(np.concatenate((w * seen[:, None], seen[:, None]), axis=1))


def fit(docs: DataFrame, text: Column, params: Params = Params()) -> Model:
    """Counts over, classes and weights from all rows of docs."""
    p = params
    texts = docs.select(F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    table = materialize(texts.mapInArrow(lambda it: _count(it, p), "h long, kind int, c long").groupBy("h").agg(F.sum("c").alias("c"), F.min("kind").alias("kind")), "counts")
    totals = {r.kind: (r.n, r.v) for r in table.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    tokens, types = sum(n for n, _ in totals.values()), sum(v for _, v in totals.values())
    # The least threshold, on a scale of counts, that at most `frequent` words reach.
    steps = sorted(((r.s, r.n) for r in table.groupBy(F.floor(F.log2("c") * 16).alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for s, n in steps:
        if held + n > p.frequent:
            break
        least, held = s, held + n
    often = [] if least is None else table.where(F.floor(F.log2("c") * 16) >= least).select("h", "c").collect()
    hashes = np.array([r.h for r in often], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], np.array([r.c for r in often], np.int64)[order]
    parts = summed_vectors(texts.mapInArrow(lambda it: _company(it, p), "block int, salt int, data binary"))
    company = np.concatenate([parts[b].reshape(-1, p.contexts) for b in range(16)]) if parts else np.zeros((p.kinds, p.contexts))
    class_of = classes_of(company, p)
    n, v = np.zeros(p.classes), np.zeros(p.classes)
    for kind, (a, b) in totals.items():
        n[class_of[kind]] += a
        v[class_of[kind]] += b
    # The end is the one word of its class.
    log_total = np.log10(n + v + 1)
    log_total[0] = np.log10(n[0] + 1)
    prior = np.log((n + 1) / (n + 1).sum()).astype(np.float32)
    rows = min(p.most_rows, max(p.least_rows, 1 << math.ceil(math.log2(p.share * math.sqrt(max(1, types))))))
    weights = np.zeros((rows, p.classes), np.float32)
    for _ in range(p.rounds):
        shared = docs.sparkSession.sparkContext.broadcast(weights)
        parts = summed_vectors(texts.mapInArrow(lambda it, shared=shared: _train(it, p, rows, class_of, prior, shared.value), "block int, salt int, data binary"))
        shared.unpersist()
        if parts:
            data = np.concatenate([parts[b].reshape(-1, p.classes + 1) for b in range(16)])
            weights = (data[:, :-1] / np.maximum(data[:, -1:], 1)).astype(np.float32)
    return Model(hashes, counts, class_of, log_total, prior, weights, int(tokens), int(types), table)


def _score(batches: Iterator[pa.RecordBatch], p: Params, m: tuple) -> Iterator[pa.RecordBatch]:
    hashes, counts, class_of, log_total, prior, weights = m
    row = TaskContext.get().partitionId() << 33
    with np.errstate(over="ignore"):
        for batch in batches:
            for at, to, texts in chunks(batch.column(2), CHUNK_BYTES):
                tokens, kinds, before = _sequence(texts, p)
                c, kinds = _lookup(tokens, hashes, counts), class_of[kinds]
                f = _features(tokens, kinds, before, len(weights))
                logs = np.empty(len(tokens))
                for lo in range(0, len(tokens), p.batch):
                    truth = kinds[lo : lo + p.batch]
                    z = _probabilities(weights, prior, f[:, lo : lo + p.batch])
                    logs[lo : lo + p.batch] = np.log10(np.maximum(z[np.arange(len(truth)), truth], 1e-30))
                logs -= log_total[kinds]
                owner = np.repeat(np.arange(to - at), np.diff(before))
                sums = [np.bincount(owner, weights=x, minlength=to - at) for x in (c > 0, np.log10(c + 1.0), logs)]
                rare = c == 0
                key = tokens[rare]
                order = np.lexsort((key, owner[rare]))
                key, who = key[order], owner[rare][order]
                first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])))) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate((first, [len(key)])))
                ends = np.concatenate(([0], np.cumsum(np.bincount(who[first], minlength=to - at)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (as_long(key[first]), times.astype(np.int32))]
                ids = np.arange(row, row + to - at)
                row += to - at
                arrays = [pa.array(ids), batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(np.diff(before)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), *lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "model", "rare", "times"])


def score(docs: DataFrame, model: Model, id_: Column, held_out: Column, text: Column, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    p, m = params, model
    shared = docs.sparkSession.sparkContext.broadcast((m.hashes, m.counts, m.class_of, m.log_total, m.prior, m.weights))
    rows = docs.select(id_.alias("doc_id"), held_out.alias("held_out"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, model double, rare array<long>, times array<int>"
    first = materialize(rows.mapInArrow(lambda it: _score(it, p, shared.value), schema), "scored")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    met = rare.join(m.table.select("h", "c"), "h")
    rest = met.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("extra"))
    both = first.drop("rare", "times").join(rest, "row", "left").fillna(0, ["more", "extra"])
    share = float(np.log10(m.tokens + m.types + 1.0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(m.tokens).cast("long").alias("train_tokens"), (F.col("logs") + F.col("extra") - F.col("n_tokens") * F.lit(share)).alias("base_score"), (F.col("model") + F.col("logs") + F.col("extra")).alias("score"))
