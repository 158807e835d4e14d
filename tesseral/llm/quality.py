"""Document quality: fixed rules, then hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Both sides are multinomials over hashed byte n-grams; every document adds to the
raw counts, the trusted ones (a bounded sample of labelled rows) also to the
target counts. A document's score is the mean log ratio over its n-grams; its tail
is the share of its n-grams, in a finer table, whose log ratio lies below
`tail_ratio`, set against what trusted text would hold of them by chance. kept is
score >= threshold and tail <= tail_share: deterministic, no sampling of documents.
The tail finds what the mean dilutes, a few words in a long fluent text that no
trusted text has.

Defined results: null and empty texts have zero words and fail the rules; texts
shorter than an n-gram score 0; without trusted rows every score is 0 and only
the rules decide; repeated rows count as often as they stand; an empty table
gives an empty result. Ids may have any type. Only the named columns are read.
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

from .common import CHUNK_BYTES, Texts, chunks, seeds, summed_vectors, windows


@dataclass(frozen=True)
class Params:
    """trusted: at most about so many labelled rows are used as the target sample. buckets: hashed n-grams; fine: of the tail's table, a multiple of buckets."""

    n: int = 4
    buckets: int = 1 << 14
    trusted: int = 20_000
    threshold: float = -0.4
    fine: int = 1 << 18
    tail_ratio: float = -2.0
    tail_share: float = 0.008
    smoothing: float = 1.0
    least_words: int = 20
    most_repeat: int = 30
    repeat: int = 8


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def rule_counts(texts: Texts, p: Params = Params()) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    data, n = texts.data, len(texts)
    starts, ends, before = texts.words()

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[texts.offsets[1:]] - total[texts.offsets[:-1]]

    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    chars = per_doc(~space & ((data & 0xC0) != 0x80))
    symbols = per_doc(_SYMBOLS[data])
    words = texts.hashes(starts, ends, lower=False)
    grams, first, counts = windows(words, before, p.repeat, 9)
    repeats = np.zeros(n, np.int64)
    runs = np.diff(counts)
    if len(grams):
        owner = np.repeat(np.arange(n, dtype=np.uint64), runs)
        with np.errstate(over="ignore"):
            _, back, times = np.unique(grams ^ (owner * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        cover = np.zeros(len(words) + 1, np.int64)
        twice = first[times[back] > 1]
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + p.repeat, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
        repeats = covered[before[1:]] - covered[before[:-1]]
    # Lines: cut at \n and at the ends of documents.
    is_cut = np.zeros(len(data) + 1, bool)
    is_cut[texts.offsets] = True
    newline = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate((texts.offsets[:-1][np.diff(texts.offsets) > 0], newline + 1)))
    line_starts = line_starts[line_starts < len(data)]
    dup = np.zeros(n, np.int64)
    if len(line_starts):
        stops = np.concatenate((line_starts[1:], [len(data)]))
        # A line ends before its newline; one that ends a document has none.
        stops = np.where(data[stops - 1] == 10, stops - 1, stops)
        stops = np.maximum(stops, line_starts)
        place = np.searchsorted(starts, line_starts)
        has_word = (place < len(starts)) & (starts[np.minimum(place, max(0, len(starts) - 1))] < stops) if len(starts) else np.zeros(len(line_starts), bool)
        line_starts, stops = line_starts[has_word], stops[has_word]
        owner = np.searchsorted(texts.offsets, line_starts, side="right") - 1
        with np.errstate(over="ignore"):
            keys = texts.hashes(line_starts, stops, lower=False) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at = np.unique(keys, return_index=True)
        once = np.zeros(len(keys), bool)
        once[at] = True
        dup = np.bincount(owner[~once], minlength=n)
    return {"n_words": np.diff(before), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeats}


def _buckets(texts: Texts, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Fine bucket of each byte n-gram of one document, and n-grams before each document; the bucket is that modulo p.buckets."""
    d = texts.data.astype(np.uint32)
    m = max(0, len(d) - p.n + 1)
    code = np.zeros(m, np.uint32)
    for j, mult in enumerate((seeds(p.n, 21) | np.uint64(1)).astype(np.uint32)):
        code += d[j : j + m] * mult
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    bucket = ((code >> np.uint32(8)) % np.uint32(p.fine)).astype(np.int64)
    sizes = np.maximum(np.diff(texts.offsets) - p.n + 1, 0)
    counts = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(counts[-1]) + np.repeat(texts.offsets[:-1] - counts[:-1], sizes)
    return bucket[at], counts


def _count(batches: Iterator[pa.RecordBatch], p: Params, trusted: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, p.fine))
    with np.errstate(over="ignore"):
        for batch in batches:
            good = np.isin(batch.column(0).to_numpy(), trusted)
            for at, to, texts in chunks(batch.column(1)):
                bucket, counts = _buckets(texts, p)
                total[0] += np.bincount(bucket, minlength=p.fine)
                own = np.repeat(good[at:to], np.diff(counts))
                total[1] += np.bincount(bucket[own], minlength=p.fine)
    part = TaskContext.get().partitionId()
    step = p.fine // 8
    for b in range(8):
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part % 16], pa.int32()), pa.array([total[:, b * step : (b + 1) * step].tobytes()], pa.binary())], names=["block", "salt", "data"])


def _hashed(id_col: str) -> Column:
    """A hash of the id as text, 0 for null, so that ids may have any type."""
    return F.coalesce(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(0)) * F.col(f"`{id_col}`").isNotNull().cast("long")


def trusted_ids(labels: DataFrame, id_col: str, p: Params) -> np.ndarray:
    """Hashed ids of about p.trusted rows with quality 1 and not toxic at most: all, or those whose hash lies below a share."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").where(F.col(f"`{id_col}`").isNotNull()).select(_hashed(id_col).alias("id")).distinct()
    share = p.trusted / max(1, good.count())
    if share < 1:
        good = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return np.array(sorted(r.id for r in good.collect()), np.int64)


def fit(docs: DataFrame, trusted: np.ndarray, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of target to raw share for each bucket, and which fine buckets trusted text lacks: two vectors of fixed size."""
    p = params
    none = np.zeros(p.buckets, np.float32), np.zeros(p.fine, bool)
    if not len(trusted):
        return none
    rows = docs.select(_hashed(id_col), F.col(text_col).cast("string"))
    parts = summed_vectors(rows.mapInArrow(lambda it: _count(it, p, trusted), "block int, salt int, data binary"))
    if not parts:
        return none
    raw, good = np.concatenate([parts[b].reshape(2, -1) for b in range(8)], axis=1)
    if not good.sum():
        return none
    # What trusted text would hold of a bucket if it were like the corpus; one more than it does hold is still far less.
    expected = good.sum() * raw / raw.sum()
    rare = good + 1 < math.exp(p.tail_ratio) * expected
    share = lambda x: (x + p.smoothing) / (x.sum() + p.smoothing * p.buckets)
    raw, good = (x.reshape(-1, p.buckets).sum(axis=0) for x in (raw, good))
    return np.log(share(good) / share(raw)).astype(np.float32), rare


def _score(batches: Iterator[pa.RecordBatch], p: Params, model: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ratio, rare = model
    with np.errstate(over="ignore"):
        for batch in batches:
            for at, to, texts in chunks(batch.column(1), CHUNK_BYTES // 2):
                rules = rule_counts(texts, p)
                bucket, counts = _buckets(texts, p)
                size = np.diff(counts)
                # Each text is summed by itself and rounded before it is compared, so that its neighbours decide nothing.
                some = size > 0
                score, tail = np.zeros(len(texts)), np.zeros(len(texts))
                if len(bucket):
                    score[some] = np.add.reduceat(ratio[bucket % p.buckets].astype(np.float64), counts[:-1][some])
                    tail[some] = np.add.reduceat(rare[bucket].astype(np.int64), counts[:-1][some])
                score, tail = (np.round(x / np.maximum(size, 1), 6) for x in (score, tail))
                n, rep = rules["n_words"], rules["n_repeat_words"]
                failed = (n < p.least_words) | (100 * rep > p.most_repeat * n)
                kept = ~failed & (score >= p.threshold) & (tail <= p.tail_share)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *[pa.array(rules[c].astype(np.int64)) for c in names], pa.array(failed), pa.array(kept), pa.array(score), pa.array(tail)], names=["doc_id", *names, "base_failed", "kept", "score", "tail"])


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double, tail double"


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """doc_id, rule counts, base_failed, kept, score, tail of every row."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(lambda it: _score(it, params, model), f"doc_id {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def _filter(batches: Iterator[pa.RecordBatch], p: Params, model: tuple[np.ndarray, np.ndarray], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(at)
        judged = list(_score(iter([pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text], names=["i", "t"])]), p, model)) if len(text) else []
        if judged:
            yield batch.filter(pa.concat_arrays([x.column(7) for x in judged]))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", params: Params = Params()) -> DataFrame:
    """The rows of docs that are kept, with all their columns, in one pass and without a join."""
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _filter(it, params, model, at), docs.schema)
