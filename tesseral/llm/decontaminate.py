"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all training windows.

Words are runs without ASCII characters other than letters and digits, A-Z
lower-cased. A window is `size` consecutive words of an item; an item with fewer
words is one window. Hash hits are verified on the words themselves.

The set is broadcast in slices of at most `slice` windows, whatever the size of
the benchmark; each slice is one more scan of the documents, from which only the
rows that are hit come back, as a row number with places and items.

Defined results: null and empty texts have no words and no hits; items without
words (or id) have no windows; equal items hit together; repeated rows are judged
each by itself; empty tables give empty results or no hits. Ids of documents may
have any type, those of items are integers. Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Texts, chunks, materialize, mix, seeds

BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_BITS = 20


@dataclass(frozen=True)
class Params:
    """size: words of a window; contaminated from so many items; slice: windows broadcast at once."""

    size: int = 8
    items: int = 2
    slice: int = 1_000_000


def _normal(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(texts.data[s:e].tobytes().lower() for s, e in zip(starts, ends, strict=True))


def _sums(words: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    per = np.maximum(np.diff(before) - (n - 1), 0)
    counts = np.concatenate(([0], np.cumsum(per)))
    first = np.arange(counts[-1]) + np.repeat(before[:-1] - counts[:-1], per)
    total = np.full(len(first), n, np.uint64)
    for j, m in enumerate(seeds(n, 31) | np.uint64(1)):
        total += words[first + j] * m
    return mix(total), first


def _window_rows(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = set()
            for at, to, texts in chunks(batch.column(1)):
                starts, ends, before = texts.words(BREAKS)
                for i in range(at, to):
                    lo, hi = before[i - at], before[i - at + 1]
                    n = min(p.size, hi - lo)
                    if n and ids[i] is not None:
                        rows |= {(int(n), _normal(texts, starts[k : k + n], ends[k : k + n]), ids[i]) for k in range(lo, hi - n + 1)}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in sorted(rows)], kind) for k, kind in ((0, pa.int32()), (1, pa.binary()), (2, pa.int64()))], names=["n", "words", "item"])


class HashSet:
    """Windows by length: sorted hashes, a bit table that lets few others pass, and the words with their items."""

    def __init__(self, rows: list[tuple[int, bytes, list[int]]], size: int):
        self.size = size
        self.by: dict[int, tuple[np.ndarray, np.ndarray, list, list]] = {}
        with np.errstate(over="ignore"):
            for n in sorted({r[0] for r in rows}):
                own = [r for r in rows if r[0] == n]
                texts = next(t for _, _, t in chunks(pa.array([r[1] for r in own], pa.binary()), 1 << 40))
                starts, ends, before = texts.words(BREAKS)
                hashes, _ = _sums(texts.hashes(starts, ends, lower=True), before, n)
                order = np.argsort(hashes, kind="stable")
                bits = np.zeros(1 << _BITS, bool)
                bits[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
                self.by[n] = (hashes[order], bits, [own[i][1] for i in order], [own[i][2] for i in order])

    def scan(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[int]], list[bool]]:
        """Start and end byte of all words, whether each is hit, the items of each document, and whether a window of full size hits it."""
        starts, ends, before = texts.words(BREAKS)
        words = texts.hashes(starts, ends, lower=True)
        cover = np.zeros(len(words) + 1, np.int64)
        items: list[set[int]] = [set() for _ in range(len(texts))]
        whole = [False] * len(texts)
        for n, (hashes, bits, known, owners) in self.by.items():
            found, first = _sums(words, before, n)
            likely = np.flatnonzero(bits[(found >> np.uint64(64 - _BITS)).astype(np.int64)])
            places = np.minimum(np.searchsorted(hashes, found[likely]), len(hashes) - 1)
            same = hashes[places] == found[likely]
            for k, at in zip(likely[same].tolist(), places[same].tolist(), strict=True):
                i = int(first[k])
                said = _normal(texts, starts[i : i + n], ends[i : i + n])
                while at < len(hashes) and hashes[at] == found[k]:
                    if known[at] == said:
                        cover[i] += 1
                        cover[i + n] -= 1
                        doc = int(np.searchsorted(before, i, side="right")) - 1
                        items[doc].update(owners[at])
                        whole[doc] = whole[doc] or n == self.size
                    at += 1
        return starts, ends, np.cumsum(cover[:-1]) > 0, items, whole


def _sets(benchmark: DataFrame, id_col: str, text_col: str, p: Params) -> Iterator[HashSet]:
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lambda it: _window_rows(it, p), "n int, words binary, item long")
    rows = rows.groupBy("n", "words").agg(F.collect_set("item").alias("items"))
    held: list[tuple[int, bytes, list[int]]] = []
    for r in rows.toLocalIterator():
        held.append((r.n, bytes(r.words), list(r["items"])))
        if len(held) == p.slice:
            yield HashSet(held, p.size)
            held = []
    yield HashSet(held, p.size)


def _scan(batches: Iterator[pa.RecordBatch], known: HashSet, at: int, names: list[str], only_hits: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows with four more columns (words, places of hit words, items, whether a full window hits); the text is column `at`. only_hits: just the rows that are hit, without their text."""
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.bool_())
    with np.errstate(over="ignore"):
        for batch in batches:
            words, hits, items, whole = [], [], [], []
            for _, _, texts in chunks(batch.column(at)):
                starts, _, hit, found, full = known.scan(texts)
                before = np.searchsorted(starts, texts.offsets)
                words += np.diff(before).tolist()
                places = np.flatnonzero(hit)
                cuts = np.searchsorted(places, before)
                whole += full
                for i in range(len(texts)):
                    hits.append((places[cuts[i] : cuts[i + 1]] - before[i]).tolist())
                    items.append(sorted(found[i]))
            new = [pa.array(v, kind) for v, kind in zip((words, hits, items, whole), kinds, strict=True)]
            old = [c for k, c in enumerate(batch.columns) if not (only_hits and k == at)]
            out = pa.RecordBatch.from_arrays([*old, *new], names=names)
            yield out.filter(pa.array([len(x) > 0 for x in hits], pa.bool_())) if only_hits else out


_NEW = "__words long, __hits array<int>, __items array<long>, __whole boolean"


def _scanned(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, p: Params) -> DataFrame:
    """docs with __words, __hits, __items and __whole. One slice of the hash set is in memory at a time."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    sets = _sets(benchmark, item_col, item_text, p)
    part, more = next(sets), next(sets, None)

    def scanned(df: DataFrame, part: HashSet, at: int, only_hits: bool = False) -> tuple[DataFrame, object]:
        shared = spark.sparkContext.broadcast(part)
        fields = [f for k, f in enumerate(df.schema.fields) if not (only_hits and k == at)]
        schema = StructType([*fields, *StructType.fromDDL(_NEW).fields])
        return df.mapInArrow(lambda it: _scan(it, shared.value, at, schema.names, only_hits), schema), shared

    if more is None:
        return scanned(docs, part, at)[0]
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = []
    for other in chain([more], sets):
        df, shared = scanned(numbered.select("__row", F.col(f"`{text_col}`").alias("__text")), other, 1, True)
        found.append(materialize(df.select("__row", "__hits", "__items", "__whole"), "hits"))
        shared.unpersist()
    rest = found[0]
    for df in found[1:]:
        rest = rest.unionByName(df)
    every = lambda c: F.flatten(F.collect_list(c))
    rest = rest.groupBy("__row").agg(every("__hits").alias("__h"), every("__items").alias("__i"), F.max("__whole").alias("__w"))
    both = scanned(numbered, part, at)[0].join(rest, "__row", "left")
    merged = lambda a, b, kind: F.array_sort(F.array_union(a, F.coalesce(b, F.array().cast(kind))))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], "__words", merged("__hits", F.col("__h"), "array<int>").alias("__hits"), merged("__items", F.col("__i"), "array<long>").alias("__items"), (F.col("__whole") | F.coalesce("__w", F.lit(False))).alias("__whole"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", params: Params = Params()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings, comma-joined), contaminated of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _scanned(rows, "text", benchmark, item_col, item_text, params)
    items = F.concat_ws(",", F.array_sort(F.transform("__items", lambda x: x.cast("string"))))
    return found.select("doc_id", F.col("__words").alias("n_words"), F.size("__hits").cast("long").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), items.alias("items"), (F.size("__items") >= params.items).alias("contaminated"))


def _cut(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Texts without their hit words."""
    for batch in batches:
        values, hits = batch.column(at).to_pylist(), batch.column(-3).to_pylist()
        for i, own in enumerate(hits):
            if own:
                texts = next(t for _, _, t in chunks(pa.array([values[i]])))
                starts, ends, _ = texts.words(BREAKS)
                stay = np.ones(len(texts.data), bool)
                for k in own:
                    stay[starts[k] : ends[k]] = False
                values[i] = texts.data[stay].tobytes().decode()
        yield batch.set_column(at, batch.schema.field(at), pa.array(values, batch.column(at).type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", params: Params = Params(), drop: bool = True) -> DataFrame:
    """docs without the documents that hold a whole window of `size` words, or windows of `items` items or more (drop): one item of a few words is no proof. Or else with all hit words cut out, and only contaminated documents gone. Columns stay as they are."""
    found, at = _scanned(docs, text_col, benchmark, item_col, item_text, params), docs.columns.index(text_col)
    if drop:
        left = found.where(~F.col("__whole") & (F.size("__items") < params.items))
    else:
        left = found.where(F.size("__items") < params.items)
        left = left.mapInArrow(lambda it: _cut(it, at), left.schema)
    return left.drop("__words", "__hits", "__items", "__whole")
