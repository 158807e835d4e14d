"""Language identification by rank-order profiles: out-of-place distance of the most frequent n-grams.

Letters are lower-cased, every run of other characters is one blank; n-grams of
1 to 3 characters, with blanks only at the ends. A language's profile has its
most frequent n-grams over all training texts.

Defined results: null texts and texts without a letter are `und` with score 0;
rows with a null language teach nothing; ties in counts go to the smaller n-gram,
ties in distance to the language first in order; without any profile everything is
`und`; repeated rows count as often as they stand. Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """most: n-grams of a profile."""

    most: int = 300
    salts: int = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text; empty without a letter."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[a]
    if not inside.any():
        return np.zeros(0, np.int64)
    a = np.where(inside, a, 32).astype(np.int64)
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    a = np.concatenate(([32], a[keep], [32]))
    one, two = a[a != 32], (a[:-1] << 21) | a[1:]
    three = (two[:-1] << 21) | a[2:]
    return np.concatenate((one, two[two != (32 << 21 | 32)], three[a[1:-1] != 32]))


def _ranked(codes: np.ndarray, most: int) -> np.ndarray:
    values, times = np.unique(codes, return_counts=True)
    if len(values) > most:
        cut = np.partition(times, len(times) - most)[len(times) - most]
        keep = times >= cut
        values, times = values[keep], times[keep]
    return values[np.argsort(-times, kind="stable")][:most]


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for lang, codes in held.items():
                values, times = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values), pa.array(times.astype(np.int64))], names=["lang", "gram", "n"])

        for lang, text in zip(langs, batch.column(1), strict=True):
            codes = grams(text.as_py() or "")
            held.setdefault(lang, []).append(codes)
            size += len(codes)
            if size > 2_000_000:
                yield from out(held)
                held, size = {}, 0
        yield from out(held)


def fit(docs: DataFrame, lang: Column, text: Column, params: Params = Params()) -> dict[str, np.ndarray]:
    """Profiles, language to ranked n-gram codes. Bounded by languages times profile length."""
    rows = docs.select(lang.alias("lang"), text.alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_teach, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(params.salts)))
    order = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= params.most)
    held: dict[str, list[tuple[int, int]]] = {}
    for r in best.select("lang", "gram", "n").collect():
        held.setdefault(r.lang, []).append((-r.n, r.gram))
    return {k: np.array([g for _, g in sorted(v)[: params.most]], np.int64) for k, v in sorted(held.items())}


def _predict(batches: Iterator[pa.RecordBatch], profiles: dict[str, np.ndarray], p: Params) -> Iterator[pa.RecordBatch]:
    names = list(profiles)
    known = np.unique(np.concatenate([*profiles.values(), np.zeros(1, np.int64)]))
    places = np.full((len(names), len(known)), -1, np.int64)
    for i, codes in enumerate(profiles.values()):
        places[i, np.searchsorted(known, codes)] = np.arange(len(codes))
    for batch in batches:
        langs, scores = [], []
        for text in batch.column(2):
            codes = grams(text.as_py() or "") if names else ()
            if not len(codes):
                langs.append("und")
                scores.append(0.0)
                continue
            top = _ranked(codes, p.most)
            at = np.minimum(np.searchsorted(known, top), len(known) - 1)
            seen = np.where((known[at] == top)[None, :], places[:, at], -1)
            apart = np.where(seen < 0, p.most, np.abs(seen - np.arange(len(top)))).sum(axis=1)
            best = int(apart.argmin())
            langs.append(names[best])
            scores.append(1 - float(apart[best]) / (p.most * len(top)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_: Column, held_out: Column, text: Column, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, lang_pred, score (1 less the share of the largest possible distance) of every row."""
    rows = docs.select(id_.alias("doc_id"), held_out.alias("held_out"), text.alias("text"))
    return rows.mapInArrow(lambda it: _predict(it, profiles, params), "doc_id long, held_out boolean, lang_pred string, score double")
