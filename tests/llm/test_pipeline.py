from __future__ import annotations

import os
import re
import sys
from collections import Counter

import pytest

import corpus_pipeline
from tesseral.llm.common import materialize

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import base_spans, hits, plain_ratio, rules, sets  # noqa: E402

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF), "stage")
        n = docs.count()
        assert n > 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and n <= before
        before = n
    assert docs.columns[: len(columns)] == columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    row = docs.first()
    odd = spark.createDataFrame([(None, row.text, None, None, None), (row.doc_id, row.text, row.lang, row.source, 1), (7_000_000, None, "en", None, 0), (7_000_001, "", None, "s", 0)], docs.schema)
    for frame in (docs.limit(40).unionByName(odd), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = materialize(stage(spark, frame, SF), "stage")
        frame.count()


def test_dedup_links_from_four_fifths(spark):
    words = [f"w{k}" for k in range(104)]
    edited = lambda at: [f"x{k}" if k in at else w for k, w in enumerate(words)]
    # Each edit changes 5 of 100 shingles: two leave 90 of 110 (0.82), three leave 85 of 115 (0.74).
    texts = {1: words, 2: edited({20, 60}), 10: [f"y{w}" for w in words], 11: [f"y{w}" for w in edited({20, 50, 80})]}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, SF).collect()} == {1, 10, 11}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_by_plain_loops(spark):
    """What each stage keeps, recomputed document by document: rules and n-grams, all pairs of shingle sets, windows, spans, targets."""
    from tesseral.llm import quality

    p = quality.Params()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    plain = plain_ratio([r.text for i, r in rows.items() if i in good], [r.text for r in rows.values()], p)
    judged = {i: plain(r.text) for i, r in rows.items()}
    edge = {i for i, (score, tail) in judged.items() if abs(score - p.threshold) < 1e-5 or abs(tail - p.tail_share) < 1e-5}
    want = {i for i, r in rows.items() if not rules(r.text)[-1] and judged[i][0] >= p.threshold and judged[i][1] <= p.tail_share}
    now = materialize(corpus_pipeline.quality_stage(spark, docs, SF), "stage")
    kept = {r.doc_id for r in now.collect()}
    assert kept - edge == want - edge and kept < set(rows)

    own = {i: sets(rows[i].text) for i in kept}
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    now = materialize(corpus_pipeline.dedup_stage(spark, now, SF), "stage")
    alone = {r.doc_id for r in now.collect()}
    assert alone == {i for i in kept if find(i) == i}

    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ITEM.findall((r.text or "").translate(LOWER))
        n = min(8, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(r.item_id)
    full = {w: items for w, items in windows.items() if len(w) == 8}
    clean = {i for i in alone if not hits(rows[i].text, full)[1] and len(hits(rows[i].text, windows)[2]) < 2}
    now = materialize(corpus_pipeline.decontaminate_stage(spark, now, SF), "stage")
    assert {r.doc_id for r in now.collect()} == clean

    now = materialize(corpus_pipeline.pii_stage(spark, now, SF), "stage")
    texts = {r.doc_id: r for r in now.collect()}
    for i, r in texts.items():
        spans = {k: len(v) for k, v in base_spans(rows[i].text).items()}
        assert r.text.count("[EMAIL]") == spans["email"] and r.n_chars == len(r.text)
        assert not base_spans(r.text)["email"] and not base_spans(r.text)["ip"] and not base_spans(r.text)["phone"]
        if not any(spans.values()) and "[" not in r.text:
            assert r.text == rows[i].text
    assert set(texts) == clean

    drawn = corpus_pipeline.mixing_stage(spark, now, SF).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in texts.items()}
    source, taken = Counter(), Counter()
    for i, r in texts.items():
        source[r.source] += size[i]
    for r in drawn:
        assert r.text == texts[r.doc_id].text
        taken[r.source] += size[r.doc_id]
    assert max(Counter(r.doc_id for r in drawn).values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(source.values())) <= len(source) * max(size.values())
    assert all(taken[s] <= 2 * n for s, n in source.items())
