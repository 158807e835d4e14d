"""Near-duplicate detection: fast similarity sketching, banding, exact verification, components.

Sketch of a set over t bins (Dahlgaard, Knudsen and Thorup, 2017): in round
i < t every element is thrown into a random bin with value i + fraction, in
round t + j into bin j; a bin keeps its least value and the sketch stops once
all bins are filled, which the last t rounds guarantee. Coordinates agree with
the sets' Jaccard similarity as probability, with concentration bounds.

Defined results: null and empty texts have no shingles, are linked with nothing
and form components of their own; texts with fewer words than a shingle have the
whole sequence as their one shingle; repeated rows are copies of one document;
rows that share an id are one vertex of the link graph; a null id takes no
part (component null, kept). An empty table gives an empty result. Only the
named id and text columns are read, so that extra columns never clash. Ids are
integers, as components are named by the least of them; a text id fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, as_long, chunks, likely_in, materialize, mix, seeds, small, stored, windows
from .graph import connected_components


@dataclass(frozen=True)
class Params:
    """shingle: words; links need percent * union <= 100 * intersection; bins = bands * rows.

    At similarity 0.85 a pair shares none of 24 bands of 5 rows with probability 7e-7.
    block: members of one centre that are verified by one group. pairs: beyond so
    many candidates of one shingle, whole blocks of `side` documents are compared.
    """

    shingle: int = 5
    percent: int = 85
    bands: int = 24
    rows: int = 5
    block: int = 64
    pairs: int = 4096
    side: int = 128
    seed: int = 11


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, document after document, and how many precede each document."""
    starts, ends, before = texts.words()
    words = texts.hashes(starts, ends, lower=True)
    grams, _, counts = windows(words, before, size, 3)
    per = np.diff(before)
    few = np.flatnonzero((per > 0) & (per < size))
    sets = []
    for i in range(len(texts)):
        sets.append(grams[counts[i] : counts[i + 1]])
    mult = seeds(size, 5) | np.uint64(1)
    for i in few:
        w = words[before[i] : before[i + 1]]
        sets[i] = mix((w * mult[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))
    for i, s in enumerate(sets):
        if len(s) > 1:
            s = np.sort(s)
            sets[i] = s[np.concatenate(([True], s[1:] != s[:-1]))]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def sketches(elements: np.ndarray, before: np.ndarray, bins: int, seed: int) -> np.ndarray:
    """One row of `bins` values for each set; rows of empty sets keep the largest value."""
    n = len(before) - 1
    empty = np.iinfo(np.int64).max
    out = np.full(n * bins, empty, np.int64)
    per = np.diff(before)
    open_ = np.flatnonzero(per)
    x, owner = elements, np.repeat(np.arange(n), per)
    salts = seeds(2 * bins, seed)
    low = np.uint64((1 << 40) - 1)
    for r in range(2 * bins):
        if not len(open_):
            break
        h = mix(x ^ salts[r])
        place = ((h >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64) if r < bins else r - bins
        np.minimum.at(out, owner * bins + place, (np.int64(r) << np.int64(40)) | (h & low).astype(np.int64))
        filled = out.reshape(n, bins)[open_].max(axis=1) < empty
        if filled.any():
            open_ = open_[~filled]
            keep = np.zeros(n, bool)
            keep[open_] = True
            stay = keep[owner]
            x, owner = x[stay], owner[stay]
    return out.reshape(n, bins)


def _sketch_rows(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    one, two = seeds(2, 17)
    salts = seeds(p.bands, p.seed + 1)
    with np.errstate(over="ignore"):
        for batch in batches:
            for at, to, texts in chunks(batch.column(1)):
                sets, before = shingle_sets(texts, p.shingle)
                sketch = sketches(sets, before, p.bands * p.rows, p.seed).view(np.uint64).reshape(-1, p.bands, p.rows)
                bands = np.repeat(salts[None, :], len(sketch), axis=0)
                for j in range(p.rows):
                    bands = mix(bands ^ sketch[:, :, j])
                ends = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets ^ s), dtype=np.uint64))) for s in (one, two)]
                size = np.diff(before)
                fp = [as_long(mix(e[before[1:]] - e[before[:-1]] + size.astype(np.uint64))) for e in ends]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * p.bands), pa.array(as_long(bands.reshape(-1))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(size), pa.array(fp[0]), pa.array(fp[1]), lists], names=["doc_id", "n", "fp1", "fp2", "bands"])


def _verify_rows(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, centres first. Gives (a, b) for members that are similar enough to a centre."""
    key, centres = None, []
    with np.errstate(over="ignore"):
        for batch in batches:
            a, k, blk, role, doc = (batch.column(i).to_pylist() for i in range(5))
            found = []
            for at, to, texts in chunks(batch.column(5)):
                sets, before = shingle_sets(texts, p.shingle)
                for i in range(at, to):
                    own = sets[before[i - at] : before[i - at + 1]]
                    if (a[i], k[i], blk[i]) != key:
                        key, centres = (a[i], k[i], blk[i]), []
                    if role[i] == 0:
                        centres.append(own)
                        continue
                    for c in centres:
                        if p.percent * max(len(c), len(own)) > 100 * min(len(c), len(own)):
                            continue
                        both = len(np.intersect1d(c, own, assume_unique=True))
                        if both and 100 * both >= p.percent * (len(c) + len(own) - both):
                            found.append((a[i], doc[i]))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["src", "dst"])


def verify(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Links (src, dst) among pairs(a, b, c): those whose full shingle sets are similar enough.

    c is about the number of pairs of a. A centre meets its members in groups of
    about `block`, each group holding one centre's set at a time.
    """
    asked = pairs.select("a", "b", F.ceil(F.col("c") / p.block).cast("int").alias("k")).withColumn("blk", F.pmod(F.xxhash64("b"), F.col("k")).cast("int"))
    members = asked.select(F.col("b").alias("node"), "a", "k", "blk", F.lit(1).alias("role"))
    centres = asked.select(F.col("a").alias("node"), "a", "k", "blk", F.lit(0).alias("role")).distinct()
    # What to compare is narrow and stored first: up to a size that its count proves it goes to the texts, which then are shuffled once.
    sides = small(materialize(members.unionByName(centres), "sides"))
    rows = texts.join(sides, "node").select("a", "k", "blk", "role", "node", "text").repartition("a", "k", "blk").sortWithinPartitions("a", "k", "blk", "role")
    return materialize(rows.mapInArrow(lambda it: _verify_rows(it, p), "src long, dst long"), "links")


def _shingle_rows(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for at, to, texts in chunks(batch.column(2)):
                sets, before = shingle_sets(texts, p.shingle)
                size = np.diff(before)
                own = np.repeat(np.arange(at, to), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(np.repeat(size, size)), pa.array(as_long(sets))], names=["node", "comp", "n", "h"])


def _prefix_pairs(texts: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """All pairs of different components among texts(node, comp, text) that can be similar enough, by prefix filtering.

    As pairs (a, b, c), or where one shingle proposes more than `pairs` of them as its rows (h, node, comp).

    Shingles are ordered by how many documents have them, those of a single
    component first. Of two similar sets of n and m shingles both have a common
    one among their first n - ceil(percent n) + 1 and m - ceil(percent m) + 1, so
    that passages which many documents share propose nothing.
    """
    tokens = materialize(texts.select("node", "comp", "text").mapInArrow(lambda it: _shingle_rows(it, p), "node long, comp long, n long, h long"), "shingles")
    often = tokens.groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("h", "c")
    common = tokens.join(small(materialize(often, "often")), "h")
    own = Window.partitionBy("node")
    placed = common.withColumn("place", F.row_number().over(own.orderBy("c", "h")) + F.col("n") - F.count("*").over(own))
    index = placed.where(f"place <= n - ({p.percent} * n + 99) div 100 + 1").select("h", "c", "node", "comp", "n")
    index = materialize(index, "index")
    sizes = index.groupBy("h", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy("h").agg(F.max(F.struct("k", "comp")).alias("s"), F.count("*").alias("comps"), F.sum("k").alias("t")).where("comps > 1")
    main = materialize(main.select("h", F.col("s.comp").alias("main"), (F.expr("(t - s.k) * t") > p.pairs).alias("hot")), "main")
    several = materialize(index.join(small(main), "h"), "several")
    cool = several.where("not hot")
    minor = cool.where("comp != main").select("h", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), "main")
    pairs = minor.join(cool.drop("main", "hot"), "h").where(f"comp != ca and (comp = main or node < a) and {p.percent} * greatest(n, na) <= 100 * least(n, na)")
    return materialize(pairs.groupBy("a", F.col("node").alias("b")).agg(F.max("c").alias("c")), "rest"), several.where("hot").select("h", "node", "comp")


def _matched(centres: list, members: list, p: Params) -> list[tuple[int, int]]:
    """(centre, member) of all similar pairs of different components, by sums over their common shingles."""
    if not centres or not members:
        return []
    tokens = [np.concatenate([x[2] for x in side]) for side in (centres, members)]
    common = np.intersect1d(*tokens)
    owners = [np.repeat(np.arange(len(side)), [len(x[2]) for x in side]) for side in (centres, members)]
    both = np.zeros((len(centres), len(members)), np.float32)
    places = [np.minimum(np.searchsorted(common, t), max(0, len(common) - 1)) for t in tokens]
    keep = [common[at] == t if len(common) else np.zeros(len(t), bool) for at, t in zip(places, tokens, strict=True)]
    places, owners = [at[k] for at, k in zip(places, keep, strict=True)], [o[k] for o, k in zip(owners, keep, strict=True)]
    for lo in range(0, len(common), 4096):
        half = []
        for at, o, side in zip(places, owners, (centres, members), strict=True):
            has = np.zeros((len(side), 4096), np.float32)
            here = (at >= lo) & (at < lo + 4096)
            has[o[here], at[here] - lo] = 1
            half.append(has)
        both += half[0] @ half[1].T
    size = [np.array([len(x[2]) for x in side], np.int64) for side in (centres, members)]
    inter = np.rint(both).astype(np.int64)
    near = (inter > 0) & (100 * inter >= p.percent * (size[0][:, None] + size[1][None, :] - inter))
    comp = [np.array([x[1] for x in side], np.int64) for side in (centres, members)]
    near &= comp[0][:, None] != comp[1][None, :]
    return [(centres[i][0], members[j][0]) for i, j in zip(*np.nonzero(near), strict=True)]


def _block_rows(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit (fam, i, j); each unit is compared as a whole, its size is bounded by 2 * side texts or so."""
    key, sides = None, ([], [])
    names = ["src", "dst"]

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=names)

    with np.errstate(over="ignore"):
        for batch in batches:
            fam, i_, j_, role, node, comp = (batch.column(k).to_pylist() for k in range(6))
            for at, to, texts in chunks(batch.column(6)):
                sets, before = shingle_sets(texts, p.shingle)
                for k in range(at, to):
                    if (fam[k], i_[k], j_[k]) != key:
                        yield batch_of(_matched(*sides, p))
                        key, sides = (fam[k], i_[k], j_[k]), ([], [])
                    sides[role[k]].append((node[k], comp[k], sets[before[k - at] : before[k - at + 1]]))
        yield batch_of(_matched(*sides, p))


def _verify_blocks(hot: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Links among large families of candidates hot(h, node, comp): blocks of the minor components against blocks of all."""
    hot = materialize(hot, "hot")
    least = materialize(hot.groupBy("h").agg(F.min("node").alias("src")), "least")
    fams = connected_components(hot.join(least, "h").select("src", F.col("node").alias("dst")).distinct())
    nodes = materialize(hot.select("node", "comp").distinct().join(fams.select("node", F.col("comp").alias("fam")), "node"), "nodes")
    sizes = nodes.groupBy("fam", "comp").agg(F.count("*").alias("k")).groupBy("fam").agg(F.max(F.struct("k", "comp")).alias("s"), F.sum("k").alias("t"))
    parts = sizes.select("fam", F.col("s.comp").alias("main"), F.ceil(F.col("t") / p.side).cast("int").alias("nj"), F.ceil(F.expr("t - s.k") / p.side).cast("int").alias("ni"))
    nodes = nodes.join(small(materialize(parts, "parts")), "fam")
    at = F.xxhash64("node")
    rows = nodes.select("node", "comp", "fam", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod(at, "nj").cast("int").alias("j")).where("ni > 0")
    own = nodes.where("comp != main").select("node", "comp", "fam", F.lit(0).alias("role"), F.pmod(at, "ni").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"))
    units = texts.join(small(materialize(rows.unionByName(own), "sides")), "node").select("fam", "i", "j", "role", "node", "comp", "text").repartition("fam", "i", "j").sortWithinPartitions("fam", "i", "j")
    return materialize(units.mapInArrow(lambda it: _block_rows(it, p), "src long, dst long").distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; see the module for the defined cases."""
    with stored(docs.sparkSession) as keep:
        sketched, named = _components(docs, id_col, text_col, params)
        keep(sketched, named)
    linkable = sketched.where("n > 0 and doc_id is not null")
    whole = linkable.select("doc_id", "n", "fp1", "fp2").join(named, ["fp1", "fp2"]).select("doc_id", "n", "component_id")
    alone = sketched.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _components(docs: DataFrame, id_col: str, text_col: str, p: Params) -> tuple[DataFrame, DataFrame]:
    """The stored sketches of all rows, and (fp1, fp2, component_id) of each different set."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = materialize(docs.mapInArrow(lambda it: _sketch_rows(it, p), "doc_id long, n long, fp1 long, fp2 long, bands array<long>"), "sketched")
    linkable = sketched.where("n > 0 and doc_id is not null")
    classes = materialize(linkable.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = materialize(banded.groupBy("bucket").agg(F.min("node").alias("a"), F.min(F.struct(F.xxhash64("bucket", "node"), "node")).alias("q"), F.count("*").alias("c")).where("c > 1").select("bucket", "a", F.col("q.node").alias("q"), "c"), "hubs")
    members = materialize(banded.join(hubs, "bucket").select("bucket", "a", "q", "c", F.col("node").alias("b")), "members")
    stars = materialize(members.where("a != b").groupBy("a", "b").agg(F.max("c").alias("c")), "stars")
    involved = members.select(F.col("b").alias("node")).distinct()
    involved = materialize(involved, "involved")
    near = likely_in(docs, "doc_id", involved, "node").withColumnRenamed("doc_id", "node")
    texts = materialize(near.join(small(involved), "node").select("node", "text"), "texts")

    # One centre for each document first: most links need no more.
    first = stars.groupBy("b").agg(F.min(F.struct("a", "c")).alias("s")).select("s.a", "b", "s.c")
    found = verify(first, texts, p).unionByName(members.where("a = b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    found = found.unionByName(members.where("a != b").select(F.col("b").alias("src"), F.col("b").alias("dst")))
    twice = linkable.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    if twice.head(1):
        same = linkable.join(materialize(twice, "twice"), "doc_id").join(classes.select("fp1", "fp2", "node"), ["fp1", "fp2"])
        found = found.unionByName(same.select(F.col("doc_id").alias("src"), F.col("node").alias("dst")))
    comps = connected_components(found)

    # Then the other centres and one random member of each bucket, where they could still join two components.
    def label(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(comps.select(F.col("node").alias(node), F.col("comp").alias(name)), node)

    def joined(links: DataFrame) -> DataFrame:
        return connected_components(comps.select(F.col("node").alias("src"), F.col("comp").alias("dst")).unionByName(links))

    other = stars.unionByName(members.where("q != b and q != a and a != b").select(F.col("q").alias("a"), "b", "c"))
    other = other.groupBy("a", "b").agg(F.max("c").alias("c")).join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = materialize(label(label(other, "b", "cb"), "a", "ca").where("ca != cb").select("a", "b", "c"), "second")
    if second.head(1):
        links = verify(second, texts, p)
        if links.head(1):
            comps = joined(links)

    # Last, an exact join of the documents whose buckets still hold several components.
    held = label(members, "b", "comp")
    mixed = held.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo != hi and n > 2").select("bucket")
    mixed = materialize(mixed, "mixed")
    if mixed.head(1):
        nodes = held.join(mixed, "bucket").select(F.col("b").alias("node"), "comp").distinct()
        rest, hot = _prefix_pairs(texts.join(small(materialize(nodes, "nodes")), "node"), p)
        more = [verify(rest, texts, p)] if rest.head(1) else []
        more += [_verify_blocks(hot, texts, p)] if hot.head(1) else []
        more = [x for x in more if x.head(1)]
        if more:
            comps = joined(more[0] if len(more) == 1 else more[0].unionByName(more[1]))

    named = classes.select("fp1", "fp2", "node").join(comps, "node", "left").select("fp1", "fp2", F.coalesce("comp", "node").alias("component_id"))
    return sketched, materialize(named, "named")
