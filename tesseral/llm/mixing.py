"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame operations only.

Sizes are words. A source's target is its weight's share of the total, at most
`most` times its size, the excess going to the others by weight (water filling).
A source's documents stand in blocks, its blocks in a permuted order; the target
says how many of them are drawn, whole passes first, the last block document by
document. That number is the source's quota at the root of a binary tree over
the output shards. A node gives its left half floor(n / 2) of its n blocks: how
many of each source is one multivariate-hypergeometric draw, block after block
without replacement, packs of sources before the sources of each pack. A leaf's
quotas are exact; shard after shard takes its quota from the source's permuted
blocks, so that draws are disjoint. Documents of a shard are ordered by a hash.

Nothing runs over all blocks in one window: sources are ranked by ranges, the
water level is a fixed point of sums, a pack has about `pack` sources, a block
about `rows` documents whatever the size of the table.

Defined results: null texts have size 0; a null source is a source of its own,
last in order; sources of size 0 have target 0 and nothing is taken; repeated
rows are documents of their own in the same block; null ids are told apart by
their texts; an empty table gives an empty result. Reruns agree, as all order is
by md5 of given values and all draws by hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, stored


@dataclass(frozen=True)
class Params:
    """weights repeat over the sources in order; share: total target over total size; most: times a source's size at most.
    rows: documents of a block at most, about; pack: sources of a pack; shards = 2 ** levels."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    rows: int = 1 << 15
    pack: int = 1024
    levels: int = 4
    seed: str = "mix"


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank, from 0, of the source by code point, null last: ranges of sources are counted, then numbered each by itself."""
    spark = sizes.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(sizes.repartitionByRange(ranges, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("own", F.row_number().over(own) - 1).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("own")).drop("part", "own", "start")


def source_targets(sizes: DataFrame, p: Params = Params()) -> DataFrame:
    """sizes(source, source_size), one row a source, with weight and target."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), (F.col("rank") % len(p.weights) + 1).cast("int"))
    ranked = materialize(_ranked(sizes).withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(p.most))), "ranked")
    # Sources that the level drowns stop at their full size; the rest of the total is dealt anew until none is above.
    level = 0.0
    while True:
        over = F.col("full") < F.col("weight") * F.lit(level)
        r = ranked.agg(F.sum("source_size").alias("s"), F.sum(F.when(over, F.col("full")).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        new = (r.s * p.share - r.full) / r.weight if r.s and r.weight else level
        if new == level:
            break
        level = new
    return ranked.select("source", "source_size", "weight", F.least("full", F.col("weight") * F.lit(level)).alias("target"))


def _key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def block_digits(docs: int, p: Params) -> int:
    """Hexadecimal digits of a block's name: two, and one more whenever blocks of one source could outgrow `rows`."""
    digits = 2
    while docs > p.rows * 16**digits:
        digits += 1
    return digits


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, p: Params, digits: int) -> list[Column]:
    """doc_id, source, size, name (the source, null or not), place and block of a row."""
    source, doc = F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`")
    text = F.col(f"`{text_col}`").cast("string")
    known = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    place = _key(F.lit(p.seed), known, F.coalesce(doc.cast("string"), F.md5(text), F.lit("")))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return [doc.alias("doc_id"), source.alias("source"), size.alias("size"), known.alias("name"), place.alias("place"), F.substring(place, 1, digits).alias("block")]


def _draw(quotas: Column, wanted: Column, salt: list[Column]) -> Column:
    """One multivariate-hypergeometric draw: of the blocks that quotas counts, `wanted` are taken without replacement; how many of each entry.

    Block after block is taken with the chance of those still wanted among those still left, an exact draw.
    """
    start = F.struct(wanted.cast("long").alias("want"), F.aggregate(quotas, F.lit(0).cast("long"), lambda a, x: a + x).alias("left"), F.array().cast("array<long>").alias("taken"))

    def entry(acc: Column, own: Column) -> Column:
        zero = F.struct(acc["want"].alias("want"), acc["left"].alias("left"), F.lit(0).cast("long").alias("k"))

        def block(a: Column, i: Column) -> Column:
            hit = (F.pmod(F.xxhash64(*salt, F.size(acc["taken"]), i), a["left"]) < a["want"]).cast("long")
            return F.struct((a["want"] - hit).alias("want"), (a["left"] - 1).alias("left"), (a["k"] + hit).alias("k"))

        blocks = F.when(own > 0, F.sequence(F.lit(1).cast("long"), own)).otherwise(F.array().cast("array<long>"))
        return F.aggregate(blocks, zero, block, lambda a: F.struct(a["want"].alias("want"), a["left"].alias("left"), F.concat(acc["taken"], F.array(a["k"])).alias("taken")))

    return F.aggregate(quotas, start, entry, lambda a: a["taken"])


def _halved(df: DataFrame, nodes: str, lefts: str) -> DataFrame:
    """df whose column `nodes` (an array of quota arrays) is replaced by the nodes' left and right halves."""
    halves = F.zip_with(nodes, lefts, lambda n, k: F.array(k, F.zip_with(n, k, lambda a, b: a - b)))
    return df.withColumn(nodes, F.flatten(halves))


def shard_quotas(quotas: DataFrame, p: Params = Params()) -> DataFrame:
    """(name, shares) of quotas(name, quota): how many of a source's blocks each shard draws, by the splitting tree."""
    packs = max(1, -(-quotas.count() // p.pack))
    dealt = quotas.withColumn("pack", F.pmod(F.xxhash64("name"), F.lit(packs)).cast("int"))
    rows = dealt.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("name", F.col("quota").cast("long").alias("quota")))).alias("own"))
    rows = materialize(rows.withColumn("total", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["quota"])), "packs")
    seed = F.lit(p.seed)
    # The tree over packs: one row, whose arrays have an entry a pack.
    top = rows.agg(F.array_sort(F.collect_list(F.struct("pack", "total"))).alias("t"))
    top = top.select(F.transform("t", lambda x: x["pack"]).alias("packs"), F.array(F.transform("t", lambda x: x["total"])).alias("nodes"))

    def over_packs(level: int) -> Column:
        half = lambda n: F.floor(F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x) / 2)
        return F.transform("nodes", lambda n, i: _draw(n, half(n), [seed, F.lit("packs"), F.lit(level), i]))

    for level in range(p.levels):
        top = _halved(top.withColumn(f"left{level}", over_packs(level)), "nodes", f"left{level}")
    wanted = [F.transform(f"left{level}", lambda n: F.get(n, F.col("at"))).alias(f"want{level}") for level in range(p.levels)]
    top = top.select("*", F.posexplode("packs").alias("at", "pack")).select("pack", *wanted)
    # The tree over each pack's sources, whose halves add up to what the pack got.
    df = rows.join(F.broadcast(materialize(top, "wanted")) if packs <= 10_000 else top, "pack").withColumn("nodes", F.array(F.transform("own", lambda x: x["quota"])))

    def over_sources(level: int) -> Column:
        return F.transform("nodes", lambda n, i: _draw(n, F.get(f"want{level}", i), [seed, F.lit("sources"), F.col("pack"), F.lit(level), i]))

    for level in range(p.levels):
        df = _halved(df.withColumn("__left", over_sources(level)), "nodes", "__left").drop("__left")
    return df.select("nodes", F.posexplode("own").alias("at", "x")).select(F.col("x.name").alias("name"), F.transform("nodes", lambda n: F.get(n, F.col("at"))).alias("shares"))


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, p: Params) -> tuple[DataFrame, DataFrame, int]:
    """The rows of docs as _sized() says, the plan (one row for each source and block), both stored, and the digits of a block."""
    with stored(docs.sparkSession) as keep:
        sized, plan, digits = _planned(docs, id_col, text_col, source_col, p)
        keep(sized, plan)
    return sized, plan, digits


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, p: Params) -> tuple[DataFrame, DataFrame, int]:
    digits = block_digits(docs.count(), p)
    sized = materialize(docs.select(*_sized(docs, id_col, text_col, source_col, p, digits)), "sized")
    blocks = sized.groupBy("name", "block").agg(F.first("source").alias("source"), F.sum("size").alias("block_size"))
    blocks = materialize(blocks, "blocks")
    targets = materialize(source_targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), p), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    here = Window.partitionBy("name").orderBy(_key(F.lit(p.seed), F.lit("block"), "name", "block"))
    drawn = blocks.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    drawn = drawn.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    drawn = drawn.withColumn("upto", F.sum("block_size").over(here)).withColumn("before", F.col("upto") - F.col("block_size")).withColumn("at", F.row_number().over(here) - 1)
    drawn = drawn.withColumn("part", F.when(F.col("rest") <= 0, F.lit("none")).when(F.col("upto") <= F.col("rest"), F.lit("all")).when(F.col("before") < F.col("rest"), F.lit("some")).otherwise(F.lit("none")))
    drawn = materialize(drawn, "drawn")
    quotas = drawn.groupBy("name").agg(F.count("*").alias("blocks"), F.sum(F.col("passes") + (F.col("part") != "none").cast("int")).alias("quota"))
    quotas = materialize(quotas, "quotas")
    shares = materialize(shard_quotas(quotas.where("quota > 0").select("name", "quota"), p), "shares")
    # Draw k of a block is unit (k - 1) * blocks + at of its source; the shard is the first whose quotas, added up, reach beyond it.
    ends = F.aggregate("shares", F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))))
    ends = quotas.join(shares, "name").select("name", "blocks", F.when(F.size("shares") > 0, ends).alias("ends"))
    units = F.sequence(F.lit(0), F.col("passes"))
    shard = lambda k: F.size(F.filter("ends", lambda e: e <= k * F.col("blocks") + F.col("at")))
    inside = F.filter(F.transform(units, shard), lambda x: x < 2**p.levels)
    plan = drawn.join(ends, "name", "left").select("name", "block", "source_size", "target", "passes", "rest", "before", "part", F.coalesce(inside, F.array().cast("array<int>")).alias("shards"))
    return sized, materialize(plan, "plan"), digits


def _decided(rows: DataFrame) -> DataFrame:
    """rows(sized and planned) of blocks that are drawn in part, with the boolean extra: documents in order of place, up to the rest."""
    inside = Window.partitionBy("name", "block").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.where("part = 'some'").withColumn("extra", F.col("before") + F.sum("size").over(inside) - F.col("size") / 2 <= F.col("rest"))


def _copies(rows: DataFrame) -> DataFrame:
    """rows with the shard of each copy: all draws of the block, less the last one for documents that it leaves out."""
    return rows.withColumn("shards", F.when(F.col("extra"), F.col("shards")).otherwise(F.slice("shards", F.lit(1), F.col("passes")))).withColumn("copies", F.size("shards"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: Params = Params()) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies, shards (array, one for each copy), place (order within a shard)."""
    sized, plan, _ = _drawn(docs, id_col, text_col, source_col, params)
    rows = sized.join(plan, ["name", "block"])
    whole = rows.where("part != 'some'").withColumn("extra", F.col("part") == "all")
    rows = _copies(whole.unionByName(_decided(rows)))
    return rows.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", "shards", "place")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: Params = Params(), most: int = 100_000) -> DataFrame:
    """The drawn copies: the columns of docs with mix_copy, mix_shard and mix_place.

    Rows meet the plan of blocks, which is broadcast up to `most` rows; only rows of
    blocks that are drawn in part are joined by place. Repeated rows of one id share a place.
    """
    columns = docs.columns
    sized, plan, digits = _drawn(docs, id_col, text_col, source_col, params)
    extras = materialize(_decided(sized.join(plan.where("part = 'some'"), ["name", "block"])).where("extra").select("name", "place").distinct(), "extras")
    parts = _sized(docs, id_col, text_col, source_col, params, digits)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), *[c for c in parts[3:]])
    small = plan.count() <= most
    rows = rows.join(F.broadcast(plan) if small else plan, ["name", "block"])
    whole = rows.where("part != 'some'").withColumn("extra", F.col("part") == "all")
    part = rows.where("part = 'some'").join(extras.withColumn("extra", F.lit(True)), ["name", "place"], "left").withColumn("extra", F.coalesce("extra", F.lit(False)))
    drawn = _copies(whole.unionByName(part)).where("copies > 0").select("__row", "place", F.posexplode("shards").alias("__copy", "__shard"))
    return drawn.select(*[F.col("__row").getField(c).alias(c) for c in columns], (F.col("__copy") + 1).alias("mix_copy"), F.col("__shard").alias("mix_shard"), _key(F.lit(params.seed), F.lit("place"), F.col("__shard").cast("string"), F.col("__copy").cast("string"), "place").alias("mix_place"))
