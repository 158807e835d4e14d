"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit.

Each text is encoded whole; documents are aggregated by length, so that what is
gathered has one row for each length that occurs. Suffix sums over the lengths give,
for any context limit: documents that exceed it, tokens kept when texts are cut
there, quantiles.

Defined results: null and empty texts have length 0; repeated rows count as often
as they stand; an empty table gives no rows, and null for every quantile; ids may
have any type; only the named columns are read.
Texts that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """vocabulary: a file of byte-level ranks, one base64 token and rank a line; pattern: the split before encoding."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@cache
def encoder(p: Params):  # noqa: ANN201
    import tiktoken

    with open(p.vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})


def _lengths(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    own = encoder(p)
    for batch in batches:
        sizes = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """doc_id, n_tokens of every row."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(lambda it: _lengths(it, params), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """For each length n_tokens that occurs, taken as context limit: docs, docs_at_least, docs_over, total_tokens, tokens_at_least, truncated_tokens (of all texts cut at it), share_within (documents that fit)."""
    bars = lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))
    down = Window.orderBy(F.desc("n_tokens"))
    every = Window.partitionBy()
    own = F.col("docs") * F.col("n_tokens")
    sums = bars.select("n_tokens", "docs", F.sum("docs").over(down).alias("docs_at_least"), F.sum(own).over(down).alias("tokens_at_least"), F.sum("docs").over(every).alias("all_docs"), F.sum(own).over(every).alias("total_tokens"))
    over = F.col("docs_at_least") - F.col("docs")
    return sums.select("n_tokens", "docs", "docs_at_least", over.alias("docs_over"), "total_tokens", "tokens_at_least", (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"), (1 - over / F.col("all_docs")).alias("share_within"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, truncated_tokens, total_tokens for each context limit, whether or not a text has that length."""
    ask = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    met = histogram.crossJoin(F.broadcast(ask))
    over = F.col("n_tokens") > F.col("limit")
    return met.groupBy("limit").agg(F.sum(F.when(over, F.col("docs")).otherwise(0)).alias("docs_over"), F.sum(F.col("docs") * F.least("n_tokens", "limit")).alias("truncated_tokens"), F.max("total_tokens").alias("total_tokens"))


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The least length that at least the share q of documents does not exceed; null for no documents."""
    found = histogram.where(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n")).first()
    return found.n
