"""Mix sources to target weights (problem 8).

Method: tokens are summed per source, each source gets a repetition rate, and a document
is emitted floor(rate) times plus once more with the probability of the fraction, decided
by a hash of its id and a seed. One aggregation of a few rows is all that is shuffled; the
documents themselves never move.

Policy: the total is the size of all documents of the listed sources, each once. The rate
of a source is target_share * total / size, but at most max_repeats; what a capped source
lacks is not made up by the others, it shows in the reported shares.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.plans.storage import cut, spread

#: The public tokenizer whose tokens are the size of a text.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to this vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SEED = 20240
#: Largest target table that is broadcast; a larger one takes an ordinary join.
BROADCAST_ROWS = 10_000


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the text; 0 for '' and NULL. The vocabulary file must be at path on every machine."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    return count(text)


def sized(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of listed sources."""
    listed = _targets(targets).select("source")
    docs = spread(documents.select("doc_id", "source", "text")).join(_small(listed), "source", "left_semi")
    return docs.select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens"))


def _targets(targets: DataFrame) -> DataFrame:
    return targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source: target_share, max_repeats, n_docs, size, total, rate."""
    # a few rows, kept so that the tokens are not counted again for the total
    own = cut(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("size")))
    total = own.agg(F.sum("size").alias("total")).first()["total"] or 0
    t = _targets(targets).join(own, "source", "left").na.fill(0, ["n_docs", "size"]).withColumn("total", F.lit(total))
    rate = F.when(F.col("size") > 0, F.least(F.col("target_share") * F.col("total") / F.col("size"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return t.withColumn("rate", F.greatest(F.coalesce(rate, F.lit(0.0)), F.lit(0.0)))


def copies(doc_id: Column, rate: Column, seed: int = SEED) -> Column:
    """How often a document is emitted: floor(rate), and one more where its hash falls below the fraction."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """The mixture: every column of documents and copy_no, from 1, for each emitted copy.

    documents needs doc_id, source and text, targets needs source, target_share and
    max_repeats. A NULL or unlisted source stays out; NULL and empty texts count 0 tokens but
    are emitted like others; rows with equal doc_id share one draw; a source without documents
    yields none; a target listed twice counts with its shares added and its smallest cap. A
    column copy_no of the input is replaced. Empty tables give an empty result.
    """
    r = rates(sized(documents, targets, path), targets).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    docs = documents.drop("copy_no").join(_small(r), F.col("source") == F.col("_source"))
    n = copies(F.col("doc_id"), F.col("_rate"), seed)
    docs = docs.withColumn("_copies", n).where(F.col("_copies") > 0)
    return docs.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_source", "_rate", "_copies")


def shares(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """Per listed source: target_share, max_repeats, n_docs, size, rate, n_emitted, tokens, share.

    share is the part of the mixture's tokens that the source really has; NULL for an empty mixture."""
    sizes = cut(sized(documents, targets, path))
    r = rates(sizes, targets)
    used = sizes.join(_small(r.select("source", "rate")), "source").withColumn("c", copies(F.col("doc_id"), F.col("rate"), seed))
    got = used.groupBy("source").agg(F.sum("c").cast("bigint").alias("n_emitted"), F.sum(F.col("c") * F.col("n_tokens")).alias("tokens"))
    out = r.join(got, "source", "left").na.fill(0, ["n_emitted", "tokens"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over as many rows as there are targets
    return out.select("source", "target_share", "max_repeats", "n_docs", "size", "rate", "n_emitted", "tokens", F.when(whole > 0, F.col("tokens") / whole).alias("share"))
