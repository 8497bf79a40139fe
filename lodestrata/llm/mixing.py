"""A mixture of sources with target shares of its tokens.

Every document gets an exponential key divided by its quality weight
(Efraimidis-Spirakis), so that taking documents in the order of their keys is
a weighted sample without replacement. Each source has a token budget: its
share of the whole, at most max_repeats times what it holds; what capped
sources leave is shared out among the others by their targets, so that the
mixture keeps its size where that is possible. Complete epochs of a source
come first, then the documents with the least keys until the rest is filled.

Running sums are formed over ranges of source and key, cut at sampled
quantiles: sums per range make a small table that gives every range its
start, and only within a range rows are ordered. A source with a third of all
rows is spread over as many ranges as its rows fill.

Defined results: null or empty text has no tokens and is never chosen;
documents of no source or of a source that isn't listed don't take part; a
listed source without documents gets nothing; copies under other ids count
each for itself; ties of keys go to the smaller id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import running
from ..session import cut_lineage
from .stuffing import measure

#: Least quality weight, seed of the keys.
LEAST_QUALITY, SEED = 0.05, 42


def default_vocabulary() -> str:
    """Place of the public byte-level vocabulary of 50 256 tokens on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, tokens, quality: tokens of the whole text, and the share of it that isn't stuffed.

    The vocabulary is read where the query is made and sent to the executors; its size is that of a tokenizer, whatever the data.
    """
    import public_tokenizers

    with open(vocabulary or default_vocabulary(), "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast((f.read(), public_tokenizers.PATTERN))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(*sent.value)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            out = batch[["doc_id", "source"]].copy()
            out["tokens"] = [len(x) for x in encoding.encode_ordinary_batch(texts, num_threads=1)]
            out["quality"] = [max(LEAST_QUALITY, 1 - measure(t)[0]) for t in texts]
            yield out

    return documents.select("doc_id", "source", "text").mapInPandas(count, "doc_id bigint, source string, tokens bigint, quality double")


def budgets(targets: list[tuple[str, float, int]], held: dict[str, int]) -> dict[str, float]:
    """Tokens each source contributes: its share of all tokens held, up to its cap, the remainder shared out by the targets."""
    whole = sum(held.get(s, 0) for s, _, _ in targets)
    caps = {s: float(held.get(s, 0) * max(repeats or 0, 0)) for s, _, repeats in targets}
    share = {s: target or 0.0 for s, target, _ in targets}
    out, left = {s: 0.0 for s in caps}, float(whole)
    open_ = {s for s in caps if caps[s] > 0 and share[s] > 0}
    while open_ and left > 1e-9:
        total = sum(share[s] for s in open_)
        full = {s for s in open_ if out[s] + left * share[s] / total >= caps[s]}
        if not full:
            for s in open_:
                out[s] += left * share[s] / total
            break
        for s in full:
            left -= caps[s] - out[s]
            out[s] = caps[s]
        open_ -= full
    return out


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, times) and its report (a row per target, with the shares reached)."""
    listed = targets.select("source", "target_share", "max_repeats").where("source is not null")
    sources = listed.select("source").distinct()
    counted = count_tokens(documents.join(F.broadcast(sources), "source", "left_semi"), vocabulary)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = cut_lineage(counted.where("tokens > 0").withColumn("key", -F.log(uniform) / F.col("quality")))
    available = cut_lineage(keyed.groupBy("source").agg(F.sum("tokens").alias("available_tokens")))
    # One row per listed source: what the driver needs to set the budgets.
    held = {r["source"]: r["available_tokens"] for r in available.toLocalIterator()}
    aims = [(r["source"], r["target_share"], r["max_repeats"]) for r in listed.toLocalIterator()]
    plan = budgets(aims, held)
    rows = [(s, float(b), int(b // held[s]) if held.get(s) else 0, b - (b // held[s]) * held[s] if held.get(s) else 0.0) for s, b in plan.items()]
    spark = documents.sparkSession
    planned = spark.createDataFrame(rows or [], "source string, budget double, epochs int, rest double")

    ordered = running(keyed, "source", [F.col("key"), F.col("doc_id")], F.col("tokens"), "reached", "place")
    # One row per listed source.
    placed = ordered.join(F.broadcast(planned), "source")
    # The last document is taken if that comes nearer to the budget.
    times = F.col("epochs") + (F.col("reached") - F.col("tokens") / 2 < F.col("rest")).cast("int")
    chosen = placed.select("doc_id", "source", "tokens", times.alias("times")).where("times > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("reached_tokens"), F.sum("times").alias("documents"))
    report = listed.join(available, "source", "left").join(got, "source", "left").join(F.broadcast(planned), "source", "left").na.fill(
        0, ["available_tokens", "reached_tokens", "documents"]
    )
    total = F.sum("reached_tokens").over(Window.partitionBy())
    report = report.select(
        "source", "target_share", "max_repeats", "available_tokens", F.round("budget", 3).alias("budget_tokens"), "documents",
        "reached_tokens", F.when(total > 0, F.col("reached_tokens") / total).alias("reached_share"),
    )
    return chosen, report
