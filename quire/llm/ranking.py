"""Problem 3: one ranking from several differently scaled scores, by robust rank aggregation."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.plans.prefix import prefix_sums

#: Legs of which the higher score is the better one; of any other leg the lower.
HIGHER_IS_BETTER = ("rerank", "popularity")


def _beta(x: Column, k: int, n: int) -> Column:
    """Probability that the k-th smallest of n uniform values is at most x: the beta(k, n-k+1) distribution."""
    return sum((F.lit(float(comb(n, j))) * F.pow(x, F.lit(float(j))) * F.pow(F.lit(1.0) - x, F.lit(float(n - j))) for j in range(k, n + 1)), F.lit(0.0))


def latest_scores(hits: DataFrame) -> DataFrame:
    """One usable score per (question, chunk, leg): the one logged last, ties to the larger hit_id, then score.

    Null and NaN scores and rows without question, chunk or leg are no scores.
    """
    usable = hits.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("question_id").isNotNull() & F.col("chunk_rowid").isNotNull() & F.col("leg").isNotNull())
    newest = F.struct("logged_at", "hit_id", "score")
    return usable.groupBy("question_id", "chunk_rowid", "leg").agg(F.max(newest)["score"].alias("score"))


def aggregate_ranks(hits: DataFrame, higher_is_better: tuple[str, ...] = HIGHER_IS_BETTER, max_legs: int = 8) -> DataFrame:
    """Rank each question's chunks so that every leg counts equally.

    Per leg, scores become ranks (mean rank of ties) divided by the number of chunks the question has in any
    leg; a chunk that a leg did not return has the normalised rank 1 there.  A chunk's sorted normalised ranks are
    evaluated as beta order statistics; its ``rho`` is the least probability times the number of legs (at most 1),
    and chunks are ranked by rho, then by the mean normalised rank, then by chunk_rowid.

    Result: question_id, chunk_rowid, n_legs (that returned the chunk), rho, mean_rank, position (1 is best).
    An empty table gives an empty result.  More than ``max_legs`` legs in one question raise an error.
    """
    scores = latest_scores(hits).withColumn("key", F.when(F.col("leg").isin(*higher_is_better), -F.col("score")).otherwise(F.col("score")))
    # equal scores are counted first, so ranks come from running sums over distinct scores, however hot a leg is
    tied = scores.groupBy("question_id", "leg", "key").agg(F.count("*").alias("n"))
    tied = prefix_sums(tied, ["question_id", "leg"], ["key"], "n", "upto")
    tied = tied.withColumn("rank", F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).select("question_id", "leg", "key", "rank")
    ranked = scores.join(tied, ["question_id", "leg", "key"])
    size = scores.groupBy("question_id").agg(F.countDistinct("chunk_rowid").alias("n_chunks"), F.countDistinct("leg").alias("legs"))
    per_chunk = ranked.groupBy("question_id", "chunk_rowid").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    per_chunk = per_chunk.join(size, "question_id")
    per_chunk = per_chunk.withColumn("legs", F.when(F.col("legs") > max_legs, F.raise_error(F.lit("more legs than max_legs"))).otherwise(F.col("legs")))
    norm = F.transform("ranks", lambda r: r / F.col("n_chunks"))
    full = F.concat(norm, F.array_repeat(F.lit(1.0), (F.col("legs") - F.size("ranks")).cast("int")))
    per_chunk = per_chunk.withColumn("r", full).withColumn("mean_rank", F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / F.col("legs"), 12))
    rho = None
    for n in range(1, max_legs + 1):
        least = F.array_min(F.array(*[_beta(F.element_at("r", k), k, n) for k in range(1, n + 1)]))
        value = F.least(least * n, F.lit(1.0))
        rho = F.when(F.col("legs") == n, value) if rho is None else rho.when(F.col("legs") == n, value)
    per_chunk = per_chunk.withColumn("rho", F.round(rho, 12))
    best = per_chunk.groupBy("question_id", "rho", "mean_rank", "chunk_rowid").agg(F.max(F.size("ranks")).cast("int").alias("n_legs"), F.lit(1).alias("one"))
    out = prefix_sums(best, ["question_id"], ["rho", "mean_rank", "chunk_rowid"], "one", "position")
    return out.select("question_id", "chunk_rowid", "n_legs", "rho", "mean_rank", F.col("position").cast("int").alias("position"))
