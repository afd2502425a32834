"""Problem 9: mix sources to target weights, by budgets cut from distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import wordpunct_count
from quire.plans.prefix import prefix_sums
from quire.plans.storage import staged


def _targets(targets: DataFrame) -> DataFrame:
    return targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def _small(targets: DataFrame, rows: int = 100_000) -> DataFrame:
    """The per-source table, broadcast only if it has at most so many rows."""
    return F.broadcast(targets) if targets.count() <= rows else targets


def sized(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, tokens) of the documents whose source has a target; null and empty texts have 0 tokens."""
    docs = documents.select("doc_id", "source", F.coalesce(wordpunct_count(F.col("text")), F.lit(0)).cast("long").alias("tokens"))
    return docs.join(_small(_targets(targets).select("source")), "source", "left_semi")


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its size, its wanted tokens, what max_repeats allows, and the budget (the less of both).

    Shares are of the size of all documents whose source has a target.  A source that cannot reach its share has
    ``short`` true; a target without documents is short unless its share is 0.
    """
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("docs"))
    t = _targets(targets).join(have, "source", "left").na.fill(0, ["size", "docs"])
    t = t.withColumn("wanted", F.col("target_share") * F.lit(total)).withColumn("allowed", F.col("max_repeats").cast("long") * F.col("size"))
    return t.withColumn("short", F.col("allowed") < F.col("wanted")).withColumn("budget", F.least(F.col("wanted"), F.col("allowed").cast("double")))


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Choose documents, whole epochs and a last part of one, so that each source fills its budget.

    Documents of a source are put in the order of hash-random keys by a range sort; running token sums cut that
    order at the exact budget, after as many whole epochs as fit.  A document is taken into the last part if it
    ends within the budget.  Documents without source or tokens are never taken.

    Returns (mixture, report): doc_id, source, tokens, repeats and source, target_share, max_repeats, size,
    taken_tokens, reached_share, short.
    """
    sizes = staged(sized(documents, targets), "sizes")
    plan = staged(budgets(sizes, targets), "budgets")
    keyed = sizes.filter(F.col("tokens") > 0).withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    keyed = prefix_sums(keyed, ["source"], ["key", "doc_id"], "tokens", "upto")
    b = plan.select("source", "budget", F.col("size").alias("source_size"))
    epochs = F.floor(F.col("budget") / F.col("source_size")).cast("int")
    rest = F.col("budget") - epochs * F.col("source_size")
    chosen = keyed.join(_small(b), "source").withColumn("repeats", epochs + F.when(F.col("upto") <= rest, 1).otherwise(0))
    mixture = staged(chosen.filter(F.col("repeats") > 0).select("doc_id", "source", "tokens", "repeats"), "mixture")
    taken = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("taken_tokens"))
    report = plan.join(taken, "source", "left").na.fill(0, ["taken_tokens"])
    whole = report.agg(F.coalesce(F.sum("taken_tokens"), F.lit(0))).first()[0]
    share = F.col("taken_tokens") / F.lit(float(max(whole, 1)))
    report = report.select("source", "target_share", "max_repeats", "size", "taken_tokens", share.alias("reached_share"), "short")
    return mixture, report
