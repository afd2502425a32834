"""Command line: ``python -m quire.cli ingest`` and ``evaluate`` (submit with spark-submit on a cluster)."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.api import Config, ToolError
from quire.operators import evaluation, fulltext, hybrid
from quire.operators.vectors import StubEmbedder, embed
from quire.plans.ingest import Snapshots, ingest_folder
from quire.plans.storage import staged

MODES = ("lexical", "semantic", "hybrid")


def ingest_command(spark: SparkSession, argv: list[str], env: dict[str, str]) -> tuple[int, list[str]]:
    """``--library=DIR --index=DIR [--recursive] [--max-file-mb=N] [--ocr=on|off]``: index a library folder.

    Returns the exit code (1 if a file failed or the three indexes disagree) and the lines of the report.
    """
    recursive = "--recursive" in argv
    config = Config.load([a for a in argv if a != "--recursive"], env)
    index = Snapshots(spark, config.index)
    _, totals = ingest_folder(index, config.library, recursive, config.max_file_mb * 1_000_000, config.ocr)
    t, n = totals.first(), index.counts()
    agree = n["chunks"] == n["vectors"] == n["postings"]
    lines = [f"{t.indexed} indexed, {t.skipped} already present, {t.failed} failed", f"index: {n['chunks']} chunks / {n['postings']} full text / {n['vectors']} vectors" + (" (in agreement)" if agree else " MISMATCH")]
    return int(t.failed > 0 or not agree), lines


def evaluate(index: Snapshots, questions: DataFrame, k: int = 10, modes: tuple[str, ...] = MODES, sweep: bool = False) -> dict[str, DataFrame]:
    """Retrieval quality of an index over a question set (see ``evaluation.load_questions``), all questions in one job a mode.

    Returns metrics by mode, by question type, the questions without ground truth, and with ``sweep`` the metrics of
    every fusion tuning.
    """
    if k < 5 or any(m not in MODES for m in modes):
        raise ToolError("k must be 5 or more, modes lexical, semantic or hybrid")
    tables, maker = index.read(), StubEmbedder()
    asked = staged(questions.select(F.xxhash64("id").alias("question_id"), "question", F.col("type").alias("qtype"), "accept"), "asked")
    wanted = asked.select("question_id", F.explode("accept").alias("a")).select("question_id", "a.source_path", "a.anchor")
    truth = staged(evaluation.ground_truth(wanted, tables["documents"], tables["chunks"]), "truth")
    q = asked.select("question_id", "question").join(embed(asked.select("question_id", F.concat(F.lit(maker.query_prefix), "question").alias("q")), "question_id", "q", maker), "question_id")
    vectors, text_index = tables["vectors"].select("id", "embedding"), fulltext.Index(tables["postings"], stem=True)
    search = lambda mode, depth: hybrid.hybrid_search(tables["chunks"], tables["documents"], vectors, q, depth, mode, index=text_index).select("question_id", "id", "rank")
    ranked = None
    for mode in modes:
        one = search(mode, k).withColumn("mode", F.lit(mode))
        ranked = one if ranked is None else ranked.unionByName(one)
    ranked = staged(ranked, "ranked")
    best = staged(evaluation.first_ranks(ranked, truth, asked, ("mode",)), "best")
    out = {"modes": evaluation.metrics(best, ("mode",)), "types": evaluation.metrics(best, ("mode", "qtype"))}
    first = asked.select("question_id", F.col("accept")[0]["source_path"].alias("source_path"), F.col("accept")[0]["anchor"].alias("anchor"))
    out["unresolvable"] = evaluation.unresolvable(first, tables["documents"], truth)
    if sweep:
        legs = staged(search("lexical", min(50, 2 * k)).withColumn("leg", F.lit("lexical")).unionByName(search("semantic", min(50, 2 * k)).withColumn("leg", F.lit("semantic"))), "legs")
        by = ("fusion_k", "w_lexical", "w_semantic")
        out["sweep"] = evaluation.metrics(evaluation.first_ranks(evaluation.sweep(legs, k), truth, asked, by), by).orderBy(F.desc("mrr"), *by)
    return out


def evaluate_command(spark: SparkSession, argv: list[str]) -> list[str]:
    """``--index=DIR --questions=FILE [--k=N] [--modes=A,B] [--json] [--sweep]``: the lines of the report."""
    flags = dict(a[2:].partition("=")[::2] for a in argv if a.startswith("--"))
    if "index" not in flags or "questions" not in flags or not flags.get("k", "10").isdigit():
        raise ToolError("index and questions are required, k is a whole number")
    modes = tuple(m.strip() for m in flags.get("modes", ",".join(MODES)).split(","))
    got = evaluate(Snapshots(spark, flags["index"]), evaluation.load_questions(spark, flags["questions"]), int(flags.get("k", "10")), modes, "sweep" in flags)
    return [line for df in got.values() for line in evaluation.report(df, "json" in flags)]


def main(argv: list[str], env: dict[str, str]) -> int:
    spark = SparkSession.builder.getOrCreate()
    if argv[:1] == ["ingest"]:
        code, lines = ingest_command(spark, argv[1:], env)
    elif argv[:1] == ["evaluate"]:
        code, lines = 0, evaluate_command(spark, argv[1:])
    else:
        raise ToolError("say ingest or evaluate")
    print("\n".join(lines))
    return code


if __name__ == "__main__":
    import os

    sys.exit(main(sys.argv[1:], dict(os.environ)))
