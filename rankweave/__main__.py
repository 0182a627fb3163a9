"""``python -m rankweave ingest | ask | evaluate | screen``: the operators over files, with lexical retrieval."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import checks, fusion, metrics, structure
from rankweave.operators.experiment import red_team_summary
from rankweave.operators.lexical import build_index
from rankweave.operators.retrieve import hit_preview, lexical_ranker, retrieve
from rankweave.session import local_session
from rankweave.sources import documents, reports


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _corpus(spark: SparkSession, path: str) -> DataFrame:
    chunks = _chunks(spark, path)
    return chunks.select("id", "pos", F.element_at("pages", 1).alias("page"), "path", "text")


def ingest(spark: SparkSession, args: argparse.Namespace) -> str:
    """Pages of editable text to a chunk index; ``--append`` adds chunks whose id is new."""
    chunks = structure.build_chunks(documents.read_editable(spark, args.source), by="doc")
    if args.append:
        documents.append_index(chunks, args.index)
    else:
        documents.rebuild_index(chunks, args.index)
    return reports.markdown_of(structure.chunk_stats(_chunks(spark, args.index)))


def _hits(spark: SparkSession, args: argparse.Namespace, queries: DataFrame) -> DataFrame:
    corpus = _corpus(spark, args.index)
    ranker = lexical_ranker(build_index(corpus.select("id", "pos", "text"), han_bigrams=True))
    return retrieve(queries, corpus, lexical=ranker, mode="bm25", strategy=args.strategy, k=max(args.k))


def ask(spark: SparkSession, args: argparse.Namespace) -> str:
    hits = _hits(spark, args, spark.createDataFrame([("q", args.question)], "qid string, text string"))
    return reports.markdown_of(hits.select("rank", "page", "path", hit_preview(F.col("text")).alias("text")), ["rank"])


def evaluate(spark: SparkSession, args: argparse.Namespace) -> str:
    """Metrics of a question set by k and by type, and what was not found."""
    cases = documents.read_jsonl(spark, args.cases, documents.GOLDEN)
    positive = cases.where((F.col("type") != "negative") & (F.size("gold_chunk_ids") > 0))
    hits = _hits(spark, args, positive.select("qid", F.col("question").alias("text")))
    judged = metrics.judged(hits, positive.select("qid", F.explode("gold_chunk_ids").alias("id")))
    per = metrics.per_query(judged, tuple(args.k)).join(positive.select("qid", "type"), "qid")
    sections = [("By k", metrics.summary(per)), ("By type", metrics.summary(per, ["type"])), ("Not found", metrics.failures(judged)), ("Not reviewed", checks.unreviewed(cases))]
    return reports.report("Retrieval", sections)


def screen(spark: SparkSession, args: argparse.Namespace) -> str:
    """Stored answers (rid, answer, error, seconds) of red-team cases graded by rule."""
    cases = documents.read_jsonl(spark, args.cases, documents.RED_TEAM)
    cases = cases.where(F.col("risk") == args.only) if args.only else cases
    answers = documents.read_jsonl(spark, args.answers, "rid string, answer string, error string, seconds double")
    rows = checks.red_team_screen(cases, answers, _chunks(spark, args.index))
    return reports.report("Screen", [("By risk", red_team_summary(rows)), ("Not passed", rows.where(~F.col("passed")).select("rid", "risk"))])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rankweave", description=__doc__)
    commands = top.add_subparsers(required=True)
    for run, options in ((ingest, ("source", "append")), (ask, ("question", "ranking")), (evaluate, ("cases", "ranking")), (screen, ("cases", "answers", "only"))):
        own = commands.add_parser(run.__name__, help=run.__doc__)
        own.add_argument("--index", required=True)
        own.set_defaults(run=run)
        for name in options:
            if name == "append":
                own.add_argument("--append", action="store_true")
            elif name == "ranking":
                own.add_argument("--strategy", choices=fusion.STRATEGIES, default="baseline")
                own.add_argument("--k", type=int, nargs="+", default=list(metrics.KS if run is evaluate else (fusion.FINAL_K,)))
            else:
                own.add_argument(f"--{name}", required=name != "only")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    text = args.run(spark or local_session(), args)
    print(text)
    return text


if __name__ == "__main__":
    main()
