"""python -m neargrain LINES HIERARCHY FOLDER [--from STEP] [--to STEP]: steps of a run over text files.

Each step leaves its tables in FOLDER; a later call can start from them.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from neargrain.plans import STEPS, Run, Settings
from neargrain.sources import numbered_lines, parse_edges, parse_multilabel


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="neargrain", description="Steps of a multi-label classification run.")
    parser.add_argument("lines", help="text files of `label, label word:tf word:tf ...`")
    parser.add_argument("hierarchy", help="text files of `parent child`")
    parser.add_argument("folder", help="where steps leave their tables")
    parser.add_argument("--from", dest="first", choices=STEPS, default="prune")
    parser.add_argument("--to", dest="last", choices=STEPS, default="evaluate")
    parser.add_argument("--header", type=int, default=1, help="lines to skip at the start")
    parser.add_argument("--queries", type=int, default=-1, help="validation documents to score; -1: all")
    parser.add_argument("-k", type=int, default=Settings.k)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    corpus = parse_multilabel(numbered_lines(spark, given.lines, given.header), strict=False)
    run = Run(corpus, parse_edges(spark.read.text(given.hierarchy)), Settings(k=given.k, queries=given.queries), f"header {given.header}")
    run.steps(given.folder, given.first, given.last)
    if given.last == "evaluate":
        run.score.show(truncate=False)


if __name__ == "__main__":
    main()
