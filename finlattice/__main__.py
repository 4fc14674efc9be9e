"""python -m finlattice ingest|query|interactive|evaluate PATH ...: a thin command line over the engine."""

from __future__ import annotations

import argparse
import sys

from .plans.engine import Engine
from .session import local_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="finlattice")
    parser.add_argument("command", choices=["ingest", "query", "interactive", "evaluate"])
    parser.add_argument("path", help="folder of the engine's tables")
    parser.add_argument("input", nargs="?", help="Parquet of documents (doc_id, text), questions (question_id, text) or labelled questions (with expected)")
    args = parser.parse_args()
    spark = local_session()
    engine = Engine(spark, args.path)
    if args.command == "interactive":
        for n, line in enumerate(sys.stdin):
            if line.strip():
                print(engine.query(spark.createDataFrame([(n, line.strip())], "question_id long, text string")).toJSON().first())
        return
    if args.input is None:
        parser.error("the command needs an input")
    rows = spark.read.parquet(args.input)
    if args.command == "ingest":
        print(engine.ingest(rows))
    else:
        for row in getattr(engine, args.command)(rows).toJSON().toLocalIterator():
            print(row)


if __name__ == "__main__":
    main()
