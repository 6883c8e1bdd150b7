"""python -m quillmesh build|ingest|query|sql|resolve ...: the engine from a shell."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmesh")
    verbs = parser.add_subparsers(dest="verb", required=True)
    build = verbs.add_parser("build", help="compile parsed documents (JSON, one a line) into a corpus")
    build.add_argument("ir")
    build.add_argument("target")
    build.add_argument("folder")
    ingest = verbs.add_parser("ingest", help="add parsed documents to a corpus")
    ingest.add_argument("ir")
    ingest.add_argument("known")
    ingest.add_argument("target")
    ingest.add_argument("folder")
    ask = verbs.add_parser("query", help="ask a corpus")
    ask.add_argument("folder")
    ask.add_argument("question")
    ask.add_argument("--mode", default="auto")
    sql = verbs.add_parser("sql", help="read-only SQL over a corpus")
    sql.add_argument("folder")
    sql.add_argument("statement")
    resolve = verbs.add_parser("resolve", help="the canonical form of an id")
    resolve.add_argument("token")
    for p in verbs.choices.values():
        p.add_argument("--master", default=None)
    args = parser.parse_args(argv)

    from pyspark.sql import functions as F

    from quillmesh import compile as C
    from quillmesh.engine import Engine
    from quillmesh.functions.ids import normalize_id
    from quillmesh.session import build_session
    from quillmesh.sources.store import Store

    spark = build_session(master=args.master)
    if args.verb == "build":
        C.build(spark, C.load_ir(spark, args.ir), args.target, args.folder)
        out = Engine(spark, args.folder).graph_stats()
    elif args.verb == "ingest":
        C.ingest(spark, Store(spark, args.folder), C.load_ir(spark, args.ir), C.load_ir(spark, args.known), args.target)
        out = Engine(spark, args.folder).graph_stats()
    elif args.verb == "query":
        out = Engine(spark, args.folder).query(args.question, args.mode)
    elif args.verb == "sql":
        out = Engine(spark, args.folder).graph_sql(args.statement)
    else:
        out = spark.range(1).select(normalize_id(F.lit(args.token)).alias("id")).first().id
    json.dump(out, sys.stdout, indent=1, default=str)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
