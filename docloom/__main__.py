"""spark-submit entry: ``python -m docloom ingest FOLDER STORE KB_ID [--recreate] [--config FILE]`` or ``ask STORE KB_ID QUESTION...``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from docloom import pipeline
from docloom.functions import config as settings
from docloom.operators.segment import FragmentConfig
from docloom.operators.store import Store
from docloom.runtime import ship, sweep


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="docloom")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("folder"), a.add_argument("store"), a.add_argument("kb_id", type=int)
    a.add_argument("--recreate", action="store_true"), a.add_argument("--config")
    b = sub.add_parser("ask")
    b.add_argument("store"), b.add_argument("kb_id", type=int), b.add_argument("questions", nargs="+")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    ship(spark)
    try:
        _run(args, spark)
    finally:
        sweep(spark)


def _run(args: argparse.Namespace, spark: SparkSession) -> None:
    store = Store(spark, args.store)
    if args.what == "ingest":
        s = settings.load(args.config)
        c = pipeline.Config(FragmentConfig(**s["chunker"]), pipeline.TableConfig(s["tables"]["format"], s["tables"]["rows"] != "full_only"), pipeline.ImageConfig(**s["images"]))
        pipeline.ingest(spark, args.folder, store, args.kb_id, config=c, recreate=args.recreate).show(1000, truncate=80)
    else:
        rows = [(i, q, args.kb_id, 8, None) for i, q in enumerate(args.questions, 1)]
        q = spark.createDataFrame(rows, "qid long, question string, kb_id int, k int, threshold double")
        pipeline.ask(q, store.read("chunks"), hybrid=True).show(1000, truncate=200)


if __name__ == "__main__":
    main()
