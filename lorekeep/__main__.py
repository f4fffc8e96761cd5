"""Runs a job of the engine from a shell.

python -m lorekeep evaluate DATASET [PATH] [--mode MODE]   the report of a dataset, with the mock embedder
python -m lorekeep ingest LEDGER TURNS                     uploads of a folder of JSON lines, those that are new there
python -m lorekeep sweep LEDGER [--seconds N]              enriches what is pending, until nothing is or the time is up
python -m lorekeep progress LEDGER                         counts by conversation, dead letters, and the cache's rows

Settings of the enrichment come from the environment: LOREKEEP_VERSION, LOREKEEP_MODEL, LOREKEEP_BATCH_SIZE and so on."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import Enrichment, Mode, from_environment, tuning
from .operators import ledger as L
from .operators.embed import MockEmbedder, rows_by_prefix
from .plans.evaluation import evaluate
from .session import session
from .sources.datasets import READERS, load
from .streaming.ingest import LEDGER, ingest, stored, texts_of
from .streaming.sweep import Sweeper


def sweeper_of(spark: SparkSession, ledger: str, config: Enrichment) -> Sweeper:
    memories = stored(spark, f"{ledger}/memories", LEDGER)
    return Sweeper(spark, ledger, memories, texts_of(spark, ledger, memories), partial(MockEmbedder, config.dims), config)


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lorekeep", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("evaluate")
    one.add_argument("dataset", choices=sorted(READERS))
    one.add_argument("path", nargs="?")
    one.add_argument("--mode", choices=[m.value for m in Mode], default=Mode.HYBRID.value)
    for name in ("ingest", "sweep", "progress"):
        one = commands.add_parser(name)
        one.add_argument("ledger")
        if name == "ingest":
            one.add_argument("turns")
        if name == "sweep":
            one.add_argument("--seconds", type=float, default=50.0)
    args, spark, config = parser.parse_args(arguments), session(), from_environment(Enrichment)
    if args.command == "evaluate":
        how = tuning(args.dataset)
        how = replace(how, search=replace(how.search, mode=args.mode))
        evaluate(load(spark, args.dataset, args.path), how, partial(MockEmbedder, config.dims), config).show(100, False)
    elif args.command == "ingest":
        uploads = spark.readStream.schema(schemas.TURNS).json(args.turns)
        ingest(uploads, args.ledger, f"{args.ledger}/checkpoint").awaitTermination()
        print(stored(spark, f"{args.ledger}/memories", LEDGER).count(), "memories")
    elif args.command == "sweep":
        for wave in sweeper_of(spark, args.ledger, config).run(seconds=args.seconds, pause=0.0):
            print(wave)
    else:
        sweeper = sweeper_of(spark, args.ledger, config)
        L.progress(sweeper.memories, sweeper.events(), config.version).orderBy("conversation_id").show(100, False)
        print(L.dead_letter(sweeper.memories, sweeper.events(), config.version, config.max_attempts).agg(F.count("*")).first()[0], "dead")
        rows_by_prefix(sweeper.cache()).show(100, False)


if __name__ == "__main__":
    main()
