"""Command line: detect, obfuscate, restore, analyze and profile CSV files."""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.errors import ConfigError
from sablefin.functions.patterns import PatternSet, load_patterns, save_patterns
from sablefin.operators import score
from sablefin.plans.api import Sablefin
from sablefin.sources import tables


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sablefin", description=__doc__)
    verbs = out.add_subparsers(dest="verb", required=True)
    for name in ("detect", "obfuscate", "restore", "analyze", "profile"):
        verb = verbs.add_parser(name)
        verb.add_argument("file")
        verb.add_argument("--key", default="id", help="column that tells rows apart")
        verb.add_argument("--output", help="where to write; rows are shown otherwise")
        verb.add_argument("--format", choices=["json", "csv", "parquet"], default="json")
        verb.add_argument("--patterns", help="JSON file of rules")
        verb.add_argument("--columns", help="names, separated by commas; obfuscate and restore take all columns but the key without them")
        verb.add_argument("--dictionary", help="folder of the tokens' dictionary (Parquet): obfuscate adds to it, restore needs it")
        verb.add_argument("--rows", type=int, default=10_000, help="rows to sample")
        verb.add_argument("--dry-run", action="store_true")
    return out


def kept_dictionary(spark: SparkSession, folder: str | None) -> DataFrame | None:
    """The dictionary of earlier calls, if the folder has one."""
    try:
        return spark.read.parquet(folder) if folder else None
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """Do what the arguments say and return the result's rows."""
    args = parser().parse_args(argv)
    rules = load_patterns(args.patterns) if args.patterns and args.verb != "detect" else None
    library = Sablefin(spark, rules)
    df = tables.csv(spark, args.file)
    columns = args.columns.split(",") if args.columns else None
    if args.verb == "detect":
        found = library.detect(df, args.key, args.rows)
        if args.patterns:
            kinds = {r.pattern_type for r in found.select("pattern_type").collect()}
            save_patterns(PatternSet(p for p in library.patterns if p.pattern_type in kinds), args.patterns)
    elif args.verb == "obfuscate":
        known = kept_dictionary(spark, args.dictionary)
        found, tokens = library.obfuscate(df, args.key, columns, known)
        if args.dictionary and not args.dry_run:
            # What is kept stays as it is, so that files of earlier calls can be restored; only new originals are added.
            fresh = tokens if known is None else tokens.join(known.select("original"), "original", "left_anti").select(*known.columns)
            fresh.write.mode("append").parquet(args.dictionary)
    elif args.verb == "restore":
        if not args.dictionary:
            raise ConfigError("restore needs --dictionary")
        found = library.restore(df, args.key, columns or [c for c in df.columns if c != args.key], spark.read.parquet(args.dictionary))
    elif args.verb == "analyze" and args.dry_run:
        seconds, cost = score.dry_run(F.count("*"), len(columns or df.columns))
        found = df.agg(seconds.alias("estimated_time_seconds"), cost.alias("estimated_cost_usd"))
    elif args.verb == "analyze":
        found = library.analyse(df, args.key, columns)
    else:
        found = library.profile(df, args.key, columns)
    if args.output and not args.dry_run:
        if args.verb == "obfuscate" and args.format != "parquet":
            found = found.withColumn("tokens_used", F.array_join("tokens_used", ","))
        tables.write(found, args.output, args.format)
    return found


def main(argv: list[str] | None = None) -> None:
    import sys

    spark = SparkSession.builder.appName("sablefin").getOrCreate()
    run(spark, sys.argv[1:] if argv is None else argv).show(50, truncate=False)


if __name__ == "__main__":
    main()
