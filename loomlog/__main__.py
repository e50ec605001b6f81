"""``python -m loomlog dump PATH [-o json|xml] [--to FOLDER]``: the events of logs, printed or written as text parts."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import export
from .sources import container


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomlog")
    commands = parser.add_subparsers(dest="command", required=True)
    dump = commands.add_parser("dump")
    dump.add_argument("path")
    dump.add_argument("-o", "--output", choices=("json", "xml"), default="json")
    dump.add_argument("--to")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("loomlog dump").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    events = container.read_events(spark, args.path).orderBy("file", "chunk_index", "record_seq")
    lines = export.result_json(events.drop("ticks")) if args.output == "json" else events.select("xml")
    if args.to:
        lines.write.text(args.to)
    else:
        for row in lines.toLocalIterator():
            print(row[0], end="\n" if args.output == "json" else "")


if __name__ == "__main__":
    main()
