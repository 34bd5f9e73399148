"""Command line: run the batch job, show a report, ask SQL, run a stream.

  python -m tripstats list
  python -m tripstats report <name> <sf_dir> [--rows N]
  python -m tripstats sql <text> <sf_dir> [--param name=value ...] [--rows N]
  python -m tripstats batch <sf_dir> <warehouse> [--months 2,2026-03]
  python -m tripstats batch-files <trip_folder> <zone_csv> <warehouse> [--months 2,2026-03]
  python -m tripstats stream <topic> <folder> <target> <checkpoint> [--reset] [--kafka servers]

``--months`` reloads only those months (see ``plans.batch.run``); without it
every month file of the folder is loaded.  ``sql`` runs on the named views
of ``plans.views``.  ``stream`` runs once over all that the topic (a folder
of JSON records, or a Kafka topic) holds beyond the checkpoint; ``--reset``
lets a new checkpoint replace a target that another one has written.

``sf_dir`` is a folder of the benchmark tables (trips are projected from
them); ``trip_folder`` holds monthly ``yellow_tripdata_YYYY-MM.parquet``
files.  The master comes from ``spark-submit`` / ``SPARK_MASTER`` (local[*]
when unset).
"""
from __future__ import annotations

import argparse
import os
import sys


def _month(text: str) -> int | tuple[int, int]:
    year, dash, month = text.rpartition("-")
    return (int(year), int(month)) if dash else int(month)


def _value(text: str) -> int | float | str:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tripstats")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    commands = {"report": ["name", "sf_dir"], "sql": ["text", "sf_dir"], "batch": ["sf_dir", "warehouse"],
                "batch-files": ["trip_folder", "zone_csv", "warehouse"],
                "stream": ["topic", "folder", "target", "checkpoint"]}
    for name, arguments in commands.items():
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        if name in ("report", "sql"):
            c.add_argument("--rows", type=int, default=40)
        if name == "sql":
            c.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
        if name.startswith("batch"):
            c.add_argument("--months", type=lambda t: [_month(m) for m in t.split(",")])
        if name == "stream":
            c.add_argument("--reset", action="store_true")
            c.add_argument("--kafka", metavar="SERVERS")
    return p


def run(spark, a: argparse.Namespace) -> None:
    """One command on a session."""
    from tripstats.plans import batch, catalog, views
    if a.cmd == "report":
        catalog.queries()[a.name](spark, a.sf_dir).show(a.rows, truncate=False)
    elif a.cmd == "sql":
        views.catalog_views(spark, a.sf_dir)
        args = {name: _value(value) for name, _, value in (p.partition("=") for p in a.param)}
        views.run_query(spark, a.text, args).show(a.rows, truncate=False)
    elif a.cmd == "stream":
        from tripstats.sources.messages import folder_record_stream, kafka_record_stream
        from tripstats.streaming.rollup_streams import start_rollup_stream, stream_session
        session = stream_session(spark, a.topic)
        records = (kafka_record_stream(session, a.kafka, a.folder) if a.kafka
                   else folder_record_stream(session, a.folder))
        query, target = start_rollup_stream(records, a.topic, a.target, a.checkpoint,
                                            on_other="reset" if a.reset else "refuse")
        query.awaitTermination()
        target.read(spark).show(truncate=False)
    else:
        if a.cmd == "batch":
            trips, zones = catalog.trips(spark, a.sf_dir), catalog.zones(spark, a.sf_dir)
        else:
            from tripstats.operators.enrich import enrich_trips
            from tripstats.sources.files import read_zone_csv, scan_monthly_trips
            trips = scan_monthly_trips(spark, a.trip_folder, a.months, clean=enrich_trips)
            zones = read_zone_csv(spark, a.zone_csv)
        for name, path in batch.run(spark, trips, zones, a.warehouse, a.months, cleaned=a.cmd == "batch-files").items():
            print(f"{name}\t{path}")


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.cmd == "list":
        from tripstats.plans.catalog import queries
        print("\n".join(sorted(queries())))
        return 0
    from tripstats.session import build_session
    spark = build_session(os.environ.get("SPARK_MASTER"))   # None: spark-submit's or local[*]
    run(spark, a)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
