"""Entry points: one capture or packet table to a published run, batches, contexts, comparisons."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, load
from .operators import compare, context, distribution, heavy, prefixes, scan
from .operators.flows import between, build_flows
from .sources import capture, runs
from .sources.store import stored


def analyse(packets: DataFrame, config: Config, name: str) -> dict[str, DataFrame]:
    """All tables of a run over packets: flows, windows, labels, ledger, membership, frequencies."""
    spark = packets.sparkSession
    keep = lambda part, build: stored(spark, name, part, build)
    wanted = [{"tcp": 6, "udp": 17}[p] for p in config.flow.protocols]
    flows = keep("flows", lambda: build_flows(packets.where(F.col("protocol").isin(*wanted)), config.flow.inactivity_timeout_seconds))
    anchor = packets.agg(F.min_by("ts", "packet_index")).first()[0] or 0.0  # one value
    windows = scan.scan_windows(flows, config.scan.window_seconds, config.scan.step_seconds, anchor)
    strict = keep("windows", lambda: scan.strict_windows(windows, config.scan.min_syn_to_rst, config.scan.min_targets))
    if config.scan.strict:
        labelled = keep("labelled", lambda: scan.label_flows(flows, scan.scan_sources(strict)))
        if not config.scan.broad:
            labelled = labelled.withColumn("broad_removed", F.col("strict_removed"))
    else:
        labelled = flows.withColumn("strict_removed", F.lit(False)).withColumn("broad_removed", F.lit(False))
    found = heavy.residuals(flows.where("src_n is not null").groupBy(F.col("src_n").alias("ip4")).agg(F.sum("byte_count").alias("w")), config.prefix.percent, lambda df, part: keep(part, lambda: df))
    found = keep("heavy", lambda: found)
    ledger = keep("ledger", lambda: prefixes.ledger(found.select(F.col("prefix").alias("src_prefix"), F.lit(None).cast("string").alias("dst_prefix"))))
    members = keep("members", lambda: prefixes.membership(flows, ledger.where("selected_for_analysis").select("net", "prefix_length", "prefix")))
    counts = distribution.conditions(distribution.frequencies(labelled, members))
    return {"flows": flows, "windows": strict, "labels": labelled.select("flow_id", "strict_removed", "broad_removed"), "heavy": found, "ledger": ledger, "membership": members, "frequencies": counts}


def run(spark: SparkSession, source: str, out: str, config: Config | None = None, start: float | None = None, end: float | None = None, dry_run: bool = False) -> runs.Run | dict:
    """Captures (or a Parquet table of packets) at ``source`` to a published run at ``out``."""
    config = config or Config()
    facts = {"source": source, "config": config.as_dict(), "config_hash": runs.fingerprint(config.as_dict()), "from": start, "to": end}
    if dry_run:
        return facts
    if source.rstrip("/").endswith(".parquet"):
        packets = spark.read.parquet(source)
    else:
        decoded = stored(spark, source, "decoded", lambda: capture.read_captures(spark, source))
        facts["skipped"] = {r.status: r.packets for r in capture.skip_counts(decoded).collect()}  # a row a status
        packets = capture.packets_of(decoded)
    if start is not None or end is not None:
        packets = between(packets, start if start is not None else float("-inf"), end if end is not None else float("inf"))
    return runs.publish(spark, out, analyse(packets, config, f"{source}|{facts['config_hash']}|{start}|{end}"), facts)


def run_batch(spark: SparkSession, ids: list[str], source_of, root: str, config: Config | None = None) -> dict[str, runs.Run | Exception]:
    """A run for each dataset; one that fails doesn't stop the others, and one that is there is loaded."""
    out: dict[str, runs.Run | Exception] = {}
    for i in ids:
        try:
            out[i] = runs.load_run(spark, f"{root}/{i}") if runs.exists(spark, f"{root}/{i}") else run(spark, source_of(i), f"{root}/{i}", config)
        except Exception as e:  # noqa: BLE001  the batch reports it
            out[i] = e
    return out


def one_packet_contexts(made: runs.Run, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tuple and source context of a run's single-packet flows that were kept, each matched to exactly one packet."""
    labelled = made.table("flows").join(made.table("labels"), "flow_id")
    targets = context.checked(context.cohort(labelled), packets)
    syns = packets.where("protocol = 6 and (flags & 2) != 0 and (flags & 16) = 0")
    return context.gaps(context.tuple_context(targets, packets)), context.source_contexts(targets, syns)


def compare_runs(one: runs.Run, other: runs.Run) -> dict[str, DataFrame]:
    """Overlap of two runs' selected prefixes and member flows, and their frequency rows that differ."""
    chosen = lambda r: r.table("ledger").where("selected_for_analysis").select("prefix")
    flows = lambda r: r.table("membership").select("flow_id").distinct()
    return {
        "prefixes": compare.set_overlap(chosen(one), chosen(other)),
        "presence": compare.presence(chosen(one), chosen(other)),
        "flows": compare.set_overlap(flows(one), flows(other)),
        "frequencies": compare.differences(one.table("frequencies"), other.table("frequencies")),
    }


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="flowscape")
    parser.add_argument("command", choices=["run", "inspect", "compare"])
    parser.add_argument("paths", nargs="+", help="run: source and output; inspect: a run; compare: two runs")
    parser.add_argument("--config")
    parser.add_argument("--from", dest="start", type=float)
    parser.add_argument("--to", dest="end", type=float)
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("flowscape").getOrCreate()
    if args.command == "run":
        config = load(runs.read_text(spark, args.config)) if args.config else None
        made = run(spark, args.paths[0], args.paths[1], config, args.start, args.end, args.dry_run)
        print(runs.canonical_json(made if args.dry_run else made.manifest))
    elif args.command == "inspect":
        print(runs.canonical_json(runs.inspect(runs.load_run(spark, args.paths[0]))))
    else:
        for name, df in compare_runs(*[runs.load_run(spark, p) for p in args.paths[:2]]).items():
            print(name)
            df.show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
