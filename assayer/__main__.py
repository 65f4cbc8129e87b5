"""Command line: ``python -m assayer run|report|delete-run|clear-anomalies|outliers|sample``."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import logging


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="assayer")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="profile, compare, recommend, repair")
    run.add_argument("--dataset", required=True)
    run.add_argument("--dataset-name")
    run.add_argument("--output-file")
    run.add_argument("--history")
    run.add_argument("--rules", help="a YAML file of rules, or a folder of them")
    run.add_argument("--skip-anomaly-detection", action="store_true")
    run.add_argument("--skip-executor", action="store_true")
    run.add_argument("--apply-non-actionable", action="store_true")
    run.add_argument("--verbose", action="store_true")
    for name in ("report", "outliers", "clear-anomalies", "delete-run"):
        s = sub.add_parser(name)
        s.add_argument("--history", required=True)
        if name in ("outliers", "clear-anomalies", "delete-run"):
            s.add_argument("--dataset-name")
        if name == "outliers":
            s.add_argument("--times", type=float, default=2.0)
            s.add_argument("--delete", action="store_true")
        if name == "delete-run":
            s.add_argument("--run-id", required=True)
        if name in ("clear-anomalies", "delete-run"):
            s.add_argument("--dry-run", action="store_true")
        if name == "report":
            s.add_argument("--limit", type=int, default=10)
    sample = sub.add_parser("sample", help="the first rows of a dataset")
    sample.add_argument("--dataset", required=True)
    sample.add_argument("--output-file", required=True)
    sample.add_argument("--rows", type=int, default=100)
    return p


def main(argv: list[str] | None = None) -> dict:
    args = _parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if getattr(args, "verbose", False) else logging.INFO)
    from pyspark.sql import SparkSession

    from .operators import recommend, reports
    from .plans import pipeline
    from .plans.service import values
    from .sources import files
    from .sources.catalog import load_rules
    from .sources.history import History

    spark = SparkSession.builder.appName("assayer").getOrCreate()
    out: dict = {}
    if args.command == "run":
        more = {"dataset_name": args.dataset_name} if args.dataset_name else {}
        done = pipeline.run_file(
            spark, args.dataset, at=dt.datetime.now(), output=args.output_file, history_root=None if args.skip_anomaly_detection else args.history,
            rules=load_rules(args.rules) if args.rules else None, execute=not args.skip_executor, only_actionable=not args.apply_non_actionable, **more,
        )
        out = {"dataset": values(done.profile.dataset)[0], "issues": done.issues.count(), **values(recommend.summary(done.recommendations))[0]}
        if done.anomalies is not None:
            out["anomalies"] = values(done.anomalies)
        if done.repaired is not None:
            out["results"], out["comparison"] = values(done.repaired.results), values(done.comparison)
    elif args.command == "sample":
        out = {"output": files.save_dataset(files.first_rows(files.load_dataset(spark, args.dataset, focused_only=False), args.rows).drop(files.ROW), args.output_file)}
    else:
        h = History(spark, args.history)
        runs = h.table("profiling_runs")
        if args.command == "report":
            tables = [h.table(t) for t in ("profiling_runs", "column_metrics", "issues", "anomalies")]
            out = {"statistics": values(reports.statistics(*tables))[0], "runs": values(reports.recent(runs, "profiling_timestamp", args.limit)), "issues": values(reports.recent(tables[2], "detected_at", args.limit)), "anomalies": values(reports.recent(tables[3], "detected_at", args.limit)), "stability": values(reports.stability(h.points()))}
        elif args.command == "outliers":
            if args.dataset_name:
                runs = runs.where(runs.dataset_name == args.dataset_name)
            out = {"outliers": values(reports.outlier_runs(runs, args.times, by="dataset_name"))}
            if args.delete:
                out["deleted"] = [h.delete_run(r["run_id"], dataset=r["dataset_name"]) for r in out["outliers"]]
        elif args.command == "clear-anomalies":
            out = {"anomalies": h.clear_anomalies(args.dataset_name, args.dry_run), "dry_run": args.dry_run}
        else:
            out = h.delete_run(args.run_id, args.dry_run, args.dataset_name)
    print(json.dumps(out, default=str, indent=1))
    return out


if __name__ == "__main__":
    main()
