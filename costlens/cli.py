"""Command line: run registered analyses on a folder of parquet tables.

    python -m costlens.cli list
    python -m costlens.cli run cost_ratio_sweep --sf /root/testdata/sf0.01 --show 20
    python -m costlens.cli run evaluate_full --sf DIR --out results/eval --log results/runs

``--out`` writes the full result as parquet (overwrite); ``--log`` appends a
one-row result as (run_id, experiment, kind, key, value) rows to a run table
partitioned by experiment.
"""

from __future__ import annotations

import argparse
import sys
import uuid


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="costlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered queries")
    run = sub.add_parser("run", help="run one registered query")
    run.add_argument("name")
    run.add_argument("--sf", required=True, help="folder with the parquet tables")
    run.add_argument("--show", type=int, default=20)
    run.add_argument("--out")
    run.add_argument("--log")
    run.add_argument("--cpus", default=None)
    args = ap.parse_args(argv)

    from costlens.plans import registry

    if args.cmd == "list":
        orc = registry.oracle_sql()
        for name in registry.queries():
            print(f"{name}\t{'sql-checked' if name in orc else 'rows-only'}")
        return 0

    from costlens.session import get_spark

    spark = get_spark("costlens-cli", cpus=args.cpus)
    q = registry.queries().get(args.name)
    if q is None:
        print(f"unknown query {args.name}; see `list`", file=sys.stderr)
        return 2
    df = q(spark, args.sf)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    if args.log:
        from costlens.operators.runlog import commit_run, metrics_long

        numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "long", "integer", "float")]
        rec = df.select(*[f"`{c}`" for c in numeric]).limit(2)
        if rec.count() != 1:
            print("--log needs a one-row result", file=sys.stderr)
            return 2
        run_id = uuid.uuid4().hex[:12]
        commit_run([metrics_long(rec, run_id, args.name)], args.log, run_id, args.name)
    df.show(args.show, truncate=False)
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
