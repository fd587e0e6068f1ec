"""Run one analysis on files and store its tables.

    python -m vendaflux synth --out data
    python -m vendaflux cohort  --sales data/vendas --out out/coorte
    python -m vendaflux pareto  --sales data/vendas --out out/pareto
    python -m vendaflux adhoc   --sales data/vendas --out out/adhoc
    python -m vendaflux targets --sales data/vendas --targets data/metas --out out/indicadores

Under ``spark-submit`` the master and the sizes come from the cluster.
"""

from __future__ import annotations

import argparse
from datetime import date

from vendaflux.functions import values as V
from vendaflux.plans import analyses
from vendaflux.plans.session import build_session
from vendaflux.sources import readers, synth, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vendaflux")
    p.add_argument("analysis", choices=("synth", "cohort", "pareto", "adhoc", "targets"))
    p.add_argument("--sales")
    p.add_argument("--targets")
    p.add_argument("--out", required=True)
    p.add_argument("--input-format", default="parquet", choices=("parquet", "csv", "orc"))
    p.add_argument("--format", default="parquet", choices=("parquet", "csv", "orc"))
    p.add_argument("--rows", type=int, default=V.SYNTH_ROWS)
    p.add_argument("--clients", type=int, default=V.SYNTH_CLIENTS)
    p.add_argument("--seed", type=int, default=V.SYNTH_SEED)
    p.add_argument("--master")
    p.add_argument("--as-of", type=date.fromisoformat, help="date of the lifecycle and discount tables")
    p.add_argument("--recurring", action="append", help="a recurring product; may be repeated")
    return p


def main(argv: list[str] | None = None) -> dict[str, str]:
    a = parser().parse_args(argv)
    spark = build_session(a.master)
    if a.analysis == "synth":
        sales = synth.synth_sales(spark, a.rows, a.clients, seed=a.seed)
        return writers.write_results({"vendas": sales, "metas": synth.synth_targets(sales, a.seed)}, a.out, a.format)
    sales = readers.scan_sales(spark, a.sales, a.input_format)
    if a.analysis == "targets":
        tables = analyses.run_gap(sales, readers.scan_targets(spark, a.targets, a.input_format))
    else:
        tables = {"cohort": lambda: analyses.run_cohort(sales, a.as_of, a.recurring), "pareto": lambda: analyses.run_pareto(sales),
                  "adhoc": lambda: analyses.run_adhoc(sales, a.as_of)}[a.analysis]()
    return writers.write_results(tables, a.out, a.format)


if __name__ == "__main__":
    for name, path in main().items():
        print(f"{name}: {path}")
