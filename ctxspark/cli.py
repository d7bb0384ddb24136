"""Command line: run a script or read statements until a semicolon."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ctxspark.plans.session import Engine, Result


def _cell(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "1" if x else "0"
    return format(x, ".15g") if isinstance(x, float) else str(x)


def show(r: Result) -> str:
    """name=value pairs joined by a bar, a line per row."""
    if r.df is None:
        return r.message
    return "\n".join(" | ".join(f"{n}={_cell(v)}" for n, v in zip(r.df.columns, row)) for row in r.rows())


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ctxspark")
    p.add_argument("--db", default="ctxspark.db")
    p.add_argument("--file")
    p.add_argument("--transpile-only", action="store_true")
    p.add_argument("--verbose", action="store_true")
    a = p.parse_args(argv)
    engine = Engine(SparkSession.builder.appName("ctxspark").getOrCreate(), a.db)

    def run(text: str) -> None:
        if a.transpile_only:
            print(engine.transpile(text))
            return
        for r in engine.execute(text):
            print(show(r))
            if a.verbose:
                print("\n".join(f"-- {n}" for n in engine.report.notes))

    if a.file:
        with open(a.file, encoding="utf-8") as f:
            run(f.read())
        return 0
    held = ""
    for line in sys.stdin:
        if line.strip() in (".begin", ".commit", ".rollback", ".exit"):
            if line.strip() == ".exit":
                break
            getattr(engine, line.strip()[1:])()
            continue
        held += line
        if ";" in line:
            try:
                run(held)
            except ValueError as e:
                print(f"error: {e}")
            held = ""
    return 0


if __name__ == "__main__":
    sys.exit(main())
