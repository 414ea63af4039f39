"""Command line: run SQL from ``-c``, a file or standard input, and print the results.

    python -m relspark.cli -d /data -c "SELECT 1 AS one"
"""

from __future__ import annotations

import argparse
import sys
from typing import TextIO

from relspark.engine import Engine, SQLResult
from relspark.session import session

#: Rows fetched for printing; larger results are for files and tables, not terminals.
SHOWN = 10_000


def format_table(columns: list[str], rows: list[tuple]) -> str:
    """A box-drawn table with a row count."""
    cells = [[("NULL" if v is None else str(v)) for v in r] for r in rows]
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(columns)]

    def rule(left: str, middle: str, right: str) -> str:
        return left + middle.join("─" * (w + 2) for w in widths) + right

    def line(values: list[str]) -> str:
        return "│" + "│".join(f" {v.ljust(w)} " for v, w in zip(values, widths, strict=True)) + "│"

    body = [rule("┌", "┬", "┐"), line(columns), rule("├", "┼", "┤"), *map(line, cells), rule("└", "┴", "┘")]
    return "\n".join(body) + f"\n({len(rows)} row{'' if len(rows) == 1 else 's'})"


def show(result: SQLResult, out: TextIO, as_json: bool = False) -> None:
    if as_json:
        print(result.to_json(), file=out)
    elif result.data is not None:
        rows = result.data.limit(SHOWN + 1).collect()
        print(format_table(result.columns, [tuple(r) for r in rows[:SHOWN]]), file=out)
        if len(rows) > SHOWN:
            print(f"(only the first {SHOWN} are shown)", file=out)
    else:
        print(result.message or f"{result.rows_affected} rows affected", file=out)


def read_sql(args: argparse.Namespace, stdin: TextIO) -> str:
    """The SQL to run: ``-c`` comes before ``-s``, which comes before standard input."""
    if args.command is not None:
        return args.command
    if args.script is not None:
        with open(args.script, encoding="utf-8") as f:
            return f.read()
    return stdin.read()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="relspark", description="Run SQL on a data folder.")
    p.add_argument("-c", "--command", help="SQL text to run")
    p.add_argument("-s", "--script", help="file of SQL to run")
    p.add_argument("-d", "--data", default="./data", help="data folder")
    p.add_argument("-u", "--use", help="database to use")
    p.add_argument("--json", action="store_true", help="print results as JSON")
    p.add_argument("--master", help="Spark master")
    return p


def main(argv: list[str] | None = None, stdin: TextIO = sys.stdin, out: TextIO = sys.stdout, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        text = read_sql(args, stdin)
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if not text.strip():
        parser().print_help(out)
        return 2
    engine = Engine(spark or session(args.master), args.data)
    try:
        if args.use:
            engine.use(args.use)
        show(engine.sql(text), out, args.json)
    except Exception as e:  # whatever Spark or the engine says goes to the user
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
