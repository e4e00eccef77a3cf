"""Statements of the dialect from a file, an argument, or typed one by one."""

from __future__ import annotations

import argparse
import re
import sys

from quillon.plans.session import Session
from quillon.runtime import build_session


def statements(text: str) -> list[str]:
    """The statements of a script: parted by semicolons outside of quotes, comments left out."""
    text = re.sub(r"(?m)^\s*--.*$", "", text)
    return [s.strip() for s in re.findall(r"(?:\"[^\"]*\"|'(?:[^']|'')*'|[^;\"'])+", text) if s.strip()]


def main(arguments: list[str] | None = None) -> int:
    """Run the statements; the exit code is the number that failed."""
    options = argparse.ArgumentParser(prog="quillon", description=__doc__)
    options.add_argument("-e", "--execute", help="statements to run")
    options.add_argument("-f", "--file", help="a script to run")
    options.add_argument("--tables", help="a folder of a saved session")
    options.add_argument("--rows", type=int, default=20, help="rows shown of a result")
    given = options.parse_args(arguments)
    spark = build_session()
    session = Session.load(spark, given.tables) if given.tables else Session(spark)
    if given.file:
        with open(given.file, encoding="utf-8") as script:
            work = statements(script.read())
    else:
        work = statements(given.execute) if given.execute else (line.strip() for line in sys.stdin if line.strip())
    failed = 0
    for statement in work:
        try:
            session.sql(statement).show(given.rows, truncate=60)
        except Exception as problem:
            failed += 1
            print(f"{type(problem).__name__}: {problem}", file=sys.stderr)
    return failed


if __name__ == "__main__":
    sys.exit(main())
