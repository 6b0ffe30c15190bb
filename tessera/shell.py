"""A shell: statements from standard input, results as text.

    python -m tessera.shell [FOLDER]

A statement ends with a semicolon and may take several lines; lines that begin with a dot are commands.
FOLDER's Parquet tables are attached under their names. An error is told and the next statement runs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from pathlib import Path

from . import session
from .sources.catalog import Database, render
from .sources.sql_text import DialectError, statements


def whole_statements(lines: Iterable[str]) -> Iterator[str]:
    """Commands and statements, each as soon as its last line is there; what is not ended at the end too."""
    held = ""
    for line in lines:
        if not held.strip() and line.startswith("."):
            yield line.strip()
            continue
        held += line
        if line.rstrip().endswith(";"):
            try:
                statements(held)
            except DialectError:  # the semicolon stands within a text that goes on
                continue
            yield held
            held = ""
    if held.strip():
        yield held


def run(db: Database, lines: Iterable[str], show=print) -> None:
    for text in whole_statements(lines):
        try:
            if text.startswith("."):
                found = db.command(text)
                if found is None:
                    return
                show("\n".join(found))
            else:
                for result in db.run_script(text):
                    show(render(result))
        except Exception as error:  # whatever a statement breaks, the shell goes on
            show(f"Error: {str(error).splitlines()[0]}")


def main() -> None:
    spark = session.build(spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    db = Database(spark)
    for folder in sys.argv[1:]:
        for path in sorted(Path(folder).glob("*.parquet")):
            db.attach(path.stem, session.table(spark, folder, path.stem))
    try:
        run(db, sys.stdin)
    finally:
        db.close()


if __name__ == "__main__":
    main()
