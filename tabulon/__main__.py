"""python -m tabulon FOLDER [QUERY FILE]: query a folder of Parquet files, from a file or line by line (a blank line runs what was typed)."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import QueryError
from .model.store import load_toml


def show(engine: Engine, text: str) -> None:
    try:
        found = engine.execute(text)
    except QueryError as e:
        print(f"error: {e}")
        return
    for row in found["rows"]:
        print("\n".join(f"  {c}: {v}" for c, v in zip(found["columns"], row, strict=True)), end="\n\n")
    if not found["rows"]:
        print("(no results)")


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("tabulon").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark)
    for p in sorted(Path(args[0]).glob("*.parquet")):
        engine.add_parquet(p.stem, str(p))
    if (model := Path(args[0]) / "model.toml").exists():
        engine._model = load_toml(engine.model, model.read_text())
    if len(args) > 1:
        show(engine, Path(args[1]).read_text())
        return 0
    typed: list[str] = []
    for line in sys.stdin:
        if line.strip():
            typed.append(line)
        elif typed:
            show(engine, "".join(typed))
            typed = []
    if typed:
        show(engine, "".join(typed))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
