"""Models in SQLite and TOML: relationships, measures, date tables and hidden objects."""

from __future__ import annotations

import json
import sqlite3
import tomllib
from pathlib import Path

from ..errors import QueryError
from .schema import Format, Model

TABLES = """
CREATE TABLE IF NOT EXISTS relationships (from_table TEXT, from_column TEXT, to_table TEXT, to_column TEXT, bidirectional INTEGER, PRIMARY KEY (from_table, from_column, to_table, to_column));
CREATE TABLE IF NOT EXISTS measures (owner TEXT, name TEXT, expression TEXT, format TEXT, PRIMARY KEY (owner, name));
CREATE TABLE IF NOT EXISTS date_tables (name TEXT PRIMARY KEY, date_column TEXT);
CREATE TABLE IF NOT EXISTS hidden (owner TEXT, name TEXT);
"""


def _quoted(v: str) -> str:
    return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f")


def to_toml(model: Model) -> str:
    """The same model always gives the same text."""
    lines: list[str] = []

    def section(head: str, /, **values) -> None:
        lines.append(head)
        for k, v in values.items():
            if v is not None:
                lines.append(f"{k} = {str(v).lower() if isinstance(v, bool) else v if isinstance(v, int) else _quoted(v)}")
        lines.append("")

    for r in sorted(model.relationships, key=lambda r: (r.from_table, r.from_column, r.to_table, r.to_column)):
        section("[[relationship]]", from_table=r.from_table, from_column=r.from_column, to_table=r.to_table, to_column=r.to_column, bidirectional=r.bidirectional)
    for m in sorted(model.measures.values(), key=lambda m: (m.table, m.name)):
        section("[[measure]]", table=m.table, name=m.name, expression=m.text)
        if m.format:
            lines.pop()
            section("[measure.format]", kind=m.format.kind, decimals=m.format.decimals, currency=m.format.currency)
    for t, c in sorted(model.date_tables.items()):
        section("[[date_table]]", table=t, column=c)
    for t, n in sorted(model.hidden, key=lambda h: (h[0], h[1] or "")):
        section("[[hidden]]", table=t, name=n)
    return "\n".join(lines)


def load_toml(model: Model, text: str) -> Model:
    """A copy of `model` with the relationships, measures, date tables and hidden objects of the text in place of its own. All or nothing."""
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise QueryError("resolve", f"not a model file: {e}") from e
    new = model.copy()
    new.relationships, new.measures, new.date_tables, new.hidden = [], {}, {}, set()
    if unknown := set(found) - {"relationship", "measure", "date_table", "hidden"}:
        raise QueryError("resolve", f"unknown sections in the model file: {', '.join(sorted(unknown))}")
    try:
        for r in found.get("relationship", []):
            new.relate(r["from_table"], r["from_column"], r["to_table"], r["to_column"], r.get("bidirectional", False))
        for m in found.get("measure", []):
            new.add_measure(m["table"], m["name"], m["expression"], Format(**m["format"]) if "format" in m else None)
        for d in found.get("date_table", []):
            new.set_date_table(d["table"], d["column"])
        new.hidden = {(new.table(h["table"]).name, h.get("name")) for h in found.get("hidden", [])}
    except KeyError as e:
        raise QueryError("resolve", f"an entry of the model file lacks {e}") from e
    return new


class Store:
    """A model's metadata in a SQLite file."""

    def __init__(self, path: str | Path) -> None:
        self.db = sqlite3.connect(path)
        self.db.executescript(TABLES)

    def save(self, model: Model) -> None:
        """In one transaction."""
        with self.db:
            for t in ("relationships", "measures", "date_tables", "hidden"):
                self.db.execute(f"DELETE FROM {t}")
            self.db.executemany("INSERT INTO relationships VALUES (?, ?, ?, ?, ?)", [(r.from_table, r.from_column, r.to_table, r.to_column, r.bidirectional) for r in model.relationships])
            self.db.executemany("INSERT INTO measures VALUES (?, ?, ?, ?)", [(m.table, m.name, m.text, json.dumps(m.format.__dict__) if m.format else None) for m in model.measures.values()])
            self.db.executemany("INSERT INTO date_tables VALUES (?, ?)", list(model.date_tables.items()))
            self.db.executemany("INSERT INTO hidden VALUES (?, ?)", list(model.hidden))

    def load(self, model: Model) -> tuple[Model, list[str]]:
        """A copy of `model` with what is stored; and what no longer fits its tables, which is left out."""
        new, lost = model.copy(), []

        def attempt(what: str, do) -> None:
            try:
                do()
            except QueryError as e:
                lost.append(f"{what}: {e.message}")

        for f, fc, t, tc, both in self.db.execute("SELECT * FROM relationships"):
            attempt(f"{f}[{fc}] - {t}[{tc}]", lambda: new.relate(f, fc, t, tc, bool(both)))  # noqa: B023
        for owner, name, text, format in self.db.execute("SELECT * FROM measures"):
            attempt(f"{owner}[{name}]", lambda: new.add_measure(owner, name, text, Format(**json.loads(format)) if format else None))  # noqa: B023
        for name, column in self.db.execute("SELECT * FROM date_tables"):
            attempt(f"{name}[{column}]", lambda: new.set_date_table(name, column))  # noqa: B023
        new.hidden = {(o, n) for o, n in self.db.execute("SELECT * FROM hidden") if new.find_table(o) is not None}
        return new, lost
