"""Scripts: SQL expressions that are registered once and called by name or digest."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scripts:
    """A catalogue of scripts.  A script is a SQL expression over the columns of the rows it is run on, so it runs
    inside the query like any built-in function; ``:name`` stands for an argument of the call."""

    def __init__(self) -> None:
        self._bodies: dict[str, str] = {}

    def load(self, body: str) -> str:
        digest = hashlib.sha1(body.encode()).hexdigest()
        self._bodies[digest] = body
        return digest

    def exists(self, *digests: str) -> list[bool]:
        return [d in self._bodies for d in digests]

    def flush(self) -> None:
        self._bodies.clear()

    def call(self, digest: str) -> Column:
        if digest not in self._bodies:
            raise KeyError(f"no script with digest {digest}")
        return F.expr(self._bodies[digest])

    def run(self, rows: DataFrame, digest: str, name: str = "result", args: dict | None = None) -> DataFrame:
        """Adds the result of a loaded script as a column; arguments are bound as values, never pasted into the text."""
        if not args:
            return rows.withColumn(name, self.call(digest))
        if digest not in self._bodies:
            raise KeyError(f"no script with digest {digest}")
        body = self._bodies[digest].replace("{", "{{").replace("}", "}}")
        return rows.sparkSession.sql(f"SELECT *, ({body}) AS `{name}` FROM {{rows}}", args=args, rows=rows)

    def eval(self, rows: DataFrame, body: str, name: str = "result", args: dict | None = None) -> DataFrame:
        return self.run(rows, self.load(body), name, args)
