"""Registered queries: a function of (spark, sf_dir) and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, facts: str = ""):
    """Registers a query; facts names the derived tables that its SQL uses."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            from .facts import SQL

            wanted: list[str] = []

            def need(n: str) -> None:
                for d in SQL[n][0]:
                    need(d)
                if n not in wanted:
                    wanted.append(n)

            for n in facts.split():
                need(n)
            parts = [f"{n} AS ({SQL[n][1]})" for n in wanted]
            body = sql.strip()
            if parts and body.upper().startswith("WITH RECURSIVE "):
                body = "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
            elif parts and body.upper().startswith("WITH "):
                body = "WITH " + ", ".join(parts) + ", " + body[5:]
            elif parts:
                body = "WITH " + ", ".join(parts) + " " + body
            ORACLES[name] = body
        return f

    return add
