"""Query catalogue: a Spark plan and, where SQL can say it, an equivalent statement per operator."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from loreweave.plans.tables import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}
CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def plan(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame``; ``uses`` lists shared table expressions of the SQL twin."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = with_tables(uses, sql)
        return fn

    return add


def table(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    CTE[name] = (uses, sql)


def with_tables(uses: tuple[str, ...], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in CTE[name][0]:
                visit(dep)
            order.append(name)

    for name in uses:
        visit(name)
    if not order:
        return body.strip()
    body = body.strip()
    # A table that is read more than once is computed once.
    everything = "\n".join([*(CTE[n][1] for n in order), body])
    often = {n for n in order if len(re.findall(rf"\b{n}\b", everything)) > 1}
    heads = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in often else ''}({CTE[n][1].strip()})" for n in order)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[len('WITH '):]}"
    return f"WITH {heads}\n{body}"
