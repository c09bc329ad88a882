"""Name to query, with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ledgerlens import testbed
from ledgerlens.bank import Bank
from ledgerlens.registry.views import VIEWS


@dataclass
class Context:
    """What a query may read: the session, the folder of test tables, the bank on them."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def bank(self) -> Bank:
        return testbed.bank_on(self.spark, self.sf_dir)

    def __getitem__(self, table: str) -> DataFrame:
        return self.bank[table]


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``build(context)`` under ``name``; ``sql`` may use any view or other query."""

    def add(build: Callable[[Context], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Context(spark, sf_dir))
        if sql:
            CHECKS[name] = sql
        return build

    return add


def check_sql(name: str) -> str:
    """The check of ``name`` as one statement: the views it needs as CTEs, then the query."""
    known = VIEWS | CHECKS
    ordered: list[str] = []

    def need(sql: str, inside: frozenset[str]) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_]\w*", sql)):
            if word in known and word not in inside and word not in ordered:
                need(known[word], inside | {word})
                ordered.append(word)

    need(CHECKS[name], frozenset({name}))
    if not ordered:
        return CHECKS[name].strip()
    views = ",\n".join(f"{v} AS ({known[v].strip()})" for v in ordered)
    return f"WITH {views}\n{CHECKS[name].strip()}"
