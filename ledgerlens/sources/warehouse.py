"""Full-table extract from a remote SQL warehouse over JDBC."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.schema import KEYS

# Connections that read one table at a time.
DEFAULT_PARTITIONS = 16
# Environment variables that hold the connection.
ENV_URL = "BANK_WAREHOUSE_URL"
ENV_USER = "BANK_WAREHOUSE_USER"
ENV_PASSWORD = "BANK_WAREHOUSE_PASSWORD"


@dataclass(frozen=True)
class KeyRange:
    """Bounds of the numeric key along which a table is read in parallel."""

    low: int
    high: int
    partitions: int


@dataclass(frozen=True)
class Warehouse:
    """JDBC connection; credentials never appear in code or in ``repr``."""

    url: str
    user: str
    password: str
    fetch_size: int = 10_000

    def __repr__(self) -> str:
        return f"Warehouse(url={self.url!r})"

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Warehouse:
        missing = [k for k in (ENV_URL, ENV_USER, ENV_PASSWORD) if not env.get(k)]
        if missing:
            raise KeyError(f"set {', '.join(missing)}")
        return cls(env[ENV_URL], env[ENV_USER], env[ENV_PASSWORD])

    def options(self, table: str, key_range: KeyRange | None = None) -> dict[str, str]:
        """Reader options for ``table``; with a key range the read is split into partitions.

        Bounds only set the stride: rows outside them still arrive, in the first or last partition.
        """
        options = {
            "url": self.url,
            "user": self.user,
            "password": self.password,
            "dbtable": table,
            "fetchsize": str(self.fetch_size),
        }
        if key_range:
            options |= {
                "partitionColumn": KEYS[table.lower()],
                "lowerBound": str(key_range.low),
                "upperBound": str(key_range.high),
                "numPartitions": str(key_range.partitions),
            }
        return options

    def bounds_query(self, table: str) -> str:
        """Query that lets the warehouse answer the key range itself."""
        key = KEYS[table.lower()]
        return f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}"

    def key_range(self, spark: SparkSession, table: str, partitions: int) -> KeyRange | None:
        options = {k: v for k, v in self.options(table).items() if k != "dbtable"}
        reader = spark.read.format("jdbc").options(**options)
        row = reader.option("query", self.bounds_query(table)).load().first()
        if row is None or row[0] is None:
            return None
        return KeyRange(int(row[0]), int(row[1]), partitions)

    def quantiles_query(self, table: str, key: str, partitions: int) -> str:
        """Query for the lowest key of each of ``partitions`` parts with equally many rows."""
        parts = f"SELECT {key} AS k, NTILE({partitions}) OVER (ORDER BY {key}) AS part FROM {table}"
        return f"SELECT MIN(k) AS low FROM ({parts} WHERE {key} IS NOT NULL) t GROUP BY part ORDER BY 1"

    def balanced_predicates(
        self, spark: SparkSession, table: str, partitions: int, key: str | None = None
    ) -> list[str]:
        """One predicate per range of ``key`` with about equally many rows, see :func:`predicates`."""
        key = key or KEYS[table.lower()]
        options = {k: v for k, v in self.options(table).items() if k != "dbtable"}
        reader = spark.read.format("jdbc").options(**options)
        lows = reader.option("query", self.quantiles_query(table, key, partitions)).load().collect()
        return predicates(key, [row[0] for row in lows])

    def read_balanced(
        self,
        spark: SparkSession,
        table: str,
        partitions: int = DEFAULT_PARTITIONS,
        key: str | None = None,
    ) -> DataFrame:
        """Lazy frame over the whole table, read in ranges that hold about equally many rows.

        The warehouse sorts its keys once to tell the ranges apart, so this suits keys that bunch
        up, texts, and tables that are worth it. Rows of one key value stay together.
        """
        return spark.read.jdbc(
            self.url,
            table,
            predicates=self.balanced_predicates(spark, table, partitions, key),
            properties={"user": self.user, "password": self.password, "fetchsize": str(self.fetch_size)},
        )

    def read(
        self, spark: SparkSession, table: str, partitions: int = DEFAULT_PARTITIONS
    ) -> DataFrame:
        """Lazy frame over the whole table; filters and columns are pushed to the warehouse.

        The table is read in ``partitions`` equally wide ranges of its key; one asks for no key
        range. Where keys bunch up, :meth:`read_balanced` cuts them by their number.
        """
        span = self.key_range(spark, table, partitions) if partitions > 1 else None
        return spark.read.format("jdbc").options(**self.options(table, span)).load()


def predicates(key: str, lows: Sequence[int | Decimal | str]) -> list[str]:
    """Conditions of which every row meets exactly one, from the lowest keys of ranges in order.

    The first range has no lower end and the last no upper end, so rows that arrive meanwhile are
    read, too. Rows without a key have a condition of their own. Equal lows make one range, and a
    table without keys has only the two ends.
    """
    cuts = [_literal(low) for low in dict.fromkeys(lows)][1:]
    if not cuts:
        return [f"{key} IS NOT NULL", f"{key} IS NULL"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{key} < {cuts[0]}", *inner, f"{key} >= {cuts[-1]}", f"{key} IS NULL"]


def _literal(value: int | Decimal | str) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (int, Decimal)) and not isinstance(value, bool):
        return f"{value:f}" if isinstance(value, Decimal) else str(value)
    raise TypeError(f"keys of type {type(value).__name__} cannot be cut into ranges")
