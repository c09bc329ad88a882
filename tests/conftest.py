import datetime as dt

import pytest

from ledgerlens.bank import Bank
from ledgerlens.schema import TABLES, struct_for
from tests.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(name="ledgerlens-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture
def make_bank(spark):
    """Bank from a few hand-made rows: ``make_bank(cards=[{...}])``; other tables are empty."""

    def build(**tables):
        frames = {}
        for name in TABLES:
            schema = struct_for(name)
            rows = [tuple(row.get(c) for c in schema.names) for row in tables.get(name, [])]
            frames[name] = spark.createDataFrame(rows, schema)
        return Bank.from_frames(spark, frames)

    return build


def day(text):
    return dt.date.fromisoformat(text)


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
