from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortlens.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def no_broadcast(spark):
    """Joins of small tables take the way that large ones take."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.fixture
def frame(spark):
    """A DataFrame from ``frame("a bigint, ts timestamp_ntz", [...])``; instants as text."""

    def build(ddl: str, rows: list[tuple]):
        names = [part.strip().split(" ")[0] for part in _fields(ddl)]
        types = [part.strip().split(" ", 1)[1] for part in _fields(ddl)]
        raw = ", ".join(
            f"{n} {'string' if t in ('timestamp_ntz', 'date') else t}"
            for n, t in zip(names, types, strict=True)
        )
        return spark.createDataFrame(rows, raw).selectExpr(
            *[f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types, strict=True)]
        )

    return build


def _fields(ddl: str) -> list[str]:
    depth, start, parts = 0, 0, []
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    return [*parts, ddl[start:]]


def rows_of(df, *order: str) -> list[tuple]:
    rows = [tuple(r) for r in (df.select(*order) if order else df).collect()]
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
