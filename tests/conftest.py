import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from frameops import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
        # tests sum over all stages so far; the default forgets stages beyond the last thousand
        spark__ui__retainedStages="1000000",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def no_broadcast(spark):
    """Forces the paths taken when no table is small enough to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


@pytest.fixture(scope="session")
def rows():
    def collect(df, *cols):
        return sorted(tuple(row) for row in (df.select(*cols) if cols else df).collect())

    return collect
