import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from caselight import schema  # noqa: E402
from caselight.operators.prepare import with_missed  # noqa: E402
from caselight.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("caselight-tests", "local[8]", shuffle_partitions=4, driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_cases(spark):
    """Cases from dicts; columns left out are 0, blank or NULL."""

    def build(*rows):
        defaults = {
            f.name: {"string": "", "int": 0, "bigint": 1}.get(f.dataType.simpleString())
            for f in schema.CASES.fields
        }
        data = [tuple({**defaults, **row}[c] for c in schema.CASE_COLUMNS) for row in rows]
        return with_missed(spark.createDataFrame(data, schema.CASES))

    return build


@pytest.fixture(scope="session")
def small_cases(spark):
    from caselight.sources import star_tables

    return with_missed(star_tables.cases(spark, SMALL))
