import contextlib
import io
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardrank.session import build_session  # noqa: E402
from wardrank.sources.schema import COMPLICATIONS_SCHEMA, HOSPITALS_SCHEMA  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4, app="wardrank-tests")
    yield s


def hosp(fid, state="AA", ownership="Proprietary", name=None, city="C", htype="Acute Care Hospitals"):
    return (fid, name or f"Hosp {fid}", city, state, htype, ownership)


def comp(fid, measure, score, den, compared="No Different Than the National Rate",
         name=None, mname=None):
    return (fid, name or f"Hosp {fid}", measure, mname or f"name {measure}", compared,
            None if den is None else str(den), None if score is None else str(score))


@pytest.fixture
def tables(spark):
    """Build (complications, hospitals) frames from row tuples."""
    def make(hospital_rows, complication_rows):
        h = spark.createDataFrame(hospital_rows, HOSPITALS_SCHEMA)
        c = spark.createDataFrame(complication_rows, COMPLICATIONS_SCHEMA)
        return c, h
    return make


def plan_text(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()
