"""wardrank: facility mortality analytics on Spark.

Inputs are two tables: a facility dimension (``hospitals``) and a long fact
table of per-facility quality measures (``complications``).  Everything is
plain DataFrame code; see the sub-packages:

* ``sources``   — CSV ingest, Parquet tables, catalog, test fixture
* ``functions`` — sentinel-safe casts, exact aggregates, labels
* ``operators`` — cleaning, facility/group metrics, ranking / top-k
* ``plans``     — the analyses and recommendations, the query registry
* ``streaming`` — incremental load of CSV drops into the stored tables
"""

from .operators.clean import clean_mortality, eligible_rows
from .plans import recommend, reports
from .session import build_session
from .sources.files import load_tables, read_complications_csv, read_hospitals_csv, save_tables

__all__ = [
    "build_session", "clean_mortality", "eligible_rows", "load_tables",
    "read_complications_csv", "read_hospitals_csv", "recommend", "reports", "save_tables",
]
