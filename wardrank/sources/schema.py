"""Domain constants and the raw-to-canonical column mapping.

The two inputs are a facility dimension (``hospitals``) and a long fact table
of per-facility quality measures (``complications``).  Raw files keep the
publisher's header names (with spaces and a slash); everything inside the
library uses the snake_case names on the right-hand side of the mappings.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the values used by the analyses we reproduce
# (measure codes, sentinel strings, comparison classes, ownership recode,
# chart labels, thresholds).  Do not edit them to make a result change.
# ---------------------------------------------------------------------------
MORTALITY_MEASURES = (
    "MORT_30_AMI",
    "MORT_30_HF",
    "MORT_30_PN",
    "MORT_30_STK",
    "MORT_30_COPD",
)
MEASURE_LABELS = {
    "MORT_30_AMI": "Heart Attack",
    "MORT_30_COPD": "COPD",
    "MORT_30_HF": "Heart Failure",
    "MORT_30_PN": "Pneumonia",
    "MORT_30_STK": "Stroke",
}
SENTINELS = ("Not Available", "Not Applicable")

WORSE = "Worse Than the National Rate"
BETTER = "Better Than the National Rate"
NO_DIFFERENT = "No Different Than the National Rate"
NOT_AVAILABLE = "Not Available"

# ownership recode, first match wins; anything else falls to the default
OWNERSHIP_RULES = (
    ("like", "%Veterans%", "VA"),
    ("like", "%non-profit%", "Non-profit"),
    ("eq", "Proprietary", "For-profit"),
)
OWNERSHIP_DEFAULT = "Government"
OWNERSHIP_GROUPS = ("VA", "Non-profit", "For-profit", "Government")
VETERANS_PATTERN = "%Veterans%"

MIN_MEASURES = 4          # facility composite needs at least 4 of 5 measures
MIN_STATE_HOSPITALS = 10  # state ranking
MIN_STATE_CHART = 5       # state chart
MIN_OWNER_HOSPITALS = 40  # ownership ranking
MIN_PATIENTS = 25         # recommendation eligibility
TOP_FACILITIES = 20
TOP_STATES = 15
TOP_RECOMMEND = 5
PREVIEW_ROWS = 3
VOLUME_BAND_EDGE = 500    # "small hospital" volume edge in total patients
# ---------------------------------------------------------------------------

# words of hospital names that name no system, and words before a patron's name
GENERIC_NAME_WORDS = (
    "HOSPITAL", "HOSPITALS", "MEDICAL", "CENTER", "CENTRE", "HEALTH", "HEALTHCARE", "CARE", "SYSTEM",
    "REGIONAL", "COMMUNITY", "MEMORIAL", "GENERAL", "UNIVERSITY", "COUNTY", "DISTRICT", "CITY", "STATE",
    "THE", "OF", "AND", "&", "AT", "FOR",
)
DEDICATION_WORDS = ("ST", "SAINT", "SAINTS", "STS")

# raw header -> canonical name
HOSPITAL_COLUMNS = {
    "Facility ID": "facility_id",
    "Facility Name": "facility_name",
    "City/Town": "city",
    "State": "state",
    "Hospital Type": "hospital_type",
    "Hospital Ownership": "ownership",
}
COMPLICATION_COLUMNS = {
    "Facility ID": "facility_id",
    "Facility Name": "facility_name",
    "Measure ID": "measure_id",
    "Measure Name": "measure_name",
    "Compared to National": "compared",
    "Denominator": "denominator",
    "Score": "score",
}

HOSPITALS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in HOSPITAL_COLUMNS.values()]
)
COMPLICATIONS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in COMPLICATION_COLUMNS.values()]
)

# typed score: exact (never binary float), up to six decimals
SCORE_TYPE = T.DecimalType(18, 6)


def all_string_schema(header: list[str]) -> T.StructType:
    """Explicit all-string schema for a CSV header (no type sniffing)."""
    return T.StructType([T.StructField(h, T.StringType(), True) for h in header])
