"""Target permit schema and the source-name maps of the two feed formats."""

from __future__ import annotations

from pyspark.sql import types as T

# Target table, in column order.  Dates are city wall-clock values, hence
# TIMESTAMP_NTZ: there is no instant to resolve and no DST gap to fail on.
PERMIT_SCHEMA = T.StructType(
    [
        T.StructField("dig_ticket_number", T.StringType()),
        T.StructField("permit_number", T.StringType()),
        T.StructField("request_date", T.TimestampNTZType()),
        T.StructField("dig_date", T.TimestampNTZType()),
        T.StructField("expiration_date", T.TimestampNTZType()),
        T.StructField("is_emergency", T.BooleanType()),
        T.StructField("street_name", T.StringType()),
        T.StructField("street_direction", T.StringType()),
        T.StructField("street_number_from", T.LongType()),
        T.StructField("street_number_to", T.LongType()),
        T.StructField("street_suffix", T.StringType()),
        T.StructField("dig_location", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("contact_first_name", T.StringType()),
        T.StructField("contact_last_name", T.StringType()),
    ]
)
PERMIT_COLUMNS = [f.name for f in PERMIT_SCHEMA.fields]
KEY = "dig_ticket_number"

# Audit columns added when rows are stored (UTC wall clock, NTZ).
AUDIT_COLUMNS = ["created_at", "updated_at"]

DATE_COLUMNS = ["request_date", "dig_date", "expiration_date"]
INT_COLUMNS = ["street_number_from", "street_number_to"]
FLOAT_COLUMNS = ["latitude", "longitude"]
TEXT_COLUMNS = [
    "dig_ticket_number",
    "permit_number",
    "street_name",
    "street_direction",
    "street_suffix",
    "dig_location",
    "contact_first_name",
    "contact_last_name",
]

# --- fixed values: source field names -> target names -----------------------
# Bulk CSV export header (upper case) and incremental API feed (lower case).
CSV_FIELD_NAMES = {
    "DIG_TICKET#": "dig_ticket_number",
    "PERMIT#": "permit_number",
    "REQUESTDATE": "request_date",
    "DIGDATE": "dig_date",
    "EMERGENCY": "is_emergency",
    "STNAME": "street_name",
    "DIRECTION": "street_direction",
    "STNOFROM": "street_number_from",
    "STNOTO": "street_number_to",
    "SUFFIX": "street_suffix",
    "PLACEMENT": "dig_location",
    "LATITUDE": "latitude",
    "LONGITUDE": "longitude",
    "EXPIRATIONDATE": "expiration_date",
    "PRIMARYCONTACTFIRST": "contact_first_name",
    "PRIMARYCONTACTLAST": "contact_last_name",
}
API_FIELD_NAMES = {
    "dig_ticket_": "dig_ticket_number",
    "permit_": "permit_number",
    "requestdate": "request_date",
    "digdate": "dig_date",
    "emergency": "is_emergency",
    "stname": "street_name",
    "direction": "street_direction",
    "stnofrom": "street_number_from",
    "stnoto": "street_number_to",
    "suffix": "street_suffix",
    "placement": "dig_location",
    "latitude": "latitude",
    "longitude": "longitude",
    "expirationdate": "expiration_date",
    "primarycontactfirst": "contact_first_name",
    "primarycontactlast": "contact_last_name",
}
# Text values read as "emergency = yes"; anything else, null included, is no.
EMERGENCY_TRUE_VALUES = ["true", "t", "yes", "y", "1"]

# Columns a feed must carry to be usable (the 13 checked by the feed probe).
REQUIRED_COLUMNS = [
    "dig_ticket_number",
    "permit_number",
    "request_date",
    "dig_date",
    "expiration_date",
    "is_emergency",
    "street_name",
    "street_direction",
    "street_number_from",
    "street_suffix",
    "dig_location",
    "latitude",
    "longitude",
]
# ---------------------------------------------------------------------------
