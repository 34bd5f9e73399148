"""Fixed values and defaults shared by all operators."""

# Must equal the reference's for equal results.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MILES_TO_KM = 1.60934
BUCKET_MINUTES = 5          # duration histogram bucket width (minutes)
BUCKET_CAP = 180            # buckets starting strictly above this share the label ">180"
OVER_CAP_LABEL = ">180"
SHORT_TRIP_KM = 3           # short trip: km <= 3, long trip: km > 3
TOP_N_ROUTES = 10
REPORT_YEAR = 2025
LAST_REPORT_MONTH = 6       # daily trend keeps month(pickup_date) < 6
MONTH_LABEL_PREFIX = "Month "
TOPIC_PREFIX = "etl.public."

# Year and month of the trip file that a row comes from.
MONTH_KEYS = ("src_year", "src_month")

# Column names of the trip files.
PICKUP_TS = "tpep_pickup_datetime"
DROPOFF_TS = "tpep_dropoff_datetime"
PU = "PULocationID"
DO = "DOLocationID"

# Engine defaults (not reference values).
# A dimension side is broadcast only when a bounded count proves it has at
# most this many rows; beyond it the join stays a shuffle join.
BROADCAST_MAX_ROWS = 2_000_000
# Largest generated method (bytes of bytecode) HotSpot's JIT compiles.
JIT_METHOD_LIMIT = 8000
# Shuffled bytes that a task of the enriched build takes, and the most shuffle
# partitions it is dealt over (beyond that tasks grow, and their sorts spill).
BUILD_TASK_BYTES = 16 << 20
BUILD_PARTITIONS = 10_000
# Means in reports are presented at this many decimals so that results do
# not depend on the order in which partial sums were combined.
REPORT_DECIMALS = 6
