"""The queries p1, p2, p3, p4 and p6 with their SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.exprs import NO_KEY
from tidemill.operators import feature_table as ft
from tidemill.operators import heavy_keys, profile, rolling
from tidemill.operators.redelivery import latest_rows
from tidemill.session import table
from tidemill.sources import records

PAIR = ("source_phone", "service_code")


def _held(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest_rows(table(spark, sf_dir, "transactions"), "transaction_code", "loaded_at", columns)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held(spark, sf_dir, *PAIR, "transaction_date", "transaction_amount")
    return rolling.daily_amounts(held, PAIR, "transaction_date", "transaction_amount", last=_last_delivery(spark, sf_dir))


def _last_delivery(spark: SparkSession, sf_dir: str) -> str | None:
    """The day of the last delivery: nothing can have happened after it."""
    last = table(spark, sf_dir, "transactions").agg(F.to_date(F.max("loaded_at"))).first()[0]
    return None if last is None else str(last)


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.backfill(_daily(spark, sf_dir), PAIR)


def p1_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day's state, advanced from the day before by its arrivals and expiring days."""
    daily = rolling.materialize(_daily(spark, sf_dir), "daily-amounts")
    last = daily.agg(F.max("day")).first()[0]
    if last is None:
        return rolling.totals(rolling.state_on(daily, PAIR, "1970-01-01"), PAIR)
    before = str(daily.select(F.date_sub(F.lit(last), 1)).limit(1).first()[0])
    state = rolling.state_on(daily, PAIR, before)
    return rolling.totals(rolling.advance(state, daily, PAIR, str(last)), PAIR)


DAYS_ADVANCED = 3


def p1_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of the last days, kept as versions: loaded, advanced day by day, then corrected.

    Rows delivered before the last day give the state of an earlier day, which is advanced
    to the last; what was delivered since (arrivals, late and re-delivered rows) makes
    signed deltas of daily amounts, and those make new versions of the days they touch.
    """
    columns = ["loaded_at", *PAIR, "transaction_date", "transaction_amount"]
    rows = table(spark, sf_dir, "transactions")
    code = F.col("transaction_code")
    bound = _last_delivery(spark, sf_dir)
    last = latest_rows(rows, "transaction_code", "loaded_at", columns[1:]).agg(F.max(rolling.usable_day("transaction_date", last=bound))).first()[0]
    if last is None:
        return rolling.totals(rolling.state_on(_daily(spark, sf_dir), PAIR, "1970-01-01"), PAIR)
    days = [str(last - timedelta(i)) for i in range(DAYS_ADVANCED, -1, -1)]
    soon = F.coalesce(F.col("loaded_at") < F.lit(days[-1]).cast("timestamp_ntz"), F.lit(True))

    def daily(of: DataFrame) -> DataFrame:
        return rolling.daily_amounts(latest_rows(of, "transaction_code", "loaded_at", columns[1:]), PAIR, "transaction_date", "transaction_amount", last=bound)

    early = rolling.materialize(daily(rows.filter(soon)), "daily-early")
    state = rolling.materialize(rolling.state_on(early, PAIR, days[0]), "state-0")
    states = state
    for day in days[1:]:
        state = rolling.materialize(rolling.advance(state, early, PAIR, day), "state")
        states = states.unionByName(state)
    # Only transactions delivered since can differ; a row without a code is one of its own.
    since = rows.filter(~soon)
    codes = since.select("transaction_code").filter(code.isNotNull()).distinct()
    touched = rolling.materialize(rows.join(codes, "transaction_code", "left_semi").select("transaction_code", *columns)
                                  .unionByName(since.filter(code.isNull()).select("transaction_code", *columns)), "touched")
    plus = daily(touched)
    minus = daily(touched.filter(soon)).withColumns({"units": -F.col("units"), "n": -F.col("n")})
    change = rolling.materialize(plus.unionByName(minus).groupBy(*PAIR, "day").agg(F.sum("units").alias("units"), F.sum("n").alias("n")), "deltas")
    # An entity first delivered since has a state on every day, if only of 0.
    known = early.select(*PAIR, F.lit(1).alias("k")).unionByName(change.select(*PAIR, F.lit(0).alias("k")))
    first = known.groupBy(*PAIR).agg(F.max("k").alias("k")).filter("k = 0").select(*PAIR, F.lit(days[0]).cast("date").alias("day"), F.lit(0).cast("bigint").alias("units"),
                                                  F.lit(0).cast("bigint").alias("n"))
    span = F.col("day") > F.date_sub(F.lit(days[0]).cast("date"), max(rolling.PERIODS))
    fixed = rolling.correct(states, change.filter(span).unionByName(first), PAIR, days[-1], version=1)
    versions = states.unionByName(fixed.filter(F.col("day") >= F.lit(days[0]).cast("date")))
    return rolling.totals(rolling.current(versions, PAIR), PAIR)


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records below the header; one without a line number is none."""
    return table(spark, sf_dir, "raw_lines").filter(F.coalesce(F.col("line_no") != 1, F.lit(True)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.failed_records(_body(spark, sf_dir), "line", ["line_id"]).select("line_id")


def p2_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.failed_records(_body(spark, sf_dir), "line", ["line_id", "batch_no", "line_no"])


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.load_records(_body(spark, sf_dir), "line", ["line_id"])


#: The catalogue of event types: every service and NULL with every partner and NULL.
SERVICES = (*[f"SERVICE_{i:02d}" for i in range(1, 13)], "null")
PARTNERS = (*[f"INS{i:06d}" for i in (3, 4, 7, 11, 14, 18, 21, 25, 26, 30, 33, 38, 41, 42, 47, 52, 56, 60)], "null")
EVENT_TYPES = tuple(f"{s}__{p}" for s in SERVICES for p in PARTNERS)
FEATURE_AMOUNTS = ("transaction_amount", "transaction_fees")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "source_phone", "service_code", "partner_reference", "transaction_date", *FEATURE_AMOUNTS)


def p3_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table over the catalogue of event types; types outside it count as ``other``."""
    return ft.feature_table(_events(spark, sf_dir), "source_phone", ("service_code", "partner_reference"), "transaction_date",
                            FEATURE_AMOUNTS, types=EVENT_TYPES)


def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in long form: a row for every phone and type that occurs."""
    cells = ft.event_cells(_events(spark, sf_dir), "source_phone", ("service_code", "partner_reference"), "transaction_date", FEATURE_AMOUNTS)
    return cells.select(F.when(F.col("k") != NO_KEY, F.col("k")).alias("source_phone"), F.col("t").alias("type"), "n", F.col("last").alias("last_day"),
                        *[(F.col(f"u{i}") / 100.0).alias(c) for i, c in enumerate(FEATURE_AMOUNTS)])


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.load_profiles(table(spark, sf_dir, "staged_rows"), "load_id", records.NAMES,
                                 table(spark, sf_dir, "schema_audit_report"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).filter(F.size("departs") > 0).select(F.col("load_id").cast("int").alias("load_id"), "column_name")


def p4_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).drop("departs", "unlisted_share", "distance", "beyond_share").withColumn("entropy", F.round("entropy", 6))


def p4_after_takeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every column over all loads, after the last load, applied by its delta, was taken back by its negative one."""
    rows = table(spark, sf_dir, "staged_rows")
    last = rows.agg(F.max("load_id")).first()[0]
    newest = rows.filter(F.col("load_id") == F.lit(last))
    kept = profile.maintain(None, profile.load_deltas(rows.filter(~F.col("load_id").eqNullSafe(F.lit(last))), "load_id", records.NAMES), "load_id")
    kept = profile.maintain(kept, profile.load_deltas(newest, "load_id", records.NAMES, kept=kept), "load_id")
    kept = profile.maintain(kept, profile.load_deltas(newest, "load_id", records.NAMES, sign=-1, kept=kept), "load_id")
    p = profile.profiles(profile.over_all_loads(kept), ["column_name"], table(spark, sf_dir, "schema_audit_report"))
    return p.drop("departs", "unlisted_share", "distance", "beyond_share").withColumn("entropy", F.round("entropy", 6))


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held(spark, sf_dir, "source_phone", "destination_phone", "transaction_amount", "transaction_fees")
    sides = ("source_phone", "destination_phone")
    return heavy_keys.per_key_totals(held, sides, ("transaction_amount", "transaction_fees"), keys=table(spark, sf_dir, "transactions").select(*sides))


LATEST_SQL = """held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_code
  ORDER BY loaded_at DESC NULLS LAST, transaction_status DESC NULLS LAST, transaction_fees DESC NULLS LAST) AS rn
  FROM transactions) WHERE rn = 1)"""
_UNITS = "CAST(round({0} * 100) AS HUGEINT)"
_DAILY_SQL = f"""{LATEST_SQL},
daily AS (SELECT source_phone, service_code,
    CASE WHEN year(transaction_date) >= 2020 AND CAST(transaction_date AS DATE) <= coalesce((SELECT CAST(max(loaded_at) AS DATE) FROM transactions), DATE '9999-12-31')
      THEN CAST(transaction_date AS DATE) END AS day,
    coalesce(sum({_UNITS.format('transaction_amount')}), 0) AS units, count(transaction_amount) AS n
  FROM held GROUP BY ALL)"""


_CELLS_SQL = f"""{LATEST_SQL},
cells AS (SELECT source_phone, concat(coalesce(service_code, 'null'), '__', coalesce(partner_reference, 'null')) AS type, count(*) AS n,
    max(CASE WHEN year(transaction_date) >= 2020 THEN CAST(transaction_date AS DATE) END) AS last_day,
    CAST(sum({_UNITS.format('transaction_amount')}) AS DOUBLE) / 100.0::DOUBLE AS transaction_amount,
    CAST(sum({_UNITS.format('transaction_fees')}) AS DOUBLE) / 100.0::DOUBLE AS transaction_fees
  FROM held GROUP BY ALL)"""


def _features_sql() -> str:
    """Every declared type's four columns out of the cells; types outside the catalogue together are ``other``."""
    columns = []
    for t in (*EVENT_TYPES, "other"):
        for kind, value in (("n", "n"), ("last", "last_day"), ("transaction_amount", "transaction_amount"), ("transaction_fees", "transaction_fees")):
            columns.append(f"max(CASE WHEN type = '{t}' THEN {value} END) AS {kind}__{t}")
    listed = ", ".join(f"'{t}'" for t in EVENT_TYPES)
    merged = f"""all_cells AS (SELECT source_phone, CASE WHEN type IN ({listed}) THEN type ELSE 'other' END AS type, sum(n)::BIGINT AS n, max(last_day) AS last_day,
    sum(transaction_amount) AS transaction_amount, sum(transaction_fees) AS transaction_fees FROM cells GROUP BY 1, 2)"""
    return f"WITH {_CELLS_SQL}, {merged} SELECT source_phone, {', '.join(columns)} FROM all_cells GROUP BY source_phone"


# The test of a record, written out from its statement and not from the loader's patterns: (position, name, pattern of the value).
_RECORD_SQL = (
    (0, "transaction_code", "[0-9]+"),
    (1, "service_code", "SERVICE_0[1-9]|SERVICE_1[0-2]"),
    (2, "transaction_status", "VALIDATED|REJECTED|INCOMPLETE|REGISTERED|EXPIRED"),
    (3, "transaction_date__date_part", "[0-9][0-9]/[0-9][0-9]/[0-9][0-9] [0-9][0-9]:[0-9][0-9]:[0-9][0-9]"),
    (4, "transaction_date__fraction_ns", "[0-9]{0,9}"),
    (5, "transaction_amount", "[0-9]+([.][0-9]+)?"),
    (7, "request_date__date_part", "([0-9][0-9]/[0-9][0-9]/[0-9][0-9] [0-9][0-9]:[0-9][0-9]:[0-9][0-9])?"),
    (8, "request_date__fraction_ns", "[0-9]{0,9}"),
    (9, "response_date__date_part", "[0-9][0-9]/[0-9][0-9]/[0-9][0-9] [0-9][0-9]:[0-9][0-9]:[0-9][0-9]"),
    (10, "response_date__fraction_ns", "[0-9]{0,9}"),
    (11, "source_phone", "TEL[0-9]{8}"),
    (12, "destination_phone", "(TEL[0-9]{8})?"),
    (13, "transaction_fees", "([0-9]+([.][0-9]+)?)?"),
    (25, "unclear_position_25", "[0-9]*"),
)


def _fails_sql(p: int, name: str, pattern: str) -> str:
    v = f"v[{p + 1}]"
    said = f"WHEN NOT regexp_full_match({v}, '{pattern}') THEN concat(CASE WHEN {v} = '' THEN 'missing ' ELSE 'invalid ' END, '{name}')"
    if p in (3, 7, 9):
        said += (f" WHEN {v} <> '' AND ({v}[10:11] > '23' OR try_cast(concat('20', {v}[7:8], '-', {v}[4:5], '-', {v}[1:2], {v}[9:]) AS TIMESTAMP) IS NULL)"
                 f" THEN 'no real date in {name}'")
    return said


_LOADS_SQL = f"""split AS (SELECT line_id, batch_no, line_no, line,
    regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^",\\r\\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\\r\\n]*))*') AS quoted,
    list_transform(regexp_extract_all(concat(line, ','), '("(?:[^"]|"")*"|[^",\\r\\n]*),', 1),
      lambda x: CASE WHEN x[1:1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v
  FROM raw_lines WHERE line_no IS DISTINCT FROM 1),
checked AS (SELECT *, CASE WHEN coalesce(line, '') = '' THEN 'no record' WHEN NOT quoted THEN 'broken quoting'
    WHEN len(v) NOT BETWEEN 26 AND 30 THEN concat(len(v), ' values')
    {' '.join(f"WHEN coalesce(v[{p + 1}], '') <> '' THEN 'value at position {p}, after the last column'" for p in range(26, 30))}
    {' '.join(_fails_sql(*x) for x in _RECORD_SQL)} END AS reason FROM split)"""


def _loaded(p: int) -> str:
    value = f"nullif(v[{p + 1}], '')"
    iso = f"CAST(concat('20', v[{p + 1}][7:8], '-', v[{p + 1}][4:5], '-', v[{p + 1}][1:2], v[{p + 1}][9:]) AS TIMESTAMP)"
    if p in records.DATES:
        value = f"CASE WHEN v[{p + 1}] <> '' THEN {iso} + to_microseconds(CAST(coalesce(nullif(v[{p + 2}], ''), '0') AS BIGINT) // 1000) END"
    elif p in (*records.FRACTIONS, *records.WHOLE):
        value = f"try_cast({value} AS BIGINT)"
    elif p in records.NUMBERS:
        value = f"CAST({value} AS DOUBLE)"
    return f"{value} AS {records.NAMES[p]}"


# The audit's patterns, written out: the first that fits the whole value.
_TYPE_SQL = """WHEN regexp_full_match(v, '[0-9]{2}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') THEN 'DATE' WHEN regexp_full_match(v, 'TEL[0-9]+') THEN 'TEL'
    WHEN regexp_full_match(v, 'SERVICE_[0-9]+') THEN 'SERVICE' WHEN regexp_full_match(v, '[0-9]+') THEN 'INT' WHEN regexp_full_match(v, '[0-9]+[.][0-9]+') THEN 'FLOAT'"""
_NAMES_SQL = ", ".join(records.NAMES)
_PROFILE = f"""cells AS (UNPIVOT (SELECT load_id, {', '.join(f"coalesce({c}, '') AS {c}" for c in records.NAMES)} FROM staged_rows /*rows*/)
    ON {_NAMES_SQL} INTO NAME column_name VALUE v),
typed AS (SELECT c.*, CASE WHEN v = '' THEN 'EMPTY' {_TYPE_SQL} ELSE 'OTHER' END AS t, r.* EXCLUDE (column_name, n_nonempty, pct_nonempty, distinct_share),
    r.n_nonempty AS r_n, r.pct_nonempty AS r_pct, r.distinct_share AS r_distinct
  FROM cells c JOIN schema_audit_report r USING (column_name)),
prof AS (SELECT load_id, column_name, count(*) AS n_seen, count(*) FILTER (v <> '') AS n_nonempty,
    100.0::DOUBLE * count(*) FILTER (v <> '') / count(*) AS pct_nonempty,
    {', '.join(f"count(*) FILTER (t = '{t}') AS n_{t.lower()}" for t in profile.TYPES)},
    count(DISTINCT v) FILTER (v <> '') AS n_distinct,
    CASE WHEN count(*) FILTER (v <> '') > 0 THEN (count(DISTINCT v) FILTER (v <> ''))::DOUBLE / (count(*) FILTER (v <> '')) END AS distinct_share,
    min(try_cast(v AS DOUBLE)) FILTER (t IN ('INT', 'FLOAT') AND median_number IS NOT NULL) AS lo,
    quantile_cont(CASE WHEN t IN ('INT', 'FLOAT') AND median_number IS NOT NULL THEN try_cast(v AS DOUBLE) END, 0.5) AS mid,
    max(try_cast(v AS DOUBLE)) FILTER (t IN ('INT', 'FLOAT') AND median_number IS NOT NULL) AS hi,
    count(*) FILTER (t IN ('INT', 'FLOAT') AND (try_cast(v AS DOUBLE) < min_number OR try_cast(v AS DOUBLE) > max_number)) AS n_beyond,
    count(*) FILTER (v <> '' AND NOT list_contains(distinct_values, v)) AS n_unlisted
  FROM typed GROUP BY load_id, column_name),
n AS (SELECT load_id, column_name, v, count(*) AS n FROM cells WHERE v <> '' GROUP BY ALL),
ent AS (SELECT load_id, column_name, log2(sum(n)::DOUBLE) - sum(n * log2(n)) / sum(n) AS entropy FROM n GROUP BY ALL),
known AS (SELECT column_name, e.key AS v, e.value / sum(e.value) OVER (PARTITION BY column_name) AS q
  FROM (SELECT column_name, unnest(map_entries(value_counts)) AS e FROM schema_audit_report WHERE value_counts IS NOT NULL)),
gap AS (SELECT p.load_id, p.column_name, sum(abs(coalesce(n.n, 0) / p.n_nonempty - k.q)) / 2 AS g, sum(coalesce(n.n, 0)) AS n_known
  FROM prof p JOIN known k USING (column_name) LEFT JOIN n ON n.load_id = p.load_id AND n.column_name = p.column_name AND n.v = k.v
  WHERE p.n_nonempty > 0 GROUP BY ALL)"""
_PROFILE_SQL = _PROFILE
_TAKEBACK_SQL = _PROFILE.replace("SELECT load_id, coalesce", "SELECT 0 AS load_id, coalesce", 1).replace(
    "/*rows*/", "WHERE load_id IS DISTINCT FROM (SELECT max(load_id) FROM staged_rows)")

SQL = {
    "p2_found": f"WITH {_LOADS_SQL} SELECT line_id FROM checked WHERE reason IS NOT NULL",
    "p2_rejected": f"WITH {_LOADS_SQL} SELECT line_id, batch_no, line_no, line, reason FROM checked WHERE reason IS NOT NULL",
    "p2_loaded": f"WITH {_LOADS_SQL} SELECT line_id, {', '.join(_loaded(p) for p in range(len(records.NAMES)))} FROM checked WHERE reason IS NULL",
    "p4_found": f"""WITH {_PROFILE_SQL}
SELECT p.load_id, p.column_name FROM prof p JOIN schema_audit_report r USING (column_name)
  LEFT JOIN gap ON gap.load_id = p.load_id AND gap.column_name = p.column_name
WHERE abs(p.pct_nonempty - r.pct_nonempty) > 10 + 1e-9 OR p.n_nonempty > 0 AND ({' OR '.join(
    f"abs(100.0::DOUBLE * n_{t.lower()} / p.n_nonempty - 100.0::DOUBLE * coalesce(r.type_counts['{t}'], 0) / r.n_nonempty) > 8 + 1e-9" for t in profile.TYPES)}
  OR r.distinct_values IS NULL AND (p.distinct_share < r.distinct_share / 2 - 1e-9 OR p.distinct_share > 2 * r.distinct_share + 1e-9)
  OR r.distinct_values IS NOT NULL AND n_unlisted::DOUBLE / p.n_nonempty > 0.05 + 1e-9
  OR r.value_counts IS NOT NULL AND g + (p.n_nonempty - n_known)::DOUBLE / p.n_nonempty / 2 > 0.2 + 1e-9
  OR r.median_number IS NOT NULL AND (mid < r.median_number / 2 - 1e-9 OR mid > 2 * r.median_number + 1e-9
    OR n_int + n_float > 0 AND n_beyond::DOUBLE / (n_int + n_float) > 0.05 + 1e-9))""",
    "p4_after_takeback": f"""WITH {_TAKEBACK_SQL}
SELECT column_name, n_seen, n_nonempty, pct_nonempty, {', '.join(f'n_{t.lower()}' for t in profile.TYPES)}, n_distinct,
  distinct_share, lo AS min_number, mid AS median_number, hi AS max_number, round(entropy, 6) AS entropy
FROM prof LEFT JOIN ent USING (load_id, column_name)""",
    "p4_profiles": f"""WITH {_PROFILE_SQL}
SELECT load_id, column_name, n_seen, n_nonempty, pct_nonempty, {', '.join(f'n_{t.lower()}' for t in profile.TYPES)}, n_distinct,
  distinct_share, lo AS min_number, mid AS median_number, hi AS max_number, round(entropy, 6) AS entropy
FROM prof LEFT JOIN ent USING (load_id, column_name)""",
    "p1_totals": f"""WITH {_DAILY_SQL},
cal AS (SELECT CAST(unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
grid AS (SELECT p.source_phone, p.service_code, cal.day, coalesce(d.units, 0) AS units, coalesce(d.n, 0) AS n
  FROM (SELECT DISTINCT source_phone, service_code FROM daily) p CROSS JOIN cal
  LEFT JOIN daily d ON d.source_phone = p.source_phone AND d.service_code = p.service_code AND d.day = cal.day),
w AS (SELECT source_phone, service_code, day,
    sum(units) OVER w7 AS s7, sum(n) OVER w7 AS n7, sum(units) OVER w30 AS s30, sum(n) OVER w30 AS n30 FROM grid
  WINDOW w7 AS (PARTITION BY source_phone, service_code ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY source_phone, service_code ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT source_phone, service_code, day, CAST(s7 AS DOUBLE) / 100.0::DOUBLE AS sum_7d,
  CASE WHEN n7 > 0 THEN CAST(s7 AS DOUBLE) / 100.0::DOUBLE / CAST(n7 AS DOUBLE) END AS avg_7d,
  CAST(s30 AS DOUBLE) / 100.0::DOUBLE AS sum_30d,
  CASE WHEN n30 > 0 THEN CAST(s30 AS DOUBLE) / 100.0::DOUBLE / CAST(n30 AS DOUBLE) END AS avg_30d FROM w""",
    "p1_latest": f"""WITH {_DAILY_SQL}, edge AS (SELECT max(day) AS last FROM daily),
s AS (SELECT source_phone, service_code, max(last) AS day,
    coalesce(sum(units) FILTER (day BETWEEN last - 6 AND last), 0) AS s7, coalesce(sum(n) FILTER (day BETWEEN last - 6 AND last), 0) AS n7,
    coalesce(sum(units) FILTER (day BETWEEN last - 29 AND last), 0) AS s30, coalesce(sum(n) FILTER (day BETWEEN last - 29 AND last), 0) AS n30
  FROM daily, edge GROUP BY ALL)
SELECT source_phone, service_code, day, CAST(s7 AS DOUBLE) / 100.0::DOUBLE AS sum_7d,
  CASE WHEN n7 > 0 THEN CAST(s7 AS DOUBLE) / 100.0::DOUBLE / CAST(n7 AS DOUBLE) END AS avg_7d,
  CAST(s30 AS DOUBLE) / 100.0::DOUBLE AS sum_30d,
  CASE WHEN n30 > 0 THEN CAST(s30 AS DOUBLE) / 100.0::DOUBLE / CAST(n30 AS DOUBLE) END AS avg_30d FROM s""",
    "p1_corrected": f"""WITH {_DAILY_SQL}, edge AS (SELECT max(day) AS last FROM daily),
days AS (SELECT CAST(unnest(generate_series((last - {DAYS_ADVANCED})::TIMESTAMP, last::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM edge),
s AS (SELECT source_phone, service_code, d AS day,
    coalesce(sum(units) FILTER (day BETWEEN d - 6 AND d), 0) AS s7, coalesce(sum(n) FILTER (day BETWEEN d - 6 AND d), 0) AS n7,
    coalesce(sum(units) FILTER (day BETWEEN d - 29 AND d), 0) AS s30, coalesce(sum(n) FILTER (day BETWEEN d - 29 AND d), 0) AS n30
  FROM daily, days GROUP BY source_phone, service_code, d)
SELECT source_phone, service_code, day, CAST(s7 AS DOUBLE) / 100.0::DOUBLE AS sum_7d,
  CASE WHEN n7 > 0 THEN CAST(s7 AS DOUBLE) / 100.0::DOUBLE / CAST(n7 AS DOUBLE) END AS avg_7d,
  CAST(s30 AS DOUBLE) / 100.0::DOUBLE AS sum_30d,
  CASE WHEN n30 > 0 THEN CAST(s30 AS DOUBLE) / 100.0::DOUBLE / CAST(n30 AS DOUBLE) END AS avg_30d FROM s""",
    "p3_features": _features_sql(),
    "p3_cells": f"WITH {_CELLS_SQL} SELECT * FROM cells",
    "p6_totals": f"""WITH {LATEST_SQL}, u AS (
  SELECT 'source_phone' AS side, source_phone AS key, transaction_amount, transaction_fees FROM held
  UNION ALL SELECT 'destination_phone', destination_phone, transaction_amount, transaction_fees FROM held)
SELECT side, key, count(*) AS n, CAST(coalesce(sum({_UNITS.format('transaction_amount')}), 0) AS DOUBLE) / 100.0::DOUBLE AS total_transaction_amount,
  CAST(coalesce(sum({_UNITS.format('transaction_fees')}), 0) AS DOUBLE) / 100.0::DOUBLE AS total_transaction_fees FROM u GROUP BY ALL""",
}

QUERIES = {f.__name__: f for f in (
    p1_totals, p1_latest, p1_corrected, p2_found, p2_loaded, p2_rejected, p3_features, p3_cells, p4_found, p4_profiles, p4_after_takeback, p6_totals)}
