"""What a run hands out: three exports as CSV, each validated, and reports as JSON."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.config import DEFAULTS
from tidemill.operators import budget
from tidemill.plans import reference as r
from tidemill.session import scratch, table
from tidemill.sources import audit, files

EXPORTS = {
    "scores": {"transaction_code": "transaction_code", "n_rules": "rules", "is_suspect": "suspect"},
    "customers": {"phone": "client", "score": "score", "band": "band", "because": "factors"},
    "consumption": {"entity": "client", "code": "service_code", "day": "day", "day_total": "day_total", "month_total": "month_total", "day_rate": "day_rate", "month_rate": "month_rate",
                    "day_left": "day_left", "month_left": "month_left", "worst_level": "level"},
}


def latest_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every entity and service the latest day, with its level."""
    return budget.latest_per_key(budget.alerts(r.budget_consumption(spark, sf_dir)), ["entity", "code"], "day")


def export_all(spark: SparkSession, sf_dir: str, out: str, one_file: bool = False) -> dict[str, dict]:
    """Write the exports under ``out`` and say of each whether its columns are as they should be."""
    made = {"scores": r.rule_flags, "customers": r.weighted_scores, "consumption": latest_consumption}
    said = {}
    for name, columns in EXPORTS.items():
        with scratch(spark):
            files.export_csv(made[name](spark, sf_dir), f"{out}/{name}", columns, one_file)
        said[name] = files.validate_export(spark, f"{out}/{name}", list(columns.values()))
    return said


def write_reports(spark: SparkSession, sf_dir: str, out: str) -> dict[str, dict]:
    """The checks, the audit of the raw lines and the leakage checks as JSON files; all are as small as their checks, positions and folds."""
    with scratch(spark):
        checks = {x.check_name: {"failures": x.failures, "passed": x.passed} for x in r.validators_report(spark, sf_dir).collect()}
        checks["offending_codes"] = [x[0] for x in r.offending_amounts(spark, sf_dir).collect()]
        checks["unknown_categories"] = [x[0] for x in r.unknown_categories(spark, sf_dir).limit(1_000).collect()]
        lines = table(spark, sf_dir, "raw_lines").filter(F.coalesce(F.col("line_no") != 1, F.lit(True)))
        reports = {
            "validation": checks,
            "audit": audit.audit_report(lines, "line", "line_id", sf_dir),
            "leakage": {str(x.fold): x.asDict() for x in r.leakage_folds(spark, sf_dir).collect()} | {"embargo_days": DEFAULTS.embargo_days},
        }
    for name, report in reports.items():
        files.write_report(report, os.path.join(out, f"{name}.json"))
    return reports
