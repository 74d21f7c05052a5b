import json

from tidemill.plans import exports


def test_exports_and_reports(spark, small, tmp_path):
    said = exports.export_all(spark, small, str(tmp_path))
    assert set(said) == set(exports.EXPORTS) and all(x["valid"] and x["rows"] > 0 for x in said.values())
    reports = exports.write_reports(spark, small, str(tmp_path / "reports"))
    assert {p.name for p in (tmp_path / "reports").iterdir()} == {"validation.json", "audit.json", "leakage.json"}
    back = json.loads((tmp_path / "reports" / "audit.json").read_text())
    assert back["lines"] == sum(back["field_counts"].values()) == reports["audit"]["lines"]
