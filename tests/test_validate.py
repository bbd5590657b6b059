import pytest

from tabguard.errors import PlanError, TableError
from tabguard.operators import anomaly, profile, report, validate
from tabguard.plans.expressions import compile_expression
from tabguard.sources.files import load

FAULTS = {"gst": (5, 13, 21), "pan": (9, 25), "email": (7, 16), "phone": (29,)}
CITIES = ("Pune", "Delhi", "Mumbai", "Chennai", "Kochi")


@pytest.fixture(scope="module")
def ledger(table):
    """Fifty vendors with seeded faults; row numbers count the header."""
    rows = []
    for i in range(50):
        row = i + 2
        pan = f"ABCD{chr(65 + i % 26)}{1000 + i}{chr(65 + i // 26)}"
        r = {
            "vendor_id": f"VND-{i + 1:04d}",
            "gstin": f"27{pan}1Z{i % 10}",
            "pan": pan,
            "email": f"vendor{i}@example.com",
            "phone": f"9{100000000 + i * 7}",
            "city": CITIES[i % 5],
            "amount": 5000.0 + 1777.0 * (i * 13 % 50),
            "invoice_date": f"2026-{1 + i % 12:02d}-{1 + i % 28:02d}",
        }
        if row in FAULTS["gst"]:
            r["gstin"] = r["gstin"].lower()
        if row in FAULTS["pan"]:
            r["pan"] = "BAD"
        if row in FAULTS["email"]:
            r["email"] = "nobody"
        if row in FAULTS["phone"]:
            r["phone"] = "12345"
        if row == 11:
            r["email"] = None
        if row == 19:
            r["amount"] = 9750000.0
        if row == 31:
            r["vendor_id"] = "VENDOR_30"
        if row == 40:
            r["city"] = "Ranchi"
        rows.append(r)
    rows[45] = dict(rows[12])  # rows 14 and 47 are the same
    rows[46] = {**rows[20], "city": rows[20]["city"] + "x"}  # row 48 is nearly row 22
    return table(list(rows[0]), [list(r.values()) for r in rows])


def found(df, rule, column=None):
    return sorted(r["row"] for r in df.collect() if r["rule_name"] == rule and column in (None, r["column"]))


def test_seeded_faults(ledger):
    got = validate.validate(ledger).cache()
    assert found(got, "format_gst") == [5, 13, 21]
    assert found(got, "format_pan") == [9, 25]
    assert found(got, "format_email") == [7, 16]
    assert found(got, "format_phone") == [29]
    assert found(got, "missing_value", "email") == [11]
    assert found(got, "duplicate_row") == [14, 47]
    assert found(got, "duplicate_id", "pan") == [14, 22, 47, 48]
    keys = [(r["row"], r["column"]) for r in got.collect()]
    assert keys == sorted(keys)


def test_anomalies(ledger):
    got = anomaly.detect_anomalies(ledger, 0.05).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r["kind"], []).append(r)
    assert [r["row"] for r in kinds["column_outlier"] if r["columns"] == ["amount"]] == [19]
    assert [r["row"] for r in kinds["pattern_break"] if r["columns"] == ["vendor_id"]] == [31]
    assert any("Ranchi" in r["reason"] for r in kinds["rare_category"])
    assert any({r["row"]} <= {22, 48} and r["columns"] == ["city"] for r in kinds["near_duplicate"])
    assert 19 in [r["row"] for r in kinds["multivariate_outlier"]]
    assert all(0 <= r["confidence"] <= 1 for r in got)


def test_sensitivity_bounds(ledger):
    for s in (0, 0.5, -1):
        with pytest.raises(TableError):
            anomaly.detect_anomalies(ledger, s)


def test_profile(ledger):
    got = {r["name"]: r for r in profile.profile(ledger).collect()}
    assert len(got) == 8
    assert (got["gstin"]["detected_format"], got["gstin"]["inferred_type"]) == ("gst", "id")
    assert got["email"]["null_rate"] == 0.02
    assert got["amount"]["inferred_type"] == "number" and got["amount"]["max_num"] == 9750000.0
    assert got["invoice_date"]["inferred_type"] == "date"
    assert got["city"]["inferred_type"] == "categorical" and len(got["city"]["top_values"]) == 5


def test_explicit_rules(table):
    df = table(["k", "v", "r"], [["a", "1", "x"], ["A ", "5", "y"], ["a", "oops", None], ["", "-3", "Z"]])
    rules = {"required": ["k", "no"], "ranges": {"v": {"min": 0, "max": 4}}, "unique": ["k"], "references": {"r": ["X", "y"]}, "auto": False}
    got = validate.validate(df, rules)
    assert found(got, "required_field") == [5] and found(got, "required_column") == [1]
    assert found(got, "range") == [3, 5]
    assert found(got, "unique") == [2, 4]
    assert found(got, "reference") == [5]
    long = {"references": {"r": ["x", "y", *map(str, range(2000))]}, "auto": False}
    assert found(validate.validate(df, long), "reference") == [5]


def test_expressions(table):
    df = table(["a", "b"], [[1.0, 2.0], [None, 1.0], [3.0, 1.0]])
    rows = lambda e: [r["_row"] for r in df.filter(compile_expression(df, e)).collect()]
    assert rows("a > 0") == [2, 4]
    assert rows("a != 1") == [3, 4]
    assert rows("a + b >= 3 and not b == 2") == [4]
    assert rows("(a > 2) | (b > 1)") == [2, 4]
    for bad in ("__import__('os')", "a.b > 1", "a > ", "c > 1", "a", "[a][0] > 1", "a if b else a"):
        with pytest.raises(PlanError):
            compile_expression(df, bad)


def test_broken_expression_is_a_warning(table):
    df = table(["a"], [[1]])
    got = validate.validate(df, {"expressions": [{"name": "e", "expr": "nope > 1"}], "auto": False}).collect()
    assert [(r["row"], r["severity"]) for r in got] == [(1, "warning")]


def test_unknown_rulesets_and_keys():
    with pytest.raises(TableError, match="kyc"):
        validate.resolve_ruleset("nope")
    with pytest.raises(TableError, match="required"):
        validate.resolve_ruleset({"need": []})
    assert validate.list_rulesets({"mine": {}})[-1] == "mine"


def test_empty_table(table):
    df = table(["a", "b"], [["x", 1]]).filter("false")
    assert validate.validate(df).count() == 0
    assert anomaly.detect_anomalies(df).count() == 0
    assert {r["null_rate"] for r in profile.profile_columns(df).collect()} <= {None, 0.0}


def test_health(spark):
    findings = spark.createDataFrame([(2, "a", "missing_value", "w", "", None), (3, "a", "format_pan", "e", "", None), (3, "b", "unique", "e", "", None), (4, "b", "range", "e", "", None)], validate.FINDING)
    flags = spark.createDataFrame([(2, "column_outlier", 0.9, "", ["a"])], anomaly.FLAG)
    got = report.health_score(10, findings, flags).first()
    # 10 percent each: 0.4 + 0.3 + 0.2 + 0.8 points a percent
    assert got["score"] == 83
    assert {r["category"]: r["deduction"] for r in got["breakdown"]} == {"missing": 4.0, "format": 3.0, "duplicate": 2.0, "outlier": 8.0}
    assert report.health_score(0, findings, flags).first()["score"] == 100
    marks = {(r["row"], r["column"]): r["category"] for r in report.highlights(findings, flags).collect()}
    assert marks == {(2, "a"): "outlier", (3, "a"): "format", (3, "b"): "duplicate"}


def test_report(spark, ledger, tmp_path):
    path = report.export_report(ledger, str(tmp_path / "r.xlsx"), "kyc")
    assert float(load(spark, path, "summary", infer=False).first()["score"]) < 100
    assert load(spark, path, "data").count() == 50
    assert load(spark, path, "issues").filter("rule_name = 'duplicate_row'").count() == 2


def test_report_sheets_are_complete(spark, table, tmp_path, monkeypatch):
    import re
    import zipfile

    from tabguard.sources import files

    monkeypatch.setattr(report, "MOST_DATA_ROWS", 50)
    df = table(["email", "n"], [[f"no mail {i}" if i % 3 else f"u{i}@example.com", i] for i in range(300)])
    path = report.export_report(df, str(tmp_path / "r.xlsx"), {"formats": {"email": "email"}, "auto": False})
    data = files.load(spark, path, "Data", infer=False).orderBy("_row").collect()
    assert len(data) == 51 and "first 50 of 300 rows" in data[-1]["row_number"]
    issues = files.load(spark, path, "Issues", infer=False)
    assert issues.count() == 200 and issues.columns == ["_row", "row", "column", "rule_name", "severity", "reason", "value"]
    summary = files.load(spark, path, "Summary", infer=False).first()
    assert (summary["rows"], summary["issues"]) == ("300", "200")
    assert [r["category"] for r in files.load(spark, path, "Working").orderBy("_row").collect()] == list(report.WEIGHTS)
    with zipfile.ZipFile(path) as book:
        sheet, styles = book.read("xl/worksheets/sheet1.xml").decode(), book.read("xl/styles.xml").decode()
    marked = re.findall(r'<c s="(\d+)" t="inlineStr"><is><t xml:space="preserve">(no mail \d+)', sheet)
    # near-duplicates win over formats
    style = {k: str(i) for i, k in enumerate(report.FILLS, 2)}
    assert len(marked) == 33 and {s for s, _ in marked} <= {style["format"], style["duplicate"]} and report.FILLS["format"] in styles


def test_reconciliation_report(spark, table, tmp_path):
    from tabguard.operators.reconcile import run_profile
    from tabguard.sources import files

    a = table(["id", "amount", "who"], [["1", 10.0, "x"], ["2", 20.0, "y"], ["3", 30.0, "z"], ["9", 1.0, "q"]])
    b = table(["id", "amount", "who"], [["1", 10.0, "x"], ["2", 25.0, "w"], ["4", 40.0, "v"], ["3", 30.01, "z"]])
    result = run_profile(a, b, {"name": "monthly", "keys": ["id"], "tolerance": {"numeric": 0.05}})
    path = report.export_reconciliation(result, str(tmp_path / "r.xlsx"), "monthly")
    read = lambda s: files.load(spark, path, s, infer=False)
    said = {r["label"]: r["value"] for r in read("Summary").collect()}
    assert said.items() >= {"matched": "2", "discrepancies": "1", "match_rate": "0.5", "profile": "monthly", "L1": "1", "L2": "1", "amount": "5.0"}.items()
    found = read("Discrepancies").orderBy("field")
    assert [(r["a.id"], r["field"], r["value_a"], r["value_b"], r["diff_abs"]) for r in found.collect()] == [("2", "amount", "20.0", "25.0", "5.0"), ("2", "who", "y", "w", None)]
    assert read("Matched").count() == 2 and [r["id"] for r in read("Only-in-B").collect()] == ["4"] and [r["id"] for r in read("Only-in-A").collect()] == ["9"]
    none = run_profile(a, a, {"keys": ["id"]})
    path = report.export_reconciliation(none, str(tmp_path / "s.xlsx"))
    assert read("Discrepancies").count() == 0 and read("Matched").count() == 4


def test_quantiles_as_sorted_values(spark):
    import random

    from tabguard.operators.quantiles import quantiles

    r = random.Random(3)
    for n in (1, 2, 3, 10, 11, 500, 30000):
        rows = [(r.choice([r.gauss(0, 1), float(r.randrange(5)), None]), None, 7.0) for _ in range(n)] + [(1.0, None, 7.0)]
        df = spark.createDataFrame(rows, "a double, b double, c double")
        got = quantiles(df, ["a", "b", "c"], [0.05, 0.25, 0.5, 1.0])
        x = sorted(v for v, *_ in rows if v is not None)
        at = [s * (len(x) - 1) for s in (0.05, 0.25, 0.5, 1.0)]
        assert got["b"] is None and got["c"] == [7.0] * 4
        assert got["a"] == pytest.approx([x[int(i)] + (x[min(int(i) + 1, len(x) - 1)] - x[int(i)]) * (i - int(i)) for i in at])
