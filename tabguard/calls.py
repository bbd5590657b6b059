"""Queries that make whole calls: files, profiles, validation, reconciliation, names, reports.

As in queries.py, each has a SQL twin over the same tables.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard import queries as q
from tabguard.functions import similarity
from tabguard.functions.text import ROW
from tabguard.operators import anomaly, clean, entity, profile, recipe, reconcile, report, risk, validate
from tabguard.operators.graph import shared_folder
from tabguard.plans import planner
from tabguard.plans.query_plan import execute_plan
from tabguard.queries import VENDOR_SQL, query, read, vendors
from tabguard.sources import files
from tabguard.streaming import quality_stream


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few results of a call on the driver as a frame."""
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- files

_CUSTOMER = "SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query(_CUSTOMER)
def source_csv(spark, d):
    path = files.write(read(spark, d, "customer"), scratch(spark, "customer.csv"))
    return files.load(spark, path).drop(ROW)


@query("SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation")
def source_tsv(spark, d):
    path = files.write(read(spark, d, "nation"), scratch(spark, "nation.tsv"))
    return files.load(spark, path).drop(ROW)


@query(_CUSTOMER.replace("SELECT", "SELECT c_custkey + 2 AS row_no,"))
def source_xlsx(spark, d):
    path = files.write(read(spark, d, "customer").orderBy("c_custkey"), scratch(spark, "customer.xlsx"))
    return files.load(spark, path, "Sheet1").withColumnRenamed(ROW, "row_no")


@query("SELECT c_custkey::DOUBLE AS k, 'line one' || chr(10) || 'says \"' || c_name || '\"; and' AS note FROM customer")
def source_csv_long_cells(spark, d):
    rows = read(spark, d, "customer").selectExpr("c_custkey AS k", "concat('line one\n', 'says \"', c_name, '\"; and') AS note")
    return files.load(spark, files.write(rows, scratch(spark, "notes.csv"))).drop(ROW)


@query("SELECT * FROM (VALUES (2::BIGINT, 1::BIGINT, 'a', 1.5::DOUBLE, true), (3, 2, NULL, 2.0, NULL), (4, NULL, '7', NULL, false)) AS t(row_no, k, v, x, ok)")
def source_values(spark, d):
    return files.from_values(spark, ["k", "v", "x", "ok"], [[1, "a", 1.5, True], [2, None, 2, None], [None, 7, None, False]]).withColumnRenamed(ROW, "row_no")


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS line FROM region ORDER BY r_regionkey LIMIT 3")
def source_json(spark, d):
    return values(spark, [(x,) for x in files.sample(read(spark, d, "region").orderBy("r_regionkey"), 3)], "line string")


@query("SELECT * FROM (VALUES ('utf-8', ';', 2), ('utf-8-sig', ',', 2), ('cp1252', '|', 3), ('utf-8', chr(9), 2)) AS t(encoding, delimiter, columns)")
def source_sniff(spark, d):
    heads = ["a;b\n1;2,5\n".encode(), "a,b\n".encode("utf-8-sig"), "ville|pays|“n”\nOrléans|€|1\n".encode("cp1252"), b"a\tb\n"]
    return values(spark, [(e, s, len(names)) for e, s, names in map(files.sniff, heads)], "encoding string, delimiter string, columns int")


@query("SELECT * FROM (VALUES ('null', NULL), ('', NULL), (' None ', NULL), ('Sheet1', 'Sheet1'), ('string', NULL)) AS t(given, sheet)")
def source_sheet_name(spark, d):
    return values(spark, [(x, files.normalise_optional(x)) for x in ("null", "", " None ", "Sheet1", "string")], "given string, sheet string")


# ---------------------------------------------------------------- profile

_TOP = "(SELECT string_agg(t, '|' ORDER BY n DESC, t) FROM (SELECT trim({0}) AS t, count(*) AS n FROM v WHERE lower(trim({0})) NOT IN {1} GROUP BY 1 ORDER BY n DESC, t LIMIT 5)) AS top"


@query(f"WITH {VENDOR_SQL} " + " UNION ALL ".join(f"SELECT name, inferred_type, null_rate, cardinality, {_TOP.format(c, q.EMPTY)} FROM ({q._profile_sql(c)})" for c in ("segment", "joined", "email")))
def profile_full(spark, d):
    out = profile.profile(vendors(spark, d, "segment", "joined", "email"))
    return out.select("name", "inferred_type", "null_rate", "cardinality", F.array_join("top_values", "|").alias("top"))


q.SQL["profile_streaming_top"] = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM orders GROUP BY 2" for c in ("o_orderstatus", "o_orderpriority"))


# ---------------------------------------------------------------- cleaning, recipes, plans

q.SQL["clean_case_title"] = "SELECT p_partkey + 2 AS _row, array_to_string(list_transform(regexp_extract_all(p_name || ' o''neil', '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS name FROM part"
q.clean_query(
    "clean_forms",
    {"_row": "p_partkey + 2", "name": "p_name", "brand": "p_brand", "price": "p_retailprice", "size": "p_size"},
    [
        {"op": "case", "params": {"columns": "name", "to": "upper"}},
        {"op": "slice_text", "params": {"columns": ["brand"], "side": "right", "length": 2}},
        {"op": "math", "params": {"into": "short", "left": 1000, "op": "-", "right": "price"}},
        {"op": "math", "params": {"into": "both", "left": "price", "op": "+", "right": "size"}},
    ],
    "SELECT _row AS row_no, upper(name) AS name, right(brand, 2) AS brand, price, size, 1000 - price AS short, price + size AS both FROM t",
)
q.clean_query("clean_dedupe_forms", {"_row": "o_orderkey + 2", "cust": "o_custkey", "price": "o_totalprice", "status": "o_orderstatus"}, [{"op": "dedupe", "params": {"columns": ["cust"], "aggregate": {"price": "max", "status": "last"}}}], "SELECT min(_row) AS row_no, cust, max(price) AS price, arg_max(status, _row) AS status FROM t GROUP BY cust", "orders")
q.clean_query("clean_split_open", {"_row": "p_partkey + 2", "brand": "p_brand"}, [{"op": "split_column", "params": {"column": "brand", "delimiter": "#"}}], "SELECT _row AS row_no, brand, string_split(brand, '#')[1] AS brand_1, string_split(brand, '#')[2] AS brand_2 FROM t")
q.clean_query("clean_date_forms", {"_row": "c_custkey + 2", "joined": q.VENDOR["joined"]}, [{"op": "parse_date", "params": {"columns": "joined", "output_format": "%d/%m/%Y"}}], "SELECT _row AS row_no, coalesce(strftime(try_strptime(joined, '%Y-%m-%d'), '%d/%m/%Y'), joined) AS joined FROM t", "customer")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}')" for name in ("absolute", "case", "concat_columns", "dedupe", "drop_empty_columns", "drop_empty_rows", "fill_down", "math", "parse_date", "remove_chars", "replace_text", "set_header", "slice_text", "split_column", "strip_currency", "trim")) + ") AS t(op)")
def clean_list(spark, d):
    return values(spark, [(k,) for k in clean.list_ops()], "op string")


@query("SELECT c_custkey + 2 AS row_no, lower(trim(c_name)) AS name, 'zone ' || lower(c_mktsegment) AS zone FROM customer")
def recipe_replace(spark, d):
    df = read(spark, d, "customer").selectExpr("c_custkey + 2 AS _row", "concat(' ', c_name, '  ') AS name", "c_mktsegment AS segment")
    steps = [
        {"op": "trim", "params": {"columns": ["name"]}},
        {"op": "case", "params": {"columns": "name", "to": "lower"}},
        {"op": "llm_map", "params": {"column": "segment", "into": "zone", "instruction": "which zone?"}},
    ]
    out = recipe.apply_recipe(df, {"steps": steps}, replace=True, mapper=lambda v, _: f"zone {v.lower()}")
    return out.select(F.col(ROW).alias("row_no"), "name", "zone")


@query("SELECT p_partkey + 2 AS row_no, string_split(p_name, ' ')[1] AS first, coalesce(string_split(p_name, ' ')[2], '') AS second, '' AS third FROM part")
def recipe_split(spark, d):
    df = read(spark, d, "part").selectExpr("p_partkey + 2 AS _row", "p_name AS name")
    out = recipe.split_values(df, "name", lambda v: v.split(" "), ["first", "second", "third"])
    return out.select(F.col(ROW).alias("row_no"), *[F.col("parts")[i].alias(k) for i, k in enumerate(("first", "second", "third"))])


@query("SELECT r_name AS before, lower(r_name) AS after FROM region")
def recipe_preview(spark, d):
    df = read(spark, d, "region").selectExpr("r_regionkey + 2 AS _row", "r_name AS name")
    reply = json.dumps({"steps": [{"op": "case", "params": {"columns": ["name"], "to": "lower"}}], "note": "small letters"})
    shown = recipe.preview(df, "small letters", lambda prompt: f"Here it is: {reply}")
    return values(spark, [(b["name"], a["name_ai"]) for b, a in zip(shown["before"], shown["after"])], "before string, after string")


@query("SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice < 300000 GROUP BY 1 ORDER BY n DESC, o_orderpriority LIMIT 4")
def plan_sort_by(spark, d):
    plan = {
        "filters": [{"column": "o_totalprice", "op": "lt", "value": 300000}],
        "group_by": ["o_orderpriority"],
        "aggregates": [{"column": "o_orderkey", "fn": "count", "as": "n"}, {"column": "o_totalprice", "fn": "max", "as": "top"}],
        "sort": [{"by": "o_orderpriority"}, {"by": "n", "desc": True}],
        "limit": 4,
    }
    return execute_plan(read(spark, d, "orders"), plan)


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id >= 20 GROUP BY 1")
def ask_evidence(spark, d):
    plan = {"filters": [{"column": "user_id", "op": "ge", "value": 20}], "group_by": ["event_type"], "aggregates": [{"column": "event_id", "fn": "count", "as": "n"}]}
    replies = iter(["I think so.", f"```json\n{json.dumps(plan)}\n```", "There are several kinds."])
    answer = planner.ask(read(spark, d, "events").drop("ts", "props"), "How many events of each kind?", lambda prompt: next(replies))
    return values(spark, [(r["event_type"], r["n"]) for r in answer.evidence], "event_type string, n long")


@query("SELECT * FROM (VALUES ('{\"a\": 1}'), ('[1, 2]'), ('{\"b\": {\"c\": null}}'), (NULL)) AS t(found)")
def planner_json(spark, d):
    def found(reply):
        try:
            return json.dumps(planner.extract_json(reply))
        except ValueError:
            return None

    replies = ['Sure: {"a": 1} ok?', "```\n[1, 2]\n```", '{x} {"b": {"c": null}}', "none"]
    return values(spark, [(found(r),) for r in replies], "found string")


@query("SELECT * FROM (VALUES ('unknown column'), ('unknown filter op'), ('unknown aggregate'), ('unknown plan key'), ('unknown sort column')) AS t(refusal)")
def plan_refusals(spark, d):
    df, out = read(spark, d, "region"), []
    for plan in (
        {"filters": [{"column": "__class__", "op": "eq", "value": 1}]},
        {"filters": [{"column": "r_name", "op": "eval", "value": 1}]},
        {"aggregates": [{"column": "r_name", "fn": "system"}]},
        {"code": "1"},
        {"sort": [{"by": "gone"}]},
    ):
        try:
            execute_plan(df, plan)
        except q.PlanError as e:
            out.append((str(e).split(" '")[0].split(" None")[0],))
    return values(spark, out, "refusal string")


# ---------------------------------------------------------------- validation

_ALL_FINDINGS = " UNION ALL ".join(
    [
        q._findings("name", "required_field", "error", "NULL", "v WHERE name IS NULL"),
        q._findings("pan", "unique", "error", "trim(pan)", "(SELECT *, count(*) OVER (PARTITION BY trim(pan)) AS n FROM v) WHERE n > 1"),
        q._findings("name", "missing_value", "warning", "NULL", "v WHERE name IS NULL"),
        q._findings("email", "missing_value", "warning", "NULL", f"v WHERE NOT {q._FULL('email')}"),
        q._findings("email", "format_email", "error", "trim(email)", f"v WHERE {q._BAD('email', 'email')}"),
        q._findings("pan", "format_pan", "error", "trim(pan)", f"v WHERE {q._BAD('pan', 'pan')}"),
        q._findings("pan", "duplicate_id", "warning", "trim(pan)", f"(SELECT *, count(*) OVER (PARTITION BY trim(pan)) AS n FROM v WHERE NOT ({q._BAD('pan', 'pan')})) WHERE n > 1"),
    ]
)


@query(f"WITH {VENDOR_SQL} {_ALL_FINDINGS}")
def validate_full(spark, d):
    found = validate.validate(vendors(spark, d, "name", "email", "pan"), {"required": ["name"], "unique": ["pan"]})
    return found.select("row", F.col("column").alias("field"), "rule_name", "severity", "value")


_LEDGER = {
    "gstin": "CASE WHEN c_custkey % 7 = 0 THEN '27ABCDE1234F1Q5' ELSE '27ABCDE1234F1Z5' END",
    "ifsc": "CASE WHEN c_custkey % 11 = 0 THEN 'SBIN1000001' ELSE 'SBIN0000001' END",
    "amount": "CASE WHEN c_custkey % 13 = 0 THEN 0.0 ELSE c_acctbal + 2000 END",
    "net_pay": "c_acctbal",
    "gross_pay": "CASE WHEN c_custkey % 17 = 0 THEN c_acctbal - 1 ELSE c_acctbal + 1 END",
    "employee_id": "CASE WHEN c_custkey % 19 = 0 THEN 'E0' ELSE concat('E', CAST(c_custkey + 1 AS STRING)) END",
}
_LEDGER_SQL = "l AS (SELECT c_custkey + 2 AS _row, " + ", ".join(f"{e} AS {k}" for k, e in _LEDGER.items()) + " FROM customer)"
_COUNTS = {
    ("invoice", "format_gst"): "gstin LIKE '%Q5'",
    ("invoice", "format_ifsc"): "ifsc LIKE 'SBIN1%'",
    ("invoice", "amount_positive"): "NOT amount > 0",
    ("payroll", "format_ifsc"): "ifsc LIKE 'SBIN1%'",
    ("payroll", "net_not_above_gross"): "NOT net_pay <= gross_pay",
    ("payroll", "unique"): "employee_id = 'E0'",
    ("bank-statement", "format_ifsc"): "ifsc LIKE 'SBIN1%'",
    ("bank-statement", "amount_nonzero"): "NOT amount != 0",
}


@query(f"WITH {_LEDGER_SQL} " + " UNION ALL ".join(f"SELECT '{s}' AS ruleset, '{r}' AS rule_name, count(*) AS n FROM l WHERE {w}" for (s, r), w in _COUNTS.items()))
def validate_builtin(spark, d):
    df = read(spark, d, "customer").select(F.expr("c_custkey + 2").alias(ROW), *[F.expr(e).alias(k) for k, e in _LEDGER.items()])
    out = None
    for name in ("invoice", "payroll", "bank-statement"):
        found = validate.validate(df, {**validate.resolve_ruleset(name), "auto": False}).select(F.lit(name).alias("ruleset"), "rule_name")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("ruleset", "rule_name").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('default'), ('kyc'), ('invoice'), ('payroll'), ('bank-statement'), ('mine')) AS t(name)")
def validate_rulesets(spark, d):
    return values(spark, [(x,) for x in validate.list_rulesets({"mine": {}})], "name string")


def _streamed(spark: SparkSession, d: str, work, mode: str) -> DataFrame:
    """What a query over the events as a stream of files gives, written batch by batch."""
    source, out = scratch(spark, "events"), scratch(spark, "out")
    rows = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn(ROW, F.col("event_id") + 2)
    rows.repartition(3, "event_id").write.parquet(source)
    found = work(quality_stream.read_stream(spark, source, rows.schema))
    keep = lambda batch, n: batch.write.mode("append" if mode == "append" else "overwrite").parquet(out)
    found.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@query("SELECT event_id + 2 AS row, 'value' AS field, 'range' AS rule_name FROM events WHERE value > 15 UNION ALL SELECT event_id + 2, 'event_type', 'reference' FROM events WHERE event_type = 'error'")
def stream_validate(spark, d):
    rules = {"ranges": {"value": {"max": 15}}, "references": {"event_type": ["click", "view", "purchase", "signup"]}}
    found = _streamed(spark, d, lambda s: quality_stream.validate_stream(s, rules), "append")
    return found.select("row", F.col("column").alias("field"), "rule_name")


@query("SELECT CAST(user_id AS STRING) AS value, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen FROM events GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts) HAVING count(*) > 1")
def stream_duplicates(spark, d):
    found = _streamed(spark, d, lambda s: quality_stream.duplicate_sightings(s, "user_id", "ts", "1 day"), "complete")
    return found.select("value", "n", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_seen"))


@query("SELECT 'value' AS field, count(*) AS n_rows, 0::BIGINT AS n_empty, min(value) AS low, max(value) AS high FROM events UNION ALL SELECT 'user_id', count(*), 0, min(user_id), max(user_id) FROM events")
def stream_profile(spark, d):
    found = _streamed(spark, d, lambda s: quality_stream.profile_stream(s, ["value", "user_id"]), "complete")
    return found.select(F.col("column").alias("field"), "n_rows", "n_empty", F.col("min_num").alias("low"), F.col("max_num").alias("high"))


# ---------------------------------------------------------------- anomalies

_NEAR = "SELECT p_partkey + 2 AS _row, md5(CAST(floor(p_partkey / 2) AS BIGINT)::STRING) || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'y' END AS code FROM part"


@query(
    f"WITH t AS ({_NEAR}) SELECT a._row AS row, 0.97::DOUBLE AS confidence, 'Row ' || a._row || ' is 97% the same as row ' || b._row || '; they differ in: code' AS reason "
    "FROM t a JOIN t b ON left(a.code, 32) = left(b.code, 32) AND a.code < b.code"
)
def anomaly_near_pairs(spark, d):
    code = "concat(md5(CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING)), CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'y' END) AS code"
    return anomaly.near_duplicate_rows(read(spark, d, "part").selectExpr("p_partkey + 2 AS _row", code)).select("row", "confidence", "reason")


_FLAGS = (
    "o AS (SELECT o_orderkey + 2 AS _row, md5(o_orderkey::STRING) AS code, CASE WHEN o_orderkey % 2999 = 0 THEN 'Oddity' ELSE o_orderpriority END AS kind, "
    "CASE WHEN o_orderkey % 499 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price FROM orders), "
    "k AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM o), "
    "f AS (SELECT _row AS row, 'column_outlier' AS kind, 'price' AS field FROM o, k WHERE price < q1 - 3 * (q3 - q1) OR price > q3 + 3 * (q3 - q1) "
    "UNION ALL SELECT _row, 'rare_category', 'kind' FROM o WHERE kind = 'Oddity')"
)


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").selectExpr(
        "o_orderkey + 2 AS _row",
        "md5(CAST(o_orderkey AS STRING)) AS code",
        "CASE WHEN o_orderkey % 2999 = 0 THEN 'Oddity' ELSE o_orderpriority END AS kind",
        "CASE WHEN o_orderkey % 499 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price",
    )


@query(f"WITH {_FLAGS} SELECT * FROM f")
def anomaly_all(spark, d):
    """Every kind of flag but the forest's, which has no twin in SQL."""
    found = anomaly.detect_anomalies(_flagged(spark, d)).filter("kind <> 'multivariate_outlier'")
    return found.select("row", "kind", F.col("columns")[0].alias("field"))


# ---------------------------------------------------------------- reconciliation

_SIDE = "SELECT o_orderkey AS _row, o_custkey AS cust, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 3 = {}"


@query(
    f"WITH a AS ({_SIDE.format(0)}), b AS ({_SIDE.format(1)}), p AS (SELECT a._row AS ra, b._row AS rb, (a.status <> b.status)::INT + (a.priority <> b.priority)::INT AS n FROM a JOIN b USING (cust)) "
    "SELECT ra, rb, n FROM p QUALIFY row_number() OVER (PARTITION BY ra ORDER BY n, rb) = 1"
)
def recon_closest(spark, d):
    side = lambda k: read(spark, d, "orders").filter(f"o_orderkey % 3 = {k}").selectExpr("o_orderkey AS _row", "o_custkey AS cust", "o_orderstatus AS status", "o_orderpriority AS priority")
    a, b = side(0).withColumn("ra", F.col(ROW)), side(1).withColumn("rb", F.col(ROW))
    found = reconcile.reconcile(a, b, ["cust"]).filter("bucket IN ('matched', 'discrepancy')")
    return found.select("a.ra", "b.rb", F.size("differences").alias("n"))


@query(
    "WITH p AS (SELECT o_orderkey AS k, o_orderkey % 4 AS late, o_orderkey % 5 = 0 AS other FROM orders) "
    "SELECT k, CASE WHEN late > 1 OR other THEN 'discrepancy' ELSE 'matched' END AS bucket, CASE WHEN late > 1 OR other THEN 'exact' WHEN late = 0 AND k % 2 = 0 AND k % 3 <> 0 THEN 'L1' WHEN late = 0 AND k % 3 <> 0 THEN 'L1' ELSE 'L2' END AS match_level, "
    "((late > 1)::INT + other::INT)::INT AS n FROM p"
)
def recon_tolerances(spark, d):
    """Dates by days, in two notations, and texts by similarity."""
    day = "CAST(o_orderdate AS DATE)"
    a = read(spark, d, "orders").selectExpr("o_orderkey AS _row", "o_orderkey AS k", f"date_format({day}, 'yyyy-MM-dd') AS day", "concat('a long enough name of ', md5(CAST(o_orderkey AS STRING))) AS who")
    who = "CASE WHEN o_orderkey % 5 = 0 THEN 'someone else' WHEN o_orderkey % 3 = 0 THEN concat('a long enough name of ', md5(CAST(o_orderkey AS STRING)), ' x') ELSE concat(' A long enough name of ', md5(CAST(o_orderkey AS STRING))) END AS who"
    b = read(spark, d, "orders").selectExpr("o_orderkey AS _row", "o_orderkey AS k", f"date_format({day} + CAST(o_orderkey % 4 AS INT), 'dd/MM/yyyy') AS day", who)
    found = reconcile.reconcile(a, b, ["k"], {"days": 1, "fuzzy": 0.9})
    return found.select("a.k", "bucket", "match_level", F.size("differences").alias("n"))


_KEYS = "SELECT p_partkey + 2 AS row, md5(p_partkey::STRING) AS key FROM part"


@query(f"WITH t AS ({_KEYS}) SELECT row, CASE WHEN row % 3 = 0 THEN 'L3' ELSE 'L1' END AS match_level, CASE WHEN row % 3 = 0 THEN 0.9846 END AS key_similarity FROM t")
def recon_fuzzy_pairs(spark, d):
    rows = read(spark, d, "part").selectExpr("p_partkey + 2 AS _row", "md5(CAST(p_partkey AS STRING)) AS key", "p_retailprice AS price")
    b = rows.withColumn("key", F.when(F.col(ROW) % 3 == 0, F.concat("key", F.lit("x"))).otherwise(F.col("key")))
    found = reconcile.reconcile(rows.withColumn("row", F.col(ROW)), b, ["key"], {"numeric": 0.01}, fuzzy_keys=0.9)
    return found.filter("bucket = 'matched'").select("a.row", "match_level", "key_similarity")


@query(
    q._PAIRS + "SELECT 'matched' AS bucket, count(*) AS n FROM p WHERE same_amount AND same_status UNION ALL SELECT 'discrepancy', count(*) FROM p WHERE NOT (same_amount AND same_status) "
    "UNION ALL SELECT 'only_in_a', count(*) FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'only_in_b', count(*) FROM b WHERE k NOT IN (SELECT k FROM a)"
)
def recon_counts(spark, d):
    return reconcile.bucket_counts(q.ledgers(spark, d))


@query(q._PAIRS + "SELECT k, 'amount' AS field, round(ba - aa, 6) AS diff_abs, sa AS status_a, sb AS status_b FROM p WHERE NOT same_amount UNION ALL SELECT k, 'status', NULL, sa, sb FROM p WHERE NOT same_status")
def recon_report(spark, d):
    rows = report.reconciliation_frames(q.ledgers(spark, d))["discrepancy"]
    return rows.select(F.col("`a.k`").alias("k"), "field", "diff_abs", F.col("`a.status`").alias("status_a"), F.col("`b.status`").alias("status_b"))


# ---------------------------------------------------------------- names and entities

q.SQL["name_pairwise"] = (
    "SELECT c_custkey + 2 AS row, c_name AS name_a, translate(c_name, '#', ' ') || CASE WHEN c_custkey % 3 = 0 THEN ' Ltd' ELSE '' END AS name_b, "
    "CASE WHEN c_custkey % 3 = 0 THEN round(100 * (2 * length(c_name))::DOUBLE / (2 * length(c_name) + 4), 2) ELSE 100.0::DOUBLE END AS similarity FROM customer"
)
# names are nation_ and a number below 100: they share that prefix, and one digit if any is common
q.SQL["name_cross"] = (
    "SELECT a.n_nationkey + 2 AS row_a, b.n_nationkey + 2 AS row_b, a.n_name AS name_a, b.n_name AS name_b, "
    "round(100 * (2 * (7 + (len(list_intersect(string_split(a.n_name[8:], ''), string_split(b.n_name[8:], ''))) > 0)::INT))::DOUBLE / (length(a.n_name) + length(b.n_name)), 2) AS similarity "
    "FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"
)


@query("SELECT p_partkey + 2 AS row_no, lower(p_name) || ' ' || replace(lower(p_brand), '#', ' ') || ' co' AS name FROM part")
def name_normalise(spark, d):
    df = read(spark, d, "part").selectExpr("p_partkey + 2 AS row_no", "concat('  ', upper(p_name), '--', p_brand, ' (Co.) ') AS name")
    return df.select("row_no", similarity.normalised(F.col("name")).alias("name"))


@query("SELECT c_custkey + 2 AS row, 'match' AS verdict FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT c_custkey + 2, 'unverified' FROM customer WHERE c_custkey % 3 = 2 UNION ALL SELECT c_custkey + 2, 'no_match' FROM customer WHERE c_custkey % 3 = 0")
def name_verdicts(spark, d):
    df = read(spark, d, "customer").selectExpr("c_custkey + 2 AS _row", "c_name AS a", "concat(lower(c_name), CASE c_custkey % 3 WHEN 0 THEN ' 0' WHEN 1 THEN ' 1' ELSE ' ?' END) AS b")
    judge = lambda a, b: {"0": "no_match", "1": "match"}.get(b[-1], "perhaps")
    return entity.match_names(df, "a", "b", threshold=80, judge=judge).select("row", "verdict")


@query("SELECT CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pairs FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)")
def name_pair_count(spark, d):
    df = read(spark, d, "customer").selectExpr("c_custkey + 2 AS _row", "c_name AS name", "CAST(c_nationkey AS STRING) AS nation")
    return values(spark, [(entity.pair_count(df, "name", "nation"),)], "pairs long")


_ENTITY = "e AS (SELECT p_partkey + 2 AS _row, p_name || p_brand AS g, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_size END AS size, row_number() OVER (PARTITION BY p_name || p_brand ORDER BY p_partkey % 2 DESC, p_partkey) AS n FROM part)"


def _entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Equal names and brands, in other notations, are one entity."""
    notation = "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE concat(' ', p_name) END AS name"
    df = read(spark, d, "part").selectExpr("p_partkey + 2 AS _row", notation, "p_brand AS brand", "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_size END AS size")
    return entity.dedupe_entities(df, ["name", "brand"], threshold=100)


@query(f"WITH {_ENTITY} SELECT _row AS row_no, size FROM e WHERE n = 1")
def entity_kept(spark, d):
    return _entities(spark, d)[0].select(F.col(ROW).alias("row_no"), "size")


@query(f"WITH {_ENTITY} SELECT first_value(_row) OVER (PARTITION BY g ORDER BY n) AS canonical_row, _row AS merged_row FROM e QUALIFY n > 1")
def entity_log(spark, d):
    return _entities(spark, d)[1].select("canonical_row", F.explode("merged_rows").alias("merged_row"))


# ---------------------------------------------------------------- health and reports

_MARKED = f"{_FLAGS}, m AS (SELECT row, field, 'outlier' AS category FROM f WHERE kind = 'column_outlier' UNION ALL SELECT o_orderkey + 2, 'price', 'missing' FROM orders WHERE o_orderkey % 998 = 0)"


def _marked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = _flagged(spark, d)
    flags = anomaly.column_outliers(df).unionByName(anomaly.rare_categories(df))
    gone = df.filter("(_row - 2) % 998 = 0").select(F.col(ROW).alias("row"), F.lit("price").alias("column"), F.lit("required_field").alias("rule_name"), F.lit("error").alias("severity"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("value"))
    return df, gone, flags


@query(
    f"WITH {_MARKED}, c AS (SELECT category, count(DISTINCT row) AS n FROM m GROUP BY 1), p AS (SELECT *, 100.0::DOUBLE * n / (SELECT count(*) FROM orders) AS pct FROM c) "
    "SELECT category, n AS rows_affected, round(pct, 2) AS pct_of_rows, round(CASE category WHEN 'outlier' THEN 0.8 ELSE 0.4 END * pct, 2) AS deduction FROM p"
)
def health_flags(spark, d):
    df, findings, flags = _marked(spark, d)
    return report.health_breakdown(df.count(), findings, flags).drop("weight_per_pct")


@query(f"WITH {_MARKED} SELECT row, field, CASE WHEN bool_or(category = 'outlier') THEN 'outlier' ELSE 'missing' END AS category FROM m GROUP BY row, field")
def highlight_flags(spark, d):
    _, findings, flags = _marked(spark, d)
    return report.highlights(findings, flags).select("row", F.col("column").alias("field"), "category")


@query(f"WITH {VENDOR_SQL} " + q._findings("email", "format_email", "error", "trim(email)", f"v WHERE {q._BAD('email', 'email')}"))
def report_issues(spark, d):
    frames = report.report_frames(vendors(spark, d, "email", "balance"), {"formats": {"email": "email"}, "auto": False})
    return frames["issues"].select("row", F.col("column").alias("field"), "rule_name", "severity", "value")


# ---------------------------------------------------------------- risk


@query(
    "WITH s AS (SELECT (o_custkey % 3 = 0)::INT AS y, ((o_orderkey * 7 + o_custkey) % 100) / 100.0::DOUBLE AS p FROM orders), "
    "c AS (SELECT sum((y = 1 AND p >= 0.5)::INT) AS tp, sum((y = 0 AND p >= 0.5)::INT) AS fp, sum((y = 1 AND p < 0.5)::INT) AS fn, sum((y = 0 AND p < 0.5)::INT) AS tn FROM s), "
    "r AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p), a AS (SELECT sum(pos * (below + neg / 2.0::DOUBLE)) AS area FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM r)) "
    "SELECT round(tp::DOUBLE / (tp + fp), 4) AS precision, round(tp::DOUBLE / (tp + fn), 4) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) AS f1, round(area::DOUBLE / ((tp + fn) * (fp + tn))::DOUBLE, 4) AS roc_auc, "
    "tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn FROM c, a"
)
def risk_metrics(spark, d):
    scored = read(spark, d, "orders").selectExpr("CAST(o_custkey % 3 = 0 AS DOUBLE) AS __y", "((o_orderkey * 7 + o_custkey) % 100) / 100.0D AS probability")
    m = risk.metrics(scored)
    row = (m["precision"], m["recall"], m["f1"], m["roc_auc"], *[m["confusion"][k] for k in ("tp", "fp", "fn", "tn")])
    return values(spark, [row], "precision double, recall double, f1 double, roc_auc double, tp long, fp long, fn long, tn long")


@query("SELECT * FROM (VALUES ('l_quantity', 'numeric'), ('l_discount', 'numeric'), ('l_extendedprice', 'numeric'), ('leak', 'numeric'), ('l_returnflag', 'categorical'), ('outcome', 'categorical'), ('label', 'categorical')) AS t(name, kind)")
def risk_features(spark, d):
    df = q._labelled(spark, d)
    numeric, categorical = risk.split_features(df, [c for c in df.columns if c != ROW])
    return values(spark, [(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical], "name string, kind string")


@query("SELECT label, count(*) AS n, sum((label = 'fraud')::INT)::DOUBLE AS positives FROM (SELECT CASE WHEN (l_discount > 0.05)::INT + (l_quantity > 30)::INT + (l_returnflag = 'R')::INT >= 2 THEN 'fraud' ELSE 'ok' END AS label FROM lineitem) GROUP BY label")
def risk_label(spark, d):
    rows, _ = risk.resolve_label(q._labelled(spark, d), "label")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("__y").alias("positives"))


@query("SELECT sha256('amount|channel|hour')[1:16] AS fingerprint, 'extra' AS unknown")
def risk_schema(spark, d):
    card = risk.ModelCard("m", "label", "yes", ["hour", "amount"], ["channel"], {}, [], {}, [], 0, "gradient_boosting")
    df = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in ("extra", "channel", "amount", "hour", "label")]))
    return values(spark, [(card.fingerprint, ",".join(risk.check_schema(df, card)))], "fingerprint string, unknown string")


@query("SELECT median(l_quantity) AS quantity, quantile_cont(l_extendedprice, 0.9) AS price, quantile_cont(l_discount, 0.25) AS discount FROM lineitem")
def risk_quantiles(spark, d):
    from tabguard.operators.quantiles import quantiles

    df = read(spark, d, "lineitem")
    of = lambda c, s: quantiles(df, [c], [s])[c][0]
    return values(spark, [(of("l_quantity", 0.5), of("l_extendedprice", 0.9), of("l_discount", 0.25))], "quantity double, price double, discount double")
