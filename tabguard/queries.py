"""A query for each operator, over the driver's tables, with its SQL twin.

The tables hold no nulls and no faults, so faults are injected by expressions that
both engines read from the same text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.errors import PlanError  # noqa: F401
from tabguard.functions import formats
from tabguard.functions.text import ROW
from tabguard.operators import anomaly, clean, entity, profile, reconcile, recipe, report, risk, validate
from tabguard.plans.query_plan import execute_plan
from tabguard.sources.files import with_row_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Columns of a vendor ledger made from customer, with faults; read by both engines.
VENDOR = {
    "_row": "c_custkey + 2",
    "name": "CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_name END",
    "email": "CASE WHEN c_custkey % 89 = 0 THEN 'no mail' WHEN c_custkey % 83 = 0 THEN ' N/A ' ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END",
    "pan": "CASE WHEN c_custkey % 71 = 0 THEN 'abc' WHEN c_custkey % 53 = 0 THEN 'ABCDE0053F' ELSE concat('ABC', chr(CAST(65 + c_custkey // 260000 AS INTEGER)), chr(CAST(65 + (c_custkey // 10000) % 26 AS INTEGER)), lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'F') END",
    "balance": "CASE WHEN c_custkey % 701 = 0 THEN 9750000.0 ELSE c_acctbal END",
    "price": "CASE WHEN c_custkey % 61 = 0 THEN 'on request' ELSE concat('$ ', CAST(c_custkey % 5000 AS STRING), '.50') END",
    "segment": "CASE WHEN c_custkey % 1009 = 0 THEN 'Oddity' ELSE c_mktsegment END",
    "code": "CASE WHEN c_custkey % 103 = 0 THEN 'VENDOR_30' ELSE concat('VND-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) END",
    "joined": "CASE WHEN c_custkey % 67 = 0 THEN 'soon' ELSE concat('2024-', lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')) END",
}
VENDOR_SQL = "v AS (SELECT " + ", ".join(f"{e} AS {k}" for k, e in VENDOR.items()) + " FROM customer)"


def vendors(spark: SparkSession, d: str, *names: str) -> DataFrame:
    for_spark = lambda e: e.replace("c_custkey // 260000", "floor(c_custkey / 260000)").replace("c_custkey // 10000", "CAST(floor(c_custkey / 10000) AS BIGINT)")
    return read(spark, d, "customer").select(*[F.expr(for_spark(VENDOR[k])).alias(k) for k in ("_row", *(names or [k for k in VENDOR if k != "_row"]))])


# ---------------------------------------------------------------- plans


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 200000 AND o_totalprice <= 400000 AND o_custkey >= 20 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def plan_filter_cmp(spark, d):
    plan = {
        "filters": [
            {"column": "o_totalprice", "op": "gt", "value": 200000},
            {"column": "o_totalprice", "op": "le", "value": "400000"},
            {"column": "o_custkey", "op": "ge", "value": 20},
        ],
        "sort": ["o_orderkey", {"column": "o_totalprice", "desc": True}],
        "limit": 1000,
    }
    return execute_plan(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), plan)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '00') AND starts_with(lower(c_mktsegment), 'b') AND lower(trim(c_mktsegment)) <> 'machinery' ORDER BY c_custkey LIMIT 500")
def plan_filter_text(spark, d):
    plan = {
        "filters": [
            {"column": "c_name", "op": "contains", "value": "00"},
            {"column": "c_mktsegment", "op": "startswith", "value": "B"},
            {"column": "c_mktsegment", "op": "ne", "value": " Machinery "},
        ],
        "sort": ["c_custkey"],
        "limit": 500,
    }
    return execute_plan(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), plan)


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND lower(o_orderpriority) = '1-urgent' ORDER BY o_orderkey LIMIT 300")
def plan_filter_in(spark, d):
    plan = {
        "filters": [
            {"column": "o_orderstatus", "op": "in", "value": ["f", " P "]},
            {"column": "o_orderpriority", "op": "eq", "value": "1-urgent"},
        ],
        "sort": [{"column": "o_orderkey"}],
        "limit": 300,
    }
    return execute_plan(read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), plan)


@query(f"WITH {VENDOR_SQL} SELECT name, segment, pan FROM v WHERE name IS NULL AND lower(trim(segment)) <> 'oddity' ORDER BY pan, segment LIMIT 1000")
def plan_filter_null(spark, d):
    plan = {
        "filters": [{"column": "name", "op": "isnull"}, {"column": "segment", "op": "notnull"}, {"column": "segment", "op": "ne", "value": "Oddity"}],
        "sort": ["segment", "pan"],
        "limit": 1000,
    }
    return execute_plan(vendors(spark, d, "name", "segment", "pan"), plan)


@query("SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS mean_price, min(l_discount) AS min_discount, max(l_tax) AS max_tax, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_quantity > 5 GROUP BY ALL ORDER BY l_returnflag, l_linestatus")
def plan_group_agg(spark, d):
    plan = {
        "filters": [{"column": "l_quantity", "op": "gt", "value": 5}],
        "group_by": ["l_returnflag", "l_linestatus"],
        "aggregates": [
            {"column": "l_quantity", "fn": "count", "as": "n"},
            {"column": "l_quantity", "fn": "sum", "as": "sum_qty"},
            {"column": "l_extendedprice", "fn": "mean", "as": "mean_price"},
            {"column": "l_discount", "fn": "min", "as": "min_discount"},
            {"column": "l_tax", "fn": "max", "as": "max_tax"},
            {"column": "l_suppkey", "fn": "nunique", "as": "suppliers"},
        ],
        "sort": ["l_linestatus", "l_returnflag"],
    }
    out = execute_plan(read(spark, d, "lineitem"), plan)
    return out.withColumns({"sum_qty": F.round("sum_qty", 2), "mean_price": F.round("mean_price", 4)})


@query("SELECT round(sum(o_totalprice), 1) AS total, count(DISTINCT o_custkey) AS customers, max(o_orderkey) AS max_o_orderkey FROM orders WHERE lower(o_orderstatus) = 'o'")
def plan_global_agg(spark, d):
    plan = {
        "filters": [{"column": "o_orderstatus", "op": "eq", "value": "O"}],
        "aggregates": [
            {"column": "o_totalprice", "fn": "sum", "as": "total"},
            {"column": "o_custkey", "fn": "nunique", "as": "customers"},
            {"column": "o_orderkey", "fn": "max"},
        ],
    }
    return execute_plan(read(spark, d, "orders"), plan).withColumn("total", F.round("total", 1))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def plan_group_count(spark, d):
    return execute_plan(read(spark, d, "events"), {"group_by": "event_type"})


@query("SELECT l_partkey, round(sum(l_quantity), 2) AS sum_qty FROM lineitem GROUP BY 1 ORDER BY sum_qty DESC, l_partkey LIMIT 25")
def plan_topk(spark, d):
    plan = {
        "group_by": ["l_partkey"],
        "aggregates": [{"column": "l_quantity", "fn": "sum", "as": "sum_qty"}],
        "sort": ["l_partkey", {"column": "sum_qty", "desc": True}],
        "limit": 25,
    }
    return execute_plan(read(spark, d, "lineitem"), plan)


# ---------------------------------------------------------------- cleaning


def parts(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    made = {k: F.expr(v) for k, v in {"_row": "p_partkey + 2", **columns}.items()}
    return read(spark, d, "part").select(*[e.alias(k) for k, e in made.items()])


def clean_query(name: str, columns: dict[str, str], steps: list[dict], sql: str, table: str = "part"):
    """A query that runs cleaning steps on a table whose columns both engines read alike."""

    def run(spark, d):
        df = read(spark, d, table).select(*[F.expr(e).alias(k) for k, e in columns.items()])
        return clean.apply_ops(df, steps).withColumnRenamed(ROW, "row_no")

    run.__name__ = name
    given = ", ".join(f"{e} AS {k}" for k, e in columns.items())
    return query(f"WITH t AS (SELECT {given} FROM {table}) {sql}")(run)


_P = {"_row": "p_partkey + 2", "name": "p_name"}
clean_query("clean_trim", _P | {"name": "concat('  ', p_name, '   and  ', p_brand, ' ')"}, [{"op": "trim"}], "SELECT _row AS row_no, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name FROM t")
clean_query("clean_case_upper", _P, [{"op": "case", "params": {"mode": "upper"}}], "SELECT _row AS row_no, upper(name) AS name FROM t")
clean_query("clean_case_sentence", _P, [{"op": "case", "params": {"mode": "sentence"}}], "SELECT _row AS row_no, upper(name[1:1]) || lower(name[2:]) AS name FROM t")
clean_query("clean_replace", _P, [{"op": "replace_text", "params": {"find": "e", "replace": "3"}}], "SELECT _row AS row_no, replace(name, 'e', '3') AS name FROM t")
clean_query("clean_replace_regex", _P, [{"op": "replace_text", "params": {"find": "([a-z])([aeiou])", "replace": "\\2\\1", "regex": True}}], "SELECT _row AS row_no, regexp_replace(name, '([a-z])([aeiou])', '\\2\\1', 'g') AS name FROM t")
clean_query("clean_remove_chars", _P, [{"op": "remove_chars", "params": {"chars": "aeiou "}}], "SELECT _row AS row_no, translate(name, 'aeiou ', '') AS name FROM t")
clean_query("clean_split", {"_row": "p_partkey + 2", "brand": "p_brand"}, [{"op": "split_column", "params": {"column": "brand", "delimiter": "#", "into": ["maker", "number", "rest"]}}], "SELECT _row AS row_no, brand, trim(string_split(brand, '#')[1]) AS maker, trim(string_split(brand, '#')[2]) AS number, trim(string_split(brand, '#')[3]) AS rest FROM t")
clean_query("clean_concat", _P | {"brand": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END", "size": "p_size"}, [{"op": "concat_columns", "params": {"columns": ["name", "brand", "size"], "into": "label", "separator": " / "}}], "SELECT _row AS row_no, name, brand, size, concat_ws(' / ', name, brand, CAST(size AS STRING)) AS label FROM t")
clean_query("clean_slice", _P, [{"op": "slice_text", "params": {"column": "name", "mode": "left", "length": 4, "into": "l"}}, {"op": "slice_text", "params": {"column": "name", "mode": "right", "length": 3, "into": "r"}}, {"op": "slice_text", "params": {"column": "name", "mode": "mid", "start": 2, "length": 5, "into": "m"}}], "SELECT _row AS row_no, name, left(name, 4) AS l, right(name, 3) AS r, substring(name, 2, 5) AS m FROM t")
clean_query("clean_math", {"_row": "p_partkey + 2", "price": "p_retailprice", "size": "CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size END"}, [{"op": "math", "params": {"column": "price", "operator": "/", "operand": "size", "into": "per"}}, {"op": "math", "params": {"column": "price", "operator": "*", "operand": 2, "into": "twice"}}, {"op": "math", "params": {"column": "price", "operator": "-", "operand": "size", "into": "less"}}], "SELECT _row AS row_no, price, size, price / nullif(size, 0)::DOUBLE AS per, price * 2 AS twice, price - size AS less FROM t")
clean_query("clean_abs", {"_row": "c_custkey + 2", "balance": "c_acctbal - 4000"}, [{"op": "absolute", "params": {"columns": ["balance"]}}], "SELECT _row AS row_no, abs(balance) AS balance FROM t", "customer")
clean_query("clean_currency", {"_row": "c_custkey + 2", "price": VENDOR["price"]}, [{"op": "strip_currency", "params": {"columns": ["price"]}}], "SELECT _row AS row_no, try_cast(regexp_replace(price, '[₹$€£,\\s]', '', 'g') AS DOUBLE) AS price FROM t", "customer")
clean_query("clean_parse_date", {"_row": "c_custkey + 2", "joined": VENDOR["joined"].replace("'2024-', ", "'', ").replace("'-', lpad", "'/', lpad").replace("28 AS STRING), 2, '0'))", "28 AS STRING), 2, '0'), '/2024')")}, [{"op": "parse_date", "params": {"columns": ["joined"], "format": "%Y.%m.%d"}}], "SELECT _row AS row_no, coalesce(strftime(coalesce(try_strptime(joined, '%d/%m/%Y'), try_strptime(joined, '%m/%d/%Y')), '%Y.%m.%d'), joined) AS joined FROM t", "customer")
clean_query("clean_drop_empty", {"_row": "c_custkey + 2", "a": "CASE WHEN c_custkey % 5 = 0 THEN ' nan ' ELSE c_name END", "b": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END", "c": "CASE WHEN c_custkey < 0 THEN 'x' ELSE 'N/A' END"}, [{"op": "drop_empty_rows"}, {"op": "drop_empty_columns"}], "SELECT _row AS row_no, a, b FROM t WHERE b IS NOT NULL", "customer")
clean_query("clean_fill_down", {"_row": "c_custkey + 2", "seg": "CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment WHEN c_custkey % 4 = 2 THEN '' WHEN c_custkey % 4 = 3 THEN 'NaN' ELSE NULL END"}, [{"op": "fill_down", "params": {"columns": ["seg"]}}], "SELECT _row AS row_no, coalesce(last_value(CASE WHEN lower(trim(seg)) IN ('', 'nan', 'none') AND seg <> 'NaN' THEN NULL ELSE seg END IGNORE NULLS) OVER (ORDER BY _row ROWS UNBOUNDED PRECEDING), seg) AS seg FROM t", "customer")
clean_query("clean_dedupe_first", {"_row": "o_orderkey + 2", "cust": "o_custkey", "status": "o_orderstatus", "price": "o_totalprice"}, [{"op": "dedupe", "params": {"keys": ["cust", "status"], "keep": "first"}}], "SELECT _row AS row_no, cust, status, price FROM t QUALIFY row_number() OVER (PARTITION BY cust, status ORDER BY _row) = 1", "orders")
clean_query("clean_dedupe_last", {"_row": "o_orderkey + 2", "cust": "o_custkey", "price": "o_totalprice"}, [{"op": "dedupe", "params": {"keys": ["cust"], "keep": "last"}}], "SELECT _row AS row_no, cust, price FROM t QUALIFY row_number() OVER (PARTITION BY cust ORDER BY _row DESC) = 1", "orders")
clean_query("clean_dedupe_agg", {"_row": "o_orderkey + 2", "cust": "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END", "qty": "CAST(o_custkey % 7 AS DOUBLE)", "top": "o_totalprice", "note": "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END"}, [{"op": "dedupe", "params": {"keys": ["cust"], "keep": "aggregate", "aggregations": {"qty": "sum", "top": "max"}}}], "SELECT min(_row) AS row_no, cust, sum(qty) AS qty, max(top) AS top, arg_min(note, _row) FILTER (WHERE note IS NOT NULL) AS note FROM t GROUP BY cust", "orders")


@query()
def clean_case_title(spark, d):
    return clean.apply_ops(parts(spark, d, name="concat(p_name, ' o''neil')"), [{"op": "case", "params": {"mode": "title"}}])


@query("SELECT p_partkey AS row_no, p_name AS a, p_brand AS b FROM part WHERE p_partkey > 1")
def clean_set_header(spark, d):
    first = "CASE WHEN p_partkey = 1 THEN '{}' ELSE {} END"
    df = parts(spark, d, x=first.format("a", "p_name"), y=first.format("b", "p_brand"))
    return clean.apply_ops(df, [{"op": "set_header", "params": {"row": 3}}]).withColumnRenamed(ROW, "row_no")


@query("SELECT c_custkey + 2 AS row_no, '  ' || c_name || ' ' AS name, c_mktsegment AS segment, upper(trim(c_name)) AS name_ai, lower(c_mktsegment) AS segment_ai FROM customer")
def recipe_pipeline(spark, d):
    df = read(spark, d, "customer").selectExpr("c_custkey + 2 AS _row", "concat('  ', c_name, ' ') AS name", "c_mktsegment AS segment")
    steps = [
        {"op": "trim", "params": {"columns": ["name"]}},
        {"op": "case", "params": {"columns": ["name_ai"], "mode": "upper"}},
        {"op": "case", "params": {"columns": ["segment"], "mode": "lower"}},
    ]
    return recipe.apply_recipe(df, {"steps": steps}).withColumnRenamed(ROW, "row_no")


@query("SELECT c_custkey + 2 AS row_no, c_mktsegment AS segment, 'seg:' || lower(c_mktsegment) AS tag FROM customer")
def recipe_map(spark, d):
    df = read(spark, d, "customer").selectExpr("c_custkey + 2 AS _row", "c_mktsegment AS segment")
    return recipe.map_values(df, "segment", lambda v, _: f"seg:{v.lower()}", "tag", "tag").withColumnRenamed(ROW, "row_no")


# ---------------------------------------------------------------- profile

EMPTY = "('', 'nan', 'null', 'none', 'n/a', 'na')"
FORMAT_SQL = {k: f"regexp_full_match(t, '{p}')" for k, p in formats.FORMATS.items()}


def _profile_sql(c: str) -> str:
    """The profile of one column of the ledger, written out."""
    numeric = c == "balance"
    text = f"CAST({c} AS STRING)" if numeric else f"CASE WHEN lower(trim({c})) NOT IN {EMPTY} THEN trim({c}) END"
    fmt = "CASE " + " ".join(f"WHEN avg({e}::INT) >= 0.9 THEN '{k}'" for k, e in FORMAT_SQL.items()) + " END"
    number = "try_cast(t AS DOUBLE)"
    kind = "'number'" if numeric else (
        f"CASE WHEN {fmt} IN ('gst', 'pan', 'aadhaar', 'ifsc') THEN 'id' WHEN count(t) = 0 THEN 'text' "
        "WHEN avg(regexp_full_match(t, '[₹$€£]\\s*-?[0-9,]+(\\.[0-9]+)?')::INT) >= 0.8 THEN 'currency' "
        "WHEN avg((try_cast(replace(t, ',', '') AS DOUBLE) IS NOT NULL)::INT) FILTER (WHERE t IS NOT NULL) >= 0.9 THEN 'number' "
        "WHEN avg((try_strptime(t, '%Y-%m-%d') IS NOT NULL)::INT) FILTER (WHERE t IS NOT NULL) >= 0.9 THEN 'date' "
        "WHEN count(DISTINCT t) > 0.95 * count(t) AND count(t) > 10 THEN 'id' "
        "WHEN count(DISTINCT t) <= greatest(20, floor(0.05 * count(t))) THEN 'categorical' ELSE 'text' END"
    )
    return (
        f"SELECT '{c}' AS name, {kind} AS inferred_type, round(1 - count(t) / count(*), 4) AS null_rate, count(DISTINCT t) AS cardinality, "
        f"min({number}) AS min_num, max({number}) AS max_num, round(avg({number}), 2) AS mean, "
        f"CASE WHEN min({number}) IS NULL THEN min(t) END AS min_text, CASE WHEN min({number}) IS NULL THEN max(t) END AS max_text, "
        f"{'NULL' if numeric else fmt} AS detected_format FROM (SELECT {text} AS t FROM v)"
    )


PROFILED = ("name", "email", "pan", "balance", "price", "segment", "joined")


@query(f"WITH {VENDOR_SQL} " + " UNION ALL ".join(map(_profile_sql, PROFILED)))
def profile_columns(spark, d):
    return profile.profile_columns(vendors(spark, d, *PROFILED)).withColumn("mean", F.round("mean", 2))


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS STRING) AS value, count(*) AS n FROM orders GROUP BY ALL" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")) + ") SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS INT) AS rank FROM c QUALIFY rank <= 5")
def profile_top_values(spark, d):
    df = read(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")
    return profile.top_values(df).withColumnRenamed("column", "field")


@query()
def profile_streaming_top(spark, d):
    return profile.top_values_approximate(read(spark, d, "orders").select("o_orderstatus", "o_orderpriority"))


@query(f"WITH {VENDOR_SQL} SELECT " + ", ".join(f"round(avg({e}::INT), 4) AS is_{k}" for k, e in FORMAT_SQL.items()) + " FROM (SELECT trim(pan) AS t FROM v)")
def format_detect(spark, d):
    df = vendors(spark, d, "pan")
    return df.agg(*[F.round(F.avg(formats.matches(F.col("pan"), k).cast("int")), 4).alias(f"is_{k}") for k in formats.FORMATS])


@query(f"WITH {VENDOR_SQL} SELECT _row AS row_no, coalesce(regexp_full_match(trim(email), '{formats.FORMATS['email']}'), false) AS valid FROM v")
def value_check_format(spark, d):
    return validate.check_format(vendors(spark, d, "email"), "email", "email").select(F.col(ROW).alias("row_no"), "valid")


# ---------------------------------------------------------------- validation


def finding_query(name: str, columns: tuple[str, ...], rules: dict | None, where: str | None, sql: str):
    def run(spark, d):
        df = vendors(spark, d, *columns)
        out = validate.explicit_checks(df, rules) if rules is not None else validate.auto_checks(df)
        if where:
            out = out.filter(where)
        return out.select("row", F.col("column").alias("field"), "rule_name", "severity", "value")

    run.__name__ = name
    return query(f"WITH {VENDOR_SQL} {sql}")(run)


def _findings(c: str, rule: str, severity: str, value: str, source: str) -> str:
    return f"SELECT _row AS row, '{c}' AS field, '{rule}' AS rule_name, '{severity}' AS severity, {value} AS value FROM {source}"


_FULL = lambda c: f"({c} IS NOT NULL AND lower(trim({c})) NOT IN {EMPTY})"
_BAD = lambda c, f: f"{_FULL(c)} AND NOT regexp_full_match(trim({c}), '{formats.FORMATS[f]}')"
finding_query("rule_required", ("name", "email"), {"required": ["name", "email", "gone"]}, None, _findings("name", "required_field", "error", "NULL", "v WHERE name IS NULL") + " UNION ALL " + _findings("email", "required_field", "error", "NULL", f"v WHERE NOT {_FULL('email')}") + " UNION ALL SELECT 1, 'gone', 'required_column', 'error', NULL")
finding_query("rule_format", ("email", "pan"), {"formats": {"email": "email", "pan": "pan"}}, None, _findings("email", "format_email", "error", "trim(email)", f"v WHERE {_BAD('email', 'email')}") + " UNION ALL " + _findings("pan", "format_pan", "error", "trim(pan)", f"v WHERE {_BAD('pan', 'pan')}"))
finding_query("rule_range", ("balance",), {"ranges": {"balance": {"min": 0, "max": 9999}}}, None, _findings("balance", "range", "error", "CASE WHEN balance = floor(balance) THEN CAST(balance::BIGINT AS STRING) || '.0' ELSE CAST(balance AS STRING) END", "v WHERE balance < 0 OR balance > 9999"))
finding_query("rule_unique", ("pan",), {"unique": ["pan"]}, None, _findings("pan", "unique", "error", "trim(pan)", "(SELECT *, count(*) OVER (PARTITION BY trim(pan)) AS n FROM v) WHERE n > 1"))
finding_query("rule_reference", ("segment",), {"references": {"segment": ["Automobile", "BUILDING", "furniture", "household", "machinery"]}}, None, _findings("segment", "reference", "error", "trim(segment)", "v WHERE lower(trim(segment)) NOT IN ('automobile', 'building', 'furniture', 'household', 'machinery')"))
finding_query("rule_expression", ("balance", "segment"), {"expressions": [{"name": "positive", "expr": "balance > 0 and balance != 9750000", "severity": "warning"}, {"name": "broken", "expr": "no_such > 1"}]}, None, _findings("*", "positive", "warning", "NULL", "v WHERE NOT (balance > 0 AND balance <> 9750000)") + " UNION ALL SELECT 1, '*', 'broken', 'warning', NULL")
finding_query("auto_missing", ("name", "email", "segment"), None, "rule_name = 'missing_value'", _findings("name", "missing_value", "warning", "NULL", "v WHERE name IS NULL") + " UNION ALL " + _findings("email", "missing_value", "warning", "NULL", f"v WHERE NOT {_FULL('email')}"))
finding_query("auto_dominant_format", ("email", "pan"), None, "rule_name LIKE 'format%'", _findings("email", "format_email", "error", "trim(email)", f"v WHERE {_BAD('email', 'email')}") + " UNION ALL " + _findings("pan", "format_pan", "error", "trim(pan)", f"v WHERE {_BAD('pan', 'pan')}"))
finding_query("auto_duplicate_id", ("pan",), None, "rule_name = 'duplicate_id'", _findings("pan", "duplicate_id", "warning", "trim(pan)", f"(SELECT *, count(*) OVER (PARTITION BY trim(pan)) AS n FROM v WHERE NOT ({_BAD('pan', 'pan')})) WHERE n > 1"))
finding_query("auto_duplicate_row", ("segment", "joined"), None, "rule_name = 'duplicate_row'", _findings("*", "duplicate_row", "warning", "NULL", "(SELECT *, count(*) OVER (PARTITION BY segment, joined) AS n FROM v) WHERE n > 1"))


@query("SELECT o_orderkey AS row, 'amount' AS field, 'mixed_types' AS rule_name, 'warning' AS severity, 'n.a. yet' AS value FROM orders WHERE o_orderkey % 37 = 0")
def auto_mixed_types(spark, d):
    amount = "CASE WHEN o_orderkey % 37 = 0 THEN 'n.a. yet' ELSE CAST(o_custkey AS STRING) END AS amount"
    df = read(spark, d, "orders").selectExpr("o_orderkey AS _row", amount, "o_orderkey AS k")
    found = validate.auto_checks(df).filter("rule_name = 'mixed_types'")
    return found.select("row", F.col("column").alias("field"), "rule_name", "severity", "value")


@query(f"WITH {VENDOR_SQL}, f AS (" + _findings("pan", "format_pan", "error", "trim(pan)", f"v WHERE {_BAD('pan', 'pan')}") + " UNION ALL " + _findings("email", "format_email", "error", "trim(email)", f"v WHERE {_BAD('email', 'email')}") + " UNION ALL " + _findings("pan", "unique", "error", "trim(pan)", "(SELECT *, count(*) OVER (PARTITION BY trim(pan)) AS n FROM v) WHERE n > 1") + ") SELECT rule_name, severity, count(*) AS n FROM f GROUP BY ALL")
def validate_ruleset(spark, d):
    found = validate.validate(vendors(spark, d, "pan", "email"), {**validate.RULESETS["kyc"], "unique": ["pan"], "auto": False})
    return found.groupBy("rule_name", "severity").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- anomalies


@query(
    "WITH x AS (SELECT o_orderkey AS _row, CASE WHEN o_orderkey % 499 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price FROM orders), "
    "q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM x), "
    "b AS (SELECT _row, price, q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi, q3 - q1 AS span FROM x, q) "
    "SELECT _row AS row, 'column_outlier' AS kind, round(least(1.0, greatest(0.5, 0.5 + 0.5 * (CASE WHEN price < lo THEN lo - price ELSE price - hi END / (3 * span)))), 3) AS confidence, 'price' AS field FROM b WHERE price < lo OR price > hi"
)
def anomaly_iqr(spark, d):
    df = read(spark, d, "orders").selectExpr("o_orderkey AS _row", "CASE WHEN o_orderkey % 499 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price")
    return anomaly.column_outliers(df).select("row", "kind", "confidence", F.col("columns")[0].alias("field"))


@query(
    f"WITH {VENDOR_SQL}, c AS (SELECT trim(segment) AS value, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS kinds FROM v GROUP BY 1) "
    "SELECT _row AS row, 'rare_category' AS kind, round(1 - n / total, 3) AS confidence, 'segment' AS field FROM v JOIN c ON trim(v.segment) = c.value "
    "WHERE total >= 20 AND kinds <= greatest(10, 0.1 * total) AND n <= greatest(1, floor(0.01 * total))"
)
def anomaly_rare(spark, d):
    return anomaly.rare_categories(vendors(spark, d, "segment")).select("row", "kind", "confidence", F.col("columns")[0].alias("field"))


@query(
    f"WITH {VENDOR_SQL}, s AS (SELECT _row, regexp_replace(regexp_replace(trim(code), '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape FROM v), "
    "c AS (SELECT shape, count(*) AS n, sum(count(*)) OVER () AS total FROM s GROUP BY 1), "
    "t AS (SELECT * FROM c QUALIFY row_number() OVER (ORDER BY n DESC, shape DESC) = 1) "
    "SELECT _row AS row, 'pattern_break' AS kind, round(n / total, 3) AS confidence, 'code' AS field FROM s, t WHERE s.shape <> t.shape AND total >= 20 AND n / total >= 0.9 AND n < total"
)
def anomaly_pattern(spark, d):
    return anomaly.pattern_breaks(vendors(spark, d, "code")).select("row", "kind", "confidence", F.col("columns")[0].alias("field"))


@query()
def anomaly_near_dup(spark, d):
    return anomaly.near_duplicate_rows(vendors(spark, d, "email", "pan", "code"))


@query()
def anomaly_iforest(spark, d):
    df = read(spark, d, "events").selectExpr("event_id + 2 AS _row", "value", "user_id")
    return anomaly.multivariate_outliers(df, 0.01)


# ---------------------------------------------------------------- reconciliation

_A = "SELECT o_orderkey AS k, round(o_totalprice, 2) AS amount, o_orderstatus AS status, CAST(o_custkey AS STRING) AS cust FROM orders WHERE o_orderkey % 11 <> 0"
_B = (
    "SELECT o_orderkey AS k, round(CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 50 WHEN o_orderkey % 7 = 0 THEN o_totalprice + 0.04 ELSE o_totalprice END, 2) AS amount, "
    "CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE concat(' ', lower(o_orderstatus)) END AS status, CAST(o_custkey AS STRING) AS cust FROM orders WHERE o_orderkey % 19 <> 0"
)
_PAIRS = (
    f"WITH a AS ({_A}), b AS ({_B}), p AS (SELECT a.k, a.amount AS aa, b.amount AS ba, a.status AS sa, b.status AS sb, a.cust, "
    "abs(a.amount - b.amount) <= 0.05 AS same_amount, lower(trim(a.status)) = lower(trim(b.status)) AS same_status, a.amount = b.amount AS exact_amount FROM a JOIN b USING (k)) "
)


def ledgers(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")

    def side(sql: str) -> DataFrame:
        columns, where = sql.removeprefix("SELECT ").split(" FROM orders WHERE ")
        return orders.filter(where).select(F.expr(f"struct({columns})").alias("x")).select("x.*").withColumn(ROW, F.col("k"))

    a, b = side(_A), side(_B)
    return reconcile.reconcile(a, b, ["k"], {"numeric": 0.05})


@query(_PAIRS + "SELECT k, CASE WHEN exact_amount THEN 'L1' ELSE 'L2' END AS match_level, aa AS amount_a, ba AS amount_b FROM p WHERE same_amount AND same_status")
def recon_matched(spark, d):
    out = ledgers(spark, d).filter("bucket = 'matched'")
    return out.select("a.k", "match_level", F.col("a.amount").alias("amount_a"), F.col("b.amount").alias("amount_b"))


@query(_PAIRS + "SELECT k, 'amount' AS field, round(ba - aa, 6) AS diff_abs, round(100 * (ba - aa) / abs(aa), 4) AS diff_pct FROM p WHERE NOT same_amount UNION ALL SELECT k, 'status', NULL, NULL FROM p WHERE NOT same_status")
def recon_discrepancies(spark, d):
    out = ledgers(spark, d).filter("bucket = 'discrepancy'").select("a.k", F.explode("differences").alias("x"))
    return out.select("k", "x.field", "x.diff_abs", "x.diff_pct")


@query(f"WITH a AS ({_A}), b AS ({_B}) SELECT k, cust FROM a WHERE k NOT IN (SELECT k FROM b)")
def recon_only_a(spark, d):
    return ledgers(spark, d).filter("bucket = 'only_in_a'").select("a.k", "a.cust")


@query(f"WITH a AS ({_A}), b AS ({_B}) SELECT k, cust FROM b WHERE k NOT IN (SELECT k FROM a)")
def recon_only_b(spark, d):
    return ledgers(spark, d).filter("bucket = 'only_in_b'").select("b.k", "b.cust")


@query(_PAIRS + "SELECT 'amount' AS field, count(*) AS n, round(sum(abs(round(ba - aa, 6))), 4) AS total_abs FROM p WHERE NOT same_amount UNION ALL SELECT 'status', count(*), 0.0 FROM p WHERE NOT same_status")
def recon_variance(spark, d):
    return reconcile.variance_by_field(ledgers(spark, d))


@query(
    _PAIRS + ", n AS (SELECT count(*) FILTER (WHERE same_amount AND same_status) AS m, count(*) FILTER (WHERE NOT (same_amount AND same_status)) AS x, "
    "count(*) FILTER (WHERE same_amount AND same_status AND exact_amount) AS l1 FROM p), "
    "o AS (SELECT count(*) FILTER (WHERE k NOT IN (SELECT k FROM b)) AS a FROM a), w AS (SELECT count(*) FILTER (WHERE k NOT IN (SELECT k FROM a)) AS b FROM b) "
    "SELECT m AS matched, x AS discrepancies, a AS only_in_a, b AS only_in_b, round(m / (m + x + a), 4) AS match_rate, l1 AS level_1, m - l1 AS level_2, 0 AS level_3 FROM n, o, w"
)
def recon_summary(spark, d):
    return reconcile.summary(ledgers(spark, d))


@query()
def recon_fuzzy_keys(spark, d):
    names = read(spark, d, "supplier").selectExpr("s_suppkey + 2 AS _row", "s_name AS name", "s_acctbal AS amount")
    b = names.withColumn("name", F.when(F.col(ROW) % 3 == 0, F.translate("name", "0", "O")).otherwise(F.col("name")))
    return reconcile.reconcile(names, b, ["name"], {"numeric": 0.01}, fuzzy_keys=0.8)


@query(
    f"WITH a AS (SELECT o_custkey AS cust, sum(round(o_totalprice, 0)) AS amount FROM orders GROUP BY 1), b AS (SELECT o_custkey AS cust, sum(round(o_totalprice, 0)) + CASE WHEN o_custkey % 5 = 0 THEN 10 ELSE 0 END AS amount FROM orders WHERE o_custkey % 9 <> 0 GROUP BY 1) "
    "SELECT count(*) FILTER (WHERE a.amount = b.amount) AS matched, count(*) FILTER (WHERE a.amount <> b.amount) AS discrepancies, count(*) FILTER (WHERE b.cust IS NULL) AS only_in_a, 0 AS only_in_b FROM a LEFT JOIN b USING (cust)"
)
def recon_profile(spark, d):
    a = read(spark, d, "orders").selectExpr("o_orderkey AS _row", "o_custkey AS cust", "round(o_totalprice, 0) AS amount")
    extra = F.when((F.col("cust") % 5 == 0), 10.0).otherwise(0.0)
    b = a.filter("cust % 9 <> 0").groupBy("cust").agg(F.sum("amount").alias("amount"), F.min(ROW).alias(ROW)).withColumn("amount", F.col("amount") + extra)
    once = {"keys": ["cust"], "keep": "aggregate", "aggregations": {"amount": "sum"}}
    result = reconcile.run_profile(a, b.select(ROW, "cust", "amount"), {"keys": ["cust"], "dedupe_a": once})
    return reconcile.summary(result).select("matched", "discrepancies", "only_in_a", "only_in_b")


# ---------------------------------------------------------------- names and entities


@query()
def name_pairwise(spark, d):
    df = read(spark, d, "customer").selectExpr("c_custkey + 2 AS _row", "c_name AS a", "concat(translate(c_name, '#', ' '), CASE WHEN c_custkey % 3 = 0 THEN ' Ltd' ELSE '' END) AS b")
    return entity.match_names(df, "a", "b", threshold=80)


@query()
def name_cross(spark, d):
    nation = read(spark, d, "nation").selectExpr("n_nationkey + 2 AS _row", "n_name AS name", "CAST(n_regionkey AS STRING) AS region")
    return entity.match_names(nation, "name", group_by="region", threshold=40)


@query()
def entity_dedupe(spark, d):
    df = read(spark, d, "part").selectExpr("p_partkey + 2 AS _row", "p_name AS name", "p_brand AS brand", "p_type AS kind", "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_size END AS size")
    return entity.dedupe_entities(df, ["name", "brand", "kind"], threshold=97)[0]


# ---------------------------------------------------------------- health


@query(
    f"WITH {VENDOR_SQL}, f AS (SELECT _row AS row, 'missing' AS category FROM v WHERE NOT {_FULL('email')} UNION ALL SELECT _row, 'format' FROM v WHERE {_BAD('email', 'email')} "
    f"UNION ALL SELECT _row, 'format' FROM v WHERE {_BAD('pan', 'pan')} UNION ALL SELECT _row, 'duplicate' FROM (SELECT *, count(*) OVER (PARTITION BY trim(pan)) AS n FROM v) WHERE n > 1), "
    "c AS (SELECT category, count(DISTINCT row) AS n, any_value((SELECT count(*) FROM v)) AS total FROM f GROUP BY 1), "
    "p AS (SELECT category, n, round(CASE category WHEN 'missing' THEN 0.4 WHEN 'format' THEN 0.3 ELSE 0.2 END * (100.0 * n / total), 2) AS deduction FROM c) "
    "SELECT CAST(greatest(0, round_even(100 - sum(deduction), 0)) AS INT) AS score, CAST(sum(n) AS BIGINT) AS rows_affected, round(sum(deduction), 2) AS deductions FROM p"
)
def health_score(spark, d):
    df = vendors(spark, d, "email", "pan")
    rules = {"required": ["email"], "formats": {"email": "email", "pan": "pan"}, "unique": ["pan"]}
    flags = spark.createDataFrame([], anomaly.FLAG)
    out = report.health_score(df.count(), validate.explicit_checks(df, rules), flags)
    total = lambda f: F.aggregate("breakdown", F.lit(0.0), lambda a, x: a + x[f].cast("double"))
    return out.select("score", total("rows_affected").cast("bigint").alias("rows_affected"), F.round(total("deduction"), 2).alias("deductions"))


@query(
    f"WITH {VENDOR_SQL} SELECT _row AS row, 'email' AS field, CASE WHEN {_BAD('email', 'email')} THEN 'format' ELSE 'missing' END AS category FROM v WHERE NOT {_FULL('email')} OR {_BAD('email', 'email')}"
)
def report_highlights(spark, d):
    df = vendors(spark, d, "email")
    found = validate.explicit_checks(df, {"required": ["email"], "formats": {"email": "email"}})
    return report.highlights(found, spark.createDataFrame([], anomaly.FLAG)).select("row", F.col("column").alias("field"), "category")


# ---------------------------------------------------------------- risk


@query(
    "SELECT o_orderkey, CASE WHEN p >= 0.75 THEN 'critical' WHEN p >= 0.5 THEN 'high' WHEN p >= 0.25 THEN 'medium' ELSE 'low' END AS band FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS p FROM orders)"
)
def risk_bands(spark, d):
    return read(spark, d, "orders").select("o_orderkey", risk.band((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("band"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    risky = "(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END + CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)"
    return read(spark, d, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS _row",
        "l_quantity",
        "l_discount",
        "l_extendedprice",
        "l_returnflag",
        f"CASE WHEN {risky} >= 2 THEN 'fraud' ELSE 'ok' END AS label",
        f"CASE WHEN {risky} >= 2 THEN 'A' ELSE 'B' END AS outcome",
        f"CASE WHEN {risky} >= 2 THEN 1.0 ELSE 0.0 END AS leak",
    )


@query("SELECT 'leak' AS field UNION ALL SELECT 'outcome'")
def risk_leakage(spark, d):
    rows, _ = risk.resolve_label(_labelled(spark, d), "label")
    return risk.leakage(rows, ["l_quantity", "l_discount", "leak"], ["l_returnflag", "outcome"]).select(F.col("column").alias("field"))


@query()
def risk_score(spark, d):
    df = _labelled(spark, d).drop("outcome", "leak")
    model, card = risk.train(df, "label", "demo")
    return risk.score(df, model, card)


# ---------------------------------------------------------------- sources


@query("SELECT count(*) AS n, min(c_custkey) + 2 AS low, max(c_custkey) + 2 AS high FROM customer")
def source_row_numbers(spark, d):
    out = with_row_id(read(spark, d, "customer").select("c_custkey"))
    return out.agg(F.count_distinct(ROW).alias("n"), F.min(ROW).cast("bigint").alias("low"), F.max(ROW).alias("high"))


from tabguard import calls  # noqa: E402, F401  the queries of whole calls register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
