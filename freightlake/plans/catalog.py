"""The registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlake.functions import scalars
from freightlake.operators import commercial, contracts, digests, features, finance, headers, kpi, lineage, marts, profile, provenance, quality, retention, samples, standardize
from freightlake.session import scratch_dir
from freightlake.sources import files, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(orders: DataFrame) -> DataFrame:
    """Orders as a raw file would have them."""
    return orders.select(
        F.col("o_orderkey").cast("string").alias("Order ID"), F.col("o_custkey").cast("string").alias("customer"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Created-At"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"),
    )


NAMES = headers.NameMap(
    {"order_id": ("order id", "o_orderkey"), "customer_id": ("customer", "o_custkey"), "created_at": ("created at", "o_orderdate"), "total": ("amount", "o_totalprice"), "status": ("o_orderstatus",)},
    critical=("order_id", "customer_id", "created_at"),
)
CONTRACT = contracts.Contract.from_json_schema(
    {"title": "Orders", "type": "object", "required": ["order_id", "customer_id"], "properties": {"order_id": {"type": "integer"}, "customer_id": {"type": "integer"}, "created_at": {"type": "string", "format": "date"}, "total": {"type": "number", "x-scale": 2}, "status": {"type": "string"}}}
)
_RAW = "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total, o_orderstatus AS status FROM orders"


def damaged(orders: DataFrame) -> DataFrame:
    """Orders as text with some values that no contract takes: by rule, of every row whose key has a certain remainder."""
    raw = headers.map_headers(texts(orders), NAMES, keep=("note",)).withColumn("k", F.col("order_id").cast("long"))
    return raw.withColumns({
        "total": F.when(F.col("k") % 7 == 0, F.lit("n/a")).otherwise(F.col("total")),
        "customer_id": F.when(F.col("k") % 11 == 0, F.lit(" ")).otherwise(F.col("customer_id")),
    }).drop("k")


# 2.1 sources and sinks


@query(_RAW)
def csv_scan(spark, d):
    raw, place = texts(t(spark, d, "orders")), scratch_dir(spark)
    odd = F.col("Order ID").cast("long") % 2 == 1
    raw.where(odd).write.option("header", True).csv(f"{place}/a")
    raw.where(~odd).select(*reversed(raw.columns)).write.option("header", True).csv(f"{place}/b")
    return headers.map_headers(files.csv_scan(spark, [f"{place}/a/*.csv", f"{place}/b/*.csv"]), NAMES)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, 'run-1' AS run_id FROM orders")
def write_raw_read_stage(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    root = scratch_dir(spark)
    files.write_raw(rows.limit(0), root, "007")
    return files.read_stage(spark, files.write_raw(rows, root, "run-1"), "run-1")


@query("SELECT o_orderkey, o_orderstatus, '007' AS run_id FROM orders WHERE o_orderstatus = 'F'")
def write_clean_read_stage(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    root = scratch_dir(spark)
    path = files.write_clean(rows, root, "008")
    files.write_clean(rows.where("o_orderstatus = 'F'"), root, "007")
    return files.read_stage(spark, path, "007")


_VERSIONS = "SELECT 'run-1' AS run_id, 1 AS version, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS detail FROM orders UNION ALL SELECT 'run-1', 2, CAST(o_orderkey AS VARCHAR), 'F' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT '2', 1, 'k' || o_orderkey, CAST(o_totalprice > 1000 AS VARCHAR) FROM orders"


def _versions(spark, d):
    """A table of two runs with unlike columns and types, the first written twice."""
    orders, path = t(spark, d, "orders"), f"{scratch_dir(spark)}/table"
    runs.write_run(orders.select("o_orderkey", "o_custkey"), path, "run-1")
    runs.write_run(orders.select(F.concat(F.lit("k"), F.col("o_orderkey")).alias("o_orderkey"), (F.col("o_totalprice") > 1000).alias("large")), path, "2")
    runs.write_run(orders.where("o_orderstatus = 'F'").select("o_orderstatus", "o_orderkey"), path, "run-1")
    return path


@query(_VERSIONS)
def stage_versions(spark, d):
    path, out = _versions(spark, d), None
    for run, version, detail in (("run-1", 1, "o_custkey"), ("run-1", None, "o_orderstatus"), ("2", None, "large")):
        rows = files.read_stage(spark, path, run, version)
        part = rows.select("run_id", F.lit(version or (2 if run == "run-1" else 1)).alias("version"), F.col("o_orderkey").cast("string").alias("key"), F.col(detail).cast("string").alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 'run-1' AS run_id, 1::BIGINT AS version, count(*) AS rows, 'o_orderkey:long,o_custkey:long' AS columns, false AS latest FROM orders UNION ALL SELECT 'run-1', 2, count(*), 'o_orderstatus:string,o_orderkey:long', true FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT '2', 1, count(*), 'o_orderkey:string,large:boolean', true FROM orders")
def stage_log(spark, d):
    return runs.stage_log(spark, _versions(spark, d)).select("run_id", "version", "rows", F.array_join("columns", ",").alias("columns"), "latest")


@query("SELECT '2' AS run_id, 'k' || o_orderkey AS o_orderkey, o_totalprice > 1000 AS large, NULL AS o_orderstatus FROM orders UNION ALL SELECT 'run-1', CAST(o_orderkey AS VARCHAR), NULL, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def runs_together(spark, d):
    return runs.read_runs(spark, _versions(spark, d))


def _odd_records(spark, d):
    """Files of orders whose notes hold separators, quotes and line breaks, and whose records lack fields or have too many, by key."""
    key, place = F.col("o_orderkey"), f"{scratch_dir(spark)}/odd"
    note = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', ""so""'), F.when(key % 3 == 0, F.lit("\nnext line")).otherwise(F.lit("")), F.lit('"'))
    fields = F.when(key % 5 == 0, F.array(key.cast("string"))).when(key % 7 == 0, F.array(key.cast("string"), note, F.col("o_orderstatus"), F.lit("extra"), F.lit('"a, b"'))).otherwise(F.array(key.cast("string"), note, F.col("o_orderstatus")))
    lines = t(spark, d, "orders").select((key % 4).alias("part"), F.lit(1).alias("row"), F.array_join(fields, ",").alias("value"))
    heads = lines.select("part").distinct().select("part", F.lit(0).alias("row"), F.lit("order_id,note,status").alias("value"))
    lines.unionByName(heads).repartition("part").sortWithinPartitions("part", "row").drop("row").write.partitionBy("part").text(place)
    return files.csv_scan(spark, f"{place}/part=*")


_ODD = """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || ', "so"' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'next line' ELSE '' END END AS note, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'short' WHEN o_orderkey % 7 = 0 THEN 'long' END AS record_shape, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 THEN 'extra|a, b' END AS overflow FROM orders"""


@query(_ODD)
def csv_odd_records(spark, d):
    rows = _odd_records(spark, d)
    return rows.select("order_id", "note", "status", "record_shape", F.array_join("overflow_fields", "|").alias("overflow"))


@query(f"SELECT order_id, record_shape IS NULL AND status IS NOT NULL AS accepted, CASE WHEN record_shape = 'short' THEN 'record:shape,status:required' WHEN record_shape = 'long' THEN 'record:shape' ELSE '' END AS reasons FROM ({_ODD})")
def csv_quarantine(spark, d):
    contract = contracts.Contract.from_json_schema({"required": ["order_id", "status"], "properties": {"order_id": {"type": "integer"}, "note": {"type": "string"}, "status": {"type": "string"}}})
    good, bad = contracts.quarantine(_odd_records(spark, d), contract, shape=files.SHAPE)
    return good.select("order_id", F.lit(True).alias("accepted"), F.lit("").alias("reasons")).unionByName(bad.select("order_id", F.lit(False).alias("accepted"), F.array_join("reasons", ",").alias("reasons")))


# 2.2 headers


@query(_RAW)
def map_headers(spark, d):
    return headers.map_headers(texts(t(spark, d, "orders")), NAMES)


@query(
    "SELECT status AS source_file, c AS \"column\", true AS present, count(*) AS rows, count(*) - count(*) FILTER (WHERE c = 'customer_id' AND k % 11 = 0) AS filled, (count(*) - count(*) FILTER (WHERE c = 'customer_id' AND k % 11 = 0)) / count(*) AS fill_rate FROM (SELECT o_orderstatus AS status, o_orderkey AS k, unnest(['order_id', 'customer_id', 'created_at']) AS c FROM orders) GROUP BY ALL"
)
def critical_column_report(spark, d):
    rows = damaged(t(spark, d, "orders")).withColumn("source", F.col("status"))
    return headers.critical_column_report(rows, NAMES, "source")


@query(
    """SELECT f AS folder, c AS "column", NOT (f = 'b' AND c = 'customer_id') AS present, count(*) AS rows, CAST(count(*) FILTER (WHERE NOT (f = 'b' AND c = 'customer_id')) AS BIGINT) AS filled FROM (SELECT CASE WHEN o_orderkey % 2 = 1 THEN 'a' ELSE 'b' END AS f, unnest(['order_id', 'customer_id', 'created_at']) AS c FROM orders) GROUP BY ALL"""
)
def critical_columns_by_file(spark, d):
    """Presence by each file's own header; the files of one folder lack a column."""
    raw, place = texts(t(spark, d, "orders")), scratch_dir(spark)
    odd = F.col("Order ID").cast("long") % 2 == 1
    raw.where(odd).write.option("header", True).csv(f"{place}/a")
    raw.where(~odd).drop("customer").write.option("header", True).csv(f"{place}/b")
    paths = [f"{place}/a/*.csv", f"{place}/b/*.csv"]
    report = headers.critical_column_report(files.csv_scan(spark, paths), NAMES, files.SOURCE_FILE, files.csv_headers(spark, paths))
    folder = F.element_at(F.split("source_file", "/"), -2)
    return report.groupBy(folder.alias("folder"), "column").agg(F.min("present").alias("present"), F.sum("rows").alias("rows"), F.sum("filled").alias("filled"))


@query("SELECT 'note' AS header, count(*) AS rows, count(o_orderpriority) AS non_null, min(o_orderpriority) AS least, max(o_orderpriority) AS largest FROM orders")
def unmapped_header_report(spark, d):
    return headers.unmapped_header_report(texts(t(spark, d, "orders")), NAMES)


@query("SELECT header, value, md5('s' || value) AS hash FROM (SELECT DISTINCT 'note' AS header, o_orderpriority AS value FROM orders UNION SELECT DISTINCT 'phone', CAST(o_custkey * 7 AS VARCHAR) FROM orders) QUALIFY row_number() OVER (PARTITION BY header ORDER BY md5('s' || value), value) <= 32")
def header_samples(spark, d):
    """Samples of two parts of the table, merged."""
    raw = texts(t(spark, d, "orders")).withColumn("phone", (F.col("customer").cast("long") * 7).cast("string"))
    parts = [samples.sample_columns(raw.where(F.col("Order ID").cast("long") % 2 == k), ["note", "phone"]) for k in (0, 1)]
    return samples.merge_samples(parts[0].unionByName(parts[1]))


def _overlap_sql(value: str, known: str) -> str:
    """The share of common values among the 32 of least hash of two samples of 32."""
    one = lambda v: f"(SELECT v FROM (SELECT DISTINCT {v} AS v FROM orders) ORDER BY md5('s' || v), v LIMIT 32)"
    return f"(SELECT avg(CASE WHEN s THEN 1.0 ELSE 0.0 END) FROM (SELECT v, count(*) = 2 AS s FROM (SELECT v FROM {one(value)} UNION ALL SELECT v FROM {one(known)}) GROUP BY v ORDER BY md5('s' || v), v LIMIT 32))"


_CLIENT = _overlap_sql("CAST(o_custkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)")
_GRAMS = lambda a, b: f"(SELECT CAST(count(*) FILTER (WHERE n = 2) AS DOUBLE) / count(*) FROM (SELECT g, count(*) AS n FROM (SELECT DISTINCT 1 AS w, substr(' {a} ', i, 3) AS g FROM range(1, {len(a) + 1}) r(i) UNION ALL SELECT DISTINCT 2, substr(' {b} ', i, 3) FROM range(1, {len(b) + 1}) q(i)) GROUP BY g))"


@query(f"SELECT header, proposal, round(l, 6) AS name_likeness, round(o, 6) AS value_overlap, round((l + o) / 2, 6) AS score FROM (SELECT 'customer_ref' AS header, 'customer_id' AS proposal, greatest({_GRAMS('customer ref', 'customer id')}, {_GRAMS('customer ref', 'customer')}) AS l, {_CLIENT} AS o UNION ALL SELECT 'order_status', 'status', {_GRAMS('order status', 'status')}, {_overlap_sql('o_orderstatus', 'o_orderstatus')}) ")
def alias_proposals(spark, d):
    """Columns under new names, held against the mapped table; only proposals of a score of 0.5 or more."""
    orders = t(spark, d, "orders")
    fresh = texts(orders).select(F.col("Order ID"), F.col("customer").alias("customer_ref"), F.col("status").alias("order_status"))
    known = headers.NameMap({"order_id": ("order id",), "customer_id": ("customer",), "status": ()})
    return samples.alias_proposals(fresh, known, texts(orders), least=0.5)


# 2.3 contracts

_DAMAGED = "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS customer_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS total, o_orderstatus AS status, o_orderpriority AS note FROM orders"


@query(f"SELECT TRY_CAST(order_id AS BIGINT) AS order_id, TRY_CAST(customer_id AS BIGINT) AS customer_id, TRY_CAST(created_at AS DATE) AS created_at, CAST(TRY_CAST(total AS DECIMAL(18,2)) AS DOUBLE) AS total, status FROM ({_DAMAGED})")
def conform(spark, d):
    return contracts.conform(damaged(t(spark, d, "orders")), CONTRACT).withColumn("total", F.col("total").cast("double"))


@query(
    f"WITH x AS ({_DAMAGED}) SELECT order_id AS key, 'total' AS \"column\", 'cast' AS reason, total AS value FROM x WHERE TRY_CAST(total AS DECIMAL(18,2)) IS NULL UNION ALL SELECT order_id, 'customer_id', 'required', customer_id FROM x WHERE trim(customer_id) = '' UNION ALL SELECT NULL, 'note', 'extra', NULL"
)
def contract_violations(spark, d):
    return contracts.contract_violations(damaged(t(spark, d, "orders")), CONTRACT, "order_id")


@query(
    f"WITH x AS ({_DAMAGED}) SELECT order_id, CASE WHEN trim(customer_id) = '' THEN CASE WHEN total = 'n/a' THEN 'customer_id:required,total:cast' ELSE 'customer_id:required' END WHEN total = 'n/a' THEN 'total:cast' ELSE '' END AS reasons, total <> 'n/a' AND trim(customer_id) <> '' AS accepted FROM x"
)
def quarantine(spark, d):
    good, bad = contracts.quarantine(damaged(t(spark, d, "orders")), CONTRACT)
    good = good.select("order_id", F.lit("").alias("reasons"), F.lit(True).alias("accepted"))
    return good.unionByName(bad.select("order_id", F.array_join("reasons", ",").alias("reasons"), F.lit(False).alias("accepted")))


NESTED = contracts.Contract.from_json_schema({
    "title": "Orders with lines", "required": ["order_id", "lines"], "properties": {
        "order_id": {"type": "integer", "minimum": 1},
        "lines": {"type": "array", "maxItems": 6, "items": {"type": "object", "required": ["part"], "properties": {"part": {"type": "integer"}, "quantity": {"type": "integer", "maximum": 45}, "flags": {"type": "array", "items": {"type": "string", "enum": ["A", "N", "F", "O"]}}}}},
        "priority": {"type": "object", "required": ["rank"], "properties": {"rank": {"type": "integer", "minimum": 2}, "name": {"type": "string", "pattern": "^[A-Z]", "maxLength": 13}}},
    },
})


def _nested(spark, d):
    """Orders with their lines and priority as JSON text; parts of some lines are no numbers, by key."""
    part = F.when(F.col("l_partkey") % 50 == 0, F.concat(F.lit("p"), F.col("l_partkey"))).otherwise(F.col("l_partkey").cast("string"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", F.struct(part.alias("part"), F.col("l_quantity").cast("int").alias("quantity"), F.array("l_returnflag", "l_linestatus").alias("flags")).alias("json"))
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["json"])).alias("lines"))
    rank = F.split("o_orderpriority", "-")
    priority = F.to_json(F.struct(rank[0].alias("rank"), rank[1].alias("name")))
    return t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("order_id"), "lines", priority.alias("priority"))


_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) - 1 AS i FROM lineitem)"


@query(
    f"""WITH l AS {_LINES} SELECT CAST(l_orderkey AS VARCHAR) AS key, 'lines[' || i || '].part' AS "column", 'cast' AS reason, 'p' || l_partkey AS value FROM l WHERE l_partkey % 50 = 0
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'lines[' || i || '].quantity', 'maximum', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) FROM l WHERE CAST(l_quantity AS INTEGER) > 45
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'lines[' || i || '].flags[0]', 'enum', l_returnflag FROM l WHERE l_returnflag NOT IN ('A', 'N', 'F', 'O')
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'lines[' || i || '].flags[1]', 'enum', l_linestatus FROM l WHERE l_linestatus NOT IN ('A', 'N', 'F', 'O')
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'lines', 'maxItems', CAST(count(*) AS VARCHAR) FROM l GROUP BY l_orderkey HAVING count(*) > 6
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'lines', 'required', NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM l)
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'order_id', 'minimum', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey < 1
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'priority.rank', 'minimum', split_part(o_orderpriority, '-', 1) FROM orders WHERE CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) < 2
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'priority.name', 'maxLength', split_part(o_orderpriority, '-', 2) FROM orders WHERE length(split_part(o_orderpriority, '-', 2)) > 13
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'priority.name', 'pattern', split_part(o_orderpriority, '-', 2) FROM orders WHERE NOT regexp_matches(split_part(o_orderpriority, '-', 2), '^[A-Z]')"""
)
def nested_violations(spark, d):
    return contracts.contract_violations(_nested(spark, d), NESTED, "order_id")


@query("WITH l AS (SELECT l_orderkey AS k, count(*) AS n, sum(CAST(l_quantity AS INTEGER)) AS q, sum(CASE WHEN l_partkey % 50 <> 0 THEN l_partkey END) AS p FROM lineitem GROUP BY 1) SELECT o_orderkey AS order_id, CAST(n AS INTEGER) AS lines, CAST(q AS BIGINT) AS quantity, CAST(p AS BIGINT) AS parts, CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) AS rank FROM orders LEFT JOIN l ON k = o_orderkey")
def nested_conform(spark, d):
    rows, add = contracts.conform(_nested(spark, d), NESTED), lambda f: F.aggregate("lines", F.lit(None).cast("long"), lambda s, x: F.coalesce(s + x[f], s, x[f]))
    return rows.select("order_id", F.when(F.col("lines").isNotNull(), F.size("lines")).alias("lines"), add("quantity").alias("quantity"), add("part").alias("parts"), F.col("priority.rank").alias("rank"))


# 2.4 quality


def _report_sql(rule: str, column: str, checked: str, failed: str, source: str, severity: str = "error", threshold: float = 1.0) -> str:
    return f"""SELECT '{rule}' AS rule, '{column}' AS "column", checked, failed, CASE WHEN checked > 0 THEN 1 - failed / checked ELSE 1.0 END AS pass_rate, '{severity}' AS severity, CASE WHEN (CASE WHEN checked > 0 THEN 1 - failed / checked ELSE 1.0 END) < {threshold} THEN 'fail' ELSE 'pass' END AS status FROM (SELECT CAST({checked} AS BIGINT) AS checked, CAST({failed} AS BIGINT) AS failed FROM {source})"""


_POLICY = " UNION ALL ".join([
    _report_sql("not_null", "o_orderkey", "count(*)", "count(*) FILTER (WHERE o_orderkey IS NULL)", "orders"),
    _report_sql("accepted_values", "o_orderstatus", "count(o_orderstatus)", "count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O'))", "orders", "error", 0.99),
    _report_sql("range", "o_totalprice", "count(o_totalprice)", "count(*) FILTER (WHERE o_totalprice NOT BETWEEN 1000 AND 400000)", "orders", "warn", 0.5),
    _report_sql("pattern", "o_orderpriority", "count(o_orderpriority)", "count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-'))", "orders", "warn", 0.9),
])
_UNIQUE = _report_sql("unique", "l_orderkey,l_linenumber", "sum(n)", "sum(n - 1)", "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
_ORDERING = _report_sql("ordering", "o_orderdate<=l_shipdate", "count(*)", "count(*) FILTER (WHERE l_shipdate < o_orderdate)", "lineitem JOIN orders ON l_orderkey = o_orderkey")
_FOREIGN = _report_sql("foreign_key", "o_orderkey", "count(o_orderkey)", "count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))", "orders")
_IQR = _report_sql("iqr_outlier", "value", "count(*)", "count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))", "events JOIN (SELECT event_type AS e, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.75), 4) AS q3 FROM events GROUP BY 1) ON e = event_type", "warn", 0.9)


def _rules():
    return [
        quality.not_null("o_orderkey"), quality.accepted_values("o_orderstatus", ["F", "O"], threshold=0.99),
        quality.in_range("o_totalprice", 1000, 400000, severity="warn", threshold=0.5), quality.pattern("o_orderpriority", "^[1-4]-", severity="warn", threshold=0.9),
    ]


@query(_POLICY)
def evaluate_policy(spark, d):
    return quality.evaluate_policy(t(spark, d, "orders"), _rules())


@query(_report_sql("not_null", "customer_id", "count(*)", "count(*) FILTER (WHERE o_orderkey % 11 = 0)", "orders", "error", 0.95))
def rule_not_null(spark, d):
    return quality.evaluate_policy(damaged(t(spark, d, "orders")), [quality.not_null("customer_id", threshold=0.95)])


@query(_UNIQUE)
def rule_unique(spark, d):
    return quality.unique_key(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(_report_sql("accepted_values", "o_orderstatus", "count(o_orderstatus)", "count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O'))", "orders", "error", 0.99))
def rule_accepted_values(spark, d):
    return quality.evaluate_policy(t(spark, d, "orders"), [_rules()[1]])


@query(_report_sql("range", "o_totalprice", "count(o_totalprice)", "count(*) FILTER (WHERE o_totalprice NOT BETWEEN 1000 AND 400000)", "orders", "warn", 0.5))
def rule_range(spark, d):
    return quality.evaluate_policy(t(spark, d, "orders"), [_rules()[2]])


@query(_report_sql("pattern", "o_orderpriority", "count(o_orderpriority)", "count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-'))", "orders", "warn", 0.9))
def rule_pattern(spark, d):
    return quality.evaluate_policy(t(spark, d, "orders"), [_rules()[3]])


@query(_ORDERING)
def rule_ordering(spark, d):
    lines = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.evaluate_policy(lines, [quality.ordering("o_orderdate", "l_shipdate")])


@query(_FOREIGN)
def rule_foreign_key(spark, d):
    return quality.foreign_key(t(spark, d, "orders"), t(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query(_IQR)
def rule_iqr_outlier(spark, d):
    return quality.iqr_outlier(t(spark, d, "events"), "value", "event_type")


@query(" UNION ALL ".join([_POLICY, _UNIQUE, _ORDERING, _FOREIGN, _IQR]))
def quality_report(spark, d):
    return quality.quality_report([one_scan_report(spark, d), rule_iqr_outlier(spark, d)])


_SEGMENTS = _report_sql("accepted_values", "c_mktsegment", "count(c_mktsegment)", "count(*) FILTER (WHERE c_mktsegment NOT IN (SELECT o_orderpriority FROM orders))", "customer", "warn", 0.5)


@query(" UNION ALL ".join([_POLICY, _UNIQUE, _ORDERING, _FOREIGN]))
def one_scan_report(spark, d):
    """All rules of orders and lineitem, one scan of each."""
    rules = [
        *[quality.OfTable("orders", r) for r in _rules()], quality.Unique("lineitem", ("l_orderkey", "l_linenumber")),
        quality.Ordered("lineitem", "l_shipdate", "l_orderkey", "orders", "o_orderdate", "o_orderkey"), quality.Known("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ]
    return quality.compiled_report({name: t(spark, d, name) for name in ("orders", "lineitem")}, rules)


@query(_SEGMENTS)
def rule_accepted_from_table(spark, d):
    """Values that another table lists, however many."""
    rules = [quality.Known("customer", "c_mktsegment", "orders", "o_orderpriority", severity="warn", threshold=0.5, name="accepted_values")]
    return quality.compiled_report({name: t(spark, d, name) for name in ("customer", "orders")}, rules)


@query(_POLICY)
def write_report(spark, d):
    path = files.write_report(evaluate_policy(spark, d), f"{scratch_dir(spark)}/quality_report.json")
    return spark.read.schema(quality.REPORT).json(path)


# 2.5 profiles


def _numeric_sql(c: str, source: str) -> str:
    return f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\", CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS largest, round(CAST(sum(CAST({c} AS DECIMAL(28,6))) AS DOUBLE) / count({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3 FROM {source}"


@query(_numeric_sql("o_totalprice", "orders"))
def profile_numeric(spark, d):
    return profile.profile_numeric(t(spark, d, "orders"), ["o_totalprice"])


_RUNS_PROFILE = lambda c: f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS largest, round(CAST(sum(CAST({c} AS DECIMAL(28,6))) AS DOUBLE) / count({c}), 6) AS mean, round(stddev_samp({c}), 4) AS sd, true AS distinct_near, true AS q1_near, true AS median_near, true AS q3_near FROM orders"


@query(" UNION ALL ".join(map(_RUNS_PROFILE, ("o_totalprice", "o_custkey"))))
def profile_runs(spark, d):
    """Sketches of two runs, stored and merged; what they estimate is held against the rows: 1 % of ranks, 4 % of distinct values."""
    orders, path, columns = t(spark, d, "orders"), f"{scratch_dir(spark)}/profiles", ["o_totalprice", "o_custkey"]
    for run, rows in (("f", orders.where("o_orderstatus = 'F'")), ("rest", orders.where("o_orderstatus <> 'F'"))):
        runs.write_run(profile.profile_sketch(rows, columns), path, run)
    told = profile.profile_of_sketches(profile.merge_sketches(runs.read_runs(spark, path))).where("column is not null")
    ends = {r["column"]: r for r in told.collect()}  # a row for each column
    near = lambda c, q, p: (F.count_if(F.col(c) < ends[c][q]) / F.count(c) <= p + 0.01) & (F.count_if(F.col(c) <= ends[c][q]) / F.count(c) >= p - 0.01)
    checks = [F.struct(F.lit(c).alias("of"), (F.abs(F.count_distinct(c) - ends[c]["distinct"]) <= 0.04 * F.count_distinct(c)).alias("distinct_near"), near(c, "q1", 0.25).alias("q1_near"), near(c, "median", 0.5).alias("median_near"), near(c, "q3", 0.75).alias("q3_near")) for c in columns]
    held = orders.agg(F.array(*checks).alias("c")).select(F.inline("c"))
    return told.join(held, F.col("column") == F.col("of")).select("column", "rows", "nulls", "least", "largest", "mean", F.round("sd", 4).alias("sd"), "distinct_near", "q1_near", "median_near", "q3_near")


@query(
    "WITH v AS (SELECT 'p_brand' AS c, p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part), n AS (SELECT c, v, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS k, sum(n) OVER (PARTITION BY c) AS s FROM n) SELECT c AS \"column\", CAST(k AS INTEGER) AS rank, v AS value, n, n / s AS share FROM r WHERE k <= 5"
)
def profile_categorical(spark, d):
    return profile.profile_categorical(t(spark, d, "part"), ["p_brand", "p_type"])


@query("SELECT CAST(CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 11 ELSE floor(o_totalprice / 50000) + 1 END AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1")
def histogram(spark, d):
    return profile.histogram(t(spark, d, "orders"), "o_totalprice", 0, 500000, 10)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def correlation(spark, d):
    return profile.correlation(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


# 2.6 standardisation


@query(r"SELECT doc_id, trim(lower(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS text FROM documents")
def normalize_text(spark, d):
    return t(spark, d, "documents").select("doc_id", scalars.normalize_text(F.col("text")).alias("text"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def parse_timestamp(spark, d):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(key % 2 == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return t(spark, d, "orders").select("o_orderkey", F.to_date(scalars.parse_timestamp(text, ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy"])).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS total FROM orders")
def parse_number(spark, d):
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("x")).otherwise(F.concat(F.lit(" "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)))
    return t(spark, d, "orders").select("o_orderkey", scalars.parse_number(text).cast("double").alias("total"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fulfilled' WHEN 'O' THEN 'open' ELSE 'UNKNOWN' END AS status_name FROM orders")
def map_codes(spark, d):
    lookup = spark.createDataFrame([("F", "fulfilled"), ("O", "open")], "code string, name string")
    return standardize.map_codes(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", lookup, "code", "name", "status_name").drop("o_orderstatus")


@query(
    "SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey, l_suppkey, l_quantity) = 1"
)
def deduplicate(spark, d):
    order = [F.desc("l_shipdate"), F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_quantity")]
    return standardize.deduplicate(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")


# 2.7 features


@query(
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(week(o_orderdate) AS INTEGER) AS iso_week, CAST(dayofweek(o_orderdate) AS INTEGER) AS weekday, CAST(o_orderdate AS DATE) = last_day(o_orderdate) AS is_month_end FROM orders"
)
def calendar_features(spark, d):
    return features.calendar_features(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


_SPEND = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"


@query(
    f"SELECT o_custkey, count(*) AS orders, {_SPEND} AS spend, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, {_SPEND} / count(*) AS mean_order, CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS INTEGER) AS tenure_days FROM orders GROUP BY 1"
)
def entity_aggregates(spark, d):
    return features.entity_aggregates(t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


@query(
    "SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS sequence, CAST(date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS INTEGER) AS days_since FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
)
def gap_features(spark, d):
    return features.gap_features(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "sequence", "days_since")


@query(
    "SELECT o_orderkey, count(*) OVER w AS rolling_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS rolling_sum FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)"
)
def rolling_features(spark, d):
    return features.rolling_features(t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice").select("o_orderkey", "rolling_count", "rolling_sum")


@query(
    "SELECT event_id, count(*) OVER w AS rolling_count, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS rolling_sum FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 5400 SECONDS PRECEDING AND CURRENT ROW)"
)
def rolling_range(spark, d):
    """The last 90 minutes of each kind of event, few kinds that hold many rows each."""
    return features.rolling_range(t(spark, d, "events").select("event_id", "event_type", "ts", "value"), "event_type", "ts", "value", 5400).select("event_id", "rolling_count", "rolling_sum")


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"n_P\" FROM orders GROUP BY 1")
def category_counts(spark, d):
    return features.category_counts(t(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, round((l_extendedprice - m) / s, 4) AS z FROM lineitem JOIN (SELECT l_returnflag AS f, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON f = l_returnflag"
)
def scale_features(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    return features.scale_features(rows, "l_extendedprice", "l_returnflag", digits=4).drop("l_extendedprice")


# 2.8 KPIs

_MEASURES = {"orders": "count(*)", "revenue": "sum(cast(o_totalprice as decimal(18,2)))", "average_order": "cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*)"}
_CUSTOMERS = "orders JOIN customer ON o_custkey = c_custkey"
_MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"


def _customers(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


@query(" UNION ALL ".join(f"SELECT {_MONTH} AS period, c_mktsegment, '{n}' AS measure, CAST({m} AS DOUBLE) AS value FROM {_CUSTOMERS} GROUP BY 1, 2" for n, m in _MEASURES.items()))
def kpi_evaluate(spark, d):
    return kpi.kpi_evaluate(_customers(spark, d), "o_orderdate", "month", ["c_mktsegment"], _MEASURES)


@query(
    f"WITH k AS (SELECT {_MONTH} AS period, 'revenue' AS measure, {_SPEND} AS value FROM orders GROUP BY 1) SELECT a.period, a.measure, a.value, b.value AS prior, a.value - b.value AS change, CASE WHEN b.value <> 0 THEN (a.value - b.value) / b.value END AS relative_change FROM k a LEFT JOIN k b ON year(b.period) * 12 + month(b.period) + 12 = year(a.period) * 12 + month(a.period)"
)
def kpi_period_change(spark, d):
    kpis = kpi.kpi_evaluate(t(spark, d, "orders"), "o_orderdate", "month", [], {"revenue": _MEASURES["revenue"]})
    return kpi.kpi_period_change(kpis, ["measure"])


@query(
    f"WITH k AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, n_name, {_SPEND} AS value FROM {_CUSTOMERS} JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT year, n_name, value, CAST(row_number() OVER (PARTITION BY year ORDER BY value DESC, n_name) AS INTEGER) AS rank FROM k QUALIFY row_number() OVER (PARTITION BY year ORDER BY value DESC, n_name) <= 3"
)
def kpi_top_k(spark, d):
    rows = _customers(spark, d).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kpis = rows.groupBy(F.year("o_orderdate").alias("year"), "n_name").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return kpi.kpi_top_k(kpis, ["year"], "n_name", "value", 3)


@query(f"SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS orders, {_SPEND} AS revenue FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def kpi_rollup(spark, d):
    return kpi.kpi_rollup(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], {"orders": "count(*)", "revenue": "cast(sum(cast(o_totalprice as decimal(18,2))) as double)"})


# 2.9 commercial


@query(
    "WITH c AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last_day, count(*) AS frequency, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS m FROM orders GROUP BY 1), n AS (SELECT *, CAST(ntile(5) OVER (ORDER BY last_day, o_custkey) AS INTEGER) AS r, CAST(ntile(5) OVER (ORDER BY frequency, o_custkey) AS INTEGER) AS f, CAST(ntile(5) OVER (ORDER BY m, o_custkey) AS INTEGER) AS mm FROM c) SELECT o_custkey, last_day, frequency, CAST(m AS DOUBLE) AS monetary, r, f, mm AS m, CAST(r * 100 + f * 10 + mm AS INTEGER) AS segment FROM n"
)
def rfm_segments(spark, d):
    return commercial.rfm_segments(t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


@query(
    "WITH m AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS m FROM orders), f AS (SELECT o_custkey, min(m) AS cohort FROM m GROUP BY 1) SELECT cohort, CAST(m - cohort AS INTEGER) AS age, count(*) AS customers FROM m JOIN f USING (o_custkey) GROUP BY 1, 2"
)
def cohort_retention(spark, d):
    return commercial.cohort_retention(t(spark, d, "orders"), "o_custkey", "o_orderdate")


@query(
    "WITH m AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS m FROM orders), f AS (SELECT o_custkey, min(m) AS cohort FROM m GROUP BY 1) SELECT cohort, CAST(m - cohort AS INTEGER) AS age, count(*) AS customers FROM m JOIN f USING (o_custkey) GROUP BY 1, 2"
)
def month_retention(spark, d):
    return retention.month_retention(t(spark, d, "orders"), "o_custkey", "o_orderdate")


@query(
    "WITH d AS (SELECT DISTINCT o_custkey AS c, CAST(o_orderdate AS DATE) AS d FROM orders), p AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM d), (SELECT max(d) FROM d), INTERVAL 30 DAYS)) AS DATE) AS day), b AS (SELECT DISTINCT day, c FROM p JOIN d ON d BETWEEN day - 89 AND day), a AS (SELECT DISTINCT day, c FROM p JOIN d ON d BETWEEN day + 1 AND day + 90) SELECT day, (SELECT count(*) FROM b WHERE b.day = p.day) AS before, (SELECT count(*) FROM a WHERE a.day = p.day) AS after, (SELECT count(*) FROM a JOIN b USING (day, c) WHERE a.day = p.day) AS retained FROM p"
)
def rolling_retention(spark, d):
    return retention.rolling_retention(t(spark, d, "orders"), "o_custkey", "o_orderdate")


@query(
    "WITH r AS (SELECT l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1), c AS (SELECT l_partkey, v, row_number() OVER w AS k, CAST(coalesce(sum(v) OVER (ORDER BY v DESC, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE) AS s FROM r WINDOW w AS (ORDER BY v DESC, l_partkey)) SELECT l_partkey, CAST(v AS DOUBLE) AS revenue, k AS rank, round(s, 9) AS share_before, CASE WHEN s < 0.8 THEN 'A' WHEN s < 0.95 THEN 'B' ELSE 'C' END AS class FROM c"
)
def abc_classes(spark, d):
    return commercial.abc_classes(t(spark, d, "lineitem"), "l_partkey", "l_extendedprice")


@query(
    "WITH s AS (SELECT a.n_name AS from_nation, b.n_name AS to_nation, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey) SELECT from_nation, to_nation, count(*) AS shipments, CAST(sum(days) AS DOUBLE) / count(*) AS mean_days, round(quantile_cont(days, 0.25), 4) AS q1, round(quantile_cont(days, 0.5), 4) AS median, round(quantile_cont(days, 0.75), 4) AS q3, count(*) FILTER (WHERE days > 30) / count(*) AS late_share FROM s WHERE days >= 0 GROUP BY 1, 2"
)
def fulfilment_lead_time(spark, d):
    nation = t(spark, d, "nation")
    to, frm = nation.select(F.col("n_nationkey").alias("to_key"), F.col("n_name").alias("to_nation")), nation.select(F.col("n_nationkey").alias("from_key"), F.col("n_name").alias("from_nation"))
    rows = t(spark, d, "lineitem").join(_customers(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(frm, F.col("s_nationkey") == F.col("from_key")).join(to, F.col("c_nationkey") == F.col("to_key"))
    return commercial.fulfilment_lead_time(rows, ["from_nation", "to_nation"], "o_orderdate", "l_shipdate")


# 2.10 finance


@query(
    "WITH l AS (SELECT o_orderkey AS k, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS a FROM orders GROUP BY 1), r AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS b FROM lineitem GROUP BY 1) SELECT k AS order_key, CAST(a AS DOUBLE) AS left_total, CAST(b AS DOUBLE) AS right_total, CAST(a - b AS DOUBLE) AS difference, CASE WHEN a IS NULL THEN 'missing_left' WHEN b IS NULL THEN 'missing_right' WHEN abs(a - b) <= 1 THEN 'match' ELSE 'variance' END AS status FROM l FULL JOIN r USING (k)"
)
def reconcile(spark, d):
    left = t(spark, d, "orders").withColumnRenamed("o_orderkey", "order_key")
    return finance.reconcile(left, t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "order_key"), "order_key", "o_totalprice", "l_extendedprice")


_P, _D, _T = "CAST(l_extendedprice AS DECIMAL(18,2))", "CAST(l_discount AS DECIMAL(6,4))", "CAST(l_tax AS DECIMAL(6,4))"


@query(
    f"SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, CAST(sum({_P}) AS DOUBLE) AS gross, CAST(sum({_P} * {_D}) AS DOUBLE) AS discount, CAST(sum({_P} * (1 - {_D})) AS DOUBLE) AS net, CAST(sum(CAST({_P} * (1 - {_D}) AS DECIMAL(26,6)) * {_T}) AS DOUBLE) AS tax FROM lineitem GROUP BY 1, 2"
)
def net_revenue(spark, d):
    return finance.net_revenue(t(spark, d, "lineitem"), {"year": F.year("l_shipdate"), "l_returnflag": F.col("l_returnflag")}, "l_extendedprice", "l_discount", "l_tax")


@query(
    "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS year_to_date FROM orders"
)
def running_balance(spark, d):
    return finance.running_balance(t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice").select("o_orderkey", "running_total", "year_to_date")


# 2.11 marts


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, c_custkey, c_mktsegment, n_name, r_name, CAST(o_orderdate AS DATE) AS order_day, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def build_fact(spark, d):
    fact = marts.build_fact(t(spark, d, "lineitem"), [
        (t(spark, d, "orders"), "l_orderkey", "o_orderkey", "inner"), (t(spark, d, "customer"), "o_custkey", "c_custkey", "inner"),
        (t(spark, d, "nation"), "c_nationkey", "n_nationkey", "inner"), (t(spark, d, "region"), "n_regionkey", "r_regionkey", "inner"),
    ])
    return fact.select("l_orderkey", "l_linenumber", "l_partkey", "c_custkey", "c_mktsegment", "n_name", "r_name", F.to_date("o_orderdate").alias("order_day"), "l_extendedprice")


@query(
    "SELECT CAST(d AS DATE) AS day, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, CAST(week(d) AS INTEGER) AS iso_week, CAST(dayofweek(d) AS INTEGER) AS weekday FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders)"
)
def date_dimension(spark, d):
    return marts.date_dimension(t(spark, d, "orders"), "o_orderdate")


@query(
    f"WITH a AS (SELECT {_MONTH} AS month, c_mktsegment, count(*) AS orders, {_SPEND} AS revenue FROM {_CUSTOMERS} GROUP BY 1, 2), s AS (SELECT CAST(m AS DATE) AS month, g.c_mktsegment FROM (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS m FROM a) CROSS JOIN (SELECT DISTINCT c_mktsegment FROM a) g) SELECT month, c_mktsegment, CAST(coalesce(orders, 0) AS DOUBLE) AS orders, coalesce(revenue, 0.0) AS revenue FROM s LEFT JOIN a USING (month, c_mktsegment)"
)
def summary_mart(spark, d):
    measures = {"orders": F.count(F.lit(1)), "revenue": F.sum(F.col("o_totalprice").cast("decimal(18,2)"))}
    return marts.summary_mart(_customers(spark, d), "o_orderdate", "c_mktsegment", measures)


# 2.12 lineage


def _manifest(spark, d):
    """Two runs of two stages over orders, their rows counted as they are written."""
    from pyspark.sql import Observation

    root = scratch_dir(spark)
    for run, rows in (("run-1", t(spark, d, "orders")), ("run-2", t(spark, d, "orders").where("o_orderstatus <> 'P'"))):
        seen = Observation()
        files.write_raw(damaged(rows).observe(seen, F.count(F.lit(1)).alias("n")), root, run)
        n = seen.get["n"]
        lineage.append_manifest(spark, f"{root}/manifest", run, "stage_01_ingestion", n, n, 0)
        if run == "run-1":
            good, bad = contracts.quarantine(damaged(rows), CONTRACT)
            kept, out = Observation(), Observation()
            files.write_clean(good.observe(kept, F.count(F.lit(1)).alias("n")), root, run)
            bad.observe(out, F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/rejected")
            lineage.append_manifest(spark, f"{root}/manifest", run, "stage_06_standardize", n, kept.get["n"], out.get["n"])
    return spark.read.schema(lineage.MANIFEST).parquet(f"{root}/manifest")


_GOOD = "o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0"


@query(f"SELECT 'run-1' AS run_id, count(*) AS stage_01_ingestion, count(*) FILTER (WHERE {_GOOD}) AS stage_06_standardize FROM orders UNION ALL SELECT 'run-2', count(*) FILTER (WHERE o_orderstatus <> 'P'), NULL FROM orders")
def phase_status(spark, d):
    return lineage.phase_status(_manifest(spark, d), ["stage_01_ingestion", "stage_06_standardize"])


@query(
    f"SELECT 'run-1' AS run_id, 'stage_01_ingestion' AS stage, count(*) AS rows_in, count(*) AS rows_out, 0::BIGINT AS rows_rejected, 0::BIGINT AS rows_lost FROM orders UNION ALL SELECT 'run-2', 'stage_01_ingestion', count(*) FILTER (WHERE o_orderstatus <> 'P'), count(*) FILTER (WHERE o_orderstatus <> 'P'), 0, 0 FROM orders UNION ALL SELECT 'run-1', 'stage_06_standardize', count(*), count(*) FILTER (WHERE {_GOOD}), count(*) FILTER (WHERE NOT ({_GOOD})), 0 FROM orders"
)
def stage_lineage(spark, d):
    return lineage.stage_lineage(_manifest(spark, d))


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'same' END AS change FROM orders UNION ALL SELECT o_orderkey, 'removed' FROM orders WHERE o_orderkey % 5 = 0")
def artifact_diff(spark, d):
    old = t(spark, d, "orders")
    key = F.col("o_orderkey")
    new = old.withColumn("o_orderstatus", F.when(key % 3 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))).withColumn("o_orderkey", F.when(key % 5 == 0, key + 1_000_000_000).otherwise(key))
    return lineage.artifact_diff(old, new, "o_orderkey")


_DECIDED = "WITH x AS (SELECT o_orderkey, o_custkey, o_totalprice, 1 AS copy FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1, 2 FROM orders WHERE o_orderkey % 4 = 0)"


@query(
    f"{_DECIDED} SELECT CAST(o_orderkey AS VARCHAR) AS order_id, copy, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'rejected' WHEN o_orderkey % 4 = 0 AND copy = 1 THEN 'duplicate' ELSE 'kept' END AS decision, CASE WHEN o_orderkey % 77 = 0 THEN 'customer_id:required,total:cast' WHEN o_orderkey % 7 = 0 THEN 'total:cast' WHEN o_orderkey % 11 = 0 THEN 'customer_id:required' END AS reasons, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS kept_copy FROM x"
)
def row_decisions(spark, d):
    """Every raw row's decision, and which copy of its order stands for it."""
    orders, root = t(spark, d, "orders"), scratch_dir(spark)
    raw = damaged(orders).withColumn("copy", F.lit(1)).unionByName(damaged(orders.where("o_orderkey % 4 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)).withColumn("copy", F.lit(2)))
    raw = provenance.with_row_id(files.read_stage(spark, files.write_raw(raw, root, "run-1"), "run-1"))
    _, decisions = provenance.decided(raw, CONTRACT, ["order_id"], [F.desc("copy")])
    rows = raw.select(F.col("row_id").alias("id"), "order_id", "copy")
    kept = raw.select(F.col("row_id").alias("kept"), F.col("copy").alias("kept_copy"))
    out = rows.join(decisions, F.col("id") == F.col("row_id"), "left").join(kept, F.col("kept_as") == F.col("kept"), "left")
    return out.select("order_id", "copy", "decision", F.array_join("reasons", ",").alias("reasons"), "kept_copy")


_EDITED = "o_orderkey % 97 = 0"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN o_orderkey % 2 = 0 THEN 'o_custkey,o_orderdate,o_orderpriority,o_orderstatus,o_totalprice' ELSE 'note,o_orderstatus' END AS columns FROM orders WHERE {_EDITED} UNION ALL SELECT o_orderkey + 1000000000, 'added', 'o_custkey,o_orderdate,o_orderpriority,o_orderstatus,o_totalprice' FROM orders WHERE {_EDITED} AND o_orderkey % 2 = 0")
def run_difference(spark, d):
    """Two runs that differ in few keys, compared by their digests."""
    old, key, edited, path = t(spark, d, "orders"), F.col("o_orderkey"), F.expr(_EDITED), f"{scratch_dir(spark)}/digested"
    new = old.withColumn("note", F.when(edited & (key % 2 == 1), F.lit("new"))).withColumn("o_orderstatus", F.when(edited & (key % 2 == 1), F.lit("X")).otherwise(F.col("o_orderstatus")))
    new = new.withColumn("o_orderkey", F.when(edited & (key % 2 == 0), key + 1_000_000_000).otherwise(key))
    digests.write_digested(old, path, "old", "o_orderkey", levels := (3, 3))
    digests.write_digested(new, path, "new", "o_orderkey", levels)
    return digests.run_difference(spark, path, "old", "new", "o_orderkey", levels).withColumn("columns", F.array_join("columns", ","))
