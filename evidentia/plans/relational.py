"""Relational queries: customers are owners, orders jobs, lineitems revisions, parts evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import relational as R
from evidentia.plans.common import table


def latest_revision_join(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    top = R.latest(lines.select("o_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["o_orderkey"], "l_linenumber")
    return top.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", "o_custkey", "l_linenumber", "l_partkey", "l_quantity")


def next_revision(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    return R.next_revision(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"), "o_orderkey", "l_linenumber")


def facet_search(spark, d):
    found = R.search(table(spark, d, "part"), "e", ["p_name", "p_brand", "p_type"])
    return R.search(R.search(found, "brand#1", ["p_brand"]), "1", ["p_size"]).select("p_partkey", "p_brand", "p_size")


def ilike_search(spark, d):
    return R.search(table(spark, d, "customer"), "_0%7", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


def equality_scan(spark, d):
    return R.scan(table(spark, d, "orders"), {"o_orderstatus": "O"}).filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


def paged_list(spark, d):
    return R.scan(table(spark, d, "orders"), order=[F.desc("o_orderdate"), "o_orderkey"], offset=100, limit=100).select("o_orderkey", "o_custkey")


def latest_per_pair(spark, d):
    newest = R.newest_identity(table(spark, d, "orders"), [F.col("o_custkey"), F.col("o_orderpriority")], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return newest.select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


def dedupe_identity(spark, d):
    kept = R.newest_identity(table(spark, d, "customer"), [F.col("c_nationkey"), F.lower("c_mktsegment")], [F.desc("c_acctbal"), F.desc("c_custkey")])
    return kept.select("c_custkey", "c_nationkey", "c_mktsegment")


def owned_ids_union(spark, d):
    lines, parts, suppliers = (table(spark, d, n) for n in ("lineitem", "part", "supplier"))
    return R.union_of_ids([(lines, "l_suppkey"), (parts.filter("p_size > 25"), "p_partkey"), (suppliers, "s_suppkey")])


def orphans(spark, d):
    orders, events = table(spark, d, "orders").filter("o_orderstatus = 'P'"), table(spark, d, "events")
    return R.orphans(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", [(orders, "o_custkey"), (events, "user_id")])


def semi_filter(spark, d):
    dear = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(dear, "p_partkey", "left_semi").select("p_partkey", "p_name")


def exists_flag(spark, d):
    ordered = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has_order", F.lit(True))
    return table(spark, d, "customer").join(ordered, "c_custkey", "left").select("c_custkey", F.coalesce("has_order", F.lit(False)).alias("has_order"))


def filtered_counts(spark, d):
    counts = [("orders", "o_orderstatus = 'F'"), ("lineitem", "l_returnflag = 'R'"), ("customer", "c_acctbal < 0"), ("part", "p_size <= 10"), ("events", "value > 50")]
    parts = [table(spark, d, t).agg(F.count_if(F.expr(c)).alias("rows")).select(F.lit(t).alias("source"), "rows") for t, c in counts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def owner_aggregate(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    whole = R.aggregate_root(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", {"orders": orders})
    ids = F.transform("orders", lambda o: o["o_orderkey"].cast("string"))
    return whole.select("c_custkey", F.size("orders").cast("bigint").alias("n_orders"), F.array_join(ids, ",").alias("order_ids"))


def section_replace(spark, d):
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("item"))
    incoming = held.filter("owner % 3 = 0 and item % 2 = 0").withColumn("item", F.col("item") + 1_000_000_000)
    return R.replace_section(held, incoming, "owner")


def upsert_rows(spark, d):
    held = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    incoming = held.filter("s_suppkey % 4 = 0").withColumns({"s_name": F.upper("s_name"), "s_acctbal": F.lit(0.0)})
    return R.upsert(held, incoming, ["s_suppkey"])


def integrity_violations(spark, d):
    rules = {"discount_range": F.col("l_discount").between(0, 0.05), "quantity_range": F.col("l_quantity") <= 48, "line_positive": F.col("l_linenumber") > 0}
    return R.violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], rules)


def reference_mismatch(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    rich = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return lines.join(rich, "l_suppkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("mismatches"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_revision_join, next_revision, facet_search, ilike_search, equality_scan, paged_list, latest_per_pair, dedupe_identity, owned_ids_union, orphans,
        semi_filter, exists_flag, filtered_counts, owner_aggregate, section_replace, upsert_rows, integrity_violations, reference_mismatch,
    )
}
ORACLE_SQL = {
    "latest_revision_join": """
        SELECT o_orderkey, o_custkey, l.l_linenumber, l_partkey, l_quantity FROM orders
        JOIN lineitem l ON l_orderkey = o_orderkey
        JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON k = o_orderkey AND m = l.l_linenumber""",
    "next_revision": "SELECT o_orderkey, CAST(coalesce(max(l_linenumber), 0) + 1 AS BIGINT) AS next_revision FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "facet_search": """
        SELECT p_partkey, p_brand, p_size FROM part WHERE (p_name ILIKE '%e%' OR p_brand ILIKE '%e%' OR p_type ILIKE '%e%')
        AND p_brand ILIKE '%brand#1%' AND CAST(p_size AS VARCHAR) ILIKE '%1%'""",
    "ilike_search": "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%_0%7%' OR c_mktsegment ILIKE '%_0%7%'",
    "equality_scan": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "paged_list": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 100",
    "latest_per_pair": """
        SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "dedupe_identity": """
        SELECT c_custkey, c_nationkey, c_mktsegment FROM customer
        QUALIFY row_number() OVER (PARTITION BY c_nationkey, lower(c_mktsegment) ORDER BY c_acctbal DESC, c_custkey DESC) = 1""",
    "owned_ids_union": """
        SELECT CAST(l_suppkey AS VARCHAR) AS id FROM lineitem WHERE l_suppkey IS NOT NULL
        UNION SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 25 UNION SELECT CAST(s_suppkey AS VARCHAR) FROM supplier""",
    "orphans": """
        SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
        AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""",
    "semi_filter": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "exists_flag": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_order FROM customer",
    "filtered_counts": """
        SELECT 'orders' AS source, count(*) FILTER (o_orderstatus = 'F') AS rows FROM orders
        UNION ALL SELECT 'lineitem', count(*) FILTER (l_returnflag = 'R') FROM lineitem
        UNION ALL SELECT 'customer', count(*) FILTER (c_acctbal < 0) FROM customer
        UNION ALL SELECT 'part', count(*) FILTER (p_size <= 10) FROM part
        UNION ALL SELECT 'events', count(*) FILTER (value > 50) FROM events""",
    "owner_aggregate": """
        SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS order_ids
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "section_replace": """
        WITH i AS (SELECT o_custkey AS owner, o_orderkey + 1000000000 AS item FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 2 = 0)
        SELECT o_custkey AS owner, o_orderkey AS item FROM orders WHERE o_custkey NOT IN (SELECT owner FROM i) UNION ALL SELECT owner, item FROM i""",
    "upsert_rows": """
        SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN upper(s_name) ELSE s_name END AS s_name,
               CASE WHEN s_suppkey % 4 = 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier""",
    "integrity_violations": """
        SELECT l_orderkey, l_linenumber, l_partkey, rule FROM (
            SELECT *, unnest(list_filter([CASE WHEN NOT (l_discount BETWEEN 0 AND 0.05::DOUBLE) THEN 'discount_range' END,
                                          CASE WHEN NOT (l_quantity <= 48) THEN 'quantity_range' END,
                                          CASE WHEN NOT (l_linenumber > 0) THEN 'line_positive' END], lambda r: r IS NOT NULL)) AS rule FROM lineitem)""",
    "reference_mismatch": """
        SELECT l_orderkey, count(*) AS mismatches FROM lineitem
        WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0) GROUP BY 1""",
}
