"""Relational operators on the driver's tables: keys, joins, aggregates, sets, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import query
from gleaner.operators.keyed import checksum, counts, first_per_key, newest, overlay, page, ranked
from gleaner.plans import checks
from gleaner.sources.tables import table


@query("""
WITH scores AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS k FROM orders o) WHERE k = 1),
rules AS (SELECT * FROM (SELECT o_custkey, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY o_custkey ORDER BY l_returnflag = 'R' DESC, l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE k = 1)
SELECT s.o_custkey, s.o_orderkey, c_name, c_mktsegment, s.o_totalprice, s.o_orderpriority, r.l_orderkey AS rule_orderkey, r.l_quantity AS rule_score,
  CASE WHEN s.o_orderstatus = 'F' AND c_acctbal < 0 THEN 'review' WHEN s.o_orderstatus = 'F' THEN 'apply' WHEN s.o_orderstatus = 'O' THEN 'review' ELSE 'skip' END AS recommendation,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY s.o_totalprice DESC, CASE s.o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END DESC, r.l_quantity DESC NULLS LAST, c_name, s.o_orderkey) AS score_rank
FROM scores s JOIN customer ON s.o_custkey = c_custkey LEFT JOIN rules r ON s.o_custkey = r.o_custkey""")
def recommendation_mart(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    scores = first_per_key(orders, ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_totalprice"), F.col("o_orderkey")])
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    joined = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rules = first_per_key(joined, ["o_custkey"], [(F.col("l_returnflag") == "R").desc(), F.desc("l_quantity"), F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])
    rules = rules.select(F.col("o_custkey").alias("r_custkey"), F.col("l_orderkey").alias("rule_orderkey"), F.col("l_quantity").alias("rule_score"))
    out = scores.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(rules, F.col("o_custkey") == F.col("r_custkey"), "left")
    state = F.col("o_orderstatus")
    said = F.when((state == "F") & (F.col("c_acctbal") < 0), "review").when(state == "F", "apply").when(state == "O", "review").otherwise("skip")
    priority = F.when(state == "F", 3).when(state == "O", 2).otherwise(1)
    out = ranked(out, ["c_mktsegment"], [F.desc("o_totalprice"), priority.desc(), newest("rule_score"), F.col("c_name"), F.col("o_orderkey")], "score_rank")
    return out.select("o_custkey", "o_orderkey", "c_name", "c_mktsegment", "o_totalprice", "o_orderpriority", "rule_orderkey", "rule_score", said.alias("recommendation"), "score_rank")


@query("SELECT event_id, user_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY props IS NOT NULL DESC, ts DESC NULLS LAST, event_id) AS k FROM events) WHERE k = 1")
def dedup_latest_event(spark, d):
    has = F.col("props").isNotNull()
    return first_per_key(table(spark, d, "events"), ["user_id", "event_type"], [has.desc(), newest("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type", "ts", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_orderpriority FROM (SELECT l.*, o_orderpriority, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_linestatus = 'O' DESC, l_quantity DESC, l_extendedprice DESC, l_linenumber, l_partkey) AS k FROM lineitem l JOIN orders ON l_orderkey = o_orderkey) WHERE k = 1")
def best_match_per_order(spark, d):
    best = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = [(F.col("l_returnflag") == "R").desc(), (F.col("l_linestatus") == "O").desc(), F.desc("l_quantity"), F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")]
    return first_per_key(best, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "o_orderpriority")


@query("SELECT o_custkey, o_orderkey, o_totalprice, c_mktsegment FROM (SELECT o.*, c_mktsegment, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_totalprice DESC, o_orderkey) AS k FROM orders o JOIN customer ON o_custkey = c_custkey) WHERE k = 1")
def latest_score_per_customer(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return first_per_key(joined, ["o_custkey"], [newest("o_orderdate"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice", "c_mktsegment")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END DESC, o_totalprice DESC, o_orderkey) AS case_rank FROM orders")
def ranked_with_case_priority(spark, d):
    state = F.col("o_orderstatus")
    priority = F.when(state == "F", 3).when(state == "O", 2).otherwise(1)
    return ranked(table(spark, d, "orders"), ["o_custkey"], [priority.desc(), F.desc("o_totalprice"), F.col("o_orderkey")], "case_rank").select("o_custkey", "o_orderkey", "case_rank")


@query("""SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_buyers, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_done,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS n_open, (SELECT max(o_orderdate) FROM orders) AS latest_order, (SELECT count(*) FROM lineitem) AS n_lines, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_parts,
(SELECT count(*) FROM customer) AS n_customers, (SELECT max(ts) FROM events) AS latest_event, (SELECT count(DISTINCT user_id) FROM events) AS n_users""")
def pipeline_summary(spark, d):
    state = F.col("o_orderstatus")
    orders = table(spark, d, "orders").agg(F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("n_buyers"), F.count_if(state == "F").alias("n_done"), F.count_if(state == "O").alias("n_open"), F.max("o_orderdate").alias("latest_order"))
    lines = table(spark, d, "lineitem").agg(F.count("*").alias("n_lines"), F.count_distinct("l_partkey").alias("n_parts"))
    rest = [table(spark, d, "customer").agg(F.count("*").alias("n_customers")), table(spark, d, "events").agg(F.max("ts").alias("latest_event"), F.count_distinct("user_id").alias("n_users"))]
    return orders.crossJoin(lines).crossJoin(rest[0]).crossJoin(rest[1])  # one row each


@query("""WITH a AS (SELECT o_custkey, max(o_totalprice) AS price, min(o_orderpriority) AS note FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, max(o_totalprice) AS price, min(o_orderpriority) AS note FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey, CASE WHEN a.price IS NOT NULL THEN a.price WHEN b.price IS NOT NULL THEN b.price END AS price, CASE WHEN a.price IS NOT NULL THEN a.note WHEN b.price IS NOT NULL THEN b.note END AS note,
CASE WHEN a.price IS NOT NULL THEN 'exact' WHEN b.price IS NOT NULL THEN 'verified' ELSE 'default' END AS scope FROM customer LEFT JOIN a ON c_custkey = a.o_custkey LEFT JOIN b ON c_custkey = b.o_custkey""")
def precedence_overlay(spark, d):
    orders = table(spark, d, "orders")
    layer = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("price"), F.min("o_orderpriority").alias("note"))
    return overlay(table(spark, d, "customer").select("c_custkey"), [("exact", layer("F")), ("verified", layer("O"))], "c_custkey", ["price", "note"], "price")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_payload_projection(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("SELECT event_id, props FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN replace(props, '}', '') ELSE props END AS props FROM events) WHERE props IS NOT NULL AND NOT json_valid(props)")
def json_valid_violations(spark, d):
    damaged = F.when(F.col("event_id") % 10 == 0, F.replace(F.col("props"), F.lit("}"), F.lit(""))).otherwise(F.col("props"))
    return checks.invalid_json(table(spark, d, "events").select("event_id", damaged.alias("props")), "props")


@query("""SELECT l_orderkey AS key, l_linenumber AS part, score_name, score_value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount * 1000 AS l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME score_name VALUE score_value) WHERE score_value NOT BETWEEN 0 AND 45
UNION ALL SELECT p_partkey, 0, score_name, score_value FROM (UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice / 30 AS p_retailprice FROM part) ON p_size, p_retailprice INTO NAME score_name VALUE score_value) WHERE score_value NOT BETWEEN 0 AND 45""")
def unpivot_range_check(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("part"), "l_quantity", (F.col("l_discount") * 1000).alias("l_discount"), "l_tax")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lit(0).alias("part"), "p_size", (F.col("p_retailprice") / 30).alias("p_retailprice"))
    return checks.outside(lines, ["key", "part"], ["l_quantity", "l_discount", "l_tax"], 0, 45).unionByName(checks.outside(parts, ["key", "part"], ["p_size", "p_retailprice"], 0, 45))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_check(spark, d):
    return checks.repeated(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 9 = 0)")
def orphan_anti_join(spark, d):
    return checks.orphans(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_orderkey % 9 = 0"), "c_custkey", "o_custkey")


@query("SELECT o_orderkey, 'orders.o_custkey' AS relation FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)")
def relationships(spark, d):
    parents = table(spark, d, "customer").where("c_custkey % 50 <> 0")
    return checks.orphans(table(spark, d, "orders"), parents, "o_custkey", "c_custkey").select("o_orderkey", F.lit("orders.o_custkey").alias("relation"))


@query("""SELECT 'not_null' AS check_name, count(*) AS violations FROM orders WHERE o_orderdate IS NULL UNION ALL SELECT 'unique', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'accepted_values', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'apply_needs_score', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 1000""")
def not_null_unique_accepted(spark, d):
    orders = table(spark, d, "orders")
    found = {"not_null": checks.nulls(orders, "o_orderdate"), "unique": checks.repeated(orders, ["o_orderkey"]), "accepted_values": checks.not_accepted(orders, "o_orderstatus", ["F", "O"]), "apply_needs_score": checks.broken(orders, ~((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 1000)))}
    out = None
    for name, rows in found.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' UNION SELECT user_id FROM events WHERE event_type = 'purchase'")
def union_distinct_keys(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return a.union(table(spark, d, "events").where("event_type = 'purchase'").select("user_id")).distinct()


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS flagged FROM customer")
def exists_semi_flag(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("flagged"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def not_exists_under_or(spark, d):
    held = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).distinct()
    return table(spark, d, "customer").join(held, F.col("c_custkey") == F.col("k"), "left").where((F.col("c_acctbal") > 5000) | F.col("k").isNull()).select("c_custkey")


@query("SELECT a.s_suppkey AS one, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE a.s_acctbal < b.s_acctbal")
def self_join_via_key(spark, d):
    s = table(spark, d, "supplier")
    a, b = (s.select("s_nationkey", F.col("s_suppkey").alias(n), F.col("s_acctbal").alias(f"{n}_bal")) for n in ("one", "other"))
    return a.join(b, "s_nationkey").where("one < other and one_bal < other_bal").select("one", "other")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON lower(trim('nation ' || s_nationkey)) = lower('NATION ' || n_nationkey)")
def derived_key_join(spark, d):
    s = table(spark, d, "supplier").withColumn("k", F.lower(F.trim(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")))))
    n = table(spark, d, "nation").withColumn("k", F.lower(F.concat(F.lit("NATION "), F.col("n_nationkey").cast("string"))))
    return s.join(n, "k").select("s_suppkey", "n_name")


@query("SELECT a.n_nationkey, r_name FROM nation a LEFT JOIN region ON lower(left(r_name, 2)) = lower(left(n_name, 2))")
def lower_key_join(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, F.lower(F.left("r_name", F.lit(2))) == F.lower(F.left("n_name", F.lit(2))), "left").select("n_nationkey", "r_name")


@query("SELECT o_orderkey, count(l_orderkey) AS late_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= coalesce(o_orderdate, TIMESTAMP '1970-01-01') AND l_returnflag = 'R' GROUP BY 1")
def theta_residual_left_join(spark, d):
    late = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_shipdate")
    floor = F.coalesce("o_orderdate", F.lit("1970-01-01").cast("timestamp_ntz"))
    out = table(spark, d, "orders").join(late, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") >= floor), "left")
    return out.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("late_lines"))


@query("SELECT user_id, max(value) AS best FROM events GROUP BY 1")
def max_per_key(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("best"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1 ORDER BY 1")
def group_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users")).orderBy("event_type")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'none') AS never, count(*) FILTER (o_totalprice > 200000) AS large, count(*) AS total FROM orders")
def conditional_metrics(spark, d):
    state = F.col("o_orderstatus")
    return counts(table(spark, d, "orders"), {"done": state == "F", "open": state == "O", "never": state == "none", "large": F.col("o_totalprice") > 200000, "total": F.lit(True)})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def topk(spark, d):
    return table(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_window(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return page(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 50, orders.count())


_CHECKSUM = " || ".join(f"lpad(to_hex(CAST(sum(CAST('0x' || substr(h, {15 * k + 1}, 15) AS HUGEINT)) % 1152921504606846976 AS BIGINT)), 15, '0')" for k in range(4))


@query(f"SELECT count(*) AS n_rows, lower({_CHECKSUM}) AS checksum FROM (SELECT sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_orderpriority, o_orderstatus)) AS h FROM orders)")
def table_checksum(spark, d):
    return checksum(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("SELECT conv_id, turn, role, length(text) AS n_chars, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) = 1")
def conversation_turns(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").withColumn("turns", F.count("*").over(Window.partitionBy("conv_id")))
    return first_per_key(rows, ["conv_id"], [F.desc("turn"), F.col("role"), F.col("text")]).select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("n_chars"), "turns")
