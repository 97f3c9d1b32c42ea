"""Joins, views, pages, sets and snapshots over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.predicates import changed, having, lacking, matches_all, not_containing, priority_order, same_text, view
from millrace.operators.ranking import first_per_key, in_given_order, last_wins, page, page_totals, round_robin, with_ordinal
from millrace.operators.setops import catalog_diff, insert_ignore, missing_keys, snapshot_changes, status_changes, update_from_arrays, upsert
from millrace.plans.registry import query
from millrace.tables import table


@query("""SELECT o_orderkey, o_custkey, c_name, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'""")
def left_dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with two left-joined dimensions; the join condition filters the dimension, not the facts."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return o.join(c, "o_custkey", "left").join(n, "c_nationkey", "left").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", "n_name")


@query("""SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_quantity >= 45 WHERE o_orderstatus = 'F' AND l_returnflag = 'R'""")
def residual_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_shipdate")
    return o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate"))).select("o_orderkey", "l_linenumber")


@query("""SELECT c_custkey, coalesce((SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), TIMESTAMP '1990-01-01') AS entered_at FROM customer""")
def correlated_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated maximum, worked out once per key and joined."""
    last = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("last", F.lit("1990-01-01").cast("timestamp_ntz")).alias("entered_at"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return lacking(having(c, o.where("o_orderpriority = '5-LOW'"), "c_custkey"), o.where("o_orderstatus = 'P'"), "c_custkey")


@query("SELECT c_custkey, c_name, pos FROM customer JOIN (SELECT unnest([7, 3, 11, 5]) AS id, unnest([0, 1, 2, 3]) AS pos) ON c_custkey = id")
def rows_in_given_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(k).cast("long") for k in (7, 3, 11, 5)])).alias("pos", "c_custkey"))
    return in_given_order(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", wanted, "pos")


#: Orders as postings: status, scoring status and score of a job made from an order's columns.
JOBS_SQL = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'inbox' WHEN 'O' THEN 'pending_af' ELSE 'applied' END AS status, CASE o_orderkey % 5 WHEN 0 THEN 'needs_jd' WHEN 1 THEN 'queued' WHEN 2 THEN 'failed' ELSE 'scored' END AS scoring_status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 101 END AS fit_score, o_orderdate AS created_at, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS reason, o_custkey AS company FROM orders"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "inbox").when(F.col("o_orderstatus") == "O", "pending_af").otherwise("applied")
    scoring = F.when(key % 5 == 0, "needs_jd").when(key % 5 == 1, "queued").when(key % 5 == 2, "failed").otherwise("scored")
    score = F.when(key % 3 == 0, None).otherwise(F.floor("o_totalprice") % 101)
    return table(spark, sf_dir, "orders").select(key.alias("id"), status.alias("status"), scoring.alias("scoring_status"), score.alias("fit_score"), F.col("o_orderdate").alias("created_at"), F.when(key % 7 == 0, None).otherwise(F.col("o_orderpriority")).alias("reason"), F.col("o_custkey").alias("company"))


@query(f"""WITH j AS ({JOBS_SQL}) SELECT 'needs_jd' AS view, count(*) AS n FROM j WHERE status = 'pending_af' AND scoring_status = 'needs_jd' UNION ALL SELECT 'local_scoring', count(*) FROM j WHERE status = 'pending_af' AND scoring_status IN ('queued', 'scoring') UNION ALL SELECT 'action_needed', count(*) FROM j WHERE status = 'pending_af' AND scoring_status = 'failed' UNION ALL SELECT 'aim_fit', count(*) FROM j WHERE status = 'pending_af' AND scoring_status = 'scored' AND fit_score IS NULL UNION ALL SELECT 'experience_fit', count(*) FROM j WHERE status = 'pending_af' AND scoring_status = 'scored' AND fit_score IS NOT NULL UNION ALL SELECT 'scored_inbox', count(*) FROM j WHERE status = 'inbox' AND fit_score IS NOT NULL UNION ALL SELECT 'applied', count(*) FROM j WHERE status = 'applied'""")
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all views in one pass."""
    names = ("needs_jd", "local_scoring", "action_needed", "aim_fit", "experience_fit", "scored_inbox", "applied")
    one = jobs(spark, sf_dir).agg(*[F.count_if(view(n)).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("view"), F.col(n).alias("n")) for n in names])).alias("v")).select("v.view", "v.n")


@query(f"WITH j AS ({JOBS_SQL}) SELECT id, fit_score, row_number() OVER (ORDER BY fit_score DESC NULLS LAST, created_at DESC NULLS LAST, id) AS place FROM j WHERE status = 'inbox' ORDER BY place LIMIT 50")
def priority_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best of a view, unscored last. Limited before places are given, so no window spans all rows."""
    top = jobs(spark, sf_dir).where(view("inbox")).orderBy(*priority_order()).limit(50)
    return with_ordinal(top, [], priority_order(), "place").select("id", "fit_score", (F.col("place") + 1).alias("place"))


@query(f"WITH j AS ({JOBS_SQL}) SELECT id, created_at FROM j WHERE status = 'inbox' ORDER BY created_at DESC, id OFFSET 48 LIMIT 24")
def third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(jobs(spark, sf_dir).where(view("inbox")).select("id", "created_at"), [F.col("created_at").desc(), F.col("id")], 3, 24)


@query(f"WITH j AS ({JOBS_SQL}) SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 24.0) AS BIGINT)) AS total_pages, 3 < greatest(1, CAST(ceil(count(*) / 24.0) AS BIGINT)) AS has_more FROM j WHERE status = 'inbox'")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_totals(jobs(spark, sf_dir).where(view("inbox")), 3, 24)


@query("SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%e%' OR lower(p_brand) LIKE '%e%' OR lower(p_type) LIKE '%e%') AND (lower(p_name) LIKE '%brand#1%' OR lower(p_brand) LIKE '%brand#1%' OR lower(p_type) LIKE '%brand#1%')")
def multi_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(matches_all("E Brand#1", ["p_name", "p_brand", "p_type"])).select("p_partkey", "p_name")


@query(f"WITH j AS ({JOBS_SQL}) SELECT id, reason FROM j WHERE reason IS NULL OR lower(reason) NOT LIKE '%low%'")
def null_safe_not_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where(not_containing("reason", "LOW")).select("id", "reason")


@query("SELECT count(*) AS n FROM supplier WHERE lower(trim(s_name)) = lower(trim('  supplier#000000007 '))")
def same_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where(same_text(F.col("s_name"), "  supplier#000000007 ")).agg(F.count("*").alias("n"))


@query(f"WITH j AS ({JOBS_SQL}) SELECT status, count(*) FILTER (fit_score IS DISTINCT FROM id % 101) AS differing FROM j GROUP BY 1")
def differing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("status").agg(F.count_if(changed(F.col("fit_score"), F.col("id") % 101)).alias("differing"))


@query("""SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) - 1 AS INTEGER) AS ordinal FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'""")
def export_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1998-01-01'").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return with_ordinal(rows, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "ordinal")


@query("""SELECT s_suppkey, rank_no, last_label FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY lower(substr(s_name, 1, 17)) ORDER BY s_suppkey DESC) AS rn, s_suppkey AS rank_no, s_name AS last_label FROM supplier) WHERE rn = 1""")
def last_rule_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("rank_no"), F.col("s_name").alias("last_label"))
    return last_wins(rows, F.lower(F.substring("last_label", 1, 17)), [F.col("s_suppkey")])


@query("""WITH held AS (SELECT c_custkey AS k, c_mktsegment AS kind, c_custkey % 4 <> 0 AS active, c_custkey % 9 = 0 AS leased FROM customer WHERE c_custkey % 5 <> 1),
wanted AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN 'NEW' ELSE c_mktsegment END AS kind FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 6 = 0)
SELECT coalesce(w.k, h.k) AS k, CASE WHEN h.k IS NULL THEN 'add' WHEN w.k IS NOT NULL AND NOT active THEN 'reactivate' WHEN w.k IS NOT NULL AND h.kind IS DISTINCT FROM w.kind THEN 'update' WHEN w.k IS NOT NULL THEN 'unchanged' WHEN NOT active THEN 'retired' WHEN leased THEN 'conflict' ELSE 'retire' END AS action FROM held h FULL JOIN wanted w ON h.k = w.k""")
def task_catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("kind"))
    held = c.where("k % 5 <> 1").withColumn("active", F.col("k") % 4 != 0).withColumn("leased", F.col("k") % 9 == 0)
    wanted = c.where("k % 3 <> 0 or k % 6 = 0").withColumn("kind", F.when(F.col("k") % 6 == 0, "NEW").otherwise(F.col("kind")))
    return catalog_diff(held, wanted, "k", ["kind"], F.col("active"), F.col("leased"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_keys(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1-%')")
def without_urgent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1-"))
    return missing_keys(table(spark, sf_dir, "customer"), urgent.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return insert_ignore(held, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), ["k"])


@query("""SELECT k, v, version FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC NULLS LAST, src DESC) AS rn FROM (SELECT o_custkey AS k, o_totalprice AS v, o_orderkey AS version, 0 AS src FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_totalprice, o_orderkey, 1 FROM orders WHERE o_orderstatus = 'O')) WHERE rn = 1""")
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("version"))
    return upsert(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus"), ["k"], "version")


@query("SELECT s_suppkey, CASE s_suppkey WHEN 2 THEN 'two' WHEN 5 THEN 'five' ELSE s_name END AS s_name FROM supplier")
def array_pair_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.range(1).select(F.array(F.lit(2), F.lit(5)).alias("k"), F.array(F.lit("two"), F.lit("five")).alias("v"))
    return update_from_arrays(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "s_name", F.col("k"), F.col("v"), pairs)


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, previous FROM (SELECT *, lag(o_orderstatus) OVER w AS previous, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE n = 1 OR o_orderstatus IS DISTINCT FROM previous""")
def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return status_changes(rows, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderstatus").select("o_custkey", "o_orderkey", "o_orderstatus", "previous")


@query(f"WITH j AS ({JOBS_SQL}), b AS (SELECT id, status FROM j WHERE id % 11 <> 0), a AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'archived' ELSE status END AS status FROM j) SELECT a.id, a.status AS new_status, b.status AS old_status FROM a LEFT JOIN b ON a.id = b.id WHERE a.status IS DISTINCT FROM b.status")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).select("id", "status")
    return snapshot_changes(j.where("id % 11 <> 0"), j.withColumn("status", F.when(F.col("id") % 4 == 0, "archived").otherwise(F.col("status"))), "id", "status")


@query("""WITH h AS (SELECT c_custkey AS id, floor(c_acctbal / 4000) AS band, c_mktsegment AS grp FROM customer), m AS (SELECT *, count(*) OVER (PARTITION BY band, grp) AS n, row_number() OVER (PARTITION BY band, grp ORDER BY id) - 1 AS place FROM h),
g AS (SELECT band, grp, row_number() OVER (PARTITION BY band ORDER BY grp) - 1 AS i, count(*) OVER (PARTITION BY band) AS k FROM (SELECT DISTINCT band, grp FROM h))
SELECT id, CAST(m.band AS BIGINT) AS band, m.grp AS "group", CAST(((place - 19738 % n) % n + n) % n AS BIGINT) AS slot, CAST(((i - 19738 % k) % k + k) % k AS BIGINT) AS group_turn FROM m JOIN g ON m.band = g.band AND m.grp = g.grp""")
def fair_task_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment")
    out = round_robin(rows, F.floor(F.col("c_acctbal") / 4000), F.col("c_mktsegment"), [F.col("id")], F.lit(19738).cast("long"))
    return out.select("id", "band", "group", F.col("slot").cast("long").alias("slot"), F.col("group_turn").cast("long").alias("group_turn"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def best_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderdate) AS oldest, count(*) FILTER (o_totalprice > 200000) AS runnable FROM orders GROUP BY 1, 2""")
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("oldest"), F.count_if(F.col("o_totalprice") > 200000).alias("runnable"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose parent is missing: what foreign keys would forbid."""
    o, c, li = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    first = lacking(o.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), c, "c_custkey").select("o_orderkey")
    return first.unionByName(lacking(li.select(F.col("l_orderkey").alias("o_orderkey")), o, "o_orderkey"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_totalprice > 300000 THEN 1 WHEN o_orderstatus = 'F' THEN 2 ELSE 3 END AS rank_no FROM orders ORDER BY rank_no, o_orderdate, o_orderkey LIMIT 120""")
def case_rank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_totalprice") > 300000, 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", rank.alias("rank_no"), "o_orderdate")
    return rows.orderBy("rank_no", "o_orderdate", "o_orderkey").limit(120).select("o_orderkey", "rank_no")
