"""Graphs over the warehouse tables, each as a builder and as the common table expressions of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweft.graph import Graph, number_rows
from sparkweft.plans.rounds import dealt_distinct

#: Where the ids of one kind of vertex start, so that kinds don't meet.
NATIONS, CUSTOMERS, SUPPLIERS, ORDERS, PARTS = 1_000, 1_000_000_000, 2_000_000_000, 1_000_000_000, 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graph(vertices: DataFrame, edges: DataFrame, directed: bool) -> Graph:
    numbered = number_rows(edges.withColumn("directed", F.lit(directed)), ["src", "dst"], "eid")
    return Graph(vertices, numbered)


def _numbered_sql(rows: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst, weight FROM ({rows})"


def _ids(df: DataFrame, key: str, offset: int = 0) -> DataFrame:
    return df.select((F.col(key).cast("long") + offset).alias("id"))


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations; from a customer's to a supplier's, directed, by the quantity of the order lines between them."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    met = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return _graph(_ids(table(spark, sf_dir, "nation"), "n_nationkey"), met.groupBy("src", "dst").agg(F.sum("l_quantity").alias("weight")), True)


TRADE = "v AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation), e AS (" + _numbered_sql(
    "SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"
) + ")"


def heavy_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """The trade edges of at least mean weight."""
    g = trade(spark, sf_dir)
    mean = g.edges.agg(F.avg("weight")).first()[0] or 0.0
    return Graph(g.vertices, g.edges.filter(F.col("weight") >= mean)).cached()


HEAVY = TRADE.replace("e AS (", "e0 AS (") + ", e AS (SELECT * FROM e0 WHERE weight >= (SELECT avg(weight) FROM e0))"


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers and parts, undirected, by the least price of a piece."""
    line = table(spark, sf_dir, "lineitem")
    edges = line.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PARTS).alias("dst")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("weight"))
    return _graph(_ids(table(spark, sf_dir, "supplier"), "s_suppkey").union(_ids(table(spark, sf_dir, "part"), "p_partkey", PARTS)), edges, False)


SUPPLY = f"v AS (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT p_partkey + {PARTS} FROM part), e AS (" + _numbered_sql(
    f"SELECT l_suppkey AS src, l_partkey + {PARTS} AS dst, min(l_extendedprice / l_quantity) AS weight FROM lineitem GROUP BY 1, 2"
) + ")"


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, their nations, and the customers and suppliers of these: one undirected tree a region."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier")}
    vertices = _ids(t["region"], "r_regionkey").union(_ids(t["nation"], "n_nationkey", NATIONS)).union(_ids(t["customer"], "c_custkey", CUSTOMERS)).union(_ids(t["supplier"], "s_suppkey", SUPPLIERS))
    link = lambda df, a, da, b, db: df.select((F.col(a).cast("long") + da).alias("src"), (F.col(b).cast("long") + db).alias("dst"))
    edges = link(t["nation"], "n_regionkey", 0, "n_nationkey", NATIONS).union(link(t["customer"], "c_nationkey", NATIONS, "c_custkey", CUSTOMERS)).union(link(t["supplier"], "s_nationkey", NATIONS, "s_suppkey", SUPPLIERS))
    return _graph(vertices, edges.withColumn("weight", F.lit(1.0)), False)


GEOGRAPHY = f"""v AS (SELECT CAST(r_regionkey AS BIGINT) AS id FROM region UNION ALL SELECT n_nationkey + {NATIONS} FROM nation UNION ALL SELECT c_custkey + {CUSTOMERS} FROM customer UNION ALL SELECT s_suppkey + {SUPPLIERS} FROM supplier), e AS (""" + _numbered_sql(
    f"SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(n_nationkey AS BIGINT) + {NATIONS} AS dst, 1.0::DOUBLE AS weight FROM nation UNION ALL SELECT CAST(c_nationkey AS BIGINT) + {NATIONS}, c_custkey + {CUSTOMERS}, 1.0 FROM customer UNION ALL SELECT CAST(s_nationkey AS BIGINT) + {NATIONS}, s_suppkey + {SUPPLIERS}, 1.0 FROM supplier"
) + ")"


def world(spark: SparkSession, sf_dir: str) -> Graph:
    """A tree of the world (-1), its regions and their nations; a nation's edge weighs one more than its customers."""
    nation, region, customer = (table(spark, sf_dir, n) for n in ("nation", "region", "customer"))
    n = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    inner = nation.join(n, "n_nationkey", "left").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey").cast("long") + NATIONS).alias("dst"), (F.coalesce("n", F.lit(0)) + 1).cast("double").alias("weight"))
    outer = region.select(F.lit(-1).cast("long").alias("src"), F.col("r_regionkey").cast("long").alias("dst"), (F.col("r_regionkey") + 1).cast("double").alias("weight"))
    vertices = spark.range(1).select(F.lit(-1).cast("long").alias("id")).union(_ids(region, "r_regionkey")).union(_ids(nation, "n_nationkey", NATIONS))
    return _graph(vertices, inner.union(outer), False)


WORLD = f"v AS (SELECT -1 AS id UNION ALL SELECT r_regionkey FROM region UNION ALL SELECT n_nationkey + {NATIONS} FROM nation), e AS (" + _numbered_sql(
    f"SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(n_nationkey AS BIGINT) + {NATIONS} AS dst, CAST(count(c_custkey) + 1 AS DOUBLE) AS weight FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2 UNION ALL SELECT -1, r_regionkey, r_regionkey + 1.0 FROM region"
) + ")"


def transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types; directed, by how often a user's event of one type is followed by one of the other."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    ids = number_rows(events.select("event_type").distinct(), ["event_type"], "id")
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    counts = events.select(F.col("event_type").alias("a"), following.alias("b")).filter("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))
    named = lambda c, end: ids.select(F.col("event_type").alias(c), F.col("id").alias(end))
    return _graph(ids.select("id", F.col("event_type").alias("name")), counts.join(named("a", "src"), "a").join(named("b", "dst"), "b").select("src", "dst", "weight"), True)


TRANSITIONS = "t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)), v AS (SELECT id, event_type AS name FROM t), e AS (" + _numbered_sql(
    "SELECT x.id AS src, y.id AS dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) p JOIN t x ON p.a = x.event_type JOIN t y ON p.b = y.event_type GROUP BY 1, 2"
) + ")"


def purchases(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers to their orders to the parts in these; directed and without cycles."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    vertices = _ids(table(spark, sf_dir, "customer"), "c_custkey").union(_ids(orders, "o_orderkey", ORDERS)).union(_ids(table(spark, sf_dir, "part"), "p_partkey", PARTS))
    edges = orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + ORDERS).alias("dst")).union(dealt_distinct(line.select((F.col("l_orderkey") + ORDERS).alias("src"), (F.col("l_partkey") + PARTS).alias("dst")), "src"))
    return _graph(vertices, edges.withColumn("weight", F.lit(1.0)), True)


PURCHASES = f"v AS (SELECT c_custkey AS id FROM customer UNION ALL SELECT o_orderkey + {ORDERS} FROM orders UNION ALL SELECT p_partkey + {PARTS} FROM part), e AS (" + _numbered_sql(
    f"SELECT o_custkey AS src, o_orderkey + {ORDERS} AS dst, 1.0::DOUBLE AS weight FROM orders UNION ALL SELECT DISTINCT l_orderkey + {ORDERS}, l_partkey + {PARTS}, 1.0 FROM lineitem"
) + ")"


def line_chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(lines, factors): the lines of each order are a chain of scalar variables from 0 that grow by the quantity.

    The key of the k-th line of an order is the order's number in the upper bits and k below.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    lines = line.withColumn("k", F.row_number().over(order)).withColumn("key", F.shiftleft("l_orderkey", 16) + F.col("k"))
    start = lines.filter("k = 1").select(F.lit("prior").alias("kind"), F.array(F.col("key") - 1).alias("keys"), F.lit(0.0).alias("m"))
    steps = lines.select(F.lit("between"), F.array(F.col("key") - 1, "key"), "l_quantity")
    factors = start.union(steps).select(
        F.xxhash64("keys").alias("fid"), "kind", "keys", F.struct(F.lit(0.0).alias("theta"), F.col("m").alias("x"), F.lit(0.0).alias("y")).alias("meas"), F.array(F.lit(0.1)).alias("sigma"), F.lit(None).cast("struct<name:string,k:double>").alias("loss")
    )
    return lines, factors


LINES = "lines AS (SELECT *, l_orderkey * 65536 + k AS key FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS k FROM lineitem))"
