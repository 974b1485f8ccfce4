"""Driver queries that run whole programs on business tables, in batch and as events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import foldplan
from ..streaming import reactive
from . import samples

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


PAYS = "SELECT o_custkey, CAST(o_totalprice AS DECIMAL(15,2)) AS amt, o_orderkey FROM orders"


def pays(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return df.select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("pay_amt"))


@query(f"SELECT o_custkey, CAST(SUM(amt) AS DECIMAL(13,2)) AS ws_sum, 'Y' AS ws_end, 'done' AS halted FROM ({PAYS}) GROUP BY 1")
def program_on_files(spark, sf_dir):
    """The sample read loop run record by record over each customer's orders."""
    out = {"WS-SUM": "decimal(13,2)", "WS-END": "string"}
    return reactive.run_files(pays(spark, sf_dir), ["o_custkey"], ["o_orderkey"], "PAY-FILE", samples.TOTALS, out).drop("steps")


def events(rows, file="PAY-FILE"):
    """Each row of (o_custkey, o_orderkey, fields...) as an inbound record of its customer, and the end of the customer's file."""
    w = Window.partitionBy("o_custkey")
    rows = rows.withColumn("seq", F.row_number().over(w.orderBy("o_orderkey")).cast("long"))
    fields = F.create_map(*(x for c in rows.columns if c not in ("o_custkey", "o_orderkey", "seq") for x in (F.lit(c.upper().replace("_", "-")), F.col(c).cast("string"))))
    some = rows.select(F.col("o_custkey").cast("string").alias("key"), "seq", F.lit(f"GET.FILE.{file}").alias("event"), fields.alias("fields"))
    ends = rows.groupBy("o_custkey").agg(F.max("seq").alias("n"))
    ends = ends.select(F.col("o_custkey").cast("string").alias("key"), (F.col("n") + 1).alias("seq"), F.lit(f"END.FILE.{file}").alias("event"), F.create_map().cast("map<string,string>").alias("fields"))
    return some.unionByName(ends)


@query(
    "SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(o_orderkey AS VARCHAR) AS out_id, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS out_amt, "
    "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR) AS out_no FROM orders WHERE o_orderstatus = 'O' AND CAST(o_totalprice AS DECIMAL(15,2)) > 200000"
)
def events_published(spark, sf_dir):
    """Records that an event-driven program writes, as events that go out."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("ord_id"), F.col("o_orderstatus").alias("ord_status"), F.col("o_totalprice").cast("decimal(15,2)").alias("ord_amt"))
    out = reactive.run_batch(events(o, "ORD-FILE"), samples.PICKS).where("kind = 'publish' and name = 'CREATE.FILE.OUT-FILE'")
    return out.select("key", *(F.get_json_object("value", f"$.{n}").alias(n.lower().replace("-", "_")) for n in ("OUT-ID", "OUT-AMT", "OUT-NO")))


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(CAST(SUM(amt) AS DECIMAL(13,2)) AS VARCHAR) AS value FROM ({PAYS}) GROUP BY 1")
def stream_batch_equal(spark, sf_dir):
    """The same program driven by events, as many as there are orders and ends of files, gives the totals that it displays."""
    return reactive.run_batch(events(pays(spark, sf_dir)), samples.TOTALS).where("kind = 'display'").select("key", "value")


FOLD = """
WITH RECURSIVE s AS (
  SELECT o_custkey, o_orderstatus AS st, CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 100 AS BIGINT) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders
), r AS (
  SELECT o_custkey, n, CAST(0 AS BIGINT) AS net FROM (SELECT DISTINCT o_custkey, 0 AS n FROM s)
  UNION ALL
  SELECT r.o_custkey, s.n, sign(r.net * 10 + CASE WHEN s.st = 'O' THEN s.c ELSE -s.c END)::BIGINT * ((abs(r.net * 10 + CASE WHEN s.st = 'O' THEN s.c ELSE -s.c END) // 10) % 10000000)
  FROM r JOIN s ON s.o_custkey = r.o_custkey AND s.n = r.n + 1
)
SELECT t.o_custkey, CAST(t.open_sum AS DECIMAL(13,2)) AS open_sum, CAST(t.all_count AS DECIMAL(7,0)) AS all_count, CAST(t.big_count AS DECIMAL(5,0)) AS big_count, CAST(CAST(u.net AS DECIMAL(7,0)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(7,1)) AS net, t.last_status
FROM (SELECT o_custkey, CAST(SUM(CASE WHEN st = 'O' THEN c ELSE 0 END) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS open_sum, COUNT(*) AS all_count, SUM(CASE WHEN c > 20000000 AND st <> 'O' THEN 1 ELSE 0 END) AS big_count, arg_max(st, n) AS last_status FROM s GROUP BY 1) t
JOIN (SELECT o_custkey, arg_max(net, n) AS net FROM r GROUP BY 1) u ON t.o_custkey = u.o_custkey
"""


@query(FOLD)
def program_as_aggregation(spark, sf_dir):
    """A whole read loop compiled to one aggregation; groups whose signed total could overflow or is cut on the way run in order."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("ord_status"), F.col("o_totalprice").cast("decimal(15,2)").alias("ord_amt"))
    return foldplan.run(samples.ORDERS, df, ["o_custkey"], ["o_orderkey"])
