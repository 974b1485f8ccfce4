"""Driver queries of totals whose order matters, with one key for all rows of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fold

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


CENTS = "CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * 100 AS BIGINT)"


#: Line items have no key of their own; rows that are equal in these are interchangeable.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "x"]
BY = f"ORDER BY l_orderkey, l_linenumber, l_partkey, {CENTS}"


def flows(spark, sf_dir):
    """All line items under one key; returned ones count against the total."""
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    x = F.when(F.col("l_returnflag") == "R", -price).otherwise(price).alias("x")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("ALL").alias("book"), "l_orderkey", "l_linenumber", "l_partkey", x)


@query(
    f"SELECT 'ALL' AS book, CAST(CAST(list_reduce(list_prepend(0, list({CENTS} {BY})), lambda a, x: (a + x) % 100000000) AS DECIMAL(9,0)) "
    "* CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(8,2)) AS ws_net FROM lineitem"
)
def one_key_total(spark, sf_dir):
    """A signed total that wraps many times, over all line items as one ordered group."""
    return fold.safe_total(flows(spark, sf_dir), ["book"], ORDER, "x", "ws_net", "S9(6)V99")


@query(f"""
WITH s AS (
  SELECT l_orderkey, l_linenumber, l_partkey, {CENTS} AS x, coalesce(sum({CENTS}) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM lineitem
), r AS (
  SELECT *, (before % 100000000 + 100000000) % 100000000 AS rest FROM s
), e AS (
  SELECT *, CASE WHEN x < 0 AND rest + x < 0 THEN -1 WHEN (rest + x) % 100000000 = 0 OR rest + x >= 100000000 THEN 1 END AS turned FROM r
), g AS (
  SELECT *, last_value(turned IGNORE NULLS) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS side FROM e
)
SELECT l_orderkey, l_linenumber,
       CAST(CAST(CASE WHEN side = -1 AND rest > 0 THEN rest - 100000000 ELSE rest END AS DECIMAL(9,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(8,2)) AS before_read FROM g
""")
def one_key_trace(spark, sf_dir):
    """That total as each READ finds it."""
    out = fold.safe_trace(flows(spark, sf_dir), ["book"], ORDER, "x", "before_read", "S9(6)V99")
    return out.select("l_orderkey", "l_linenumber", "before_read")


BALANCES = "list_prepend(0, list(CAST(CAST(c_acctbal AS DECIMAL(15,2)) * 100 AS BIGINT) ORDER BY c_custkey))"


@query(
    f"SELECT side, CAST(CAST(n AS DECIMAL(9,0)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(5,1)) AS ws_tenths FROM ("
    f"SELECT 'signed' AS side, list_reduce({BALANCES}, lambda a, x: (a * 10 + x) // 10 % 100000) AS n FROM customer "
    f"UNION ALL SELECT 'unsigned', list_reduce({BALANCES}, lambda a, x: abs(a * 10 + x) // 10 % 100000) FROM customer)"
)
def one_key_finer_steps(spark, sf_dir):
    """Balances added to fields of one fraction digit, signed and unsigned: cutting depends on the sign of the sum on the way."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_acctbal").cast("decimal(15,2)").alias("x"))
    both = [
        fold.safe_total(df.withColumn("side", F.lit(side)), ["side"], ["c_custkey"], "x", "ws_tenths", picture)
        for side, picture in (("signed", "S9(4)V9"), ("unsigned", "9(4)V9"))
    ]
    return both[0].unionByName(both[1])
