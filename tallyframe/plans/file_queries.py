"""Driver queries of keyed files, generation datasets, byte lineage over job steps, record files, ordered streams, and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions.bytes import ByteLayout
from ..functions.picture import parse_picture
from ..operators import byte_lineage, keyed, scan
from ..operators.settle import shared_folder
from ..sources import estate, record_file
from ..streaming import totals
from . import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# keyed files: events change the customer file, one step each

VERB = {"signup": "WRITE", "click": "WRITE", "purchase": "REWRITE", "view": "REWRITE"}
CHANGES = """
WITH RECURSIVE log AS (
  SELECT event_id, user_id, CAST(value AS DECIMAL(15,2)) AS amount, ts,
         CASE WHEN event_type IN ('signup', 'click') THEN 'WRITE' WHEN event_type IN ('purchase', 'view') THEN 'REWRITE' ELSE 'DELETE' END AS verb,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events
), replay(user_id, n, held, amount, event_id, status) AS (
  SELECT u.user_id, 0, c_custkey IS NOT NULL, CAST(c_acctbal AS DECIMAL(15,2)), CAST(NULL AS BIGINT), ''
  FROM (SELECT user_id FROM events UNION SELECT c_custkey FROM customer) AS u LEFT JOIN customer ON c_custkey = u.user_id
  UNION ALL
  SELECT r.user_id, l.n, CASE verb WHEN 'WRITE' THEN true WHEN 'DELETE' THEN false ELSE held END,
         CASE WHEN verb = 'WRITE' AND NOT held OR verb = 'REWRITE' AND held THEN l.amount ELSE r.amount END, l.event_id,
         CASE WHEN verb = 'WRITE' AND held THEN '22' WHEN verb <> 'WRITE' AND NOT held THEN '23' ELSE '00' END
  FROM replay AS r JOIN log AS l ON l.user_id = r.user_id AND l.n = r.n + 1
)
"""


def changes(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    file = customers.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("decimal(15,2)").alias("amount"))
    verb = F.coalesce(F.create_map(*(F.lit(x) for kv in VERB.items() for x in kv))[F.col("event_type")], F.lit("DELETE"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = events.select("event_id", "ts", "user_id", verb.alias("verb"), F.col("value").cast("decimal(15,2)").alias("amount"))
    return file, keyed.statuses(file, log, ["user_id"], ["ts", "event_id"])


@query(CHANGES + "SELECT event_id, user_id, status, status <> '00' AS invalid_key FROM replay WHERE n > 0")
def keyed_changes(spark, sf_dir):
    """Every WRITE, REWRITE and DELETE that the events make of the customer file, and whether its key was invalid."""
    return changes(spark, sf_dir)[1].select("event_id", "user_id", "status", "invalid_key")


@query(CHANGES + "SELECT user_id, amount FROM replay QUALIFY n = max(n) OVER (PARTITION BY user_id) AND held")
def keyed_file(spark, sf_dir):
    """The customer file after all of them."""
    file, told = changes(spark, sf_dir)
    return keyed.applied(file, told, ["user_id"], ["ts", "event_id"])


# generation datasets: each order is a run of its customer's job

BOOKS = "SELECT o_orderkey AS run, o_orderdate AS begun, 'PAY.C' || o_custkey % 40 AS base, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END AS made FROM orders"


@query(f"""
WITH r AS (
  SELECT *, coalesce(sum(made) OVER (PARTITION BY base ORDER BY begun, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM ({BOOKS})
), d AS (
  SELECT run, base, made, had, unnest([0, -1, -7]) AS rel, 'input' AS direction FROM r
  UNION ALL SELECT run, base, made, had, unnest(range(1, made + 1)), 'output' FROM r
  UNION ALL SELECT run, base, made, had, 2, 'input' FROM r
)
SELECT run, base, direction, rel AS relative, CASE WHEN had + rel > 0 THEN CAST(had + rel AS BIGINT) END AS generation,
       CASE WHEN direction = 'output' THEN 'made' WHEN had + rel < 1 OR rel > made THEN 'missing' WHEN rel <= -5 THEN 'rolled-off' ELSE 'found' END AS status
FROM d
""")
def generations(spark, sf_dir):
    """Generation numbers of what every run reads and makes: (0), (-1), (-7), those it makes, and the second it may have made itself."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = o.select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("then"))
    name = lambda n: F.concat(F.lit("PAY.C"), (F.col("o_custkey") % 40).cast("string"), F.lit(f"({n})"))
    one = lambda n, direction: F.struct(name(n).alias("dataset"), F.lit(direction).alias("direction"), F.lit(n).cast("long").alias("relative"))
    read = [one(n, "input") for n in (0, -1, -7, 2)]
    made = F.when(F.col("o_orderstatus") == "F", F.array(one(1, "output"))).when(F.col("o_orderstatus") == "P", F.array(one(1, "output"), one(2, "output")))
    cards = F.concat(F.array(*read), F.coalesce(made, F.array().cast("array<struct<dataset:string,direction:string,relative:bigint>>")))
    dd = o.select(F.col("o_orderkey").alias("run"), F.explode(cards).alias("c")).select("run", "c.*")
    return jobs.generations(runs, dd, limit=5).select("run", "base", "direction", F.col("relative"), "generation", "status")


# byte lineage: a job of three or four reformatting steps for each supplier

#: Cards of each step as (read from, length) of {k}; a null start is a literal. The fourth step is there for every third supplier.
STEPS = (
    (("1 + k % 5", "10 + k % 3"), (None, "2"), ("40 + k % 7", "90"), ("20", "4")),
    (("8", "100 + k % 11"), ("1 + k % 3", "6"), (None, "3"), ("100", "5")),
    (("1 + k % 9", "70"), ("71", "30"), (None, "1 + k % 2"), ("3", "9")),
    (("50", "40"), ("1", "49")),
)
CARDS = " UNION ALL ".join(
    f"SELECT k, {s} AS step, {p} AS place, {'NULL' if at is None else at} AS read, {n} AS n FROM p{' WHERE k % 3 = 0' if s == 3 else ''}" for s, cards in enumerate(STEPS) for p, (at, n) in enumerate(cards)
)
BYTES = f"""
WITH p AS (SELECT s_suppkey AS k FROM supplier), cards AS ({CARDS}), placed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY k, step ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cards
), b AS (
  SELECT k, step, before + 1 + i AS put, read + i AS got FROM (SELECT *, unnest(range(n)) AS i FROM placed)
), two AS (
  SELECT y.k, y.put, CASE WHEN y.got IS NULL THEN NULL ELSE x.got END AS got FROM b AS y LEFT JOIN b AS x ON x.k = y.k AND x.step = 0 AND x.put = y.got
  WHERE y.step = 1 AND (y.got IS NULL OR x.put IS NOT NULL)
), three AS (
  SELECT y.k, y.put, x.got FROM b AS y LEFT JOIN two AS x ON x.k = y.k AND x.put = y.got WHERE y.step = 2 AND (y.got IS NULL OR x.put IS NOT NULL)
), four AS (
  SELECT y.k, y.put, x.got FROM b AS y LEFT JOIN three AS x ON x.k = y.k AND x.put = y.got WHERE y.step = 3 AND (y.got IS NULL OR x.put IS NOT NULL)
)
SELECT k AS chain, CAST(put AS BIGINT) AS put, CAST(got AS BIGINT) AS got FROM three WHERE k % 3 <> 0
UNION ALL SELECT k, CAST(put AS BIGINT), CAST(got AS BIGINT) FROM four
"""


@query(BYTES)
def byte_chains(spark, sf_dir):
    """The input byte of every byte that the last step of each chain puts out."""
    k = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    cards = None
    for s, parts in enumerate(STEPS):
        card = lambda p, at, n: F.struct(F.lit(p).alias("place"), (F.lit(None) if at is None else F.expr(at)).cast("long").alias("in_start"), F.expr(n).cast("long").alias("length"))
        rows = (k.where("k % 3 = 0") if s == 3 else k).select(F.col("k").alias("chain"), F.lit(s).alias("step"), F.explode(F.array(*(card(p, at, n) for p, (at, n) in enumerate(parts)))).alias("c"))
        rows = rows.select("chain", "step", "c.*")
        cards = rows if cards is None else cards.unionByName(rows)
    ranges = byte_lineage.traced(byte_lineage.parts_of(cards, ["chain", "step"]))
    return ranges.withColumn("i", F.explode(F.expr("sequence(0L, length - 1)"))).select("chain", (F.col("out_start") + F.col("i")).alias("put"), (F.col("in_start") + F.col("i")).alias("got"))


# record files in bytes

ORDERS = [("ID", "9(9)", "COMP"), ("STATUS", "X", "DISPLAY"), ("AMT", "S9(9)V99", "COMP-3"), ("DAY", "S9(4)", "BINARY"), ("PRIO", "X(15)", "DISPLAY")]


@query(
    "SELECT form, o_orderkey AS id, o_orderstatus AS status, CAST(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(11,2)) AS amt, "
    "CAST(dayofmonth(o_orderdate) - 16 AS DECIMAL(4,0)) AS day, o_orderpriority AS prio FROM orders, (VALUES ('F'), ('V')) AS v(form)"
)
def record_files(spark, sf_dir):
    """Orders with packed and binary numbers, written to files of fixed and of variable records, and read back in several splits a file."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.col("o_totalprice").cast("decimal(15,2)")
    df = o.select(
        F.col("o_orderkey").cast("decimal(9,0)").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") == "F", -price).otherwise(price).alias("amt"),
        (F.dayofmonth("o_orderdate") - 16).cast("decimal(4,0)").alias("day"), F.col("o_orderpriority").alias("prio"),
    )
    layout = ByteLayout(ORDERS)
    whole = layout.record()
    ragged = F.substring(whole, F.lit(1), F.lit(layout.size - 15) + F.length(F.rtrim("prio")))  # without the spaces at its end
    out = None
    for form, record in (("F", whole), ("V", ragged)):
        path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
        record_file.write(df.select(record.alias("record")), "record", path, form=form, size=layout.size, step_kb=16)
        got = layout.read(record_file.read(spark, path, form=form, size=layout.size, split_kb=64), "record")
        got = got.select(F.lit(form).alias("form"), F.col("id").cast("long").alias("id"), "status", "amt", "day", F.rtrim("prio").alias("prio"))
        out = got if out is None else out.unionByName(got)
    return out


# a stream

@query(
    "SELECT CAST(user_id AS VARCHAR) AS key, count(*) + 1 AS seq, CAST(CAST(list_reduce(list_prepend(0, list(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * CAST(CAST(value AS DECIMAL(15,2)) * 100 AS BIGINT) "
    "ORDER BY ts, event_id)), lambda a, x: (a + x) % 100000) AS DECIMAL(9,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(5,2)) AS total FROM events GROUP BY user_id"
)
def streamed_totals(spark, sf_dir):
    """Signed totals of events that arrive in any order, in several batches, each told when its user's end has come."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.col("value").cast("decimal(15,2)")
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.row_number().over(w).cast("long").alias("seq"), F.when(F.col("event_type") == "purchase", -value).otherwise(value).alias("x"))
    ends = rows.groupBy("key").agg((F.max("seq") + 1).alias("seq")).select("key", "seq", F.lit(None).cast("decimal(15,2)").alias("x"), F.lit(True).alias("last"))
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    shuffled = rows.withColumn("last", F.lit(False)).unionByName(ends).repartition(6, F.xxhash64("key", "seq"))
    shuffled.write.parquet(f"{path}/in")
    p = parse_picture("S9(3)V99")
    stream = spark.readStream.schema(shuffled.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    told = totals.drain(totals.ordered_totals(stream, scan.step(F.col("x"), p, 2), p), path)
    return told.where("kind = 'total'").select("key", "seq", totals.number(F.col("units"), p).alias("total"))


# an estate that answers slowly and sometimes fails


def _estate(name: str, kind: str):
    """A stand-in for an outside service: what it has follows from the number in a name."""
    n = int(name.rsplit("#", 1)[1])
    if n % 7 == 3:
        raise OSError("not reachable")
    if n % 3 == 0:
        return None
    return f"MEMBER {n}" if kind == ("cobol" if n % 2 else "asm") else {"text": None, "alternatives": [f"ALT{n}"]} if n % 5 == 0 else None


@query(
    "SELECT s_name AS name, CASE WHEN n % 7 = 3 THEN 'error' WHEN n % 3 = 0 THEN 'absent' WHEN n % 2 = 0 AND n % 5 = 0 THEN 'alternatives' ELSE 'found' END AS outcome, "
    "CASE WHEN n % 7 = 3 OR n % 3 = 0 OR n % 2 = 0 AND n % 5 = 0 THEN NULL WHEN n % 2 = 1 THEN 'cobol' ELSE 'asm' END AS found_type, "
    "CASE WHEN n % 7 = 3 OR n % 3 = 0 OR n % 2 = 0 AND n % 5 = 0 THEN NULL ELSE 'MEMBER ' || n END AS text "
    "FROM (SELECT s_name, CAST(split_part(s_name, '#', 2) AS BIGINT) AS n FROM supplier)"
)
def retrieved_members(spark, sf_dir):
    """One member for each supplier's name, asked as a program and then as an assembler source, several at a time and again after failures."""
    plan = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("name"), F.array(F.lit("cobol"), F.lit("asm")).alias("types"), F.col("s_suppkey").alias("place"))
    return estate.retrieve(plan, _estate, jobs=4, tries=2, wait=0.001).select("name", "outcome", "found_type", "text")
