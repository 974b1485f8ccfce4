"""Job steps and their datasets (an extension): binding of files to datasets, dataflow between steps, run conditions.

dd: job, step (position), program, ddname, dataset, direction (input | output), place in a concatenation. There is no job-language front end here; the table comes from outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import sum_before


def base_name(dataset: Column) -> Column:
    """A generation dataset's base: X(+1), X(-1) and X(0) are X."""
    return F.regexp_replace(dataset, r"\([+-]?\d+\)$", "")


def relative(dataset: Column) -> Column:
    """The relative number of a generation, X(-1) -> -1; null for other names."""
    return F.regexp_extract(dataset, r"\(([+-]?\d+)\)$", 1).try_cast("long")


def generations(runs: DataFrame, dd: DataFrame, limit: int | None = None) -> DataFrame:
    """dd (run, dataset, direction, ...) with base, generation and status, for runs (run, then) in order of `then` and run.

    A run finds the generations that the runs before it left: (0) is the newest of them, (-1) the one before, and (+1) the first that it makes itself, all
    day as it stood when the run began. status: `made` by an output, `found`, `missing` if there is or was no such generation, `rolled-off` if `limit` newer ones
    have pushed it out; null for names that are no generations. Runs of one base may be any number: they are summed over range partitions.
    """
    rows = dd.withColumns({"base": base_name(F.col("dataset")), "relative__": relative(F.col("dataset"))})
    new = rows.where("relative__ is not null").groupBy("run", "base").agg(F.coalesce(F.max(F.when((F.col("direction") == "output") & (F.col("relative__") > 0), F.col("relative__"))), F.lit(0)).alias("new__"))
    told = sum_before(new.join(runs.select("run", "then"), "run"), ["base"], ["then", "run"], "new__", "had__").select("run", "base", "new__", "had__")
    out = rows.join(told, ["run", "base"], "left")
    number = F.col("had__") + F.col("relative__")
    made = (F.col("relative__") > 0) & (F.col("relative__") <= F.col("new__"))
    off = number <= F.col("had__") - limit if limit is not None else F.lit(False)
    status = F.when(F.col("relative__").isNull(), F.lit(None)).when(made & (F.col("direction") == "output"), "made").when((number < 1) | ((F.col("relative__") > 0) & ~made), "missing").when(off, "rolled-off").otherwise("found")
    return out.select(*dd.columns, "base", F.when(number > 0, number).alias("generation"), status.alias("status"))


def bind(artifacts: DataFrame, dd: DataFrame) -> DataFrame:
    """File artifacts with the datasets that steps give their ddnames: bound (one), candidates (several), unbound (none)."""
    files = artifacts.where("kind = 'file' and assign is not null").select("program", "name", F.col("assign").alias("ddname"), "io")
    sets = dd.groupBy("program", "ddname").agg(F.sort_array(F.collect_set(base_name(F.col("dataset")))).alias("datasets"))
    out = files.join(sets, ["program", "ddname"], "left")
    n = F.coalesce(F.size("datasets"), F.lit(0))
    return out.withColumn("status", F.when(n == 0, "unbound").when(n == 1, "bound").otherwise("candidates"))


def dataflow(dd: DataFrame) -> DataFrame:
    """(job, dataset, producer, consumer): a step reads what the last earlier step of its job wrote. One equi-join and one aggregation."""
    rows = dd.select("job", "step", base_name(F.col("dataset")).alias("dataset"), "direction").distinct()
    out = rows.where("direction = 'output'").select("job", "dataset", F.col("step").alias("producer"))
    into = rows.where("direction = 'input'").select("job", "dataset", F.col("step").alias("consumer"))
    return into.join(out, ["job", "dataset"]).where("producer < consumer").groupBy("job", "dataset", "consumer").agg(F.max("producer").alias("producer"))


def dataset_roles(dd: DataFrame) -> DataFrame:
    """Each dataset of a job: source (only read), result (only written), intermediate (written, then read by a later step)."""
    rows = dd.withColumn("dataset", base_name(F.col("dataset")))
    used = rows.groupBy("job", "dataset").agg(F.max((F.col("direction") == "input").cast("int")).alias("i"), F.max((F.col("direction") == "output").cast("int")).alias("o"))
    flows = dataflow(dd).select("job", "dataset").distinct().withColumn("f", F.lit(True))
    return used.join(flows, ["job", "dataset"], "left").select("job", "dataset", F.when(F.col("f"), "intermediate").when(F.col("o") == 1, "result").otherwise("source").alias("role"))


OPERATORS = {"EQ": lambda a, b: a == b, "NE": lambda a, b: a != b, "GT": lambda a, b: a > b, "LT": lambda a, b: a < b, "GE": lambda a, b: a >= b, "LE": lambda a, b: a <= b}


def runs(conditions: DataFrame, codes: DataFrame) -> DataFrame:
    """conditions (job, step, tested, operator, value, kind, and if wanted negated), codes (job, step, code, and if wanted abended): whether each step runs.

    Kinds: `if` must hold, or must not where negated (the ELSE of it); all IFs around a step conjoin. `cond` is the inverted sense: the step is passed over if value operator
    code is true. Without a tested step, an `if` asks for the highest code of the steps before, and a `cond` for any of them. `even` lets a step run after an abend, `only` lets it run
    then alone; other steps do not run after one.
    """
    if "negated" not in conditions.columns:
        conditions = conditions.withColumn("negated", F.lit(False))
    if "abended" not in codes.columns:
        codes = codes.withColumn("abended", F.lit(False))
    own = conditions.withColumn("n", F.monotonically_increasing_id())
    before = codes.select("job", F.col("step").alias("earlier"), "code", "abended")
    # a job's steps meet its own earlier steps: an equi-join on the job
    rows = own.join(before, "job", "left").where(F.col("earlier").isNull() | (F.coalesce(F.col("tested") == F.col("earlier"), F.col("earlier") < F.col("step"))))
    rows = own.select("n").join(rows, "n", "left").drop("job", "step", "kind", "operator", "value", "negated", "tested").join(own, "n")
    hit = F.lit(None).cast("boolean")
    for name, op in OPERATORS.items():
        hit = F.when(F.col("operator") == name, op(F.col("value"), F.col("code"))).otherwise(hit)
    per = rows.groupBy("n", "job", "step", "kind", "operator", "value", "negated").agg(F.max("code").alias("code"), F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("any"))
    holds = F.lit(None).cast("boolean")
    for name, op in OPERATORS.items():
        holds = F.when(F.col("operator") == name, op(F.col("code"), F.col("value"))).otherwise(holds)
    holds = F.coalesce(holds, F.lit(False)) != F.coalesce("negated", F.lit(False))
    ok = F.when(F.col("kind") == "if", holds).when(F.col("kind") == "cond", F.col("any") == 0).otherwise(F.lit(True))
    per_step = per.groupBy("job", "step").agg(F.min(ok.cast("int")).alias("r"), F.max((F.col("kind") == "even").cast("int")).alias("even"), F.max((F.col("kind") == "only").cast("int")).alias("only"))
    after = per_step.select("job", "step").join(before, "job").where("earlier < step").groupBy("job", "step").agg(F.max(F.coalesce("abended", F.lit(False)).cast("int")).alias("ab"))
    out = per_step.join(after, ["job", "step"], "left").withColumn("ab", F.coalesce("ab", F.lit(0)))
    fits = F.when(F.col("only") == 1, F.col("ab") == 1).when(F.col("even") == 1, F.lit(True)).otherwise(F.col("ab") == 0)
    return out.select("job", "step", ((F.col("r") == 1) & fits).alias("runs"))
