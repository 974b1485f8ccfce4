"""Driver queries over the sample estate: every view, with the rows worked out by hand where they are few."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.settle import settled
from ..sources import estate
from . import estate_rows, jobs, samples, views

QUERIES: dict = {}
ORACLES: dict = {}


def sample_facts(spark: SparkSession) -> DataFrame:
    programs = spark.createDataFrame(sorted(samples.PROGRAMS.items()), "name string, text string")
    members = spark.createDataFrame(sorted(samples.MEMBERS.items()), "name string, text string")
    return settled(estate.parse_estate(programs, members))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(sample_facts(spark))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(columns: str, *rows: tuple) -> str:
    def lit(x):
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


def joined(c: str) -> F.Column:
    return F.array_join(F.sort_array(c), ",")


@query(estate_rows.values(estate_rows.DATA_DICTIONARY))
def estate_data_dictionary(facts):
    return views.data_dictionary(facts).select("program", "name", "category", "digits", "scale", "signed", "usage", "member")


@query(estate_rows.values(estate_rows.RECORD_LAYOUT))
def estate_record_layout(facts):
    numbers = [F.col(c).cast("int").alias(c) for c in ("start", "length", "record_size")]
    return views.record_layout(facts).select("program", "record_name", "name", *numbers, "reason")


@query(estate_rows.values(estate_rows.ENDPOINTS))
def estate_endpoints(facts):
    d = views.endpoints(facts)
    return d.select("program", "endpoint", "endpoint_type", joined("directions").alias("directions"), joined("verbs").alias("verbs"), "assign")


@query(values("table_name, column_name, host_var, status", ("ACCOUNT", "NAME", "ACC-NAME", "mapped"), ("ACCOUNT", "BAL", "ACC-BAL", "mapped"), ("ACCOUNT", None, None, "refused: an indicator variable"), ("ACCOUNT", "BAL", "ACC-BAL", "mapped"), ("LEDGER", "ID", "ACC-ID", "mapped"), ("LEDGER", None, "ACC-BAL", "derived")))
def estate_sql_columns(facts):
    return estate.fact_table(facts, "sql_column").select(F.col("table").alias("table_name"), F.col("column").alias("column_name"), "host_var", "status")


@query(estate_rows.values(estate_rows.CONSTANTS))
def estate_constants(facts):
    return views.constants(facts).select("program", "item", "status", joined("literals").alias("literals"))


@query(values("program, operand, callee, resolution, category", ("RULES", "WS-PGM", "RATES", "proven", "cobol-program"), ("RULES", "DSNTIAR", "DSNTIAR", "literal", "ibm-db2"), ("RULES", "WS-NEXT", None, "runtime", "unresolved")))
def estate_calls(facts):
    return views.calls(facts).select("program", "operand", "callee", "resolution", "category")


@query(values("program, operand, outcome, named_by, through, steps", ("RULES", "WS-NEXT", "artifact", "GET.CONSOLE.SYSIN", "WS-ID", 1)))
def estate_dynamic_calls(facts):
    return views.dynamic_calls(facts).select("program", "operand", "outcome", "named_by", "through", "steps")


@query(values("program, kind, name, io, identity", ("RATES", "db2-table", "ACCOUNT", "input-output", "global"), ("RATES", "db2-table", "LEDGER", "input", "global"), ("RATES", "file", "OUT-FILE", "output", "program-local"), ("RATES", "caller", "CALLER", "input-output", "program-local"), ("RATES", "copybook", "ACCTREC", "input", "global"), ("RULES", "file", "REP-FILE", "output", "program-local"), ("RULES", "program", "RATES", "output", "global"), ("RULES", "program", "DSNTIAR", "output", "global"), ("RULES", "program", "WS-NEXT", "output", "program-local"), ("RULES", "caller", "CALLER", "input", "program-local"), ("RULES", "spool", "SYSIN", "input", "global"), ("TOTALS", "file", "PAY-FILE", "input", "program-local"), ("TOTALS", "spool", "SYSOUT", "output", "global")))
def estate_artifacts(facts):
    return views.artifacts(facts).where("excluded is null").select("program", "kind", "name", "io", "identity")


@query(values("program, pattern", ("RATES", "unload"), ("RULES", "none"), ("TOTALS", "none")))
def estate_patterns(facts):
    return views.patterns(facts)


@query(values("program, name, kind, status", ("RATES", "ACCOUNT", "db2-table", "planned"), ("RATES", "LEDGER", "db2-table", "planned"), ("RATES", "RATEOUT", "file", "planned"), ("RATES", "CALLER", "caller", "not-retrievable"), ("RATES", "ACCTREC", "copybook", "in-hand"), ("RULES", "REPOUT", "file", "planned"), ("RULES", "RATES", "program", "in-hand"), ("RULES", "DSNTIAR", "program", "supplied"), ("RULES", "WS-NEXT", "program", "dynamic"), ("RULES", "CALLER", "caller", "not-retrievable"), ("RULES", "SYSIN", "spool", "not-retrievable"), ("TOTALS", "PAYIN", "file", "planned"), ("TOTALS", "SYSOUT", "spool", "not-retrievable")))
def estate_fetch_plan(facts):
    have = facts.sparkSession.createDataFrame([(n,) for n in [*samples.PROGRAMS, *samples.MEMBERS]], "name string")
    return views.fetch_plan(facts, have).select("program", "name", "kind", "status")


@query(estate_rows.values(estate_rows.LINEAGE))
def estate_lineage(facts):
    text = F.transform("conditions", lambda c: F.when(c.negated, F.concat(F.lit("NOT "), c.guard)).otherwise(c.guard))
    return views.lineage(facts).select(
        "program", "event", "field", "line", F.array_join(F.transform("changed_by", lambda n: F.concat(F.lit("L"), n)), ",").alias("changed_by"),
        F.array_join(F.transform("origins", lambda o: o.event), ",").alias("origins"), F.array_join(F.sort_array(text), ",").alias("conditions"),
        F.col("conditions_partial").alias("partial"),
    )


@query(estate_rows.values(estate_rows.BUSINESS_RULES))
def estate_business_rules(facts):
    return views.business_rules(facts).select("program", "event", "line", F.array_join("rule", " AND ").alias("rule"), joined("fields").alias("fields"))


@query(estate_rows.values(estate_rows.BUSINESS_STEPS))
def estate_business_steps(facts):
    return views.business_steps(facts).select("program", "source", "target", F.array_join("rule", ",").alias("rule"))


@query(estate_rows.values(estate_rows.BUSINESS_STATES))
def estate_business_states(facts):
    return views.business_states(facts)


@query(values("program, paragraph", ("LOOPS", "C-SELF")))
def estate_perform_cycles(facts):
    return views.perform_cycles(facts)


@query(values("caller, callee, place, argument, parameter", ("RULES", "RATES", 0, "WS-FEE", "LK-FEE")))
def estate_callers(facts):
    return views.callers(facts).drop("line")


@query(values("node, component", ("program:RATES", "copybook:ACCTREC"), ("copybook:ACCTREC", "copybook:ACCTREC"), ("db2-table:ACCOUNT", "copybook:ACCTREC"), ("db2-table:LEDGER", "copybook:ACCTREC"), ("dd:RATEOUT", "copybook:ACCTREC"), ("dd:REPOUT", "copybook:ACCTREC"), ("program:DSNTIAR", "copybook:ACCTREC"), ("program:RULES", "copybook:ACCTREC"), ("dd:PAYIN", "dd:PAYIN"), ("program:TOTALS", "dd:PAYIN")))
def estate_graph_components(facts):
    return views.graph_components(facts)


@query()
def estate_state_graph(facts):
    return estate.fact_table(facts, "edge")


@query(estate_rows.values(estate_rows.STATEMENTS))
def estate_statements(facts):
    return estate.fact_table(facts, "statement").select("program", "stmt_id", "parent_id", "branch", "paragraph", "kind", "line", "member")


@query(values("program, line, message", ("LOOPS", 8, "OCCURS on the group LINE-A is not modelled as an array"), ("LOOPS", 14, "OCCURS DEPENDING ON: VAR-B is modelled at its greatest size")))
def estate_flags(facts):
    return estate.fact_table(facts, "flag").select("program", "line", "message")


# job steps


def steps(spark):
    rows = [
        ("J1", 1, "TOTALS", "PAYIN", "PAY.DAILY(0)", "input"), ("J1", 1, "RATES", "RATEOUT", "RATE.OUT", "output"), ("J1", 2, "SORT", "SORTIN", "RATE.OUT", "input"), ("J1", 2, "SORT", "SORTOUT", "RATE.SORTED", "output"),
        ("J1", 3, "RULES", "IN", "RATE.SORTED", "input"), ("J1", 3, "RULES", "REPOUT", "REP.A", "output"), ("J2", 1, "RULES", "REPOUT", "REP.B(+1)", "output"),
    ]
    return spark.createDataFrame(rows, "job string, step int, program string, ddname string, dataset string, direction string")


@query(values("program, ddname, status, datasets", ("TOTALS", "PAYIN", "bound", "PAY.DAILY"), ("RATES", "RATEOUT", "bound", "RATE.OUT"), ("RULES", "REPOUT", "candidates", "REP.A,REP.B")))
def job_bindings(facts):
    return jobs.bind(views.artifacts(facts), steps(facts.sparkSession)).select("program", "ddname", "status", joined("datasets").alias("datasets"))


@query(values("job, dataset, consumer, producer", ("J1", "RATE.OUT", 2, 1), ("J1", "RATE.SORTED", 3, 2)))
def job_dataflow(facts):
    return jobs.dataflow(steps(facts.sparkSession))


@query(values("job, dataset, role", ("J1", "PAY.DAILY", "source"), ("J1", "RATE.OUT", "intermediate"), ("J1", "RATE.SORTED", "intermediate"), ("J1", "REP.A", "result"), ("J2", "REP.B", "result")))
def job_dataset_roles(facts):
    return jobs.dataset_roles(steps(facts.sparkSession))


@query(values("job, step, runs", ("J1", 2, True), ("J1", 3, False), ("J1", 4, True)))
def job_runs(facts):
    spark = facts.sparkSession
    conds = spark.createDataFrame([("J1", 2, 1, "EQ", 0, "if"), ("J1", 3, 1, "LE", 0, "cond"), ("J1", 4, 2, "LT", 4, "cond")], "job string, step int, tested int, operator string, value int, kind string")
    codes = spark.createDataFrame([("J1", 1, 0), ("J1", 2, 4)], "job string, step int, code int")
    return jobs.runs(conds, codes)
