"""Views over fact tables: dictionary, layouts, interface, calls, artifacts, dynamic calls, retrieval plan, business rules, estate graph.

Every view is joins, aggregations and windows over facts of a whole estate at once; keys always carry the program.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import graph
from ..operators.settle import settled
from ..sources.estate import fact_table

# Entry points and reserved prefixes of the subsystems.
MQ_VERBS = (
    "MQCONN", "MQCONNX", "MQDISC", "MQOPEN", "MQCLOSE", "MQGET", "MQPUT", "MQPUT1", "MQINQ", "MQSET", "MQCMIT", "MQBACK", "MQBEGIN", "MQSUB", "MQSUBRQ", "MQCB", "MQCTL", "MQSTAT",
    "MQCRTMH", "MQDLTMH", "MQSETMH", "MQINQMP", "MQSETMP", "MQDLTMP", "MQMHBUF", "MQBUFMH",
)
DB2_MODULES = ("DSNTIAR", "DSNTIAC", "DSNHLI", "DSNALI", "DSNRLI", "DSNELI", "DSNCLI")
RESERVED = {"CEE": "ibm-le", "DFH": "ibm-cics"}
# Endpoint type -> (artifact kind, identity, what resolves it, order).
ARTIFACTS = {
    "db2": ("db2-table", "global", None, 0), "file": ("file", "program-local", "JCL DD statement", 1), "program": ("program", "global", "link-edit control or run-time configuration", 2),
    "queue": ("queue", "program-local", "CICS CSD or MQ definition", 3), "transaction": ("cics-transaction", "global", "CICS CSD", 4), "terminal": ("terminal-map", "program-local", "BMS mapset", 5),
    "ims": ("ims-segment", "program-local", "IMS PSB and DBD", 6), "caller": ("caller", "program-local", "JCL step or transaction definition", 7), "console": ("spool", "global", None, 8),
}
EXCLUDED = {"response": "a subsystem's reply", "condition": "a handled condition", "system": "a system value"}
# Artifact kind -> member types to ask for, likeliest first.
MEMBER_TYPES = {"program": ["cobol", "asm"], "copybook": ["copybook"], "db2-table": ["ddl"], "file": ["cntl"], "terminal-map": ["bms"], "cics-transaction": ["csd"], "queue": ["csd"]}


def data_dictionary(facts: DataFrame) -> DataFrame:
    """Typed items and condition names; `resolves` marks the item that an unqualified name means (the first of its name)."""
    items = fact_table(facts, "data_item").where("name <> 'FILLER'")
    w = Window.partitionBy("program", "name").orderBy("ordinal")
    items = items.withColumn("resolves", F.row_number().over(w) == 1)
    conds = fact_table(facts, "cond_name").groupBy("program", F.col("of").alias("name")).agg(F.sort_array(F.collect_list("name")).alias("condition_names"))
    return items.join(conds, ["program", "name"], "left")


def _over_ancestors(rows: DataFrame, value: str, both) -> DataFrame:
    """rows (program, ord, up, value): value combined by both() with those of all items above. Each round looks twice as many levels up."""
    chain = settled(rows.select("program", "ord", "up", value))
    while not chain.where("up is not null").isEmpty():
        above = chain.select("program", F.col("ord").alias("up"), F.col("up").alias("next"), F.col(value).alias("more"))
        chain = settled(chain.join(above, ["program", "up"], "left").select("program", "ord", F.col("next").alias("up"), both(F.col(value), F.col("more")).alias(value)))
    return chain.drop("up")


def record_layout(facts: DataFrame) -> DataFrame:
    """Bytes of each record: start and length of every elementary field, or why they are withheld.

    A record is withheld if it holds OCCURS DEPENDING, SYNCHRONIZED or REDEFINES. A table's length is its element times its size (`occurs`). Fields inside a repeating
    group are those of its first occurrence; what follows the group starts after its last.
    """
    items = fact_table(facts, "data_item").withColumn("ord", F.row_number().over(Window.partitionBy("program").orderBy("ordinal")) - 1)
    items = items.withColumn("record", F.max(F.when(F.col("level").isin(1, 77), F.col("ord"))).over(Window.partitionBy("program").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    items = items.withColumns({"up": F.col("above"), "own": F.greatest(F.col("occurs"), F.lit(1))})
    times = _over_ancestors(items.select("program", "ord", "up", F.col("own").cast("long").alias("times")), "times", lambda a, b: a * F.coalesce(b, F.lit(1)))
    sized = items.join(times, ["program", "ord"]).withColumn("full", F.when(F.col("is_group"), 0).otherwise(F.col("bytes") * F.col("times")))
    before = Window.partitionBy("program", "record").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    sized = settled(sized.withColumn("passed", F.coalesce(F.sum("full").over(before), F.lit(0))))
    # how far an item lies behind the start of its parent: what lies between them, in one occurrence of the parent
    parent = sized.select("program", F.col("ord").alias("up"), F.col("passed").alias("parent_passed"), F.col("times").alias("parent_times"))
    behind = (F.col("passed") - F.coalesce("parent_passed", F.lit(0))) / F.coalesce("parent_times", F.lit(1))
    behind = sized.join(parent, ["program", "up"], "left").select("program", "ord", "up", F.when(F.col("up").isNull(), 0).otherwise(behind).cast("long").alias("offset"))
    offsets = _over_ancestors(behind, "offset", lambda a, b: a + F.coalesce(b, F.lit(0)))
    blockers = items.groupBy("program", "record").agg(
        F.first(F.when(F.col("level").isin(1, 77), F.col("name")), ignorenulls=True).alias("record_name"),
        F.concat_ws(", ", F.sort_array(F.collect_set(F.when(F.col("depending").isNotNull(), "OCCURS DEPENDING ON").when(F.col("sync"), "SYNCHRONIZED").when(F.col("redefines").isNotNull(), "REDEFINES")))).alias("why"),
    )
    out = sized.withColumn("record_size", F.sum("full").over(Window.partitionBy("program", "record"))).where("not is_group")
    out = out.join(offsets, ["program", "ord"]).join(blockers, ["program", "record"])
    known = F.col("why") == ""
    return out.select(
        "program", "record_name", "ord", "name", F.when(known, F.col("offset") + 1).alias("start"), (F.col("bytes") * F.col("own")).alias("length"), F.col("own").alias("occurs"),
        F.when(known, F.col("record_size")).alias("record_size"), F.when(~known, F.concat(F.lit("withheld: "), "why")).alias("reason"),
    )


def endpoints(facts: DataFrame) -> DataFrame:
    """One row for each endpoint of a program, with its directions, verbs and file binding."""
    ev = fact_table(facts, "event")
    out = ev.groupBy("program", "endpoint_type", "endpoint").agg(
        F.sort_array(F.collect_set("direction")).alias("directions"), F.sort_array(F.collect_set("verb")).alias("verbs"), F.sort_array(F.collect_set("line")).alias("lines"),
        F.max("dynamic").alias("dynamic"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("fields"), F.min("ordinal").alias("first_seen"),
    )
    files = fact_table(facts, "file_binding").select("program", F.col("file").alias("endpoint"), F.lit("file").alias("endpoint_type"), "assign", "organization", "access", "record_key", "status_field")
    return out.join(files, ["program", "endpoint_type", "endpoint"], "left")


def perimeter(facts: DataFrame) -> DataFrame:
    """Paragraphs that cross the boundary, labelled input, output or input-output."""
    ev = fact_table(facts, "event").where("stmt_id >= 0").groupBy("program", "paragraph").agg(F.max((F.col("direction") == "input").cast("int")).alias("i"), F.max((F.col("direction") == "output").cast("int")).alias("o"))
    return ev.select("program", "paragraph", F.when((F.col("i") == 1) & (F.col("o") == 1), "input-output").when(F.col("i") == 1, "input").otherwise("output").alias("perimeter"))


def constants(facts: DataFrame) -> DataFrame:
    """What each text item can hold: proven if one literal and nothing else reaches it, else the candidates and why not.

    Literals come from VALUE, MOVE and SET of condition names; an item that a READ, ACCEPT, CALL or a variable can fill is not constant.
    """
    items = fact_table(facts, "data_item").where("not is_group and name <> 'FILLER'").select("program", F.col("name").alias("item"), F.regexp_replace("value", "^['\"]|['\"]$", "").alias("v"))
    moves = fact_table(facts, "assignment").select("program", F.col("target").alias("item"), "literal")
    filled = fact_table(facts, "event").where("direction = 'input'").select("program", F.explode("fields").alias("item")).distinct().withColumn("filled", F.lit(True))
    conds = fact_table(facts, "cond_name").select("program", F.col("of").alias("item"), F.explode("values").alias("candidate")).groupBy("program", "item").agg(F.sort_array(F.collect_set("candidate")).alias("declared"))
    lits = items.select("program", "item", F.col("v").alias("literal")).where("literal is not null").unionByName(moves.where("literal is not null"))
    lits = lits.groupBy("program", "item").agg(F.sort_array(F.collect_set(F.rtrim("literal"))).alias("literals"))
    moved = moves.groupBy("program", "item").agg(F.max(F.col("literal").isNull().cast("int")).alias("variable"))
    out = items.select("program", "item").distinct().join(lits, ["program", "item"], "left").join(moved, ["program", "item"], "left").join(filled, ["program", "item"], "left").join(conds, ["program", "item"], "left")
    n = F.coalesce(F.size("literals"), F.lit(0))
    status = (
        F.when((F.coalesce("variable", F.lit(0)) == 1) | F.coalesce("filled", F.lit(False)), "runtime").when(n == 1, "proven").when(n > 1, "candidates").when(F.col("declared").isNotNull(), "declared-candidates").otherwise("never-assigned")
    )
    return out.select("program", "item", status.alias("status"), F.coalesce("literals", F.array().cast("array<string>")).alias("literals"), F.coalesce("declared", F.array().cast("array<string>")).alias("declared"))


def _category(name: Column) -> Column:
    c = F.when(name.isin(*MQ_VERBS), "ibm-mq").when(name.isin(*DB2_MODULES), "ibm-db2")
    for prefix, kind in RESERVED.items():
        c = c.when(name.startswith(prefix), kind)
    return c


def calls(facts: DataFrame) -> DataFrame:
    """Calls with their targets: literal, resolved by constants, or unresolved with the reason; and what kind of program each is."""
    c = fact_table(facts, "call")
    k = constants(facts).select("program", F.col("item").alias("target"), "status", "literals", "declared")
    out = c.join(k, ["program", "target"], "left")
    resolved = F.when(F.col("literal"), F.col("target")).when(F.col("status") == "proven", F.upper(F.trim(F.element_at("literals", 1))))
    why = F.when(F.col("literal"), "literal").when(F.col("status").isNull(), "not-declared").otherwise(F.col("status"))
    out = out.select("program", "paragraph", "line", "verb", F.col("target").alias("operand"), resolved.alias("callee"), why.alias("resolution"), F.when(resolved.isNull(), F.array_union(F.coalesce("literals", F.array().cast("array<string>")), F.coalesce("declared", F.array().cast("array<string>")))).alias("candidates"), F.col("using").alias("arguments"))
    inner = fact_table(facts, "program").where("inside is not null").select(F.col("program").alias("callee"), F.lit(True).alias("nested")).distinct()
    known = fact_table(facts, "program").where("inside is null").select(F.col("program").alias("callee"), F.lit(True).alias("parsed")).distinct()
    out = out.join(inner, "callee", "left").join(known, "callee", "left")
    kind = F.when(F.col("callee").isNull(), "unresolved").otherwise(F.coalesce(F.when(F.col("nested"), "internal-nested"), _category(F.col("callee")), F.when(F.col("parsed"), "cobol-program"), F.lit("unresolved-program")))
    return out.withColumn("category", kind).drop("nested", "parsed")


def artifacts(facts: DataFrame) -> DataFrame:
    """What each program is related to: tables, files, programs, queues, maps, copybooks; one row each, in a fixed order. Exclusions keep their reason."""
    ep = endpoints(facts).where("endpoint_type <> 'program'")
    spec = facts.sparkSession.createDataFrame([(k, *v) for k, v in ARTIFACTS.items()], "endpoint_type string, kind string, identity string, resolved_by string, priority int")
    out_rows = facts.sparkSession.createDataFrame(list(EXCLUDED.items()), "endpoint_type string, excluded string")
    # fixed vocabularies of a few rows
    rows = ep.join(F.broadcast(spec), "endpoint_type", "left").join(F.broadcast(out_rows), "endpoint_type", "left")
    io = F.when(F.size("directions") == 2, "input-output").otherwise(F.element_at("directions", 1))
    cics = F.exists("verbs", lambda v: v.startswith("CICS"))
    resolver = F.when((F.col("endpoint_type") == "file") & cics, "CICS CSD").otherwise(F.col("resolved_by"))
    rows = rows.select("program", F.coalesce("kind", "endpoint_type").alias("kind"), F.col("endpoint").alias("name"), io.alias("io"), "identity", resolver.alias("resolved_by"), "assign", F.coalesce("priority", F.lit(99)).alias("priority"), "excluded", "dynamic")
    called = calls(facts).groupBy("program", F.coalesce("callee", "operand").alias("name"), "category").agg(F.max(F.col("callee").isNull()).alias("dynamic"))
    called = called.select("program", F.lit("program").alias("kind"), "name", F.lit("output").alias("io"), F.when(F.col("dynamic"), "program-local").otherwise("global").alias("identity"), F.when(F.col("category").startswith("ibm"), F.col("category")).otherwise(F.lit(ARTIFACTS["program"][2])).alias("resolved_by"), F.lit(None).cast("string").alias("assign"), F.lit(2).alias("priority"), F.when(F.col("category") == "internal-nested", "contained in this source").alias("excluded"), "dynamic")
    copies = fact_table(facts, "copybook").groupBy("program", F.col("member").alias("name")).agg(F.max((F.col("status") == "missing").cast("int")).alias("missing"))
    copies = copies.select("program", F.lit("copybook").alias("kind"), "name", F.lit("input").alias("io"), F.lit("global").alias("identity"), F.when(F.col("missing") == 1, "missing").otherwise("found").alias("resolved_by"), F.lit(None).cast("string").alias("assign"), F.lit(9).alias("priority"), F.lit(None).cast("string").alias("excluded"), F.lit(False).alias("dynamic"))
    return rows.unionByName(called).unionByName(copies)


def patterns(facts: DataFrame) -> DataFrame:
    """Programs that unload a table to a file or load a file into a table."""
    a = artifacts(facts).where("excluded is null").groupBy("program").agg(*(F.max(((F.col("kind") == k) & F.col("io").contains(d)).cast("int")).alias(n) for n, k, d in (("db_in", "db2-table", "input"), ("db_out", "db2-table", "output"), ("f_in", "file", "input"), ("f_out", "file", "output"))))
    return a.select("program", F.when((F.col("db_in") == 1) & (F.col("f_out") == 1), "unload").when((F.col("f_in") == 1) & (F.col("db_out") == 1), "load").otherwise("none").alias("pattern"))


def lineage(facts: DataFrame) -> DataFrame:
    return fact_table(facts, "lineage").drop("ordinal")


def _operands(facts: DataFrame) -> DataFrame:
    return calls(facts).where("callee is null").select("program", "operand", "resolution", "candidates").distinct()


def _routes(facts: DataFrame, operands: DataFrame) -> DataFrame:
    """(program, operand, item, steps, route): every item whose value can come to an operand, by the shortest way over assignments (source, target, line), in source order.

    One equi-join for each step back over all programs at once; ties go to the least route. An item is seen once for each operand, so the rounds end.
    """
    back = fact_table(facts, "assignment").where("literal is null").select("program", F.col("target").alias("item"), F.explode("reads").alias("source"), "line")
    back = settled(back.groupBy("program", "item", "source").agg(F.min("line").alias("line")))
    none = F.array().cast("array<struct<source:string,target:string,line:int>>")
    seen = wave = settled(operands.select("program", "operand", F.col("operand").alias("item"), F.lit(0).alias("steps"), none.alias("route")).distinct())
    for k in count(1):
        step = F.array(F.struct("source", F.col("item").alias("target"), "line"))
        more = wave.join(back, ["program", "item"]).groupBy("program", "operand", F.col("source").alias("at")).agg(F.min(F.concat(step, "route")).alias("route"))
        more = more.select("program", "operand", F.col("at").alias("item"), F.lit(k).alias("steps"), "route")
        wave = settled(more.join(seen.select("program", "operand", "item"), ["program", "operand", "item"], "left_anti"))
        if wave.isEmpty():
            return seen
        seen = seen.unionByName(wave)
        if k % 16 == 0:
            seen = settled(seen)


def _fills(facts: DataFrame) -> DataFrame:
    return fact_table(facts, "event").where("direction = 'input' and endpoint_type <> 'response'").select("program", F.explode("fields").alias("item"), "event", "endpoint_type", "endpoint", "verb", "line", "stmt_id")


def _handed_on(facts: DataFrame) -> DataFrame:
    """Items passed by reference to a call, which may write them."""
    return fact_table(facts, "call").select("program", F.explode("using").alias("item"), F.concat(F.lit("GET.PROGRAM."), "target").alias("event"), F.col("target").alias("endpoint"), "verb", "line", "stmt_id")


def dynamic_calls(facts: DataFrame) -> DataFrame:
    """How each dynamic call's target gets its value: the shortest way back over assignments from the operand to a fill from outside.

    outcome: artifact (an endpoint fills it), caller, called-program (may be filled by one), candidates, declared-candidates, chain-broken (not
    declared), dead-end (declared, never filled). `provisional` marks what rests on an item that is not declared, with the copybooks that are missing; `dead_ends` names the
    items where the ways back end; `variable` says that literals are not the whole set.
    """
    operands = _operands(facts)
    seen = settled(_routes(facts, operands))
    key = ["program", "operand"]
    hit = seen.join(_fills(facts), ["program", "item"]).groupBy(*key).agg(F.min(F.struct("steps", "event", "endpoint_type", "item")).alias("f"))
    soft = seen.join(_handed_on(facts), ["program", "item"]).groupBy(*key).agg(F.min(F.struct("steps", "event", "item")).alias("m"))
    moved = fact_table(facts, "assignment").select("program", F.col("target").alias("item"), F.lit(True).alias("moved")).distinct()
    filled = _fills(facts).select("program", "item", F.lit(True).alias("filled")).distinct()
    ends = seen.join(moved, ["program", "item"], "left").join(filled, ["program", "item"], "left").where("moved is null and filled is null and steps > 0")
    ends = ends.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("ends"))
    lost = fact_table(facts, "copybook").where("status = 'missing'").groupBy("program").agg(F.sort_array(F.collect_set("member")).alias("lost"))
    var = fact_table(facts, "assignment").where("literal is null").select("program", F.col("target").alias("operand"), F.lit(True).alias("var")).distinct()
    out = operands.join(hit, key, "left").join(soft, key, "left").join(ends, key, "left").join(var, key, "left").join(lost, "program", "left")
    outcome = (
        F.when(F.col("resolution") == "not-declared", "chain-broken").when(F.col("f.endpoint_type") == "caller", "caller").when(F.col("f").isNotNull(), "artifact")
        .when(F.col("resolution") == "candidates", "candidates").when(F.col("resolution") == "declared-candidates", "declared-candidates").when(F.col("m").isNotNull(), "called-program").otherwise("dead-end")
    )
    none = F.array().cast("array<string>")
    out = out.withColumn("outcome", outcome).withColumn("provisional", F.col("resolution") == "not-declared")
    return out.select(
        *key, "outcome", F.coalesce("f.event", "m.event").alias("named_by"), F.coalesce("f.item", "m.item").alias("through"), F.coalesce("f.steps", "m.steps").alias("steps"), "candidates",
        F.when(F.col("outcome") == "dead-end", F.coalesce("ends", none)).otherwise(none).alias("dead_ends"), "provisional",
        F.when(F.col("provisional"), F.coalesce("lost", none)).otherwise(none).alias("missing_members"), F.coalesce("var", F.lit(False)).alias("variable"),
    )


def call_sources(facts: DataFrame) -> DataFrame:
    """One row for each source of each dynamic call's target: where the name comes from, by which route, and how to list all targets.

    kind is the artifact's, caller, or called-program (`maybe`: that program can write the item, not that it does). For a table, `run` is the statement that lists the
    column's values; for a file, the field's record, start and length, or why they are withheld.
    """
    seen = settled(_routes(facts, _operands(facts)))
    sure = _fills(facts).withColumn("maybe", F.lit(False))
    soft = _handed_on(facts).withColumns({"maybe": F.lit(True), "endpoint_type": F.lit("called-program")})
    hits = seen.join(sure.unionByName(soft, allowMissingColumns=True), ["program", "item"])
    first = F.min(F.struct("steps", "line", "item", "stmt_id", "verb", "endpoint_type", "endpoint", "route")).alias("r")
    hits = hits.groupBy("program", "operand", "event", "maybe").agg(first).select("program", "operand", "event", "maybe", "r.*")
    columns = fact_table(facts, "sql_column").where("status = 'mapped'").groupBy("program", "stmt_id", F.col("host_var").alias("item")).agg(F.min(F.struct("table", "column")).alias("c"))
    layout = record_layout(facts).groupBy("program", F.col("name").alias("item")).agg(F.min(F.struct("record_name", "start", "length", "record_size", "reason")).alias("l"))
    spec = F.create_map(*(x for k, v in ARTIFACTS.items() for x in (F.lit(k), F.lit(v[0]))))
    out = hits.join(columns, ["program", "stmt_id", "item"], "left").join(layout, ["program", "item"], "left")
    is_file = (F.col("endpoint_type") == "file") & F.col("c").isNull()
    return out.select(
        "program", "operand", F.coalesce(F.try_element_at(spec, F.col("endpoint_type")), "endpoint_type").alias("kind"), F.col("endpoint").alias("artifact"), "event", "maybe", "verb", "line", F.col("item").alias("field"), "steps",
        F.transform("route", lambda x: F.concat(x.source, F.lit(" -> "), x.target, F.lit(" @"), x.line)).alias("route"),
        F.concat(F.lit("SELECT DISTINCT "), "c.column", F.lit(" FROM "), "c.table").alias("run"),
        F.when(is_file, F.col("l.record_name")).alias("record"), F.when(is_file, F.col("l.start")).alias("start"), F.when(is_file & F.col("l.start").isNotNull(), F.col("l.length")).alias("length"),
        F.when(is_file, F.coalesce("l.reason", F.when(F.col("l").isNull(), F.lit("withheld: not in a record")))).alias("withheld"),
    )


def candidate_requests(facts: DataFrame) -> DataFrame:
    """Programs that a dynamic call may name, by its literals or by declared values: (program, kind, name)."""
    c = dynamic_calls(facts).select("program", F.explode("candidates").alias("name"))
    return c.select("program", F.lit("program").alias("kind"), F.upper(F.trim("name")).alias("name")).where("name <> ''").distinct()


def fetch_plan(facts: DataFrame, have: DataFrame | None = None, with_candidates: bool = False) -> DataFrame:
    """What to ask an estate for: name, kind, types in order, status (planned, in-hand, dynamic, supplied, excluded) for every artifact.

    with_candidates also asks for the programs that dynamic calls may name.
    """
    a = artifacts(facts)
    if with_candidates:
        a = a.unionByName(candidate_requests(facts).withColumn("dynamic", F.lit(False)), allowMissingColumns=True).withColumn("resolved_by", F.coalesce("resolved_by", F.lit("")))
    types = F.create_map(*(x for k, v in MEMBER_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    a = a.withColumn("types", F.try_element_at(types, F.col("kind")))
    name = F.when((F.col("kind") == "file") & F.col("assign").isNotNull(), F.col("assign")).otherwise(F.col("name"))
    a = a.withColumn("ask", name)
    if have is not None:
        a = a.join(have.select(F.col("name").alias("ask"), F.lit(True).alias("held")).distinct(), "ask", "left")
    else:
        a = a.withColumn("held", F.lit(None).cast("boolean"))
    status = F.when(F.col("excluded").isNotNull(), "excluded").when(F.col("types").isNull(), "not-retrievable").when(F.col("dynamic"), "dynamic").when(F.col("resolved_by").startswith("ibm"), "supplied").when(F.col("held"), "in-hand").otherwise("planned")
    return a.select("program", "kind", F.col("ask").alias("name"), "types", status.alias("status"))


def business_rules(facts: DataFrame) -> DataFrame:
    """Outputs with the business conditions that govern them; loop and end-of-file plumbing left out. Programs with handler regions give one row that says so."""
    parallel = fact_table(facts, "program").where("parallel").select("program").distinct()
    rows = lineage(facts).where("direction = 'output'").join(parallel, "program", "left_anti")
    rule = F.sort_array(F.transform(F.filter("conditions", lambda c: c.kind == "business"), lambda c: F.when(c.negated, F.concat(F.lit("NOT ("), c.guard, F.lit(")"))).otherwise(c.guard)))
    out = rows.groupBy("program", "event", "line", "paragraph", rule.alias("rule"), "conditions_partial").agg(F.sort_array(F.collect_set("field")).alias("fields"))
    empty = parallel.select("program", F.lit("<handlers run beside the main flow: not distilled>").alias("event"))
    return out.unionByName(empty, allowMissingColumns=True)


def business_states(facts: DataFrame) -> DataFrame:
    """Paragraphs by role: perimeter (crosses the boundary), decision (holds a business condition), technical (neither)."""
    p = fact_table(facts, "paragraph").select("program", F.col("name").alias("paragraph"))
    decides = fact_table(facts, "statement").where("kind in ('IF', 'EVALUATE')").select("program", "paragraph").distinct().withColumn("d", F.lit(True))
    out = p.join(perimeter(facts), ["program", "paragraph"], "left").join(decides, ["program", "paragraph"], "left")
    return out.select("program", "paragraph", F.when(F.col("perimeter").isNotNull(), F.col("perimeter")).when(F.col("d"), "decision").otherwise("technical").alias("role"))


def business_steps(facts: DataFrame) -> DataFrame:
    """Lines between which a program goes from one boundary crossing to the next (0: its start, null: its end), and under which business conditions."""
    return fact_table(facts, "business_step").drop("ordinal")


def perform_cycles(facts: DataFrame) -> DataFrame:
    """Paragraphs that can perform themselves, directly or through others: those in a cycle of the PERFORMs."""
    st = fact_table(facts, "state").select("program", "state", "paragraph")
    e = fact_table(facts, "edge").where("kind = 'call'").join(st.select("program", F.col("state").alias("source"), F.col("paragraph").alias("a")), ["program", "source"])
    e = e.join(st.select("program", F.col("state").alias("target"), F.col("paragraph").alias("b")), ["program", "target"])
    return graph.cycles(e.select("program", "a", "b"), ["program"]).select("program", F.col("node").alias("paragraph"))


def callers(facts: DataFrame) -> DataFrame:
    """Calls between programs of the estate, arguments matched to the callee's parameters by place where both counts agree."""
    c = calls(facts).where("callee is not null").select(F.col("program").alias("caller"), F.col("callee").alias("program"), "line", "arguments")
    p = fact_table(facts, "program").select("program", "using")
    pairs = c.join(p, "program").where(F.size("arguments") == F.size("using"))
    return pairs.select("caller", F.col("program").alias("callee"), "line", F.posexplode(F.arrays_zip("arguments", "using")).alias("place", "z")).select("caller", "callee", "line", "place", F.col("z.arguments").alias("argument"), F.col("z.using").alias("parameter"))


def graph_edges(facts: DataFrame) -> DataFrame:
    """Edges of the estate graph with names that hold across programs: calls, tables, copybooks, bound files."""
    a = artifacts(facts).where("excluded is null and not dynamic")
    name = F.when(F.col("kind") == "file", F.concat(F.lit("dd:"), "assign")).otherwise(F.concat("kind", F.lit(":"), "name"))
    return a.where("kind in ('db2-table', 'program', 'copybook', 'cics-transaction') or (kind = 'file' and assign is not null)").select(F.concat(F.lit("program:"), "program").alias("a"), name.alias("b"), F.col("io").alias("edge")).distinct()


def graph_components(facts: DataFrame) -> DataFrame:
    """(node, component): least name reachable over the estate graph."""
    return graph.components(graph_edges(facts).select("a", "b"))


def status_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").count()


def member_counts(facts: DataFrame) -> DataFrame:
    """What each copied member gives a program: its data items and its paragraphs."""
    items = fact_table(facts, "data_item").where("member is not null").groupBy("program", "member").agg(F.count(F.lit(1)).alias("items"))
    code = fact_table(facts, "statement").where("member is not null").groupBy("program", "member").agg(F.countDistinct("paragraph").alias("paragraphs"), F.count(F.lit(1)).alias("statements"))
    used = fact_table(facts, "copybook").groupBy("program", "member").agg(F.max("status").alias("status"), F.max("replacing").alias("replacing"), F.count(F.lit(1)).alias("copies"))
    out = used.join(items, ["program", "member"], "left").join(code, ["program", "member"], "left")
    return out.select("program", "member", "status", "replacing", "copies", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "paragraphs", "statements")))


def hierarchy(facts: DataFrame) -> DataFrame:
    """The state graph as a tree: section, paragraph, its first state, and its states in order; `compound` if a paragraph has several."""
    section = fact_table(facts, "paragraph").select("program", F.col("name").alias("paragraph"), "section", F.col("line").alias("starts_at"))
    states = fact_table(facts, "state").where("paragraph is not null").groupBy("program", "paragraph").agg(
        F.min("state").alias("initial"), F.sort_array(F.collect_list(F.struct("state", "kind", "line"))).alias("states"), (F.count(F.lit(1)) > 1).alias("compound")
    )
    return section.join(states, ["program", "paragraph"]).select("program", "section", "paragraph", "starts_at", "initial", "compound", "states")


#: Relations as words in names, longest first.
RELATION_WORDS = ((">=", "ge"), ("<=", "le"), ("<>", "ne"), ("=", "eq"), (">", "gt"), ("<", "lt"))
LITERALS = r"('[^']*'|\"[^\"]*\"|[^'\"]+|['\"])"


def slug(text: Column, most: int = 60) -> Column:
    """A name made of a statement or condition: its relations, as words, and its words, quotes left out, joined by _."""
    named = F.create_map(*(F.lit(x) for pair in RELATION_WORDS for x in pair))
    parts = F.regexp_extract_all(text, F.lit("(" + "|".join(sign for sign, _ in RELATION_WORDS) + "|[0-9A-Za-z'\"-]+)"), F.lit(1))
    words = F.transform(parts, lambda x: F.coalesce(named[x], F.translate(x, "'\"", "")))
    name = F.substring(F.array_join(F.filter(words, lambda x: x != ""), "_"), 1, most)
    return F.when(name == "", "x").otherwise(F.rtrim(name, F.lit("_")))


def signature(text: Column) -> Column:
    """What makes two texts the same: case does not matter outside literals."""
    parts = F.regexp_extract_all(F.trim(text), F.lit(LITERALS), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^(?s)['\"].*['\"]$"), x).otherwise(F.upper(x))), "")


def names(facts: DataFrame) -> DataFrame:
    """A name for each distinct statement and condition of a program, unique in it: the slug, and _2, _3 ... by first use where slugs are equal."""
    acts = fact_table(facts, "statement").select("program", F.lit("action").alias("kind"), "text", "line", F.col("stmt_id").alias("at"))
    guards = fact_table(facts, "condition").select("program", F.lit("guard").alias("kind"), "text", "line", F.col("stmt_id").alias("at"))
    rows = acts.unionByName(guards).groupBy("program", "kind", signature(F.col("text")).alias("signature")).agg(F.min(F.struct("at", "line", "text")).alias("f"))
    rows = rows.select("program", "kind", "signature", "f.*").withColumn("base", slug(F.col("text")))
    rows = settled(rows.withColumn("name", F.col("base")))
    again = Window.partitionBy("program", "name").orderBy("at", "kind", "signature")
    while not rows.groupBy("program", "name").count().where("count > 1").isEmpty():  # a suffix may make another name
        n = F.row_number().over(again)
        rows = settled(rows.withColumn("name", F.when(n == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), n))))
    return rows.select("program", "kind", "name", "text", "line")


def corpus_graph(facts: DataFrame, dd: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, kind), edges (a, b, edge)) of a whole estate; names hold across programs only where that can be proven, else they carry the program.

    Kinds: program, field, copybook, endpoint, column, event, dataset (of dd, where given).
    """
    of = lambda kind, *parts: F.concat(F.lit(f"{kind}:"), *parts)
    program, slash = of("program", F.col("program")), F.lit("/")
    edges = graph_edges(facts).select("a", "b", F.coalesce("edge", F.lit("uses")).alias("edge"))
    items = fact_table(facts, "data_item").where("name <> 'FILLER'")
    one = of("field", "program", slash, "name")
    edges = edges.unionByName(items.select(program.alias("a"), one.alias("b"), F.lit("declares").alias("edge")))
    edges = edges.unionByName(items.where("member is not null").select(of("copybook", "member").alias("a"), one.alias("b"), F.lit("declares").alias("edge")))
    sql = fact_table(facts, "sql_column").where("column is not null")
    column = of("column", "table", F.lit("."), "column")
    edges = edges.unionByName(sql.select(of("db2-table", "table").alias("a"), column.alias("b"), F.lit("has").alias("edge")))
    edges = edges.unionByName(sql.where("host_var is not null").select(column.alias("a"), of("field", "program", slash, "host_var").alias("b"), F.lit("meets").alias("edge")))
    ev = fact_table(facts, "event")
    event, end = of("event", "program", slash, "event"), of("endpoint", "program", slash, "endpoint_type", F.lit(":"), "endpoint")
    edges = edges.unionByName(ev.select(program.alias("a"), event.alias("b"), F.lit("raises").alias("edge")))
    edges = edges.unionByName(ev.select(event.alias("a"), end.alias("b"), F.lit("at").alias("edge")))
    edges = edges.unionByName(ev.select("program", event.alias("a"), F.explode("fields").alias("f")).select("a", of("field", "program", slash, "f").alias("b"), F.lit("carries").alias("edge")))
    if dd is not None:
        base = F.regexp_replace("dataset", r"\([+-]?\d+\)$", "")
        edges = edges.unionByName(dd.select(of("dd", F.col("ddname")).alias("a"), of("dataset", base).alias("b"), F.col("direction").alias("edge")))
    edges = settled(edges.distinct())
    prefix = F.substring_index("node", ":", 1)
    kind = F.when(prefix.isin("program", "field", "copybook", "column", "event", "dataset"), prefix).otherwise("endpoint")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("kind", kind)
    return nodes, edges
