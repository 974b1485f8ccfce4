"""Conditions, origins and cycles of a whole estate from its flow facts: fixpoints over tables, with no Python worker after the parse.

The parse gives each program's graph over (instruction, return mark). Everything else is here: which guards hold where, which definitions of a field
reach where it is used, and from which events the values come, inside programs and between those that call one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import graph
from ..operators.settle import settled
from ..sources.estate import fact_table
from .views import calls

AFTER = ("WRITE", "REWRITE", "RELEASE")  # what these put out is what the record holds after their own FROM


def _flow(facts: DataFrame) -> DataFrame:
    f = fact_table(facts, "flow")
    return f.select("program", F.col("source").alias("a"), F.col("target").alias("b"), "kind", "guard", "negated", "callee").distinct()


def _places(facts: DataFrame) -> DataFrame:
    """(program, stmt_id, node): where statements run; -1 stands for the entry and -2 for every end of the program."""
    n = settled(fact_table(facts, "flow_node").select("program", "node", "stmt_id", "kind"))
    own = n.where("stmt_id is not null").select("program", "stmt_id", "node")
    first = n.where("node = 0").select("program", F.lit(-1).alias("stmt_id"), "node")
    return own.unionByName(first).unionByName(n.where("kind = 'stop'").select("program", F.lit(-2).alias("stmt_id"), "node"))


def conditions(facts: DataFrame) -> DataFrame:
    """(program, stmt_id, guard, negated, kind, holds, may): guards that hold on every way to a statement (holds) or on some way only."""
    state = graph.must_and_may(_flow(facts), ["program"])
    at = _places(facts).join(state, ["program", "node"]).groupBy("program", "stmt_id", "word").agg(F.bit_and("must").alias("must"), F.bit_or("may").alias("may"))
    g = fact_table(facts, "guard").withColumn("word", F.expr(f"div(guard, {graph.GUARDS})")).withColumn("sense", F.explode(F.array(F.lit(0), F.lit(1))))
    bit = (F.col("guard") % graph.GUARDS) * 2 + F.col("sense")
    both = at.join(g, ["program", "word"]).withColumns({"holds": graph.is_set(F.col("must"), bit), "may": graph.is_set(F.col("may"), bit)})
    return both.where("may or holds").select("program", "stmt_id", F.col("text").alias("guard"), ((F.col("sense") == 1) != F.col("flip")).alias("negated"), "kind", "holds", "may")


def event_conditions(facts: DataFrame) -> DataFrame:
    """Boundary crossings with the conditions they are under; `partial`: some ways to it are under a business condition, others are not."""
    c = settled(conditions(facts))
    senses = c.groupBy("program", "stmt_id", "guard").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n"), F.max("holds").alias("holds"), F.max(F.struct("holds", "negated")).alias("one"))
    text = F.when(F.col("one.negated"), F.concat(F.lit("NOT ("), "guard", F.lit(")"))).otherwise(F.col("guard"))
    some = senses.groupBy("program", "stmt_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("holds"), text))).alias("conditions"), F.max((F.col("kind") == "business") & (F.col("n") == 1) & ~F.col("holds")).alias("partial")
    )
    e = fact_table(facts, "event").select("program", "event", "direction", "stmt_id", "line").distinct()
    out = e.join(some, ["program", "stmt_id"], "left")
    return out.select("program", "event", "direction", "stmt_id", "line", F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"), F.coalesce("partial", F.lit(False)).alias("partial"))


def _passable(flow: DataFrame, crossings: DataFrame, ends: DataFrame) -> DataFrame:
    """(program, callee): what can be performed from its start to its end without a crossing. What is performed inside it has to be known first: rounds by nesting."""
    entries = settled(flow.where("kind = 'call'").select("program", "callee", F.col("b").alias("node")).distinct())
    inside = flow.where("kind <> 'call'").join(crossings.select("program", F.col("node").alias("a")), ["program", "a"], "left_anti")
    inside = settled(inside.withColumns({"guard": F.lit(None).cast("int"), "negated": F.lit(False)}))
    found, n = entries.select("program", "callee").where("false"), -1
    while True:
        known = settled(found)
        if known.count() == n:
            return known
        n = known.count()
        edges = inside.where("kind <> 'after'").unionByName(inside.where("kind = 'after'").join(known, ["program", "callee"], "left_semi"))
        reached = graph.must_and_may(edges.select("program", "a", "b", "guard", "negated"), ["program"], entries.select("program", "node"))
        reached = reached.select("program", "origin", "node").unionByName(entries.select("program", F.col("node").alias("origin"), "node"))
        at_end = reached.join(ends, ["program", "node"]).select("program", "origin", "callee")
        found = at_end.join(entries.withColumnRenamed("node", "origin"), ["program", "origin", "callee"], "left_semi").select("program", "callee").distinct()


def business_steps(facts: DataFrame) -> DataFrame:
    """From which boundary crossing a program goes to which, under which business conditions: (program, source, target, rule, partial).

    source and target are lines: 0 for the start, null for the end. The ways between two crossings are contracted: a step's rule is what holds on all of them, so branches that
    meet again cancel, and nothing is listed path by path. A way that begins inside what is performed goes on behind every PERFORM of it; conditions met
    inside what is performed do not outlast it.
    """
    flow = settled(_flow(facts))
    nodes = settled(fact_table(facts, "flow_node").select("program", "node", "state", "stmt_id", "kind", F.col("ends").alias("callee"), "line"))
    outside = fact_table(facts, "event").where("endpoint_type not in ('response', 'system') and stmt_id >= 0").select("program", "stmt_id").distinct()
    crossings = settled(nodes.where("kind in ('do', 'read')").join(outside, ["program", "stmt_id"], "left_semi").select("program", "node"))
    ends = nodes.where("callee is not null").select("program", "node", "callee")
    business = fact_table(facts, "guard").where("kind = 'business'").select("program", "guard", F.lit(True).alias("counts"))
    flow = settled(flow.join(business, ["program", "guard"], "left").withColumn("guard", F.when(F.col("counts"), F.col("guard"))).drop("counts"))
    passed = _passable(flow, crossings, ends)
    stops_at = crossings.select("program", F.col("node").alias("a"), F.lit(True).alias("crosses"))
    marked = settled(flow.join(stops_at, ["program", "a"], "left").withColumn("crosses", F.coalesce("crosses", F.lit(False))))
    # two copies of each node: 2 n, and 2 n + 1 once the way has entered something by a PERFORM; -(n + 1) is a crossing as a start
    both = marked.where("not crosses").withColumn("deep", F.explode(F.array(F.lit(0), F.lit(1))))
    inner = both.where("kind not in ('call', 'after')").unionByName(both.where("kind = 'after'").join(passed, ["program", "callee"], "left_semi").select(both.columns))
    walk = inner.select("program", (2 * F.col("a") + F.col("deep")).alias("a"), (2 * F.col("b") + F.col("deep")).alias("b"), "guard", "negated")
    enter = both.where("kind = 'call'").select("program", (2 * F.col("a") + F.col("deep")).alias("a"), (2 * F.col("b") + 1).alias("b"), "guard", "negated")
    leave = ends.join(marked.where("kind = 'after'").select("program", "callee", "b").distinct(), ["program", "callee"])
    leave = leave.select("program", (2 * F.col("node")).alias("a"), (2 * F.col("b")).alias("b"), F.lit(None).cast("int").alias("guard"), F.lit(False).alias("negated"))
    begin = marked.where("crosses").select("program", (-F.col("a") - 1).alias("a"), (2 * F.col("b")).alias("b"), "guard", "negated")
    walk = settled(walk.unionByName(enter).unionByName(leave).unionByName(begin).distinct())
    zero = nodes.where("node = 0").select("program", "node").join(crossings, ["program", "node"], "left_anti")
    starts = zero.unionByName(crossings.select("program", (-F.col("node") - 1).alias("node")))
    state = graph.must_and_may(walk, ["program"], starts).where("node >= 0").withColumn("node", F.shiftright("node", 1))
    targets = crossings.unionByName(nodes.where("kind = 'stop'").select("program", "node"))
    state = state.join(targets, ["program", "node"], "left_semi").withColumn("from", F.when(F.col("origin") < 0, -F.col("origin") - 1))
    source = nodes.select("program", F.col("node").alias("from"), F.col("state").alias("source_state"), F.col("line").alias("source"))
    target = nodes.select("program", "node", F.col("state").alias("target_state"), F.col("line").alias("target"))
    key = ["program", "source_state", "target_state"]
    told = state.join(source, ["program", "from"], "left").join(target, ["program", "node"])
    told = told.groupBy(*key, "word").agg(F.bit_and("must").alias("must"), F.bit_or("may").alias("may"), F.min(F.coalesce("source", F.lit(0))).alias("source"), F.min("target").alias("target"))
    told = settled(told)
    g = fact_table(facts, "guard").where("kind = 'business'").withColumn("word", F.expr(f"div(guard, {graph.GUARDS})"))
    bit = (F.col("guard") % graph.GUARDS) * 2
    sense = {"yes": graph.is_set(F.col("must"), bit), "no": graph.is_set(F.col("must"), bit + 1), "some": graph.is_set(F.col("may"), bit) != graph.is_set(F.col("may"), bit + 1)}
    text = F.when(F.col("no") != F.col("flip"), F.concat(F.lit("NOT ("), "text", F.lit(")"))).otherwise(F.col("text"))
    rules = told.join(g, ["program", "word"]).withColumns(sense).groupBy(*(F.col(k).alias(f"{k}__r") for k in key)).agg(
        F.sort_array(F.collect_list(F.when(F.col("yes") | F.col("no"), text))).alias("rule"), F.max(F.col("some") & ~F.col("yes") & ~F.col("no")).alias("partial")
    )
    steps = told.where("word = 0").select(*key, "source", "target")
    first = nodes.where("node = 0").join(crossings, ["program", "node"], "left_semi").select("program", F.lit(0).alias("source"), F.col("line").alias("target"))
    on = (F.col("program") == F.col("program__r")) & F.col("source_state").eqNullSafe(F.col("source_state__r")) & (F.col("target_state") == F.col("target_state__r"))
    none = F.array().cast("array<string>")
    out = steps.join(rules, on, "left").select("program", "source", "target", F.coalesce("rule", none).alias("rule"), F.coalesce("partial", F.lit(False)).alias("partial"))
    return out.unionByName(first.select("program", "source", "target", none.alias("rule"), F.lit(False).alias("partial")))


def _runs(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Straight runs of nodes: (program, node, head, hop), and the edges between runs (program, a head, b head, kind, callee)."""
    f = settled(_flow(facts).select("program", "a", "b", "kind", "callee").distinct())
    nodes = fact_table(facts, "flow_node").select("program", "node").distinct()
    alone_in = f.groupBy("program", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 1 and b <> 0").select("program", "b")
    alone_out = f.groupBy("program", "a").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("program", "a")
    inside = f.where("kind not in ('call', 'after')").join(alone_in, ["program", "b"], "left_semi").join(alone_out, ["program", "a"], "left_semi")
    up = settled(inside.select("program", F.col("b").alias("node"), F.col("a").alias("head"), F.lit(1).cast("long").alias("hop")))
    while True:
        above = up.select("program", F.col("node").alias("head"), F.col("head").alias("next"), F.col("hop").alias("more"))
        step = settled(up.join(above, ["program", "head"], "left").select("program", "node", F.coalesce("next", "head").alias("head"), (F.col("hop") + F.coalesce("more", F.lit(0))).alias("hop"), F.col("next").isNotNull().alias("on")))
        up = step.drop("on")
        if step.where("on").isEmpty():
            break
    runs = settled(nodes.join(up, ["program", "node"], "left").select("program", "node", F.coalesce("head", "node").alias("head"), F.coalesce("hop", F.lit(0)).alias("hop")))
    heads = runs.select("program", F.col("node").alias("a"), "head")
    edges = f.join(up.select("program", F.col("node").alias("b")), ["program", "b"], "left_anti").join(heads, ["program", "a"])
    return runs, settled(edges.select("program", F.col("head").alias("a"), "b", "kind", "callee").distinct())


def _definitions(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Effects as definitions: (program, head, at, def, field, strong, kind, event, reads, line); at orders those of a run, def names one in its program."""
    e = fact_table(facts, "effect").join(runs, ["program", "node"])
    at = F.struct("hop", "place").alias("at")
    return settled(e.select("program", "head", at, F.concat_ws(":", "node", "place", "field").alias("def"), "field", (~F.col("weak")).alias("strong"), "kind", "event", "reads", "line"))


def reaching(facts: DataFrame, runs: DataFrame, edges: DataFrame, defs: DataFrame) -> DataFrame:
    """(program, head, field, def): definitions that reach the start of a run, with PERFORMs returning only to where they were called.

    A definition made inside what is performed goes on behind every PERFORM of it; one from before goes on behind a PERFORM only if it can pass
    what is performed (some definition of the field from outside reaches its end), and only behind its own.
    """
    last = defs.where("strong").groupBy("program", "head", "field").agg(F.max("at").alias("cut"))
    kills = settled(last.select("program", "head", "field"))
    made = defs.join(last, ["program", "head", "field"], "left").where("cut is null or at >= cut").select("program", "head", "field", "def")
    ends = fact_table(facts, "flow_node").where("ends is not null").select("program", "node", "ends").join(runs, ["program", "node"])
    ends = settled(ends.select("program", "head", F.col("ends").alias("callee")).distinct())
    flows = edges.where("kind <> 'after'").select("program", F.col("a").alias("head"), F.col("b").alias("to"), (F.col("kind") == "call").alias("enters")).distinct()
    behind = edges.where("kind = 'after'").select("program", F.col("a").alias("head"), F.col("b").alias("to"), "callee").distinct()

    def on(leaving: DataFrame) -> DataFrame:
        """leaving (program, head, field, def, inside): what leaves a run, at the next runs."""
        near = leaving.join(flows, ["program", "head"]).select("program", F.col("to").alias("head"), "field", "def", (F.col("inside") & ~F.col("enters")).alias("inside"))
        back = leaving.where("inside").join(ends, ["program", "head"]).select("program", "callee", "field", "def").distinct()
        back = back.join(behind, ["program", "callee"]).select("program", F.col("to").alias("head"), "field", "def", F.lit(True).alias("inside"))
        return near.unionByName(back)

    key = ["program", "head", "field", "def", "inside"]
    front = settled(on(made.withColumn("inside", F.lit(True))).distinct())
    known = front
    while not front.isEmpty():
        through = front.join(kills, ["program", "head", "field"], "left_anti")
        passed = known.where("not inside").join(kills, ["program", "head", "field"], "left_anti").join(ends, ["program", "head"]).select("program", "callee", "field").distinct()
        calls = known.unionByName(made.withColumn("inside", F.lit(True))).join(behind, ["program", "head"]).join(kills_of(known, kills, made), ["program", "head", "field", "def", "inside"], "left_anti")
        past = calls.join(passed, ["program", "callee", "field"], "left_semi").select("program", F.col("to").alias("head"), "field", "def", "inside")
        new = on(through).unionByName(past).distinct()
        front = settled(new.join(known, key, "left_anti"))
        known = settled(known.unionByName(front))
    return known.select("program", "head", "field", "def").distinct()


def kills_of(known: DataFrame, kills: DataFrame, made: DataFrame) -> DataFrame:
    """Rows of known that a run overwrites before its end."""
    return known.join(kills, ["program", "head", "field"], "left_semi").join(made, ["program", "head", "field", "def"], "left_anti")


def _used(uses: DataFrame, defs: DataFrame, reach: DataFrame) -> DataFrame:
    """uses (program, head, at, use, field): (program, use, def) of the definitions whose value a use can see."""
    d = defs.select("program", "head", "field", "def", F.col("at").alias("made"), "strong")
    local = uses.join(d, ["program", "head", "field"]).where("made < at")
    w = Window.partitionBy("program", "use", "field", "head", "at")
    local = local.withColumn("cut", F.max(F.when(F.col("strong"), F.col("made"))).over(w)).where("cut is null or made >= cut")
    covered = local.where("cut is not null").select("program", "use", "field", "head", "at").distinct()
    far = uses.join(covered, ["program", "use", "field", "head", "at"], "left_anti").join(reach, ["program", "head", "field"])
    return local.select("program", "use", "def").unionByName(far.select("program", "use", "def")).distinct()


def origins(facts: DataFrame) -> DataFrame:
    """Where the fields of every output come from: (program, event, line, field, origin_program, origin, maybe).

    An origin is an input event. A field passed to another program has that program's return as a possible origin (maybe); if the program is in the estate, the
    values its parameter can have at its ends are followed too, and a parameter's values come from all callers' arguments at that place.
    """
    runs, edges = _runs(facts)
    defs = _definitions(facts, runs)
    reach = settled(reaching(facts, runs, edges, defs))
    after_all = F.struct(F.col("hop"), F.lit(1 << 20).alias("place"))
    reads = defs.select("program", "head", "at", F.col("def").alias("use"), F.explode("reads").alias("field"))
    outs = fact_table(facts, "event").where("direction = 'output'").select("program", "event", "verb", "line", "stmt_id", F.explode("fields").alias("field")).distinct()
    outs = outs.join(_places(facts), ["program", "stmt_id"]).join(runs, ["program", "node"])
    name = F.concat_ws("|", F.lit("out"), "event", "line", "field")
    at = F.when(F.col("verb").isin(*AFTER), after_all).otherwise(F.struct("hop", F.lit(-1 << 20).alias("place")))
    puts = outs.select("program", "head", at.alias("at"), name.alias("use"), "field")
    # arguments at calls and parameters at ends
    own = fact_table(facts, "call").where("literal").select("program", F.col("target").alias("callee"), "stmt_id", "using")
    takes = fact_table(facts, "program").select(F.col("program").alias("callee"), F.col("using").alias("takes"))
    pairs = own.join(takes, "callee").where(F.size("using") == F.size("takes"))
    pairs = pairs.select("program", "callee", "stmt_id", F.explode(F.arrays_zip("using", "takes")).alias("z")).select("program", "callee", "stmt_id", F.col("z.using").alias("field"), F.col("z.takes").alias("takes"))
    pairs = settled(pairs.join(_places(facts), ["program", "stmt_id"]).join(runs, ["program", "node"]))
    given = pairs.select("program", "head", F.struct("hop", F.lit(-1 << 20).alias("place")).alias("at"), F.concat_ws("|", F.lit("arg"), "callee", "takes").alias("use"), "field").distinct()
    ends = fact_table(facts, "flow_node").where("kind = 'stop'").join(runs, ["program", "node"]).select("program", "head", "hop")
    left = ends.join(pairs.select(F.col("callee").alias("program"), F.col("takes").alias("field")).distinct(), "program")
    left = left.select("program", "head", after_all.alias("at"), F.concat_ws("|", F.lit("end"), "field").alias("use"), "field")
    uses = settled(reads.unionByName(puts).unionByName(given).unionByName(left))
    seen = settled(_used(uses, defs, reach))
    # value flow: use <- def, within a program and between programs
    links = seen.select(F.col("program").alias("to_program"), F.col("use").alias("to"), F.col("program").alias("from_program"), F.col("def").alias("from"))
    entry = defs.where("kind = 'input' and at.hop = 0 and at.place = -1").select(F.col("program").alias("to_program"), F.col("def").alias("to"), F.col("field").alias("takes"))
    down = pairs.select("program", "callee", "takes").distinct().join(entry.withColumnRenamed("to_program", "callee"), ["callee", "takes"])
    down = down.select(F.col("callee").alias("to_program"), "to", F.col("program").alias("from_program"), F.concat_ws("|", F.lit("arg"), "callee", "takes").alias("from"))
    back = pairs.select("program", "node", "callee", "field", "takes").distinct().join(fact_table(facts, "effect").where("kind = 'call'").select("program", "node", "place", "field"), ["program", "node", "field"])
    back = back.select(F.col("program").alias("to_program"), F.concat_ws(":", "node", "place", "field").alias("to"), F.col("callee").alias("from_program"), F.concat_ws("|", F.lit("end"), "takes").alias("from"))
    links = settled(links.unionByName(down).unionByName(back).distinct())
    front = settled(defs.where("event is not null").select("program", F.col("def").alias("at"), F.col("program").alias("origin_program"), F.col("event").alias("origin"), (F.col("kind") == "call").alias("maybe")).distinct())
    known = front
    while not front.isEmpty():
        come = links.join(front.withColumnRenamed("program", "from_program").withColumnRenamed("at", "from"), ["from_program", "from"])
        come = come.select(F.col("to_program").alias("program"), F.col("to").alias("at"), "origin_program", "origin", "maybe").distinct()
        front = settled(come.join(known, known.columns, "left_anti"))
        known = settled(known.unionByName(front))
    part: Column = F.split("at", r"\|")
    found = known.where(F.col("at").startswith("out|"))
    return found.select("program", part[1].alias("event"), part[2].cast("int").alias("line"), part[3].alias("field"), "origin_program", "origin", "maybe")


def call_cycles(facts: DataFrame) -> DataFrame:
    """Programs that can call themselves, directly or through others, by calls of proven names: (node, component)."""
    e = calls(facts).where("callee is not null").select(F.col("program").alias("a"), F.col("callee").alias("b"), F.lit(0).alias("estate"))
    return graph.cycles(e, ["estate"]).select("node", "component")
