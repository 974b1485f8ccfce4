"""Graph operators on tables of edges, many graphs at once: components, cycles, and forward analyses to a fixpoint. Columns only, no Python workers.

Every loop goes on until a round finds nothing new; rows stay in proportion to nodes and edges. `by` names the columns that tell graphs apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .settle import settled

#: Guards in one 64-bit word: two bits each.
GUARDS = 31


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) in any direction -> (node, component): the least node reachable, for every node with an edge. By alternating stars."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    links = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settled(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        links = settled(large.join(least, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return nodes.join(links.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
        mark = now


def cycles(edges: DataFrame, by: list[str]) -> DataFrame:
    """edges (*by, a, b) -> (*by, node, component): nodes that can reach themselves, with the least node of their strong component.

    Nodes with one way in and one way out are taken out first, so that long chains and rings cost rounds only in the logarithm of their length. Of the rest, nodes without a way
    in or out are trimmed; each node then takes the greatest node that reaches it as its colour; what reaches a colour's node inside its colour is a strong
    component, and the next round goes on with the other nodes.
    """
    edges = settled(edges.select(*by, "a", "b").distinct())
    short, inner, found = _taken_out(edges.where("a <> b"), by)
    loops = edges.where("a = b").unionByName(short.where("a = b")).select(*by, F.col("a").alias("node")).distinct()
    rest = short.where("a <> b")
    while True:
        rest = _trimmed(rest, by)
        if rest.isEmpty():
            break
        colour = _coloured(rest, by)
        same = rest.join(colour.select(*by, F.col("node").alias("a"), F.col("colour").alias("ca")), [*by, "a"]).join(
            colour.select(*by, F.col("node").alias("b"), F.col("colour").alias("cb")), [*by, "b"]
        )
        same = settled(same.where("ca = cb").select(*by, "a", "b"))
        inside = settled(colour.where("node = colour").select(*by, "node", F.col("colour").alias("root")))
        front = inside
        while True:  # back from each colour's node
            back = same.join(front.select(*by, F.col("node").alias("b"), "root"), [*by, "b"]).select(*by, F.col("a").alias("node"), "root").distinct()
            front = settled(back.join(inside.select(*by, "node"), [*by, "node"], "left_anti"))
            if front.isEmpty():
                break
            inside = settled(inside.unionByName(front))
        several = inside.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by, "root")
        found = found.unionByName(inside.join(several, [*by, "root"]).select(*by, "node", "root"))
        gone = inside.select(*by, "node")
        rest = rest.join(gone.withColumnRenamed("node", "a"), [*by, "a"], "left_anti").join(gone.withColumnRenamed("node", "b"), [*by, "b"], "left_anti")
    found = settled(found)
    alone = loops.join(found.select(*by, "node"), [*by, "node"], "left_anti")
    found = settled(found.unionByName(alone.withColumn("root", F.col("node"))))
    # what lies on a way between two nodes of one component belongs to it
    heads = found.select(*by, F.col("node").alias("up"), "root")
    tails = found.select(*by, F.col("node").alias("down"), F.col("root").alias("other"))
    between = inner.join(heads, [*by, "up"]).join(tails, [*by, "down"]).where("root = other").select(*by, "node", "root")
    between = between.join(found.select(*by, "node"), [*by, "node"], "left_anti").unionByName(found)
    # a taken-out node with an edge to itself is alone only if its way is in no component
    inner_roots = inner.join(heads, [*by, "up"]).join(tails, [*by, "down"]).where("root = other").select(*by, "node", F.col("root").alias("way"))
    root = settled(between.join(inner_roots, [*by, "node"], "left").select(*by, "node", F.coalesce("way", "root").alias("root")))
    named = root.groupBy(*by, "root").agg(F.min("node").alias("component"))
    return root.join(named, [*by, "root"]).select(*by, "node", "component")


def _taken_out(edges: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges between the other nodes, (node, up, down) of the nodes with one way in and one out, (node, root) of rings of such nodes alone)."""
    edges = settled(edges)
    into = edges.groupBy(*by, F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*by, "node")
    out = edges.groupBy(*by, F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*by, "node")
    plain = settled(into.join(out, [*by, "node"]))
    rounds = int(plain.count()).bit_length() + 1

    def followed(node: str, to: str) -> DataFrame:
        """(node, to, least): the first node on the way that is not plain, or any on a ring; and the least node passed."""
        now = settled(edges.select(*by, F.col(node).alias("node"), F.col(to).alias("to")).join(plain, [*by, "node"], "left_semi").withColumn("least", F.col("node")))
        for _ in range(rounds):
            ahead = now.select(*by, F.col("node").alias("to"), F.col("to").alias("next"), F.col("least").alias("more"))
            step = now.join(ahead, [*by, "to"], "left")
            step = settled(step.select(*by, "node", F.coalesce("next", "to").alias("to"), F.least("least", F.coalesce("more", "least")).alias("least"), F.col("next").isNotNull().alias("on")))
            now = step.drop("on")
            if step.where("on").isEmpty():
                break
        return now

    back, on = followed("b", "a"), followed("a", "b")
    rings = back.join(plain.withColumnRenamed("node", "to"), [*by, "to"], "left_semi").select(*by, "node", F.col("least").alias("root"))
    inner = back.select(*by, "node", F.col("to").alias("up")).join(on.select(*by, "node", F.col("to").alias("down")), [*by, "node"])
    inner = settled(inner.join(rings.select(*by, "node"), [*by, "node"], "left_anti"))
    ends = edges.join(plain.withColumnRenamed("node", "b"), [*by, "b"], "left_anti").join(inner.select(*by, F.col("node").alias("a"), "up"), [*by, "a"], "left")
    return settled(ends.select(*by, F.coalesce("up", "a").alias("a"), "b").distinct()), inner, rings


def _trimmed(edges: DataFrame, by: list[str]) -> DataFrame:
    edges, n = settled(edges), -1
    while True:
        m = edges.count()
        if m in (n, 0):
            return edges
        n = m
        into, out = edges.select(*by, F.col("b").alias("a")).distinct(), edges.select(*by, F.col("a").alias("b")).distinct()
        edges = settled(edges.join(into, [*by, "a"], "left_semi").join(out, [*by, "b"], "left_semi"))


def _coloured(edges: DataFrame, by: list[str]) -> DataFrame:
    nodes = edges.select(*by, F.col("a").alias("node")).union(edges.select(*by, "b")).distinct()
    colour = settled(nodes.withColumn("colour", F.col("node")))
    front = colour
    while True:
        new = edges.join(front.select(*by, F.col("node").alias("a"), "colour"), [*by, "a"]).groupBy(*by, F.col("b").alias("node")).agg(F.max("colour").alias("new"))
        front = settled(new.join(colour, [*by, "node"]).where("new > colour").select(*by, "node", F.col("new").alias("colour")))
        if front.isEmpty():
            return colour
        colour = settled(colour.unionByName(front).groupBy(*by, "node").agg(F.max("colour").alias("colour")))


def _hung(edges: DataFrame, by: list[str], starts: DataFrame, moved: list[str], joined) -> tuple[DataFrame, DataFrame]:
    """Nodes with one way in, but for starts (*by, node), hang on the node they come from: (node -> root and what lies between, edges between roots).

    moved: columns that say what an edge does; joined(first, second): those of two edges in a row, by column. Each round makes ways twice as long. Nodes that still
    hang after as many rounds as a way can double are on rings that nothing enters, and have no root.
    """
    ways = edges.groupBy(*by, F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("ways")).where("ways = 1").select(*by, "node").join(starts, [*by, "node"], "left_anti")
    up = settled(edges.withColumnRenamed("b", "node").join(ways, [*by, "node"], "left_semi").select(*by, "node", F.col("a").alias("up"), *moved))
    for left in range(int(up.count()).bit_length() + 1, 0, -1):
        above = up.select(*by, F.col("node").alias("up"), F.col("up").alias("next"), *(F.col(c).alias(f"{c}_") for c in moved))
        both = joined(lambda c: F.col(f"{c}_"), F.col)
        step = up.join(above, [*by, "up"], "left")
        longer = settled(step.select(*by, "node", F.coalesce("next", "up").alias("up"), *(F.when(F.col("next").isNull(), F.col(c)).otherwise(both[c]).alias(c) for c in moved), F.col("next").isNotNull().alias("on")))
        if longer.where("on").isEmpty():
            up = longer.drop("on")
            break
        up = (longer.where("not on") if left == 1 else longer).drop("on")
    joins = edges.join(up.select(*by, F.col("node").alias("b")), [*by, "b"], "left_anti")
    above = up.select(*by, F.col("node").alias("a"), F.col("up").alias("next"), *(F.col(c).alias(f"{c}_") for c in moved))
    both = joined(lambda c: F.col(f"{c}_"), F.col)
    joins = joins.join(above, [*by, "a"], "left").select(
        *by, F.coalesce("next", "a").alias("a"), "b", *(F.when(F.col("next").isNull(), F.col(c)).otherwise(both[c]).alias(c) for c in moved)
    )
    return up, settled(joins)


def must_and_may(edges: DataFrame, by: list[str], starts: DataFrame | None = None) -> DataFrame:
    """Which guards hold on every way (must) and on some way (may) from a start to each node that is reached from it.

    edges (*by, a, b, guard int from 0 or null, negated); starts (*by, node), by default node 0 of each graph; starts are met apart. Returns (*by, word, origin, node, must, may), origin
    being the start: in word w, bit 2 (g - 31 w) stands for guard g and the next one for its
    negation. Passing a guard adds its bit and takes the opposite one from must. Nodes with one way in are composed with the one before; the others
    are met by rounds over what changed.
    """
    words = edges.groupBy(*by).agg(F.coalesce(F.max(F.expr(f"div(guard, {GUARDS})")), F.lit(0)).alias("words"))
    edges = edges.join(words, by).withColumn("word", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words").cast("long"))))
    here = F.col("guard").isNotNull() & (F.expr(f"div(guard, {GUARDS})") == F.col("word"))
    place = (2 * (F.col("guard") % GUARDS) + F.col("negated").cast("int")).cast("int")
    other = (2 * (F.col("guard") % GUARDS) + 1 - F.col("negated").cast("int")).cast("int")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = lambda at: F.when(here, F.call_function("shiftleft", one, at)).otherwise(zero)
    edges = settled(edges.select(*by, "word", "a", "b", bit(other).alias("drop"), bit(place).alias("add"), bit(place).alias("any")))
    graphs = edges.select(*by, "word").distinct()
    starts = settled(graphs.withColumn("node", F.lit(0)) if starts is None else graphs.join(starts.distinct(), by).select(*by, "word", "node"))
    by = [*by, "word"]

    def joined(first, second) -> dict:
        kept = first("add").bitwiseAND(F.bitwise_not(second("drop")))
        return {"drop": first("drop").bitwiseOR(second("drop")), "add": kept.bitwiseOR(second("add")), "any": first("any").bitwiseOR(second("any"))}

    up, joins = _hung(edges, by, starts, ["drop", "add", "any"], joined)
    after = lambda m: m.bitwiseAND(F.bitwise_not("drop")).bitwiseOR(F.col("add"))
    state = settled(starts.select(*by, F.col("node").alias("origin"), "node", zero.alias("must"), zero.alias("may")))
    front, key = state, [*by, "origin", "node"]
    while True:
        come = joins.join(front.withColumnRenamed("node", "a"), [*by, "a"])
        come = come.groupBy(*by, "origin", F.col("b").alias("node")).agg(F.bit_and(after(F.col("must"))).alias("new_must"), F.bit_or(F.col("may").bitwiseOR(F.col("any"))).alias("new_may"))
        met = come.join(state, key, "left")
        must = F.coalesce(F.col("must").bitwiseAND(F.col("new_must")), F.col("new_must"))
        may = F.coalesce(F.col("may").bitwiseOR(F.col("new_may")), F.col("new_may"))
        changed = F.col("must").isNull() | (must != F.col("must")) | (may != F.col("may"))
        front = settled(met.where(changed).select(*key, must.alias("must"), may.alias("may")))
        if front.isEmpty():
            break
        state = settled(state.join(front.select(*key), key, "left_anti").unionByName(front))
    hung = up.join(state.withColumnRenamed("node", "up"), [*by, "up"])
    return state.unionByName(hung.select(*key, after(F.col("must")).alias("must"), F.col("may").bitwiseOR(F.col("any")).alias("may")))


def is_set(word: Column, bit: Column) -> Column:
    return F.call_function("shiftright", word, bit.cast("int")).bitwiseAND(1) == 1
