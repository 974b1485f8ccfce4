"""Prefix trie of conversations by prefix doubling.

Turns get dense names by (role, text); round k names each aligned block of 2**k turns by the pair of names of its halves, so that a block of any length
is one number after logarithmically many equi-joins. A prefix is the few blocks of its length's binary digits, largest first:
those names say which prefix it is, exactly, and one grouping on (depth, names) gives the nodes. A node is (its smallest member, depth).

What a subtree adds up needs no walk: a node's members are the conversations through it, so each conversation carries the sum of
what the nodes it is the smallest member of add from a depth on, and a node sums that over its members. Long conversations are split: turns are numbered
over range partitions, and sums from the end run in blocks of SPAN turns and over the blocks' totals. Every table that a hot key
is joined with is written first, so that adaptive execution can split the other side.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, drop, small_batches

#: Turns of a conversation in one block of the sums from the end; ids in one piece of a digest's text.
SPAN, PIECE = 4_096, 4_096
#: monotonically_increasing_id() puts the row's place in its partition in these low bits.
PLACE = 33


def _place(column: str) -> tuple[Column, Column]:
    """(partition, place in it) of a number from monotonically_increasing_id()."""
    return F.shiftright(column, PLACE), F.col(column).bitwiseAND((1 << PLACE) - 1)


def named(keys: DataFrame) -> DataFrame:
    """The distinct rows of keys with dense numbers `name` from 0: places within partitions and a running sum of the partitions' sizes."""
    rows = cut(keys.distinct().withColumn("at", F.monotonically_increasing_id()), "names")
    part, place = _place("at")
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    out = rows.withColumn("part", part).join(F.broadcast(before), "part")  # one row a task of the stage before
    return out.select(*keys.columns, (F.col("before") + place).alias("name"))


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text) with `pos` from 1 in each conv, ordered by turn (null first), then role, text: (conv, pos, key, words).

    A conversation may span many range partitions: its rows count on from those in the partitions before. key: SHA-256 of the role and text.
    """
    words = F.size(F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")).cast("long")
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.select("conv", key.alias("key"), words.alias("words"), F.monotonically_increasing_id().alias("at")), "turns")
    part, _ = _place("at")
    runs = rows.groupBy("conv", part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("conv").orderBy("part")  # a row for each partition that holds some of the conversation
    runs = runs.select("conv", "part", "first", (F.sum("rows").over(before) - F.col("rows")).alias("before"))
    out = rows.withColumn("part", part).join(runs, ["conv", "part"])
    return out.select("conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "key", "words")


def as_turns(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as (conv, turn, role, text): null role and text are empty; rows without a conv_id belong to no conversation."""
    empty = F.lit("")
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )


def _blocks(turns: DataFrame):
    """Names of the aligned blocks of 2**k turns: yields (k, table (conv, block, name)) for k = 0, 1, ... while any is whole."""
    names = cut(named(turns.select("key")), "names")
    level = cut(turns.join(names, "key").select("conv", (F.col("pos") - 1).alias("block"), "name"), "blocks")
    drop(names)
    k = 0
    while not level.isEmpty():
        yield k, level
        half = F.col("block") % 2
        pairs = level.groupBy("conv", F.shiftright("block", 1).alias("block")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("a"), F.max(F.when(half == 1, F.col("name"))).alias("b")
        )
        pairs = cut(pairs.where("b is not null"), "pairs")
        names = cut(named(pairs.select("a", "b")), "names")
        level = cut(pairs.join(names, ["a", "b"]).select("conv", "block", "name"), "blocks")
        drop(pairs)
        drop(names)
        k += 1


def _prefixes(levels: list, turns: DataFrame) -> DataFrame:
    """(conv, depth, names): each prefix with the names of its blocks, the largest first. Block 2 i of level k is in the prefixes of the 2**k lengths
    from (2 i + 1) 2**k on."""
    parts = None
    for k, level in levels:
        rows = level.where("block % 2 = 0").withColumn("first", F.expr(f"shiftleft(block + 1, {k})"))
        if k > 12:  # in two steps, so that no row makes a long array
            rows = rows.withColumn("first", F.explode(F.expr(f"sequence(first, first + {(1 << k) - 1}, 4096)")))
        rows = rows.select("conv", F.explode(F.expr(f"sequence(first, first + {(1 << min(k, 12)) - 1})")).alias("depth"), F.lit(k).alias("k"), "name")
        parts = rows if parts is None else parts.unionByName(rows)
    ordered = F.expr("transform(array_sort(collect_list(struct(-k as k, name))), b -> b.name)")
    prefixes = parts.groupBy("conv", "depth").agg(ordered.alias("names"))  # at most one block of each level
    # the last blocks reach beyond the ends of conversations
    return prefixes.join(turns.select("conv", F.col("pos").alias("depth"), "words"), ["conv", "depth"])


def _from_the_end(rows: DataFrame, sums: list[str]) -> DataFrame:
    """rows (conv, depth, *sums): each sum over the same conversation's rows of this depth and deeper."""
    rows = rows.withColumn("span", F.expr(f"div(depth, {SPAN})"))
    after = Window.partitionBy("conv").orderBy(F.desc("span"))
    inside = Window.partitionBy("conv", "span").orderBy(F.desc("depth"))
    spans = rows.groupBy("conv", "span").agg(*(F.sum(c).alias(f"{c}_span") for c in sums))
    spans = spans.select("conv", "span", *((F.sum(f"{c}_span").over(after) - F.col(f"{c}_span")).alias(f"{c}_after") for c in sums))
    out = rows.select(*(c for c in rows.columns if c not in sums), *(F.sum(c).over(inside).alias(c) for c in sums))
    return out.join(spans, ["conv", "span"]).select(
        *(c for c in rows.columns if c not in (*sums, "span")), *((F.col(c) + F.col(f"{c}_after")).alias(c) for c in sums)
    )


def _pieces(batches):
    """Sorted rows (node, depth, conv) -> (node, depth, first conv, its ids in decimal, comma-joined) of at most PIECE ids."""
    held, node = [], None

    def row():
        return (*node, held[0], ",".join(map(str, held)))

    for batch in batches:
        out = []
        for n, d, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and ((n, d) != node or len(held) == PIECE):
                out.append(row())
                held = []
            node = (n, d)
            held.append(c)
        if out:
            yield _piece_rows(out)
    if held:
        yield _piece_rows([row()])


def _piece_rows(rows):
    return pa.RecordBatch.from_arrays(
        [*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], names=["node", "depth", "first", "ids"]
    )


def _digests(batches):
    """Sorted pieces -> (node, depth, SHA-256 of the node's pieces, comma-joined): one hash state at a time."""
    state, node = None, None
    for batch in batches:
        out = []
        for n, d, _, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (n, d) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (n, d), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield _digest_rows(out)
    if node is not None:
        yield _digest_rows([(*node, state.hexdigest())])


def _digest_rows(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["node", "depth", "ends"]
    )


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends (node, depth, conv): (node, depth, ends), the SHA-256 of each node's ids, ascending and comma-joined.

    Ids become text in range partitions, so a node with very many ids is spread; only its hash, which cannot be split, runs over the pieces in one task.
    """
    small_batches(ends.sparkSession)
    order = ["node", "depth", "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "node long, depth long, first long, ids string")
    pieces = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")
    return pieces.mapInArrow(_digests, "node long, depth long, ends string")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The prefix trie of conversations: turns (conv, pos from 1, key, words), ids (conv) of all of them, those without turns included.

    One row a node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Equal
    sequences of keys are one node. No conversations give no rows.
    """
    ids = cut(ids.distinct(), "convs")
    count, root = ids.agg(F.count("conv"), F.min("conv")).first()
    levels = list(_blocks(turns))
    if count == 0:
        return ids.sparkSession.createDataFrame([], NODE)
    if not levels:
        paths = turns.select("conv", F.col("pos").alias("depth"), F.col("conv").alias("node"), F.lit(1).cast("long").alias("n_convs"), "words").where("false")
    else:
        prefixes = cut(_prefixes(levels, turns), "prefixes")
        nodes = cut(prefixes.groupBy("depth", "names").agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n_convs")), "nodes")
        paths = cut(prefixes.join(nodes, ["depth", "names"]).select("conv", "depth", "node", "n_convs", "words"), "paths")
        for _, level in levels:
            drop(level)
        drop(prefixes)
        drop(nodes)
    # every conversation's way: its nodes by depth; it owns those whose smallest member it is
    owned = paths.where("conv = node")
    above = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    owned = owned.join(above, ["conv", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(root)))
    children = owned.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    children = cut(children, "children")
    owned = owned.join(children, ["node", "depth"], "left").select(
        "node", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    )
    owned = cut(owned, "owned")
    adds = owned.select(F.col("node").alias("conv"), "depth", "saved", (F.col("n_children") == 0).cast("long").alias("leaves"))
    on_way = paths.join(adds, ["conv", "depth"], "left").select("conv", "depth", "node", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaves", F.lit(0)).alias("leaves"))
    below = _from_the_end(on_way, ["saved", "leaves"]).groupBy("node", "depth").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    last = paths.groupBy("conv").agg(F.max(F.struct("depth", "node")).alias("last"))
    ends = ids.join(last, "conv", "left").select(
        F.coalesce("last.node", F.lit(root)).alias("node"), F.coalesce(F.col("last.depth"), F.lit(0)).cast("long").alias("depth"), "conv"
    )
    digests = cut(ends_digests(ends), "digests")
    inner = (
        owned.join(below, ["node", "depth"])
        .select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    )
    whole = owned.agg(
        F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"),
        F.greatest(F.count(F.when(F.col("n_children") == 0, 1)), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"),
    )
    top = whole.select(
        F.lit(root).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(count).cast("long").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens",
    )
    out = top.unionByName(inner).join(digests.withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select(*(c.split()[0] for c in NODE.split(", ")[:-1]), F.coalesce("ends", F.lit(nobody)).alias("ends_sha256"))


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are; turns in order of turn (null first), equal turns by role and text.

    Null role and text are empty; rows with a null conv_id belong to no conversation; repeated rows are turns of their own; texts of any length count as
    their SHA-256; no rows give no nodes. Other columns are not read.
    """
    turns = numbered(as_turns(conversations))
    return trie(turns, turns.select("conv"))


def rebuilt(turns: DataFrame, heads: int = 4, every: int = 20) -> DataFrame:
    """Numbered turns with each conv's first h = crc32(conv) mod heads turns taken from conv - conv % every; its own follow from place h on."""
    ids = turns.where("pos = 1").select("conv").withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % heads)
    ids = ids.withColumn("base", F.col("conv") - F.col("conv") % every)
    first = turns.where(F.col("pos") < heads).select(F.col("conv").alias("base"), "pos", "key", "words")
    taken = ids.join(first, "base").where("pos <= h")
    got = taken.groupBy("conv").agg(F.count(F.lit(1)).alias("got"))
    own = turns.join(ids.join(got, "conv", "left").select("conv", "h", F.coalesce("got", F.lit(0)).alias("got")), "conv").where("pos > h")
    return taken.select("conv", "pos", "key", "words").unionByName(own.select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "key", "words"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with the head of the first of its twenty."""
    turns = cut(numbered(as_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), "numbered")
    return trie(cut(rebuilt(turns), "rebuilt"), turns.where("pos = 1").select("conv"))


ORACLE = r"""
WITH RECURSIVE crc(i, v, s) AS (
  SELECT i, i, 0 FROM range(256) AS t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, s + 1 FROM crc WHERE s < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM crc WHERE s = 8
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), digits AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM turns
), hashed(conv_id, s, j, v) AS (
  SELECT conv_id, s, 1, 4294967295::BIGINT FROM digits
  UNION ALL SELECT conv_id, s, j + 1, xor(v >> 8, t[(xor(v, ord(s[j])) & 255) + 1]) FROM hashed, crc_table WHERE j <= length(s)
), heads AS (
  SELECT conv_id, xor(v, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base FROM hashed WHERE j = length(s) + 1
), taken AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM heads AS c JOIN turns AS t ON t.conv_id = c.base AND t.pos <= c.h
), got AS (
  SELECT c.conv_id, c.h, count(t.pos) AS got FROM heads AS c LEFT JOIN taken AS t USING (conv_id) GROUP BY ALL
), rebuilt AS (
  SELECT * FROM taken
  UNION ALL SELECT t.conv_id, t.pos - g.h + g.got, t.role, t.text FROM turns AS t JOIN got AS g USING (conv_id) WHERE t.pos > g.h
), chained AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS words FROM heads
  UNION ALL
  SELECT c.conv_id, c.depth + 1, sha256(c.path || length(t.role) || ':' || t.role || t.text),
         length(list_filter(regexp_split_to_array(t.text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))
  FROM chained AS c JOIN rebuilt AS t ON t.conv_id = c.conv_id AND t.pos = c.depth + 1
), ways AS (
  SELECT conv_id AS member, depth, words, min(conv_id) OVER w AS node, count(*) OVER w AS n_convs FROM chained WINDOW w AS (PARTITION BY depth, path)
), nodes AS (
  SELECT w.node, w.depth, p.node AS parent, w.n_convs, (w.n_convs - 1) * w.words AS saved
  FROM ways AS w LEFT JOIN ways AS p ON p.member = w.member AND p.depth = w.depth - 1 WHERE w.member = w.node
), children AS (
  SELECT n.node, n.depth, count(c.node) AS n_children FROM nodes AS n LEFT JOIN nodes AS c ON c.parent = n.node AND c.depth = n.depth + 1 GROUP BY ALL
), below AS (
  SELECT w.node, w.depth, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
  FROM ways AS w JOIN nodes AS n ON n.node = w.member AND n.depth >= w.depth JOIN children AS k ON k.node = n.node AND k.depth = n.depth GROUP BY ALL
), ends AS (
  SELECT node, depth, string_agg(member, ',' ORDER BY member) AS ids
  FROM (SELECT * FROM ways QUALIFY depth = max(depth) OVER (PARTITION BY member)) GROUP BY ALL
)
SELECT n.node AS conv_id, n.depth::BIGINT AS depth, n.parent AS parent_conv_id, n.n_convs, c.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes AS n JOIN children AS c USING (node, depth) JOIN below AS b USING (node, depth) LEFT JOIN ends AS e USING (node, depth)
"""
