"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

1. Equal vectors of one label collapse into classes with a key of their own, so a hot group of copies is one row with a multiplicity, and null or
   repeated ids are no matter.
2. Every class gets a sign code in each table and a short sketch of further signs. Only the class key and the sketch are dealt to the buckets (32 bytes a
   table), in blocks: a bucket of m members is ceil(m / block) blocks, and each pair of blocks is its own unit of work, so no task holds a whole bucket.
3. A unit compares sketches by bit counts and names the members that may have a link in it. Only those fetch their vector, once for each such unit.
4. Exact cosines decide. A pair that collides in several tables is counted in the first one, which both codes tell and the vectors give again, so pairs
   are never rows: each unit returns link counts by class and a spanning forest of its links, and components are formed of these.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import cut, drop, forest
from .components import components

#: Signs of a sketch.
SKETCH = 128
#: Members of a bucket that unrelated vectors fill, about.
CROWD = 32


def hyperplanes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def _vectors(batch, column: str) -> list:
    """float64 vectors of a batch; None for those that are null, empty, zero or hold a null or non-finite component."""
    col = batch.column(column)
    inner = col.flatten()
    values = inner.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    holes = inner.is_null().to_numpy(zero_copy_only=False)
    sizes = np.array([0 if n is None else n for n in _lengths(col)], np.int64)
    ends = np.cumsum(sizes)
    out = []
    for n, end in zip(sizes, ends):
        x = values[end - n : end]
        out.append(x if n and not holes[end - n : end].any() and np.isfinite(x).all() and x.any() else None)
    return out


def _lengths(col) -> list:
    import pyarrow.compute as pc

    return pc.list_value_length(col).to_pylist()


def _digests(with_vectors: bool, narrow: bool):
    """Of (vec_id, label, embedding): vec_id, digest of label and vector (null where the vector links with nothing), and the vector's bytes if asked for."""

    def run(batches):
        kind = np.float32 if narrow else np.float64
        for batch in batches:
            labels = batch.column("label").to_pylist()
            digest, raws = [], []
            for label, x in zip(labels, _vectors(batch, "embedding")):
                raw = None if x is None or label is None else x.astype(kind).tobytes()
                digest.append(None if raw is None else hashlib.blake2b(label.encode() + b"\0" + raw, digest_size=16).digest())
                raws.append(raw)
            out = {"vec_id": batch.column("vec_id"), "digest": pa.array(digest, pa.binary())}
            if with_vectors:
                out |= {"label": batch.column("label"), "vector": pa.array(raws, pa.binary())}
            yield pa.RecordBatch.from_pydict(out)

    return run


class Signs:
    """Codes of all tables and sketches of vectors (rows of a matrix), from their signs against fixed hyperplanes."""

    def __init__(self, bits: int, tables: int, seed: int):
        self.bits, self.tables, self.seed, self.planes = bits, tables, seed, {}

    def _of(self, x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        dim = x.shape[1]
        if dim not in self.planes:
            self.planes[dim] = hyperplanes(dim, self.tables * self.bits + SKETCH, self.seed)
        return x @ self.planes[dim][:, lo:hi] > 0

    def codes(self, x: np.ndarray) -> np.ndarray:
        n = self.tables * self.bits
        return self._of(x, 0, n).reshape(len(x), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))

    def sketches(self, x: np.ndarray) -> np.ndarray:
        n = self.tables * self.bits
        return np.packbits(self._of(x, n, n + SKETCH), axis=1).view(np.int64)


def by_length(raws: list, kind) -> list:
    """(places, matrix of unit vectors) for each length among the vectors' bytes."""
    at: dict[int, list[int]] = {}
    for i, raw in enumerate(raws):
        at.setdefault(len(raw), []).append(i)
    out = []
    for places in at.values():
        x = np.frombuffer(b"".join(raws[i] for i in places), kind).astype(np.float64).reshape(len(places), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((np.array(places), x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return out


def _keys(signs: Signs, narrow: bool):
    """Of (rep, label, vector): rep, sketch (s1, s2) and the bucket key of each table, a hash of label, length, table and code."""

    def run(batches):
        import xxhash

        for batch in batches:
            raws = batch.column("vector").to_pylist()
            salt = np.array([xxhash.xxh3_64_intdigest(f"{len(r)} {label}") for label, r in zip(batch.column("label").to_pylist(), raws)], np.uint64)
            keys, sketch = [None] * len(raws), np.zeros((len(raws), SKETCH // 64), np.int64)
            tables = np.arange(1, signs.tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for places, x in by_length(raws, np.float32 if narrow else np.float64):
                sketch[places] = signs.sketches(x)
                key = _mix(signs.codes(x).astype(np.uint64) + tables)
                key = _mix(key ^ salt[places][:, None]).view(np.int64)
                for i, k in zip(places, key):
                    keys[i] = k
            yield pa.RecordBatch.from_pydict(
                {"rep": batch.column("rep"), "s1": pa.array(sketch[:, 0].copy()), "s2": pa.array(sketch[:, 1].copy()), "keys": pa.array(keys, pa.list_(pa.int64()))}
            )

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    from .common import mix64

    return mix64(x)


UNIT = ["tab", "bucket", "lo", "hi"]


def _units(batches, names):
    """Rows sorted by unit: each unit's columns, whole."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {k: np.array(batch.column(k).to_pylist() + [None], object)[:-1] if k in ("vector", "label") else batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        if held is not None:
            rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
        new = np.zeros(len(rows["lo"]) - 1, bool)
        for k in UNIT:
            new |= rows[k][1:] != rows[k][:-1]
        cuts = np.r_[0, np.flatnonzero(new) + 1]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo > 1:
                yield {k: v[lo:hi] for k, v in rows.items()}
        held = {k: v[cuts[-1] :] for k, v in rows.items()}
    if held is not None and len(held["lo"]) > 1:
        yield held


def _sides(rows: dict):
    """(left, right, one block?) places of a unit: a block with itself, or two blocks."""
    if rows["lo"][0] == rows["hi"][0]:
        every = np.arange(len(rows["lo"]))
        return every, every, True
    return np.flatnonzero(rows["side"] == 0), np.flatnonzero(rows["side"] == 1), False


def _involved(most: int):
    """The members of each unit whose sketch is within `most` signs of another's."""

    def run(batches):
        names = (*UNIT, "side", "rep", "s1", "s2")
        out, n = [], 0
        for rows in _units(batches, names):
            left, right, same = _sides(rows)
            s1, s2 = rows["s1"].view(np.uint64), rows["s2"].view(np.uint64)
            hit = np.zeros(len(s1), bool)
            for at in range(0, len(left), 256):
                a = left[at : at + 256]
                near = np.bitwise_count(s1[a][:, None] ^ s1[right]).astype(np.int16) + np.bitwise_count(s2[a][:, None] ^ s2[right]) <= most
                if same:
                    near[np.arange(len(a)), a] = False
                hit[a] |= near.any(axis=1)
                hit[right] |= near.any(axis=0)
            if hit.any():
                out.append({k: rows[k][hit] for k in names[:-2]})
                n += int(hit.sum())
            if n >= 10_000:
                yield _members(out)
                out, n = [], 0
        if out:
            yield _members(out)

    return run


def _members(parts: list):
    kinds = {"bucket": pa.int64(), "rep": pa.int64()}
    return pa.RecordBatch.from_pydict({k: pa.array(np.concatenate([p[k] for p in parts]), kinds.get(k, pa.int32())) for k in parts[0]})


def _compare(threshold: float, signs: Signs, narrow: bool):
    """Link counts and a spanning forest of the links of each unit, by exact cosines; a pair counts in the first table that both codes share."""

    def links(rows):
        left, right, same = _sides(rows)
        one = np.zeros(len(rows["rep"]), bool)
        one[left] = True
        counts, edges = [], []
        for places, x in by_length(rows["vector"].tolist(), np.float32 if narrow else np.float64):
            rep, copies, codes = rows["rep"][places], rows["copies"][places], None
            labels = rows["label"][places]
            a_side = np.flatnonzero(one[places])
            b_side = a_side if same else np.flatnonzero(~one[places])
            for lo in range(0, len(a_side), 512):
                a = a_side[lo : lo + 512]
                close = x[a] @ x[b_side].T >= threshold
                if same:
                    close &= b_side[None, :] > a[:, None]
                i, j = np.nonzero(close)
                i, j = a[i], b_side[j]
                fits = labels[i] == labels[j]
                i, j = i[fits], j[fits]
                if not len(i):
                    continue
                if codes is None:
                    codes = signs.codes(x)
                keep = np.empty(len(i), bool)
                for at in range(0, len(i), 65_536):
                    p, q = i[at : at + 65_536], j[at : at + 65_536]
                    keep[at : at + 65_536] = (codes[p] == codes[q]).argmax(axis=1) == rows["tab"][0]
                i, j = i[keep], j[keep]
                if len(i):
                    n = np.zeros(len(rep), np.int64)
                    np.add.at(n, i, copies[j])
                    np.add.at(n, j, copies[i])
                    hit = np.flatnonzero(n)
                    counts.append((rep[hit], n[hit]))
                    edges.append(forest(rep[i], rep[j]))
        return counts, edges

    def run(batches):
        for rows in _units(batches, (*UNIT, "side", "rep", "copies", "label", "vector")):
            counts, edges = links(rows)
            if not counts:
                continue
            n = [np.concatenate([c[k] for c in counts]) for k in (0, 1)]
            e = [np.concatenate([c[k] for c in edges]) for k in (0, 1)]
            yield pa.RecordBatch.from_pydict(
                {
                    "u": pa.array(np.concatenate([n[0], e[0]]), pa.int64()),
                    "v": pa.array(np.concatenate([np.full(len(n[0]), -1), e[1]]), pa.int64()),
                    "is_link": pa.array(np.r_[np.zeros(len(n[0]), bool), np.ones(len(e[0]), bool)]),
                    "links": pa.array(np.concatenate([n[1], np.zeros(len(e[0]), np.int64)]), pa.int64()),
                }
            )

    return run


def plan_tables(n: int, threshold: float, miss: float) -> tuple[int, int, int]:
    """(bits, tables, signs that sketches may differ in) for n vectors of a label.

    Buckets of unrelated vectors stay at about CROWD members as n grows, whatever n is. A pair at the threshold collides in no table with probability `miss`, and
    differs in more signs of its sketch with a tenth of that.
    """
    bits = max(1, math.ceil(math.log2(max(n, 2) / CROWD)))
    differ = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    agree = (1 - differ) ** bits
    tables = max(1, math.ceil(math.log(miss) / math.log1p(-agree))) if agree < 1 else 1
    tail, most = 1.0, 0
    while most < SKETCH:
        tail -= math.comb(SKETCH, most) * differ**most * (1 - differ) ** (SKETCH - most)
        if tail <= miss / 10:
            break
        most += 1
    return bits, tables, most


def near_vectors(vectors: DataFrame, threshold: float = 0.93, miss: float = 1e-5, block: int = 512, seed: int = 1) -> DataFrame:
    """vectors (vec_id long, embedding array of numbers, label): links between equal labels with cosine >= threshold.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable by links, itself included) and kept, one row for each row
    of vectors. A pair at the threshold is missed with probability `miss`, a closer one with less; no pair below it is linked.
    Null labels, null, empty or zero vectors and vectors with null or non-finite components link with nothing and are their own
    component. Vectors of different lengths never link. Labels are equal if their texts are. Rows are told apart by label and vector, not by id: null and repeated ids
    keep a row each. A component of rows without ids has a null component_id, and its rows are kept; a row without an id in any other component is
    not. Other columns are not read. An empty table gives no rows.
    """
    kind = vectors.schema["embedding"].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    source = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding") if narrow else F.col("embedding").cast("array<double>").alias("embedding")
    )
    rows = cut(source.mapInArrow(_digests(False, narrow), "vec_id long, digest binary"), "rows")
    found = source.mapInArrow(_digests(True, narrow), "vec_id long, digest binary, label string, vector binary").where("digest is not null")
    classes = found.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    # the key is made once, in the write
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables, most = plan_tables(largest, threshold, miss)
    signs = Signs(bits, tables, seed)
    keyed = cut(classes.select("rep", "label", "vector").mapInArrow(_keys(signs, narrow), "rep long, s1 long, s2 long, keys array<long>"), "keyed")
    members = keyed.select("rep", "s1", "s2", F.posexplode("keys").alias("tab", "bucket"))
    large = cut(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block), "large")
    blocks = F.coalesce(F.ceil(F.col("c") / block).cast("int"), F.lit(1))
    dealt = (
        members.join(large, "bucket", "left")
        .select("rep", "s1", "s2", "tab", "bucket", blocks.alias("blocks"))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("tab", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "s1", "s2")
    )
    spread = dealt.repartition(*UNIT).sortWithinPartitions(*UNIT)
    asked = cut(spread.mapInArrow(_involved(most), "tab int, bucket long, lo int, hi int, side int, rep long"), "asked")
    fetched = asked.join(classes.select("rep", "copies", "label", "vector"), "rep").select(*UNIT, "side", "rep", "copies", "label", "vector")
    spread = fetched.repartition(*UNIT).sortWithinPartitions(*UNIT)
    found = cut(spread.mapInArrow(_compare(threshold, signs, narrow), "u long, v long, is_link boolean, links long"), "found")
    drop(keyed)
    drop(asked)
    comps = components(found.where("is_link").select("u", "v"))
    counts = found.where("not is_link").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    own = (
        classes.select("rep", "digest", "least", "copies")
        .join(counts, "rep", "left")
        .join(comps.withColumnRenamed("id", "rep"), "rep", "left")
        .select("digest", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("root"))
    )
    own = cut(own, "own")
    smallest = cut(own.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    per_class = own.join(smallest, "root").select("digest", "n_links", "component_id")
    linked = rows.where("digest is not null").join(per_class, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors of `embeddings`, within labels."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
