"""Exact repeated-passage removal with a sparse, distributed suffix array.

Every byte that lies in a string of `length` bytes which also starts anywhere else is removed. Sorting a suffix for every byte is not needed:
each window of `length` bytes names one anchor, the least hash among its runs of GRAM bytes (leftmost on ties). The anchor depends on the
window's bytes alone, so equal windows have equal anchors at equal distances; about 2 windows in (length - GRAM) start a new anchor.

1. One scan writes a row for each anchor: hash of its leading GRAM bytes, a hash of its whole span (all windows that name it) and its place.
2. Anchors whose leading bytes occur once cannot repeat and go. Anchors whose spans seem equal form a class; two of a class stand for it (one, if it has no
   other), so that copies of a hot group are not sorted over and over. Hashes only choose what is sorted.
3. The suffixes of these anchors are put in order: range partitions between splitters that Spark samples, by what follows the anchor, its leading bytes
   first; a local three-way multikey quicksort on characters of four symbols in each bucket; and a comparison across bucket boundaries. Where several spans share their
   leading bytes, a second order goes by these and then by what precedes the anchor. A window that reaches d bytes back and length - d on is
   repeated if another span agrees that far both ways. The longest agreement either way is the one with a neighbour in that order, which
   bounds the windows that can be repeated; the agreements with the neighbours, byte by byte, prove ranges of them.
4. Windows within the bound that no neighbour proves are compared by digest, with those of the spans that share their leading bytes.
5. What is proven for a class holds at each of its places; the ranges meet their texts in one join, where they are merged and cut out.
No step holds a group of equal leading bytes in one task: aggregations combine before they shuffle, joins are
sort-merge joins of two shuffled sides, and the orders are over all bytes, so range partitions split the largest group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import cut, documents, drop, mix64, small_batches, told_apart

GRAM = 32
#: Bytes worked on at once; a longer text goes in overlapping pieces.
CHUNK = 500_000
BASE = 0x9E3779B97F4A7C15 | 1


class Hasher:
    """Polynomial hashes modulo 2**64 of any stretch of a chunk, by prefix sums."""

    def __init__(self, most: int):
        one = np.ones(most, np.uint64)
        one[1:] = BASE
        self.up = np.multiply.accumulate(one)
        one[1:] = pow(BASE, -1, 1 << 64)
        self.down = np.multiply.accumulate(one)
        self.table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def load(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        x = self.table[data]
        x *= self.up[: len(data)]
        np.cumsum(x, out=self.sums[1:])

    def of(self, lo, hi) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, hasher: Hasher):
    """Texts data[starts[i]:ends[i]]: (text, anchor, first window, last window, hash of leading bytes, hash of span), places in data."""
    n, width = len(data), length - GRAM + 1
    empty = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    long = ends - starts >= length
    if n < length or not long.any():
        return empty
    hasher.load(data)
    key = mix64((hasher.sums[GRAM:] - hasher.sums[:-GRAM]) * hasher.down[: n - GRAM + 1])
    key &= np.uint64(~0xFFFFFF & (1 << 64) - 1)
    key |= np.arange(len(key), dtype=np.uint64)
    low, have = key, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = (low & np.uint64(0xFFFFFF)).astype(np.int32)  # anchor of the window that starts at each place
    valid = np.zeros(len(at) + 1, np.int32)
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, np.minimum(ends[long] - length + 1, len(at)), -1)
    at[np.cumsum(valid[:-1]) == 0] = -1
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    keep = at[first] >= 0
    first, last = first[keep], last[keep]
    a = at[first].astype(np.int64)
    text = np.searchsorted(starts, first, "right") - 1
    gram = mix64(hasher.of(a, a + GRAM))
    span = mix64(hasher.of(first, last + length) + mix64(((last - first) * 4096 + (a - first)).astype(np.uint64)))
    return [text, a, first, last, gram, span]


def _anchor_rows(length: int):
    def run(batches):
        hasher = Hasher(CHUNK + length)
        for batch in batches:
            ids, tags = batch.column("did"), batch.column("tag")
            raw = batch.column("raw")
            offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
            sizes = np.diff(offsets)
            row = 0
            while row < len(raw):
                # a run of whole texts, or one long text in pieces that overlap by length - 1
                end = row + 1
                while end < len(raw) and offsets[end + 1] - offsets[row] <= CHUNK:
                    end += 1
                if sizes[row] > CHUNK:
                    jobs = [(row, row + 1, lo, min(lo + CHUNK, int(sizes[row]))) for lo in range(0, int(sizes[row]) - length + 1, CHUNK - length + 1)]
                else:
                    jobs = [(row, end, 0, int(offsets[end] - offsets[row]))]
                for lo_row, hi_row, lo, hi in jobs:
                    base = int(offsets[lo_row])
                    if hi_row - lo_row == 1:
                        starts, ends = np.array([0]), np.array([hi - lo])
                    else:
                        starts, ends = offsets[lo_row:hi_row] - base, offsets[lo_row + 1 : hi_row + 1] - base
                    text, a, first, last, gram, span = anchors(data[base + lo : base + hi], starts, ends, length, hasher)
                    if not len(text):
                        continue
                    take = pa.array(text + lo_row)
                    place = ((a - starts[text] + lo) << 16) | ((a - first) << 8) | (last - first)
                    yield pa.RecordBatch.from_pydict(
                        {"gram": pa.array(gram.view(np.int64)), "span": pa.array(span.view(np.int64)), "did": ids.take(take), "tag": tags.take(take), "place": pa.array(place)}
                    )
                row = end

    return run


def _contexts(length: int):
    """One row for each span that is compared: `after`, its bytes from the anchor on, and `before`, those before it, read backwards. Twice if its text is there twice."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("gram", "span", "place", "both", "after", "before")}
            for raw, texts, spans in zip(batch.column("raw"), batch.column("texts").to_pylist(), batch.column("spans").to_pylist()):
                raw = memoryview(raw.as_buffer())
                for s in spans:
                    a, back, more = s["place"] >> 16, (s["place"] >> 8) & 255, s["place"] & 255
                    after, before = bytes(raw[a : a - back + more + length]), bytes(raw[a - back : a])[::-1]
                    for twin in range(min(texts, 2)):
                        for k, v in zip(out, (s["gram"], s["span"], s["place"], s["both"] and not twin, after, before)):
                            out[k].append(v)
            kinds = {"after": pa.binary(), "before": pa.binary(), "both": pa.bool_()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return run


def symbols(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of 16-bit symbols, byte + 1, and 0 after the end, so that the end sorts before any byte."""
    sizes = np.array([len(b) for b in strings])
    out = np.zeros((len(strings), -(-width // 4) * 4), np.uint16)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    return out


def multikey(*blocks: np.ndarray) -> np.ndarray:
    """The order of rows by their symbols, block after block.

    Multikey quicksort: a segment of rows that agree up to a character (four symbols) is split in three by a pivot at that character; the
    middle part goes on with the next one. Segments of at most SMALL rows are finished by comparing what is left of the rows.
    """
    wide = np.concatenate(blocks, axis=1).astype(">u2").view(">u8")
    rows, width = [r.tobytes() for r in wide], wide.shape[1]
    chars = wide.astype(np.uint64)
    order = np.arange(len(rows))
    todo = [(0, len(rows), 0)]
    while todo:
        lo, hi, at = todo.pop()
        if hi - lo < 2 or at == width:
            continue
        some = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = sorted(some.tolist(), key=lambda i: rows[i][8 * at :])
            continue
        c = chars[some, at]
        pivot = np.partition(c[:: max(1, len(c) // 9)], min(4, len(c) // 2))[min(4, len(c) // 2)]
        less, more = c < pivot, c > pivot
        same = ~(less | more)
        i, j = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([some[less], some[same], some[more]])
        todo += [(lo, i, at), (i, j, at + 1), (j, hi, at)]
    return order


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows of symbols."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


CONTEXT = {"gram": pa.int64(), "span": pa.int64(), "place": pa.int64(), "after": pa.binary(), "before": pa.binary()}
ORDERED = "gram long, span long, place long, on long, back long, end long, after binary, before binary"


def _held(batches, names) -> dict:
    held = {k: [] for k in names}
    for batch in batches:
        for k, v in held.items():
            v.extend(batch.column(k).to_pylist())
    return held


def _neighbours(length: int, backwards: bool):
    """One bucket: sorts it and compares neighbours. The ends of the bucket are also returned, with their bytes, for the boundaries."""

    def run(batches):
        from pyspark import TaskContext

        held = _held(batches, CONTEXT)
        if not held["gram"]:
            return
        a, b = symbols(held["after"], length), symbols(held["before"], length)
        order = multikey(a[:, :GRAM], b, a) if backwards else multikey(a, b)
        yield from _compared(held, a, b, order[:-1], order[1:])
        task = TaskContext.get().partitionId()
        yield _batch(held, [int(order[0]), int(order[-1])], [0, 0], [0, 0], [2 * task, 2 * task + 1], True)

    return run


def _compared(held, a, b, left, right):
    """Each row of `left` against the one of `right` in its place, told to both; rows whose leading bytes differ have nothing to tell."""
    for lo in range(0, len(left), 20_000):
        i, j = left[lo : lo + 20_000], right[lo : lo + 20_000]
        after, before = agreement(a[i], a[j]), agreement(b[i], b[j])
        keep = after >= GRAM
        i, j, after, before = i[keep], j[keep], after[keep], before[keep]
        if len(i):
            yield _batch(held, np.concatenate([i, j]).tolist(), np.tile(after, 2), np.tile(before, 2), [-1] * (2 * len(i)), False)


def _batch(held, at, after, before, end, with_bytes):
    ids = {k: pa.array([held[k][i] for i in at], pa.int64()) for k in ("gram", "span", "place")}
    text = {k: pa.array([held[k][i] for i in at] if with_bytes else [None] * len(at), pa.binary()) for k in ("after", "before")}
    return pa.RecordBatch.from_pydict(ids | {"on": pa.array(np.asarray(after, np.int64)), "back": pa.array(np.asarray(before, np.int64)), "end": pa.array(end, pa.int64())} | text)


def _boundaries(length: int):
    """Ends of buckets in order: the last row of each bucket against the first of the next. The task's own first and last end are returned as well."""

    def run(batches):
        held = _held(batches, (*CONTEXT, "end"))
        if not held["gram"]:
            return
        a, b = symbols(held["after"], length), symbols(held["before"], length)
        ends = np.array(held["end"])
        order = np.argsort(ends, kind="stable")
        near = np.flatnonzero((ends[order][:-1] % 2 == 1) & (ends[order][1:] % 2 == 0))
        yield from _compared(held, a, b, order[near], order[near + 1])
        at = [int(order[0]), int(order[-1])]
        yield _batch(held, at, [0, 0], [0, 0], ends[at].tolist(), True)

    return run


def _settle(length: int):
    """One row for each class with the agreements of its neighbours: proven ranges of bytes from the anchor on, and what is left open as (least, greatest) d."""

    def run(batches):
        for batch in batches:
            ranges = {k: [] for k in ("gram", "span", "lo", "hi", "open")}

            def add(g, span, lo, hi, is_open):
                for k, v in zip(ranges, (g, span, lo, hi, is_open)):
                    ranges[k].append(v)

            for g, span, place, pairs in zip(*(batch.column(c).to_pylist() for c in ("gram", "span", "place", "pairs"))):
                most = (place >> 8) & 255
                least = most - (place & 255)
                low = max(least, length - max(p["on"] for p in pairs))
                high = min(most, max(p["back"] for p in pairs))
                proven = merged((max(low, length - p["on"]), min(high, p["back"]) + 1) for p in pairs if max(low, length - p["on"]) <= min(high, p["back"]))
                at = low
                for lo, hi in proven:  # of d
                    add(g, span, 1 - hi, length - lo, False)
                    if at < lo:
                        add(g, span, at, lo - 1, True)
                    at = hi
                if at <= high:
                    add(g, span, at, high, True)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.bool_() if k == "open" else pa.int64()) for k, v in ranges.items()})

    return run


def _window_digests(length: int):
    """Windows of the spans in the ranges [lo, hi] of d, each with its digest."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("gram", "span", "d", "wanted", "digest")}
            names = ("gram", "span", "place", "after", "before", "lo", "hi", "wanted")
            for g, span, place, after, before, lo, hi, wanted in zip(*(batch.column(c).to_pylist() for c in names)):
                least = ((place >> 8) & 255) - (place & 255)
                for d in range(max(lo, least), min(hi, len(before)) + 1):
                    text = before[:d][::-1] + after[: length - d]
                    for k, v in zip(out, (g, span, d, wanted, hashlib.blake2b(text, digest_size=16).digest())):
                        out[k].append(v)
            kinds = {"wanted": pa.bool_(), "digest": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return run


def merged(ranges) -> list[tuple[int, int]]:
    """Ranges (lo, hi) as maximal runs in order."""
    out: list = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


#: A class of spans.
SPAN = ["gram", "span"]
#: Rows of a bucket, about, and of the segments that multikey() leaves to comparisons.
BUCKET, SMALL = 25_000, 48


def _in_order(context: DataFrame, length: int, backwards: bool, parts: int) -> DataFrame:
    """gram, span, place, on, back: agreements of each span with its neighbours in one of the two orders."""
    keys = (F.substring("after", 1, GRAM), "before", "after") if backwards else ("after", "before")
    found = cut(context.select(*CONTEXT).repartitionByRange(parts, *keys).mapInArrow(_neighbours(length, backwards), ORDERED), "order")
    told = found.where("end < 0").select(*SPAN, "place", "on", "back")
    ends, tasks = found.where("end >= 0"), parts
    while True:  # two ends for each task of the level below; the last level is one task of at most BUCKET rows
        fewer = -(-2 * tasks // BUCKET)
        tasks = fewer if 2 < fewer < tasks else 1
        level = ends.repartition(1) if tasks == 1 else ends.repartitionByRange(tasks, "end")
        level = cut(level.mapInArrow(_boundaries(length), ORDERED), "ends")
        told = told.unionByName(level.where("on > 0").select(*SPAN, "place", "on", "back"))
        if tasks == 1:
            return told
        ends = level.where("on = 0")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *told_apart(), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))


def repeated_ranges(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs (doc_id long, text string): (did, tag, lo, hi), ranges of bytes of text that lie in repeated strings; they may overlap. did and tag as in told_apart().

    Between GRAM + 8 and 256 bytes of length are possible.
    """
    if not GRAM + 8 <= length <= 256:
        raise ValueError("length out of range")
    small_batches(docs.sparkSession)
    rows = _rows(docs).select("did", "tag", "raw")
    every = cut(rows.mapInArrow(_anchor_rows(length), "gram long, span long, did long, tag long, place long"), "anchors")
    twice = cut(every.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram"), "twice")
    shared = cut(every.join(twice, "gram"), "shared")
    drop(every)
    one = F.struct("did", "tag", "place")
    spans = cut(shared.groupBy(*SPAN).agg(F.count(F.lit(1)).alias("copies"), F.min(one).alias("first"), F.max(one).alias("last")), "spans")
    # leading bytes of several spans, one of which is not repeated as a whole
    mixed = cut(spans.groupBy("gram").agg(F.count(F.lit(1)).alias("members"), F.min("copies").alias("least")).where("members > 1 and least = 1").select("gram", F.lit(True).alias("mixed")), "mixed")
    todo = spans.join(mixed, "gram", "left").select(*SPAN, "first", F.coalesce("mixed", F.lit(False)).alias("both"), F.explode(F.array_distinct(F.array("first", "last"))).alias("one"))
    todo = todo.select("one.did", "one.tag", F.struct(*SPAN, F.col("one.place").alias("place"), (F.col("both") & (F.col("one") == F.col("first"))).alias("both")).alias("s"))
    by_text = todo.groupBy("did", "tag").agg(F.collect_list("s").alias("spans"))
    texts = rows.groupBy("did", "tag").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("texts"))
    context = texts.join(by_text, ["did", "tag"]).select("raw", "texts", "spans")
    context = cut(context.mapInArrow(_contexts(length), "gram long, span long, place long, both boolean, after binary, before binary"), "contexts")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [max(least, -(-n // BUCKET)) for n in context.agg(F.count(F.lit(1)), F.count_if("both")).first()]
    pairs = _in_order(context, length, False, parts[0]).unionByName(_in_order(context.where("both"), length, True, parts[1]))
    pairs = pairs.groupBy(*SPAN).agg(F.min("place").alias("place"), F.collect_set(F.struct("on", "back")).alias("pairs"))
    settled = cut(pairs.mapInArrow(_settle(length), "gram long, span long, lo long, hi long, open boolean"), "settled")
    proven, undecided = settled.where("not open").drop("open"), settled.where("open").drop("open")
    if not undecided.isEmpty():
        # what is open, and all windows at these distances of the spans with the same leading bytes
        reach = cut(undecided.groupBy("gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "reach")
        names = [*SPAN, "place", "after", "before", "lo", "hi"]
        partners = context.join(reach, "gram").select(*names, F.lit(False).alias("wanted"))
        asked = context.join(undecided, SPAN).select(*names, F.lit(True).alias("wanted"))
        windows = partners.unionByName(asked).mapInArrow(_window_digests(length), "gram long, span long, d long, wanted boolean, digest binary")
        windows = cut(windows, "windows")
        again = cut(windows.where("not wanted").groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("digest"), "again")
        proven = proven.unionByName(windows.where("wanted").join(again, "digest").select(*SPAN, (-F.col("d")).alias("lo"), (length - F.col("d")).alias("hi")))
    anchor = F.shiftright("place", 16)
    out = cut(shared.join(proven, SPAN).select("did", "tag", (anchor + F.col("lo")).alias("lo"), (anchor + F.col("hi")).alias("hi")), "ranges")
    drop(shared)
    drop(context)
    return out


def _cut_out(batches):
    for batch in batches:
        n, removed, runs, kept_hash, kept_bytes = [], [], [], [], []
        for raw, ranges in zip(batch.column("raw"), batch.column("ranges").to_pylist()):
            raw = raw.as_buffer().to_pybytes()
            cuts, at, kept = merged((r["lo"], r["hi"]) for r in ranges or ()), 0, []
            for lo, hi in cuts:
                kept.append(raw[at:lo])
                at = hi
            kept = b"".join([*kept, raw[at:]])
            n.append(len(raw))
            removed.append(len(raw) - len(kept))
            runs.append(len(cuts))
            kept_hash.append(hashlib.sha256(kept).hexdigest())
            kept_bytes.append(kept)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()),
                "kept_sha256": pa.array(kept_hash, pa.string()), "kept": pa.array(kept_bytes, pa.binary()),
            }
        )


def _digest_only(batches):
    for batch in _cut_out(batches):
        yield batch.drop_columns(["kept"])


def _with_ranges(docs: DataFrame, length: int) -> DataFrame:
    ranges = repeated_ranges(docs, length).groupBy("did", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    return _rows(docs).join(ranges, ["did", "tag"], "left").select("doc_id", "raw", "ranges")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs (doc_id long, text string): doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes left, one row for each row of docs.

    Every byte covered by a string of `length` bytes that also starts anywhere else goes, in all places; matches never cross
    texts and overlaps count. Null and empty texts have no bytes; texts shorter than `length` are left alone. Two equal rows are repeats of each other. Rows with null
    ids are judged like others. Other columns are not read. An empty table gives no rows.
    """
    return _with_ranges(docs, length).mapInArrow(_digest_only, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _rewrite(batches):
    for batch in batches:
        found = next(_cut_out([batch.select(["doc_id", "raw", "ranges"])]))
        null = batch.column("null").to_pylist()
        kept = [None if n else b.decode("utf-8", "ignore") for n, b in zip(null, found.column("kept").to_pylist())]
        yield pa.RecordBatch.from_pydict({"others": batch.column("others"), "text": pa.array(kept, pa.string()), "removed": found.column("n_removed")})


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs (doc_id, text, any others): (others, text, removed): the other columns as one struct, the text with its repeated strings cut out, and bytes cut.

    A character cut in two goes as a whole. Columns of docs may have any names.
    """
    ranges = repeated_ranges(docs, length).groupBy("did", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    wide = docs.select("doc_id", "text", others.alias("others"))
    rows = wide.select(
        "doc_id", "others", *told_apart(), F.col("text").isNull().alias("null"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw")
    )
    joined = rows.join(ranges, ["did", "tag"], "left").select("doc_id", "others", "null", "raw", "ranges")
    return joined.mapInArrow(_rewrite, T.StructType([joined.schema["others"], T.StructField("text", T.StringType()), T.StructField("removed", T.LongType())]))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings of all documents, cut out."""
    return remove_repeats(documents(spark, sf_dir))
