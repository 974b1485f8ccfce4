"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One scan turns each text into its set of 64-bit shingle hashes, its size, a 128-bit digest of the set, band keys and a packed
   signature that keeps the two low bits of each minimum. Documents with equal sets collapse into classes; a class has a key of its own and one text that
   stands for it, so null and repeated ids are no matter.
2. Bands propose candidates between classes: first each bucket's members against its least class (a star, never all pairs).
3. Packed signatures estimate similarity by bit counts, corrected for chance agreement; pairs far below the threshold go.
4. The rest is confirmed exactly on the full sets of both texts, and components are formed.
5. Buckets that still span several components get their remaining cross-component pairs checked, so no link is lost to the
   star. Pairs are never rows, and sizes, signatures and texts are joined to one row a document before it is dealt. A first pass deals
   buckets in pairs of blocks, those of the commonest component never with one another, and finds candidates from sizes, components and signatures.
   It says between which homes a document has candidates: a home is a block of documents whose largest buckets have the same least class.
   The second pass deals texts by pairs of homes, once for all buckets that two documents share, counts intersections of full sets for one document against many
   at once, and returns a spanning forest of the links. Both passes compare pairs in blocks, so what they deal grows with a group by its size over the block.
A pair at similarity 0.8 is proposed with probability 1 - (1 - 0.8**rows)**bands: all but 5 in a million at the defaults.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WordHashes, cut, documents, drop, forest, mix64, small_batches, told_apart
from .components import components

ROWS, BANDS = 6, 42
HASHES = 256  # minima kept: 252 in bands, all in the signature
WORDS = HASHES * 2 // 64
LOW = 0x5555555555555555


def shingle_set(words: list, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; a shorter sequence is one shingle as a whole."""
    h = hashes.of(words)
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(mix64(out + np.uint64(width)))


def words_of(text: str | None) -> list:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as bytes."""
    return (text or "").encode().lower().split()


class Signer:
    """Minima under HASHES linear permutations modulo 2**32."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        step = 512
        for at in range(0, len(h), step):
            np.minimum(low, (self.a * h[None, at : at + step] + self.b).min(axis=1), out=low)
        return low

    @staticmethod
    def bands(minima: np.ndarray) -> np.ndarray:
        m = minima[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
        out = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for i in range(ROWS):
            out = mix64(out + m[:, i])
        return out.view(np.int64)

    @staticmethod
    def packed(minima: np.ndarray) -> np.ndarray:
        """The two low bits of each minimum, 32 minima a word. Multipliers are odd, so low bits of different minima agree by chance only."""
        two = minima & np.uint32(3)
        return (two.astype(np.uint64).reshape(WORDS, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sign(size: int):
    def run(batches):
        hashes, signer = WordHashes(), Signer()
        for batch in batches:
            n, digest, bands, packed = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(words_of(text), size, hashes)
                n.append(len(s))
                if not len(s):
                    digest.append(None)
                    bands.append([])
                    packed.append([])
                    continue
                two = np.array([s.sum(), mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64)
                digest.append(two.tobytes())
                m = signer.minima(s)
                bands.append(signer.bands(m))
                packed.append(signer.packed(m))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict(
                {k: batch.column(k) for k in ("doc_id", "did", "tag")} | {"n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()), "bands": pa.array(bands, longs), "packed": pa.array(packed, longs)}
            )

    return run


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: matching two-bit groups, less the quarter that agrees by chance."""
    same = F.lit(0)
    for i in range(WORDS):
        x = F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))
        same = same + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW)))
    return ((1 - same / HASHES) - 0.25) / 0.75


def _confirm(size: int, percent: int):
    """Rows sorted by (g, head first): the head's set against each other text of its unit."""

    def run(batches):
        hashes, unit, head = WordHashes(), None, None
        for batch in batches:
            u, v = [], []
            for g, first, p, d, text in zip(*(batch.column(c).to_pylist() for c in ("g", "o", "p", "d", "text"))):
                s = shingle_set(words_of(text), size, hashes)
                if first == 0:
                    unit, head = (p, g), s
                elif unit == (p, g):
                    both = len(np.intersect1d(head, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(head) + len(s) - both):
                        u.append(p)
                        v.append(d)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _pairs(rows: dict, percent: int):
    """Candidate pairs (i, j) of one unit: other components, possible sizes and signatures; in units of a bucket, first shared bucket."""
    n, label, side, packed, bands = rows["n"], rows["label"], rows["side"], rows["packed"], rows.get("bands")
    _, least = _least(percent)
    same_block = bool(rows["lo"][0] == rows["hi"][0])
    left = np.arange(len(n)) if same_block else np.flatnonzero(side == 0)
    right = left if same_block else np.flatnonzero(side == 1)
    for at in range(0, len(left), 256):
        a = left[at : at + 256]
        ok = label[a][:, None] != label[right]
        if same_block:
            ok &= a[:, None] < right
        ok &= np.minimum(n[a][:, None], n[right]) * 100 >= np.maximum(n[a][:, None], n[right]) * percent
        i, j = np.nonzero(ok)
        i, j = a[i], right[j]
        x = packed[i] ^ packed[j]
        differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(LOW)).sum(axis=1)
        keep = (1 - differ / HASHES - 0.25) / 0.75 >= least
        i, j = i[keep], j[keep]
        if len(i) and bands is not None:
            keep = (bands[i] == bands[j]).argmax(axis=1) == (bands[i[0]] == rows["band"][0]).argmax()
            i, j = i[keep], j[keep]
        if len(i):
            yield i, j


def _units(batches, unit: tuple, plain: tuple, arrays: dict, also: tuple = ()):
    """Rows sorted by the columns of `unit`: each unit's columns, whole. arrays: widths of array columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {k: np.array(batch.column(k).to_pylist(), object) if k in also else batch.column(k).to_numpy(zero_copy_only=False) for k in (*unit, *plain, *also)}
        for k, width in arrays.items():
            rows[k] = batch.column(k).flatten().to_numpy().reshape(-1, width).astype(np.int64).view(np.uint64 if k == "packed" else np.int64)
        if held is not None:
            rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
        new = np.any([rows[k][1:] != rows[k][:-1] for k in unit], axis=0)
        cuts = np.r_[0, np.flatnonzero(new) + 1]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield {k: v[lo:hi] for k, v in rows.items()}
        held = {k: v[cuts[-1] :] for k, v in rows.items()}
    if held is not None:
        yield held


def _involved(percent: int):
    """For each unit of a bucket: documents in a candidate pair (d), and the homes of the others of such pairs."""

    def run(batches):
        for rows in _units(batches, ("band", "lo", "hi"), ("side", "d", "label", "n", "home"), {"packed": WORDS, "bands": BANDS}):
            homes, at = np.unique(rows["home"], return_inverse=True)
            hit = [np.unique(np.r_[i * len(homes) + at[j], j * len(homes) + at[i]]) for i, j in _pairs(rows, percent)]
            if hit:
                hit = np.unique(np.concatenate(hit))
                yield pa.RecordBatch.from_pydict({"d": pa.array(rows["d"][hit // len(homes)]), "other": pa.array(homes[hit % len(homes)])})

    return run


def _linked(size: int, percent: int):
    """Spanning forests of the links of each unit of two homes, counted on full sets."""

    def run(batches):
        hashes = WordHashes()
        for rows in _units(batches, ("lo", "hi"), ("side", "d", "label", "n"), {"packed": WORDS}, ("text",)):
            sets = [shingle_set(words_of(t), size, hashes) for t in rows["text"]]
            counts = np.array([len(s) for s in sets])
            _, ids = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.r_[0, np.cumsum(counts)]
            mark = np.zeros(len(ids) and ids.max() + 1, np.int64)
            u, v = [], []
            for i, j in _pairs(rows, percent):
                for one in np.unique(i):
                    mark[ids[starts[one] : starts[one + 1]]] = 1
                    others = j[i == one]
                    for at in range(0, len(others), 512):
                        some = others[at : at + 512]
                        flat = np.concatenate([ids[starts[k] : starts[k + 1]] for k in some])
                        both = np.add.reduceat(mark[flat], np.r_[0, np.cumsum(counts[some])[:-1]])
                        good = some[100 * both >= percent * (counts[one] + counts[some] - both)]
                        u.append(np.full(len(good), rows["d"][one]))
                        v.append(rows["d"][good])
                    mark[ids[starts[one] : starts[one + 1]]] = 0
            if u and sum(map(len, u)):
                a, b = forest(np.concatenate(u), np.concatenate(v))
                yield pa.RecordBatch.from_pydict({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})

    return run


def with_texts(needs: DataFrame, column: str, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """needs with the text of the class that `column` names. rows (did, tag, text) shuffle once, and of repeated rows one goes on."""
    keys = classes.select(F.col("rep").alias(column), "did", "tag")
    wanted = cut(needs.join(keys, column), "wanted")
    some = rows.join(wanted.select("did", "tag").distinct().hint("merge"), ["did", "tag"], "left_semi").groupBy("did", "tag").agg(F.first("text").alias("text"))
    return wanted.join(some.hint("merge"), ["did", "tag"]).select(*needs.columns, "text")


def _commonest(rows: DataFrame, key: str) -> DataFrame:
    """For each key of rows (key, label, n): its commonest label, and rows (c, odd_c) and shingles (n, odd_n) under that label and under the others."""
    counts = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    most = counts.groupBy(key).agg(F.max(F.struct("c", "label", "n")).alias("m"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    return most.select(key, F.col("m.label").alias("common"), F.col("m.c").alias("c"), F.col("m.n").alias("n"), (F.col("c") - F.col("m.c")).alias("odd_c"), (F.col("n") - F.col("m.n")).alias("odd_n"))


def across(rest: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int, block: int = 1_024) -> DataFrame | None:
    """rest (band, p, d, label, common, c, odd_c): links (u, v) between components within buckets; None if there are no candidates.

    common is the commonest label of the bucket, with c members; odd_c others are under other labels.
    """
    sigs = classes.select(F.col("rep").alias("d"), "n", "packed", "bands")
    at = F.collect_list(F.struct("band", "common", "c", "odd_c")).alias("at")  # at most BANDS
    each = rest.groupBy("d").agg(F.first("label").alias("label"), F.min(F.struct(-(F.col("c") + F.col("odd_c")), "p")).alias("h"), at)
    each = cut(each.select("d", "label", F.col("h.p").alias("p"), "at").join(sigs, "d"), "each")
    homes = cut(_commonest(each, "p").withColumnsRenamed({"common": "most", "c": "most_c", "n": "most_n"}), "homes")
    most = F.col("label") == F.col("most")
    parts = F.ceil(F.greatest(F.when(most, F.col("most_c")).otherwise(F.col("odd_c")) / block, F.when(most, F.col("most_n")).otherwise(F.col("odd_n")) / (block * 1_024)))
    placed = each.join(homes, "p").withColumn("home", F.xxhash64("p", most, F.pmod(F.xxhash64("d"), parts))).select("d", "label", "n", "packed", "bands", "home", "at")
    odd, blocks = F.ceil(F.col("b.odd_c") / block), F.ceil(F.col("b.odd_c") / block) + F.ceil(F.col("b.c") / block)
    stray = F.col("label") != F.col("b.common")
    dealt = (
        placed.withColumn("b", F.explode("at"))
        .withColumn("own", F.when(stray, F.pmod("home", odd)).otherwise(odd + F.pmod("home", blocks - odd)))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(stray, blocks).otherwise(odd) - 1)))
        .select("b.band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "d", "label", "n", "home", "packed", "bands")
    )
    unit = ["band", "lo", "hi"]
    found = dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_involved(percent), "d long, other long")
    asked = cut(found.groupBy("d").agg(F.collect_set("other").alias("others")), "asked")
    if asked.isEmpty():
        return None
    needs = asked.join(placed.select("d", "label", "n", "home", "packed"), "d")
    dealt = with_texts(needs, "d", classes, rows).withColumn("other", F.explode("others"))
    dealt = dealt.select(F.least("home", "other").alias("lo"), F.greatest("home", "other").alias("hi"), (F.col("home") > F.col("other")).cast("int").alias("side"), "d", "label", "n", "packed", "text")
    return dealt.repartition("lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(_linked(size, percent), "u long, v long")


def confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int, unit: int = 256) -> DataFrame:
    """pairs (p, d) of classes, distinct. The pairs whose full sets are alike, as (u, v).

    Pairs of one p are dealt in units of about `unit`; texts shuffle once by their own key and once by unit.
    """
    units = cut(pairs.groupBy("p").agg(F.count(F.lit(1)).alias("c")).select("p", F.ceil(F.col("c") / unit).cast("long").alias("s")), "units")
    dealt = pairs.join(units, "p").select("p", "d", F.pmod(F.xxhash64("d"), F.col("s")).alias("g"))
    heads = units.select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("g"))
    needs = dealt.select("d", "p", "g", F.lit(1).alias("o")).unionByName(heads.select(F.col("p").alias("d"), "p", "g", F.lit(0).alias("o")))
    spread = with_texts(needs, "d", classes, rows).repartition("p", "g").sortWithinPartitions("p", "g", "o")
    return spread.select("g", "o", "p", "d", "text").mapInArrow(_confirm(size, percent), "u long, v long")


def rooted(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, did, tag, n, root for each row of docs (doc_id, text): root names its component; null without shingles."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", *told_apart(), "text")
    signed = cut(rows.mapInArrow(_sign(size), "doc_id long, did long, tag long, n long, digest binary, bands array<long>, packed array<long>"), "signed")
    some = signed.where("digest is not null")
    best = F.min_by(F.struct("did", "tag", "n", "bands", "packed"), F.struct("did", "tag")).alias("r")
    # the key is made once, in the write
    classes = cut(some.groupBy("digest").agg(best).select("digest", "r.*").withColumn("rep", F.monotonically_increasing_id()), "classes")
    rows = rows.drop("doc_id")
    keys = classes.select(F.col("rep").alias("d"), F.explode("bands").alias("band"))
    many = cut(keys.groupBy("band").agg(F.min("d").alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1"), "many")
    members = cut(keys.join(many, "band").select("band", "c", "p", "d"), "members")
    sigs = classes.select("rep", "n", "packed")
    a = sigs.select(F.col("rep").alias("p"), F.col("n").alias("n1"), F.col("packed").alias("s1"))
    b = sigs.select(F.col("rep").alias("d"), F.col("n").alias("n2"), F.col("packed").alias("s2"))
    stars = members.where("d <> p").select("p", "d").distinct().join(b, "d").join(a, "p").where(_possible(percent)).select("p", "d")
    links = cut(confirmed(cut(stars, "stars"), classes, rows, size, percent), "links")
    comps = cut(components(links), "comps")
    # buckets of three and more may hold links that miss their least member
    wide = members.where("c > 2").join(comps.select(F.col("id").alias("d"), "component_id"), "d", "left")
    wide = cut(wide.select("band", "c", "p", "d", F.coalesce("component_id", "d").alias("label")), "wide")
    split = cut(_commonest(wide.withColumn("n", F.lit(0)), "band").where("odd_c > 0").select("band", "common", "c", "odd_c"), "split")
    rest = wide.drop("c").where("d <> p").join(split, "band")
    more = across(rest, classes, rows, size, percent)
    if more is not None:
        more = cut(more, "links")
        if not more.isEmpty():
            comps = cut(components(links.unionByName(more)), "comps")
    drop(members)
    drop(wide)
    roots = classes.select("digest", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component_id", "rep").alias("root"))
    linked = some.select("doc_id", "did", "tag", "n", "digest").join(roots, "digest").drop("digest")
    alone = signed.where("digest is null").select("doc_id", "did", "tag", "n", F.lit(None).cast("long").alias("root"))
    return linked.unionByName(alone)


def near_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id long, text string): classes of documents linked by Jaccard similarity >= percent / 100 on word shingles.

    Returns doc_id, n_shingles, component_id (smallest id reachable, itself included) and kept (doc_id = component_id), one row for each row of docs.
    Null, empty and wordless texts have no shingles and link with nothing. Rows are told apart by id and text: different texts of one id are documents of their
    own. Rows without an id link like others, and their id is never the smallest; a component of such rows alone has a null component_id and its rows
    count as kept. Other columns are not read. An empty table gives no rows.
    """
    found = cut(rooted(docs, size, percent), "rooted")
    least = cut(found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    linked = found.where("root is not null").join(least, "root").select("doc_id", "n", "component_id")
    alone = found.where("root is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text, any others) with one row of each component: the least id (rows without one come last), then the least hash of text and of the other columns.

    Rows without words link with nothing and all stay. Columns may have any names.
    """
    found = rooted(docs.select("doc_id", "text"), size, percent)
    chosen = F.min(F.struct(F.col("doc_id").isNull(), F.col("did"), F.col("tag"))).alias("one")
    chosen = cut(found.where("root is not null").groupBy("root").agg(chosen).select("one.did", "one.tag"), "chosen")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    plain = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs.where(words).select(*told_apart(), F.xxhash64(*plain).alias("h"), row.alias("row"))
    kept = own.join(chosen, ["did", "tag"], "left_semi").groupBy("did", "tag").agg(F.min_by("row", "h").alias("row"))
    return kept.select("row.*").unionByName(docs.where(~words))


def _least(percent: int) -> tuple[float, float]:
    """(chance that two-bit groups agree at the threshold, least estimate let through: five standard errors below the threshold)."""
    agree = 0.25 + 0.75 * percent / 100
    return agree, percent / 100 - 5 * ((agree * (1 - agree) / HASHES) ** 0.5) / 0.75


def _possible(percent: int) -> Column:
    """Of n1, s1, n2, s2: sizes within the ratio and an estimate not far below the threshold."""
    sizes = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
    return sizes & (estimate(F.col("s1"), F.col("s2")) >= _least(percent)[1])


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents on two-word shingles, similarity 0.8 or more."""
    return near_documents(documents(spark, sf_dir), size=2)
