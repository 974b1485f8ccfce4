"""Phrase collocations: contiguous phrases counted with compressed position bitmaps, depth first, and scored by their weakest cut.

A shard is a run of a task's words of one language. Every word has a compressed bitmap of its positions there: the non-zero 16-bit
blocks only. A position without a word lies at each end of a piece, so that no phrase crosses it. A phrase's bitmap marks
where it ends; shifted by one place and ANDed with the bitmaps of the words in the blocks it touches, it gives all phrases that are one
word longer, and popcounts give their numbers in the shard, which Spark sums over shards. Phrases extend depth first in batches of
a bounded number of ANDs, so memory does not follow the number of phrases.

Lengths are counted one after another. A phrase of k words can only be frequent where its first and its last k - 1 words are, so
later scans leave out what fixed-size hash filters of the shorter frequent phrases rule out. A filter has no false negatives: a full one only saves
less work. Counts are whole at every size of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, documents, mix64, small_batches

#: Bytes that end a piece, bytes that part words, and the upper case that is folded: fixed values.
ENDS, BLANKS, UPPER = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
END, BLANK = b".", b" "
TABLE = bytes(END[0] if c in ENDS else BLANK[0] if c in BLANKS else c + 32 if c in UPPER else c for c in range(256))
#: A block of a bitmap is 2**BLOCK positions; bits of a row's number in a batch.
BLOCK, INDEX = 4, 21


def slices(text: bytes, size: int):
    """Parts of a folded text of about `size` bytes, cut between words."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            end = max(text.rfind(BLANK, at, end), text.rfind(END, at, end)) + 1
            if end <= at:  # a word longer than that
                found = [i for i in (text.find(BLANK, at), text.find(END, at)) if i >= 0]
                end = min(found) + 1 if found else len(text)
        yield text[at:end]
        at = end


def positions(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """(number of the word at each position, 0 at the end of a piece; the words by number, the first being empty) of a folded text."""
    raw = np.frombuffer(text + END, np.uint8).copy()
    ends = np.flatnonzero((raw == BLANK[0]) | (raw == END[0]))
    gap = raw[ends] == END[0]
    raw[ends] = BLANK[0]
    offsets = np.r_[0, ends + 1].astype(np.int32)
    parts = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    word = np.diff(offsets) > 1
    places = word.astype(np.int64) + gap
    first = np.cumsum(places) - places
    ids = np.zeros(int(places.sum()), np.int32)
    ids[first[word]] = parts.indices.to_numpy()[word] + 1
    return ids, pa.concat_arrays([pa.array([b""], pa.binary()), pc.binary_slice(parts.dictionary, 0, -1)])


class Filter:
    """A set of hashes in 2**bits bits."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = place(hashes, self.bits)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return mix64(hashes) >> np.uint64(64 - bits)


def word_hashes(lang: str, words: list) -> np.ndarray:
    import xxhash

    head = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh3_64_intdigest(head + w) for w in words), np.uint64, len(words))


def joined(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return mix64(first) + word


def _bits_of(n: int) -> int:
    return max(1, int(n - 1).bit_length())


def _grouped(keys: np.ndarray) -> np.ndarray:
    """Order that brings equal keys (below 2**(63 - INDEX)) together, in their order; at most 2**INDEX of them."""
    return np.sort(keys << INDEX | np.arange(len(keys))) & ((1 << INDEX) - 1)


class Shard:
    """Position bitmaps of one shard. ids: word numbers by position; use: by number, whether the word may be in a phrase; hashes by number."""

    def __init__(self, ids: np.ndarray, use: np.ndarray, hashes: np.ndarray | None, most: int = 1 << (INDEX - 1)):
        at = np.flatnonzero(use[ids])
        self.bits, self.hashes, self.most = _bits_of(len(use)), hashes, most
        # (block, word, place in the block) in one number
        key = np.sort((at >> BLOCK << self.bits | ids[at]) << BLOCK | at & (1 << BLOCK) - 1)
        first = np.flatnonzero(np.diff(key >> BLOCK, prepend=-1))
        bit = np.left_shift(np.uint16(1), (key & (1 << BLOCK) - 1).astype(np.uint16))
        self.mask = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        key = key[first] >> BLOCK
        self.word, self.block = key & (1 << self.bits) - 1, (key >> self.bits).astype(np.int32)
        self.from_block = np.searchsorted(self.block, np.arange((len(ids) >> BLOCK) + 3)).astype(np.int32)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, popcounts) of all bitmaps."""
        count = np.bincount(self.word, np.bitwise_count(self.mask)).astype(np.int64)
        return np.flatnonzero(count), count[count > 0]

    def phrases(self, length: int, filters: list):
        """Yields (columns of word numbers, counts) of the phrases of `length` words; a phrase may come in several parts."""
        if len(self.word):
            order = np.argsort(self.word, kind="stable")
            path = [np.arange(1 << self.bits)]
            yield from self._extend(path, self.word[order], self.block[order], self.mask[order], length, filters)

    def _hash(self, path: list) -> np.ndarray:
        h = self.hashes[path[0]]
        for w in path[1:]:
            h = joined(h, self.hashes[w])
        return h

    def _extend(self, path, phrase, block, mask, length, filters):
        """path: words of each phrase, by place; phrase (ascending), block, mask: the blocks of its bitmap."""
        over, under = mask >> ((1 << BLOCK) - 1), mask << 1
        spill, here = np.flatnonzero(over), np.flatnonzero(under)
        number = np.concatenate([here, spill])
        order = np.argsort(number, kind="stable")
        number = number[order]
        phrase, mask = phrase[number], np.concatenate([under[here], over[spill]])[order]
        block = np.concatenate([block[here], block[spill] + 1])[order]
        width = self.from_block[block + 1] - self.from_block[block]
        upto = np.cumsum(width, dtype=np.int64)
        lo = 0
        while lo < len(phrase):
            base = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, base + self.most, "right")))
            part, lo_row, lo = slice(lo, hi), lo, hi
            row = np.repeat(np.arange(lo_row, hi, dtype=np.int32), width[part])
            skip = (self.from_block[block[part]] - (upto[part] - width[part] - base)).astype(np.int32)
            entry = np.arange(upto[hi - 1] - base, dtype=np.int32) + np.repeat(skip, width[part])
            both = self.mask[entry] & np.repeat(mask[part], width[part])
            hit = np.flatnonzero(both)
            if not len(hit):
                continue
            row, entry, both = row[hit], entry[hit], both[hit]
            key = phrase[row] << self.bits | self.word[entry]
            order = _grouped(key)
            key, both = key[order], both[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            count = np.add.reduceat(np.bitwise_count(both).astype(np.int64), first)
            before, word = key[first] >> self.bits, key[first] & (1 << self.bits) - 1
            new = [p[before] for p in path] + [word]
            n = len(new)
            keep = np.ones(len(first), bool)
            if n > 2:  # the last n - 1 words; those of pairs passed before
                keep &= filters[n - 2].passes(self._hash(new[1:]))
            if n < length:
                keep &= filters[n - 1].passes(self._hash(new))
            new = [p[keep] for p in new]
            if n == length:
                yield new, count[keep]
                continue
            each = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
            on = keep[each]
            yield from self._extend(new, (np.cumsum(keep) - 1)[each[on]], block[row[order[on]]], both[on], length, filters)


def _count(length: int, filters: list, shard_bytes: int):
    """Counts of the phrases of `length` words of each shard: rows (lang, phrase, a)."""

    def run(batches):
        pending: dict[str, list] = {}
        held: dict[str, int] = {}
        ready = [f.value for f in filters]

        def shard(lang, on):
            """The shard's counts. With on, its last words open the next shard, as a phrase may lie across the cut."""
            ids, words = positions(b"".join(pending.pop(lang)))
            del held[lang]
            if on and length > 1:  # the last place is the gap that positions() adds
                put(lang, b"".join(words[i].as_py() + BLANK if i else END for i in ids[-length:-1].tolist()))
            use, hashes = np.ones(len(words), bool), None
            if ready:
                hashes = word_hashes(lang, words.to_pylist())
                use = ready[0].passes(hashes)
            use[0] = False
            bitmaps = Shard(ids, use, hashes)
            for path, count in [([w], c) for w, c in [bitmaps.words()]] if length == 1 else bitmaps.phrases(length, ready):
                for at in range(0, len(count), 100_000):
                    part = [words.take(pa.array(w[at : at + 100_000])) for w in path]
                    text = (part[0] if length == 1 else pc.binary_join_element_wise(*part, BLANK)).cast(pa.string())
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(text), pa.string()), "phrase": text, "a": pa.array(count[at : at + 100_000])})

        def put(lang, text):
            pending.setdefault(lang, []).append(text)
            held[lang] = held.get(lang, 0) + len(text)

        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                for text in slices((raw or b"").translate(TABLE), shard_bytes):
                    put(lang, text)
                    if held[lang] >= shard_bytes:
                        yield from shard(lang, True)
                if lang in held:
                    put(lang, END)
                if len(held) > 64 or sum(held.values()) >= 2 * shard_bytes:
                    for one in list(held):
                        yield from shard(one, False)
        for one in list(held):
            yield from shard(one, False)

    return run


def counts(docs: DataFrame, length: int, filters: list = (), shard_bytes: int = 6_000_000) -> DataFrame:
    """Occurrences `a` of the phrases of `length` words by lang, overlaps included. With filters (broadcast, of lengths 1 to length - 1) the
    phrases that these rule out are left out."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found = rows.mapInArrow(_count(length, list(filters), shard_bytes), "lang string, phrase string, a long")
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _bits(bits: int):
    def run(batches):
        """Bits of the phrases' hashes: rows (at: number of a 64-bit word, bits)."""
        for batch in batches:
            at = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                h = word_hashes(lang, phrase.encode().split(b" "))
                one = h[:1]
                for w in h[1:]:
                    one = joined(one, np.array([w]))
                at.append(one)
            if at:
                p = place(np.concatenate(at), bits)
                word, back = np.unique(p >> np.uint64(6), return_inverse=True)
                ored = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(ored, back, np.left_shift(np.uint64(1), p & np.uint64(63)))
                yield pa.RecordBatch.from_pydict({"at": pa.array(word.astype(np.int64)), "bits": pa.array(ored.view(np.int64))})

    return run


def hash_filter(phrases: DataFrame, bits: int):
    """A broadcast Filter of phrases (lang, phrase), of 2**bits bits whatever their number."""
    rows = phrases.select("lang", "phrase").mapInArrow(_bits(bits), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(Filter(words, bits))


#: floor(1000000 a a / (l r)) in 38 digits; more are an error.
SCORE = "cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) * 1000000BD div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"


def _run(first, size) -> str:
    return f"array_join(slice(words, {first}, {size}), ' ')"


def _scored(
    docs: DataFrame, min_count: int = 10, min_words: int = 2, max_words: int = 3, covered: int = 50, filter_bits: int = 26, shard_bytes: int = 6_000_000
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, a, l, r, score) of all collocations, (lang, n)): see collocations()."""
    filters, known = [], []
    for length in range(1, max_words + 1):
        found = counts(docs, length, filters, shard_bytes)
        if length == 1:
            words = found = cut(found, "words")
            totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
            found = words.where(F.col("a") >= min_count)
        else:
            found = cut(found.where(F.col("a") >= min_count), "phrases")
        known.append(found)
        if length < max_words:
            filters.append(hash_filter(found, filter_bits))
    frequent = known[0]
    for one in known[1:]:
        frequent = frequent.unionByName(one)
    candidates = frequent.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words")).where(F.col("size") >= min_words)
    cuts = (
        candidates.where("size > 1")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .withColumns({"first": F.expr(_run("1", "k")), "rest": F.expr(_run("k + 1", "size - k"))})
        .select("lang", "phrase", "a", "k", "first", "rest")
    )
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(SCORE))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = (
        candidates.where(F.col("size") > min_words)
        .withColumn("part", F.explode(F.expr(f"sequence({min_words}, size - 1)")))
        .withColumn("at", F.explode(F.expr("sequence(1, size - part + 1)")))
        .groupBy("lang", F.expr(_run("at", "part")).alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    kept = weakest.join(inner, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {covered} * a"))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), totals


def collocations(docs: DataFrame, **options) -> DataFrame:
    """All collocations of docs (lang, text): (lang, phrase, a, l, r, n, score). Options: min_count, min_words, max_words, covered, filter_bits, shard_bytes.

    Candidates are phrases of min_words to max_words words inside a piece with a = f(phrase) >= min_count. A cut after k words has l = f(first
    part), r = f(rest) and the score floor(1000000 a a / (l r)), in exact arithmetic (a below 10**15, else an error); the lowest cut counts,
    the smallest k of equal ones. A candidate goes if 100 f(longer) >= covered * a for a longer candidate that holds its words in a row. n: all words of the lang.
    Null texts are empty, a null lang is `und`; texts without words add nothing; repeated rows count again; very long texts are read in slices; an empty
    table gives no rows. Other columns are not read.
    """
    scored, totals = _scored(docs, **options)
    return scored.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best(docs: DataFrame, limit: int = 2_000, **options) -> DataFrame:
    """Each lang's first `limit` collocations by score and a descending, then phrase in byte order, with their rank from 1. Phrases are dealt by hash to
    many, then to eight parts of a lang, and each part keeps its own first ones, so that no task sees all phrases of a lang."""
    scored, totals = _scored(docs, **options)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for deals in (max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 8, 1):
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(deals))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(part).cast("long")).where(F.col("rank") <= limit)
    return scored.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two or three words of each lang of all documents."""
    return best(documents(spark, sf_dir))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), runs AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM worded
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM worded
), f AS (
  SELECT lang, phrase, k, count(*)::HUGEINT AS a FROM runs GROUP BY ALL HAVING count(*) >= 10
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2
), cuts AS (
  SELECT c.lang, c.phrase, c.a, j, array_to_string(c.w[1:j], ' ') AS head, array_to_string(c.w[j + 1:], ' ') AS tail
  FROM candidates AS c, (VALUES (1), (2)) AS s(j) WHERE j < c.k
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a * y.a) AS score
  FROM cuts AS c JOIN f AS x ON x.lang = c.lang AND x.phrase = c.head JOIN f AS y ON y.lang = c.lang AND y.phrase = c.tail
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_of AS (
  SELECT lang, sub, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS sub FROM candidates WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM candidates WHERE k = 3
  ) GROUP BY lang, sub
), kept AS (
  SELECT s.* FROM weakest AS s LEFT JOIN inner_of AS i ON i.lang = s.lang AND i.sub = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
