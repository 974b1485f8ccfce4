"""Token ids in files: canonical length-limited Huffman codes from global counts, in independent blocks with bit-offset checkpoints.

Texts become ids once, in a table that also holds each task's counts of ids. The counts of all tasks, no more than the vocabulary has ids, give
code lengths of at most `max_bits` by package-merge; lengths alone say the canonical code, and are the dataset's book. Documents are then dealt by range of doc_id
and each range is written by the format "id_blocks".

A file is blocks, their index and a footer. A block holds up to BLOCK_IDS ids of consecutive documents: its segments (doc_id, offset of the segment in its
document, ids here, ids of the document), the bit offset of every STEP-th id, and the bits. Any block decodes alone, and all its checkpoints at once: one lookup of
max_bits bits in a table gives an id and its length for every lane. Files are named by attempt, and a manifest is written when the job
commits, so lost and repeated tasks leave nothing that a reader sees; it lists files in order of doc_id with the ids before each. Overwriting takes
earlier manifests away; a dataset is written once, not appended to, as ids before a document count from the start of the dataset.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import cut, documents, small_batches, table_path
from .packing import WordTokens

MAGIC = b"TFIDBLK1"
BLOCK_IDS, STEP, MOST_SEGMENTS = 1 << 18, 256, 1 << 16
#: Segments of a block, rows of a file's index, and the footer, all little endian.
SEGMENT = np.dtype([("doc", "<i8"), ("null", "<u1"), ("at", "<u8"), ("ids", "<u4"), ("total", "<u8")])
INDEX = np.dtype([("offset", "<u8"), ("bytes", "<u8"), ("first", "<u8"), ("ids", "<u4"), ("crc", "<u4")])
FOOTER, HEAD = "<8sQQ", "<IIII"
BOOK = np.dtype([("id", "<u4"), ("bits", "<u1")])
PIECE = "doc_id long, start long, at long, n_tokens long, ids binary"


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Bits of each symbol's code, at most max_bits, of least total length for the counts (all above 0): package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.uint8)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need codes of more than {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    leaf, merged = [np.ones(n, bool)], weights
    for _ in range(max_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        leaf.append(by < n)
        merged = both[by]
    bits, take = np.zeros(n, np.uint8), 2 * n - 2
    for one in reversed(leaf):
        leaves = int(one[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.zeros(n, np.uint8)
    out[order] = bits
    return out


class Code:
    """The canonical code of a book (ids ascending, bits of each): shorter codes first, then smaller ids."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        self.max_bits = int(bits.max(initial=1))
        order = np.lexsort([ids, bits])
        ids, bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        room = 1 << (self.max_bits - bits)
        size = int(ids.max(initial=0)) + 1
        self.bits, self.code = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.bits[ids] = bits
        self.code[ids] = ((np.cumsum(room) - room) >> (self.max_bits - bits)).astype(np.uint64)
        #: what the next max_bits bits say: id * 32 + bits of its code
        self.table = np.zeros(1 << self.max_bits, np.uint32)
        self.table[: room.sum()] = np.repeat((ids << 5 | bits).astype(np.uint32), room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every STEP-th id)."""
        if len(ids) and (ids.max() >= len(self.bits) or not self.bits[ids].all()):
            raise ValueError("an id is not in the book")
        bits = self.bits[ids]
        code, end = self.code[ids], np.cumsum(bits)
        start = end - bits
        word, free = start >> 6, 64 - (start & 63)
        fits = bits <= free
        left, right = np.where(fits, free - bits, 0).astype(np.uint64), np.where(fits, 0, bits - free).astype(np.uint64)
        out = np.zeros((int(end[-1]) + 63 >> 6 if len(ids) else 0) + 1, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] = np.bitwise_or.reduceat(code << left >> right, first)
            over = np.flatnonzero(~fits)
            out[word[over] + 1] |= code[over] << (np.uint64(64) - right[over])
        return out.byteswap().tobytes()[: (int(end[-1]) + 7) // 8 if len(ids) else 0], start[::STEP].astype("<u4")

    def decode(self, raw: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block, all checkpoints side by side."""
        b = np.frombuffer(raw + bytes(STEP * self.max_bits // 8 + 8), np.uint8).astype(np.uint32)
        window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at = checkpoints.astype(np.int64)
        out = np.empty((min(STEP, n), len(at)), np.uint32)
        down, mask = 32 - self.max_bits, (1 << self.max_bits) - 1
        for i in range(len(out)):
            found = self.table[window[at >> 3] >> (down - (at & 7)).astype(np.uint32) & mask]
            out[i] = found >> 5
            at += found & 31
        return out.T.reshape(-1)[:n]


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _fetch(fs, path: str, offset: int, length: int, tries: int = 4) -> bytes:
    """Bytes of a file, read again after short or failed reads."""
    import time

    for i in range(tries):
        try:
            with fs.open_input_file(path) as f:
                raw = f.read_at(length, offset)
            if len(raw) == length:
                return raw
        except OSError:
            if i + 1 == tries:
                raise
        time.sleep(0.1 * 2**i)
    raise OSError(f"{path}: {length} bytes at {offset} could not be read")


@lru_cache(maxsize=4)
def _code(root: str, book: str) -> Code:
    fs, at = _fs(root)
    with fs.open_input_stream(f"{at}/{book}") as f:
        rows = np.frombuffer(f.read(), BOOK)
    return Code(rows["id"], rows["bits"])


class _Commit(WriterCommitMessage):
    def __init__(self, task, files):
        self.task, self.files = task, files  # (name, bytes of blocks, blocks, ids, first doc_id, last doc_id)


class IdWriter(DataSourceArrowWriter):
    """Rows (doc_id long, ids binary) in order of doc_id within and over tasks. ids are little-endian integers of `width` bytes."""

    def __init__(self, path: str, book: str, width: int, max_mb: int, overwrite: bool):
        self.path, self.book, self.width, self.max_bytes, self.overwrite = path, book, width, max_mb << 20, overwrite

    def write(self, batches):
        from pyspark import TaskContext

        fs, root = _fs(self.path)
        code, files = _code(self.path, self.book), []
        out = name = None
        at = written = 0
        index, ends = [], []
        segments, ids, held = [], [], 0

        def block():
            nonlocal out, name, at, written, segments, ids, held, index, ends
            if out is None:
                name, at, written, index, ends = f"{uuid.uuid4().hex}.ids", 0, 0, [], [segments[0][0]]
                out = fs.open_output_stream(f"{root}/{name}")
            bits, checkpoints = code.encode(np.concatenate(ids))
            rows = np.array([(d or 0, d is None, *rest) for d, *rest in segments], SEGMENT)
            raw = struct.pack(HEAD, len(rows), held, len(checkpoints), len(bits)) + rows.tobytes() + checkpoints.tobytes() + bits
            index.append((at, len(raw), written, held, zlib.crc32(raw)))
            out.write(raw)
            at, written = at + len(raw), written + held
            ends[1:] = [segments[-1][0]]
            segments, ids, held = [], [], 0

        def close():
            nonlocal out
            rows = np.array(index, INDEX)
            out.write(rows.tobytes() + struct.pack(FOOTER, MAGIC, at, len(rows)))
            out.close()
            files.append((name, at, len(rows), written, *ends))
            out = None

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                own = np.frombuffer(raw, f"<u{self.width}")
                done = 0
                while done < len(own) or not len(own) and done == 0:
                    some = own[done : done + BLOCK_IDS - held]
                    segments.append((doc, done, len(some), len(own)))
                    ids.append(some)
                    held, done = held + len(some), done + max(1, len(some))
                    if held == BLOCK_IDS or len(segments) == MOST_SEGMENTS:
                        block()
                        if at >= self.max_bytes:
                            close()
        if segments:
            block()
        if out is not None:
            close()
        return _Commit(TaskContext.get().partitionId(), files)

    def commit(self, messages):
        fs, root = _fs(self.path)
        files, first, last = [], 0, None
        for m in sorted((m for m in messages if m is not None and m.files), key=lambda m: m.task):
            for name, size, blocks, ids, lo, hi in m.files:
                if last is not None and (lo is None or lo < last):
                    raise ValueError("documents were not dealt in order of doc_id")
                last = hi
                files.append((name, size, blocks, first))
                first += ids
        before = _manifests(fs, root)
        if before and not self.overwrite:
            raise ValueError(f"{self.path} holds a dataset")
        with fs.open_output_stream(f"{root}/{uuid.uuid4().hex}.manifest") as out:
            out.write(json.dumps({"book": self.book, "files": files}).encode())
        for name in before:
            fs.delete_file(name)

    def abort(self, messages):
        fs, root = _fs(self.path)
        for m in messages:
            for name, *_ in m.files if m is not None else ():
                try:
                    fs.delete_file(f"{root}/{name}")
                except OSError:
                    pass


def _manifests(fs, root: str) -> list[str]:
    from pyarrow.fs import FileSelector

    return sorted(f.path for f in fs.get_file_info(FileSelector(root)) if f.path.endswith(".manifest"))


class _Blocks(InputPartition):
    """Byte ranges (file, lo, hi, bytes of blocks, blocks, ids before the file) and the book."""

    def __init__(self, book, ranges):
        self.book, self.ranges = book, ranges


class IdReader(DataSourceReader):
    """A partition owns the blocks that start in its byte ranges; small files go together, large ones are split."""

    def __init__(self, path: str, split_mb: float, most: int):
        self.path, self.split, self.most = path, int(split_mb * (1 << 20)), most

    def partitions(self):
        fs, root = _fs(self.path)
        out = []
        for manifest in _manifests(fs, root):
            with fs.open_input_stream(manifest) as f:
                found = json.loads(f.read())
            split = max(self.split, -(-sum(f[1] for f in found["files"]) // self.most))
            held, room = [], 0
            for name, size, blocks, first in found["files"]:
                n = max(1, -(-size // split))
                for i in range(n):
                    lo, hi = size * i // n, size * (i + 1) // n
                    if held and hi - lo > room:
                        out.append(_Blocks(found["book"], held))
                        held = []
                    room = (room if held else split) - (hi - lo)
                    held.append((name, lo, hi, size, blocks, first))
            if held:
                out.append(_Blocks(found["book"], held))
        return out or [_Blocks("", [])]

    def read(self, part):
        fs, root = _fs(self.path)
        for name, lo, hi, size, blocks, before in part.ranges:
            where = f"{root}/{name}"
            tail = _fetch(fs, where, size, blocks * INDEX.itemsize + struct.calcsize(FOOTER))
            if struct.unpack(FOOTER, tail[blocks * INDEX.itemsize :]) != (MAGIC, size, blocks):
                raise OSError(f"{where}: footer is damaged")
            index = np.frombuffer(tail[: blocks * INDEX.itemsize], INDEX)
            for row in index[(index["offset"] >= lo) & (index["offset"] < hi)]:
                raw = _fetch(fs, where, int(row["offset"]), int(row["bytes"]))
                if zlib.crc32(raw) != row["crc"]:
                    raw = _fetch(fs, where, int(row["offset"]), int(row["bytes"]))
                    if zlib.crc32(raw) != row["crc"]:
                        raise OSError(f"{where}: block at {row['offset']} is damaged")
                yield self._pieces(raw, before + int(row["first"]), _code(self.path, part.book))

    @staticmethod
    def _pieces(raw: bytes, first: int, code: Code) -> pa.RecordBatch:
        n, ids, points, size = struct.unpack_from(HEAD, raw)
        at = struct.calcsize(HEAD)
        seg = np.frombuffer(raw, SEGMENT, n, at)
        at += n * SEGMENT.itemsize
        points = np.frombuffer(raw, "<u4", points, at)
        found = code.decode(raw[len(raw) - size :], points, ids).astype("<u4")
        ends = np.r_[0, np.cumsum(seg["ids"].astype(np.int64))]
        offset = seg["at"].astype(np.int64)
        data = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(found.tobytes())])
        docs = pa.array(seg["doc"].copy(), pa.int64(), mask=seg["null"].astype(bool))
        cols = [docs, pa.array(first + ends[:-1] - offset), pa.array(offset), pa.array(seg["total"].astype(np.int64)), data]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PIECE.split(", ")])


class IdSource(DataSource):
    """spark.read.format("id_blocks").load(uri); options split_mb, max_partitions. Writing: options book, width, max_mb."""

    @classmethod
    def name(cls):
        return "id_blocks"

    def schema(self):
        return PIECE

    def reader(self, schema):
        return IdReader(self.options["path"], float(self.options.get("split_mb", 16)), int(self.options.get("max_partitions", 20_000)))

    def writer(self, schema, overwrite):
        o = self.options
        return IdWriter(o["path"], o["book"], int(o.get("width", 4)), int(o.get("max_mb", 128)), overwrite)


def _tokenize(path: str, end: int, width: int):
    def run(batches):
        """Rows (doc_id, ids), then a row (id, seen) for each id the task met."""
        tokens, seen = WordTokens(path), np.zeros(1 << 16, np.int64)

        def rows(doc_id, ids, one, n):
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((doc_id, ids, one, n), kinds)], names=["doc_id", "ids", "id", "seen"])

        for batch in batches:
            found = [tokens.of(text or "", end) for text in batch.column("text").to_pylist()]
            more = np.bincount(np.concatenate(found)) if found else seen[:0]
            if len(more) > len(seen):
                seen = np.r_[seen, np.zeros(len(more) - len(seen), np.int64)]
            seen[: len(more)] += more
            out, none = [ids.astype(f"<u{width}").tobytes() for ids in found], [None] * len(found)
            yield rows(batch.column("doc_id").to_pylist(), out, none, none)
        at = np.flatnonzero(seen)
        none = [None] * len(at)
        yield rows(none, none, at, seen[at])

    return run


def encode(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, max_bits: int = 18, max_mb: int = 128) -> None:
    """Writes the ids of docs (doc_id long, text string), each followed by end_id, under path in ascending order of doc_id.

    A null doc_id comes first; rows of one doc_id, repeated ones too, are documents of their own, by a hash of their ids, so that they spread. Null and
    empty texts are end_id alone; a long text spans blocks; an empty table gives a dataset without files. Other columns are not read. Raises where path
    already holds a dataset. max_bits grows if there are more ids than codes of that length.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    spark.dataSource.register(IdSource)
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select("doc_id", "text").mapInArrow(_tokenize(tokenizer_path, end_id, width), "doc_id long, ids binary, id long, seen long")
    rows = cut(rows, "ids")
    counts = rows.where("id is not null").groupBy("id").agg(F.sum("seen").alias("seen")).orderBy("id").toArrow()  # at most one row an id of the vocabulary
    ids, seen = counts.column("id").to_numpy(), counts.column("seen").to_numpy()
    book = np.zeros(len(ids), BOOK)
    book["id"], book["bits"] = ids, code_lengths(seen, max(max_bits, int(len(ids)).bit_length()))
    name = f"{uuid.uuid4().hex}.book"
    fs, root = _fs(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(book.tobytes())
    own = rows.where("id is null").select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), "tie", "ids"]
    own = own.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "ids")
    own.write.format("id_blocks").options(book=name, width=width, max_mb=max_mb).mode("append").save(path)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """The dataset under path in pieces of documents, schema PIECE: a document that spans blocks has several, at offsets `at`."""
    spark.dataSource.register(IdSource)
    return spark.read.format("id_blocks").options(**options).load(path)


def _crcs(batches):
    for batch in batches:
        crc = [zlib.crc32(memoryview(x)) for x in (v.as_buffer() for v in batch.column("ids"))]
        size = np.diff(np.frombuffer(batch.column("ids").buffers()[1], np.int32)[batch.column("ids").offset :][: batch.num_rows + 1]) // 4
        names = ["doc_id", "start", "at", "n_tokens"]
        cols = [batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=[*names, "size", "crc"])


def _whole(batches):
    """Pieces sorted by (start, at) -> one row a document: the crc of joined pieces, from theirs and their sizes."""
    held = None
    for batch in batches:
        out = []
        for doc, start, at, total, size, crc in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if at:
                zeros = bytes(4 * size)
                held[3] = zlib.crc32(zeros, held[3]) ^ crc ^ zlib.crc32(zeros)
            else:
                if held:
                    out.append(held)
                held = [doc, start, total, crc]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in held], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(pieces: DataFrame) -> DataFrame:
    """One row a document of load(): doc_id, start, n_tokens, ids_crc32 of its ids as unsigned 32-bit little-endian integers. Only pieces of
    documents that span blocks are shuffled."""
    rows = cut(pieces.mapInArrow(_crcs, "doc_id long, start long, at long, n_tokens long, size long, crc long"), "crcs")
    alone = rows.where("size = n_tokens").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    parts = rows.where("size < n_tokens").repartition("start").sortWithinPartitions("start", "at")
    return alone.unionByName(parts.mapInArrow(_whole, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids of the public 49k word tokenizer in files of the shared folder, read back."""
    import public_tokenizers

    path = table_path(spark, "ids")
    encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    return digests(load(spark, path))
