"""Media columns: payloads stored as grey-scale PNG members of archives, read back through a Python data source.

Format "media_archive". Writing packs rows (key long, payload binary) into archives, one or more for each task, under names that
hold the attempt; the driver's commit writes a manifest of its archives last, so retried and lost tasks leave nothing
that a reader sees. Every commit has a manifest of its own: appending adds to what is there, overwriting takes the other manifests away. An archive is the members one after another, followed by an index of (key, offset, length, crc32) rows and a
footer. Reading plans byte-range partitions over the manifests' archives, a large one in several, small ones together, and never more than a bound:
beyond it ranges grow. A partition owns the members that
start in its ranges, reads them in runs, streams Arrow batches, and fetches a member again by its own offset when its
read comes short or its checksum fails. Paths go through pyarrow.fs, so file, S3, GCS and HDFS addresses work.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import documents, small_batches, table_path

TILE = 576
#: An index row and the footer of an archive, little endian.
INDEX = np.dtype([("key", "<i8"), ("null", "<u1"), ("offset", "<u8"), ("length", "<u8"), ("crc", "<u4")])
FOOTER = "<8sQQ"
MAGIC = b"TFMEDIA1"
PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """A grey-scale PNG of 8-bit samples, TILE wide; payload is a positive multiple of TILE bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, TILE)
    lines = np.zeros((len(rows), TILE + 1), np.uint8)  # filter 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", TILE, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of a PNG that to_png() wrote; raises ValueError for anything else."""
    if png[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(png):
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("PNG chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey-scale")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not written here")
    return lines[:, 1:].tobytes()


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _manifests(fs, root: str) -> list[str]:
    from pyarrow.fs import FileSelector

    return sorted(f.path for f in fs.get_file_info(FileSelector(root)) if f.path.endswith(".manifest"))


class _Commit(WriterCommitMessage):
    def __init__(self, archives):
        self.archives = archives  # (file name, bytes of members, members)


class MediaWriter(DataSourceArrowWriter):
    """Archives of at most about max_mb of members."""

    def __init__(self, path: str, max_mb: int, overwrite: bool = False):
        self.path, self.max_bytes, self.overwrite = path, max_mb << 20, overwrite

    def write(self, batches):
        import uuid

        import numpy as np

        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        done, out, name, at, index = [], None, None, 0, []

        def close():
            nonlocal out
            rows = np.array(index, INDEX)
            out.write(rows.tobytes())
            out.write(struct.pack(FOOTER, MAGIC, at, len(rows)))
            out.close()
            done.append((name, at, len(rows)))
            out = None

        for batch in batches:
            for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload")):
                if out is None:
                    name, at, index = f"{uuid.uuid4().hex}.media", 0, []
                    out = fs.open_output_stream(f"{root}/{name}")
                png = to_png(payload.as_py())
                index.append((key or 0, key is None, at, len(png), zlib.crc32(png)))
                out.write(png)
                at += len(png)
                if at >= self.max_bytes:
                    close()
        if out is not None:
            close()
        return _Commit(done)

    def commit(self, messages):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        archives = [a for m in messages if m is not None for a in m.archives]
        before = _manifests(fs, root) if self.overwrite else []
        with fs.open_output_stream(f"{root}/{uuid.uuid4().hex}.manifest") as out:
            out.write(json.dumps(archives).encode())
        for name in before:
            fs.delete_file(name)

    def abort(self, messages):
        fs, root = _fs(self.path)
        for m in messages:
            for name, *_ in m.archives if m is not None else ():
                try:
                    fs.delete_file(f"{root}/{name}")
                except OSError:
                    pass


class _Ranges(InputPartition):
    """Byte ranges (archive, lo, hi, bytes of members, members) of archives."""

    def __init__(self, ranges):
        self.ranges = ranges


class MediaReader(DataSourceReader):
    def __init__(self, path: str, split_mb: int, batch_mb: int, tries: int, most: int = 20_000):
        self.path, self.split, self.batch, self.tries, self.most = path, split_mb << 20, batch_mb << 20, tries, most

    def partitions(self):
        fs, root = _fs(self.path)
        archives = []
        for name in _manifests(fs, root):
            with fs.open_input_stream(name) as f:
                archives += json.loads(f.read())
        split = max(self.split, -(-sum(size for _, size, _ in archives) // self.most))
        out, held, room = [], [], 0
        for name, size, members in archives:
            n = max(1, -(-size // split))
            for i in range(n):
                lo, hi = size * i // n, size * (i + 1) // n
                if held and hi - lo > room:
                    out.append(_Ranges(held))
                    held = []
                room = (room if held else split) - (hi - lo)
                held.append((name, lo, hi, size, members))
        return [*out, _Ranges(held)]

    def read(self, part):
        for one in part.ranges:
            yield from self._range(*one)

    def _range(self, name, lo, hi, end, members):
        import time

        import numpy as np
        import pyarrow as pa

        fs, root = _fs(self.path)
        where = f"{root}/{name}"

        def fetch(offset, length):
            with fs.open_input_file(where) as f:
                return f.read_at(length, offset)

        def member(row):
            """One member by its own offset, tried again on short, damaged or failed reads."""
            for i in range(self.tries):
                try:
                    raw = fetch(int(row["offset"]), int(row["length"]))
                    if len(raw) == row["length"] and zlib.crc32(raw) == row["crc"]:
                        return raw
                except OSError:
                    if i + 1 == self.tries:
                        raise
                time.sleep(0.1 * 2**i)
            raise OSError(f"{name}: member at {row['offset']} is damaged")

        raw = fetch(end, members * INDEX.itemsize + struct.calcsize(FOOTER))
        if struct.unpack(FOOTER, raw[-struct.calcsize(FOOTER) :]) != (MAGIC, end, members):
            raise OSError(f"{name}: footer is damaged")
        index = np.frombuffer(raw[: -struct.calcsize(FOOTER)], INDEX)
        index = index[(index["offset"] >= lo) & (index["offset"] < hi)]
        at = 0
        while at < len(index):
            start = int(index["offset"][at])
            stop = max(at + 1, int(np.searchsorted(index["offset"] + index["length"], start + self.batch, "right")))
            run = index[at:stop]
            try:
                raw = fetch(start, int(run["offset"][-1] + run["length"][-1]) - start)
            except OSError:
                raw = b""
            media = []
            for row in run:
                first = int(row["offset"]) - start
                one = raw[first : first + int(row["length"])]
                media.append(one if len(one) == row["length"] and zlib.crc32(one) == row["crc"] else member(row))
            keys = pa.array(run["key"].copy(), pa.int64(), mask=run["null"].astype(bool))
            yield pa.RecordBatch.from_arrays([keys, pa.array(media, pa.binary())], names=["key", "media"])
            at = stop


class MediaSource(DataSource):
    """spark.read.format("media_archive").load(uri); options split_mb, batch_mb, tries, max_partitions. Writing: option max_mb."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "key long, media binary"

    def reader(self, schema):
        o = self.options
        return MediaReader(o["path"], int(o.get("split_mb", 16)), int(o.get("batch_mb", 4)), int(o.get("tries", 4)), int(o.get("max_partitions", 20_000)))

    def writer(self, schema, overwrite):
        return MediaWriter(self.options["path"], int(self.options.get("max_mb", 128)), overwrite)


def _payloads(batches):
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            out.append(raw + b"\xff" * ((-len(raw)) % TILE or (0 if raw else TILE)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["key", "payload"])


def store(docs: DataFrame, path: str) -> None:
    """Writes the texts of docs (doc_id long, text string) as media archives under path.

    Null and empty texts are one tile of bytes 255; a null id stays null; repeated rows are members of their own. An empty
    table gives an archive directory without members. What is under path already stays. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs.sparkSession.dataSource.register(MediaSource)
    rows = docs.select("doc_id", "text").mapInArrow(_payloads, "key long, payload binary")
    rows.write.format("media_archive").mode("append").save(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").load(path)


def _features(batches):
    """Features of each member: sizes, hashes, and a short text of sample statistics."""
    for batch in batches:
        cols = [[] for _ in range(7)]
        for media in batch.column("media").to_pylist():
            raw = from_png(media)
            x = np.frombuffer(raw, np.uint8)
            tail = np.trim_zeros(x[-TILE:] != 255, "b").size  # samples of the last line before the filling
            n = len(x) - TILE + tail
            hist = np.bincount(x >> 5, minlength=8)
            rows = x.reshape(-1, TILE)
            edges = int(np.abs(np.diff(rows.astype(np.int16), axis=1)).sum(dtype=np.int64))
            feature = f"{TILE}x{len(rows)};sum={int(x.sum(dtype=np.int64))};edges={edges};hist={','.join(map(str, hist))}"
            for c, v in zip(cols, (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def features(media: DataFrame) -> DataFrame:
    """media (key, media): one row of features for each member. UTF-8 holds no byte 255, so the filling tells the length."""
    return media.mapInArrow(
        _features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as PNG members in the shared folder, read back by byte ranges."""
    path = table_path(spark, "media")
    store(documents(spark, sf_dir), path)
    return features(load(spark, path))
