"""Data source "record_file": files of fixed-length records, or of records that carry their length, split at record boundaries.

Form F: records of `size` bytes one after another; any multiple of size is a boundary. Form V: before each record four bytes, its length with these four (big
endian, two bytes) and two zeros. Such a file cannot be entered in the middle, so the writer leaves the offset of about every `step` bytes' first record
beside it, and a split begins at one of those; a file without them is one split. Files are named by attempt and a manifest is written when the job commits.
"""

from __future__ import annotations

import json
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MOST = 32_760 - 4  # bytes of a record of form V, without its length


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Files(WriterCommitMessage):
    def __init__(self, files):
        self.files = files  # (name, bytes, offsets where splits may begin)


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str, form: str, size: int, step: int):
        self.path, self.form, self.size, self.step = path, form, size, step

    def write(self, batches):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        name, out, at, marks = f"{uuid.uuid4().hex}.rec", None, 0, [0]
        for batch in batches:
            for raw in batch.column("record").to_pylist():
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}")
                if self.form == "F":
                    if raw is None or len(raw) != self.size:
                        raise ValueError(f"a record of {len(raw or b'')} bytes in a file of {self.size}-byte records")
                else:
                    if raw is None or len(raw) > MOST:
                        raise ValueError(f"a record of {len(raw or b'')} bytes cannot carry its length")
                    if at - marks[-1] >= self.step:
                        marks.append(at)
                    raw = struct.pack(">HH", len(raw) + 4, 0) + raw
                out.write(raw)
                at += len(raw)
        if out is None:
            return _Files([])
        out.close()
        return _Files([(name, at, marks)])

    def commit(self, messages):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{root}/{uuid.uuid4().hex}.manifest") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, root = _fs(self.path)
        for m in messages:
            for name, *_ in m.files if m is not None else ():
                try:
                    fs.delete_file(f"{root}/{name}")
                except OSError:
                    pass


class _Split(InputPartition):
    def __init__(self, name, lo, hi):
        self.name, self.lo, self.hi = name, lo, hi


class RecordReader(DataSourceReader):
    def __init__(self, path: str, form: str, size: int, split: int):
        self.path, self.form, self.size, self.split = path, form, size, split

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, root = _fs(self.path)
        found = [f for f in fs.get_file_info(FileSelector(root)) if f.type == FileType.File]
        manifests = sorted(f.path for f in found if f.path.endswith(".manifest"))
        if manifests:
            files = []
            for m in manifests:
                with fs.open_input_stream(m) as f:
                    files += json.loads(f.read())
        else:  # files from elsewhere
            files = [(f.base_name, f.size, [0]) for f in sorted(found, key=lambda f: f.path)]
        out = []
        for name, size, marks in files:
            if self.form == "F":
                if size % self.size:
                    raise ValueError(f"{name}: {size} bytes are no whole number of {self.size}-byte records")
                cuts = list(range(0, size, max(1, self.split // self.size) * self.size)) or [0]
            else:
                cuts = [0]
                for m in marks:
                    if m - cuts[-1] >= self.split:
                        cuts.append(m)
            out += [_Split(name, lo, hi) for lo, hi in zip(cuts, [*cuts[1:], size])]
        return out or [_Split("", 0, 0)]

    def read(self, part):
        if not part.name:
            return
        fs, root = _fs(self.path)
        at, rest = part.lo, b""
        with fs.open_input_file(f"{root}/{part.name}") as f:
            while at < part.hi:
                rest += f.read_at(min(1 << 20, part.hi - at - len(rest)), at + len(rest))
                records, offsets, used = [], [], 0
                while True:
                    head, n = (0, self.size) if self.form == "F" else (4, self._length(rest, used, part.name, at) - 4)
                    if n is None or n < 0 or used + head + n > len(rest):
                        break
                    records.append(rest[used + head : used + head + n])
                    offsets.append(at + used)
                    used += head + n
                if not used:
                    raise ValueError(f"{part.name}: the record at {at} ends beyond the file")
                yield pa.RecordBatch.from_arrays([pa.array([part.name] * len(records)), pa.array(offsets, pa.int64()), pa.array(records, pa.binary())], names=["file", "at", "record"])
                at, rest = at + used, rest[used:]

    @staticmethod
    def _length(raw: bytes, used: int, name: str, at: int) -> int:
        if used + 4 > len(raw):
            return 0
        n, zero = struct.unpack_from(">HH", raw, used)
        if n < 4 or zero:
            raise ValueError(f"{name}: no record length at {at + used}")
        return n


class RecordFile(DataSource):
    """Columns file, at (the record's offset: its order in the file), record. Options: form (F or V), size, split_kb; writing takes record, and step_kb."""

    @classmethod
    def name(cls):
        return "record_file"

    def schema(self):
        return "file string, at long, record binary"

    def _form(self):
        form, size = self.options.get("form", "V").upper(), int(self.options.get("size", 0))
        if form not in ("F", "V") or form == "F" and size < 1:
            raise ValueError("form is F, with a size, or V")
        return form, size

    def reader(self, schema):
        return RecordReader(self.options["path"], *self._form(), int(float(self.options.get("split_kb", 65_536)) * 1024))

    def writer(self, schema, overwrite):
        return RecordWriter(self.options["path"], *self._form(), int(float(self.options.get("step_kb", 1024)) * 1024))


def write(df: DataFrame, record: str, path: str, **options) -> None:
    """Adds the records of df to the files under path. A null record, and one that does not fit the form, raises; an empty table leaves an empty directory."""
    df.sparkSession.dataSource.register(RecordFile)
    df.selectExpr("cast(null as string) as file", "cast(null as long) as at", f"`{record}` as record").write.format("record_file").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(RecordFile)
    return spark.read.format("record_file").options(**options).load(path)
