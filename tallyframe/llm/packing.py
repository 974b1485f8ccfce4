"""Packing documents into fixed windows of tokens: bounded-space online best fit, with one merge of the leftovers.

Each partition of the scan tokenizes its documents and keeps `open_windows` windows open. A document's tokens fill whole
windows first; the rest goes to the open window it fits most tightly. When none fits, the fullest window is emitted; if more
than `slack` places of it are free, the new piece is cut to fill them. What stays open at the end of a partition goes, with its
ids, to one of a number of merge tasks (`merge_every` partitions each), which concatenates and cuts the leftovers; the merge's last
window is split at powers of two, which need no padding. Pieces are written once to the shared folder, so nothing is
tokenized twice.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, documents, small_batches

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences of one task are numbered from task * 2**STEP.
STEP = 36
#: Merge tasks number their sequences from here on.
MERGED = 1 << 62


class WordTokens(dict):
    """Run of text without white space -> its token ids as little-endian 32-bit words; remembered up to a bound.

    Valid for tokenizers that drop white space and never join across it. str.split() also splits at \\x1c-\\x1f, which such a
    tokenizer keeps as text, so texts with these go through whole. Runs of ASCII and Latin-1 letters take a faster encoder
    when the file describes byte-level BPE with word ends: the same merges, with the word's end written as byte 255 (which no UTF-8 text
    holds). All else goes to the tokenizer itself.
    """

    limit = 400_000
    #: The pre-tokenizer whose words the fast way knows, and its form for lower-case ASCII and Latin-1.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = r"[!-~À-ÖØ-öø-ÿ]+"
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+"

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.core, self.pieces = None, {}
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if spec["model"].get("end_of_word_suffix") == "</w>" and split[0].get("pattern") == {"Regex": self.PATTERN} and steps == ["NFC", "Replace", "Lowercase"]:
            import tiktoken

            self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=self._ranks(spec), special_tokens={})._core_bpe
            self.plain, self.words = re.compile(self.PLAIN), re.compile(self.WORDS)

    @staticmethod
    def _ranks(spec) -> dict:
        """Byte strings of the vocabulary; the byte-level alphabet writes printable bytes as themselves and others from U+0100 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"] for t in spec["added_tokens"]}
        out = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                end = token.endswith("</w>")
                out[bytes(byte[c] for c in (token[:-4] if end else token)) + b"\xff" * end] = i
        out[b"\xff"] = max(spec["model"]["vocab"].values()) + 1  # never alone: it joins the byte before it first
        return out

    def __missing__(self, word: str) -> bytes:
        if self.core is not None and "<|" not in word and self.plain.fullmatch(word):
            found, pieces = [], self.pieces
            for piece in self.words.findall(word.lower()):
                ids = pieces.get(piece)
                if ids is None:
                    ids = array("I", self.core.encode_single_piece(piece.encode() + b"\xff")).tobytes()
                    if len(pieces) >= self.limit:
                        pieces.clear()
                    pieces[piece] = ids
                found.append(ids)
            ids = b"".join(found)
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def of(self, text: str, end: int) -> np.ndarray:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            ids = b"".join(map(self.__getitem__, text.split()))
        return np.frombuffer(ids + array("I", [end]).tobytes(), "<u4")


class Packer:
    """Open windows of one partition. emit(piece) gets (doc_id, start, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, size: int, open_windows: int, slack: int, first: int, emit):
        self.size, self.most, self.slack, self.next, self.emit = size, open_windows, slack, first, emit
        self.open: list[tuple[int, int]] = []  # (used, window), ascending
        self.pieces: dict[int, list] = {}
        self.made = 0

    def _close(self, window: int) -> None:
        at = 0
        for doc, start, ids, total in self.pieces.pop(window):
            self.emit((doc, start, ids, total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self.emit((doc, start, ids[start : start + self.size], total, self.next, 0))
            self.next += 1
            start += self.size
        while start < total:
            start += self._place(doc, start, ids[start:], total)

    def _place(self, doc: int, start: int, rest: np.ndarray, total: int) -> int:
        need = len(rest)
        at = bisect_left(self.open, (self.size - need + 1, -1)) - 1  # the fullest window with room
        if at >= 0:
            used, window = self.open.pop(at)
        elif len(self.open) < self.most:
            used, window = 0, self.made
            self.made += 1
            self.pieces[window] = []
        else:
            used, window = self.open.pop()
            room = self.size - used
            if room > self.slack:  # cut to fill it
                self.pieces[window].append((doc, start, rest[:room], total))
                need = room
            else:
                need = 0
            self._close(window)
            return need
        self.pieces[window].append((doc, start, rest, total))
        if used + need == self.size:
            self._close(window)
        else:
            insort(self.open, (used + need, window))
        return need

    def leftovers(self):
        for used, window in self.open:
            yield from self.pieces[window]


def _rows(pieces: list) -> dict:
    return {
        "doc_id": pa.array([p[0] for p in pieces], pa.int64()),
        "start": pa.array([p[1] for p in pieces], pa.int64()),
        "length": pa.array([len(p[2]) for p in pieces], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(p[2].tobytes()) for p in pieces], pa.int64()),
        "doc_tokens": pa.array([p[3] for p in pieces], pa.int64()),
        "sequence_id": pa.array([p[4] for p in pieces], pa.int64()),
        "offset": pa.array([p[5] for p in pieces], pa.int64()),
    }


def _pack_partition(path: str, size: int, open_windows: int, slack: int, end: int):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        tokens, done = WordTokens(path), []
        packer = Packer(size, open_windows, slack, task << STEP, done.append)
        none = pa.nulls(0, pa.binary())
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                packer.add(doc, tokens.of(text or "", end))
                if len(done) >= 5_000:
                    yield pa.RecordBatch.from_pydict(_rows(done) | {"ids": pa.nulls(len(done), pa.binary()), "task": pa.array([task] * len(done), pa.int32())})
                    done.clear()
        if done:
            yield pa.RecordBatch.from_pydict(_rows(done) | {"ids": pa.nulls(len(done), pa.binary()), "task": pa.array([task] * len(done), pa.int32())})
        left = [(*p, -1, 0) for p in packer.leftovers()]
        if left:
            yield pa.RecordBatch.from_pydict(_rows(left) | {"ids": pa.array([p[2].tobytes() for p in left], pa.binary()), "task": pa.array([task] * len(left), pa.int32())})

    return run


def _merge_partition(size: int):
    def run(batches):
        """Rows come sorted by group: concatenates a group's leftovers into full windows."""
        done, group, held, used, seq = [], None, [], 0, 0

        def close(pieces, seq):
            at = 0
            for doc, start, ids, total in pieces:
                done.append((doc, start, ids, total, seq, at))
                at += len(ids)

        def tail():
            """The last window, split where its size is a sum of powers of two."""
            nonlocal held, seq
            left = sum(len(p[2]) for p in held)
            while left:
                part = 1 << (left.bit_length() - 1)
                out, room = [], part
                while room:
                    doc, start, ids, total = held.pop(0)
                    out.append((doc, start, ids[:room], total))
                    if len(ids) > room:
                        held.insert(0, (doc, start + room, ids[room:], total))
                    room -= min(room, len(ids))
                close(out, seq)
                seq += 1
                left -= part

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("group", "doc_id", "start", "doc_tokens", "ids")]
            for g, doc, start, total, raw in zip(*cols):
                if g != group:
                    tail()
                    group, held, used, seq = g, [], 0, MERGED + (g << STEP)
                ids = np.frombuffer(raw, "<u4")
                while used + len(ids) >= size:
                    held.append((doc, start, ids[: size - used], total))
                    start, ids = start + size - used, ids[size - used :]
                    close(held, seq)
                    held, used, seq = [], 0, seq + 1
                if len(ids):
                    held.append((doc, start, ids, total))
                    used += len(ids)
            if done:
                yield pa.RecordBatch.from_pydict(_rows(done))
                done.clear()
        tail()
        if done:
            yield pa.RecordBatch.from_pydict(_rows(done))

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, open_windows: int = 64, slack: int = 16, merge_every: int = 16
) -> DataFrame:
    """Packs docs (doc_id, text) into windows of at most `size` tokens; one row per piece, schema PIECE.

    Null and empty texts are the end id alone. Very long texts are cut at window size. Repeated rows and repeated ids are
    packed once for each row. A null doc_id stays null. An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    pieces = docs.select("doc_id", "text").mapInArrow(
        _pack_partition(tokenizer_path, size, open_windows, slack, end_id), f"{PIECE}, ids binary, task int"
    )
    pieces = cut(pieces, "pieces")
    names = [c.split()[0] for c in PIECE.split(", ")]
    left = pieces.where("ids is not null").withColumn("group", F.expr(f"cast(floor(task / {int(merge_every)}) as long)"))
    merged = (
        left.select("group", *names, "ids", "task")
        .repartition("group")
        .sortWithinPartitions("group", "task", "doc_id", "start")
        .select("group", "doc_id", "start", "doc_tokens", "ids")
        .mapInArrow(_merge_partition(size), PIECE)
    )
    return pieces.where("ids is null").select(*names).unionByName(merged)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens of the public 49k word tokenizer."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
