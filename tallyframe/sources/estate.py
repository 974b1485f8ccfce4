"""Members of an estate: reading, decoding, copy closure, answers of an estate client, and parsing to fact tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.settle import settled
from ..plans.facts import SCHEMAS, program_facts
from ..plans.parse import parse_programs
from ..plans.source_text import copy_members, detect_format, member_format

JCL = r"(?m)^//[A-Z$#@][A-Z0-9$#@]{0,7}\s+(JOB|PROC)\b"
#: File suffix -> type of member.
SUFFIXES = {"cbl": "cobol", "cob": "cobol", "cpy": "copybook", "asm": "asm", "ddl": "ddl", "jcl": "jcl", "prc": "proc", "bms": "bms", "csd": "csd", "cntl": "cntl"}


def decode_member(raw: bytes) -> str:
    """UTF-8, else latin-1."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """name, type, text of every file under path; text that looks like a job is type jcl."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def decode(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"path": b.column("path"), "text": pa.array([decode_member(x) for x in b.column("content").to_pylist()], pa.string())})

    rows = raw.mapInArrow(decode, "path string, text string")
    file = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split(file, r"\."), -1))
    kind = F.coalesce(*(F.when(suffix == s, F.lit(t)) for s, t in SUFFIXES.items()))
    return rows.select(F.upper(F.regexp_replace(file, r"\.[^.]*$", "")).alias("name"), F.when(F.col("text").rlike(JCL), "jcl").otherwise(kind).alias("type"), "text")


def copy_refs(texts: DataFrame, as_members: bool = False) -> DataFrame:
    """texts (name, text): one row (name, form, member, ordinal) for each member that a text copies.

    A program is read in its own format. A member is read in the format of the program that copies it, which is not known here, so it is read in both.
    """
    def refs(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for n, t in zip(b.column("name").to_pylist(), b.column("text").to_pylist()):
                t = t or ""
                for form, own in [(f, member_format(t, f)) for f in ("fixed", "free")] if as_members else [(detect_format(t)[0],) * 2]:
                    rows += [(n, form, own, m, i) for i, m in enumerate(copy_members(t, own))]
            kinds = {"ordinal": pa.int32()}
            names = ("name", "form", "own_form", "member", "ordinal")
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], kinds.get(k, pa.string())) for i, k in enumerate(names)})

    return texts.select("name", "text").mapInArrow(refs, "name string, form string, own_form string, member string, ordinal int")


def copy_closure(programs: DataFrame, members: DataFrame) -> DataFrame:
    """(source, member, level, via, status): every member that each program copies, directly or through members, level by level.

    Each member is scanned for its own references once; a level is one equi-join, and levels go on until nothing new is found.
    """
    inner = settled(copy_refs(members, as_members=True).select(F.col("name").alias("via"), "form", F.col("own_form").alias("inner_form"), "member").distinct())
    start = copy_refs(programs).groupBy(F.col("name").alias("source"), "member").agg(F.first("form").alias("form"))
    wave = settled(start.select("source", "member", "form", F.lit(0).alias("level"), F.lit(None).cast("string").alias("via")))
    seen = wave
    for level in count(1):  # ends: a source has each member once
        more = wave.select("source", F.col("member").alias("via"), "form").join(inner, ["via", "form"])
        more = more.groupBy("source", "member").agg(F.min(F.struct("via", "inner_form")).alias("r"))
        more = more.select("source", "member", F.col("r.inner_form").alias("form"), F.lit(level).alias("level"), F.col("r.via").alias("via"))
        wave = settled(more.join(seen.select("source", "member"), ["source", "member"], "left_anti"))
        if wave.isEmpty():
            break
        seen = seen.unionByName(wave)
        if level % 16 == 0:
            seen = settled(seen)
    have = members.select(F.col("name").alias("member"), F.lit("found").alias("status")).dropDuplicates(["member"])
    return seen.join(have, "member", "left").select("source", "member", "level", "via", F.coalesce("status", F.lit("missing")).alias("status"))


def resolve_members(members: DataFrame, paths: list[str] | None = None, suffixes: tuple = ("cpy", "cbl", "cob", "")) -> DataFrame:
    """One text for each name among members (name, text, and where known: origin `store`, `cache`, `path` or `client`; path; suffix).

    The store wins over the cache, then come the search paths in their order and in each the suffixes in theirs, and last an estate client's answer. `alternatives` counts
    the texts that were passed over.
    """
    for c in ("origin", "path", "suffix"):
        if c not in members.columns:
            members = members.withColumn(c, F.lit(None).cast("string"))
    place = lambda column, known: F.coalesce(*(F.when(F.col(column) == v, F.lit(i)) for i, v in enumerate(known)), F.lit(len(known)))
    rank = F.struct(
        place("origin", ("store", "cache", "path", "client")).alias("a"), (place("path", paths) if paths else F.lit(0)).alias("b"),
        place("suffix", suffixes).alias("c"), F.coalesce("path", F.lit("")).alias("d"), F.xxhash64("text").alias("e"),
    )
    if paths:  # a path that is not searched has nothing to offer
        members = members.where(F.coalesce(F.col("origin") != "path", F.lit(True)) | F.col("path").isin(*paths))
    best = F.min_by(F.struct("text", "origin", "path"), rank).alias("m")
    return members.groupBy(F.upper("name").alias("name")).agg(best, (F.count(F.lit(1)) - 1).alias("alternatives")).select("name", "m.*", "alternatives")


def parse_estate(programs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """programs (name, text): fact rows (source, program, fact, ordinal, body); body is JSON of the fact's schema.

    Each program meets the members of its own closure, and is parsed in one Python pass; programs that cannot be read give a flag row.
    """
    spark = programs.sparkSession
    members = spark.createDataFrame([], "name string, text string") if members is None else members.withColumn("name", F.upper("name"))
    closure = copy_closure(programs, members).where("status = 'found'")
    texts = closure.join(resolve_members(members).select(F.col("name").alias("member"), "text"), "member").groupBy(F.col("source").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("member", "text"))).alias("members"))
    rows = programs.select("name", "text").join(texts, "name", "left")

    def parse(batches):
        import pyarrow as pa

        for b in batches:
            out = {k: [] for k in ("source", "program", "fact", "ordinal", "body")}

            def add(source, program, fact, n, body):
                for k, v in zip(out, (source, program, fact, n, json.dumps(body, default=str))):
                    out[k].append(v)

            for name, text, found in zip(b.column("name").to_pylist(), b.column("text").to_pylist(), b.column("members").to_pylist()):
                try:
                    for p in parse_programs(text or "", dict(found or []), name):
                        for n, (fact, body) in enumerate(program_facts(p, name)):
                            add(name, p.name, fact, n, body)
                except Exception as e:  # noqa: BLE001  one unreadable program must not stop an estate
                    add(name, name, "flag", 0, {"paragraph": None, "line": None, "message": f"program was not read: {type(e).__name__}: {e}"})
            kinds = {"ordinal": pa.int32()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    return rows.mapInArrow(parse, "source string, program string, fact string, ordinal int, body string")


def fact_table(facts: DataFrame, name: str) -> DataFrame:
    """One typed fact table: program, ordinal and the columns of facts.SCHEMAS."""
    body = F.from_json("body", SCHEMAS[name]).alias("b")
    return facts.where(F.col("fact") == name).select("program", "ordinal", body).select("program", "ordinal", "b.*")


# estate clients and bundles

#: What an estate client said of one request.
OUTCOMES = ("found", "found-as-other-type", "alternatives", "absent", "error")


def ask(client: Callable, name: str, kind: str) -> dict:
    """One answer of a client(name, type): text, a dict (text, type, alternatives), a list of alternatives, or None. A raising client is an error, not an absence."""
    row = {"name": name, "type": kind, "outcome": "absent", "found_type": None, "text": None, "alternatives": [], "reason": None}
    try:
        got = client(name, kind)
    except Exception as e:  # noqa: BLE001
        return row | {"outcome": "error", "reason": f"{type(e).__name__}: {e}"}
    if got is None:
        return row
    if isinstance(got, bytes):
        got = decode_member(got)
    if isinstance(got, str):
        return row | {"outcome": "found", "found_type": kind, "text": got}
    if isinstance(got, (list, tuple)):
        return row | {"outcome": "alternatives", "alternatives": [str(x) for x in got]}
    found = got.get("type") or kind
    if got.get("text") is None:
        return row | {"outcome": "alternatives" if got.get("alternatives") else "absent", "alternatives": list(got.get("alternatives") or [])}
    return row | {"outcome": "found" if found == kind else "found-as-other-type", "found_type": found, "text": got["text"], "alternatives": list(got.get("alternatives") or [])}


ANSWER = "name string, type string, outcome string, found_type string, text string, alternatives array<string>, reason string"


def ask_again(client: Callable, name: str, kind: str, tries: int, wait: float) -> dict:
    """ask(), up to `tries` times while the client raises, each time after a wait twice as long."""
    import time

    for i in range(tries):
        row = ask(client, name, kind)
        if row["outcome"] != "error" or i + 1 == tries:
            return row
        time.sleep(wait * 2**i)


def retrieve(plan: DataFrame, client: Callable, jobs: int = 8, tries: int = 1, wait: float = 0.1) -> DataFrame:
    """plan (name, types array in order of likelihood, and if wanted place): answers, each name asked once, type by type until one is found.

    Requests run in the plan's partitions, `jobs` at a time in each task; the client is shipped to the executors. Answers come in the order of place (by name where places are
    equal or there are none), whichever request is done first, and no more than `jobs` requests are ahead of the one whose answer is due. A client that raises is asked
    again up to `tries` times; its last failure is an `error` row.
    """
    place = F.col("place") if "place" in plan.columns else F.lit(0)
    wanted = plan.groupBy("name").agg(F.min_by("types", F.struct(place, "types")).alias("types"), F.min(place).alias("place")).orderBy("place", "name").select("name", "types")

    def one(name, types):
        last = None
        for t in types or ():
            last = ask_again(client, name, t, tries, wait)
            if last["outcome"] in ("found", "found-as-other-type", "alternatives"):
                break
        return last

    def run(batches):
        from collections import deque
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        names = [c.split()[0] for c in ANSWER.split(", ")]
        kinds = {"alternatives": pa.list_(pa.string())}
        with ThreadPoolExecutor(jobs) as pool:
            for b in batches:
                rows, ahead = [], deque()
                for name, types in zip(b.column("name").to_pylist(), b.column("types").to_pylist()):
                    if len(ahead) == jobs:
                        rows.append(ahead.popleft().result())
                    ahead.append(pool.submit(one, name, types))
                rows += [f.result() for f in ahead]
                rows = [r for r in rows if r is not None]
                yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names})

    return wanted.mapInArrow(run, ANSWER)


def write_bundle(answers: DataFrame, path: str) -> None:
    """Appends answers to a bundle; replay() reads it in place of the client."""
    answers.withColumn("asked_at", F.current_timestamp()).write.mode("append").parquet(path)


def replay(spark: SparkSession, path: str, plan: DataFrame, strict: bool = False) -> DataFrame:
    """The bundle's latest answer for each (name, type) of the plan; what was never asked comes back as `not-recorded`, not as absent.

    plan has name and type, or name alone for whatever types were asked. With strict, a question that is not recorded raises.
    """
    key = ["name", "type"] if "type" in plan.columns else ["name"]
    w = Window.partitionBy("name", "type").orderBy(F.col("asked_at").desc(), "outcome")
    said = spark.read.parquet(path).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "asked_at")
    out = plan.select(*key).distinct().join(said, key, "left").withColumn("outcome", F.coalesce("outcome", F.lit("not-recorded")))
    if strict:
        lost = out.where("outcome = 'not-recorded'").select(*key).first()
        if lost is not None:
            raise KeyError(f"the bundle has no answer for {' '.join(map(str, lost))}")
    return out
