"""Whole-estate entry points: analyse program texts, gather what they need, write the views."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.settle import settled
from .plans import views
from .sources import estate

VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "dictionary": views.data_dictionary, "layout": views.record_layout, "endpoints": views.endpoints, "perimeter": views.perimeter, "constants": views.constants, "calls": views.calls, "artifacts": views.artifacts,
    "dynamic-calls": views.dynamic_calls, "lineage": views.lineage, "business": views.business_rules, "states": lambda f: estate.fact_table(f, "state"), "edges": lambda f: estate.fact_table(f, "edge"),
    "statements": lambda f: estate.fact_table(f, "statement"), "flags": lambda f: estate.fact_table(f, "flag"), "sql-columns": lambda f: estate.fact_table(f, "sql_column"), "fetch-plan": views.fetch_plan, "callers": views.callers, "graph": views.graph_edges,
}


@dataclass
class Analysis:
    """Fact rows of an estate and the views over them."""

    facts: DataFrame

    def view(self, name: str) -> DataFrame:
        return VIEWS[name](self.facts)

    def write(self, path: str, names: list[str] | None = None, fmt: str = "json") -> None:
        """Each view under path/<view>/, partitioned by program."""
        for name in names or VIEWS:
            df = self.view(name)
            writer = df.write.mode("overwrite")
            key = next((c for c in ("program", "caller") if c in df.columns), None)
            (writer.partitionBy(key) if key else writer).format(fmt).save(f"{path}/{name}")

    def document(self, name: str, program: str) -> str:
        """One program's rows of a view as one JSON document, in a fixed order."""
        rows = self.view(name)
        if "program" in rows.columns:
            rows = rows.where(F.col("program") == program)
        return json.dumps(sorted((json.loads(r) for r in rows.toJSON().collect()), key=lambda r: json.dumps(r, sort_keys=True)), indent=1, sort_keys=True)


def analyze(programs: DataFrame, members: DataFrame | None = None, path: str | None = None) -> Analysis:
    """programs and members as (name, text); each program is parsed once and its facts are kept in the shared folder.

    With a path they are kept there, partitioned by fact, so that a view reads only the facts it needs.
    """
    facts = estate.parse_estate(programs, members)
    if path is None:
        return Analysis(settled(facts))
    facts.write.mode("overwrite").partitionBy("fact").parquet(path)
    return Analysis(programs.sparkSession.read.parquet(path))


def analyze_path(spark: SparkSession, path: str) -> Analysis:
    """All programs under a path, with its copybooks as members."""
    found = estate.read_members(spark, path)
    return analyze(found.where("type = 'cobol'").select("name", "text"), found.where("type = 'copybook'").select("name", "text"))


def gather(programs: DataFrame, client: Callable, path: str, members: DataFrame | None = None) -> DataFrame:
    """Asks an estate client for everything the programs need and does not have, and appends the answers to a bundle. Returns the plan."""
    have = programs.select("name") if members is None else programs.select("name").unionByName(members.select("name"))
    plan = views.fetch_plan(analyze(programs, members).facts, have)
    estate.write_bundle(estate.retrieve(plan.where("status = 'planned'").select("name", "types"), client), path)
    return plan
