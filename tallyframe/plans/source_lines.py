"""Program text to logical lines as columns: source format, comments, continuation. The rules of source_text.logical_lines() for whole programs, with no Python worker.

Lines come from posexplode; whether a division has begun is a running maximum, the line that a continuation belongs to a running count, and continued
text is put together by an ordered aggregate over the few lines of one statement line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Patterns of the language, as in source_text.
DIVISION = r"(?i)\b(IDENTIFICATION|ID|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b"
DIRECTIVE = r"(?i)^\s*(?:>>\s*SOURCE|\$SET\s+SOURCEFORMAT)\b.*?\b(FREE|FIXED)\b"
OPTIONS = r"(?i)^\s*(?:CBL|PROCESS)(?![\w-])"
LISTING = r"(?i)^\s*(?:(?:EJECT|SKIP[123])|TITLE\s+(?:'[^']*'|\"[^\"]*\"))\s*\.?\s*$"
QUOTED = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\""
BREAKS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"
MARKS = " */-Dd$"


def _tabs(text: Column) -> Column:
    """Tabs as spaces to the next of columns 9, 17, 25 ..."""
    parts = F.split(text, "\t")
    rest = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    return F.aggregate(rest, F.element_at(parts, 1), lambda a, x: F.concat(F.rpad(a, (F.floor(F.length(a) / 8) + 1).cast("int") * 8, " "), x))


def _blank(c: Column) -> Column:
    return ~c.rlike(r"[^\s\x1c-\x1f\x85\xa0]")


def physical(programs: DataFrame) -> DataFrame:
    """programs (name, text): (name, line, raw), one row a line that is not blank; lines count from 1."""
    rows = programs.select("name", F.posexplode(F.split(F.coalesce("text", F.lit("")), BREAKS)).alias("n", "raw"))
    return rows.select("name", (F.col("n") + 1).alias("line"), "raw").where(~_blank(F.col("raw")))


def formats(lines: DataFrame) -> DataFrame:
    """(name, form, confidence) of each program from the strongest of five signals: a directive on one of the first 50 lines, column 7 clean, the column of the first
    division header, a line beyond 80 columns, the share of lines with text in column 7."""
    first = F.row_number().over(Window.partitionBy("name").orderBy("line"))
    said = F.lower(F.regexp_extract("raw", DIRECTIVE, 1))
    mark = F.substring(F.rpad("raw", 7, " "), 7, 1)
    start = F.length(F.regexp_extract("raw", r"(?i)^(.*?)\b(?:IDENTIFICATION|ID|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b", 1))
    where = F.when(F.col("raw").rlike(DIVISION) & ((start == 7) | (start < 4)), F.when(start == 7, "fixed").otherwise("free"))
    rows = lines.withColumns({"nth": first, "said": said, "bad": (~F.lit(MARKS).contains(mark)).cast("int"), "header": where, "long": F.length(F.regexp_replace("raw", r"\s+$", "")) > 80})
    told = rows.groupBy("name").agg(
        F.min_by("said", F.when((F.col("nth") <= 50) & (F.col("said") != ""), F.col("line"))).alias("said"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"),
        F.min_by("header", F.when(F.col("header").isNotNull(), F.col("line"))).alias("header"), F.max("long").alias("long"),
    )
    part = F.col("bad") / F.col("n")
    signals = (
        (F.col("said").isNotNull(), F.col("said"), F.lit(1.0)), (F.col("bad") == 0, F.lit("fixed"), F.lit(0.97)), (F.col("header").isNotNull(), F.col("header"), F.lit(0.95)),
        (F.col("long"), F.lit("free"), F.lit(0.85)), (part >= 0.15, F.lit("free"), F.least(F.lit(0.9), part + 0.6)),
    )
    form, confidence = F.lit("fixed"), F.lit(0.6)
    for test, f, c in reversed(signals):
        form, confidence = F.when(test, f).otherwise(form), F.when(test, c).otherwise(confidence)
    return told.select("name", form.alias("form"), confidence.alias("confidence"))


def logical(programs: DataFrame) -> DataFrame:
    """programs (name, text): (name, line, text) of code lines without comments, continued ones joined to the line they continue.

    Null and empty texts give no lines; names are taken to be distinct; a line's row is one task's work, a program's lines are one window.
    """
    lines = physical(programs)
    rows = lines.join(formats(lines), "name").withColumn("raw", _tabs(F.regexp_replace("raw", r"[\r\n]+$", "")))
    so_far = Window.partitionBy("name").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.where(~F.col("raw").rlike(DIRECTIVE)).withColumn("has", F.col("raw").rlike(DIVISION))
    before = F.coalesce(F.max("has").over(so_far), F.lit(False))
    # an option line in front of all divisions is none of the program's, whatever it says
    rows = rows.withColumn("before", before).where(~F.col("raw").rlike(OPTIONS) | F.col("before")).withColumn("inside", F.col("before") | F.col("has"))
    fixed = F.col("form") == "fixed"
    mark = F.when(fixed, F.substring("raw", 7, 1)).otherwise(F.when(F.ltrim("raw").startswith("*") & ~F.ltrim("raw").startswith("*>"), "*").otherwise(" "))
    body = F.when(fixed, F.substring("raw", 8, 65)).otherwise(F.col("raw"))
    rows = rows.select("name", "line", "inside", mark.alias("mark"), body.alias("body"), (fixed & (mark == "-")).alias("continues")).where("mark not in ('*', '/', 'D', 'd')")
    rows = rows.withColumn("code", F.regexp_extract("body", rf"^((?:{QUOTED}|(?!\*>).)*)", 1))
    keeps = ~_blank(F.col("code")) & ~F.col("code").rlike(LISTING) & (F.col("inside") | ~F.col("code").rlike(OPTIONS))
    rows = rows.withColumn("keeps", keeps & ~F.col("continues"))
    # a continuation with nothing before it is a line of its own
    lone = F.col("continues") & keeps & (F.coalesce(F.max((F.col("keeps")).cast("int")).over(so_far), F.lit(0)) == 0)
    rows = rows.withColumn("lone", lone)
    first_lone = F.col("lone") & (F.coalesce(F.max(F.col("lone").cast("int")).over(so_far), F.lit(0)) == 0)
    rows = rows.withColumn("starts", F.col("keeps") | first_lone).where("starts or continues")
    group = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("name").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("group", group).where("group > 0")
    parts = rows.groupBy("name", "group").agg(
        F.min(F.when(F.col("starts"), F.col("line"))).alias("line"), F.max(F.when(F.col("starts"), F.col("code"))).alias("code"),
        F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("line", "body")))).alias("more"),
    )

    def joined(text: Column, more: Column) -> Column:
        left = F.regexp_replace(text, QUOTED, "")
        odd = lambda q: (F.length(left) - F.length(F.replace(left, F.lit(q), F.lit("")))) % 2 == 1
        quote = F.when(odd("'"), "'").when(odd('"'), '"')
        add = F.regexp_replace(more, r"^\s+", "")
        opened = F.concat(F.rpad(text, F.greatest(F.length(text), F.lit(65)), " "), F.when(F.substring(add, 1, 1) == quote, F.substring(add, F.lit(2), F.length(add))).otherwise(add))
        return F.when(quote.isNull(), F.concat(F.regexp_replace(text, r"\s+$", ""), add)).otherwise(opened)

    return parts.select("name", "line", F.aggregate("more", F.col("code"), lambda a, x: joined(a, x["body"])).alias("text"))
