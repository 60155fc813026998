"""Validation logs of both dialects (SRC25-SRC27, PRJ18, AG15-AG17, EV13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import clean_message, severity_tag


def processor_hits(lines: DataFrame) -> DataFrame:
    """SRC25, SRC26: (line_no, id, message, rule_url, lines) of `[message:id] text - file line, line, url` lines (line_no, value)."""
    numbers = F.transform(F.regexp_extract_all(F.regexp_extract("value", r"\s-\s\S+((?:\s+[0-9]+,?)+)", 1), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    return lines.where(F.col("value").rlike(r"^\[message:")).select("line_no", F.regexp_extract("value", r"^\[message:([^\]]+)\]", 1).alias("id"), clean_message(F.regexp_replace("value", r"^\[message:[^\]]+\]\s*", "")).alias("message"), F.nullif(F.regexp_extract("value", r"(https?://\S+)", 1), F.lit("")).alias("rule_url"), numbers.alias("lines"))


def portal_hits(lines: DataFrame, by: str = "file") -> DataFrame:
    """SRC27: a header line names the id, the line after it the details: (line_no, id, detail, severity, tables, zero). Lines are numbered without gaps
    within each file; a header is joined to the next number, so that a file of any length is no single task's."""
    head = r"AssertionUnsatisfied\.(\S+)"
    after = lines.select(by, (F.col("line_no") - 1).alias("line_no"), F.col("value").alias("detail"))
    seen = lines.where(F.col("value").rlike(head)).join(after, [by, "line_no"], "left")
    return seen.select(
        by, "line_no", F.regexp_extract("value", head, 1).alias("id"), "detail", severity_tag(F.col("detail")).alias("severity"),
        F.array_distinct(F.regexp_extract_all("detail", F.lit(r"\b([A-Z]{1,3}[0-9]{1,3}(?:\.[0-9]{2})+)\b"), F.lit(1))).alias("tables"), F.coalesce(F.col("detail").rlike(r"reported as 0\s*="), F.lit(False)).alias("zero"),
    )


def report(hits: DataFrame) -> DataFrame:
    """AG16, EV13: for each id its count and the message of its first line."""
    return hits.groupBy("id").agg(F.count("*").alias("n"), F.min_by("message", "line_no").alias("message"))


def family(tables: Column, families: list[tuple[str, str]], other: str = "other") -> Column:
    """AG17: the first family whose pattern fits one of the tables."""
    out = None
    for name, pattern in families:
        hit = _any_like(tables, pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(other) if out is None else out.otherwise(other)


def _any_like(tables: Column, pattern: str) -> Column:
    return F.exists(tables, lambda t: t.rlike(pattern))
