"""Seeded, type-correct test data (GN1-GN6, GN8). Values are hashes of (key, seed): the same on any cluster and in any order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded(key: Column, seed: str, below: int) -> Column:
    """A whole number from 0 to below - 1."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{seed}")).cast("binary")), 1, 8), 16, 10).cast("bigint") % below


def value_of(datatype: Column, key: Column, seed: str, year: int = 2024, allowed: Column | None = None) -> Column:
    """GN2: text of a random value by datatype. Whole numbers and amounts from 1 to 9999, percentages as fractions, days of a year."""
    n = seeded(key, seed, 9999) + 1
    text = (
        F.when(datatype.isin("MONETARY"), (n * 1000).cast("string"))
        .when(datatype == "INTEGER", n.cast("string"))
        .when(datatype == "DECIMAL", (n / 100).cast("decimal(12,2)").cast("string"))
        .when(datatype == "PERCENTAGE", (n / 10000).cast("decimal(8,4)").cast("string"))
        .when(datatype == "BOOLEAN", F.when(n % 2 == 0, "true").otherwise("false"))
        .when(datatype == "DATE", F.date_add(F.lit(f"{year}-01-01").cast("date"), (n % 365).cast("int")).cast("string"))
    )
    if allowed is not None:
        text = text.when((datatype == "ENUMERATION") & (F.size(allowed) > 0), F.element_at(allowed, (n % F.size(allowed) + 1).cast("int")))
    return text.otherwise(F.concat(F.lit("S"), n.cast("string")))


def inferred_datatype(name: Column, text: Column, has_unit: Column) -> Column:
    """GN3: from a value's looks where none is declared."""
    return (
        F.when(text.isin("true", "false"), "BOOLEAN")
        .when(text.rlike(r"^[A-Za-z_][\w.-]*:[\w.-]+$"), "ENUMERATION")
        .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "DATE")
        .when(has_unit, "MONETARY")
        .otherwise("STRING")
    )


#: Characters more than the least that open lengths ({n,}, *, +) may have.
_OPEN = 3


def _classes(pattern: str) -> list[tuple[str, int, int]]:
    """The characters and the least and most number of them of each part of a ^[class]{n,m}...$ pattern."""
    out, rest = [], pattern.removeprefix("^").removesuffix("$")
    while rest:
        m = re.match(r"(?:\[([^\]]+)\]|(\\d)|([^\\\[\]{}()*+?|.]))(?:\{(\d+)(,)?(\d*)\}|([*+?]))?", rest)
        if not m:
            raise ValueError(f"pattern {pattern!r}")
        if m[1]:
            chars = re.sub(r"(.)-(.)", lambda r: "".join(map(chr, range(ord(r[1]), ord(r[2]) + 1))), m[1])
        else:
            chars = "0123456789" if m[2] else m[3]
        least = int(m[4]) if m[4] else {"*": 0, "?": 0}.get(m[7], 1)
        most = {"*": _OPEN, "+": 1 + _OPEN}.get(m[7], 1) if not m[4] else least if not m[5] else int(m[6]) if m[6] else least + _OPEN
        out.append((chars, least, most))
        rest = rest[m.end() :]
    return out


def matching_text(pattern: str, key: Column, seed: str) -> Column:
    """GN4: text that fits a pattern of character classes with lengths; of a range of lengths each is as likely."""
    parts, at = [], 0
    for chars, least, most in _classes(pattern):
        drawn = []
        for _ in range(most):
            drawn.append(F.substring(F.lit(chars), (seeded(F.concat(key, F.lit(f"#{at}")), seed, len(chars)) + 1).cast("int"), F.lit(1)))
            at += 1
        if not drawn:
            continue
        text = F.concat(*drawn)
        if least < most:
            text = F.substring(text, F.lit(1), (seeded(F.concat(key, F.lit(f"#n{at}")), seed, most - least + 1) + least).cast("int"))
        parts.append(text)
    return F.concat(*parts) if parts else F.lit("")


def enum_pools(facts: DataFrame) -> DataFrame:
    """GN5: members seen for each enumerated metric, sorted."""
    return facts.groupBy("concept").agg(F.array_sort(F.collect_set("value")).alias("pool"))


def clone(facts: DataFrame, metrics: DataFrame, seed: str, with_strings: bool = False) -> DataFrame:
    """GN1: the facts with new values by datatype (declared, else inferred); nil facts and, unless asked, strings are kept."""
    j = facts.join(metrics.select("concept", "datatype"), "concept", "left").join(enum_pools(facts.where(F.col("value").contains(":"))), "concept", "left")
    kind = F.coalesce("datatype", inferred_datatype(F.col("concept"), F.col("value"), F.col("unit").isNotNull()))
    keep = F.col("value").isNull() | ((kind == "STRING") & (not with_strings))
    new = value_of(kind, F.concat_ws("|", "concept", "dim_key"), seed, allowed=F.coalesce("pool", F.array().cast("array<string>")))
    return j.withColumn("value", F.when(keep, F.col("value")).otherwise(new)).drop("datatype", "pool")


def override(cells: DataFrame, values: DataFrame) -> DataFrame:
    """GN8: rule-driven values (key, rule_value) replace those of numeric cells only."""
    numeric = F.col("datatype").isin("MONETARY", "DECIMAL", "PERCENTAGE", "INTEGER")
    return cells.join(values, "key", "left").withColumn("value", F.when(numeric & F.col("rule_value").isNotNull(), F.col("rule_value").cast("string")).otherwise(F.col("value"))).drop("rule_value")
