"""Names and keys that give facts their identity (PRJ1-PRJ6, PRJ13, PRJ14, PRJ17, PRJ19, PRJ20, SNK4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clark(qname: Column, namespaces: Column) -> Column:
    """PRJ1: prefix:local to {namespace}local by a prefix map; names without a known prefix stay."""
    prefix, local = F.substring_index(qname, ":", 1), F.substring_index(qname, ":", -1)
    space = F.try_element_at(namespaces, F.when(qname.contains(":"), prefix).otherwise(F.lit("")))
    return F.when(qname.startswith("{") | space.isNull(), qname).otherwise(F.concat(F.lit("{"), space, F.lit("}"), local))


def local_name(name: Column, peel: tuple[str, ...] = ()) -> Column:
    """PRJ2: the name without namespace or prefix; leading owner prefixes in `peel` are taken off as often as they come."""
    bare = F.substring_index(F.substring_index(name, "}", -1), ":", -1)
    if not peel:
        return bare
    return F.regexp_replace(bare, "^(?:" + "|".join(sorted(peel, key=len, reverse=True)) + ")+", "")


def qualified_member(name: Column, peel: tuple[str, ...] = ()) -> Column:
    """PRJ3: DOMAIN:member, as member codes repeat across domains."""
    return F.when(name.contains(":"), F.concat(local_name(F.substring_index(name, ":", 1), peel), F.lit(":"), F.substring_index(name, ":", -1))).otherwise(name)


def domain_of(member: Column) -> Column:
    """PRJ14: the domain part of a member's qualified name; null without one."""
    return F.when(member.contains(":"), F.substring_index(member, ":", 1))


def without_defaults(dims: Column, defaults: Column) -> Column:
    """PRJ4: dimensions that hold their default member are left out."""
    return F.map_filter(dims, lambda d, m: ~m.eqNullSafe(F.try_element_at(defaults, d)))


def dim_key(dims: Column, defaults: Column | None = None) -> Column:
    """PRJ5: dim=member pairs sorted by dimension, defaults left out. Maps can't be joined on; this string can."""
    kept = without_defaults(dims, defaults) if defaults is not None else dims
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def cell_key(concept: Column, dims: Column, defaults: Column | None = None) -> Column:
    """PRJ5: concept|dim=member,..."""
    return F.concat(concept, F.lit("|"), dim_key(dims, defaults))


def merge_aspects(base: Column, over: Column) -> Column:
    """PRJ6: the later axis wins for each dimension. Independent of spark.sql.mapKeyDedupPolicy."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def table_family(code: Column) -> Column:
    """PRJ13: the first two segments."""
    return F.substring_index(code, ".", 2)


def template_of(code: Column) -> Column:
    """SNK4: a table code of more than three segments without its last one."""
    n = F.size(F.split(code, r"\."))
    return F.when(n > 3, F.array_join(F.slice(F.split(code, r"\."), F.lit(1), n - 1), ".")).otherwise(code)


# Fixed value: the form of a table code (PRJ17): one to three letters, two or three digits, and dotted pairs of digits.
TABLE_CODE = r"[A-Z]{1,3}[0-9]{2,3}(?:\.[0-9]{2})+"


def is_table_code(code: Column) -> Column:
    """PRJ17."""
    return code.rlike(f"^{TABLE_CODE}$")


def table_refs(expression: Column) -> Column:
    """PRJ17: distinct table codes that `t:` keys of an expression name."""
    return F.array_distinct(F.regexp_extract_all(expression, F.lit(rf"t:\s*({TABLE_CODE})"), F.lit(1)))


def url_to_path(url: Column, root: str = "") -> Column:
    """PRJ19: an http(s) address as a path below root."""
    return F.concat(F.lit(root), F.regexp_replace(url, r"^https?://", ""))


def compare_text(text: Column) -> Column:
    """PRJ20: white space collapsed, case folded."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
