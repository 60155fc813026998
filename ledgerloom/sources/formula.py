"""Formula rules from linkbase rows (SRC5, SRC8, SRC18, SRC19, FLT3): tables of rules, variables and filters.

The rows come from package.linkbases; everything here is a join on (path, role, label). Filters of a variable and of its
whole variable set come alike, the latter with a null variable. A boolean filter keeps its operator and members, so that a tree can be
compiled to one Column instead of an approximate union. Names come with their namespaces, as they do in instances.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSERTIONS = ("valueAssertion", "existenceAssertion", "consistencyAssertion")


def lean_rules(links: DataFrame) -> DataFrame:
    """SRC19: (path, rule, role, label, test, severity) of the assertions: nothing else of the file is needed. Severity: as the rule's resource says, else what its severity arc leads to, else error."""
    a = links.where("kind = 'resource'").where(F.col("tag").isin(*ASSERTIONS))
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    arcs = links.where("kind = 'arc' AND arcrole LIKE '%severity'").select("path", "role", F.col("source").alias("label"), "target")
    ends = links.where("kind = 'locator'").select("path", "role", F.col("label").alias("target"), F.lower(F.substring_index("href", "#", -1)).alias("_severity"))
    told = arcs.join(ends, ["path", "role", "target"]).groupBy("path", "role", "label").agg(F.min("_severity").alias("_severity"))
    a = a.select("path", F.coalesce("id", "label").alias("rule"), "role", "label", get("test").alias("test"), F.lower(get("severity")).alias("severity"))
    return a.join(told, ["path", "role", "label"], "left").select("path", "rule", "role", "label", "test", F.coalesce("severity", "_severity", F.lit("error")).alias("severity"))


def variables(links: DataFrame) -> DataFrame:
    """SRC18: (rule, var, fallback, sequence, role, path, label): the variables of each assertion by their arcs' names."""
    rules = lean_rules(links).select("path", "role", "rule", F.col("label").alias("source"))
    arcs = links.where("kind = 'arc' AND arcrole LIKE '%variable-set'").select("path", "role", "source", "target", F.try_element_at("attributes", F.lit("name")).alias("var"))
    res = links.where("kind = 'resource' AND tag = 'factVariable'").select("path", "role", F.col("label").alias("target"), F.try_element_at("attributes", F.lit("fallbackValue")).alias("fallback"), (F.try_element_at("attributes", F.lit("bindAsSequence")) == "true").alias("sequence"))
    j = rules.join(arcs, ["path", "role", "source"]).join(res, ["path", "role", "target"])
    return j.select("path", "role", "rule", "var", "fallback", F.coalesce("sequence", F.lit(False)).alias("sequence"), F.col("target").alias("label"))


def _resources(links: DataFrame) -> DataFrame:
    """(path, role, target, tag, dim, members, concepts) of filter resources."""
    under = lambda parent: F.transform(F.filter("parts", lambda p: p["text"].startswith(f"{parent}:")), lambda p: F.substring(p["text"], len(parent) + 2, 1 << 20))
    return links.where("kind = 'resource'").select(
        "path", "role", F.col("label").alias("target"), "tag",
        F.when(F.col("tag").isin("explicitDimension", "typedDimension"), F.get(under("dimension"), F.lit(0))).alias("dim"),
        F.when(F.col("tag") == "explicitDimension", under("member")).alias("members"), F.when(F.col("tag") == "conceptName", under("concept")).alias("concepts"),
    )


def _arcs(links: DataFrame, role: str) -> DataFrame:
    """(path, role, source, target, complement) of the arcs of a role."""
    return links.where("kind = 'arc'").where(F.col("arcrole").rlike(role)).select("path", "role", "source", "target", (F.coalesce(F.try_element_at("attributes", F.lit("complement")), F.lit("false")) == "true").alias("complement"))


def filters(links: DataFrame) -> DataFrame:
    """FLT3: (rule, var, tag, dim, members, concepts, complement): filters of variables, and of variable sets with var null. Boolean filters
    have their tag only; `trees` follows them to their members."""
    owners = variables(links).select("path", "role", "rule", "var", F.col("label").alias("source"))
    owners = owners.unionByName(lean_rules(links).select("path", "role", "rule", F.lit(None).cast("string").alias("var"), F.col("label").alias("source")))
    return owners.join(_arcs(links, "variable(-set)?-filter$"), ["path", "role", "source"]).join(_resources(links), ["path", "role", "target"])


@dataclass(frozen=True)
class Variable:
    """A rule's variable: its filters as a tree of ("and", [..]) ("or", [..]) ("not", x) ("concept", names) ("member", dim, names) ("has", dim) ("unknown",), those of the
    whole set included; the dimensions that filters of its own name; the fallback's text, and whether it binds a sequence."""

    name: str
    tree: tuple
    own: frozenset[str]
    fallback: str | None
    sequence: bool


@dataclass(frozen=True)
class Rule:
    id: str
    test: str
    severity: str
    variables: tuple[Variable, ...]


def rules(links: DataFrame) -> list[Rule]:
    """SRC18, FLT3: the rules of linkbases with their variables and filter trees. Rules are a catalogue: what comes to the driver are assertions and
    their filters, none of the other resources of a package. A filter that is not known (a general one) is ("unknown",): whether it holds stays open."""
    boolean = _arcs(links, "boolean-filter$")
    under = _resources(links).join(boolean.select("path", "role", "target").distinct(), ["path", "role", "target"], "left_semi")
    found = {k: [r.asDict() for r in df.collect()] for k, df in {"rules": lean_rules(links), "vars": variables(links), "filters": filters(links), "boolean": boolean, "res": under}.items()}
    resource, below = defaultdict(list), defaultdict(list)
    for r in found["res"]:
        resource[r["path"], r["role"], r["target"]].append(r)
    for r in found["boolean"]:
        below[r["path"], r["role"], r["source"]].append(r)

    def tree(r: dict, complement: bool, seen: tuple = ()):
        at = r["path"], r["role"], r["target"]
        out = ("unknown",)
        if r["tag"] in ("andFilter", "orFilter"):
            parts = [tree(x, a["complement"], (*seen, at[2])) for a in below[at] if a["target"] not in seen for x in resource[*at[:2], a["target"]]]
            out = (r["tag"][:-6], parts) if parts else out
        elif r["tag"] == "explicitDimension" and r["dim"]:
            out = ("member", r["dim"], tuple(sorted(r["members"]))) if r["members"] else ("has", r["dim"])
        elif r["tag"] == "typedDimension" and r["dim"]:
            out = ("has", r["dim"])
        elif r["tag"] == "conceptName" and r["concepts"]:
            out = ("concept", tuple(sorted(r["concepts"])))
        return ("not", out) if complement else out

    by_rule = defaultdict(list)
    for r in found["filters"]:
        by_rule[r["rule"], r["var"]].append(tree(r, r["complement"]))
    of_rule = defaultdict(list)
    for v in sorted(found["vars"], key=lambda v: v["var"]):
        own, common = by_rule[v["rule"], v["var"]], by_rule[v["rule"], None]
        of_rule[v["rule"]].append(Variable(v["var"], ("and", [*common, *own]), frozenset(d for t in own for d in dims_of(t)), v["fallback"], v["sequence"]))
    return [Rule(r["rule"], r["test"], r["severity"], tuple(of_rule[r["rule"]])) for r in sorted(found["rules"], key=lambda r: r["rule"]) if r["test"]]


def dims_of(tree) -> set[str]:
    """Dimensions that a filter tree names."""
    if tree[0] in ("and", "or"):
        return {d for x in tree[1] for d in dims_of(x)}
    return dims_of(tree[1]) if tree[0] == "not" else {tree[1]} if tree[0] in ("member", "has") else set()


def concepts_of(tree) -> set[str] | None:
    """Concepts to one of which a filter tree limits facts; None if it doesn't."""
    if tree[0] == "concept":
        return set(tree[1])
    if tree[0] == "and":
        known = [c for x in tree[1] if (c := concepts_of(x)) is not None]
        return set.intersection(*known) if known else None
    if tree[0] == "or":
        every = [concepts_of(x) for x in tree[1]]
        return None if None in every else set().union(*every)
    return None


def binding_filters(links: DataFrame) -> DataFrame:
    """The rows that binding.bind wants: (rule, var, concept, dim, allowed), a set's filters repeated for each of its variables. A typed
    dimension asks for its presence: an empty array. Complements and boolean filters have no such rows: `rules` and binding.bind_rules take them."""
    f, v = filters(links).where("NOT complement"), variables(links).select("rule", F.col("var").alias("v")).distinct()
    f = f.join(v, "rule").where(F.col("var").isNull() | (F.col("var") == F.col("v"))).drop("var").withColumnRenamed("v", "var")
    concepts = f.where("concepts IS NOT NULL").select("rule", "var", F.explode("concepts").alias("concept"))
    dims = f.where("dim IS NOT NULL").select("rule", "var", "dim", F.coalesce("members", F.array().cast("array<string>")).alias("allowed"))
    return concepts.join(dims, ["rule", "var"], "left").select("rule", "var", "concept", "dim", "allowed")


def boolean_filter(tree, test) -> Column:
    """FLT3: a tree of ('and', [...]), ('or', [...]), ('not', x) and leaves as one Column; test makes a leaf's."""
    if isinstance(tree, tuple) and tree and tree[0] in ("and", "or", "not"):
        if tree[0] == "not":
            return ~boolean_filter(tree[1], test)
        out = boolean_filter(tree[1][0], test)
        for x in tree[1][1:]:
            out = out & boolean_filter(x, test) if tree[0] == "and" else out | boolean_filter(x, test)
        return out
    return test(tree)


def concepts(schema_rows: DataFrame) -> DataFrame:
    """SRC5: metrics (code, qname, datatype, needs_refine, period_type, balance) of concept declarations (name, type, substitutionGroup, periodType,
    balance, abstract, prefix): items that are not abstract."""
    from .package import datatype_of, needs_refine

    c = schema_rows.where(F.col("substitutionGroup").endswith("item") & ~F.coalesce(F.col("abstract"), F.lit(False)))
    return c.select(F.col("name").alias("code"), F.concat_ws(":", "prefix", "name").alias("qname"), datatype_of(F.col("type")).alias("datatype"), needs_refine(F.col("type")).alias("needs_refine"), F.col("periodType").alias("period_type"), "balance")


def enumerations(specs: DataFrame, edges: DataFrame) -> DataFrame:
    """SRC8: (metric, member): the usable descendants of each metric's head in its domain. specs: (metric, domain, head); edges: (domain, parent, child, usable)."""
    from ..operators.cube import usable_members

    key = lambda d, m: F.concat_ws("\u0001", d, m)
    e = edges.select(key("domain", "parent").alias("parent"), key("domain", "child").alias("child"), "usable")
    s = specs.select("metric", key("domain", "head").alias("start"))
    found = usable_members(e, s.select("start").distinct())
    return s.join(found, "start").select("metric", F.substring_index("node", "\u0001", -1).alias("member")).distinct()
