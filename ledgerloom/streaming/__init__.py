"""Incremental validation of facts that keep arriving (an extension; the batch operators are the reference's own)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# functions go to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VERDICT = "code string, inst string, lhs double, rhs double, tol double, any_absent boolean, ok boolean"
_STATE = "keys array<string>, vals array<double>, decimals array<int>"


def _judged(floor: float):
    def update(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """Of a rule instance: its cells' latest values are its state; what arrives replaces them, and the instance is judged again."""
        known = {k: (v, d) for k, v, d in zip(*state.get, strict=True)} if state.exists else {}
        terms, seen = {}, {}
        for batch in batches:
            for key, value, decimals, at, cells in zip(batch["key"], batch["value"], batch["decimals"], batch["at"], batch["cells"], strict=True):
                terms = terms or {(c["side"], c["key"]): c["coef"] for c in cells}
                if key not in seen or at >= seen[key]:  # of several reports of a batch the last
                    seen[key] = at
                    known[key] = (float(value), None if pd.isna(decimals) else int(decimals))
        keys = sorted(known)
        state.update((keys, [known[k][0] for k in keys], [known[k][1] for k in keys]))
        side = lambda s: sum(coef * known[k][0] for (at, k), coef in terms.items() if at == s and k in known)
        half = lambda d: 0.5 if d is None else 0.5 * 10.0**-d
        tol = max(floor, sum(abs(coef) * half(known[k][1]) for (_, k), coef in terms.items() if k in known))
        absent = any(k not in known for _, k in terms)
        lhs, rhs = float(side("lhs")), float(side("rhs"))
        yield pd.DataFrame([(*group, lhs, rhs, tol, absent, abs(lhs - rhs) <= tol)], columns=["code", "inst", "lhs", "rhs", "tol", "any_absent", "ok"])

    return update


def revalidate(stream: DataFrame, terms: DataFrame, floor: float = 0.5) -> DataFrame:
    """A streaming DataFrame of verdicts (as evaluate.additive_verdicts gives them) for every rule instance that arriving facts touch, in update mode. stream: (key, value, decimals, at:
    what orders reports of a cell); terms: (code, inst, side, coef, key), static.

    The state store holds the latest values of an instance's own cells and nothing else; a batch costs what it touches, whatever came before, and
    restarts go on from the query's checkpoint."""
    each = terms.select("code", F.col("inst").cast("string").alias("inst"), "side", F.col("coef").cast("double").alias("coef"), "key")
    cells = each.groupBy("code", "inst").agg(F.collect_list(F.struct("side", "coef", "key")).alias("cells"))  # as many as a rule has terms
    touched = stream.select("key", F.col("value").cast("double").alias("value"), "decimals", "at").join(each.select("code", "inst", "key").distinct(), "key").join(cells, ["code", "inst"])
    return touched.groupBy("code", "inst").applyInPandasWithState(_judged(floor), _VERDICT, _STATE, "update", "NoTimeout")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window; what comes later than `late` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
