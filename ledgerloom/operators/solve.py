"""Solvers of equation systems by connected component (DV8-DV13, DV27).

terms: (component, eq, key, coef, rhs, start, fixed) and perhaps kind (`=`, the default, or `<=`): a row for each cell of each equation
sum coef * x = rhs. Components are independent and of any size; none is left out. What one aggregate solves (an equation whose only unknown is in no other) is solved by one
aggregate in DataFrames; least squares are conjugate gradients on the term table. Least change of a component that one row couples is a running sum over its cells' costs; for one that several rows couple, cells that
stand in the same rows become one, and what is left of it goes to a worker, many to a batch, as sparse rows. In exact systems all but one of such cells are known, and are added up before.

Edge cases: a null start or right side counts as 0; a null coefficient is no term; a cell with several starts keeps the least; repeated terms add up; an equation without cells
holds if its right side fits; fixed cells never move; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import heapq
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ROWS_A_TASK, bounded, dealt, forget, lookup, settled, summed_before

# functions go to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERM = ("eq", "key", "coef", "rhs", "start", "fixed", "kind")
#: Cost of a unit by which an equation is missed, against one for a unit by which a cell moves.
MISS = 1e4
#: Rows of a component up to which its normal equations are factored; beyond, they are solved by conjugate gradients.
DENSE = 1_500


def eliminated(rows: list[dict[int, Fraction]], right: list[Fraction]) -> tuple[list[tuple[int, dict[int, Fraction], Fraction]], bool]:
    """Pivots (column, row, right side) in order of elimination, and whether the equations can hold.

    Rows with a column of their own are set aside first, which costs nothing and undoes whole trees of sums; what is left is eliminated
    by the shortest row, on its column that the fewest others have."""
    where = defaultdict(set)
    for i, row in enumerate(rows):
        for c in row:
            where[c].add(i)
    rows, right, pivots = [dict(r) for r in rows], list(right), []
    own = [c for c, at in where.items() if len(at) == 1]
    heapq.heapify(own)

    def away(i: int) -> None:
        for c in rows[i]:
            where[c].discard(i)
            if len(where[c]) == 1:
                heapq.heappush(own, c)

    left, consistent = set(range(len(rows))), True
    while left:
        while own:
            c = heapq.heappop(own)
            if len(where[c]) == 1:
                i = next(iter(where[c]))
                pivots.append((c, rows[i], right[i]))
                left.discard(i)
                away(i)
        if not left:
            break
        i = min(left, key=lambda j: (len(rows[j]), j))
        left.discard(i)
        away(i)
        if not rows[i]:
            consistent &= not right[i]
            continue
        c = min(rows[i], key=lambda k: (len(where[k]), k))
        pivots.append((c, rows[i], right[i]))
        for j in sorted(where[c]):
            k = rows[j][c] / rows[i][c]
            right[j] -= k * right[i]
            for d, x in rows[i].items():
                new = rows[j].get(d, 0) - k * x
                if new:
                    rows[j][d] = new
                    where[d].add(j)
                elif d in rows[j]:
                    del rows[j][d]
                    where[d].discard(j)
                    if len(where[d]) == 1:
                        heapq.heappush(own, d)
    return pivots, consistent


class System:
    """A component: its cells in order, and its rows over the cells that may move."""

    def __init__(self, terms: list[tuple]):
        about, eqs = {}, {}
        for eq, key, coef, rhs, start, fixed, kind in terms:
            before = about.get(key)
            about[key] = (bool(fixed) or bool(before and before[0]), min(start or 0.0, before[1]) if before else start or 0.0)
            row = eqs.setdefault(eq, ([rhs or 0.0, kind or "="], defaultdict(float)))
            if coef:
                row[1][key] += coef
        self.keys = sorted(about)
        self.fixed = np.array([about[k][0] for k in self.keys], bool)
        self.start = np.array([about[k][1] for k in self.keys], float)
        at = {k: i for i, k in enumerate(self.keys)}
        self.rows = [(kind, rhs, {at[k]: c for k, c in cells.items() if c}) for (rhs, kind), cells in (eqs[e] for e in sorted(eqs))]

    def exact(self) -> tuple[np.ndarray, bool]:
        """DV9: in rationals. Cells that no equation settles keep their start."""
        x = [Fraction(str(v)) for v in self.start]
        rows, right = [], []
        for _, rhs, cells in self.rows:
            rows.append({i: Fraction(str(c)) for i, c in cells.items() if not self.fixed[i]})
            right.append(Fraction(str(rhs)) - sum((Fraction(str(c)) * x[i] for i, c in cells.items() if self.fixed[i]), Fraction(0)))
        pivots, consistent = eliminated(rows, right)
        if consistent:
            for c, row, b in reversed(pivots):
                x[c] = (b - sum((k * x[d] for d, k in row.items() if d != c), Fraction(0))) / row[c]
        return np.array([float(v) for v in x]), consistent

    def sparse(self, want: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, column (among the cells that may move) and value of each coefficient, and the right sides less what is fixed."""
        move = np.cumsum(~self.fixed) - 1
        r, c, v, b = [], [], [], []
        for i, (_, rhs, cells) in enumerate(x for x in self.rows if want in (None, x[0])):
            b.append(rhs - sum(k * self.start[j] for j, k in cells.items() if self.fixed[j]))
            for j, k in cells.items():
                if not self.fixed[j]:
                    r.append(i)
                    c.append(move[j])
                    v.append(k)
        return np.array(r, np.int64), np.array(c, np.int64), np.array(v, float), np.array(b, float)

    def holds(self, x: np.ndarray, tolerance: float = 1e-6) -> bool:
        """Each row's gap against its largest part: what is small depends on what is added up."""
        for kind, rhs, cells in self.rows:
            parts = [k * x[j] for j, k in cells.items()]
            gap = sum(parts) - rhs
            if (gap if kind == "<=" else abs(gap)) > tolerance * max(1.0, abs(rhs), *map(abs, parts)):
                return False
        return True

    def least_change(self, whole: bool = False) -> tuple[np.ndarray, bool]:
        """DV10-DV13: values of at least 0 for which equalities and `<=` rows hold, with the least sum of changes; where they can't all hold,
        with the least sum of misses. With whole, values are whole numbers: what comes out whole stays, of the others the nearer half is rounded, and the rest
        is solved again around that, until all are whole; the result is checked."""
        x, now = self._changed(), self
        while whole and not now.fixed.all():
            off = np.where(now.fixed, 0.0, np.abs(x - np.rint(x)))
            apart = off > 1e-6
            if not apart.any():
                break
            settle = ~now.fixed & ~apart
            if not settle.any() or apart.sum() > 1:
                order = np.flatnonzero(apart)[np.argsort(off[apart], kind="stable")]
                settle[order[: max(1, len(order) // 2)]] = True
            if len(np.flatnonzero(~now.fixed)) == 1:
                break  # the last one is what the rows make it
            now = copy.copy(now)
            now.start = np.where(settle, np.maximum(np.rint(x), 0.0), now.start)
            now.fixed = now.fixed | settle
            x = now._changed()
        if whole:
            x = np.where(self.fixed, x, np.maximum(np.rint(x), 0.0))
        return x, self.holds(x)

    def _changed(self) -> np.ndarray:
        move = ~self.fixed
        equal, at_most = self.sparse("="), self.sparse("<=")
        m, x = len(equal[3]), self.start.copy()
        if move.any():
            r, c, v = np.r_[equal[0], at_most[0] + m], np.r_[equal[1], at_most[1]], np.r_[equal[2], at_most[2]]
            rows, r = np.unique(r, return_inverse=True)  # rows of fixed cells only have nothing to decide
            y = least_change(r, c, v, np.r_[equal[3], at_most[3]][rows], rows >= m, self.start[move])
            x[move] = np.maximum(np.where(np.abs(y - np.rint(y)) < 1e-6, np.rint(y), y), 0.0)
        return x


def least_change(r: np.ndarray, c: np.ndarray, v: np.ndarray, b: np.ndarray, at_most: np.ndarray, start: np.ndarray, rounds: int = 100) -> np.ndarray:
    """min sum w |x - start| + MISS * misses over x >= 0 with rows (r, c, v) equal to b, or at most b: a primal-dual interior-point method.

    Variables are x, the changes up and down, and for each row what it lacks and exceeds (and its slack). The changes are eliminated, so that each round
    solves a system of one unknown a row. Weights w differ by less than a thousandth, so that the optimum is one corner."""
    n, m = len(start), len(b)
    scale = max(1.0, np.abs(start).max(initial=0), np.abs(b).max(initial=0))
    b, start = b / scale, start / scale
    w = 1 + 1e-3 * np.modf((np.arange(n) + 1) * 0.6180339887498949)[0]
    # what an `at most` row lacks is its slack, and costs nothing
    cost = np.r_[np.zeros(n), w, w, np.full(m, MISS), np.where(at_most, 0.0, MISS)]
    forth = lambda z: np.bincount(r, v * z[c], m) if len(r) else np.zeros(m)
    back = lambda y: np.bincount(c, v * y[r], n) if len(r) else np.zeros(n)
    X, U, D, P, Q = (slice(0, n), slice(n, 2 * n), slice(2 * n, 3 * n), slice(3 * n, 3 * n + m), slice(3 * n + m, 3 * n + 2 * m))
    z, s = np.ones(3 * n + 2 * m), np.maximum(cost, 1.0)
    y1, y2 = np.zeros(n), np.zeros(m)  # of x - up + down = start, and of the rows: A x - exceeds + lacks = b
    for _ in range(rounds):
        g1 = start - (z[X] - z[U] + z[D])
        g2 = b - (forth(z[X]) - z[P] + z[Q])
        gd = cost - s
        gd[X] -= y1 + back(y2)
        gd[U] += y1
        gd[D] -= y1
        gd[P] += y2
        gd[Q] -= y2
        mu = z @ s / len(z)
        # to be small in the system's own units, where rows are judged
        if mu < 1e-13 / scale or (mu < 1e-10 / scale and max(np.abs(g1).max(initial=0), np.abs(g2).max(initial=0)) < 1e-7 / max(scale, 100.0)):
            break
        t = z / s
        t1 = t[X] + t[U] + t[D]
        weight = t[X] * ((t[U] + t[D]) / t1)
        diagonal = t[P] + t[Q]
        if m <= DENSE:
            a = np.zeros((m, n))
            np.add.at(a, (r, c), v)
            matrix = (a * weight) @ a.T
            matrix += np.diag(diagonal + 1e-13 * (1 + matrix.diagonal()))  # rows that say the same would leave it singular
            solve = lambda rhs, matrix=matrix: np.linalg.solve(matrix, rhs)
        else:
            solve = lambda rhs, weight=weight, diagonal=diagonal: _gradients(lambda y: forth(weight * back(y)) + diagonal * y, np.bincount(r, v * v * weight[c], m) + diagonal, rhs)

        def direction(target: np.ndarray, t=t, t1=t1, g1=g1, g2=g2, gd=gd, solve=solve):
            h = gd - target / z
            f1 = g1 + t[X] * h[X] - t[U] * h[U] + t[D] * h[D]
            f2 = g2 + forth(t[X] * h[X]) - t[P] * h[P] + t[Q] * h[Q]
            d2 = solve(f2 - forth(t[X] / t1 * f1)) if m else f2
            d1 = (f1 - t[X] * back(d2)) / t1
            dz = -t * h
            dz[X] += t[X] * (d1 + back(d2))
            dz[U] -= t[U] * d1
            dz[D] += t[D] * d1
            dz[P] -= t[P] * d2
            dz[Q] += t[Q] * d2
            return dz, d1, d2, (target - s * dz) / z

        reach = lambda now, d: min(1.0, 0.9995 * np.min(now[d < 0] / -d[d < 0], initial=np.inf))
        dz, _, _, ds = direction(-z * s)
        p, q = reach(z, dz), reach(s, ds)
        aside = min(1.0, ((z + p * dz) @ (s + q * ds) / len(z) / mu) ** 3)
        # second order only where the first order could go some way
        dz, d1, d2, ds = direction(aside * mu - z * s - dz * ds if min(p, q) > 0.1 else max(aside, 0.3) * mu - z * s)
        p, q = reach(z, dz), reach(s, ds)
        z, s, y1, y2 = np.maximum(z + p * dz, 1e-18), np.maximum(s + q * ds, 1e-18), y1 + q * d1, y2 + q * d2
    return z[X] * scale


def _gradients(times: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Conjugate gradients for a positive matrix, preconditioned by its diagonal."""
    x, gap = np.zeros(len(rhs)), rhs.copy()
    d = gap / diagonal
    size = gap @ d
    for _ in range(10 * len(rhs)):
        if gap @ gap <= 1e-22 * (rhs @ rhs):
            break
        q = times(d)
        a = size / (d @ q)
        x += a * d
        gap -= a * q
        h = gap / diagonal
        d, size = h + (gap @ h) / size * d, gap @ h
    return x


_METHODS = {"exact": System.exact, "non_negative": System.least_change, "whole": lambda s: s.least_change(True)}


def _solved(method: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (component, and its terms as an array for each column): many components to a batch, as most are small."""
        for batch in batches:
            at, keys, values, consistent = [], [], [], []
            for i in range(batch.num_rows):  # a component at a time: only its own terms are Python objects
                terms = [batch.column(c)[i].as_py() for c in TERM]
                system = System(list(zip(*terms, strict=True)))
                x, ok = _METHODS[method](system)
                at += [i] * len(x)
                keys += system.keys
                values += x.tolist()
                consistent += [ok] * len(x)
            columns = [batch.column("component").take(pa.array(at, pa.int64())), pa.array(keys, pa.string()), pa.array(values, pa.float64()), pa.array(consistent, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["component", "key", "value", "consistent"])

    return run


def _told(terms: DataFrame) -> DataFrame:
    t = terms if "kind" in terms.columns else terms.withColumn("kind", F.lit("="))
    return t.select("component", "eq", "key", F.col("coef").cast("double"), F.coalesce(F.col("rhs").cast("double"), F.lit(0.0)).alias("rhs"), F.coalesce(F.col("start").cast("double"), F.lit(0.0)).alias("start"), F.coalesce("fixed", F.lit(False)).alias("fixed"), "kind")


def lone_unknowns(terms: DataFrame) -> DataFrame:
    """(component, key, value): unknowns of components that are one equation with one unknown, solved by one aggregate. Sums are decimals, so
    they are exact; null where a number has more than five places or thirteen digits before them, which the workers then solve."""
    exact = lambda c: F.col(c).cast("decimal(19,5)")
    fits = (exact("coef").cast("double") == F.col("coef")) & (exact("start").cast("double") == F.col("start")) & (exact("rhs").cast("double") == F.col("rhs"))
    free = ~F.col("fixed")
    g = terms.groupBy("component").agg(
        F.min("eq").alias("e0"), F.max("eq").alias("e1"), F.count(F.when(free, 1)).alias("unknowns"), F.max(F.when(free, F.col("key"))).alias("key"),
        F.max(F.when(free, exact("coef"))).alias("coef"), F.sum(F.when(F.col("fixed"), (exact("coef") * exact("start")).cast("decimal(38,10)"))).alias("held"), F.max(exact("rhs")).alias("rhs"),
        F.bool_and(F.coalesce(fits, F.lit(False))).alias("fits"), F.bool_and(F.col("kind") == "=").alias("equal"),
    )
    value = F.try_divide((F.col("rhs") - F.coalesce("held", F.lit(0))).cast("double"), F.col("coef").cast("double"))
    return g.where("e0 = e1 AND unknowns = 1 AND fits AND equal AND coef != 0").select("component", "key", value.alias("value"))


def least_squares(terms: DataFrame, tolerance: float = 1e-12, rounds: int | None = None) -> DataFrame:
    """DV27: (component, key, value, consistent): of all components, of any size, the values nearest to the starts for which the equations hold as well as they can.

    Conjugate gradients on the term table: a round is two sparse products, each a join and an aggregate, with two sums for each component; a component goes when its gradient is this small against its
    right sides, or when the rounds (twice its cells at most, if not given) are over. No component has to fit in a worker. consistent: each equation's gap against its largest part."""
    t = _told(terms)
    cells = settled(t.groupBy("component", "key").agg(F.min("start").alias("start"), F.bool_or("fixed").alias("fixed")))
    # repeated terms add up; a cell that is fixed anywhere is fixed
    a = settled(t.where("coef IS NOT NULL").groupBy("component", "eq", "key").agg(F.sum("coef").alias("coef")).join(cells, ["component", "key"]))
    rights = t.groupBy("component", "eq").agg(F.max("rhs").alias("rhs"))
    held = a.groupBy("component", "eq").agg(F.sum(F.col("coef") * F.col("start")).alias("_h"))
    gaps = settled(rights.join(held, ["component", "eq"], "left").select("component", "eq", (F.col("rhs") - F.coalesce("_h", F.lit(0.0))).alias("gap")))
    moving = settled(a.where("NOT fixed").select("component", "eq", "key", "coef"))
    square = lambda c: F.sum(F.col(c) * F.col(c))

    def down(g: DataFrame) -> DataFrame:
        """The gradient: (component, key, g)."""
        return moving.join(g, ["component", "eq"]).groupBy("component", "key").agg(F.sum(F.col("coef") * F.col("gap")).alias("g"))

    goal = settled(gaps.groupBy("component").agg((F.greatest(F.lit(1e-12), square("gap")) * tolerance**2).alias("goal")))
    now = settled(down(gaps).withColumns({"d": F.col("g"), "step": F.lit(0.0)}))
    most = rounds or 2 * (now.groupBy("component").count().agg(F.max("count")).first()[0] or 0)
    rest, ended = gaps, None
    for _ in range(most):
        size = now.groupBy("component").agg(square("g").alias("size")).join(goal, "component")
        active = settled(size.where("size > goal").select("component", "size"))
        # what has come to rest goes aside
        over = settled(now.join(active.select("component"), "component", "left_anti").select("component", "key", "step"))
        ended = over if ended is None else settled(ended.unionByName(over))
        if active.isEmpty():
            now = None
            break
        q = settled(moving.join(now.join(active.select("component"), "component", "left_semi").select("component", "key", "d"), ["component", "key"]).groupBy("component", "eq").agg(F.sum(F.col("coef") * F.col("d")).alias("q")))
        alpha = settled(q.groupBy("component").agg(square("q").alias("qq")).join(active, "component").select("component", "size", F.coalesce(F.try_divide("size", "qq"), F.lit(0.0)).alias("alpha")))
        before, rest = rest, settled(rest.join(q, ["component", "eq"]).join(alpha, "component").select("component", "eq", (F.col("gap") - F.col("alpha") * F.col("q")).alias("gap")))
        new = settled(down(rest))
        beta = new.groupBy("component").agg(square("g").alias("_n")).join(alpha, "component").select("component", "alpha", (F.col("_n") / F.col("size")).alias("beta"))
        old = now.select("component", "key", F.col("d").alias("_d"), "step")
        moved = settled(new.join(old, ["component", "key"]).join(beta, "component").select("component", "key", "g", (F.col("g") + F.col("beta") * F.col("_d")).alias("d"), (F.col("step") + F.col("alpha") * F.col("_d")).alias("step")))
        forget(now, before if before is not gaps else None, q, alpha, new)
        now = moved
    steps = ended if now is None else now.select("component", "key", "step") if ended is None else ended.unionByName(now.select("component", "key", "step"))
    values = settled(cells.join(steps, ["component", "key"], "left").select("component", "key", (F.col("start") + F.coalesce("step", F.lit(0.0))).alias("value")))
    part = F.col("coef") * F.col("value")
    judged = rights.join(a.select("component", "eq", "key", "coef").join(values, ["component", "key"]).groupBy("component", "eq").agg(F.sum(part).alias("sum"), F.max(F.abs(part)).alias("most")), ["component", "eq"], "left")
    fits = F.abs(F.coalesce("sum", F.lit(0.0)) - F.col("rhs")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("rhs"), F.coalesce("most", F.lit(0.0)))
    return values.join(judged.groupBy("component").agg(F.bool_and(fits).alias("consistent")), "component").select("component", "key", "value", "consistent")


def _coefficients(t: DataFrame) -> DataFrame:
    """(component, key, eq, coef, rhs, kind, start, fixed) of a table of terms: repeated ones add up (0: no term), a cell that is fixed anywhere is fixed."""
    g = t.repartition(t.count() // ROWS_A_TASK + 1, "component", "key").groupBy("component", "key", "eq")
    g = g.agg(F.coalesce(F.sum("coef"), F.lit(0.0)).alias("coef"), F.max("rhs").alias("rhs"), F.coalesce(F.min("kind"), F.lit("=")).alias("kind"), F.min("start").alias("start"), F.bool_or("fixed").alias("fixed"))
    cell = Window.partitionBy("component", "key")
    return settled(g.withColumns({"start": F.min("start").over(cell), "fixed": F.bool_or("fixed").over(cell)}))


def _by_group(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left (a table) with the columns of its group in right (a table, with the number of left's rows in each): a group may be of any size, and there may be any number of them."""
    small = bounded(right)
    return lookup(left, right, key, count, left.count(), "inner") if small is right else left.join(small, key)


def _sums(*of: Column | str) -> list[Column]:
    """128 bits that tell a set of rows, whatever its size: no list of them is gathered."""
    return [F.sum(F.xxhash64(F.lit(seed), *of).cast("decimal(38,0)")).alias(f"_{seed}") for seed in (1, 2)]


def _segments(own: DataFrame, whole: bool) -> DataFrame:
    """(component, key, v, len, slope, x) from what is told of single cells (v, base, jump: a convex cost, its slope before v and how much more it is after; one of them at 0): the segments from 0 on of their
    sum (null: without end), and where it is least. With whole, costs are those of whole numbers, and what lies between them is on the straight line."""
    if whole:
        near = F.rint("v")
        is_whole = F.abs(F.col("v") - near) < 1e-9 * F.greatest(F.lit(1.0), F.abs("v"))
        low = F.when(is_whole, near).otherwise(F.floor("v").cast("double"))
        own = own.select("component", "key", "base", "jump", low.alias("_low"), F.when(is_whole, 0.0).otherwise(F.col("v") - low).alias("_over"))
        ends = F.array(F.struct(F.col("_low").alias("v"), "base", (F.col("jump") * (1 - F.col("_over"))).alias("jump")), F.struct((F.col("_low") + 1).alias("v"), F.lit(0.0).alias("base"), (F.col("jump") * F.col("_over")).alias("jump")))
        own = own.select("component", "key", F.inline(F.when(F.col("_over") == 0, F.slice(ends, 1, 1)).otherwise(ends)))
    g = own.withColumn("v", F.greatest("v", F.lit(0.0))).groupBy("component", "key", "v").agg(F.sum("base").alias("base"), F.sum("jump").alias("jump"))
    cell = Window.partitionBy("component", "key")
    at = cell.orderBy("v")
    g = g.select("component", "key", "v", (F.lead("v").over(at) - F.col("v")).alias("len"), (F.sum("base").over(cell) + F.sum("jump").over(at)).alias("slope"))
    return g.withColumn("x", F.min(F.when(F.col("slope") >= 0, F.col("v"))).over(cell))


def _spread(parts: DataFrame, goals: DataFrame, whole: bool) -> DataFrame:
    """(component, key, step): how far cells move for each group's sum of coef * x to move by its gap, the cheapest unit first.

    parts: (group, component, key, v, len, slope, coef), the segments of the costs of the group's cells; a null len has no end. goals: (group, gap, most, at_most): most is the cost of a unit beyond which none moves.
    A group may be of any size."""
    parts = settled(parts)
    p = _by_group(parts, settled(goals.join(parts.groupBy("group").agg(F.count("*").alias("_n")), "group")), "group", "_n")
    fills, size = F.col("slope") >= 0, F.abs("coef")
    price = F.abs("slope") / size
    p = p.where((F.col("gap") != 0) & (((F.col("coef") > 0) == fills) == (F.col("gap") > 0)) & (price < F.col("most")))
    p = p.select("group", "component", "key", "v", "slope", "coef", "gap", "at_most", price.alias("price"), F.least(F.coalesce("len", F.lit(float("inf"))) * size, F.abs("gap")).alias("room"))
    p = summed_before(p, "group", ["price", "key", "v"], "room")
    step = F.greatest(F.lit(0.0), F.least(F.col("room"), F.abs("gap") - F.col("before"))) / size
    if whole:  # a row that is an upper bound holds with a part of a unit more
        step = F.when(F.col("at_most"), F.ceil(step - 1e-9).cast("double")).otherwise(step)
    return p.where("before < abs(gap)").groupBy("component", "key").agg(F.sum(F.when(fills, step).otherwise(-step)).alias("step"))


def _merged(shared: DataFrame, own: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Cells that rows of several cells hold with the same coefficients, and whose own rows and start come in the same order, become one cell, whose start and bounds are the sums of theirs: the costs
    of their sum are the same, as all are spent from the cheapest unit on. (component, key, class), and the terms of the cells that are left. With whole, cells join only if all that is told of them is whole."""
    order = Window.partitionBy("component", "key").orderBy("v", "tag", "coef")
    told = settled(own.select("component", "key", "v", "tag", "coef", F.row_number().over(order).alias("place")))
    columns = shared.groupBy("component", "key").agg(*_sums("eq", "coef"))
    orders = told.groupBy("component", "key").agg(*[c.alias(f"_o{i}") for i, c in enumerate(_sums("place", "tag", "coef"))], F.bool_or(F.col("v") != F.rint("v")).alias("_odd"))
    alone = F.when(F.col("_odd"), F.col("key")) if whole else F.lit(None).cast("string")
    classes = settled(columns.join(orders, ["component", "key"]).select("component", "key", F.concat_ws(" ", "_1", "_2", "_o0", "_o1", alone).alias("class")))
    told = told.join(classes, ["component", "key"]).where("tag != '0'").groupBy("component", "class", "place", "tag").agg(F.max("coef").alias("coef"), F.sum("v").alias("v"))
    told = settled(told)
    starts = told.where("tag = '1'").select("component", "class", F.col("v").alias("start"))
    bounds = told.where("tag != '1'").select("component", F.concat(F.lit("own "), "place", F.lit(" "), "class").alias("eq"), "class", "coef", (F.col("coef") * F.col("v")).alias("rhs"), F.substring("tag", 2, 9).alias("kind"))
    rows = shared.join(classes, ["component", "key"]).groupBy("component", "class", "eq").agg(F.max("coef").alias("coef"), F.max("right").alias("rhs"), F.max("kind").alias("kind"))
    rows = rows.select("component", F.concat(F.lit("row "), F.col("eq").cast("string")).alias("eq"), "class", "coef", "rhs", "kind")
    return classes, rows.unionByName(bounds).join(starts, ["component", "class"]).withColumnRenamed("class", "key").withColumn("fixed", F.lit(False))


def _in_workers(terms: DataFrame, method: str, kind: str) -> DataFrame:
    grouped = terms.groupBy("component").agg(F.collect_list(F.struct(*TERM)).alias("t"))
    return grouped.select("component", *[F.col(f"t.{c}").alias(c) for c in TERM]).mapInArrow(_solved(method), f"component {kind}, key string, value double, consistent boolean")


def least_changes(t: DataFrame, method: str, kind: str) -> DataFrame:
    """DV10-DV13 for components of any size: (component, key, value, consistent).

    A row with one cell that may move is a part of that cell's cost, as is its start; costs are convex, so each cell has a place where it rests. What one row couples moves from there by the cheapest units
    until the row holds; what several rows couple is solved with like cells merged, whose sum is then handed down to them in the same way."""
    whole, t = method == "whole", settled(t)
    a = _coefficients(t)
    n = t.count() // ROWS_A_TASK + 1
    free, moves = ~F.col("fixed"), ~F.col("fixed") & (F.col("coef") != 0)
    rows = a.groupBy("component", "eq").agg(F.max("rhs").alias("rhs"), F.min("kind").alias("kind"), F.coalesce(F.sum(F.when(F.col("fixed"), F.col("coef") * F.col("start"))), F.lit(0.0)).alias("held"), F.count(F.when(moves, 1)).alias("moving"), F.max(F.when(moves, F.struct("key", "coef"))).alias("only"))
    rows = settled(rows.select("component", "eq", "kind", (F.col("rhs") - F.col("held")).alias("right"), "moving", "only").where("moving > 0"))
    bounds = rows.where("moving = 1").select("component", "only.key", (F.col("right") / F.col("only.coef")).alias("v"), F.concat(F.lit("2"), "kind").alias("tag"), "only.coef")
    point = lambda v, tag: F.struct(v.alias("v"), F.lit(tag).alias("tag"), F.lit(1.0).alias("coef"))
    starts = a.where(free).groupBy("component", "key").agg(F.max("start").alias("start"))
    own = starts.select("component", "key", F.inline(F.array(point(F.lit(0.0), "0"), point(F.col("start"), "1")))).unionByName(bounds).repartition(n, "component", "key")
    both = F.col("tag") != "2<="
    miss = F.when(F.col("tag") == "0", 0.0).when(F.col("tag") == "1", 1.0).otherwise(MISS * F.abs("coef"))
    segments = settled(_segments(own.select("component", "key", "v", F.when(both | (F.col("coef") < 0), -miss).otherwise(0.0).alias("base"), F.when(both, 2 * miss).otherwise(miss).alias("jump")), whole))
    rests = segments.where("v = 0").select("component", "key", "x")
    together = settled(rows.where("moving > 1").select("component", F.struct("component", "eq").alias("row"), "kind", "right", "moving"))
    coupled = settled(together.groupBy("component").agg(F.count("*").alias("rows")))
    together = settled(_by_group(together, coupled, "component", "rows").select("row", "kind", "right", "moving", "rows"))
    shared = settled(a.where(moves).select(F.struct("component", "eq").alias("row"), "key", "coef"))
    shared = _by_group(shared, together, "row", "moving").select("row.component", "row.eq", "key", "coef", "right", "kind", "rows")
    shared = settled(shared.join(rests, ["component", "key"]))
    one, many = shared.where("rows = 1"), shared.where("rows > 1")
    gap = F.max("right") - F.sum(F.col("coef") * F.col("x"))
    goals = one.groupBy(F.col("component").alias("group")).agg(F.when(F.max("kind") == "<=", F.least(gap, F.lit(0.0))).otherwise(gap).alias("gap"), F.lit(MISS).alias("most"), (F.max("kind") == "<=").alias("at_most"))
    steps = _spread(segments.join(one.select("component", "key", "coef"), ["component", "key"]).withColumn("group", F.col("component")), goals, whole)
    if not many.isEmpty():
        here = many.select("component", "key").distinct()
        classes, left = _merged(many, own.join(here, ["component", "key"], "left_semi"), whole)
        sums = settled(_in_workers(left, method, kind).select("component", F.col("key").alias("class"), "value"))
        group = F.struct("component", "class").alias("group")
        had = rests.join(classes, ["component", "key"]).groupBy("component", "class").agg(F.sum("x").alias("x"))
        goals = sums.join(had, ["component", "class"]).select(group, (F.col("value") - F.col("x")).alias("gap"), F.lit(float("inf")).alias("most"), F.lit(False).alias("at_most"))
        steps = steps.unionByName(_spread(segments.join(classes, ["component", "key"]).select(group, "component", "key", "v", "len", "slope", F.lit(1.0).alias("coef")), goals, whole))
    value = F.greatest(F.lit(0.0), F.col("x") + F.coalesce("step", F.lit(0.0)))
    cells = a.groupBy("component", "key").agg(F.max("start").alias("start"), F.bool_or("fixed").alias("fixed"))
    values = cells.join(rests, ["component", "key"], "left").join(steps, ["component", "key"], "left")
    values = settled(values.select("component", "key", F.when(F.col("fixed"), F.col("start")).otherwise(F.rint(value) if whole else value).alias("value")))
    part = F.col("coef") * F.col("value")
    judged = a.join(values, ["component", "key"]).groupBy("component", "eq").agg(F.max("rhs").alias("rhs"), F.min("kind").alias("kind"), F.sum(part).alias("sum"), F.max(F.abs(part)).alias("most"))
    off = F.col("sum") - F.col("rhs")
    fits = F.when(F.col("kind") == "<=", off).otherwise(F.abs(off)) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("rhs"), F.col("most"))
    out = _with_verdicts(values, judged.groupBy("component").agg(F.bool_and(fits).alias("consistent")))
    forget(t, a, rows, segments, together, shared)
    return out


def _with_verdicts(values: DataFrame, verdicts: DataFrame) -> DataFrame:
    """values (a table) with their component's verdict; a component may be of any size."""
    sizes = values.groupBy("component").agg(F.count("*").alias("_n"))
    return _by_group(values, settled(sizes.join(verdicts, "component")), "component", "_n").select("component", "key", "value", "consistent")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, part): the exact sum of a batch's products, as a fraction, for each row."""
    for batch in batches:
        sums = defaultdict(Fraction)
        for row, coef, start in zip(batch.column("text").to_pylist(), batch.column("coef").to_pylist(), batch.column("start").to_pylist(), strict=True):
            sums[row] += Fraction(str(coef)) * Fraction(str(start))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([str(v) for v in sums.values()], pa.string())], ["text", "part"])


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, start): doubles whose texts add up to the sum of the row's parts exactly."""
    for batch in batches:
        rows, starts = [], []
        for row, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            rest = sum(map(Fraction, parts), Fraction(0))
            while rest and (near := float(rest)):
                rows.append(row)
                starts.append(near)
                rest -= Fraction(str(near))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(starts, pa.float64())], ["text", "start"])


def exact_values(t: DataFrame, kind: str) -> DataFrame:
    """DV9 for components of any size: (component, key, value, consistent) of a table of terms. Of cells that stand in the same rows with the same coefficients only the first can be told by them; the others keep
    their starts, as fixed cells do, and what is known of a row is added up exactly before its component goes to a worker."""
    a = _coefficients(t)
    cells = a.groupBy("component", "key").agg(F.max("start").alias("start"))
    classes = settled(a.where("NOT fixed AND coef != 0").groupBy("component", "key").agg(*_sums("eq", "coef")))
    first = settled(classes.groupBy("component", "_1", "_2").agg(F.min("key").alias("key")).select("component", "key"))
    terms = a.where("coef != 0")
    # a row is told by its text, so that components and equations may be of any type
    text = F.to_json(F.struct("component", "eq")).alias("text")
    held = terms.join(first, ["component", "key"], "left_anti").select(text, "coef", "start").mapInArrow(_added, "text string, part string")
    held = held.groupBy("text").agg(F.collect_list("part").alias("parts")).mapInArrow(_doubles, "text string, start double")
    known = a.groupBy("component", "eq").agg(F.max("rhs").alias("rhs"))
    known = known.withColumn("text", text).join(held, "text", "left").select("component", "eq", F.concat(F.lit("\0"), "text", F.lit(" "), F.coalesce(F.col("start").cast("string"), F.lit(""))).alias("key"), F.lit(1.0).alias("coef"), "rhs", F.coalesce("start", F.lit(0.0)).alias("start"), F.lit(True).alias("fixed"), F.lit("=").alias("kind"))
    solved = settled(_in_workers(terms.join(first, ["component", "key"], "left_semi").select(known.columns).unionByName(known), "exact", kind))
    values = settled(cells.join(solved.select("component", "key", "value"), ["component", "key"], "left").select("component", "key", F.coalesce("value", "start").alias("value")))
    return _with_verdicts(values, solved.groupBy("component").agg(F.bool_and("consistent").alias("consistent")))


def solve(terms: DataFrame, method: str = "exact", most: int | None = None) -> DataFrame:
    """(component, key, value, consistent) for each cell. method: exact, least_squares, non_negative (least change) or whole. Components may be of any size. Only a caller who names
    `most` has those of more cells put off: their consistent is null, and their starts stay (least_squares never does)."""
    if method == "least_squares":
        return least_squares(terms)
    t, off = _told(terms), None
    kind = terms.schema["component"].dataType.simpleString()
    if most is not None:
        t = settled(t)
        sizes = settled(t.groupBy("component").agg(F.count_distinct("key").alias("cells")))
        off = t.join(sizes.where(F.col("cells") > most), "component", "left_semi").groupBy("component", "key").agg(F.min("start").alias("value")).withColumn("consistent", F.lit(None).cast("boolean"))
        t = t.join(sizes.where(F.col("cells") <= most), "component", "left_semi")
    if method == "exact":
        # dealt by component once for all that follows
        t = dealt(settled(t), "component")
        alone = settled(lone_unknowns(t))
        met = t.join(alone.select("component", F.col("key").alias("_k"), F.col("value").alias("_v")), "component")
        out = met.groupBy("component", "key").agg(F.max(F.when(F.col("key") == F.col("_k"), F.col("_v"))).alias("_v"), F.min("start").alias("start"))
        out = out.select("component", "key", F.coalesce("_v", "start").alias("value"), F.lit(True).alias("consistent"))
        rest = settled(t.join(alone.select("component"), "component", "left_anti"))
        if not rest.isEmpty():
            out = out.unionByName(exact_values(rest, kind))
    else:
        out = least_changes(t, method, kind)
    return out if off is None else out.unionByName(off)


def residuals(terms: DataFrame, values: DataFrame) -> DataFrame:
    """(eq, residual) of equations over solved values."""
    return terms.join(values.select("key", "value"), "key").groupBy("eq").agg((F.sum(F.col("coef") * F.col("value")) - F.max("rhs")).alias("residual"))
