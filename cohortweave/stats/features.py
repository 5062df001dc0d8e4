"""Modelling features: derived columns, imputation, level coding, spline bases, designs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.functions.dates import month_boundaries
from cohortweave.operators.summaries import exact_quantiles

#: Levels that a category may have without declaring them.
MAX_FREE_LEVELS = 500


def age_years(birth: str, at: str) -> Column:
    return F.datediff(F.col(at), F.col(birth)) / 365.25


def body_mass_index(pounds: str, inches: str) -> Column:
    return F.col(pounds).cast("double") * 703 / F.pow(F.col(inches).cast("double"), 2)


def egfr_2021(creatinine: str, age: str, female: Column) -> Column:
    """Published creatinine equation of 2021 (mL/min/1.73 m2)."""
    kappa, alpha = F.when(female, 0.7).otherwise(0.9), F.when(female, -0.241).otherwise(-0.302)
    ratio = F.col(creatinine).cast("double") / kappa
    return (142 * F.pow(F.least(ratio, F.lit(1.0)), alpha) * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.2))
            * F.pow(F.lit(0.9938), F.col(age)) * F.when(female, 1.012).otherwise(1.0))


def known_flag(*dates: str) -> Column:
    """``Yes`` when any of the dates is known, else ``No``."""
    return F.when(F.coalesce(*[F.col(d).cast("string") for d in dates]).isNotNull(), "Yes").otherwise("No")


def cut(col: str, points: Sequence[float], labels: Sequence[str]) -> Column:
    """Category of a number: ``labels[i]`` for values below ``points[i]``; NULL stays NULL."""
    x = F.col(col)
    expr = F.lit(labels[-1])
    for point, label in reversed(list(zip(points, labels))):
        expr = F.when(x < point, label).otherwise(expr)
    return F.when(x.isNotNull(), expr)


def months_to(col: str, at: str) -> Column:
    return month_boundaries(col, at)


def baseline_features(df: DataFrame, spec: Mapping[str, Column]) -> DataFrame:
    """Add derived columns; later entries may use earlier ones."""
    for name, expr in spec.items():
        df = df.withColumn(name, expr)
    return df


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column (a handful of numbers)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "variable", "_value")
    return {r["variable"]: r["q"] for r in exact_quantiles(long, ["variable"], "_value", [0.5]).collect()}


def median_impute(df: DataFrame, columns: Sequence[str], values: Mapping[str, float] | None = None) -> DataFrame:
    """Replace NULLs by the column's median."""
    values = values or medians(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(values.get(c))) for c in columns})


def encode_levels(col: str, levels: Sequence[str], ref: str | None = None, missing: bool = False) -> dict[str, Column]:
    """0/1 columns for every level but the reference, in the declared order; with ``missing``, one for NULL at the end."""
    ref = levels[0] if ref is None else ref
    out = {f"{col}={lv}": F.when(F.col(col).cast("string") == lv, 1.0).otherwise(0.0)
           for lv in levels if lv != ref}
    return out | ({f"{col} missing": F.when(F.col(col).isNull(), 1.0).otherwise(0.0)} if missing else {})


def ns_basis(col: str | Column, knots: Sequence[float]) -> list[Column]:
    """Natural cubic spline of one column; ``knots`` are boundary, inner..., boundary.

    Columns are the scaled value and truncated-power differences: the span of any
    natural spline basis on these knots, so fitted values agree between bases.
    """
    ks = sorted(dict.fromkeys(float(k) for k in knots))
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    if len(ks) < 2:
        return [x]
    low, width = ks[0], ks[-1] - ks[0]
    u = (x - low) / width
    z = [(k - low) / width for k in ks]

    def cube(at: float) -> Column:
        return F.pow(F.greatest(u - F.lit(at), F.lit(0.0)), F.lit(3.0))

    def bend(k: float) -> Column:
        return (cube(k) - cube(1.0)) / (1.0 - k)

    return [u] + [bend(k) - bend(z[-2]) for k in z[:-2]]


@dataclass(frozen=True)
class Term:
    """One model term: ``numeric``, ``spline`` (df, or inner knots) or ``category``.

    ``missing`` says what a NULL means where the data has one: ``level`` (a category's own 0/1 column; the default for
    categories), ``drop`` (such rows take no part in the fit and get no score) or ``error`` (the default for numbers).
    """

    column: str
    kind: str = "numeric"
    df: int = 3
    knots: Sequence[float] | None = None
    levels: Sequence[str] | None = None
    ref: str | None = None
    missing: str | None = None

    @property
    def rule(self) -> str:
        return self.missing or ("level" if self.kind == "category" else "error")


@dataclass
class Design:
    """Terms with their data-dependent parts (knots, levels) resolved."""

    terms: Sequence[Term]
    names: list[str] = field(default_factory=list)
    variables: list[str] = field(default_factory=list)
    columns: list[Column] = field(default_factory=list)
    required: list[str] = field(default_factory=list)  # columns whose NULL rows take no part

    def rows(self, df: DataFrame) -> DataFrame:
        """The rows that take part in a fit."""
        return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.required])) if self.required else df

    def add(self, variable: str, named: Mapping[str, Column]) -> None:
        for name, col in named.items():
            self.names.append(name)
            self.variables.append(variable)
            self.columns.append(col)

    def array(self, intercept: bool = False) -> Column:
        head = [F.lit(1.0)] if intercept else []
        return F.array(*head, *[c.cast("double") for c in self.columns])

    def vector(self) -> Column:
        return array_to_vector(self.array())


def design(df: DataFrame, terms: Sequence[Term]) -> Design:
    """Resolve knots (exact quantiles, range) and levels of the terms on the data.

    NULLs are counted first and treated by each term's rule.  A category without declared levels may have ``MAX_FREE_LEVELS``
    of them; a value outside declared levels is an error.
    """
    gaps = _checked(df, terms)
    out = Design(terms, required=[t.column for t in terms if t.rule == "drop" and gaps[t.column]])
    df = out.rows(df)
    splines = [t for t in terms if t.kind == "spline"]
    knots: dict[str, list[float]] = {}
    if splines:
        ends = df.agg(*[f(F.col(t.column).cast("double")).alias(f"{n}_{i}") for i, t in enumerate(splines)
                        for n, f in (("lo", F.min), ("hi", F.max))]).first()
        open_knots = [t for t in splines if t.knots is None]
        inner: dict[str, dict[float, float]] = {}
        if open_knots:
            probs = sorted({i / t.df for t in open_knots for i in range(1, t.df)})
            cols = list(dict.fromkeys(t.column for t in open_knots))
            long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
                [], cols, "variable", "_value")
            for r in exact_quantiles(long, ["variable"], "_value", probs).collect():
                inner.setdefault(r["variable"], {})[r["prob"]] = r["q"]
        for i, t in enumerate(splines):
            mids = t.knots if t.knots is not None else [inner[t.column][j / t.df] for j in range(1, t.df)]
            knots[t.column] = [ends[f"lo_{i}"], *mids, ends[f"hi_{i}"]]
    free = [t.column for t in terms if t.kind == "category" and t.levels is None]
    levels: dict[str, list[str]] = {}
    if free:
        found = (df.select(*[F.col(c).cast("string").alias(c) for c in free])
                 .unpivot([], free, "variable", "level").where("level is not null").distinct().collect())
        for r in found:
            levels.setdefault(r["variable"], []).append(r["level"])
    for t in terms:
        if t.kind == "numeric":
            out.add(t.column, {t.column: F.col(t.column).cast("double")})
        elif t.kind == "spline":
            basis = ns_basis(t.column, knots[t.column])
            out.add(t.column, {f"{t.column}~{i + 1}": c for i, c in enumerate(basis)})
        else:
            lv = list(t.levels) if t.levels is not None else sorted(levels.get(t.column, []))
            out.add(t.column, encode_levels(t.column, lv, t.ref, t.rule == "level" and gaps[t.column] > 0) if lv else {})
    return out


def _checked(df: DataFrame, terms: Sequence[Term]) -> dict[str, int]:
    """Rows without a value per column, after the checks of ``design``; one aggregate."""
    free = [t.column for t in terms if t.kind == "category" and t.levels is None]
    declared = [t for t in terms if t.kind == "category" and t.levels is not None]
    columns = list(dict.fromkeys(t.column for t in terms))
    facts = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"gap {c}") for c in columns],
        *[F.approx_count_distinct(c).alias(f"levels {c}") for c in dict.fromkeys(free)],
        *[F.count_if(F.col(t.column).isNotNull() & ~F.col(t.column).cast("string").isin(list(t.levels))).alias(f"other {t.column}") for t in declared]).first() \
        if columns else {}
    for t in terms:
        if t.rule not in ("level", "drop", "error") or (t.rule == "level" and t.kind != "category"):
            raise ValueError(f"{t.column}: unknown rule {t.missing!r} for missing values")
        if t.rule == "error" and facts[f"gap {t.column}"]:
            raise ValueError(f"{t.column}: {facts[f'gap {t.column}']} rows without a value; impute them or set missing='drop'")
        if t.column in free and t.kind == "category" and facts[f"levels {t.column}"] > MAX_FREE_LEVELS:
            raise ValueError(f"{t.column}: some {facts[f'levels {t.column}']} levels; declare the ones to use")
    for t in declared:
        if facts[f"other {t.column}"]:
            raise ValueError(f"{t.column}: {facts[f'other {t.column}']} rows with a value outside the declared levels")
    return {c: facts[f"gap {c}"] for c in columns}
