"""Checks of panels and their report: all counts of a table come from one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.panel import PanelFrame


@dataclass(frozen=True)
class ColumnContract:
    """What a column must be; ``impact`` is error or warning."""

    dtype: str | None = None
    nullable: bool = True
    allow_nan: bool = True
    unique: bool = False
    allowed: Sequence | None = None
    ge: float | None = None
    le: float | None = None
    required: bool = True
    impact: str = "error"


FAMILIES = {
    "numeric": T.NumericType,
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "temporal": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "decimal": T.DecimalType,
    "string": T.StringType,
    "boolean": T.BooleanType,
}


def quality_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: rows, nulls, NaNs, distinct values (approximate), whether it is constant."""
    names = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        is_float = isinstance(df.schema[c].dataType, FAMILIES["float"])
        aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"null{i}"), (F.sum(F.isnan(c).cast("long")) if is_float else F.lit(0).cast("long")).alias(f"nan{i}"), F.approx_count_distinct(c).alias(f"d{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.col("n").alias("n_rows"), F.col(f"null{i}").alias("n_null"), F.col(f"nan{i}").alias("n_nan"), F.col(f"d{i}").alias("n_distinct"), (F.col(f"d{i}") <= 1).alias("constant")) for i, c in enumerate(names)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def validate(p: PanelFrame, contracts: Mapping[str, ColumnContract] | None = None, rules: Mapping[str, Column] | None = None, min_obs: int | None = None) -> DataFrame:
    """One row per check: ``check``, ``column``, ``impact``, ``n_bad``, ``passed``.

    Keys (null, unique), declared contracts, row rules (true is good), and the least number of rows of an entity.
    """
    df, checks = p.df, []
    flags: list[tuple[str, str, str, Column]] = [("null_keys", c, "error", F.col(c).isNull()) for c in (p.entity, p.time)]
    for c, k in (contracts or {}).items():
        if c not in df.columns:
            checks.append(df.sparkSession.range(1).select(F.lit("columns_present").alias("check"), F.lit(c).alias("column"), F.lit(k.impact).alias("impact"), F.lit(int(k.required)).cast("long").alias("n_bad")))
            continue
        kind, x = df.schema[c].dataType, F.col(c)
        if k.dtype:
            flags.append(("dtype", c, k.impact, F.lit(not isinstance(kind, FAMILIES[k.dtype]))))
        if not k.nullable:
            flags.append(("nullability", c, k.impact, x.isNull()))
        if not k.allow_nan and isinstance(kind, FAMILIES["float"]):
            flags.append(("nan", c, k.impact, F.isnan(x)))
        if k.allowed is not None:
            flags.append(("allowed_values", c, k.impact, ~x.isin(list(k.allowed))))
        if k.ge is not None or k.le is not None:
            bad = F.lit(False)
            bad = bad | (x < k.ge) if k.ge is not None else bad
            bad = bad | (x > k.le) if k.le is not None else bad
            flags.append(("range", c, k.impact, bad))
    flags += [("rule", n, "error", ~r) for n, r in (rules or {}).items()]
    one = df.agg(*[F.coalesce(F.sum(F.coalesce(f, F.lit(False)).cast("long")), F.lit(0)).alias(f"c{i}") for i, (_, _, _, f) in enumerate(flags)])
    rows = F.array(*[F.struct(F.lit(a).alias("check"), F.lit(b).alias("column"), F.lit(m).alias("impact"), F.col(f"c{i}").alias("n_bad")) for i, (a, b, m, _) in enumerate(flags)])
    out = one.select(F.explode(rows).alias("x")).select("x.*")
    grouped = [("unique_keys", "error", p.df.groupBy(p.entity, p.time).count().where("count > 1"))]
    grouped += [("unique", k.impact, df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(c)).count().where("count > 1")) for c, k in (contracts or {}).items() if k.unique and c in df.columns]
    if min_obs:
        grouped.append(("min_obs", "warning", df.groupBy(p.entity).count().where(F.col("count") < min_obs)))
    for name, impact, bad in grouped:
        checks.append(bad.agg(F.lit(name).alias("check"), F.lit(bad.columns[0]).alias("column"), F.lit(impact).alias("impact"), F.count(F.lit(1)).alias("n_bad")))
    for c in checks:
        out = out.unionByName(c)
    return out.withColumn("passed", F.col("n_bad") == 0)


def gaps(p: PanelFrame, longest: str) -> DataFrame:
    """Neighbouring rows of an entity that are further apart than an interval such as ``7 days``."""
    t = F.col(p.time).cast("timestamp")
    rows = p.df.select(p.entity, F.lag(t).over(p.window).alias("after"), t.alias("before"))
    return rows.where(F.col("before") > F.col("after") + F.expr(f"INTERVAL {longest}"))


def coverage(p: PanelFrame) -> DataFrame:
    """Rows of each entity over the number of all times."""
    total = p.df.agg(F.count_distinct(p.time).alias("t"))
    return p.df.groupBy(p.entity).agg(F.count_distinct(p.time).alias("n")).join(F.broadcast(total)).select(p.entity, (F.col("n") / F.col("t")).alias("coverage"))


def train_test_straddle(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test rows whose keys are in the training rows too."""
    return test.join(train.select(*keys).distinct(), list(keys), "left_semi")


def drift(a: DataFrame, b: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index of b against a, over a's quantile bins."""
    cuts = a.agg(F.percentile(column, [i / bins for i in range(1, bins)]).alias("cuts"))
    place = lambda df: df.where(F.col(column).isNotNull()).join(F.broadcast(cuts)).select(F.size(F.filter("cuts", lambda c: c < F.col(column))).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    share = lambda df, n: place(df).select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias(n))
    both = share(a, "pa").join(share(b, "pb"), "bin", "full")
    pa, pb = (F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(1e-6)) for c in ("pa", "pb"))
    return both.agg(F.sum((pb - pa) * F.ln(pb / pa)).alias("psi"))


# --- checks one by one, and the validator that runs them -----------------------------------------------------------------------------


class QualityWarning(UserWarning):
    """A check of impact ``warning`` failed."""


class PanelValidationError(ValueError):
    """A check of impact ``error`` failed; ``report`` has all of them."""

    def __init__(self, report: ValidationReport) -> None:
        super().__init__("; ".join(c.message for c in report.failed("error")))
        self.report = report


@dataclass(frozen=True)
class CheckResult:
    """Outcome of one check; ``offending`` has the failing keys or rows (a plan, not yet run) and ``n_failing`` their number."""

    name: str
    impact: str
    n_failing: int
    message: str
    offending: DataFrame | None = None

    @property
    def passed(self) -> bool:
        return self.n_failing == 0


@dataclass(frozen=True)
class ValidationReport:
    """All checks of a run, and the rows split in those that break a row-wise error check and those that break none."""

    checks: tuple[CheckResult, ...]
    valid: DataFrame
    invalid: DataFrame

    @property
    def passed(self) -> bool:
        return not self.failed("error")

    def failed(self, impact: str | None = None) -> list[CheckResult]:
        return [c for c in self.checks if not c.passed and impact in (None, c.impact)]

    def to_frame(self) -> DataFrame:
        rows = [(c.name, c.impact, c.passed, c.n_failing, c.message) for c in self.checks]
        return self.valid.sparkSession.createDataFrame(rows, "check string, impact string, passed boolean, n_failing long, message string")


def _result(name: str, impact: str, bad: DataFrame, what: str) -> CheckResult:
    n = bad.count()
    return CheckResult(name, impact, n, f"{name}: {n} {what}" if n else f"{name}: passed", bad)


def check_key_columns(df: DataFrame, entity: str, time: str, impact: str = "error") -> CheckResult:
    """Entity and time must be columns, and time a whole number, date or timestamp."""
    bad = [c for c in (entity, time) if c not in df.columns]
    if not bad and not isinstance(df.schema[time].dataType, (*FAMILIES["integer"], *FAMILIES["temporal"])):
        bad = [time]
    return CheckResult("key_columns", impact, len(bad), f"key_columns: missing or of a wrong type: {bad}" if bad else "key_columns: passed")


def check_null_keys(df: DataFrame, entity: str, time: str, impact: str = "error") -> CheckResult:
    return _result("null_keys", impact, df.where(F.col(entity).isNull() | F.col(time).isNull()), "rows without an entity or a time")


def check_unique_keys(df: DataFrame, entity: str, time: str, impact: str = "error") -> CheckResult:
    """Offending are the repeated pairs, each with its count."""
    return _result("unique_keys", impact, df.groupBy(entity, time).count().where("count > 1"), "repeated pairs of entity and time")


def check_monotone_time(df: DataFrame, entity: str, time: str, order: Sequence[str], impact: str = "error") -> CheckResult:
    """In the explicit order of the columns ``order`` (of arrival, say) the time of an entity must not fall."""
    w = Window.partitionBy(entity).orderBy(*order)
    rows = df.withColumn("__before", F.lag(time).over(w)).where(F.col(time) < F.col("__before")).drop("__before")
    return _result("monotone_time", impact, rows, "rows before their predecessor's time")


def check_min_obs(df: DataFrame, entity: str, time: str, min_obs: int, impact: str = "warning") -> CheckResult:
    n = df.where(F.col(time).isNotNull()).groupBy(entity).agg(F.count_distinct(time).alias("n_obs"))
    return _result("min_obs", impact, n.where(F.col("n_obs") < min_obs), f"entities with fewer than {min_obs} times")


def _steps(df: DataFrame, time: str) -> DataFrame:
    """The times that occur, numbered: the calendar that all entities share."""
    parts = df.select(time).where(F.col(time).isNotNull()).distinct()
    return parts.withColumn("__step", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(time)))


def check_gaps(df: DataFrame, entity: str, time: str, step: int | None = None, impact: str = "warning") -> CheckResult:
    """Offending are the rows (entity, after, before, missing) between whose times a step is missing.

    ``step`` is the distance of neighbouring times in units (days for dates); without it the times that occur in the panel are
    the calendar.
    """
    keys = df.select(entity, time).where(F.col(time).isNotNull()).distinct()
    if step is None:
        keys, place = keys.join(_steps(df, time), time), F.col("__step")
    else:
        number = F.col(time) if isinstance(df.schema[time].dataType, FAMILIES["integer"]) else F.unix_date(F.to_date(time))
        keys, place = keys.withColumn("__step", number), F.col("__step") / step
    w = Window.partitionBy(entity).orderBy(time)
    rows = keys.withColumns({"after": F.lag(time).over(w), "missing": (place - F.lag(place).over(w) - 1).cast("long")}).where("missing > 0")
    return _result("gaps", impact, rows.select(entity, "after", F.col(time).alias("before"), "missing"), "gaps between neighbouring times")


def check_coverage(df: DataFrame, entity: str, time: str, min_coverage: float, impact: str = "warning") -> CheckResult:
    """Each entity must be there at so large a part of all times of the panel."""
    low = coverage(PanelFrame(df, entity, time)).where(F.col("coverage") < min_coverage)
    return _result("coverage", impact, low, f"entities below a coverage of {min_coverage}")


def check_near_duplicate_straddle(pairs: DataFrame, split: DataFrame, id_col: str, split_col: str, impact: str = "error") -> CheckResult:
    """Pairs (a, b) of near copies must not lie on both sides of a split."""
    from tideframe.operators.clean import straddling_pairs

    return _result("near_duplicate_straddle", impact, straddling_pairs(pairs, split, id_col, split_col), "near copies on both sides of the split")


def check_fitted_state(fitted_until, test: DataFrame, time: str, impact: str = "error") -> CheckResult:
    """What was fitted on rows up to ``fitted_until`` must not be judged on rows of that time or earlier."""
    return _result("fitted_state", impact, test.where(F.col(time) <= F.lit(fitted_until)), "test rows not after the end of fitting")


@dataclass(frozen=True)
class PanelValidator:
    """Runs the checks that are configured; rules are row conditions by name (true is good, null counts as good)."""

    entity: str
    time: str
    rules: Mapping[str, Column] | None = None
    min_obs: int | None = None
    min_coverage: float | None = None
    step: int | None = None
    gaps: bool = False
    order: Sequence[str] = ()

    def filter(self, df: DataFrame) -> ValidationReport:
        """All checks, and the rows split; nothing is raised."""
        keys = (df, self.entity, self.time)
        first = check_key_columns(*keys)
        if not first.passed:
            return ValidationReport((first,), df.limit(0), df)
        checks = [first, check_null_keys(*keys), check_unique_keys(*keys)]
        if self.order:
            checks.append(check_monotone_time(*keys, self.order))
        if self.min_obs is not None:
            checks.append(check_min_obs(*keys, self.min_obs))
        if self.min_coverage is not None:
            checks.append(check_coverage(*keys, self.min_coverage))
        if self.gaps or self.step is not None:
            checks.append(check_gaps(*keys, self.step))
        rules = {n: F.coalesce(r, F.lit(True)) for n, r in (self.rules or {}).items()}
        checks += [_result(f"rule {n}", "error", df.where(~r), "rows break it") for n, r in rules.items()]
        good = F.col(self.entity).isNotNull() & F.col(self.time).isNotNull()
        for r in rules.values():
            good &= r
        same = F.count(F.lit(1)).over(Window.partitionBy(self.entity, self.time)) == 1
        marked = df.withColumn("__good", good & same)
        return ValidationReport(tuple(checks), marked.where("__good").drop("__good"), marked.where("not __good").drop("__good"))

    def validate(self, df: DataFrame, raise_on_fail: bool = True) -> ValidationReport:
        """The report; warns of failed warnings, and raises if an error check failed."""
        import warnings

        report = self.filter(df)
        for c in report.failed("warning"):
            warnings.warn(c.message, QualityWarning, stacklevel=2)
        if raise_on_fail and not report.passed:
            raise PanelValidationError(report)
        return report


def validate_panel(df: DataFrame, entity: str, time: str, raise_on_fail: bool = True, **options) -> ValidationReport:
    return PanelValidator(entity, time, **options).validate(df, raise_on_fail)
