"""Registry of queries and their ANSI-SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.plans.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LATE: dict[str, Callable[[], str]] = {}
#: The columns that a query rounds, and to how many digits.
ROUNDED: dict[str, tuple[list[str], int]] = {}


class Views:
    """Views and tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def series(self, *columns: str) -> DataFrame:
        """These columns of records with their symbol, day and number: what ranges over symbols carry along."""
        return self.records.select("record_id", "symbol", "report_date", *columns)

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def t_tail(t: str, df: str) -> str:
    """SQL of a t-test's two-sided p: one minus the density's integral to |t|, by Simpson's rule."""
    weight = "(CASE WHEN i IN (0, 4000) THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END)"
    density = f"exp(-(({df}) + 1e0) / 2 * ln(1 + ((({t}) * i / 4000e0) ** 2) / ({df})))"
    return f"greatest(0e0, 1 - 2 * list_sum(list_transform(range(0, 4001), lambda i: {weight} * {density})) * abs({t}) / 12000e0 * exp(lgamma((({df}) + 1e0) / 2) - lgamma(({df}) / 2e0)) / sqrt(({df}) * pi()))"


def t_critical(df: str) -> str:
    """SQL of the value that |t| exceeds with probability 0.05: the sum of those halvings of 256 that stay below it."""
    return f"list_reduce(list_transform(range(0, 50), lambda k: 256e0 / power(2, k)), lambda c, h: CASE WHEN {t_tail('(c + h)', df)} > 0.05 THEN c + h ELSE c END, 0e0)"


def t_power(d: str, n: str, c: str) -> str:
    """SQL of the power of a two-sided one-sample t-test with critical value c: one minus the integral, by Simpson's rule, of the
    density of the angle whose tangent is t over the root of its degrees of freedom, a sum with Poisson weights."""
    df, half = f"(({n}) - 1e0)", f"(({d}) * ({d}) * ({n}) / 2e0)"
    a = f"(i * atan(({c}) / sqrt({df})) / 400e0)"
    term = f"(CASE WHEN j = 0 THEN 0e0 ELSE j * ln({half}) + 2 * j * ln(sin({a})) END) - {half} - lgamma(j + 1e0) - lgamma(j + 5e-1) + lgamma(j + {df} / 2 + 5e-1) - lgamma({df} / 2) + ({df} - 1) * ln(cos({a}))"
    poisson = f"range(0, CASE WHEN i = 0 OR {half} = 0 THEN 1 ELSE CAST(floor({half} + 12 * sqrt({half}) + 40) AS BIGINT) END)"
    weight = "(CASE WHEN i IN (0, 400) THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END)"
    return f"1 - 2 * atan(({c}) / sqrt({df})) / 1200e0 * list_sum(list_transform(range(0, 401), lambda i: {weight} * list_sum(list_transform({poisson}, lambda j: exp({term})))))"


def query(name: str, sql: str | Callable[[], str] | None = None, views: str = "", rounded: str = "", digits: int = 6):
    """Registers f(views) under name; sql may be a function that gives the text once all modules are loaded. Columns in `rounded` are rounded on both sides, as sums of doubles depend on the
    order of rows."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Views(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in rounded.split()}) if rounded else df

        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name], ROUNDED[name] = run, (rounded.split(), digits)
        if sql is not None:

            def text() -> str:
                own = sql if isinstance(sql, str) else sql()
                body = with_views(own, *views.split()) if views else own
                cols = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0e0 AS {c}" for c in rounded.split())
                return f"SELECT * REPLACE ({cols}) FROM ({body}) x" if rounded else body

            if isinstance(sql, str):
                ORACLES[name] = text()
            else:
                LATE[name] = text
        return f

    return add
