"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (one combination of the raked columns), combined before the shuffle. Raking scales the cells
in turn until the token shares along each column meet their targets; a cell's factor is its weight. A document is kept
once at most, so the expected tokens of a cell are bounded by its tokens: a second fit within these bounds gives the
probability of its documents. There the tokens along each column are the targets' parts of the budget; a value with fewer
tokens than its part gives all it has, and the others share the rest by their targets. With share=None the budget is the
largest multiple of the raked tokens within all bounds, and every target is met. A document is kept if a hash of its
doc_id, uniform in [0, 1), lies below its cell's probability. `report` lists targets, expected shares and the values that
cannot reach theirs.

Cells are a summary, at most the product of the columns' distinct values. They are raked as one table of numbers on the
driver, at any size of the corpus; more than MAX_CELLS of them raise an error.

A table without topics gets them from the form of a text: numbers, table, symbols, shout or prose, the first that has its
share of the text's characters (`FORMS`).

Defined results: nulls are a value of their own in every raked column; null text counts 0 tokens and follows its cell;
documents without doc_id share one draw; repeated rows are kept or dropped together; an empty table gives an empty
result; cells without tokens get probability 1.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.store import fresh, keep

DIMS = ["source", "lang", "topic"]
#: By default a column's targets are its measured shares, tempered: each to this power, scaled to sum 1.
TEMPER = {"source": 0.6, "lang": 0.7, "topic": 0.8}
KEEP_SHARE, ROUNDS, FIT_ROUNDS, CLOSE, SEED, MAX_CELLS = 0.75, 40, 200, 1e-7, 17, 1_000_000
NULL = "\u0000"


#: What most prose is made of; and each form's characters, with their least share of all characters of a text.
ORDINARY = "a-z \\n\\r.,;:!?'()\"-"
FORMS = {"numbers": ("0-9", 0.25), "table": ("|\\t", 0.02), "symbols": ("#*$%&<>=_~^+", 0.05), "shout": ("A-Z", 0.4)}


def topic() -> Column:
    """A topic by form, for tables without one. The ordinary characters are taken out once; the forms are counted in what is
    left, which is short."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = F.regexp_replace(text, f"[{ORDINARY}]+", "")
    of = F.struct(F.length(text).alias("whole"), rest.alias("rest"))

    def form(x: Column) -> Column:
        out, size = F.when(F.length(x["rest"]) == 0, "prose"), F.length(x["rest"])
        for name, (characters, share) in FORMS.items():
            out = out.when(size - F.length(F.regexp_replace(x["rest"], f"[{characters}]+", "")) >= F.greatest(x["whole"] * share, F.lit(1.0)), name)
        return out.otherwise("prose")

    return F.transform(F.array(of), form)[0]  # so that the text is searched once


def tokens() -> Column:
    """Token weight of a text: a quarter of its UTF-8 bytes, rounded up."""
    return ((F.coalesce(F.octet_length("text"), F.lit(0)) + 3) / 4).cast("bigint")


def rake(weight: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """weight scaled so that its sums by each code meet the targets (masses over the same total)."""
    w = weight.astype(float)
    for _ in range(ROUNDS):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            mass = np.bincount(code, w, len(target))
            factor = np.divide(target, mass, out=np.ones_like(target), where=mass > 0)
            worst = max(worst, float(np.abs(factor[mass > 0] - 1).max(initial=0)))
            w = w * factor[code]
        if worst < CLOSE:
            break
    return w


def reach(have: np.ndarray, target: np.ndarray, budget: float) -> np.ndarray:
    """Masses within what the values have, in proportion to target where that allows, with budget as their sum."""
    k = budget / max(target.sum(), 1e-300)
    while True:
        full = k * target >= have
        more = (budget - have[full].sum()) / target[~full].sum() if target[~full].sum() > 0 else 0
        if more <= k * (1 + 1e-12):
            return np.minimum(have, k * target)
        k = more


def fit(fitted: np.ndarray, bound: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray]) -> np.ndarray:
    """fitted scaled so that the sums of min(fitted, bound) by each code meet the goals."""
    x = fitted.astype(float)
    for _ in range(FIT_ROUNDS):
        worst = 0.0
        for code, goal in zip(codes, goals, strict=True):
            full = x >= bound
            held, free = np.bincount(code, bound * full, len(goal)), np.bincount(code, x * ~full, len(goal))
            mass = held + free
            # what is full stays, the rest is scaled; where the full cells are too much, all is
            some = (goal > held) & (free > 0)
            factor = np.divide(np.where(some, goal - held, goal), np.where(some, free, mass), out=np.ones(len(mass)), where=mass > 0)
            factor[(free <= 0) & (goal >= held)] = 1
            worst = max(worst, float((np.abs(mass - goal)[mass > 0] / np.maximum(goal, 1e-300)[mass > 0]).max(initial=0)))
            x = x * factor[code]
        if worst < CLOSE:
            break
    return x


def calibrate(expected: Callable[[float], float], budget: float) -> float:
    """The constant at which the expected tokens meet the budget (they grow with it)."""
    low, high = 0.0, 1.0
    while expected(high) < budget * (1 - 1e-12) and high < 1e9:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < budget else (low, mid)
    return high


def margin(cells: DataFrame, d: str, temper: dict[str, float], targets: dict[str, dict[str, float]]) -> DataFrame:
    """(d, tokens, target) of each value of a column; the targets are masses over the same total."""
    m = cells.groupBy(d).agg(F.sum("tokens").alias("tokens"))
    if d in targets:
        given = cells.sparkSession.createDataFrame(list(targets[d].items()), f"{d} string, part double")
        m = m.join(given, d, "left").withColumn("part", F.coalesce("part", F.lit(0.0)))
    else:
        m = m.withColumn("part", F.pow(F.col("tokens").cast("double"), F.lit(temper[d])))
    total, whole = m.agg(F.sum("tokens"), F.sum("part")).first()
    return m.select(d, "tokens", (F.col("part") / (whole or 1.0) * (total or 0)).alias("target"))


def probabilities(docs: DataFrame, share: float | None = KEEP_SHARE, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(the raked columns, weight, probability) by cell of docs(the raked columns, tokens)."""
    temper, targets = temper or TEMPER, targets or {}
    cells = docs.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")).limit(MAX_CELLS + 1).toPandas()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} combinations of {', '.join(DIMS)}")
    have = cells["tokens"].to_numpy(float)
    total = have.sum()
    codes, goals, margins = [], [], []
    for d in DIMS:
        values = sorted(cells[d].unique())
        codes.append(np.searchsorted(np.array(values, object), cells[d].to_numpy(object)) if len(values) else np.zeros(0, np.int64))
        margins.append(np.bincount(codes[-1], have, len(values)))
        part = np.array([targets[d].get(v, 0.0) for v in values]) if d in targets else margins[-1] ** temper[d]
        goals.append(part / max(part.sum(), 1e-300) * total)
    fitted = rake(have, codes, goals)
    weight = np.divide(fitted, have, out=np.ones(len(have)), where=have > 0)
    if share is None:
        kept = fitted / max(weight[have > 0].max(initial=0), 1e-300)
    else:
        budget = min([share * total, *(float(m[g > 0].sum()) for m, g in zip(margins, goals, strict=True))])
        kept = fit(fitted * share, have, codes, [reach(m, g, budget) for m, g in zip(margins, goals, strict=True)])
        kept = kept * calibrate(lambda c: float(np.minimum(have, c * kept).sum()), budget)
    cells["weight"] = weight
    cells["probability"] = np.minimum(1, np.divide(kept, have, out=np.ones(len(have)), where=have > 0))
    return docs.sparkSession.createDataFrame(cells[[*DIMS, "weight", "probability"]], f"{', '.join(f'{d} string' for d in DIMS)}, weight double, probability double")


def uniform(seed: int = SEED) -> Column:
    """A number in [0, 1) from doc_id, with 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), 11) / F.lit(float(1 << 53))


def with_probability(docs: DataFrame, **options) -> tuple[DataFrame, dict[str, str]]:
    """docs with its raked columns (null as a value), tokens, weight and probability, and the names of these columns,
    which docs does not have. A topic column that docs has is used."""
    names = {n: fresh(docs, f"mix_{n}") for n in [*DIMS, "tokens", "weight", "probability"]}
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("topic") if "topic" in docs.columns else topic()}
    rows = docs.withColumns({names[d]: F.coalesce(c.cast("string"), F.lit(NULL)) for d, c in values.items()} | {names["tokens"]: tokens()})
    cells = probabilities(rows.select(*(F.col(names[d]).alias(d) for d in DIMS), F.col(names["tokens"]).alias("tokens")), **options)
    return rows.join(cells.select(*(F.col(c).alias(names[c]) for c in [*DIMS, "weight", "probability"])), [names[d] for d in DIMS], "left"), names


def sample(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability and kept of every row."""
    rows, n = with_probability(docs, **options)
    kept = uniform() < F.col(n["probability"])
    return rows.select(F.col("doc_id").cast("long"), *(F.nullif(n[d], F.lit(NULL)).alias(d) for d in DIMS), *(F.col(n[c]).alias(c) for c in ("tokens", "weight", "probability")), kept.alias("kept"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept."""
    rows, n = with_probability(docs, **options)
    return rows.filter(uniform() < F.col(n["probability"])).select(docs.columns)


def report(docs: DataFrame, **options) -> DataFrame:
    """For each value of each raked column: its tokens, its target and its expected share of the kept tokens, and whether
    it has as many tokens as its target asks for."""
    rows, n = with_probability(docs, **options)
    cells = keep(rows.groupBy(*(F.col(n[d]).alias(d) for d in DIMS)).agg(F.sum(n["tokens"]).alias("tokens"), F.sum(F.col(n["tokens"]) * F.col(n["probability"])).alias("kept")), "mixed-cells")
    total, kept = (x or 1 for x in cells.agg(F.sum("tokens"), F.sum("kept")).first())
    out = None
    for d in DIMS:
        m = margin(cells, d, options.get("temper") or TEMPER, options.get("targets") or {})
        m = m.join(cells.groupBy(d).agg(F.sum("kept").alias("kept")), d).select(F.lit(d).alias("dim"), F.nullif(d, F.lit(NULL)).alias("value"), "tokens", (F.col("target") / total).alias("target"), (F.col("kept") / kept).alias("expected"), (F.col("target") / total * kept <= F.col("tokens") * (1 + 1e-9)).alias("reachable"))
        out = m if out is None else out.unionByName(m)
    return out
