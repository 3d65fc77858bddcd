"""Column expressions with the null, warm-up and tie rules of the library, as SQL text.

Rolling values are NULL until their frame holds n non-null values; zero denominators give NULL; frames are rows.
"""

from __future__ import annotations

BY = "PARTITION BY instrument_id ORDER BY bar_time"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def lag(x: str, k: int = 1, by: str = BY) -> str:
    return f"lag({x}, {k}) OVER ({by})"


def lead(x: str, k: int, by: str = BY) -> str:
    return f"lead({x}, {k}) OVER ({by})"


def frame(n: int, shift: int = 0, by: str = BY) -> str:
    end = "CURRENT ROW" if shift == 0 else f"{shift} PRECEDING"
    return f"OVER ({by} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {end})"


def rolling(agg: str, x: str, n: int, shift: int = 0, least: int | None = None, by: str = BY, args: str = "") -> str:
    """agg of the last n rows (ending ``shift`` rows ago), when at least ``least`` (default n) values are there."""
    w = frame(n, shift, by)
    return f"(CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {agg}({x}{args}) {w} END)"


def total(x, n, **k):
    return rolling("sum", x, n, **k)


def mean(x, n, **k):
    return rolling("avg", x, n, **k)


def std(x, n, **k):
    return rolling("stddev_samp", x, n, **k)


def low(x, n, **k):
    return rolling("min", x, n, **k)


def high(x, n, **k):
    return rolling("max", x, n, **k)


def quantile(x, n, q, **k):
    return rolling("@PCT", x, n, args=f", {q}", **k).replace("@PCT(", "@PCT(")


def at(f: str, x: str) -> str:
    """A cross-sectional aggregate of the row's timestamp."""
    return f"{f}({x}) OVER (PARTITION BY bar_time)"


def clip(x: str, a, b) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {a}), {b}) END)"


def pos(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, 0.0) END)"


def log1p(x: str) -> str:
    return f"ln(1 + ({x}))"


def tanh(x: str) -> str:
    return f"(1 - 2 / (exp(2 * ({x})) + 1))"


def balance(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN 2 * ({x}) / (1 + ({x}) * ({x})) END)"


def softplus(x: str) -> str:
    return f"ln(1 + exp({x}))"


def corr(x: str, y: str, n: int) -> str:
    """Rolling correlation of complete pairs; NULL where a side is constant."""
    w = frame(n)
    both = f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN"
    p, q = f"{both} ({x}) END", f"{both} ({y}) END"
    sd = f"stddev_samp({p}) {w} * stddev_samp({q}) {w}"
    return f"(CASE WHEN count({p}) {w} = {n} AND {sd} > 1e-14 THEN covar_samp({p}, {q}) {w} / ({sd}) END)"


def avg_rank(x: str, part: str, desc: bool = False) -> str:
    """Average-tie rank of a non-null value within its partition."""
    d = "DESC" if desc else "ASC"
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x} {d}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


def pct_rank(x: str, part: str, desc: bool = False) -> str:
    return f"({avg_rank(x, part, desc)} / count({x}) OVER (PARTITION BY {part}))"


def out(*columns: str, **exprs: str) -> str:
    """A final select list: key columns as they are, doubles rounded to six digits without negative zero."""
    return ", ".join([*columns, *(f"round(CAST({e} AS DOUBLE), 6) + 0.0 AS {n}" for n, e in exprs.items())])
