"""Linear recurrences y' = a * y + b over time as parallel scans, and the exponentially weighted mean built on them.

A step is the pair (a, b); steps compose, so the state after any stretch is that of one step.  Each key's history is cut
into blocks of time, and every block is scanned by doubling: in round k each row's step is composed with the one 2^k rows
before, which is one window function a round over one sort.  The step of a whole block is the last one in it; the few
blocks of a key are scanned in the same way, which gives the state at every block's start, and all rows follow from it.  So a
key's history is spread over as many tasks as it has blocks, and nothing but columns of doubles is computed.

Rows of a key must have different times.  A null key is a key of its own; null times come first.  Where a or b is null the
state stays as it is.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a block should have, and the most blocks that the time axis is cut into (the cuts are a literal of the plan).
BLOCK_ROWS, MOST_BLOCKS = 100_000, 1024
#: Cuts are looked up in two steps over so many each.
_FINE = 32
#: The state before a first value: far enough away to weigh nothing.
_NEVER = 1e9


@dataclass(frozen=True)
class Blocks:
    """Rows with the column ``__cell`` (key and block, never null), and the rounds that the longest block and the number of blocks take."""

    rows: DataFrame
    time: str
    rounds: int
    block_rounds: int

    def scan(self, **states: tuple[Column, Column, float]) -> Blocks:
        """Adds for each state (a, b, start) its value after the row, and before it as ``<name>_before``."""
        steps = {}
        for n, (a, b, _) in states.items():
            known = a.isNotNull() & b.isNotNull()
            steps |= {f"__a_{n}": F.when(known, a.cast("double")).otherwise(1.0), f"__b_{n}": F.when(known, b.cast("double")).otherwise(0.0)}
        inside = Window.partitionBy("__cell").orderBy(self.time)
        done = _doubled(self.rows.withColumns(steps), list(states), inside, self.rounds)
        ends = done.groupBy("__cell").agg(F.max_by(F.struct(*steps), F.struct(self.time)).alias("end")).select("__cell", "__cell.key", "__cell.block", "end.*")
        across = Window.partitionBy("key").orderBy("block")
        ends = _doubled(ends, list(states), across, self.block_rounds)
        begin = {n: F.lag(f"__a_{n}", 1, 1.0).over(across) * start + F.lag(f"__b_{n}", 1, 0.0).over(across) for n, (_, _, start) in states.items()}
        out = done.join(ends.select("__cell", *(c.alias(f"__s_{n}") for n, c in begin.items())), "__cell")
        for n in states:
            before = F.lag(f"__a_{n}", 1, 1.0).over(inside) * F.col(f"__s_{n}") + F.lag(f"__b_{n}", 1, 0.0).over(inside)
            out = out.withColumns({n: F.col(f"__a_{n}") * F.col(f"__s_{n}") + F.col(f"__b_{n}"), f"{n}_before": before})
        return replace(self, rows=out.select(*self.rows.columns, *(c for n in states for c in (n, f"{n}_before"))))


def _doubled(rows: DataFrame, names: list[str], window, rounds: int) -> DataFrame:
    """Every row's step composed with those of all rows before it in the window's partition."""
    for k in range(rounds):
        far = {}
        for n in names:
            a, b = F.col(f"__a_{n}"), F.col(f"__b_{n}")
            far |= {f"__a_{n}": a * F.lag(a, 1 << k, 1.0).over(window), f"__b_{n}": a * F.lag(b, 1 << k, 0.0).over(window) + b}
        rows = rows.withColumns(far)
    return rows


def _block_of(time: str, cuts: list) -> Column:
    """Number of cuts before a time, looked up in two steps."""
    if not cuts:
        return F.lit(0)
    every = [F.lit(c) for c in cuts]
    coarse = F.size(F.filter(F.array(*every[_FINE - 1 :: _FINE]), lambda c: c < F.col(time))) if len(cuts) >= _FINE else F.lit(0)
    fine = F.slice(F.array(*every), coarse * _FINE + 1, _FINE)
    return coarse * _FINE + F.size(F.filter(fine, lambda c: c < F.col(time)))


def time_blocks(df: DataFrame, by: list[str], time: str, block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS) -> Blocks:
    """Cuts the time axis so that the longest key gets about block_rows in a block; three aggregates reach the driver."""
    key = F.struct(*by)
    longest = df.groupBy(key.alias("key")).count().agg(F.max("count")).first()[0] or 0
    n = min(most_blocks, -(-longest // block_rows))
    cuts: list = []
    if n > 1:
        cuts = sorted(set(df.agg(F.percentile_approx(time, [i / n for i in range(1, n)], F.lit(10 * n))).first()[0] or []))
    rows = df.withColumn("__cell", F.struct(key.alias("key"), _block_of(time, cuts).alias("block")))
    held = rows.groupBy("__cell").count().agg(F.max("count")).first()[0] or 1 if cuts else max(longest, 1)
    return Blocks(rows, time, (held - 1).bit_length(), len(cuts).bit_length())


def linear_recurrence(df: DataFrame, by: list[str], time: str, states: dict[str, tuple[Column, Column, float]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds each state ``name: (a, b, start)`` after every row of its key, and before it as ``<name>_before``."""
    return time_blocks(df, by, time, block_rows).scan(**states).rows.drop("__cell")


def ewm_mean(df: DataFrame, by: list[str], time: str, x: str, halflife: float, least: int | None = None, name: str = "ewm", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds the exponentially weighted mean of x, its weights halved every ``halflife`` rows.

    The first value starts it.  A value that comes g rows after the last one has weight alpha against (1 - alpha)^g, so gaps
    let the past fade; at a null or NaN the mean stays.  Null until ``least`` (the half-life, rounded up) values were seen.
    """
    alpha = 1 - 0.5 ** (1 / halflife)
    value = F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))
    seen, carry = value.isNotNull(), value.isNull().cast("double")
    counted = time_blocks(df, by, time, block_rows).scan(__gap=(carry, carry, _NEVER), __seen=(F.lit(1.0), seen.cast("double"), 0.0))
    past = F.pow(F.lit(1 - alpha), F.col("__gap_before") + 1)
    out = counted.scan(**{name: (F.when(seen, past / (past + alpha)), F.when(seen, alpha * value / (past + alpha)), 0.0)}).rows
    least = -(-halflife // 1) if least is None else least
    return out.withColumn(name, F.when(F.col("__seen") >= least, F.col(name))).select(*df.columns, name)
