"""Path-dependent operators as ordered folds: gate hysteresis, rank-buffer policy, execution simulation, EWM.

Each fold runs once for every run (a scenario or parameter set) or instrument; runs are independent and spread over
executors, time within one can't be.  A run's rows come in order from a sorted iterator, so policies and the simulator
hold one timestamp and the holdings.  The steps themselves are small functions over plain values.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import lead, mean, quantile
from ..plans.sql import Plan
from . import research

#: Output rows of a fold that are handed to Spark together.
BATCH = 10_000


def folded(df: DataFrame, key: str, order: list[str], step: Callable[[str, Iterator[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """Feeds the rows of each key, in order, to ``step``, which yields output rows.

    Spark sorts; the rows come one after another from small batches, so a task holds no more than what the step keeps.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for pdf in batches:
            yield from pdf.astype(object).where(pdf.notna(), None).to_dict("records")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for value, own in itertools.groupby(rows(batches), lambda r: r[key]):
            out = iter(step(value, own))
            while some := list(itertools.islice(out, BATCH)):
                yield pd.DataFrame(some, columns=columns)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def each_run(df: DataFrame, runs: Iterable[str]) -> DataFrame:
    return df.withColumn("run_id", F.explode(F.array(*map(F.lit, runs))))


# ------------------------------------------------------------------------------------------- gates
@dataclass(frozen=True)
class Gate:
    """Hysteresis of a gate: repeats until a state switches, step limits and a deadband on its scale."""

    confirm: int = 2
    up: float = 0.25
    down: float = 0.5
    deadband: float = 0.02
    max_step: float | None = None
    deadband_first: bool = False


def hysteresis(rows: Iterable[tuple[str, float]], gate: Gate) -> Iterator[tuple[str, float, str]]:
    """(state, scale, note) for (raw state, raw scale) rows in time order; warm-up resets confirmation."""
    state = scale = pending = None
    count = 0
    up, down = (x if gate.max_step is None else min(x, gate.max_step) for x in (gate.up, gate.down))
    for raw, wanted in rows:
        if raw == "warmup" or state is None or state == "warmup":
            state, scale, pending, count = raw, wanted, None, 0
            yield state, scale, "reset"
            continue
        if raw == state:
            pending, count = None, 0
        else:
            count = count + 1 if raw == pending else 1
            pending = raw
            if count >= gate.confirm:
                state, pending, count = raw, None, 0
        aim = wanted if raw == state else scale
        delta = aim - scale
        if gate.deadband_first and abs(delta) <= gate.deadband:
            note = "held"
        elif abs(delta) <= 1e-12:
            scale, note = aim, "taken"
        elif abs(delta) <= gate.deadband:
            note = "held"
        elif delta > up:
            scale, note = scale + up, "step_limited_up"
        elif -delta > down:
            scale, note = scale - down, "step_limited_down"
        else:
            scale, note = aim, "taken"
        yield state, scale, note


GATES = {"default": Gate(), "patient": Gate(confirm=3, up=0.1), "free": Gate(confirm=1, up=1.0, down=1.0, deadband=0.0)}
RISK_GATES = {"default": Gate(deadband_first=True), "capped": Gate(deadband_first=True, max_step=0.2)}
_GATE_SCHEMA = "run_id string, bar_time date, state string, scale double, note string"


def _gated(df: DataFrame, gates: dict[str, Gate]) -> DataFrame:
    def step(run: str, rows: Iterator[dict]):
        rows = list(rows)
        for r, (state, scale, note) in zip(rows, hysteresis(((r["raw"], float(r["wanted"])) for r in rows), gates[run])):
            yield run, r["bar_time"], state, round(scale, 9), note

    return folded(each_run(df, gates), "run_id", ["bar_time"], step, _GATE_SCHEMA)


def gate_inputs() -> Plan:
    """Raw state of the score's recent health by timestamp: blocked, reduced or full."""
    least = f"least({research.linear('g_ic', -0.05, 0.05)}, {research.linear('g_edge', -0.02, 0.02)})"
    p = research.market().then("ga", f"SELECT *, {mean('score_ic', 8, shift=2, least=4, by=research.TS)} AS g_ic, {mean('edge', 8, shift=2, least=4, by=research.TS)} AS g_edge FROM market_ts")
    p = p.then("gb", f"SELECT bar_time, CASE WHEN g_ic IS NULL OR g_edge IS NULL THEN 1.0 ELSE 0.2 + 0.8 * {least} END AS wanted, (g_ic IS NULL OR g_edge IS NULL) AS warm FROM ga")
    return p.then("out", "SELECT bar_time, wanted, CASE WHEN warm THEN 'warmup' WHEN wanted <= 0.4 THEN 'blocked' WHEN wanted < 0.7 THEN 'reduced' ELSE 'full' END AS raw FROM gb")


def risk_inputs() -> Plan:
    p = research.market().then("ri", f"SELECT *, {quantile('m_vol', 26, 0.6, shift=1, least=8, by=research.TS)} AS q_red, {quantile('m_vol', 26, 0.9, shift=1, least=8, by=research.TS)} AS q_blk FROM market_ts")
    p = p.then("rj", "SELECT bar_time, CASE WHEN q_red IS NULL OR m_vol IS NULL THEN 'warmup' WHEN round(m_vol, 9) >= round(q_blk, 9) THEN 'blocked' WHEN round(m_vol, 9) >= round(q_red, 9) THEN 'reduced' ELSE 'full' END AS raw FROM ri")
    return p.then("out", "SELECT bar_time, raw, CASE raw WHEN 'blocked' THEN 0.0 WHEN 'reduced' THEN 0.5 ELSE 1.0 END AS wanted FROM rj")


# ------------------------------------------------------------------------------------------ policy
@dataclass(frozen=True)
class Buffer:
    """Limits of the rank-buffer policy."""

    target_count: int = 5
    entry_rank: int = 5
    exit_rank: int = 10
    min_hold: int = 2
    max_entries: int = 3
    max_exits: int = 3
    name_cap: float = 0.3
    band: float = 0.005
    rate: float = 1.0
    turnover: float | None = 0.8
    gross: float = 1.0


@dataclass
class Held:
    weight: float
    bars: int = 0


def decide(forecast: dict[str, tuple[int, float]], held: dict[str, Held], p: Buffer) -> dict[str, tuple[str, float]]:
    """Action and target weight of every held or entered name, given each name's (rank, score)."""
    action: dict[str, str] = {}
    leaving = []
    for name, h in held.items():
        rank = forecast.get(name, (None, 0.0))[0]
        if rank is not None and rank <= p.exit_rank:
            action[name] = "hold_buffer"
        elif h.bars < p.min_hold:
            action[name] = "min_hold_blocked"
        else:
            leaving.append(name)
    leaving.sort(key=lambda n: (n in forecast, -forecast.get(n, (0, 0.0))[0], forecast.get(n, (0, 0.0))[1], -held[n].weight, n))
    for i, n in enumerate(leaving):
        action[n] = "exit_budget_deferred" if i >= p.max_exits else "exit" if n in forecast else "universe_removed"
    stays = [n for n, a in action.items() if a not in ("exit", "universe_removed")]
    room = min(p.target_count - len(stays), p.max_entries) if p.gross > 0 else 0
    by_rank = sorted(forecast, key=lambda n: (forecast[n][0], n))
    for n in by_rank:
        if room <= 0 or forecast[n][0] > p.entry_rank:
            break
        if n not in held:
            action[n], room = "entry", room - 1
            stays.append(n)
    aim = min(p.name_cap, 1 / len(stays)) * p.gross if stays else 0.0
    target = {}
    for n, a in action.items():
        now = held[n].weight if n in held else 0.0
        step = p.rate * ((aim if n in stays else 0.0) - now)
        if n in held and n in stays and 1e-12 < abs(step) < p.band:
            step, action[n] = 0.0, "below_weight_band"
        target[n] = now + step
    moved = {n: t - (held[n].weight if n in held else 0.0) for n, t in target.items()}
    total = sum(map(abs, moved.values()))
    if p.turnover is not None and total > p.turnover:
        target = {n: target[n] - moved[n] * (1 - p.turnover / total) for n in target}
    over = sum(target.values()) - p.gross  # buys of the lowest priority give way first
    for n in reversed(by_rank):
        if over > 1e-12 and n in target and target[n] > (now := held[n].weight if n in held else 0.0):
            cut = min(over, target[n] - now)
            target[n], over = target[n] - cut, over - cut
    return {n: (action[n], target[n]) for n in action}


POLICIES = {"rank_buffer": Buffer(), "slow": Buffer(min_hold=4, max_entries=1, max_exits=1, rate=0.5), "hold_buffer": Buffer(min_hold=0, max_entries=5, max_exits=1000, turnover=None)}


def policy_targets(scored: DataFrame, policies: dict[str, Buffer]) -> DataFrame:
    """Decisions of each policy over (bar_time, instrument_id, score_rank, score); targets count as filled.

    A name that never ranks high enough to be entered is never held and changes nothing, so a run's task doesn't get it.
    """
    reach = max(p.entry_rank for p in policies.values())
    best = F.min("score_rank").over(Window.partitionBy("instrument_id"))
    scored = scored.withColumn("__best", best).where(F.col("__best") <= reach).drop("__best")

    def step(run: str, rows: Iterator[dict]):
        held: dict[str, Held] = {}
        def turn(time, forecast):
            out = decide(forecast, held, policies[run])
            rows = [(run, time, n, a, round(held[n].weight, 9) if n in held else 0.0, round(w, 9)) for n, (a, w) in sorted(out.items())]
            kept = {n: Held(w, held[n].bars + 1 if n in held else 0) for n, (_, w) in out.items() if w > 1e-12}
            held.clear()
            held.update(kept)
            return rows
        time, forecast = None, {}
        for r in rows:
            if r["bar_time"] != time and forecast:
                yield from turn(time, forecast)
                forecast = {}
            time = r["bar_time"]
            forecast[r["instrument_id"]] = (int(r["score_rank"]), float(r["score"]))
        if forecast:
            yield from turn(time, forecast)

    schema = "run_id string, bar_time date, instrument_id string, action string, current_weight double, target_weight double"
    return folded(each_run(scored, policies), "run_id", ["bar_time", "score_rank"], step, schema)


# --------------------------------------------------------------------------------------- execution
@dataclass(frozen=True)
class Costs:
    commission: float = 0.0003
    least_commission: float = 5.0
    stamp: float = 0.0005
    slip: float = 0.0005
    lot: int = 100
    capacity: float | None = 0.05
    min_weight: float = 0.001
    cash: float = 1e8


@dataclass
class Account:
    cash: float
    lots: dict[str, list[list]] = field(default_factory=dict)  # name: [shares, sellable], oldest first
    last: dict[str, float] = field(default_factory=dict)

    def shares(self, name: str, sellable: bool = False) -> int:
        return sum(n for n, free in self.lots.get(name, []) if free or not sellable)

    def equity(self) -> float:
        return self.cash + sum(self.shares(n) * self.last.get(n, 0.0) for n in self.lots)

    def remove(self, name: str, count: int) -> None:
        for lot in self.lots[name]:
            taken = min(lot[0], count) if lot[1] else 0
            lot[0] -= taken
            count -= taken
        self.lots[name] = [x for x in self.lots[name] if x[0]]


def trade(acc: Account, name: str, bar: dict | None, target: float, equity: float, c: Costs) -> str:
    """Trades one name towards its target weight at the open; returns what happened."""
    price = bar and bar["open_price"]
    if not price or price <= 0:
        return "missing_price"
    if not bar["tradable_bar"]:
        return "non_tradable"
    delta = target * equity - acc.shares(name) * price
    if abs(delta) < c.min_weight * equity:
        return "below_min_trade_weight"
    room = math.inf if c.capacity is None else math.floor(max(bar["capacity"] or 0.0, 0.0) * c.capacity / price)
    fee = lambda value: max(value * c.commission, c.least_commission) if c.commission > 0 else 0.0
    if delta > 0:
        if bar["limit_up_open"]:
            return "limit_up_buy_blocked"
        if delta <= price * c.lot:
            return "none"
        wanted = math.floor(delta / price / c.lot) * c.lot
        count = wanted if room >= wanted else int(room // c.lot * c.lot)
        if count <= 0:
            return "capacity_zero"
        value = count * price * (1 + c.slip)
        if value + fee(value) > acc.cash:
            return "cash_insufficient"
        acc.cash -= value + fee(value)
        acc.lots.setdefault(name, []).append([count, False])
        return "bought" if count == wanted else "capacity_capped"
    if bar["limit_down_open"]:
        return "limit_down_sell_blocked"
    wanted = math.floor(-delta / price + 1e-9)
    free = acc.shares(name, sellable=True)
    count = int(min(wanted, free, room))
    if count <= 0:
        return "none" if wanted <= 0 else "t1_sell_limited" if free <= 0 else "capacity_zero"
    acc.remove(name, count)
    value = count * price * (1 - c.slip)
    acc.cash += value - fee(value) - value * c.stamp
    return "sold" if count == wanted else "t1_sell_limited" if count == free else "capacity_capped"


def simulate(rows: Iterator[dict], c: Costs) -> Iterator[tuple]:
    """(exec_time, equity, cash, names, buys, sells, blocked) of each time, for bars with targets in time order.

    Shares bought become sellable when the trade date changes; names trade in id order, so that cash from a later
    sale can't pay an earlier purchase; times without a target only mark to the close.
    """
    acc, day = Account(c.cash), None

    def turn(time, bars):
        nonlocal day
        date = next(iter(bars.values()))["trade_date"]
        if date != day:
            day = date
            for lots in acc.lots.values():
                for lot in lots:
                    lot[1] = True
        acc.last.update((n, b["open_price"]) for n, b in bars.items() if b["open_price"])
        equity = acc.equity()
        targets = {n: b["target_weight"] for n, b in bars.items() if b["target_weight"] is not None}
        said = [trade(acc, n, bars.get(n), targets.get(n, 0.0), equity, c) for n in sorted({*targets, *acc.lots})] if targets else []
        acc.last.update((n, b["close_price"]) for n, b in bars.items() if b["close_price"])
        buys, sells = said.count("bought"), said.count("sold")
        return time, round(acc.equity(), 4), round(acc.cash, 4), sum(acc.shares(n) > 0 for n in acc.lots), buys, sells, len(said) - buys - sells - said.count("none")

    time, bars = None, {}
    for r in rows:
        if r["exec_time"] != time and bars:
            yield turn(time, bars)
            bars = {}
        time = r["exec_time"]
        bars[r["instrument_id"]] = r  # of duplicate targets the last counts
    if bars:
        yield turn(time, bars)


SCENARIOS = {"base": Costs(), "high_cost": Costs(commission=0.0006, slip=0.001), "zero_cost": Costs(commission=0.0, least_commission=0.0, stamp=0.0, slip=0.0), "no_capacity_limit": Costs(capacity=None)}


def execution_inputs() -> Plan:
    """Bars of all names that were ever a target, with the previous timestamp's targets and its turnover as capacity."""
    p = research.rebalances().then("nb", f"SELECT bar_time, {lead('bar_time', 1, research.TS)} AS exec_time FROM (SELECT DISTINCT bar_time FROM exec_bars) d")
    p = p.then("goals", "SELECT n.exec_time, o.instrument_id, o.target_weight FROM orders o JOIN nb n ON o.bar_time = n.bar_time WHERE n.exec_time IS NOT NULL")
    p = p.then("cp", "SELECT *, lag(turnover) OVER (PARTITION BY instrument_id ORDER BY bar_time) AS capacity FROM exec_bars")
    return p.then("out", "SELECT c.bar_time AS exec_time, c.instrument_id, c.trade_date, c.open_price, c.close_price, c.capacity, c.tradable_bar, c.limit_up_open, c.limit_down_open, g.target_weight FROM cp c LEFT JOIN goals g ON c.bar_time = g.exec_time AND c.instrument_id = g.instrument_id WHERE c.instrument_id IN (SELECT instrument_id FROM goals)")


def simulated(bars: DataFrame, scenarios: dict[str, Costs]) -> DataFrame:
    def step(run: str, rows: Iterator[dict]):
        for out in simulate(rows, scenarios[run]):
            yield run, *out

    schema = "run_id string, exec_time date, equity double, cash double, names long, buys long, sells long, blocked long"
    return folded(each_run(bars, scenarios), "run_id", ["exec_time", "instrument_id"], step, schema)


# ------------------------------------------------------------------------- multiple-testing control
def bh_qvalues(summary: DataFrame) -> DataFrame:
    """Two-sided normal p-values of t statistics and Benjamini-Hochberg q-values over all features (few rows)."""
    @F.pandas_udf("double")
    def two_sided(t: pd.Series) -> pd.Series:
        return t.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    p = summary.where("t_stat IS NOT NULL").select("feature", "t_stat").withColumn("p_value", two_sided("t_stat"))
    return p.sparkSession.sql("""
      WITH k AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS i, count(*) OVER () AS m FROM {p})
      SELECT feature, round(p_value, 9) AS p_value, round(least(1e0, min(p_value * m / i) OVER (ORDER BY i DESC)), 9) AS q_value FROM k""", p=p)


def queries() -> dict:
    scored = research.scores().then("out", "SELECT bar_time, instrument_id, score_rank, score FROM scored")
    summary = research.by_timestamp().then("out", research._summary())
    return {
        "gate_hysteresis": lambda spark, d: _gated(research.run(gate_inputs(), spark, d), GATES),
        "risk_hysteresis": lambda spark, d: _gated(research.run(risk_inputs(), spark, d), RISK_GATES),
        "policy_rank_buffer": lambda spark, d: policy_targets(research.run(scored, spark, d), {k: v for k, v in POLICIES.items() if k != "hold_buffer"}),
        "hold_buffer": lambda spark, d: policy_targets(research.run(scored, spark, d), {"hold_buffer": POLICIES["hold_buffer"]}),
        "simulate_targets": lambda spark, d: simulated(research.run(execution_inputs(), spark, d), SCENARIOS),
        "bh_qvalues": lambda spark, d: bh_qvalues(summary.over(spark, d)),
    }
