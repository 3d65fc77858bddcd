"""Cost-aware portfolio policy: names are picked by their edge net of cost and risk, within a turnover budget.

``decide`` is one rebalance over plain values; ``targets`` runs it in time order for every run as a grouped map, like
the rank-buffer policy in ``folds``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import folds, research

TINY = 1e-12


@dataclass(frozen=True)
class Limits:
    """Weights are shares of equity, edges and costs basis points."""

    target_count: int = 5
    max_entries: int = 3
    max_exits: int | None = None
    min_hold: int = 1
    min_net: float = 0.0
    cost: float = 13.0
    edge_per_score: float = 100.0
    risk: float = 0.0
    name_cap: float = 0.3
    gross: float = 1.0
    band: float = 0.005
    turnover: float | None = 0.8


def net_edge(score: float, edge: float | None, risk: float | None, p: Limits) -> float:
    """Expected edge, or else the positive score's, less cost and a multiple of the risk penalty."""
    return (edge or max(score, 0.0) * p.edge_per_score) - p.cost - p.risk * max(risk or 0.0, 0.0)


def chosen(net: dict[str, float], held: dict[str, folds.Held], p: Limits) -> list[str]:
    """Names to hold: those still within their minimum holding time, then the best by net edge.

    Leaving a name costs what entering one does, so held names compete with their cost added back.  Exits beyond
    the limit wait, the least attractive leaving first.
    """
    picks = sorted(n for n, h in held.items() if h.bars < p.min_hold)
    entries = 0
    for n in sorted((n for n in net if net[n] >= p.min_net and n not in picks), key=lambda n: (-net[n] - p.cost * (n in held), n)):
        if len(picks) >= p.target_count or p.gross <= 0:
            break
        if n in held:
            picks.append(n)
        elif entries < p.max_entries:
            picks.append(n)
            entries += 1
    leaving = sorted((n for n in held if n not in picks), key=lambda n: (n in net, net.get(n, 0.0), -held[n].weight, n))
    return picks + (leaving[p.max_exits :] if p.max_exits is not None else [])


def aims(picks: list[str], p: Limits) -> dict[str, float]:
    """Equal weights, each at most the name cap."""
    return {n: min(p.gross / len(picks), p.name_cap) for n in picks}


def budgeted(now: dict[str, float], aim: dict[str, float], net: dict[str, float], p: Limits) -> dict[str, float]:
    """Moves from current weights towards aims within the turnover budget.

    The budget grows by unused exposure.  Half of it is for sales, all where nothing is bought or exposure is too
    high; the rest is for purchases up to the gross limit.  Steps smaller than the band are left out.
    """
    target = dict(now)
    sells = sorted((n for n in now if aim[n] < now[n] - TINY), key=lambda n: (net.get(n, float("-inf")), n))
    buys = sorted((n for n in now if aim[n] > now[n] + TINY), key=lambda n: (-net.get(n, 0.0), n))

    def spend(names: list[str], most: float) -> float:
        spent = 0.0
        for n in names:
            step = min(abs(aim[n] - target[n]), most - spent)
            if step > TINY and step >= p.band:
                target[n] += step if aim[n] > target[n] else -step
                spent += step
        return spent

    gross = sum(now.values())
    budget = float("inf") if p.turnover is None else p.turnover + max(p.gross - gross, 0.0)
    over = gross > p.gross + TINY
    budget -= spend(sells, budget if over or not buys else budget / 2)
    budget -= spend(buys, min(budget, max(p.gross - sum(target.values()), 0.0)))
    if over:
        spend(sells, budget)
    return target


def decide(forecast: dict[str, dict], held: dict[str, folds.Held], p: Limits) -> dict[str, tuple[str, float, float | None]]:
    """(action, target weight, net edge) of every held or chosen name; forecasts carry score and perhaps edge and risk."""
    net = {n: net_edge(f["score"], f.get("edge"), f.get("risk"), p) for n, f in forecast.items()}
    picks = chosen(net, held, p)
    aim = aims(picks, p)
    now = {n: held[n].weight if n in held else 0.0 for n in {*picks, *held}}
    target = budgeted(now, {n: aim.get(n, 0.0) for n in now}, net, p)
    out = {}
    for n in sorted(now):
        if n not in held:
            action = "entry" if target[n] > TINY else "turnover_budget_limited"
        elif n in aim:
            action = "min_hold" if held[n].bars < p.min_hold else "hold"
        else:
            action = "exit" if n in forecast else "universe_removed"
        out[n] = action, target[n], net.get(n)
    return out


RUNS = {"cost_aware": Limits(), "patient": Limits(min_hold=4, max_entries=1, max_exits=1, turnover=0.3), "free": Limits(turnover=None, cost=0.0, band=0.0)}


def targets(scored: DataFrame, runs: dict[str, Limits]) -> DataFrame:
    """Decisions of each run over (bar_time, instrument_id, score); targets count as filled.

    A name enters only from the first target_count places by net edge and name: of those before it, held ones take a place
    each.  Names that never reach such a place are never held and change nothing, so a run's task doesn't get them.
    """
    able = F.lit(False)
    for p in {(p.edge_per_score, p.cost): p for p in runs.values()}.values():
        net = F.greatest("score", F.lit(0.0)) * p.edge_per_score - p.cost
        most = max(q.target_count for q in runs.values())
        able = able | (F.row_number().over(Window.partitionBy("bar_time").orderBy(net.desc(), "instrument_id")) <= most)
    scored = scored.withColumn("__able", able).withColumn("__able", F.max("__able").over(Window.partitionBy("instrument_id"))).where("__able").drop("__able")

    def step(run: str, rows: Iterator[dict]):
        held: dict[str, folds.Held] = {}

        def turn(time, forecast):
            nonlocal held
            out = decide(forecast, held, runs[run])
            said = [(run, time, n, a, round(held[n].weight, 9) if n in held else 0.0, round(w, 9), None if e is None else round(e, 6)) for n, (a, w, e) in out.items()]
            held = {n: folds.Held(w, held[n].bars + 1 if n in held else 0) for n, (_, w, _) in out.items() if w > TINY}
            return said

        time, forecast = None, {}
        for r in rows:
            if r["bar_time"] != time and forecast:
                yield from turn(time, forecast)
                forecast = {}
            time = r["bar_time"]
            forecast[r["instrument_id"]] = {"score": float(r["score"])}
        if forecast:
            yield from turn(time, forecast)

    schema = "run_id string, bar_time date, instrument_id string, action string, current_weight double, target_weight double, net_edge double"
    return folds.folded(folds.each_run(scored, runs), "run_id", ["bar_time", "instrument_id"], step, schema)


def queries() -> dict:
    scored = research.scores().then("out", "SELECT bar_time, instrument_id, score FROM scored")
    return {"policy_cost_aware": lambda spark, d: targets(research.run(scored, spark, d), RUNS)}
