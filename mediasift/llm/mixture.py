"""Mixing sources to target weights, by iterative proportional fitting with a cap on repeats.

Token counts of cells (source x language x topic) are raked until each source has its share of the tokens and languages
and topics keep theirs; a cell's weight, the expected number of copies of its documents, never exceeds what its source may
repeat. Documents are then drawn by these weights.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.session import cut

#: Cells that the driver rakes: the bound of the control table that goes there. More are raked where they are.
CELLS = 10_000
#: Sources that a table of weights may list: it's a control table, which the driver reads and sends to all tasks.
SOURCES = 100_000


@dataclass(frozen=True)
class Raked:
    """Weights of the cells, and of each source its target and what the weights give, in tokens."""

    cells: list[tuple]
    weights: np.ndarray
    sources: list[str]
    target: np.ndarray
    reached: np.ndarray
    short: list[bool]
    rounds: int
    residual: float


def _fill(w: np.ndarray, tokens: np.ndarray, cap: np.ndarray, goal: float) -> np.ndarray:
    """Weights scaled alike so that the tokens sum to goal, but none above its cap; all at their caps if that's too little."""
    full = np.zeros(len(w), bool)
    while not full.all():
        now = (w * tokens)[~full].sum()
        if now <= 0:
            break
        scaled = w * (max(goal - (cap * tokens)[full].sum(), 0.0) / now)
        over = ~full & (scaled > cap)
        if not over.any():
            return np.where(full, cap, scaled)
        full |= over
    return np.where(full, cap, w)


def _places(values: list) -> dict:
    """Where each value stands, by value in order."""
    at: dict = {}
    for i, v in enumerate(values):
        at.setdefault(v, []).append(i)
    return {v: np.array(at[v]) for v in sorted(at)}


def rake(cells: list[tuple], tokens: np.ndarray, shares: dict[str, float], repeats: dict[str, int], rounds: int = 200, tolerance: float = 1e-9) -> Raked:
    """`cells`: (source, level, level, ...) with their tokens. Each round fits the margins of the levels, which keep the
    proportions they have in the corpus (of the tokens that the sources can give), and last the sources, whose targets are shares of all tokens of the listed
    sources. It ends when no weight moves by more than the tolerance, or after `rounds`. So sources are met exactly unless capped, and the others as near as that allows: `residual` is
    the largest distance of a level from its goal, by the goal. A source is `short` if all its cells stand at their caps and still give less than its target; that is decided in
    whole tokens and exact fractions, as a rounding must not."""
    names = sorted(shares)
    total = float(tokens.sum())
    target = np.array([shares[s] * total for s in names])
    w = np.ones(len(cells))
    cap = np.array([float(max(repeats[c[0]], 0)) for c in cells])
    of_source = _places([c[0] for c in cells])
    member = [of_source.get(s, np.empty(0, np.int64)) for s in names]
    margins = [list(_places([c[k] for c in cells]).values()) for k in range(1, len(cells[0]) if cells else 1)]
    goals = [[tokens[m].sum() for m in margin] for margin in margins]
    done, before = 0, w
    for done in range(1, rounds + 1):
        before = w.copy()
        size = np.minimum(target, [(cap * tokens)[m].sum() for m in member]).sum() / total if total else 0.0
        for margin, goal in zip(margins, goals):
            for m, g in zip(margin, goal):
                w[m] = _fill(w[m], tokens[m], cap[m], g * size)
        for m, t in zip(member, target):
            w[m] = _fill(w[m], tokens[m], cap[m], t)
        if not len(w) or np.abs(w - before).max() <= tolerance:
            break
    off = [abs((w * tokens)[m].sum() / (g * size) - 1) for margin, goal in zip(margins, goals) for m, g in zip(margin, goal) if g * size > 0]
    full = [bool((w[m] >= cap[m] * (1 - 1e-9)).all()) and too_few(sum(int(t) for t in tokens[m]), repeats[s], shares[s], int(total)) for m, s in zip(member, names)]
    return Raked(cells, w, names, target, np.array([(w * tokens)[m].sum() for m in member]), full, done, max(off, default=0.0))


def too_few(tokens: int, repeats: int, share: float, total: int) -> bool:
    """Whether all tokens, repeated as often as allowed, are fewer than the share of the total: exactly, the share taken as the decimal that it is written as."""
    return tokens * max(repeats, 0) < Fraction(repr(share)) * total


def rake_wide(cells: DataFrame, names: list[str], plan: dict[str, tuple[float, int]], rounds: int = 200, tolerance: float = 1e-9) -> tuple[DataFrame, Raked]:
    """`rake` for any number of cells, a table of `source`, the levels and `tokens`: the same steps, each level's cells and then each source's fitted
    in one task. The table of cells with `_w` and `_cap`, and the sums by source."""
    have = {r["source"]: float(r["t"] or 0) for r in cells.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = sum(have.values())
    target = {s: p[0] * total for s, p in plan.items()}
    size = sum(min(target[s], max(p[1], 0) * have.get(s, 0.0)) for s, p in plan.items()) / total if total else 0.0
    caps = cells.sparkSession.createDataFrame([(s, max(p[1], 0)) for s, p in plan.items()], "source string, _cap int")
    columns = ["source", *names, "tokens", "_cap", "_w", "_before"]
    fields = ", ".join(f"{n} string" for n in ["source", *names]) + ", tokens double, _cap int, _w double, _before double"

    def fitted(column: str):
        def run(g):
            tokens = g["tokens"].to_numpy(float)
            goal = target[g["source"].iloc[0]] if column == "source" else tokens.sum() * size
            return g.assign(_w=_fill(g["_w"].to_numpy(float), tokens, g["_cap"].to_numpy(float), goal))[columns]

        return run

    now = cells.join(F.broadcast(caps), "source").withColumns({"tokens": F.coalesce(F.col("tokens").cast("double"), F.lit(0.0)), "_w": F.lit(1.0), "_before": F.lit(1.0)}).select(*columns)
    done = 0
    for done in range(1, rounds + 1):
        now = now.withColumn("_before", F.col("_w"))
        for column in [*names, "source"]:
            now = now.groupBy(column).applyInPandas(fitted(column), fields)
        now = cut(now)
        change = now.agg(F.max(F.abs(F.col("_w") - F.col("_before")))).first()[0]
        if change is None or change <= tolerance:
            break
    of_source = now.groupBy("source").agg(F.sum(F.col("_w") * F.col("tokens")).alias("t"), F.min(F.col("_w") - F.col("_cap") * (1 - 1e-9)).alias("room"))
    got = {r["source"]: (r["t"], r["room"] >= 0) for r in of_source.collect()}
    sources = sorted(plan)
    short = [got.get(s, (0.0, True))[1] and too_few(int(have.get(s, 0)), plan[s][1], plan[s][0], int(total)) for s in sources]
    off = [now.groupBy(n).agg(F.abs(F.sum(F.col("_w") * F.col("tokens")) / F.nullif(F.sum("tokens") * size, F.lit(0.0)) - 1).alias("o")).agg(F.max("o")).first()[0] or 0.0 for n in names]
    sums = Raked([], np.empty(0), sources, np.array([target[s] for s in sources]), np.array([got.get(s, (0.0, True))[0] for s in sources]), short, done, max(off, default=0.0))
    return now.select("source", *names, "_w", "_cap"), sums


def mix(documents: DataFrame, weights: DataFrame, id_column: str, source: Column, tokens: Column, margins: dict[str, Column], seed: int = 7, most_cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """Two tables: `id_column`, `source`, `tokens` and `copies` of each document that is in the mixture, and the report by source:
    `source`, `target_share`, `max_repeats`, `tokens` (available), `target_tokens`, `capped_tokens` (the most that repeats
    allow), `raked_tokens`, `mixed_tokens`, `actual_share` (of what is mixed), `share_of_target` (of the total that the targets are shares of: where some sources fall short, others have more of what is mixed, but
    no more of this), `reachable`, and of the raking `rounds` and `residual` (the largest distance of a level of a margin from its goal).

    `weights` (`source`, `target_share`, `max_repeats`) has few rows; more than SOURCES are an error. Only sources listed there take part; a listed source without
    documents reaches nothing. A null share or cap counts as 0, of a source listed twice the shares add up and the larger
    cap holds. Null sources match nothing; null levels of a margin are a level. Documents without tokens are in no mixture. A document gets the
    integer part of its weight as copies, and one more with the probability of the rest, decided by a hash of its id: the
    same in every run, and never more than the source's cap. Every level of a margin is told apart; up to `most_cells` cells are raked by the driver, more by Spark.
    """
    listed = weights.groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats")).where("source IS NOT NULL")
    plan = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in listed.limit(SOURCES + 1).collect()}
    if len(plan) > SOURCES:
        raise ValueError(f"a table of weights lists at most {SOURCES} sources")
    names = list(margins)
    base = documents.select(F.col(id_column), source.alias("source"), tokens.cast("long").alias("tokens"), *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in margins.items()))
    # cut, as it is read several times, and counting tokens is costly
    counted = cut(base.join(F.broadcast(listed.select("source")), "source"))
    table = counted.groupBy("source", *names).agg(F.sum("tokens").alias("tokens"))
    spark = documents.sparkSession
    rows = table.limit(most_cells + 1).collect()
    if len(rows) > most_cells:
        by_cell, raked = rake_wide(table, names, plan)
    else:
        rows = sorted(tuple(r) for r in rows)
        cells, size = [r[:-1] for r in rows], np.array([float(r[-1] or 0) for r in rows])
        raked = rake(cells, size, {s: p[0] for s, p in plan.items()}, {s: p[1] for s, p in plan.items()})
        fields = ", ".join(f"{n} string" for n in ["source", *names])
        by_cell = F.broadcast(spark.createDataFrame([(*c, float(w), plan[c[0]][1]) for c, w in zip(cells, raked.weights)], f"{fields}, _w double, _cap int"))
    u = (F.xxhash64(F.col(id_column), F.lit(seed)).bitwiseAND(F.lit(2**53 - 1))) / F.lit(float(2**53))
    copies = F.least(F.floor("_w") + (u < F.col("_w") - F.floor("_w")).cast("long"), F.col("_cap"))
    drawn = counted.where("tokens > 0").join(by_cell, ["source", *names]).withColumn("copies", copies.cast("int"))
    mixed = drawn.where("copies > 0").select(id_column, "source", "tokens", "copies")
    got = counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).alias("a")
    rows = [(s, plan[s][0], plan[s][1], float(t), float(r), not low, raked.rounds, float(raked.residual)) for s, t, r, low in zip(raked.sources, raked.target, raked.reached, raked.short)]
    report = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, target_tokens double, raked_tokens double, reachable boolean, rounds int, residual double")
    total = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    report = report.join(got, "source", "left").join(total, "source", "left").fillna(0, ["tokens", "mixed_tokens"])
    everything = mixed.agg(F.sum(F.col("tokens") * F.col("copies")).alias("_all"))
    report = report.crossJoin(everything).select(
        "source", "target_share", "max_repeats", "tokens", "target_tokens",
        (F.col("tokens") * F.col("max_repeats")).alias("capped_tokens"), "raked_tokens", "mixed_tokens",
        F.coalesce(F.col("mixed_tokens") / F.nullif("_all", F.lit(0)), F.lit(0.0)).alias("actual_share"),
        F.coalesce(F.col("mixed_tokens") * F.col("target_share") / F.nullif("target_tokens", F.lit(0.0)), F.lit(0.0)).alias("share_of_target"), "reachable", "rounds", "residual",
    )
    return mixed, report
