"""Exact results of bets on a race: the tree of finishing orders, as deep as the bets look, and its tail.

By Plackett and Luce a runner comes next with its chance divided by what those before it left over. A node of the tree
is the beginning of a finishing order. It is opened only where some bet names more runners behind it; everywhere else
what comes after changes no bet, so the node is an outcome. A field of n with bets to win has n outcomes, and each
different beginning that a longer bet names adds at most n. Nothing is drawn, and no scenario table exists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .rows import cross_levels


#: Runners times bets of the races whose trees grow in step; a race with more grows alone.
IN_STEP = 100_000


def _gathered(runners: DataFrame, bets: DataFrame, race: str = "race", runner: str = "runner", p: str = "p") -> DataFrame:
    """One row per race of both tables: race, field, bets, staked. Each table is dealt once, by race, and trees grow inside the row."""
    field = runners.select(F.col(race).alias("race"), F.struct(F.col(runner).alias("runner"), F.col(p).cast("double").alias("p")).alias("_r")).groupBy("race").agg(F.collect_list("_r").alias("field"))
    bet = F.struct("selection", F.coalesce((F.col("stake") * F.col("odds")).cast("double"), F.lit(0.0)).alias("pays"))
    return field.join(bets.groupBy("race").agg(F.collect_list(bet).alias("bets"), F.sum("stake").cast("double").alias("staked")), "race")


def _in_step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of races of at most IN_STEP runners times bets, or of one race."""
    work = np.cumsum(pc.list_value_length(batch.column("field")).to_numpy().astype(np.int64) * pc.list_value_length(batch.column("bets")).to_numpy())
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + IN_STEP, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def _levels(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Outcomes of the races of a batch, those of one depth together: row of the race, finishing_order, chance, won. A bet goes down the tree with the nodes that it begins with."""
    field, placed = batch.column("field"), batch.column("bets")
    n = pc.list_value_length(field).to_numpy().astype(np.int64)
    begin = np.cumsum(n) - n
    runner, p = field.flatten().flatten()
    selection, pays = placed.flatten().flatten()
    kind, named = runner.type, selection.flatten()
    if named.type != kind:
        wide = pa.int64() if pa.types.is_integer(kind) and pa.types.is_integer(named.type) else pa.float64()
        runner, named = runner.cast(wide), named.cast(wide)
    both = pa.concat_arrays([runner, named]).dictionary_encode()
    code = both.indices.fill_null(-1).to_numpy().astype(np.int64)
    who, code = code[: len(runner)], code[len(runner) :]
    no_p, p, pays = p.is_null().to_numpy(zero_copy_only=False), p.fill_null(np.nan).to_numpy(), pays.to_numpy()
    size = pc.list_value_length(selection).fill_null(0).to_numpy().astype(np.int64)
    first = np.cumsum(size) - size
    # Nodes of the depth, and bets (which, at which node) that name more runners.
    race, order = np.arange(len(n)), np.zeros((len(n), 0), np.int64)
    chance, used, won = np.ones(len(n)), np.zeros(len(n)), np.zeros(len(n))
    bet = np.flatnonzero(size > 0)
    node = np.repeat(race, pc.list_value_length(placed).to_numpy())[bet]
    for depth in range(int(size.max(initial=0)) + 1):
        opens = np.zeros(len(race), bool)
        opens[node] = True
        opens &= depth < n[race]
        end = ~opens
        values = both.dictionary.take(pa.array(order[end].ravel())).cast(kind)
        yield race[end], pa.ListArray.from_arrays(pa.array(np.arange(int(end.sum()) + 1, dtype=np.int32) * depth), values), chance[end], won[end]
        parent = np.repeat(np.flatnonzero(opens), n[race[opens]])
        if not len(parent):
            return
        width = n[race[opens]]
        at = np.arange(len(parent)) + np.repeat(begin[race[opens]] - (np.cumsum(width) - width), width)
        keep = (who[at] >= 0) & (order[parent] != who[at][:, None]).all(1)
        parent, at = parent[keep], at[keep]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where((used[parent] < 1) & ~no_p[at], p[at] / (1 - used[parent]), 0.0)
        # Bets meet the children that they name; a runner that is listed twice has two.
        key = parent * (len(both.dictionary) + 1) + who[at]
        by = np.argsort(key, kind="stable")
        ask = np.where(code[first[bet] + depth] >= 0, node * (len(both.dictionary) + 1) + code[first[bet] + depth], -1)
        low, high = (np.searchsorted(key[by], ask, side=s) for s in ("left", "right"))
        hits = high - low
        child = by[np.repeat(low, hits) + np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits)]
        bet = np.repeat(bet, hits)
        paid = size[bet] == depth + 1
        won = won[parent] + np.bincount(child[paid], pays[bet[paid]], len(parent))
        race, order, chance, used = race[parent], np.column_stack([order[parent], who[at]]), chance[parent] * share, used[parent] + p[at]
        bet, node = bet[~paid], child[~paid]


def outcome_tree(runners: DataFrame, bets: DataFrame, race: str = "race", runner: str = "runner", p: str = "p") -> DataFrame:
    """race, finishing_order, chance, won: the outcomes that the bets tell apart, their chances, and what they pay back.

    bets has race, selection (array of runners, first past the post first), stake, odds. Chances of a race sum to 1, so
    do those of its outcomes; a runner without chance, or behind a certain winner, gives outcomes of chance 0. A field
    with fewer runners than a bet names ends where all have come in, and such a bet is lost. Races of only one of the
    two tables have no outcomes.
    """

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_step(batch):
                for at, order, chance, won in _levels(part):
                    yield pa.RecordBatch.from_arrays([part.column("race").take(pa.array(at)), order, pa.array(chance), pa.array(won)], names=["race", "finishing_order", "chance", "won"])

    both = _gathered(runners, bets, race, runner, p)
    schema = StructType().add("race", both.schema["race"].dataType).add("finishing_order", ArrayType(runners.schema[runner].dataType)).add("chance", DoubleType()).add("won", DoubleType())
    return both.mapInArrow(on, schema)


def payoffs(bets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per bet and outcome of its race: odds - 1 if the selection begins the finishing order, else -1."""
    both = bets.join(outcomes.select("race", "finishing_order", "chance"), "race")
    return both.withColumn("payoff", F.when(F.expr("slice(finishing_order, 1, size(selection))") == F.col("selection"), F.col("odds") - 1).otherwise(-1.0))


def tail_risk(pnl: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """expected_return, var, cvar of the outcomes (pnl, chance) of each key.

    The value at risk is the loss of the worst outcomes, taken from the worst on until they hold alpha of the chance;
    cvar is the mean of the losses at least as large. Outcomes of equal pnl come as one row before they are sorted.
    """
    keys = list(keys)
    total = pnl.groupBy(*keys, F.round("pnl", 12).alias("pnl")).agg(F.sum("chance").alias("chance"))
    upto = F.sum("chance").over(Window.partitionBy(*keys).orderBy("pnl").rowsBetween(Window.unboundedPreceding, -1))
    tail = F.coalesce(upto, F.lit(0.0)) < alpha - 1e-12
    lost = F.when(tail, F.col("chance"))
    risk = total.withColumn("_lost", lost).groupBy(*keys).agg(
        F.sum(F.col("pnl") * F.col("chance")).alias("expected_return"),
        (-F.max(F.when(F.col("_lost").isNotNull(), F.col("pnl")))).alias("var"),
        (-F.try_divide(F.sum(F.col("pnl") * F.col("_lost")), F.sum("_lost"))).alias("cvar"),
    )
    return risk.select(*keys, "expected_return", "var", "cvar")


def _tails(race: np.ndarray, pnl: np.ndarray, chance: np.ndarray, alpha: float, out: np.ndarray) -> None:
    """tail_risk() of each race into out (expected_return, var, cvar; NaN: none). Sums run within a race, in tables of races with about as many outcomes."""
    by = np.lexsort((pnl, race))
    pnl, chance, n = pnl[by], chance[by], np.bincount(race, minlength=len(out))
    begin, wide = np.cumsum(n) - n, np.ceil(np.log2(np.maximum(n, 1))).astype(int)
    for w in np.unique(wide[n > 0]):
        some = np.flatnonzero((wide == w) & (n > 0))
        column = np.arange(1 << w)
        real = column < n[some, None]
        at = np.where(real, begin[some, None] + column, 0)
        v, c = np.where(real, pnl[at], 0.0), np.where(real, chance[at], 0.0)
        start = np.ones(v.shape, bool)  # the first of equal pnl: the chance before it decides
        start[:, 1:] = v[:, 1:] != v[:, :-1]
        before = np.concatenate([np.zeros((len(v), 1)), np.cumsum(c, 1)[:, :-1]], 1)
        before = np.take_along_axis(before, np.maximum.accumulate(np.where(start, column, 0), 1), 1)
        tail = real & (before < alpha - 1e-12)
        lost, worst = np.where(tail, c, 0.0).sum(1), np.where(tail, v, -np.inf).max(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[some, 0], out[some, 1] = (v * c).sum(1), np.where(tail.any(1), -worst, np.nan)
            out[some, 2] = np.where(lost != 0, -np.where(tail, v * c, 0.0).sum(1) / lost, np.nan)


def portfolio_risk(runners: DataFrame, bets: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per race: expected_return, var and cvar of all its bets together, in units of their stakes. As tail_risk() of the outcomes, which are no rows here."""

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_step(batch):
                race, _, chance, won = zip(*_levels(part), strict=True)
                race, out = np.concatenate(race), np.full((part.num_rows, 3), np.nan)
                pnl = np.round(np.concatenate(won) - part.column("staked").fill_null(np.nan).to_numpy()[race], 12)
                _tails(race, pnl, np.concatenate(chance), alpha, out)
                some = pa.array(np.bincount(race, minlength=len(out)) > 0)
                yield pa.RecordBatch.from_arrays([part.column("race"), *[pa.array(x, from_pandas=True) for x in out.T.copy()]], names=["race", "expected_return", "var", "cvar"]).filter(some)

    both = _gathered(runners, bets)
    schema = StructType().add("race", both.schema["race"].dataType)
    for name in ("expected_return", "var", "cvar"):
        schema = schema.add(name, DoubleType())
    return both.mapInArrow(on, schema)


def risk_capped_allocation(runners: DataFrame, bets: DataFrame, levels: Sequence[float], alpha: float = 0.05) -> DataFrame:
    """Per race and level: the stakes, at most 1 in all, scaled so that their tail loss meets the level. The tail loss is positively homogeneous, so one tree serves all levels."""
    total = bets.groupBy("race").agg(F.sum("stake").alias("_sum"), F.count("*").alias("n_bets"))
    both = cross_levels(portfolio_risk(runners, bets, alpha).join(total, "race"), levels)
    whole = F.greatest(F.lit(1.0), F.col("_sum"))
    both = both.withColumn("_scale", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("level") * whole, F.when(F.col("cvar") > 0, F.col("cvar"))), F.lit(1.0))) / whole)
    return both.select("race", "level", "n_bets", (F.col("_sum") * F.col("_scale")).alias("stake"), *[(F.col(x) * F.col("_scale")).alias(x) for x in ("expected_return", "var", "cvar")])
