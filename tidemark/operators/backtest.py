"""Strategy backtests on a prediction log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio, return_band, sanitize
from tidemark.operators.ordered import ROWS_PER_SLICE, Running, axis_cuts, framed, running
from tidemark.operators.walkforward import MIN_TEST, block_number
from tidemark.session import materialize

# Names of the strategies.
STRATEGIES = [
    "buy_hold", "h21_long_cash", "clf_daily_long_cash", "hysteresis_60_35", "predret_long_cash", "h21_long_short",
    "clf_daily_long_short", "predret_long_short",
]
ENTER, LEAVE = 0.60, 0.35
HOLD_ROWS = 21
CAPITAL = 1_000_000.0


def hysteresis(score: Column, enter: float = ENTER, leave: float = LEAVE) -> Running:
    """State that switches on at ``enter``, off at ``leave`` and holds in between.

    The state is the last switch seen; before the first switch it is NULL (off).
    """
    return Running("last", F.when(score >= enter, 1.0).when(score <= leave, 0.0))


def add_state(df: DataFrame, keys: Sequence[str], ts: str, score: str, name: str = "state", **slicing) -> DataFrame:
    held = running(df, keys, ts, {name: hysteresis(F.col(score))}, **slicing)
    return held.withColumn(name, F.coalesce(name, F.lit(0.0)))


def _exposures() -> dict[str, Column]:
    daily = F.coalesce(F.col("proba_up") >= F.col("threshold"), F.lit(False))
    predicted = F.coalesce(F.col("pred_return_direct") > 0, F.lit(False))
    held = F.coalesce(F.col("__held") == 1, F.lit(False))
    sides = {"long_cash": 0.0, "long_short": -1.0}

    def pick(test: Column, other: float) -> Column:
        return F.when(test, 1.0).otherwise(other)

    return {
        "buy_hold": F.lit(1.0),
        "hysteresis_60_35": F.coalesce("__state", F.lit(0.0)),
        **{f"h21_{side}": pick(held, other) for side, other in sides.items()},
        **{f"clf_daily_{side}": pick(daily, other) for side, other in sides.items()},
        **{f"predret_{side}": pick(predicted, other) for side, other in sides.items()},
    }


def past_type(held: str = "int") -> str:
    """What a key's earlier rows leave behind: rows so far, held signal, hysteresis state and one entry per strategy."""
    entry = "struct<strategy: string, exposure: double, growth: double, peak: double>"
    return f"struct<n_rows: bigint, held: {held}, state: double, book: array<{entry}>>"


def _rows(preds: DataFrame, keys: Sequence[str], ts: str, price: str) -> DataFrame:
    return preds.select(*keys, ts, price, "proba_up", "threshold", "pred_return_direct", "pred_up_calibrated")


def backtest(
    preds: DataFrame,
    keys: Sequence[str],
    ts: str = "ds",
    price: str = "px",
    start: str | date | None = None,
    end: str | date | None = None,
    capital: float = CAPITAL,
    cost: float = 0.0,
    slippage: float = 0.0,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Daily exposure, return, capital and drawdown of eight strategies.

    Needs ``proba_up``, ``threshold``, ``pred_up_calibrated`` and
    ``pred_return_direct``. The strategies stay side by side as columns until the
    end, so they share one shuffle and one sort; the last row of a key has no
    return yet and is dropped.
    """
    rows = preds
    if start is not None:
        rows = rows.where(F.col(ts) >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col(ts) <= F.lit(end).cast("date"))
    rows = _rows(rows, keys, ts, price)
    nothing = F.lit(None).cast(past_type(rows.schema["pred_up_calibrated"].dataType.simpleString()))
    curves = strategy_curves(rows.withColumn("__past", nothing), keys, ts, price, capital, cost, slippage, rows_per_slice)
    return strategy_rows(curves, keys, ts, price)


def strategy_curves(
    rows: DataFrame, keys: Sequence[str], ts: str, price: str, capital: float, cost: float, slippage: float,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """All strategies side by side; ``__past`` on a key's first row says what earlier rows left behind."""
    slicing = {"rows_per_slice": rows_per_slice, "cuts": axis_cuts(rows, ts, rows_per_slice, keys)}
    past = {s: F.get("__past.book", F.lit(i)) for i, s in enumerate(STRATEGIES)}

    def next_row(w: WindowSpec) -> dict[str, Column]:
        return {
            "ret1": ratio(F.lead(price, 1).over(w), F.col(price)) - 1,
            "__more": F.lead(F.lit(True), 1, False).over(w),
        }

    moved = framed(rows, keys, ts, next_row, back=0, ahead=1, **slicing).where("__more").drop("__more")
    moved = moved.withColumn("ret1", F.coalesce("ret1", F.lit(0.0)))
    step = F.coalesce("__past.n_rows", F.lit(0)) + 1
    numbered = running(moved, keys, ts, {"__at": Running("total", step)}, **slicing)
    rebalance = F.when((F.col("__at") - 1) % HOLD_ROWS == 0, F.coalesce(F.col("pred_up_calibrated"), F.lit(0)))
    switched = hysteresis(F.col("proba_up"))
    states = {
        "__held": Running("last", F.coalesce(rebalance, "__past.held")),
        "__state": Running("last", F.coalesce(switched.value, "__past.state")),
    }
    held = running(numbered, keys, ts, states, **slicing)
    exposed = held.withColumns({f"e_{s}": e for s, e in _exposures().items()})

    def turnovers(w: WindowSpec) -> dict[str, Column]:
        before = {s: F.coalesce(F.lag(f"e_{s}", 1).over(w), past[s]["exposure"], F.lit(0.0)) for s in STRATEGIES}
        return {f"t_{s}": F.abs(F.col(f"e_{s}") - before[s]) for s in STRATEGIES}

    traded = framed(exposed, keys, ts, turnovers, back=1, **slicing).withColumns(
        {f"r_{s}": F.col(f"e_{s}") * F.col("ret1") - F.col(f"t_{s}") * (cost + slippage) for s in STRATEGIES}
    )
    grown = {s: (1 + F.col(f"r_{s}")) * F.coalesce(past[s]["growth"], F.lit(1.0)) for s in STRATEGIES}
    growth = running(traded, keys, ts, {f"g_{s}": Running("product", grown[s]) for s in STRATEGIES}, **slicing)
    funded = growth.withColumns({f"c_{s}": F.col(f"g_{s}") * capital for s in STRATEGIES})
    highs = {f"h_{s}": Running("high", F.greatest(F.col(f"c_{s}"), past[s]["peak"])) for s in STRATEGIES}
    return running(funded, keys, ts, highs, **slicing)


def strategy_rows(curves: DataFrame, keys: Sequence[str], ts: str, price: str) -> DataFrame:
    per_strategy = F.array(
        *[
            F.struct(
                F.lit(s).alias("strategy"),
                F.col(f"e_{s}").alias("exposure"),
                F.col("ret1"),
                F.col(f"t_{s}").alias("turnover"),
                F.col(f"r_{s}").alias("net_return"),
                F.col(f"c_{s}").alias("capital"),
                (ratio(F.col(f"c_{s}"), F.col(f"h_{s}")) - 1).alias("drawdown"),
            )
            for s in STRATEGIES
        ]
    )
    return curves.select(*keys, ts, price, "proba_up", "threshold", "pred_return_direct", F.inline(per_strategy))


def advance(
    state: DataFrame | None, preds: DataFrame, keys: Sequence[str], ts: str = "ds", price: str = "px", capital: float = CAPITAL,
    cost: float = 0.0, slippage: float = 0.0, rows_per_slice: int = ROWS_PER_SLICE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The backtest of new rows alone, going on from ``state``: (series, new state, late rows).

    ``state`` has one row per key: its last prediction, which has no return before the
    next one comes, and ``past``, what all rows before left behind. None starts afresh.
    The series of all steps together are those of one backtest over all rows. A key
    without new rows keeps its state. Rows that do not come after their key's last
    prediction are late: they change nothing and are given back.
    """
    new, late = _rows(preds, keys, ts, price), None
    past = past_type(new.schema["pred_up_calibrated"].dataType.simpleString())
    if state is None:
        rows, late = new.withColumn("__past", F.lit(None).cast(past)), new.limit(0)
    else:
        told = new.join(state.select(*keys, F.col(ts).alias("__last")), list(keys), "left")
        known = F.coalesce(F.col(ts) <= F.col("__last"), F.lit(False))
        late = told.where(known).drop("__last")
        rows = told.where(~known).select(*new.columns, F.lit(None).cast(past).alias("__past"))
        rows = rows.unionByName(state.select(*new.columns, F.col("past").alias("__past")))
    rows = materialize(rows)
    curves = materialize(strategy_curves(rows, keys, ts, price, capital, cost, slippage, rows_per_slice))
    entry = {s: F.struct(F.lit(s).alias("strategy"), F.col(f"e_{s}").alias("exposure"), F.col(f"g_{s}").alias("growth"), F.col(f"h_{s}").alias("peak")) for s in STRATEGIES}
    left = F.struct(F.col("__at").alias("n_rows"), F.col("__held").alias("held"), F.col("__state").alias("state"), F.array(*entry.values()).alias("book"))
    done = curves.groupBy(*keys).agg(F.max_by(left, ts).cast(past).alias("__done"))
    shown = [c for c in new.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*shown, "__past"), ts).alias("__r")).select(*keys, "__r.*")
    after = last.join(done, list(keys), "left").select(*new.columns, F.coalesce("__done", "__past").alias("past"))
    return strategy_rows(curves, keys, ts, price), after, late


def backtest_summary(
    series: DataFrame, keys: Sequence[str], ts: str = "ds", capital: float = CAPITAL, cost: float = 0.0, slippage: float = 0.0
) -> DataFrame:
    sums = series.groupBy(*keys, "strategy").agg(
        F.max_by("capital", ts).alias("capital_final"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("hit_rate"),
        F.avg(F.abs("exposure")).alias("time_in_market"),
        F.count_if(F.col("turnover") > 0).alias("n_position_changes"),
        F.min(ts).alias("start_date"),
        F.max(ts).alias("end_date"),
    )
    years = F.datediff("end_date", "start_date") / 365.25
    growth = F.col("capital_final") / capital
    return sums.withColumns(
        {
            "capital_initial": F.lit(capital),
            "total_return": growth - 1,
            "cagr": F.when(years > 0, sanitize(F.pow(growth, F.try_divide(F.lit(1.0), years)) - 1)),
            "cost": F.lit(cost),
            "slippage": F.lit(slippage),
        }
    )


def market_regime_periods(
    series: DataFrame, keys: Sequence[str], ts: str = "ds", months: int = 6, strategies: Sequence[str] = STRATEGIES
) -> DataFrame:
    """Six-month windows from each key's first day, labelled by the buy-and-hold return."""
    first = series.groupBy(*keys).agg(F.min(ts).alias("__first"))
    numbered = series.join(first, list(keys)).withColumn("window_id", block_number(F.col(ts), F.col("__first"), months))
    held = F.col("strategy") == "buy_hold"
    windows = numbered.groupBy(*keys, "window_id").agg(
        F.min(F.when(held, F.col(ts))).alias("inicio"),
        F.max(F.when(held, F.col(ts))).alias("fin"),
        (F.product(F.when(held, 1 + F.col("ret1"))) - 1).alias("buyhold_return"),
        F.count_if(held).alias("n_dias"),
        *[(F.product(F.when(F.col("strategy") == s, 1 + F.col("net_return"))) - 1).alias(s) for s in strategies],
    )
    labelled = windows.where(F.col("n_dias") >= MIN_TEST)
    return labelled.withColumn("regimen_mercado", return_band(F.col("buyhold_return")))


def market_regime_summary(periods: DataFrame, keys: Sequence[str], strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    return periods.groupBy(*keys, "regimen_mercado").agg(
        F.count("*").alias("n_periodos"),
        F.avg("buyhold_return").alias("buyhold_return"),
        *[F.avg(s).alias(s) for s in strategies],
    )


def strategy_by_period(series: DataFrame, keys: Sequence[str], period: str, ts: str = "ds") -> DataFrame:
    """Start and end capital and behaviour of each strategy inside each period."""
    sums = series.groupBy(*keys, "strategy", period).agg(
        F.min(ts).alias("fecha_ini"),
        F.max(ts).alias("fecha_fin"),
        F.count("*").alias("n"),
        F.min_by("capital", ts).alias("capital_ini_periodo"),
        F.max_by("capital", ts).alias("capital_fin_periodo"),
        F.avg("net_return").alias("mean_daily_return"),
        F.stddev_samp("net_return").alias("vol_daily_return"),
        F.min("drawdown").alias("max_drawdown_period"),
        F.avg(F.abs("exposure")).alias("time_in_market"),
    )
    change = ratio(F.col("capital_fin_periodo"), F.col("capital_ini_periodo")) - 1
    return sums.where(F.col("n") >= MIN_TEST).withColumn("period_return", change)


def quick_backtest(
    preds: DataFrame, keys: Sequence[str], ts: str = "ds", price: str = "px", signal: str = "pred_up_calibrated",
    capital: float = CAPITAL, rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Final capital and worst drawdown: holding against trading on yesterday's signal."""
    known = preds.where(F.col(price).isNotNull()).select(*keys, ts, price, signal)
    slicing = {"rows_per_slice": rows_per_slice, "cuts": axis_cuts(known, ts, rows_per_slice, keys)}

    def columns(w: WindowSpec) -> dict[str, Column]:
        change = F.coalesce(ratio(F.col(price), F.lag(price, 1).over(w)) - 1, F.lit(0.0))
        return {"__ret": change, "__on": F.coalesce(F.lag(signal, 1).over(w).cast("double"), F.lit(0.0))}

    moved = framed(known, keys, ts, columns, back=1, **slicing)
    steps = {"buy_hold": 1 + F.col("__ret"), "model": 1 + F.col("__on") * F.col("__ret")}
    curves = running(moved, keys, ts, {f"c_{n}": Running("product", s) for n, s in steps.items()}, **slicing)
    peaks = running(curves, keys, ts, {f"h_{n}": Running("high", F.col(f"c_{n}")) for n in steps}, **slicing)
    return peaks.groupBy(*keys).agg(
        F.min(ts).alias("start_date"),
        F.max(ts).alias("end_date"),
        *[(F.max_by(f"c_{n}", ts) * capital).alias(f"{n}_final") for n in steps],
        *[F.min(ratio(F.col(f"c_{n}"), F.col(f"h_{n}")) - 1).alias(f"{n}_max_drawdown") for n in steps],
    )


def expected_prices(
    preds: DataFrame, magnitude: DataFrame, keys: Sequence[str], ts: str, price: str, volatility: Column, tiebreak: Sequence[str]
) -> DataFrame:
    """Predicted return and price: the magnitude model's where known, else from the score.

    Of several magnitude rows per key and time the last is used, so the join never
    multiplies predictions.
    """
    latest = magnitude.groupBy(*keys, ts).agg(F.max_by("pred_return_direct", F.struct(*tiebreak)).alias("__direct"))
    fallback = (F.col("proba_up") - 0.5) * 2 * volatility
    joined = preds.join(latest, [*keys, ts], "left").withColumn("pred_return_direct", F.coalesce("__direct", fallback))
    return joined.drop("__direct").withColumn("expected_price_h21", F.col(price) * F.exp("pred_return_direct"))
