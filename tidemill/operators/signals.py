"""Registered signals as predicates over features and parameter cells."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import written
from . import indicators as I
from .scans import over_blocks
from .segments import frame, ordered

Grid = dict[str, list[float]]


@dataclass(frozen=True)
class Signal:
    """``needs``: features by lookback parameter, or without one. ``rule`` is a predicate of features and ``p.<parameter>``."""

    name: str
    grid: Grid
    rule: str
    first: int = 1
    needs: tuple[tuple[str, str | None], ...] = ()
    hold: bool = False
    latch: tuple[str, str] | None = None
    over: dict[str, str] = field(default_factory=dict)


# The registered parameter grids.
SIGNALS: dict[str, Signal] = {
    s.name: s
    for s in (
        Signal("hyp0001", {"lookback": [120, 168, 216], "confirmation": [12, 24, 36]}, "{ret:lookback} > 0 and {ret:confirmation} > 0"),
        Signal("hyp0002", {"lookback": [36, 48, 60], "entry": [-0.015, -0.02, -0.025], "exit": [-0.0025, -0.005, -0.0075]}, "", latch=("close / {sma:lookback} - 1 <= p.entry", "close / {sma:lookback} - 1 >= p.exit")),
        Signal("hyp0003", {"lookback": [18, 24, 30], "range_lookback": [18, 24, 30], "threshold": [0.0075, 0.01, 0.0125]}, "", latch=("close > {max_close:lookback} and {norm_range:range_lookback} >= p.threshold", "close < {min_close:lookback}")),
        Signal(
            "hyp0004",
            {"ema": [160, 200, 240], "slope": [12, 24, 36], "trigger": [18, 24, 30]},
            "",
            latch=("{up} and {cross}", "close < {sma:trigger} or not ({up})"),
            over={"up": "{ema:ema} > {ema_ago:ema,slope} and close > {ema:ema}", "cross": "prev_close <= {sma_prev:trigger} and close > {sma:trigger}"},
        ),
        Signal("hyp0005", {"volume_lookback": [24, 48], "shock": [2, 3, 4], "return_threshold": [0.005, 0.01, 0.015]}, "{med_vol:volume_lookback} > 0 and volume >= p.shock * {med_vol:volume_lookback} and ret_1 >= p.return_threshold"),
        Signal("hyp0006", {"lead_threshold": [0.01, 0.015, 0.02], "gap": [0.0025, 0.005, 0.01]}, "lead_ret >= p.lead_threshold and lead_ret - ret_1 >= p.gap"),
        Signal("hyp0007", {"volume_lookback": [24, 48], "shock": [2, 3, 4], "return_threshold": [-0.01, -0.015, -0.02]}, "{med_vol:volume_lookback} > 0 and volume >= p.shock * {med_vol:volume_lookback} and ret_1 <= p.return_threshold"),
        Signal("hyp0008", {"lookback": [24, 48], "multiplier": [2, 3, 4], "threshold": [0.01, 0.015, 0.02]}, "{med_abs:lookback} > 0 and ret_4 >= p.threshold and ret_4 >= p.multiplier * {med_abs:lookback}"),
        Signal("hyp0009", {"compression": [0.5, 0.7, 0.9], "breakout_lookback": [12, 24], "breakout": [0.001, 0.005, 0.01]}, "vol_12 <= p.compression * vol_12_med and close >= {max_close:breakout_lookback} * (1 + p.breakout)"),
        Signal("hyp0010", {"selloff": [0.005, 0.01, 0.015], "volume_multiplier": [0, 1, 1.5]}, "bar_idx >= 2 and prev_ret <= -p.selloff and ret_1 <= -p.selloff and close > open and (p.volume_multiplier = 0 or volume >= p.volume_multiplier * med_vol_24)"),
        Signal("hyp0011", {"selloff": [0.005, 0.01, 0.015], "location": [0.75, 0.85, 0.95]}, "prev_ret <= -p.selloff and close > open and location >= p.location"),
        Signal("hyp0012", {"lookback": [24, 48], "multiplier": [2, 3, 4], "location": [0.75, 0.85]}, "{range_exp:lookback} >= p.multiplier and location >= p.location"),
        Signal("hyp0013", {"pullback": [0.005, 0.01, 0.015], "trend_lookback": [24, 48], "location": [0.5, 0.7]}, "bar_idx >= p.trend_lookback + 1 and prev_close > {close_ago:trend_lookback} and prev_ret <= -p.pullback and close > open and close > {close_ago:trend_lookback} and location >= p.location"),
        Signal("hyp0014", {"breakout": [0, 0.0025, 0.005], "location": [0.75, 0.85]}, "prev_high <= prev_high_2 and prev_low >= prev_low_2 and close >= prev_high * (1 + p.breakout) and location >= p.location"),
        Signal("hyp0015", {"lookback": [24, 48], "volume_multiplier": [1.5, 2.5, 4], "location": [0.75, 0.9]}, "close > open and close_4 < prev_close and {med_vol:lookback} > 0 and volume >= p.volume_multiplier * {med_vol:lookback} and location >= p.location"),
        Signal("hyp0016", {"weekday": [5, 6], "trend_threshold": [0.005, 0.01], "location": [0.75, 0.9]}, "weekday = p.weekday and close_4 / close_8 - 1 >= p.trend_threshold and close > open and location >= p.location"),
        Signal("hyp0017", {"gap": [0.0025, 0.005, 0.01], "location": [0.75, 0.9]}, "opening_gap >= p.gap and close > open and location >= p.location"),
        Signal("hyp0018", {"threshold": [0.005, 0.01, 0.02], "location": [0.75, 0.9]}, "close_3 < close_2 and close_2 < prev_close and prev_close < close and close / close_3 - 1 >= p.threshold and location >= p.location"),
        Signal("hyp0019", {"lookback": [12, 24], "breakout": [0, 0.0025], "volume_cap": [0.75, 1.0], "location": [0.75, 0.9]}, "close >= {max_close:lookback} * (1 + p.breakout) and {med_vol:lookback} > 0 and volume <= p.volume_cap * {med_vol:lookback} and location >= p.location"),
        Signal("hyp0020", {"hour": [0, 8, 12, 16, 20], "threshold": [0.005, 0.01], "location": [0.75, 0.9]}, "hour = p.hour and close > open and ret_1 >= p.threshold and location >= p.location"),
        Signal("hyp0021", {"k": [3, 4], "threshold": [0.005, 0.01], "location": [0.25, 0.5]}, "{min_ret:k} > 0 and prev_close / {close_ago:k} - 1 >= p.threshold and location <= p.location"),
        Signal("hyp0022", {"body_ratio": [0.6, 0.8], "range_ratio": [0.005, 0.01, 0.02], "body_return": [0.0025, 0.005]}, "high > low and close > open and (close - open) / (high - low) >= p.body_ratio and range_prev >= p.range_ratio and (close - open) / prev_close >= p.body_return"),
        Signal("hyp0023", {"abnormal": [0.05, 0.1], "threshold": [0, 0.005], "hold_bars": [6, 12, 24]}, "ret_24 >= p.abnormal and ret_1 >= p.threshold", hold=True),
        Signal("hyp0024", {"quantile": [0.2, 0.3], "buffer": [0, 0.0025], "hold_bars": [12, 24]}, "rank_720 <= p.quantile and close >= max_high_24 * (1 + p.buffer)", hold=True),
        Signal("hyp0025", {"parent_body_ratio": [0.5, 0.7], "location": [0.6, 0.75], "hold_bars": [12, 24]}, "prev_close < prev_open and close > open and prev_high > prev_low and (prev_open - prev_close) / (prev_high - prev_low) >= p.parent_body_ratio and open >= prev_close and close <= prev_open and location >= p.location", hold=True),
    )
}


# The registered base parameters of the hypotheses on events.
BASES: dict[str, dict[str, float]] = {
    "hyp0005": {"volume_lookback": 24, "shock": 3, "return_threshold": 0.01},
    "hyp0006": {"lead_threshold": 0.015, "gap": 0.005},
    "hyp0007": {"volume_lookback": 24, "shock": 3, "return_threshold": -0.015},
    "hyp0008": {"lookback": 24, "multiplier": 3, "threshold": 0.015},
    "hyp0009": {"compression": 0.7, "breakout_lookback": 12, "breakout": 0.005},
    "hyp0010": {"selloff": 0.01, "volume_multiplier": 0},
    "hyp0011": {"selloff": 0.01, "location": 0.85},
    "hyp0012": {"lookback": 24, "multiplier": 3, "location": 0.85},
    "hyp0013": {"pullback": 0.01, "trend_lookback": 24, "location": 0.7},
    "hyp0014": {"breakout": 0.0025, "location": 0.85},
    "hyp0015": {"lookback": 24, "volume_multiplier": 2.5, "location": 0.9},
    "hyp0016": {"weekday": 5, "trend_threshold": 0.005, "location": 0.9},
    "hyp0017": {"gap": 0.005, "location": 0.9},
    "hyp0018": {"threshold": 0.01, "location": 0.9},
    "hyp0019": {"lookback": 24, "breakout": 0.0025, "volume_cap": 0.75, "location": 0.9},
    "hyp0020": {"hour": 0, "threshold": 0.005, "location": 0.9},
    "hyp0021": {"k": 3, "threshold": 0.005, "location": 0.5},
    "hyp0022": {"body_ratio": 0.6, "range_ratio": 0.005, "body_return": 0.0025},
    "hyp0023": {"abnormal": 0.1, "threshold": 0.005, "hold_bars": 12},
    "hyp0024": {"quantile": 0.2, "buffer": 0.0025, "hold_bars": 12},
    "hyp0025": {"parent_body_ratio": 0.5, "location": 0.75, "hold_bars": 12},
}


def base_cell(name: str) -> int:
    """The number of a hypothesis' base in its registered grid."""
    return reduce(lambda n, p: n * len(SIGNALS[name].grid[p]) + SIGNALS[name].grid[p].index(BASES[name][p]), SIGNALS[name].grid, 0)


def _by_lookback(kind: str, n: int) -> Column:
    """The features that a rule names as ``{kind:parameter}``, for one value of the parameter."""
    return {
        "ret": lambda: I.ret(n),
        "sma": lambda: I.sma(n),
        "max_close": lambda: I.prior_extreme("close", n),
        "min_close": lambda: I.prior_extreme("close", n, False),
        "norm_range": lambda: I.norm_range(n),
        "med_vol": lambda: I.prior_median("volume", n),
        "med_abs": lambda: I.prior_abs_ret_median(n),
        "range_exp": lambda: I.range_expansion(n),
        "close_ago": lambda: I.lag("close", n),
        "min_ret": lambda: F.when(F.col("bar_idx") >= n + 1, F.min("ret_1").over(frame(-n, -1))),
    }[kind]()


_FIXED = {
    "prev_close": lambda: I.lag("close", 1),
    "prev_open": lambda: I.lag("open", 1),
    "prev_high": lambda: I.lag("high", 1),
    "prev_low": lambda: I.lag("low", 1),
    "prev_high_2": lambda: I.lag("high", 2),
    "prev_low_2": lambda: I.lag("low", 2),
    "close_2": lambda: I.lag("close", 2),
    "close_3": lambda: I.lag("close", 3),
    "close_4": lambda: I.lag("close", 4),
    "close_8": lambda: I.lag("close", 8),
    "prev_ret": lambda: I.lag("ret_1", 1),
    "ret_4": lambda: I.ret(4),
    "ret_24": lambda: I.ret(24),
    "opening_gap": I.opening_gap,
    "hour": lambda: F.hour("ts"),
    "weekday": lambda: F.weekday("ts"),
    "med_vol_24": lambda: I.prior_median("volume", 24),
    "max_high_24": lambda: I.prior_extreme("high", 24),
}


def param_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """All combinations of ``grid``, numbered from 0 as nested loops in its order: ``cell`` and a double per parameter."""
    df = spark.range(1).select(F.lit(0).cast("bigint").alias("cell"))
    for name, values in grid.items():
        axis = F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias("_i", name)
        df = df.select("*", axis).withColumn("cell", F.col("cell") * len(values) + F.col("_i")).drop("_i")
    return df


def assert_cells(cells: DataFrame, n: int) -> DataFrame:
    """``cells`` if there are ``n``, else an error."""
    found = cells.count()
    if found != n:
        raise ValueError(f"{found} parameter cells, not {n}")
    return cells


def grid_size(*names: str) -> int:
    """How many cells the registered grids of some signals have together."""
    return sum(reduce(lambda a, b: a * len(b), SIGNALS[n].grid.values(), 1) for n in names)


def _bound(rule: str, signal: Signal, grid: Grid) -> tuple[str, dict[str, tuple[str, list[int]]]]:
    """The rule with feature placeholders as column expressions, and the features (column prefix: kind, lookbacks)."""
    import re

    wanted: dict[str, tuple[str, list[int]]] = {}

    def place(m: re.Match) -> str:
        kind, params = m[1], m[2].split(",")
        if kind == "sma_prev":
            kind = "sma"
            suffix = "_prev"
        else:
            suffix = ""
        values = [int(v) for v in grid[params[0]]]
        if kind == "ema_ago":
            pairs = [(a, b) for a in values for b in map(int, grid[params[1]])]
            return "case " + " ".join(f"when p.{params[0]} = {a} and p.{params[1]} = {b} then ema_{a}_ago_{b}" for a, b in pairs) + " end"
        wanted[kind + suffix] = (kind, sorted({*values, *wanted.get(kind + suffix, (kind, []))[1]}))
        return f"case p.{params[0]} " + " ".join(f"when {v} then {kind}{suffix}_{v}" for v in values) + " end"

    for name, text in signal.over.items():
        rule = rule.replace("{" + name + "}", text)
    return re.sub(r"\{(\w+):([\w,]+)\}", place, rule), wanted


def _wanted(signal: Signal, grid: Grid) -> tuple[str, dict[str, tuple[str, list[int]]]]:
    """The signal's bound rules, and the features by lookback that they read."""
    text, wanted = "", {}
    for r in signal.latch or (signal.rule,):
        bound, more = _bound(r, signal, grid)
        text += " " + bound
        for column, (kind, values) in more.items():
            wanted[column] = (kind, sorted({*values, *wanted.get(column, (kind, []))[1]}))
    return text, wanted


def features_for(seg: DataFrame, *signals: tuple[Signal, Grid]) -> DataFrame:
    """``seg`` with the features that the signals' rules read, each lookback of their grids once, in one pass."""
    read = [(signal, grid, *_wanted(signal, grid)) for signal, grid in signals]
    df = seg
    for n in sorted({int(v) for signal, grid in signals if signal.name == "hyp0004" for v in grid["ema"]}):
        df = I.ema(df, n)
    if any("rank_720" in text for _, _, text, _ in read):
        df = I.prior_rank(df)
    # no feature looks further back than all its parameters and the longest fixed window together
    halo = 800 + max(sum(int(max(abs(v) for v in values)) for values in grid.values()) for _, grid in signals)

    def build(d: DataFrame) -> DataFrame:
        d = I.with_base_columns(d)
        for one in read:
            d = _features(d, *one)
        return d

    return over_blocks(df, build, halo)


def _features(seg: DataFrame, signal: Signal, grid: Grid, text: str, wanted: dict[str, tuple[str, list[int]]]) -> DataFrame:
    import re

    df = seg
    if signal.name == "hyp0004":
        df = df.withColumns({f"ema_{n}_ago_{k}": F.lag(f"ema_{n}", k).over(ordered()) for n in map(int, grid["ema"]) for k in map(int, grid["slope"])})
    words = set(re.findall(r"[a-z_0-9]+", text))
    if "vol_12" in words and "vol_12" not in df.columns:
        df = df.withColumn("vol_12", I.prior_realized_vol(12))
        df = df.withColumn("vol_12_med", I.median_of_vol())  # med_vol_12 is the median volume of a lookback of 12
    own = {c: make() for c, make in _FIXED.items() if c in words}
    for column, (kind, values) in wanted.items():
        for v in values:
            if kind != "ema":
                own[f"{column}_{v}"] = _by_lookback(kind, v) if not column.endswith("_prev") else F.lag(f"{kind}_{v}", 1).over(ordered())
    direct = {c: e for c, e in own.items() if "_prev_" not in c and c not in df.columns}
    df = df.withColumns(direct) if direct else df
    late = {c: e for c, e in own.items() if "_prev_" in c and c not in df.columns}
    return df.withColumns(late) if late else df


def _groups(parts: list[str], grid: Grid) -> tuple[list[str], list[tuple[list[str], list[str]]]]:
    """The conditions without a parameter, and the others by groups of parameters that no condition joins with those of another group."""
    import re

    plain, groups = [], [([p], []) for p in grid]
    for part in parts:
        own = {p for p in re.findall(r"\bp\.(\w+)", part)}
        if not own:
            plain.append(part)
            continue
        met = [g for g in groups if own & set(g[0])]
        groups = [g for g in groups if g not in met] + [(sorted({p for g in met for p in g[0]}, key=list(grid).index), [c for g in met for c in g[1]] + [part])]
    return plain, groups


def _hits(features: DataFrame, name: str, grid: Grid) -> DataFrame:
    """The bars of every cell on which the signal fires, from bars with its features.

    A rule is a conjunction, and most of its conditions have one threshold. So a bar isn't tried against each cell: it is
    held against what all cells ask first, then against the values of each group of parameters on its own, and the cells
    that fire are all combinations of the values that hold. Conditions grow with the sum of the groups, rows with the hits.
    """
    import re

    signal = SIGNALS[name]
    rule, _ = _bound(signal.rule, signal, grid)
    plain, groups = _groups(rule.split(" and "), grid)
    stride, size = {}, 1
    for p in reversed(grid):
        stride[p], size = size, size * len(grid[p])
    df = features.filter(" and ".join([f"bar_idx >= {signal.first}", *plain]))
    for k, (params, conditions) in enumerate(groups):
        held = []
        for combo in product(*[range(len(grid[p])) for p in params]):
            value = {p: float(grid[p][i]) for p, i in zip(params, combo)}
            cell = sum(stride[p] * i for p, i in zip(params, combo))
            own = F.struct(F.lit(cell).cast("bigint").alias("cell"), *[F.lit(value[p]).alias(p) for p in params])
            text = " and ".join(re.sub(r"\bp\.(\w+)", lambda m: f"({value[m[1]]!r}D)", c) for c in conditions)  # noqa: B023
            held.append(F.when(F.expr(text), own) if text else own)
        df = df.withColumn(f"_g{k}", F.explode(F.array_compact(F.array(*held))))
    at = {p: f"_g{k}" for k, (params, _) in enumerate(groups) for p in params}
    cell = sum((F.col(f"_g{k}.cell") for k in range(1, len(groups))), F.col("_g0.cell"))
    return df.select("symbol", "segment_id", "bar_idx", "ts", cell.alias("cell"), F.struct(*[F.col(f"{at[p]}.{p}").alias(p) for p in grid]).alias("params"))


def evaluate_grid(seg: DataFrame, name: str, grid: Grid | None = None) -> DataFrame:
    """The bars of every cell on which a signal fires: symbol, segment_id, bar_idx, ts, ``cell`` and its ``params``. Features are computed once per lookback."""
    signal = SIGNALS[name]
    grid = grid or signal.grid
    if signal.latch:
        raise ValueError(f"{name} has a held state: see held_targets")
    return _hits(features_for(seg, (signal, grid)), name, grid)


def evaluate_grids(seg: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``evaluate_grid`` of several signals with their registered grids: ``hypothesis``, symbol, segment_id, bar_idx, ts, cell, and for how many bars the cell holds.

    The features of all are computed in one pass and written; each signal reads its own columns of them.
    """
    features = written(features_for(seg, *[(SIGNALS[n], SIGNALS[n].grid) for n in names]), "features")
    out = None
    for name in names:
        hold = F.col("params.hold_bars").cast("int") if SIGNALS[name].hold else F.lit(1)
        hits = _hits(features, name, SIGNALS[name].grid).select(F.lit(name).alias("hypothesis"), "symbol", "segment_id", "bar_idx", "ts", "cell", hold.alias("hold"))
        out = hits if out is None else out.unionByName(hits)
    return out


def latch(enter: Column, exit_: Column) -> Column:
    """1 from an entry until an exit (then 0), and 0 before any: the last of them so far. They must exclude each other."""
    change = F.when(F.coalesce(enter, F.lit(False)), 1).when(F.coalesce(exit_, F.lit(False)), 0)
    held = F.last(change, ignorenulls=True).over(_cell_order().rowsBetween(_UNBOUNDED, 0))
    return F.coalesce(held, F.lit(0))


_UNBOUNDED = -(1 << 63)


def _cell_order():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("cell", "symbol", "segment_id").orderBy("bar_idx")


def held_targets(seg: DataFrame, name: str, grid: Grid | None = None) -> DataFrame:
    """The target (0 or 1) of every bar and cell of a target-weight signal: the bars' columns, ``cell`` and ``target``."""
    signal = SIGNALS[name]
    grid = grid or signal.grid
    features = features_for(seg, (signal, grid))
    cells = param_grid(seg.sparkSession, grid).select("cell", F.struct(*grid).alias("p"))
    if not signal.latch:
        rule, _ = _bound(signal.rule, signal, grid)
        target = F.coalesce(F.expr(rule), F.lit(False)).cast("int")
        out = features.join(F.broadcast(cells)).withColumn("target", target)
    else:
        enter, exit_ = (_bound(r, signal, grid)[0] for r in signal.latch)
        # a bar before the warm-up has null features and changes nothing
        start = F.expr("bar_idx >= greatest(p.ema - 1, p.slope + p.trigger - 1)") if name == "hyp0004" else F.expr("bar_idx >= greatest(p.lookback, p.range_lookback)") if name == "hyp0003" else F.lit(True)
        out = features.join(F.broadcast(cells)).withColumns({"_in": start & F.expr(enter), "_out": start & F.expr(exit_)})
        out = out.withColumn("target", latch(F.col("_in"), F.col("_out")))
    return out.select("cell", "symbol", "segment_id", "bar_idx", "ts", "open", "high", "low", "close", "target")


def vwap_triggers(bars: DataFrame, k: float = 2.0, n: int = 20) -> DataFrame:
    """``bars`` with bands, ``vol_ma`` and ``short`` / ``long``: a band is pierced, the close is back inside, volume is above its mean."""
    df = I.rolling_mean(I.vwap_bands(bars, k), "volume", n, "vol_ma")
    loud = F.col("volume") > F.col("vol_ma")
    short = (F.col("high") > F.col("upper_band")) & (F.col("close") < F.col("upper_band")) & loud
    long = (F.col("low") < F.col("lower_band")) & (F.col("close") > F.col("lower_band")) & loud
    return df.withColumns({"short": F.coalesce(short, F.lit(False)), "long": F.coalesce(long, F.lit(False))})


def zero_event_cells(cells: DataFrame, events: DataFrame) -> DataFrame:
    """Cells with their number of events, and whether it is zero."""
    n = events.groupBy("cell").agg(F.count("*").alias("events"))
    out = cells.join(n, "cell", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    return out.withColumn("unsatisfied", F.col("events") == 0)
