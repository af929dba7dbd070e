"""Price measures for every (ticker, date) in one pass.

All windows share `partitionBy(ticker).orderBy(date)`: one shuffle and one sort
serve returns, risk and technicals. (ticker, date) is the key of the bar table,
so a partition is bounded by the number of trading days, however large the raw
feed was: duplicates are aggregated or dropped before this point.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import safe_divide

TRADING_DAYS = 252
PERIODS = {
    "one_month_return": 21,
    "three_month_return": 63,
    "six_month_return": 126,
    "one_year_return": 252,
}
# Largest power of e that a block of the exponential averages may span, and the
# decay (as a power of e) beyond which history is below double precision.
BLOCK_RANGE, NEGLIGIBLE = 600.0, 40.0
# A moving frame is read whole at every row, so only short runs are framed; longer averages add runs up.
RUN, RSI_RUN = 10, 7


def by_date():
    return Window.partitionBy("ticker").orderBy("date")


def so_far():
    return by_date().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(rows: int):
    return by_date().rowsBetween(-(rows - 1), Window.currentRow)


def with_price(bars: DataFrame) -> DataFrame:
    return bars.withColumn("price", F.coalesce("adjusted_close", "close"))


def with_returns(bars: DataFrame) -> DataFrame:
    """price, rn (0-based row) and daily_return; no forward fill."""
    return (
        with_price(bars)
        .withColumn("rn", (F.row_number().over(by_date()) - 1).cast("long"))
        .withColumn("daily_return", safe_divide("price", F.lag("price").over(by_date())) - 1)
    )


def with_period_returns(priced: DataFrame) -> DataFrame:
    return priced.withColumns(
        {
            name: safe_divide("price", F.lag("price", rows).over(by_date())) - 1
            for name, rows in PERIODS.items()
        }
    )


def with_risk(priced: DataFrame, risk_free_rate: float = 0.0) -> DataFrame:
    """Expanding measures: what each date could know of its own past."""
    deviation = F.stddev_samp("daily_return").over(so_far())
    mean = F.avg("daily_return").over(so_far())
    flat = F.round(deviation, 12) == 0
    return (
        priced.withColumns(
            {
                "cumulative_return": F.when(
                    F.col("rn") >= 1, safe_divide("price", F.first("price").over(so_far())) - 1
                ),
                "annualized_volatility": deviation * math.sqrt(TRADING_DAYS),
                "sharpe_ratio": F.when(
                    ~flat,
                    safe_divide(mean - risk_free_rate / TRADING_DAYS, deviation)
                    * math.sqrt(TRADING_DAYS),
                ),
                "return_count": F.count("daily_return").over(so_far()),
                "_peak": F.max("price").over(so_far()),
            }
        )
        .withColumn("_drawdown", safe_divide(F.col("price") - F.col("_peak"), "_peak"))
        .withColumn("max_drawdown", F.min("_drawdown").over(so_far()))
        .drop("_peak", "_drawdown")
    )


def benchmark_returns(bars: DataFrame, benchmark: str) -> DataFrame:
    """(date, benchmark_return) of one ticker: one row per trading day."""
    return with_returns(bars.filter(F.col("ticker") == benchmark)).select(
        "date", F.col("daily_return").alias("benchmark_return")
    )


def with_beta(priced: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Expanding beta over common dates.

    The benchmark has one row per calendar day (a century is under 40,000
    rows), a bound that does not move with the data, so it is broadcast and the
    ticker partitioning survives.
    """
    both = F.when(F.col("daily_return").isNotNull(), F.col("benchmark_return"))
    variance = F.var_samp(both).over(so_far())
    covariance = F.covar_samp("daily_return", both).over(so_far())
    return (
        priced.join(F.broadcast(benchmark), "date", "left")
        .withColumn("beta_vs_spy", F.when(variance > 1e-18, safe_divide(covariance, variance)))
        .drop("benchmark_return")
    )


def full_window(value: Column, counted: str, rows: int) -> Column:
    """value over exactly `rows` non-null rows, else NULL."""
    return F.when(F.count(counted).over(trailing(rows)) == rows, value)


def runs(column: str, run: int, rows: int) -> list[Column]:
    """Values of `column`, a measure of `run` rows, at the ends of the runs that make up the last `rows` rows.

    A run that is not full is NULL, and so is every sum with it.
    """
    return [F.col(column), *[F.lag(column, at).over(by_date()) for at in range(run, rows, run)]]


def total(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


def with_emas(priced: DataFrame, source: str, spans: dict[str, int]) -> DataFrame:
    """Exponential averages seeded with the first value, without a loop or UDF.

    Needs a dense `rn` and non-null `source`. Inside a block the recursion has
    the closed form q^j * sum(x_i * q^-i); the end value of the block before is
    carried in, as often as a span's history reaches. All spans share one sort by
    (ticker, block, date).
    """
    decay = {name: 1.0 - 2.0 / (span + 1.0) for name, span in spans.items()}
    rates = [-math.log(q) for q in decay.values() if q > 0]
    block = max(int(BLOCK_RANGE / max(rates)), 2) if rates else 2
    carries = max([1, *[math.ceil(NEGLIGIBLE / (rate * block)) for rate in rates]])
    j = (F.col("rn") % block).cast("double")
    in_block = (
        Window.partitionBy("ticker", "_block")
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy("ticker")
        .orderBy("_block", "date")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = F.col("rn") % block == block - 1

    def weighted(q: float) -> Column:
        first = F.when(F.col("rn") == 0, F.col(source)).otherwise(F.col(source) * (1.0 - q))
        return first * F.pow(F.lit(q), -j)

    def carry(name: str, column: str) -> Column:
        return F.coalesce(F.last(F.when(ends, F.col(f"{column}{name}")), True).over(before), F.lit(0.0))

    out = priced.withColumn("_block", F.floor(F.col("rn") / block))
    parts = {f"_part_{n}": F.pow(F.lit(q), j) * F.sum(weighted(q)).over(in_block) for n, q in decay.items()}
    out = out.withColumns(parts).withColumns({f"_full_{n}": F.col(f"_part_{n}") for n in spans})
    for _ in range(carries):
        out = out.withColumns(
            {f"_full_{n}": F.col(f"_part_{n}") + F.pow(F.lit(q), j + 1) * carry(n, "_full_") for n, q in decay.items()}
        )
    out = out.withColumns({n: F.col(f"_full_{n}") for n in spans})
    return out.drop("_block", *[f"{k}{n}" for n in spans for k in ("_part_", "_full_")])


def chained_ema(first: str, first_span: int, second: str, second_span: int) -> Column:
    """Exponential average of an exponential average, from the two single ones.

    By partial fractions the chain of two first-order recursions with decays
    a and b is (a(1-b) * first - b(1-a) * second) / (a - b).
    """
    a, b = 1.0 - 2.0 / (first_span + 1.0), 1.0 - 2.0 / (second_span + 1.0)
    return F.col(first) * (a * (1 - b) / (a - b)) - F.col(second) * (b * (1 - a) / (a - b))


def with_technicals(priced: DataFrame) -> DataFrame:
    """SMA, EMA, RSI, MACD, Bollinger bands and volume average."""
    delta = F.col("price") - F.lag("price").over(by_date())
    base = priced.withColumns(
        {
            "_gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
            "_loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
        }
    )
    base = base.withColumns(
        {
            "_sum": full_window(F.sum("price").over(trailing(RUN)), "price", RUN),
            "_square": full_window(F.var_pop("price").over(trailing(RUN)) * RUN, "price", RUN),
            "_volume": full_window(F.sum(F.col("volume").cast("double")).over(trailing(RUN)), "volume", RUN),
            "_gain": full_window(F.sum("_gain").over(trailing(RSI_RUN)), "_gain", RSI_RUN),
            "_loss": full_window(F.sum("_loss").over(trailing(RSI_RUN)), "_loss", RSI_RUN),
        }
    )
    base = base.withColumns(
        {
            "sma_20": total(runs("_sum", RUN, 20)) / 20,
            "sma_50": total(runs("_sum", RUN, 50)) / 50,
            "volume_sma_20": total(runs("_volume", RUN, 20)) / 20,
            "_square": total(runs("_square", RUN, 20)),
            "_before": F.lag("_sum", RUN).over(by_date()),
            "_avg_gain": total(runs("_gain", RSI_RUN, 14)) / 14,
            "_avg_loss": total(runs("_loss", RSI_RUN, 14)) / 14,
        }
    )
    # squares around the means of both runs, and those of the means around the common one
    apart = (F.col("_sum") - F.col("_before")) / RUN
    base = (
        base.withColumn("_deviation", F.sqrt((F.col("_square") + RUN / 2 * apart * apart) / 19))
        .withColumn("sma_200", total(runs("sma_50", 50, 200)) / 4)
        .withColumns(
            {
                "rsi_14": F.when(
                    (F.col("_avg_loss") == 0) & (F.col("_avg_gain") > 0), F.lit(100.0)
                ).otherwise(
                    100 - F.try_divide(F.lit(100.0), 1 + safe_divide("_avg_gain", "_avg_loss"))
                ),
                "bollinger_middle_20": F.col("sma_20"),
                "bollinger_upper_20": F.col("sma_20") + 2 * F.col("_deviation"),
                "bollinger_lower_20": F.col("sma_20") - 2 * F.col("_deviation"),
                "volume_ratio": safe_divide("volume", "volume_sma_20"),
            }
        )
        .drop("_avg_gain", "_avg_loss", "_gain", "_loss", "_deviation", "_sum", "_square", "_volume", "_before")
    )
    base = with_emas(base, "price", {"ema_12": 12, "ema_26": 26, "_ema_9": 9})
    signal = chained_ema("ema_12", 12, "_ema_9", 9) - chained_ema("ema_26", 26, "_ema_9", 9)
    return base.withColumns(
        {"macd": F.col("ema_12") - F.col("ema_26"), "macd_signal": signal}
    ).withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_ema_9")


def price_panel(bars: DataFrame, benchmark: str, risk_free_rate: float = 0.0) -> DataFrame:
    """Every market and technical measure of every (ticker, date).

    Bars that carry the mark WANTED give the measures of factors, of the marked rows alone.
    """
    if WANTED in bars.columns:
        return measured_rows(bars, benchmark, risk_free_rate)
    priced = with_risk(with_period_returns(with_returns(bars)), risk_free_rate)
    return with_technicals(with_beta(priced, benchmark_returns(bars, benchmark)))


# --- measures of few rows of a ticker ---------------------------------------------------------

# a Boolean column of bars: rows whose measures are asked for
WANTED = "_wanted"
EMA_SPANS = {"ema_12": 12, "ema_26": 26, "_ema_9": 9}
MEASURES = [
    "cumulative_return", *PERIODS, "annualized_volatility", "sharpe_ratio", "max_drawdown", "beta_vs_spy",
    "sma_50", "sma_200", "rsi_14", "volume_ratio", *EMA_SPANS,
]


def measured_rows(bars: DataFrame, benchmark: str, risk_free_rate: float = 0.0) -> DataFrame:
    """The rows marked WANTED with MEASURES, macd, macd_signal, price and return_count; rows without a ticker are left out.

    Spark brings the bars of a ticker together in the order of their dates; a task then holds one ticker and
    one batch at a time and measures the marked rows alone, where windows would measure every bar.
    """
    index = benchmark_returns(bars.select("ticker", "date", "close", "adjusted_close"), benchmark)
    kept = [f for f in bars.schema.fields if f.name != WANTED]
    doubles = {"price": F.coalesce("adjusted_close", "close"), "_volume": F.col("volume")}
    dated = bars.filter(F.col("ticker").isNotNull()).withColumns({k: v.cast("double") for k, v in doubles.items()})
    ordered = dated.join(F.broadcast(index), "date", "left").sortWithinPartitions("ticker", "date")
    names = [f.name for f in kept]

    def run(batches):
        for rows in whole_tickers(batches):
            yield measured_batch(rows, names, risk_free_rate)

    columns = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "price double", "return_count long"]
    schema = ", ".join([*columns, *[f"{m} double" for m in MEASURES]])
    out = ordered.select(*names, "price", "_volume", "benchmark_return", WANTED).mapInArrow(run, schema)
    signal = chained_ema("ema_12", 12, "_ema_9", 9) - chained_ema("ema_26", 26, "_ema_9", 9)
    return out.withColumns({"macd": F.col("ema_12") - F.col("ema_26"), "macd_signal": signal}).drop("_ema_9")


def whole_tickers(batches):
    """Tables of whole tickers from batches in the order of tickers."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held and held[-1]["ticker"][-1] != rows["ticker"][0]:
            yield pa.concat_tables(held)
            held = []
        last = ticker_starts(rows)[-1]
        if last:
            yield pa.concat_tables([*held, rows.slice(0, last)])
            held = []
        held.append(rows.slice(last))
    if held:
        yield pa.concat_tables(held)


def ticker_starts(rows: pa.Table) -> np.ndarray:
    ticker = rows["ticker"].combine_chunks()
    changes = pc.not_equal(ticker.slice(1), ticker.slice(0, len(ticker) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(changes) + 1])


def measured_batch(rows: pa.Table, names: list[str], risk_free_rate: float) -> pa.RecordBatch:
    """Marked rows of whole tickers with their measures; NaN stands for NULL on the way."""
    price, volume, index = (rows[c].to_numpy().astype(float) for c in ("price", "_volume", "benchmark_return"))
    marked = np.flatnonzero(rows[WANTED].to_numpy())
    starts = ticker_starts(rows)
    made = []
    for start, end in zip(starts, [*starts[1:], rows.num_rows]):
        low, high = np.searchsorted(marked, [start, end])
        if low < high:
            cut = slice(start, end)
            made.append(measures_at(price[cut], volume[cut], index[cut], marked[low:high] - start, risk_free_rate))
    cells = np.concatenate(made) if made else np.zeros((0, len(MEASURES) + 1))
    kept = rows.take(pa.array(marked))
    arrays = [kept[c].combine_chunks() for c in names] + [pa.array(price[marked], from_pandas=True)]
    arrays.append(pa.array(cells[:, 0].astype(np.int64)))
    arrays += [pa.array(np.ascontiguousarray(c), from_pandas=True) for c in cells[:, 1:].T]
    return pa.RecordBatch.from_arrays(arrays, [*names, "price", "return_count", *MEASURES])


def ratio(a, b):
    """a / b, NaN where b is 0."""
    return np.where(b == 0, np.nan, a / np.where(b == 0, 1.0, b))


def last_values(values: np.ndarray, at: np.ndarray, rows: int, fill: float = np.nan) -> np.ndarray:
    """(places, rows): the `rows` values that end at every place, `fill` before the first."""
    return sliding_window_view(np.concatenate([np.full(rows, fill), values]), rows)[at + 1]


@cache
def ema_weights() -> tuple[np.ndarray, np.ndarray]:
    """Decay of every span of EMA_SPANS and the weights of the rows it reaches; those beyond are below double precision."""
    decays = np.array([1.0 - 2.0 / (span + 1.0) for span in EMA_SPANS.values()])
    reach = math.ceil(NEGLIGIBLE / -math.log(decays.max()))
    return decays, decays[None, :] ** np.arange(reach - 1, -1, -1)[:, None]


def centred(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the first n values for every n of `counts`, and (counts, values): those values less their mean, 0 for the others."""
    first = np.arange(len(values)) < counts[:, None]
    mean = np.where(first, values, 0.0).sum(1) / counts
    return mean, np.where(first, values - mean[:, None], 0.0)


def measures_at(price, volume, index, at, risk_free_rate: float = 0.0) -> np.ndarray:
    """return_count and MEASURES at the places `at` of one ticker's bars, in order of their dates."""
    with np.errstate(all="ignore"):
        before = np.concatenate([[np.nan], price[:-1]])
        returns, delta = ratio(price, before) - 1, price - before
        have = ~np.isnan(returns)
        known, counts = returns[have], have.cumsum()[at]
        both = have & ~np.isnan(index)
        pairs = both.cumsum()[at]
        mean, apart = centred(known, counts)
        deviation = np.where(counts > 1, np.sqrt((apart * apart).sum(1) / (counts - 1)), np.nan)
        (_, own), (_, market) = centred(returns[both], pairs), centred(index[both], pairs)
        square = (market * market).sum(1)
        beta = np.where((pairs > 1) & (square / (pairs - 1) > 1e-18), ratio((own * market).sum(1), square), np.nan)
        flat = np.round(deviation, 12) == 0
        year = math.sqrt(TRADING_DAYS)
        sharpe = np.where(flat, np.nan, ratio(mean - risk_free_rate / TRADING_DAYS, deviation) * year)
        peak = np.maximum.accumulate(np.where(np.isnan(price), -np.inf, price))
        fall = np.fmin.accumulate(ratio(price - peak, peak))[at]
        here = price[at]
        total_return = np.where(at >= 1, ratio(here, price[0]) - 1, np.nan)
        periods = [ratio(here, np.where(at >= n, price[np.maximum(at - n, 0)], np.nan)) - 1 for n in PERIODS.values()]
        sma_50, sma_200 = (last_values(price, at, n).sum(1) / n for n in (50, 200))
        moves = last_values(delta, at, 2 * RSI_RUN)
        up, down = (np.where(np.isnan(moves), np.nan, np.maximum(way * moves, 0.0)) for way in (1, -1))
        gain, loss = ((w[:, RSI_RUN:].sum(1) + w[:, :RSI_RUN].sum(1)) / 14 for w in (up, down))
        rsi = np.where((loss == 0) & (gain > 0), 100.0, 100 - 100.0 / (1 + ratio(gain, loss)))
        traded = ratio(volume[at], last_values(volume, at, 20).sum(1) / 20)
        # a missing price adds nothing, the first one counts whole
        decays, weights = ema_weights()
        filled = np.nan_to_num(price)
        average = last_values(filled, at, len(weights), 0.0) @ weights * (1 - decays) + filled[0] * decays ** (at[:, None] + 1.0)
        columns = [counts, total_return, *periods, deviation * year, sharpe, fall, beta, sma_50, sma_200, rsi, traded]
        return np.column_stack([*columns, average])


def cap_at(rows: DataFrame) -> Column:
    """Market value of a bar: no fall back to close when adjusted_close is NULL."""
    return F.col("adjusted_close") * F.col("shares_outstanding")
