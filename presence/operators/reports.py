"""Calibration, error-rate, latency and monitoring reports.

Reports aggregate to small per-class or per-value tables on the map side
first; anything ordered (percentiles, sweeps) then runs over grid cells, and
exact ranks inside the few cells that hold them, never over raw rows. Every report takes a ``weight`` column so
it can also read a pre-counted table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presence.config import DEFAULTS, Settings



def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("long") if weight else F.lit(1).cast("long")


def _sum_if(cond: Column, weight: str | None) -> Column:
    return F.coalesce(F.sum(F.when(cond, _weight(weight))), F.lit(0).cast("long"))


def attach_truth(decisions: DataFrame, truth: DataFrame, key: str = "frame_id") -> DataFrame:
    """Decisions that have a ground-truth class."""
    return decisions.join(truth, key)


def confusion_counts(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Correct and total per true class; frames without a face do not count."""
    called = F.col("label") != "no_face"
    expected = F.when(F.col("bona_fide"), F.col("label") == "real").otherwise(
        F.col("label").isin("spoof", "document_photo")
    )
    return df.groupBy("bona_fide").agg(
        _sum_if(called & expected, weight).alias("correct"), _sum_if(called, weight).alias("total")
    )


def apcer_bpcer(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Attack acceptance per species and bona fide rejection.

    ``overall`` marks the pooled row, whose ``species`` is NULL; rows without
    a species have one of their own. It carries the worst rate of all species
    and the species that has it (the first by name at a tie).
    """
    live, attack = F.col("verdict") == "live", ~F.col("bona_fide")
    counts = ("attacks", "accepted", "bona_fide", "rejected")
    per = df.groupBy("species").agg(
        _sum_if(attack, weight).alias("attacks"),
        _sum_if(attack & live, weight).alias("accepted"),
        _sum_if(~attack, weight).alias("bona_fide"),
        _sum_if(~attack & ~live, weight).alias("rejected"),
    )
    # the rollup is over one row per species
    apcer = F.try_divide(F.col("accepted"), F.col("attacks"))
    rows = per.rollup("species").agg(
        F.grouping_id().alias("_g"),
        *[F.sum(c).alias(c) for c in counts],
        F.max(apcer).alias("apcer_max"),
        F.min(F.when(apcer.isNotNull(), F.struct((-apcer).alias("rate"), "species")))["species"].alias("_worst"),
    )
    return rows.select(
        "species",
        (F.col("_g") == 1).alias("overall"),
        *counts,
        "apcer_max",
        apcer.alias("apcer"),
        F.try_divide(F.col("rejected"), F.col("bona_fide")).alias("bpcer"),
        F.when(F.col("_g") == 1, F.col("_worst")).alias("worst_species"),
    )


CELLS = 64  # per doubling


def _cell(v: Column) -> Column:
    """A number's place on a logarithmic grid, in the order of the numbers:
    some thousand cells hold whatever doubles the data has."""
    size = F.floor(F.log2(F.abs(v)) * CELLS) + 1100 * CELLS
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * size)


def order_statistics(values: DataFrame, keys: list[str], value: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact elements of each key's sorted ``value`` (not NULL or NaN), at
    full precision: ``wanted`` maps a name to an index from 0 as a function of
    the count. ``values`` carry a count ``n``.

    Two passes: rows are counted per grid cell, which tells the cell that holds
    each index; then only those cells are ranked, each on its own.
    """
    counted = values.groupBy(*keys, F.col(value).alias("_v")).agg(F.sum("n").alias("n")).withColumn("_cell", _cell(F.col("_v")))
    cells = counted.groupBy(*keys, "_cell").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(*keys).orderBy("_cell")
    cells = cells.withColumns({"_upto": F.sum("n").over(along), "_total": F.sum("n").over(Window.partitionBy(*keys))})
    places = F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("_total")).cast("long").alias("at")) for name, at in wanted.items()])
    held = (
        cells.withColumn("_w", F.explode(places))
        .where((F.col("_w.at") < F.col("_upto")) & (F.col("_w.at") >= F.col("_upto") - F.col("n")))
        .groupBy(*keys, "_cell")
        .agg(F.collect_list(F.struct(F.col("_w.name").alias("name"), (F.col("_w.at") - F.col("_upto") + F.col("n")).alias("at"))).alias("_held"))
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy("_v")
    on = F.lit(True)
    for k in (*keys, "_cell"):
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"h.{k}"))
    ranked = counted.alias("c").join(held.alias("h"), on).select("c.*", "_held").withColumn("_upto", F.sum("n").over(inside))
    hit = ranked.withColumn("_w", F.explode("_held")).where(F.col("_w.at") < F.col("_upto"))
    element = hit.groupBy(*keys, F.col("_w.name").alias("_name")).agg(F.min("_v").alias("_v"))
    return element.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in wanted])


def signal_distribution(
    df: DataFrame, signals: list[str], by: str = "bona_fide", weight: str | None = None
) -> DataFrame:
    """n, min, exact median, max and mean of each signal per class; a signal
    that a class never has keeps its row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in signals]))
    rows = df.select(by, _weight(weight).alias("w"), pairs.alias("e")).select(by, "e.signal", "e.v", F.when(F.col("e.v").isNotNull(), F.col("w")).alias("n"))
    out = rows.groupBy(by, "signal").agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum("n")).alias("mean"),
    )
    middle = order_statistics(
        rows.where(F.col("v").isNotNull()), [by, "signal"], "v", {"_a": lambda n: F.floor((n - 1) / 2), "_b": lambda n: F.floor(n / 2)}
    )
    on = F.col(f"o.{by}").eqNullSafe(F.col(f"m.{by}")) & (F.col("o.signal") == F.col("m.signal"))
    joined = out.alias("o").join(middle.alias("m"), on, "left")
    median = (F.col("_a") + F.col("_b")) / 2
    return joined.select(f"o.{by}", "o.signal", "o.n", "o.min", median.alias("median"), "o.max", "o.mean")


def threshold_margin(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Room between the threshold and the closest sample of either class."""
    top = F.max(F.when(F.col("bona_fide"), F.col(score)))
    low = F.min(F.when(~F.col("bona_fide"), F.col(score)))
    return df.agg(top.alias("bona_fide_max"), low.alias("spoof_min")).select(
        "bona_fide_max",
        "spoof_min",
        (F.try_divide(F.lit(threshold), F.col("bona_fide_max")) - 1).alias("margin_above"),
        (F.try_divide(F.lit(threshold), F.col("spoof_min")) - 1).alias("margin_below"),
    )


def threshold_sweep(
    df: DataFrame, score: str, steps: int = 100, weight: str | None = None
) -> DataFrame:
    """False accept and false reject rates at thresholds 0, 1/steps, .. 1.

    A sample is rejected when its score reaches the threshold. Samples are
    counted once per grid cell, then summed along the grid: linear in the
    data, whatever the number of thresholds.
    """
    c, grid = F.col(score), float(steps)
    cell = F.floor(c * grid)
    cell = cell + F.when(c >= (cell + 1) / grid, 1).when(c < cell / grid, -1).otherwise(0)
    counted = (
        df.where(c.isNotNull())
        .groupBy(F.least(F.greatest(cell, F.lit(-1)), F.lit(steps)).alias("cell"))
        .agg(
            _sum_if(~F.col("bona_fide"), weight).alias("attacks"),
            _sum_if(F.col("bona_fide"), weight).alias("genuine"),
        )
    )
    ticks = df.sparkSession.range(-1, steps + 1).withColumnRenamed("id", "cell")
    filled = ticks.join(counted, "cell", "left").fillna(0, ["attacks", "genuine"])
    # steps + 2 rows from here on
    along, whole = Window.orderBy("cell"), Window.partitionBy()
    below = F.sum("attacks").over(along) - F.col("attacks")
    reached = F.sum("genuine").over(whole) - F.sum("genuine").over(along) + F.col("genuine")
    return (
        filled.withColumns(
            {
                "accepted": below,
                "rejected": reached,
                "n_attacks": F.sum("attacks").over(whole),
                "n_genuine": F.sum("genuine").over(whole),
            }
        )
        .where(F.col("cell") >= 0)
        .select(
            (F.col("cell") / grid).alias("threshold"),
            F.try_divide("accepted", "n_attacks").alias("far"),
            F.try_divide("rejected", "n_genuine").alias("frr"),
        )
    )


def latency_summary(df: DataFrame, by: str = "endpoint", ms: str = "processing_ms") -> DataFrame:
    """Average and exact order statistics of latencies.

    ``p50, p95, p99`` are the elements at ``n // 2``, ``int(.95 n)`` and
    ``int(.99 n)`` of the sorted list; ``median`` and ``p95_low`` the second
    convention (middle of the list, element ``int(.95 n) - 1``).
    """
    timed = df.where(F.col(ms).isNotNull()).select(by, F.col(ms).alias("v"), F.lit(1).cast("long").alias("n"))
    low = lambda n: F.floor(n * 0.95) - 1
    ranks = order_statistics(
        timed,
        [by],
        "v",
        {
            "p50": lambda n: F.floor(n / 2),
            "p95": lambda n: F.floor(n * 0.95),
            "p99": lambda n: F.floor(n * 0.99),
            "_below": lambda n: F.floor((n - 1) / 2),
            "p95_low": lambda n: F.when(low(n) < 0, n - 1).otherwise(low(n)),
        },
    )
    totals = timed.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("_sum"))
    joined = totals.alias("t").join(ranks.alias("r"), F.col(f"t.{by}").eqNullSafe(F.col(f"r.{by}")))
    return joined.select(
        f"t.{by}",
        "n",
        (F.col("_sum") / F.col("n")).alias("avg_ms"),
        "p50",
        "p95",
        "p99",
        ((F.col("_below") + F.col("p50")) / 2).alias("median"),
        "p95_low",
        (F.col("n") * 1000.0 / F.col("_sum")).alias("per_busy_second"),
    )


def batch_summary(df: DataFrame, row_number: str, s: Settings = DEFAULTS) -> DataFrame:
    """Count and total time per scored batch of at most ``max_batch`` rows."""
    return df.groupBy(F.floor(F.col(row_number) / s.max_batch).alias("batch")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("processing_ms").alias("total_ms")
    )


def verdict_monitor(df: DataFrame, ts: str = "ts", width: str = "5 minutes") -> DataFrame:
    """Counts and rates of verdict reasons per time window and endpoint."""
    counts = df.groupBy(F.window(ts, width).alias("w"), "endpoint", "verdict", "reason").agg(
        F.count(F.lit(1)).alias("n")
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy("w", "endpoint"))
    return counts.withColumn("rate", share).select(
        F.col("w.start").alias("window_start"), "endpoint", "verdict", "reason", "n", "rate"
    )


def worst_k(df: DataFrame, score: str, k: int, order: str, by: str | None = None) -> DataFrame:
    """The k highest scores, overall or per class; both forms keep only k
    rows per task before the exchange."""
    if by is None:
        return df.orderBy(F.desc(score), order).limit(k)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


MOST_BLOCKS, BLOCK_ROWS, TILE = 32, 16_384, (512, 512)


def cell_extremes(
    left: np.ndarray, right: np.ndarray, ra: np.ndarray, rb: np.ndarray, mask: Callable | None = None
) -> tuple[np.ndarray, ...]:
    """Count, least, sum and greatest of ``left @ right.T`` per pair of runs.

    Runs of rows start at ``ra`` and ``rb``. Products are formed a tile at a
    time; counts and sums need none, they come from the runs' own sums.
    ``mask(rows, columns)`` says which pairs of a tile count; without it all do.
    """
    shape = (len(ra), len(rb))
    n, low, total, high = np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros(shape), np.full(shape, -np.inf)
    if mask is None:
        n = np.outer(np.diff(np.r_[ra, len(left)]), np.diff(np.r_[rb, len(right)]))
        total = np.add.reduceat(left, ra, axis=0) @ np.add.reduceat(right, rb, axis=0).T

    def runs(starts: np.ndarray, lo: int, hi: int) -> tuple[slice, np.ndarray]:
        first, last = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")
        return slice(first, last), np.maximum(starts[first:last] - lo, 0)

    for r in range(0, len(left), TILE[0]):
        rows = slice(r, min(r + TILE[0], len(left)))
        at, cuts = runs(ra, rows.start, rows.stop)
        spans = [slice(*x) for x in zip(cuts, np.r_[cuts[1:], rows.stop - rows.start], strict=True)]
        for c in range(0, len(right), TILE[1]):
            columns = slice(c, min(c + TILE[1], len(right)))
            to, edges = runs(rb, columns.start, columns.stop)
            sims = left[rows] @ right[columns].T
            least = most = sims
            if mask is not None:
                wanted = mask(rows, columns)
                least, most = np.where(wanted, sims, np.inf), np.where(wanted, sims, -np.inf)
                for k, x in enumerate(spans):
                    n[at.start + k, to] += np.add.reduceat(wanted[x].sum(axis=0), edges)
                    total[at.start + k, to] += np.add.reduceat(np.where(wanted[x], sims[x], 0.0).sum(axis=0), edges)
            down = np.stack([least[x].min(axis=0) for x in spans])
            up = np.stack([most[x].max(axis=0) for x in spans])
            low[at, to] = np.minimum(low[at, to], np.minimum.reduceat(down, edges, axis=1))
            high[at, to] = np.maximum(high[at, to], np.maximum.reduceat(up, edges, axis=1))
    return n, low, total, high


def cross_file_similarity(
    vectors: DataFrame, key: str, cls: str, embedding: str, block: int = 1024
) -> DataFrame:
    """Pair count, min, mean and max cosine over all unordered pairs, per pair
    of classes.

    Vectors hash into blocks of about ``block`` rows, of more once there are
    MOST_BLOCKS, and of at most about BLOCK_ROWS; a cell of two blocks is one
    group's tiled matrix product, so no class or key can skew a task, and a
    cell hands on one row per pair of classes, never the pairs themselves. A
    vector is copied once per block: the number of blocks stays at MOST_BLOCKS
    until blocks are full. The products remain quadratic in the rows.
    """
    rows = vectors.count()
    blocks = max(1, min(-(-rows // block), MOST_BLOCKS), -(-rows // BLOCK_ROWS))
    own = F.pmod(F.xxhash64(key), F.lit(blocks))
    cells = vectors.select(
        F.col(key).alias("id"),
        F.col(cls).alias("c"),
        F.col(embedding).alias("v"),
        own.alias("own"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"),
    ).select(
        "id",
        "c",
        "v",
        "own",
        F.least("own", "other").alias("p"),
        F.greatest("own", "other").alias("q"),
    )
    class_type = vectors.schema[cls].dataType
    schema = T.StructType(
        [T.StructField(n, class_type) for n in ("class_a", "class_b")]
        + [T.StructField("n", T.LongType())]
        + [T.StructField(n, T.DoubleType()) for n in ("low", "total", "high")]
    )

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        p, q = part["p"].iat[0], part["q"].iat[0]
        left = part[part["own"] == p].sort_values("c")
        right = part[part["own"] == q].sort_values("c")
        if left.empty or right.empty:
            return pd.DataFrame(columns=schema.names)

        def unit(rows: pd.DataFrame) -> np.ndarray:
            m = np.stack(rows["v"].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return m / np.where(norm < 1e-9, 1.0, norm)

        def edges(rows: pd.DataFrame) -> np.ndarray:
            c = rows["c"].to_numpy()
            return np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])

        once = None
        if p == q:  # each pair once
            ids = left["id"].to_numpy(), right["id"].to_numpy()
            once = lambda a, b: ids[0][a][:, None] < ids[1][b][None, :]
        ra, rb = edges(left), edges(right)
        n, low, total, high = cell_extremes(unit(left), unit(right), ra, rb, once)
        ca, cb = left["c"].to_numpy()[ra], right["c"].to_numpy()[rb]
        i, j = np.nonzero(n)
        return pd.DataFrame(
            {
                "class_a": np.minimum(ca[i], cb[j]),
                "class_b": np.maximum(ca[i], cb[j]),
                "n": n[i, j],
                "low": low[i, j],
                "total": total[i, j],
                "high": high[i, j],
            }
        )

    # as many partitions as cells, so that small cells are not put together
    dealt = cells.repartition(blocks * (blocks + 1) // 2, "p", "q")
    partial = dealt.groupBy("p", "q").applyInPandas(cell, schema)
    return partial.groupBy("class_a", "class_b").agg(
        F.sum("n").alias("pairs"),
        F.min("low").alias("min_cos"),
        (F.sum("total") / F.sum("n")).alias("mean_cos"),
        F.max("high").alias("max_cos"),
    )


def calibration_report(judged: DataFrame, signals: list[str], sweep: str, threshold: float) -> DataFrame:
    """All calibration measures of judged, labelled rows as one long table.

    Rows are counted once per (class, species, outcome, scores); that counted
    table is one exchange shared by every section.
    """
    base = judged.groupBy("bona_fide", "species", "label", "verdict", *signals).agg(
        F.count(F.lit(1)).alias("weight")
    )
    text = {"bona_fide": F.when(F.col("bona_fide"), F.lit("bona_fide")).otherwise(F.lit("attack"))}

    def long(df: DataFrame, section: str, group: Column, measures: list[str]) -> DataFrame:
        entries = F.array(
            *[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
        )
        return df.select(
            F.lit(section).alias("section"), group.alias("group"), F.inline(entries)
        )

    parts = [
        long(confusion_counts(base, "weight"), "confusion", text["bona_fide"], ["correct", "total"]),
        long(
            apcer_bpcer(base, "weight"),
            "error_rates",
            F.coalesce(F.col("species").cast("string"), F.lit("overall")),
            ["apcer", "bpcer", "apcer_max"],
        ),
        long(
            signal_distribution(base, signals, weight="weight"),
            "distribution",
            F.concat_ws("/", text["bona_fide"], F.col("signal")),
            ["n", "min", "median", "max", "mean"],
        ),
        long(
            threshold_margin(base, sweep, threshold),
            "margin",
            F.lit(sweep),
            ["bona_fide_max", "spoof_min", "margin_above", "margin_below"],
        ),
        long(
            threshold_sweep(base, sweep, 20, "weight"),
            "sweep",
            F.format_string("%.2f", F.col("threshold")),
            ["far", "frr"],
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
