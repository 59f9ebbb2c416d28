"""Resampling tests, false-discovery control and ensemble agreement.

Draws are deterministic and independent of the engine: they come from md5 digests of 'seed:iteration:item', so a rerun,
another cluster and a SQL engine draw the same samples. A block of cells is one matrix in a task, and all its draws are
products with it, so cells x draws never become rows. `mc_test` is the relational form of `mc_test_blocked`, a join of draws
with the pool, whose size is iterations x events x cells; for small pools only.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.epochs import small

#: Draws that a task of mc_test_blocked works on at once.
DRAWS = 512

#: Means within this share of a cell's largest value are equal: the order of a sum must not decide a p value.
TIE = 1e-12


def digest(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def draws_without_replacement(candidates: DataFrame, n: int, iterations: int, seed: int, column: str = "anchor_t") -> DataFrame:
    """(iteration, column): the n candidates of least digest, for each iteration."""
    every = candidates.select(column).distinct().select(column, F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    order = Window.partitionBy("iteration").orderBy(digest(seed, F.col("iteration"), F.col(column)))
    return every.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).select("iteration", column)


def mc_test(pool: DataFrame, keys: list[str], events: DataFrame, neutral: DataFrame, iterations: int, seed: int, column: str = "anchor_t") -> DataFrame:
    """(keys): composite over the events, p_value, null_mean, null_std (population), n_events, n_iterations.

    The null distribution is of means over as many neutral anchors, drawn without replacement. p = (ge + 1) / (n + 1),
    ge counting draws at least as far from zero as the composite, up to rounding (TIE); a cell without any value has p = 1.
    """
    n = events.select(column).distinct().join(pool.select(column).distinct(), column, "left_semi").count()
    if not n:
        raise ValueError("no event is in the pool")
    if neutral.select(column).distinct().count() < n:
        raise ValueError("fewer neutral anchors than events")
    chosen = events.select(column).distinct().withColumn("_event", F.lit(True))
    observed = pool.join(small(chosen), column, "left_semi").groupBy(*keys).agg(F.avg("value").alias("composite"))
    observed = pool.groupBy(*keys).agg(F.max(F.abs("value")).alias("_top")).join(observed, keys, "left")
    draws = draws_without_replacement(neutral, n, iterations, seed, column)
    null = pool.join(draws, column).groupBy(*keys, "iteration").agg(F.avg("value").alias("null"))
    both = observed.join(null, keys, "left")
    far = F.count_if(F.abs("null") >= F.abs("composite") - TIE * F.col("_top"))
    valid = F.count("null")
    return both.groupBy(*keys).agg(
        F.first("composite").alias("composite"), ((far + 1) / (valid + 1)).alias("p_value"), F.avg("null").alias("null_mean"), F.stddev_pop("null").alias("null_std")
    ).withColumns({"n_events": F.lit(n), "n_iterations": F.lit(iterations)})


def draw_matrix(anchors: list[int], n: int, iterations: int, seed: int) -> np.ndarray:
    """The draws of draws_without_replacement as a 0/1 matrix (iterations x anchors)."""
    out = np.zeros((iterations, len(anchors)))
    for i in range(iterations):
        order = sorted(range(len(anchors)), key=lambda k: hashlib.md5(f"{seed}:{i}:{anchors[k]}".encode()).hexdigest())
        out[i, order[:n]] = 1
    return out


def mc_test_blocked(pool: DataFrame, keys: list[str], events: list[int], neutral: list[int], iterations: int, seed: int, column: str = "anchor_t", cells_a_block: int = 1024) -> DataFrame:
    """mc_test() for large pools: each block of cells is one matrix (anchors x cells), and draws x anchors times it gives all null means.

    The lists of anchors (hundreds of years at most) and the draw matrix go to every task; the pool is shuffled once, by block. There
    are as many blocks as cells ask for, and draws are taken `DRAWS` at a time, so a task holds DRAWS x cells_a_block means at once.
    """
    neutral = sorted(set(neutral))
    # One pass over the pool says which of the events it has (no more than were given) and how many cells.
    there = F.collect_set(F.when(F.col(column).isin(*set(events)), F.col(column)))
    found = pool.agg(there.alias("events"), number_of(keys).alias("cells")).first()
    events = sorted(found["events"])
    if not events:
        raise ValueError("no event is in the pool")
    if len(neutral) < len(events):
        raise ValueError("fewer neutral anchors than events")
    draws = draw_matrix(neutral, len(events), iterations, seed)
    blocks = found["cells"] // cells_a_block + 1
    kinds = {f.name: f.dataType.simpleString() for f in pool.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "composite double, p_value double, null_mean double, null_std double"])
    numbers = {"n_events": F.lit(len(events)), "n_iterations": F.lit(iterations)}

    def test(table: pa.Table) -> pa.Table:
        frame = table.to_pandas()
        cells, cell = np.unique(frame["_cell"].to_numpy(), return_inverse=True)
        values = frame["value"].to_numpy(float)
        anchor = frame[column].to_numpy()

        def block(anchors: list[int]) -> tuple[np.ndarray, np.ndarray]:
            v, m = np.zeros((len(anchors), len(cells))), np.zeros((len(anchors), len(cells)))
            of = {a: k for k, a in enumerate(anchors)}
            row = np.array([of.get(a, -1) for a in anchor])
            ok = (row >= 0) & np.isfinite(values)
            v[row[ok], cell[ok]] = values[ok]
            m[row[ok], cell[ok]] = 1
            return v, m

        def mean(a: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.divide(a, n, out=np.full(a.shape, np.nan), where=n > 0)

        v, m = block(events)
        observed = mean(v.sum(0), m.sum(0))
        slack = _slack(values, cell, len(cells))
        v, m = block(neutral)
        parts = [draws[i : i + DRAWS] for i in range(0, iterations, DRAWS)]
        far, count, total, squares = (np.zeros(len(cells)) for _ in range(4))
        for d in parts:
            null = mean(d @ v, d @ m)
            far += (np.abs(null) >= np.abs(observed) - slack).sum(0)
            count += np.isfinite(null).sum(0)
            total += np.nansum(null, 0)
        centre = mean(total, count)
        for d in parts:
            squares += np.nansum((mean(d @ v, d @ m) - centre) ** 2, 0)
        first = frame.drop_duplicates("_cell").set_index("_cell").loc[cells]
        columns = {k: pa.array(first[k], type=table.schema.field(k).type) for k in keys}
        nan = lambda x: pa.array(x, pa.float64(), from_pandas=True)
        return pa.table(columns | {"composite": nan(observed), "p_value": nan((far + 1) / (count + 1)), "null_mean": nan(centre), "null_std": nan(np.sqrt(mean(squares, count)))})

    wanted = pool.where(F.col(column).isin(*neutral, *events)) if len(neutral) + len(events) <= 1000 else pool
    # A cell has a row even where it has no value at any of these anchors.
    wanted = wanted.select(*keys, column, "value").unionByName(pool.select(*keys).distinct().withColumns({column: F.lit(None).cast(kinds[column]), "value": F.lit(None).cast("double")}))
    dealt = wanted.withColumn("_cell", F.xxhash64(*keys)).withColumn("_block", F.pmod(F.col("_cell"), F.lit(blocks)))
    return dealt.groupBy("_block").applyInArrow(lambda t: test(t), schema).withColumns(numbers)


def number_of(keys: list[str]) -> Column:
    """About how many different keys there are, for dealing them into blocks: an aggregate that needs no exchange of them."""
    return F.approx_count_distinct(F.struct(*keys))


def in_blocks(
    df: DataFrame, keys: list[str], cells_a_block: int, work: Callable[[pd.DataFrame, np.ndarray, int], dict[str, np.ndarray]], fields: dict[str, str], cells: int | None = None,
) -> DataFrame:
    """(keys, fields): work(rows, cell of each row, number of cells) for one block of about cells_a_block keys after another, a task each.

    Blocks are dealt by a hash of the keys; a key's rows (items of a record) are few, so blocks are alike in size. What work() returns has
    an entry for each cell; numbers that are not finite become null. cells: how many keys there are, where the caller has counted them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    numbers = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}

    def block(table: pa.Table) -> pa.Table:
        frame = table.to_pandas()
        cell = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(cell, return_index=True)[1]
        out = {k: table[k].combine_chunks().take(pa.array(first)) for k in keys}
        for name, values in work(frame, cell, len(first)).items():
            values = np.asarray(values)
            out[name] = pa.array(values, numbers[fields[name]], mask=~np.isfinite(values)) if fields[name] == "double" else pa.array(values, numbers[fields[name]])
        return pa.table(out)

    cells = df.agg(number_of(keys)).first()[0] if cells is None else cells
    blocks = cells // cells_a_block + 1
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{name} {kind}" for name, kind in fields.items())])
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))
    return dealt.groupBy("_block").applyInArrow(lambda t: block(t), schema)


def pick(seed: int, iteration: int, slot: int, n: int) -> int:
    """The place, of n, that a slot of a draw with replacement takes: the first 8 hexadecimal digits of the digest, modulo n."""
    return int(hashlib.md5(f"{seed}:{iteration}:{slot}".encode()).hexdigest()[:8], 16) % n


@functools.cache
def weights(n: int, iterations: int, seed: int) -> np.ndarray:
    """How often each draw of n places takes each of n items (iterations x n)."""
    out = np.zeros((iterations, n))
    for i in range(iterations):
        for s in range(n):
            out[i, pick(seed, i, s, n)] += 1
    return out


def _drawn(w: np.ndarray, value: np.ndarray, cell: np.ndarray, row: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Means of each draw over the items that a cell has (draws x cells), DRAWS draws at once; NaN where it has none of them."""
    v, m = np.zeros((w.shape[1], n)), np.zeros((w.shape[1], n))
    ok = np.isfinite(value)
    np.add.at(v, (row[ok], cell[ok]), value[ok])
    np.add.at(m, (row[ok], cell[ok]), 1)
    for i in range(0, len(w), DRAWS):
        count = w[i : i + DRAWS] @ m
        yield np.divide(w[i : i + DRAWS] @ v, count, out=np.full(count.shape, np.nan), where=count > 0)


def _means(value: np.ndarray, cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    ok = np.isfinite(value)
    count = np.bincount(cell[ok], minlength=n)
    return np.divide(np.bincount(cell[ok], value[ok], n), count, out=np.full(n, np.nan), where=count > 0), count


def _slack(value: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """What counts as zero in each cell: TIE of its largest value."""
    out = np.zeros(n)
    np.maximum.at(out, cell, np.nan_to_num(np.abs(value)) * TIE)
    return out


def _two_sided(observed: np.ndarray, draws: Iterator[np.ndarray], slack: np.ndarray) -> dict[str, np.ndarray]:
    """p = 2 (cross + 1) / (n + 1), at most 1, cross counting draws at zero or on its other side from what was observed; and the draws' deviation."""
    n, cross, total, squares = (np.zeros(len(observed)) for _ in range(4))
    for d in draws:
        ok = np.isfinite(d)
        n += ok.sum(0)
        cross += (ok & np.where(observed >= -slack, d <= slack, d >= -slack)).sum(0)
        off = np.where(ok, d - observed, 0)  # from what was observed, which the draws lie around: no digits are lost to their mean
        total += off.sum(0)
        squares += (off * off).sum(0)
    mean = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)
    spread = np.sqrt(np.maximum(np.divide(squares, n, out=np.full(len(n), np.nan), where=n > 0) - mean * mean, 0))
    return {"p_value": np.minimum(2 * (cross + 1) / (n + 1), 1), "sd": spread}


def bootstrap_difference(a: DataFrame, b: DataFrame, keys: list[str], iterations: int, seed: int, scale: float = 1.0, event: str = "event_year", cells_a_block: int = 1024) -> DataFrame:
    """(keys): excess = mean(a) - scale * mean(b) over events, with p_value and sd from resampling the events of both.

    Draws are over all the events of a, and of b, and are the same for all keys; in a draw a key's mean is over those it has. Keys in both
    a and b have a row. Events (hundreds at most) and draws go to every task as one matrix; a block of keys is one product with it.
    """
    side = lambda df, k: df.select(*keys, event, F.col("value").cast("double").alias("value"), F.lit(k).alias("_side"))
    both = side(a, 0).unionByName(side(b, 1))
    on = lambda k: F.collect_set(F.when(F.col("_side") == k, F.col(event)))
    found = both.agg(on(0).alias("a"), on(1).alias("b"), number_of(keys).alias("cells")).first()
    ia, ib = sorted(found["a"]), sorted(found["b"])
    at = [{x: k for k, x in enumerate(items)} for items in (ia, ib)]

    def work(frame: pd.DataFrame, cell: np.ndarray, n: int) -> dict[str, np.ndarray]:
        means, draws, there = [], [], []
        for k, items in enumerate((ia, ib)):
            own = (frame["_side"] == k).to_numpy()
            there.append(np.bincount(cell[own], minlength=n) > 0)
            own &= frame[event].notna().to_numpy()
            value, of, row = frame["value"].to_numpy(float)[own], cell[own], np.array([at[k][e] for e in frame[event][own]], int)
            means.append(_means(value, of, n)[0])
            draws.append(_drawn(weights(len(items), iterations, seed + k), value, of, row, n))
        excess = means[0] - scale * means[1]
        return {"excess": excess, **_two_sided(excess, (x - scale * y for x, y in zip(*draws, strict=True)), _slack(frame["value"].to_numpy(float), cell, n)), "_both": there[0] & there[1]}

    fields = {"excess": "double", "p_value": "double", "sd": "double", "_both": "boolean"}
    return in_blocks(both, keys, cells_a_block, work, fields, found["cells"]).where("_both").drop("_both")


def paired_difference(a: DataFrame, b: DataFrame, keys: list[str], iterations: int, seed: int, event: str = "event_year", cells_a_block: int = 1024) -> DataFrame:
    """(keys): mean over common events of a - b, with p_value and sd from resampling those events together; n_events have both values."""
    pairs = a.select(*keys, event, F.col("value").alias("x")).join(b.select(*keys, event, F.col("value").alias("y")), [*keys, event])
    pairs = pairs.select(*keys, event, (F.col("x") - F.col("y")).cast("double").alias("value"))
    found = pairs.agg(F.collect_set(event).alias("items"), number_of(keys).alias("cells")).first()  # the events in common, hundreds at most
    items = sorted(found["items"])
    at = {x: k for k, x in enumerate(items)}

    def work(frame: pd.DataFrame, cell: np.ndarray, n: int) -> dict[str, np.ndarray]:
        value = frame["value"].to_numpy(float)
        mean, count = _means(value, cell, n)
        draws = _drawn(weights(len(items), iterations, seed), value, cell, np.array([at[e] for e in frame[event]], int), n)
        return {"difference": mean, "n_events": count, **_two_sided(mean, draws, _slack(value, cell, n))}

    return in_blocks(pairs, keys, cells_a_block, work, {"difference": "double", "n_events": "long", "p_value": "double", "sd": "double"}, found["cells"])


def bootstrap_ci(df: DataFrame, keys: list[str], iterations: int, seed: int, low: float = 0.05, high: float = 0.95, item: str = "event_year", cells_a_block: int = 1024) -> DataFrame:
    """(keys): mean of the values and its percentile interval over resampled items; percentiles interpolate linearly.

    A key is resampled over its own values, in the items' order, and nothing else: its interval stays when other keys come or go. Keys
    with equally many values share their draws, so that a block takes one product for each number of values. Without values: null.
    """
    def work(frame: pd.DataFrame, cell: np.ndarray, n: int) -> dict[str, np.ndarray]:
        value = frame["value"].to_numpy(float)
        mean, count = _means(value, cell, n)
        ok = np.isfinite(value)
        order = np.lexsort((frame[item].to_numpy()[ok], cell[ok]))  # each cell's values side by side, by item
        value, start, ends = value[ok][order], np.r_[0, np.cumsum(count)], np.full((2, n), np.nan)
        for size in np.unique(count[count > 0]):
            own = np.flatnonzero(count == size)
            drawn = weights(int(size), iterations, seed) @ value[start[own] + np.arange(size)[:, None]] / size
            ends[:, own] = np.percentile(drawn, [100 * low, 100 * high], axis=0)
        return {"mean": mean, "ci_low": ends[0], "ci_high": ends[1]}

    rows = df.select(*keys, item, F.col("value").cast("double").alias("value"))
    return in_blocks(rows, keys, cells_a_block, work, {"mean": "double", "ci_low": "double", "ci_high": "double"})


def bh_threshold(df: DataFrame, p: str = "p_value", alpha: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """(by, threshold): for each family, the largest p(i) with p(i) <= alpha * i / n over its rows with a p, or 0; without `by`, all rows are one family.

    Ranks over all cells would put them into one task. Only the number of rows up to each distinct p matters, so counts
    of distinct values are summed; p values of a test with N iterations take at most N + 1 values, in any family. Families
    are sorted side by side in one plan. A family without any p has no row.
    """
    by = by or []
    counts = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("c"))
    ranked = counts.select(*by, "_p", F.sum("c").over(Window.partitionBy(*by).orderBy("_p")).alias("i"), F.sum("c").over(Window.partitionBy(*by)).alias("n"))
    return ranked.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_p") <= alpha * F.col("i") / F.col("n"), F.col("_p"))), F.lit(0.0)).alias("threshold"))


def fdr_mask(df: DataFrame, p: str = "p_value", alpha: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """Add threshold and significant: p at or below its family's Benjamini-Hochberg threshold, which is above 0."""
    found = bh_threshold(df, p, alpha, by)
    if by:
        found = small(found.select(*[F.col(c).alias(f"_{c}") for c in by], "threshold"))
        same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
        both = df.join(found, same, "left").drop(*[f"_{c}" for c in by]).fillna(0.0, ["threshold"])
    else:
        both = df.crossJoin(F.broadcast(found))
    return both.withColumn("significant", F.coalesce((F.col(p) <= F.col("threshold")) & (F.col("threshold") > 0), F.lit(False)))


def sign_agreement(df: DataFrame, keys: list[str], member: str = "model") -> DataFrame:
    """(keys): share of the members with a value whose sign is that of their mean, and the number of members. df has a row for each member."""
    df = df.withColumn("_mean", F.avg("value").over(Window.partitionBy(*keys)))
    same = F.when(F.col("value").isNotNull(), (F.signum("value") == F.signum("_mean")).cast("double"))
    return df.groupBy(*keys).agg(F.avg(same).alias("agreement"), F.count("value").alias("n_models"), F.first("_mean").alias("ensemble_mean"))


def robust_mask(agreement: DataFrame, test: DataFrame, keys: list[str], least: float = 0.66, min_models: int = 3, alpha: float = 0.1, fdr: bool = True) -> DataFrame:
    """Join a test with the members' agreement; robust: enough members, enough agreement, and significant (FDR, or p < alpha)."""
    test = fdr_mask(test, alpha=alpha) if fdr else test.withColumns({"threshold": F.lit(float(alpha)), "significant": F.coalesce(F.col("p_value") < alpha, F.lit(False))})
    both = test.join(agreement, keys)
    robust = (F.col("n_models") >= min_models) & (F.col("agreement") >= least) & F.col("significant")
    return both.withColumn("robust", F.coalesce(robust, F.lit(False)))


def significance_summary(masked: DataFrame, by: list[str], least_events: int = 2) -> DataFrame:
    """(by), of robust_mask(): shares of cells that are significant and robust, largest absolute composite, events, members, threshold.

    Cells without a value count as not significant; what was tested with fewer than least_events events is left out.
    """
    return masked.where(F.col("n_events") >= least_events).groupBy(*by).agg(
        F.avg(F.col("significant").cast("double")).alias("frac_significant"), F.avg(F.col("robust").cast("double")).alias("frac_robust"), F.max(F.abs("composite")).alias("max_abs_composite"),
        F.count(F.lit(1)).alias("n_cells"), F.max("n_events").alias("n_events"), F.max("n_models").alias("n_models"), F.max("threshold").alias("threshold"),
    )
