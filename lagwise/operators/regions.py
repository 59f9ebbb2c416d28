"""Spatial aggregation, exposure and nearest joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.epochs import small
from lagwise.operators.inference import bootstrap_ci
from lagwise.sources.scratch import fresh


def weighted_mean(value: Column | str = "value", weight: Column | str = "area") -> Column:
    """sum(w v) / sum(w) over rows with a value; null without weight."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    total = F.sum(F.when(v.isNotNull(), w))
    return F.sum(v * w) / F.when(total != 0, total)


def region_aggregate(df: DataFrame, regions: DataFrame, by: list[str], how: str = "mean", weight: str = "area") -> DataFrame:
    """(region, by): weighted mean, weighted sum (0 where all are null) or maximum over the cells of each region.

    regions has (cell_id, region); cells of no region drop out, and so do regions without any weight.
    """
    value = {
        "mean": weighted_mean("value", weight), "sum": F.coalesce(F.sum(F.col("value") * F.col(weight)), F.lit(0.0)), "max": F.max("value"),
    }[how]
    joined = df.join(small(regions.where("region is not null")), "cell_id")
    return joined.groupBy("region", *by).agg(value.alias("value"), F.sum(weight).alias("_w")).where(F.col("_w") > 0).drop("_w")


def fallback_region(lat: Column | str = "lat", lon: Column | str = "lon", size: int = 30) -> Column:
    """Tiles of size x size degrees, numbered from the south-west."""
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    return (F.floor((lat + 90) / size) * (360 // size) + F.floor((lon + 180) / size)).cast("int")


def regions_of_polygons(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell_id, region): the least region whose polygon holds the cell's centre.

    edges has (region, x1, y1, x2, y2), a row for each side of each ring (holes included). A ray to the east is cut by an
    odd number of sides from inside. Sides meet only cells in whole degrees of latitude that they span, by an equi-join,
    so nothing compares all cells with all sides.
    """
    side = edges.withColumn("row", F.explode(F.sequence(F.floor(F.least("y1", "y2")).cast("int"), F.floor(F.greatest("y1", "y2")).cast("int"))))
    c = cells.select("cell_id", "lat", "lon", F.floor("lat").cast("int").alias("row"))
    cuts = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (
        F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1")
    )
    hits = c.join(small(side), "row").where(cuts).groupBy("cell_id", "region").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") % 2 == 1).groupBy("cell_id").agg(F.min("region").alias("region"))


def _near(points: DataFrame, cells: DataFrame, point: str, size: float) -> DataFrame:
    """Each point with the nearest cell of its tile of `size` degrees and of the eight around it, and the squared distance."""
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("d")
    p = points.select(point, "plat", "plon", tile("plat").alias("i"), tile("plon").alias("j"), around)
    p = p.select(point, "plat", "plon", (F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j"))
    c = cells.select("cell_id", "lat", "lon", tile("lat").alias("i"), tile("lon").alias("j"))
    gap = (F.col("plat") - F.col("lat")) * (F.col("plat") - F.col("lat")) + (F.col("plon") - F.col("lon")) * (F.col("plon") - F.col("lon"))
    best = F.when(F.col("cell_id").isNotNull(), F.struct(gap.alias("gap"), F.col("cell_id").alias("cell_id")))
    return p.join(c, ["i", "j"], "left").groupBy(point, "plat", "plon").agg(F.min(best).alias("_best")).select(point, "plat", "plon", "_best.gap", "_best.cell_id")


def nearest_cell(points: DataFrame, cells: DataFrame, point: str, step: float) -> DataFrame:
    """(point, cell_id): the nearest cell in degrees of latitude and longitude, ties to the least id; null only without place or cells.

    Points and cells are dealt into tiles of `step` degrees, the grid's, and each point looks into its own and the eight around it: an
    equi-join instead of all distances. That settles a point whose nearest cell is within a step. On a grid with holes, such as land
    alone, the others look again, in tiles twice as wide, and so on until none is open: a point at a distance of d steps is settled after
    log2(d) rounds, and a round holds the open points only. What is open is written to the shared folder between rounds.
    """
    spark = points.sparkSession
    todo = points.select(point, F.col("lat").cast("double").alias("plat"), F.col("lon").cast("double").alias("plon"))
    placed = F.col("plat").isNotNull() & F.col("plon").isNotNull()
    done, size = [], float(step)
    while True:
        path = fresh(spark, "nearest")
        found = _near(todo, cells, point, size)
        found.write.parquet(path)
        found = spark.read.schema(found.schema).parquet(path)
        last = size >= 720  # tiles as wide as the earth: everything was looked at
        is_open = placed & (F.col("gap").isNull() | (F.col("gap") > size * size)) & F.lit(not last)
        done.append(found.where(~is_open).select(point, "cell_id"))
        todo, size = found.where(is_open).select(point, "plat", "plon"), 2 * size
        if last or not todo.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def regions_of_raster(raster: DataFrame, cells: DataFrame, step: float) -> DataFrame:
    """(cell_id, region): the region of the nearest raster point; NaN and null mean none."""
    points = cells.select(F.col("cell_id").alias("point"), "lat", "lon")
    raster = raster.withColumn("cell_id", F.xxhash64("lat", "lon"))
    region = F.when(~F.isnan(F.col("region").cast("double")), F.col("region").cast("int"))
    found = nearest_cell(points, raster, "point", step).join(raster.select("cell_id", region.alias("region")), "cell_id", "left")
    return found.select(F.col("point").alias("cell_id"), "region")


def outlet_cells(df: DataFrame, regions: DataFrame) -> DataFrame:
    """(region): the cell of the largest mean value, least id first, and that mean."""
    means = df.groupBy("cell_id").agg(F.avg("value").alias("value")).where("value is not null")
    top = means.join(small(regions.where("region is not null")), "cell_id")
    return top.groupBy("region").agg(F.max_by("cell_id", F.struct(F.col("value"), -F.col("cell_id"))).alias("cell_id"), F.max("value").alias("value"))


def region_response(seasonal: DataFrame, by: list[str]) -> DataFrame:
    """(by): mean over members and events, number of events, and whether all events have the mean's sign."""
    events = seasonal.groupBy(*by, "event_year").agg(F.avg("value").alias("value"))
    mean = F.avg("value").over(Window.partitionBy(*by))
    events = events.withColumn("_mean", mean)
    consistent = F.bool_and(F.signum("value") == F.signum("_mean"))
    return events.groupBy(*by).agg(F.first("_mean").alias("mean"), F.count("value").alias("n_events"), consistent.alias("sign_consistent"))


def region_table(seasonal: DataFrame, by: list[str], iterations: int, seed: int) -> DataFrame:
    """(by): region_response() with the 90% interval of the mean over resampled events."""
    events = seasonal.groupBy(*by, "event_year").agg(F.avg("value").alias("value"))
    return region_response(seasonal, by).join(bootstrap_ci(events, by, iterations, seed).drop("mean"), by)


def band_table(composite: DataFrame, seasonal: DataFrame, agreement: DataFrame, cells: DataFrame, bands: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(band): mean response with its 90% interval over resampled events, the lag and value of the largest mean composite, and the mean agreement.

    composite has (cell_id, lag, value), seasonal (cell_id, event_year, value), agreement (cell_id, agreement, n_models), cells (cell_id, lat, area).
    Means over cells are weighted by area, but for the agreement's, as the cells of a map are.
    """
    dealt = band_join(cells.select("cell_id", "lat", "area"), bands).select("band", "cell_id", "area")
    profile = composite.join(small(dealt), "cell_id").groupBy("band", "lag").agg(weighted_mean().alias("value"))
    order = F.when(F.col("value").isNotNull(), F.struct(F.abs("value"), -F.col("lag")))
    peaks = profile.groupBy("band").agg(F.max_by("lag", order).alias("peak_lag"), F.max_by("value", order).alias("peak_amplitude"))
    events = seasonal.join(small(dealt), "cell_id").groupBy("band", "event_year").agg(weighted_mean().alias("value"))
    agreed = agreement.join(small(dealt), "cell_id").groupBy("band").agg(F.avg("agreement").alias("mean_agreement"), F.max("n_models").alias("n_models"))
    return bootstrap_ci(events, ["band"], iterations, seed).join(peaks, "band").join(agreed, "band")


def amplification(responses: DataFrame, by: list[str], strong: str = "super", reference: str = "reference", least: float = 0.05) -> DataFrame:
    """(by): one column for each class, and strong / reference where the reference exceeds `least` in size."""
    wide = responses.groupBy(*by).pivot("event_class", [strong, reference]).agg(F.first("value"))
    ratio = F.when(F.abs(reference) > least, F.col(strong) / F.when(F.abs(reference) > least, F.col(reference)))
    return wide.withColumn("amplification", ratio)


def band_join(df: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows with each band that holds their latitude, both ends included. bands: (band, low, high), a handful of rows."""
    return df.join(small(bands), F.col("lat").between(F.col("low"), F.col("high")))


def box_join(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """As band_join, for boxes (box, south, north, west, east)."""
    return df.join(small(boxes), F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))


def land_mask(df: DataFrame) -> DataFrame:
    """(cell_id, land): whether a cell ever has a value."""
    return df.groupBy("cell_id").agg(F.coalesce(F.bool_or(F.col("value").isNotNull()), F.lit(False)).alias("land"))


def fraction_mask(fraction: Column | str, least: float = 0.05, strict: bool = False) -> Column:
    fraction = F.col(fraction) if isinstance(fraction, str) else fraction
    return fraction > least if strict else fraction >= least


def exposure(df: DataFrame, by: list[str], threshold: float = 1.0, area: str = "area", population: str = "population") -> DataFrame:
    """(by): area in km2 and population of robust cells at or beyond the threshold, dry and wet."""
    dry = F.coalesce((F.col("value") <= -threshold) & F.col("robust"), F.lit(False))
    wet = F.coalesce((F.col("value") >= threshold) & F.col("robust"), F.lit(False))
    part = lambda when, c, scale: F.sum(F.when(when, F.coalesce(F.col(c), F.lit(0.0)) / scale).otherwise(F.lit(0.0)))
    return df.groupBy(*by).agg(
        part(dry, area, 1e6).alias("dry_area_km2"), part(wet, area, 1e6).alias("wet_area_km2"), part(dry, population, 1.0).alias("dry_population"), part(wet, population, 1.0).alias("wet_population")
    )


def exposure_pivot(exposed: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    return exposed.groupBy(*by).pivot("event_class", classes).agg(F.first("dry_population").alias("dry_population"), F.first("wet_population").alias("wet_population"))


def nearest_year(events: DataFrame, years: DataFrame, event: str = "event_year") -> DataFrame:
    """(event, year): the available year nearest to each event, the earlier of equals. Both tables are short."""
    gap = F.abs(F.col("year") - F.col(event))
    return events.select(event).distinct().crossJoin(small(years.select("year").distinct())).groupBy(event).agg(F.min_by("year", F.struct(gap, F.col("year"))).alias("year"))


def density_to_count(density: Column | str, area: Column | str) -> Column:
    """Persons for each km2 times the cell's km2."""
    density, area = (F.col(c) if isinstance(c, str) else c for c in (density, area))
    return density * area / 1e6
