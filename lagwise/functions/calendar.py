"""Season codes, season labels and amplitude classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Three-month seasons by their central month, January first.
CENTRED = ("DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ")

#: Amplitude classes: name -> (least, below) of the absolute peak.
CLASSES: dict[str, tuple[float, float]] = {"weak": (0.5, 1.0), "moderate": (1.0, 1.5), "strong": (1.5, 2.0), "super": (2.0, float("inf"))}


def season_label(month: Column | str) -> Column:
    """The season whose central month is given."""
    month = F.col(month) if isinstance(month, str) else month
    return F.element_at(F.array(*map(F.lit, CENTRED)), month.cast("int"))


def season_lags(code: str) -> tuple[int, ...]:
    """The three lags, in months from December of the developing year, of a code such as JJA0, DJF01 or MAM1.

    The first digit is the year of the season's first month: 0 the developing year, 1 the year after; a second digit, as of a
    season that crosses into the next year, says nothing more.
    """
    letters, years = code[:3], code[3:]
    if letters not in CENTRED or not years.isdecimal() or len(years) > 2:
        raise ValueError(f"not a season: {code!r}")
    start = CENTRED.index(letters) - 12 if letters != "DJF" else 0  # the first month's lag; DJF starts in December itself
    return tuple(start + 12 * int(years[0]) + k for k in range(3))


def season_table(spark: SparkSession, codes: list[str]) -> DataFrame:
    """(season, lag): three rows for each code."""
    return spark.createDataFrame([(c, lag) for c in codes for lag in season_lags(c)], "season string, lag int")


def amplitude_class(peak: Column | str, classes: dict[str, tuple[float, float]] = CLASSES) -> Column:
    """The class whose range holds the absolute peak, or 'none'."""
    size = F.abs(F.col(peak) if isinstance(peak, str) else peak)
    out = F.lit("none")
    for name, (low, high) in classes.items():
        out = F.when((size >= low) & (size < high), name).otherwise(out)
    return out
