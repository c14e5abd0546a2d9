"""Frequencies as a unit, a multiple and an anchor, and the calendar's arithmetic on them.

A frequency numbers its periods: ``index`` turns a time to the number of its period and ``time`` a number to the period's
label, both as column expressions, so no calendar is ever enumerated or joined.  Labels are period starts for seconds,
minutes, hours, days and the ``...S`` months, quarters and years; the anchor's day for weeks; the last day for months,
quarters and years otherwise; and the day itself for business days (Saturday and Sunday count to Friday).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of the units that have them, days and months that anchors name, spellings.
SECONDS = {"S": 1, "T": 60, "H": 3600, "D": 86_400}
WEEKDAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
SPELLINGS = {"MIN": "T", "M": "ME", "Q": "QE", "A": "YE", "Y": "YE", "AS": "YS"}
SPAN = {"M": 1, "Q": 3, "Y": 12}


@dataclass(frozen=True)
class Freq:
    """``unit`` is S, T, H, D, W, B, ME, MS, QE, QS, YE or YS.  ``anchor``: a weekday from Monday as 0 for weeks; a month from January as 0
    for quarters and years, the last month of a period that ends there and the first of one that starts there."""

    unit: str
    n: int = 1
    anchor: int = 0

    def __str__(self) -> str:
        names = WEEKDAYS if self.unit == "W" else MONTHS if self.unit[0] in "QY" else None
        return ("" if self.n == 1 else str(self.n)) + self.unit + (f"-{names[self.anchor]}" if names else "")

    @property
    def shift(self) -> int:
        """Months by which periods of several months lie after the first of January."""
        span = SPAN[self.unit[0]]
        return (self.anchor + (1 if self.unit.endswith("E") else 0)) % span

    def index(self, ts: Column | str) -> Column:
        """Number of the period that holds ``ts`` (bigint); NULL for NULL."""
        t = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
        if self.unit in SECONDS:
            seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.date_trunc("second", t).cast("timestamp_ntz"))
            return _floor(seconds, SECONDS[self.unit] * self.n)
        days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
        if self.unit == "W":  # the first of January 1970 was a Thursday: 3 from Monday
            return _floor(days - (self.anchor - 3) + 7 * self.n - 1, 7 * self.n)
        if self.unit == "B":
            monday = days + 3
            return _floor(_floor(monday, 7) * 5 + F.least(F.pmod(monday, F.lit(7)), F.lit(4)), self.n)
        months = (F.year(t) * 12 + F.month(t) - 1).cast("bigint")
        return months_index(months, self)

    def time(self, index: Column | str) -> Column:
        """Label of a period's number, as timestamp_ntz."""
        i = (F.col(index) if isinstance(index, str) else index).cast("bigint")
        if self.unit in SECONDS:
            return F.timestamp_add("SECOND", i * (SECONDS[self.unit] * self.n), F.lit("1970-01-01").cast("timestamp_ntz"))
        if self.unit == "W":
            return _day(i * (7 * self.n) + (self.anchor - 3))
        if self.unit == "B":
            k = i * self.n
            return _day(_floor(k, 5) * 7 + F.pmod(k, F.lit(5)) - 3)
        first = i * (self.n * SPAN[self.unit[0]]) + (self.shift if SPAN[self.unit[0]] > 1 else 0)
        if self.unit.endswith("S"):
            return F.timestamp_add("MONTH", first - 1970 * 12, F.lit("1970-01-01").cast("timestamp_ntz"))
        after = F.timestamp_add("MONTH", first + self.n * SPAN[self.unit[0]] - 1970 * 12, F.lit("1970-01-01").cast("timestamp_ntz"))
        return F.timestamp_add("DAY", F.lit(-1), after)


def _floor(x: Column, n: int) -> Column:
    return x if n == 1 else F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def _day(days: Column) -> Column:
    return F.timestamp_add("DAY", days, F.lit("1970-01-01").cast("timestamp_ntz"))


def months_index(months: Column, freq: Freq) -> Column:
    span = SPAN[freq.unit[0]]
    return _floor(months - (freq.shift if span > 1 else 0), span * freq.n)


def parse(text: str) -> Freq:
    """15T, 15min, 6H, D, W-SUN, B, M, MS, QE-DEC, 2Q, A, YS-APR, ...; ValueError for anything else."""
    found = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-([A-Za-z]{3}))?", text.strip())
    if not found or found[1] == "0" * len(found[1]) and found[1]:
        raise ValueError(f"no frequency: {text!r}")
    unit, anchor = found[2].upper(), (found[3] or "").upper()
    unit = SPELLINGS.get(unit, unit)
    names = WEEKDAYS if unit == "W" else MONTHS if unit in ("QE", "QS", "YE", "YS") else []
    if unit not in (*SECONDS, "W", "B", "ME", "MS", "QE", "QS", "YE", "YS") or anchor and anchor not in names:
        raise ValueError(f"no frequency: {text!r}")
    default = {"W": "SUN", "QE": "DEC", "YE": "DEC", "QS": "JAN", "YS": "JAN"}.get(unit)
    return Freq(unit, int(found[1] or 1), names.index(anchor or default) if names else 0)


def as_freq(freq: str | Freq) -> Freq:
    return parse(freq) if isinstance(freq, str) else freq


def regularize(events: DataFrame, series: str, ts: str, value: str, freq: str | Freq) -> DataFrame:
    """(series, pos, ts, y): mean value per series and period; periods without events are rows with NULL.

    NaN is missing; events without a time go.  ``pos`` counts periods from the series' first."""
    f = as_freq(freq)
    value = F.when(~F.isnan(value), F.col(value))
    means = events.select(F.col(series).alias("series"), f.index(ts).alias("i"), value.alias("v")).filter("i is not null").groupBy("series", "i").agg(F.avg("v").alias("y"))
    own = Window.partitionBy("series")
    rows = means.withColumn("_next", F.lead("i").over(own.orderBy("i"))).withColumn("_low", F.min("i").over(own))
    spread = F.sequence(F.col("i"), F.coalesce(F.col("_next") - 1, F.col("i")))
    rows = rows.select("series", "_low", F.col("i").alias("_own"), "y", F.explode(spread).alias("i"))
    return rows.select("series", (F.col("i") - F.col("_low")).cast("int").alias("pos"), f.time("i").alias("ts"), F.when(F.col("i") == F.col("_own"), F.col("y")).alias("y"))


def pack(long: DataFrame, freq: str | Freq) -> DataFrame:
    """(series, start, freq, target) of a regular frame."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "y")))
    return long.groupBy("series").agg(F.min("ts").alias("start"), F.lit(str(as_freq(freq))).alias("freq"), ordered.alias("_p")).select("series", "start", "freq", F.transform("_p", lambda s: s["y"]).alias("target"))


def shifted(start: Column | str, steps: Column, freqs: list[str | Freq], freq_col: str = "freq") -> Column:
    """The label ``steps`` periods after the period of ``start``, each row by its own ``freq_col``, one of ``freqs``; others give NULL."""
    made = [F.when(F.col(freq_col) == str(f), f.time(f.index(start) + steps)) for f in map(as_freq, freqs)]
    return F.coalesce(*made, F.lit(None).cast("timestamp_ntz"))


def unpack(packed: DataFrame) -> DataFrame:
    """The inverse of :func:`pack`, each row by its own ``freq``; the distinct frequencies (some dozens at most) are the plan's only list."""
    freqs = [r["freq"] for r in packed.select("freq").distinct().collect() if r["freq"]]
    rows = packed.select("series", "start", "freq", F.posexplode("target").alias("pos", "y"))
    return rows.select("series", "pos", shifted("start", F.col("pos"), freqs).alias("ts"), "y")


def forecast_times(packed: DataFrame, horizon: int) -> DataFrame:
    """(series, step, ts): the labels of the ``horizon`` periods after each packed series' end."""
    if horizon < 1:
        raise ValueError("horizon must be positive")
    freqs = [r["freq"] for r in packed.select("freq").distinct().collect() if r["freq"]]
    rows = packed.select("series", "start", "freq", F.size("target").alias("_n"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return rows.select("series", "step", shifted("start", F.col("_n") + F.col("step") - 1, freqs).alias("ts"))


def infer(rows: DataFrame) -> DataFrame:
    """(series, freq): the frequency whose periods the times of (series, ts) fill one by one, else NULL.

    Steps are those between neighbouring distinct times.  Tried are, in this order: one step of whole months from month start to month start or from
    month end to month end (years and quarters where the multiple allows), one step of whole seconds (weeks, days, hours, minutes,
    seconds, by the largest that divides), and business days, where the steps are 1, or 3 from Friday on.  Fewer than two times give NULL.
    """
    spots = rows.filter("ts is not null").select("series", F.col("ts").cast("timestamp_ntz").alias("ts")).distinct()
    spots = spots.withColumn("before", F.lag("ts").over(Window.partitionBy("series").orderBy("ts")))
    midnight = lambda c: F.date_trunc("day", c).cast("timestamp_ntz") == F.col(c)
    month = lambda c: F.year(c) * 12 + F.month(c)
    last = lambda c: F.last_day(c) == F.col(c).cast("date")
    facts = spots.select(
        "series", "ts", "before", midnight("ts").alias("midnight"), (F.dayofmonth("ts") == 1).alias("starts"), last("ts").alias("ends"), F.timestamp_diff("SECOND", "before", "ts").alias("s"),
        (month("ts") - month("before")).alias("m"), (Freq("B").index("ts") - Freq("B").index("before")).alias("b"), (F.weekday("ts") < 5).alias("work"), F.weekday("ts").alias("weekday"),
    )
    single = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) > 0), F.min(c))
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(False))
    found = facts.groupBy("series").agg(
        single("s").alias("s"), single("m").alias("m"), single("b").alias("b"), every("midnight").alias("midnight"), every("starts").alias("starts"), every("ends").alias("ends"), every("work").alias("work"),
        F.max("weekday").alias("weekday"), F.max(F.month("ts")).alias("month"),
    )
    number = lambda k, name: F.concat(F.when(k > 1, k.cast("bigint").cast("string")).otherwise(F.lit("")), name)
    s, m = F.col("s"), F.col("m")
    edge = F.when(F.col("starts"), F.lit("S")).when(F.col("ends"), F.lit("E"))
    named = lambda names, k: F.get(F.array(*[F.lit(x) for x in names]), k)
    # A quarter's anchor is the month of its year's latest label, and a year's that of its only one.
    of_year = F.concat(F.lit("Y"), edge, F.lit("-"), named(MONTHS, F.col("month") - 1))
    of_quarter = F.concat(F.lit("Q"), edge, F.lit("-"), named(MONTHS, F.when(F.col("starts"), F.pmod(F.col("month") - 1, F.lit(3))).otherwise(F.pmod(F.col("month") - 1, F.lit(3)) + 9)))
    by_month = F.when(m % 12 == 0, number(m / 12, of_year)).when(m % 3 == 0, number(m / 3, of_quarter)).otherwise(number(m, F.concat(F.lit("M"), edge)))
    week = F.concat(F.lit("W-"), named(WEEKDAYS, F.col("weekday")))
    by_second = F.when(s % 604_800 == 0, number(s / 604_800, week))
    for unit, size in reversed(SECONDS.items()):
        by_second = by_second.when(s % size == 0, number(s / size, F.lit(unit)))
    freq = F.coalesce(F.when(F.col("midnight") & edge.isNotNull() & m.isNotNull(), by_month), F.when(s.isNotNull(), by_second), F.when(F.col("midnight") & F.col("work") & F.col("b").isNotNull(), number(F.col("b"), F.lit("B"))))
    return rows.select("series").distinct().join(found.select("series", freq.alias("freq")), "series", "left")
