"""Layout of items: channels as items and back, names, frequencies, patches, time features, resizing.

Items are packed rows (item_id, target); ``target`` is an array of values, or of channels where that is said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Seasons per unit of frequency, default horizons (general, and of the M4 sets), multiples by term.
SEASONS = {"S": 3600, "T": 1440, "H": 24, "D": 1, "W": 1, "B": 5, "M": 12, "Q": 4, "A": 1}
HORIZONS = {"A": 6, "Q": 8, "M": 12, "W": 8, "B": 21, "D": 30, "H": 48, "T": 48, "S": 60}
M4_HORIZONS = {"A": 6, "Q": 8, "M": 18, "W": 13, "D": 14, "H": 48}
TERMS = {"short": 1, "medium": 10, "long": 15}
#: Other spellings of units.
ALIASES = {"MIN": "T", "ME": "M", "MS": "M", "QE": "Q", "QS": "Q", "Y": "A", "YE": "A", "YS": "A"}
DAY = 86_400


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def to_univariate(items: DataFrame) -> DataFrame:
    """One item per channel of ``target``; ids end in ``_dim`` and the channel's number.  Other columns stay."""
    rows = items.select("*", F.posexplode("target").alias("_k", "_channel"))
    name = F.concat(F.col("item_id").cast("string"), F.lit("_dim"), F.col("_k").cast("string"))
    return rows.withColumn("item_id", name).withColumn("target", F.col("_channel")).drop("_k", "_channel")


def to_multivariate(rows: DataFrame) -> DataFrame:
    """The inverse of :func:`to_univariate`: (item_id, target of channels in their order)."""
    name, k = F.regexp_extract("item_id", r"^(.*)_dim\d+$", 1), F.regexp_extract("item_id", r"_dim(\d+)$", 1).cast("int")
    channels = F.array_sort(F.collect_list(F.struct(k.alias("k"), "target")))
    return rows.groupBy(name.alias("item_id")).agg(F.transform(channels, lambda c: c["target"]).alias("target"))


def unflatten(rows: DataFrame, n_variates: int) -> DataFrame:
    """Adds ``series`` and ``variate`` to rows numbered by ``idx`` across variates first."""
    if n_variates < 1:
        raise ValueError("n_variates must be positive")
    return rows.withColumn("series", F.floor(F.col("idx") / n_variates)).withColumn("variate", F.pmod("idx", F.lit(n_variates)))


def item_names(rows: DataFrame) -> DataFrame:
    """Adds ``item_id`` to (file, variate, ...): the file where files have one variate, the variate of a single file, else both."""
    counts = rows.agg(F.count_distinct("file").alias("_files"), F.count_distinct("variate").alias("_variates"))
    name = F.when((F.col("_files") > 1) & (F.col("_variates") == 1), F.col("file")).when(F.col("_files") == 1, F.col("variate")).otherwise(F.concat_ws("_", "file", "variate"))
    return rows.join(F.broadcast(counts)).withColumn("item_id", name).drop("_files", "_variates")


def infer_freq(rows: DataFrame) -> DataFrame:
    """(series, step_seconds, step_months, freq) of (series, ts): the one distinct step in seconds, or in months at the same
    moment of the month.  ``freq`` is NULL where neither is single: an irregular series, or one of fewer than two times."""
    before = F.lag("ts").over(Window.partitionBy("series").orderBy("ts"))
    month = lambda t: F.year(t) * 12 + F.month(t)
    same = (F.dayofmonth("ts") == F.dayofmonth("before")) & (F.timestamp_diff("SECOND", F.date_trunc("day", "before"), F.col("before")) == F.timestamp_diff("SECOND", F.date_trunc("day", "ts"), F.col("ts")))
    steps = rows.filter("ts is not null").withColumn("before", before).filter("before is not null").select(
        "series", F.timestamp_diff("SECOND", "before", "ts").alias("s"), F.when(same, month("ts") - month("before")).alias("m")
    )
    single = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")) & (F.min(c) > 0), F.min(c))
    found = steps.groupBy("series").agg(single("s").alias("step_seconds"), single("m").alias("step_months"))
    s, m = F.col("step_seconds"), F.col("step_months")
    named = lambda n, unit: F.concat(F.when(n > 1, n.cast("long").cast("string")).otherwise(F.lit("")), F.lit(unit))
    # Months first: three quarters may have equal days.
    freq = F.when(m % 12 == 0, named(m / 12, "A")).when(m % 3 == 0, named(m / 3, "Q")).when(m > 0, named(m, "M"))
    freq = F.coalesce(freq, F.when(s % (7 * DAY) == 0, named(s / (7 * DAY), "W")).when(s % DAY == 0, named(s / DAY, "D")).when(s % 3600 == 0, named(s / 3600, "H")).when(s % 60 == 0, named(s / 60, "T")).when(s > 0, named(s, "S")))
    return rows.select("series").distinct().join(found, "series", "left").withColumn("freq", freq)


def require_freq(found: DataFrame) -> DataFrame:
    """Raises ValueError naming up to five series without a frequency."""
    lost = [r["series"] for r in found.filter("freq is null").select("series").orderBy("series").limit(5).collect()]
    if lost:
        raise ValueError(f"no single frequency for series {lost}")
    return found


def freq_size(freq: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(freq, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(1))


def freq_unit(freq: str) -> Column:
    """The unit's letter, whatever its spelling: 15min is T, W-SUN is W."""
    unit = F.upper(F.regexp_extract(freq, r"^\d*([A-Za-z]+)", 1))
    return F.coalesce(F.try_element_at(_lookup(ALIASES), unit), unit)


def steps_per_day(seconds: str) -> Column:
    """Steps of so many seconds in a day where that is a whole number, else 1."""
    s = F.col(seconds)
    return F.when((s > 0) & (s <= DAY) & (F.pmod(F.lit(DAY), s) == 0), (F.lit(DAY) / s).cast("int")).otherwise(1)


def seasonality(freq: str) -> Column:
    """The unit's season over the multiple where that is whole, else 1; unknown units have 1."""
    base, n = F.try_element_at(_lookup(SEASONS), freq_unit(freq)), freq_size(freq)
    return F.when((n > 0) & (F.pmod(base, n) == 0), (base / n).cast("int")).otherwise(1)


def default_horizon(freq: str, term: str = "short", m4: bool = False) -> Column:
    if term not in TERMS:
        raise ValueError(f"unknown term {term!r}")
    return F.try_element_at(_lookup(M4_HORIZONS if m4 else HORIZONS), freq_unit(freq)) * TERMS[term]


def cast_features(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric columns become double, others string, by the schema."""
    number = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.col(c).cast("double" if kinds[c].startswith(number) else "string") for c in columns})


def patch(packed: DataFrame, size: int, stride: int) -> DataFrame:
    """Adds ``patches`` of the target padded with NULL on its left to a multiple of ``size``, and ``usable``: any value observed."""
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be positive")
    n = F.size("target")
    padded = F.concat(F.array_repeat(F.lit(None).cast("double"), F.pmod(-n, F.lit(size))), F.col("target"))
    out = packed.withColumn("_padded", padded)
    windows = F.transform(F.sequence(F.lit(0), F.size("_padded") - size, F.lit(stride)), lambda i: F.slice("_padded", i + 1, F.lit(size)))
    out = out.withColumn("patches", F.when(n > 0, windows).otherwise(F.array().cast("array<array<double>>"))).drop("_padded")
    return out.withColumn("usable", F.transform("patches", lambda p: F.exists(p, lambda v: v.isNotNull())))


def time_index(long: DataFrame, scale: float) -> DataFrame:
    """Adds ``t``: positions counted back from the series' end, -n ... -1, over ``scale``."""
    n = F.max("pos").over(Window.partitionBy("series")) + 1
    return long.withColumn("t", (F.col("pos") - n) / F.lit(float(scale)))


def fourier_features(rows: DataFrame, coord: str, scales: list[float], n: int, base: float = 2.0, disjoint: bool = False, log: bool = True) -> DataFrame:
    """Adds sin_<scale>_<k> and cos_<scale>_<k> of ``coord`` times pi times ``n`` bands between the scale's bounds."""
    out, low = {}, 0.0
    for number, scale in enumerate(scales):
        start = low if disjoint else 0.0
        for k in range(n):
            part = k / (n - 1) if n > 1 else 0.0
            band = base ** (start + (scale - start) * part) if log else base**start + (base**scale - base**start) * part
            angle = F.col(coord) * (band * 3.141592653589793)
            out |= {f"sin_{number}_{k}": F.sin(angle), f"cos_{number}_{k}": F.cos(angle)}
        low = scale
    return rows.withColumns(out)


def group_ids(targets: DataFrame, covariates: DataFrame) -> DataFrame:
    """(series, name, role, group_id, place): targets first, then past-only covariates, then those known ahead, by name.

    Inputs: (series, name), and (series, name, known_future)."""
    rows = targets.select("series", "name", F.lit(0).alias("role")).unionByName(covariates.select("series", "name", F.when(F.col("known_future"), 2).otherwise(1).alias("role")))
    rows = rows.groupBy("series", "name").agg(F.max("role").alias("role"))
    # Series are numbered by ranges: within each from its first, and by the number of those in the ranges before.
    ranged = checkpointed(rows.select("series").distinct().orderBy("series").withColumn("_n", F.monotonically_increasing_id()))
    ranged = ranged.select("series", F.shiftright("_n", 33).alias("_range"), F.col("_n").bitwiseAND((1 << 33) - 1).alias("_place"))
    sizes = ranged.groupBy("_range").agg((F.max("_place") + 1).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))  # a row per range
    ids = ranged.join(F.broadcast(before), "_range").select("series", (F.col("_before") + F.col("_place")).cast("int").alias("group_id"))
    return rows.join(ids, "series").withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy("role", "name")) - 1)


def resize_series(packed: DataFrame, n: int, mode: str = "nearest") -> DataFrame:
    """The target at ``n`` places: nearest earlier value, or linear between half-pixel centres.  An empty target stays empty."""
    if n < 1 or mode not in ("nearest", "linear"):
        raise ValueError("n must be positive and mode nearest or linear")
    size = F.size("target")
    at = lambda i: F.get(F.col("target"), i.cast("int"))

    def linear(i):
        spot = F.greatest((i + 0.5) * size / F.lit(float(n)) - 0.5, F.lit(0.0))
        low = F.floor(spot)
        w = spot - low
        return at(low) * (1 - w) + at(F.least(low + 1, size - 1)) * w

    places = F.sequence(F.lit(0), F.lit(n - 1))
    made = F.transform(places, (lambda i: at(F.floor(i * size / F.lit(float(n))))) if mode == "nearest" else linear)
    return packed.withColumn("target", F.when(size > 0, made).otherwise(F.col("target")))
