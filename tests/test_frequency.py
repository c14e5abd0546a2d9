import datetime as dt

import pandas as pd
import pytest

from tidemill.operators import frequency
from tidemill.operators.frequency import Freq, parse

PANDAS = ["15min", "6h", "D", "3D", "W-SUN", "W-WED", "B", "ME", "MS", "QE-DEC", "QE-JAN", "QS-FEB", "YE-JUN", "YS-APR", "YE-DEC", "QS-JAN", "30s"]


def test_parse():
    assert parse("15min") == parse("15T") == Freq("T", 15) and parse("W") == Freq("W", 1, 6) and parse("M") == Freq("ME") and parse("2Q") == Freq("QE", 2, 11)
    assert str(parse("A-JUN")) == "YE-JUN" and str(parse("6h")) == "6H" and str(parse("QS")) == "QS-JAN" and str(parse("b")) == "B"
    for bad in ("", "X", "0D", "W-JAN", "D-SUN", "1.5H", "QE-SUN", "-D"):
        with pytest.raises(ValueError):
            parse(bad)


def test_labels_are_those_of_a_calendar(spark):
    """Labels made by a calendar library go to consecutive numbers and back to themselves, before and after 1970."""
    rows = []
    for name in PANDAS:
        for start in ("1959-11-03", "2023-12-20"):
            rows += [(name, start, k, t.to_pydatetime()) for k, t in enumerate(pd.date_range(start, periods=40, freq=name))]
    frame = spark.createDataFrame(rows, "name string, start string, k int, ts timestamp_ntz")
    for name in PANDAS:
        f = parse(name)
        got = frame.filter(frame.name == name).select("start", "k", "ts", f.index("ts").alias("i"), f.time(f.index("ts")).alias("back")).orderBy("start", "k").collect()
        assert name == "3D" or all(r.ts == r.back for r in got), name  # a multiple of days counts from 1970
        assert all(b.i - a.i == 1 for a, b in zip(got, got[1:]) if a.start == b.start), name


def test_times_within_periods(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    cases = [
        ("15T", "2024-05-01T10:14:59.5", "2024-05-01T10:00:00"), ("6H", "2024-05-01T05:00:00", "2024-05-01T00:00:00"), ("6H", "1969-12-31T23:00:00", "1969-12-31T18:00:00"),
        ("W-SUN", "2024-05-01T10:00:00", "2024-05-05T00:00:00"), ("W-SUN", "2024-05-05T23:00:00", "2024-05-05T00:00:00"), ("W-WED", "2024-05-02T00:00:00", "2024-05-08T00:00:00"),
        ("B", "2024-05-04T10:00:00", "2024-05-03T00:00:00"), ("B", "2024-05-05T10:00:00", "2024-05-03T00:00:00"), ("B", "2024-05-06T10:00:00", "2024-05-06T00:00:00"),
        ("ME", "2024-02-03T10:00:00", "2024-02-29T00:00:00"), ("MS", "2024-02-03T10:00:00", "2024-02-01T00:00:00"), ("QE-DEC", "2024-02-03T10:00:00", "2024-03-31T00:00:00"),
        ("QE-JAN", "2024-02-03T10:00:00", "2024-04-30T00:00:00"), ("QS-FEB", "2024-01-03T10:00:00", "2023-11-01T00:00:00"), ("YE-JUN", "2024-07-01T00:00:00", "2025-06-30T00:00:00"), ("YS-APR", "2024-03-31T00:00:00", "2023-04-01T00:00:00"),
    ]
    for name, ts, label in cases:
        f = parse(name)
        (r,) = spark.createDataFrame([(t(ts),)], "ts timestamp_ntz").select(f.time(f.index("ts")).alias("x")).collect()
        assert r.x == t(label), (name, ts)
    assert spark.createDataFrame([(None,)], "ts timestamp_ntz").select(parse("W").index("ts").alias("i")).first().i is None


def test_regularize_pack_unpack(spark):
    times = pd.date_range("2024-01-31", periods=14, freq="ME")
    events = spark.createDataFrame([("a", t.to_pydatetime() - dt.timedelta(days=k % 3), float(k), "x") for k, t in enumerate(times) if k not in (3, 4, 9)] + [("b", times[0].to_pydatetime(), float("nan"), "x"), ("c", None, 1.0, "x")], "who string, ts timestamp_ntz, v double, series string")
    long = frequency.regularize(events, "who", "ts", "v", "M")
    got = {(r.series, r.pos): (r.ts, r.y) for r in long.collect()}
    assert got == {("a", k): (t.to_pydatetime(), None if k in (3, 4, 9) else float(k)) for k, t in enumerate(times)} | {("b", 0): (times[0].to_pydatetime(), None)}
    packed = frequency.pack(long, "M").unionByName(frequency.pack(frequency.regularize(events.filter("who = 'a'"), "who", "ts", "v", "W").withColumn("series", frequency.F.lit("w")), "W"))
    back = {(r.series, r.pos): (r.ts, r.y) for r in frequency.unpack(packed).filter("series <> 'w'").collect()}
    assert back == got
    ahead = {(r.series, r.step): r.ts for r in frequency.forecast_times(packed, 2).collect()}
    assert ahead["a", 1] == dt.datetime(2025, 3, 31) and ahead["b", 2] == dt.datetime(2024, 3, 31) and ahead["w", 1].weekday() == 6
    assert frequency.regularize(events.limit(0), "who", "ts", "v", "B").collect() == []


def test_infer(spark):
    rows = [(name, t.to_pydatetime()) for name in [*PANDAS, "2MS", "2h", "2W-SUN"] for t in pd.date_range("2021-03-05", periods=30, freq=name)]
    rows += [("irregular", dt.datetime(2024, 1, d)) for d in (1, 2, 5, 6)] + [("one", dt.datetime(2024, 1, 1)), ("none", None), ("twice", dt.datetime(2024, 1, 1)), ("twice", dt.datetime(2024, 1, 1)), ("twice", dt.datetime(2024, 1, 2))]
    got = {r.series: r.freq for r in frequency.infer(spark.createDataFrame(rows, "series string, ts timestamp_ntz")).collect()}
    want = {name: str(parse(name)) for name in [*PANDAS, "2MS", "2h", "2W-SUN"]} | {"irregular": None, "one": None, "none": None, "twice": "D"}
    want |= {"QE-JAN": "QE-OCT", "QS-FEB": "QS-FEB"}  # quarters that end in January end in October too
    assert got == want
