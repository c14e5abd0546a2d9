import hashlib

import pytest
from pyspark.sql import functions as F

from tidemill.llm.exact_dedup import drop_duplicates, exact_dedup, exchanged, merged

ROWS = [(5, "Ab É"), (3, "aB É"), (9, "ab é"), (7, None), (8, ""), (None, "ab É"), (None, "only"), (3, "aB É"), (4, "x" * 200_000), (6, "X" * 200_000), (10, "solo")]


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        k = (min if keep == "smallest" else max)(ids) if ids else None
        out.append((i, k, len(groups[norm(t)]), i == k, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("runs,fan_in", [(4096, 16), (8, 2), (5, 3), (1, 2)])
def test_against_brute_force(spark, keep, runs, fan_in):
    docs = spark.createDataFrame([(*r, "q", 1) for r in ROWS], "doc_id long, text string, keep_id string, at int").repartition(7)
    got = exact_dedup(docs, keep=keep, runs=runs, fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == brute(ROWS, keep)


def test_sql_on_repeated_rows_and_null_ids(spark, tmp_path):
    import duckdb

    from tidemill.llm.queries import OP2_SQL, op2_exact_dedup

    rows = [*ROWS, *ROWS, (None, None), (None, "solo")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = op2_exact_dedup(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(map(str, con.sql(f"SELECT {', '.join(sorted(got.columns))} FROM ({OP2_SQL})").fetchall()))


def test_empty_and_arguments(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(docs).collect() == [] and drop_duplicates(docs).collect() == []
    with pytest.raises(ValueError):
        exact_dedup(docs, keep="first")


def test_drop_duplicates_keeps_columns_and_one_row_each(spark):
    docs = spark.createDataFrame([(*r, "q") for r in ROWS], "doc_id long, text string, kept string")
    out = drop_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted(((str(r.doc_id), norm(r.text)) for r in out.collect()))
    assert got == sorted([("3", norm("ab É")), ("9", "ab é"), ("7", ""), ("None", "only"), ("4", "x" * 200_000), ("10", "solo")])


def test_hot_group(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Same', concat('t', id)) as text")
    got = exact_dedup(docs, runs=16, fan_in=4, keep="largest").filter("kept").count()
    assert got == 2001


def test_rounds_exchange_between_partners_and_merge_in_order(spark):
    """Three binomial rounds over eight positions: a round changes one digit of a line's position, and after the last every
    line is in its digest's slice, once; the merge sorts what it receives and needs neither hash table nor second shuffle."""
    rows = [(k % 8, hashlib.sha256(b"%d" % (k % 40)).digest(), 1, k % 40, k) for k in range(320)]
    level = spark.createDataFrame(rows, "at int, digest binary, octets int, check long, id long").selectExpr("at", "digest", "octets", "check", "struct(id) best", "1L n")
    for stride in (4, 2, 1):
        moved = exchanged(level, stride, 2, 8)
        for r in moved.collect():
            assert (r.at // stride) % 2 == ((r.digest[0] >> 5) // stride) % 2
        result = merged(moved, "smallest")
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" in plan and "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
        for part in result.withColumn("part", F.spark_partition_id()).toPandas().groupby("part"):
            keys = list(zip(part[1]["at"], part[1]["digest"]))
            assert keys == sorted(keys)
        level = spark.createDataFrame(result.collect(), result.schema)
    got = level.collect()
    assert sorted((r.check, r.best.id, r.n) for r in got) == [(k, k, 8) for k in range(40)]
    assert all(r.at == r.digest[0] >> 5 for r in got)
