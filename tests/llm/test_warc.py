import hashlib

from tidemill.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first.get(h) is not None and first[h] != i
        out.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(first[h]) if again else "None"))
    return sorted(out)


def run(spark, rows):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, offset int")
    got = warc.archive_round_trip(pages).collect()
    assert all(r.payload_ok for r in got)
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got)


def test_round_trip(spark):
    long = "é<p>" * 60
    rows = [(5, "http://a", long), (3, "b\r\nX: y", long), (7, None, long), (8, "", "short"), (9, "u", "short"), (10, "u", None), (11, "u", ""), (None, "u", long), (12, "u", "x\r\n\r\n" * 50), (13, "u", "z" * 300_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_magic_inside_payloads(spark):
    rows = [(1, "u", FAKE), (2, "u", "a" + FAKE * 3 + "b"), (3, "u", "WARC/1.0\r\n"), (4, "u", "text WARC/1.0\r\nContent-Length: 99999\r\n\r\n"), (5, "u", FAKE.replace("5", "60") * 9)] + [(k, "u", f"page {k} " * k) for k in range(20, 60)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_chain_jumps_over_many_runs(spark):
    # Records 0, 10, 20, ... each with a false candidate 5 bytes in that names a place between candidates or another false one.
    rows = [("f", k, k + 10) for k in range(0, 400, 10)] + [("f", k + 5, k + 25 if k % 20 else k + 7) for k in range(0, 400, 10)] + [("g", 3, 9)]
    got = warc.chain(spark.createDataFrame(rows, "file string, offset long, successor long")).collect()
    assert sorted(r.offset for r in got) == list(range(0, 400, 10))


def test_repeated_ids_with_equal_and_other_payloads(spark):
    p, q, r = "p" * 120, "q" * 130, "r" * 140
    rows = [(1, "u", p), (5, "u", p), (5, "u", q), (2, "u", r), (6, "u", p), (6, "u", r), (6, "u", r), (None, "u", q), (2, "u", "short"), (2, "u", None)]
    assert run(spark, rows) == brute(rows)


def test_sql_on_repeated_ids(spark, tmp_path):
    import duckdb

    from tidemill.llm.queries import OP4_SQL, op4_warc

    p, q, r = "p" * 120, "é" * 130, "r" * 140
    rows = [(1, "u", p), (5, "u", p), (5, "u", q), (2, "u", r), (6, "u", p), (6, "u", r), (6, "u", r), (7, "u", "short"), (7, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, op4_warc(spark, str(tmp_path)).collect()), key=str) == sorted(con.sql(OP4_SQL).fetchall(), key=str)
