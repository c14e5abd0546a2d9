"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing is one scan: each row becomes a text line ``version, headers, block`` that Spark's text writer ends
with the record separator, so the files are plain WARC in any store Spark can write to.

Reading splits the files anywhere.  Spark's text reader cuts at the version line, so every place where it
occurs, also inside a payload, is a candidate start; its header names the successor's offset.  Runs of
candidates that each name the next are links of a chain; pointer jumping over runs from the file's start
keeps what is reachable.  A candidate inside a payload is on no path from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_path, remove, sized

VERSION, EOL = "WARC/1.0\r\n", "\r\n"
#: Payloads of fewer bytes are always stored whole.
LEAST_SHARED = 100
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def decide(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Revisits only: id and digest (an id may repeat with other payloads), and the id of the response that holds the payload."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    digests = cut(pages.select(F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes")).filter(F.col("bytes") >= LEAST_SHARED), "warc-digests")
    groups = digests.groupBy("digest", "bytes").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    groups = cut(groups, "warc-groups")
    return cut(digests.join(sized(groups), ["digest", "bytes"]).filter(~F.col("id").eqNullSafe(F.col("refers_to"))).select(F.col("id").alias("_revisit"), F.col("digest").alias("_of"), "refers_to").distinct(), "warc-revisits")


def record(page_id: Column, url: Column, payload: Column, refers_to: Column) -> Column:
    """The whole record but the separator."""
    header = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(EOL))
    urn = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(">"))
    revisit = refers_to.isNotNull()
    http = F.concat(F.lit(HTTP), F.octet_length(payload).cast("string"), F.lit(EOL + EOL))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    return F.concat(
        F.lit(VERSION),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", urn(page_id)),
        header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        header("WARC-Target-URI", F.translate(F.coalesce(url, F.lit("")), "\r\n", "")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(payload, 256))),
        F.when(revisit, header("WARC-Refers-To", urn(refers_to))).otherwise(F.lit("")),
        F.when(revisit, header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(EOL),
        block,
    )


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One record per row.  Of rows with equal payloads of at least 100 bytes the smallest id is the response,
    the others revisit it.  Null payloads are empty; a null id is written as ``none`` and only ever refers.
    Rows that repeat an id, with equal or other payloads, each get a record.  Ids are read back as whole numbers;
    ids of other kinds are written, but come back null."""
    revisits = decide(pages, id_col, payload_col)
    joined = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(payload_col), F.lit("")).alias("_payload"))
    # By id and digest: a row that repeats an id but not its payload is no revisit of another payload's response.
    same = F.col("_id").eqNullSafe(F.col("_revisit")) & (F.col("_digest") == F.col("_of"))
    joined = joined.withColumn("_digest", F.sha2("_payload", 256)).join(sized(revisits), same, "left")
    own = F.when(F.octet_length("_payload") >= LEAST_SHARED, F.col("refers_to"))
    joined.select(record(F.col("_id"), F.col("_url"), F.col("_payload"), own).alias("value")).write.option("lineSep", EOL + EOL).text(path)


def chain(candidates: DataFrame) -> DataFrame:
    """The candidates reachable from their file's start.

    ``candidates``: file, offset, successor, and any other columns.  Neighbours in offset order that name one
    another form runs; each run has one way out, so reachability is pointer jumping over runs."""
    by_file = Window.partitionBy("file").orderBy("offset")
    rows = candidates.withColumn("_start", F.when(F.coalesce(F.lag("successor").over(by_file) == F.col("offset"), F.lit(False)), 0).otherwise(1))
    rows = cut(rows.withColumn("_run", F.sum("_start").over(by_file.rowsBetween(Window.unboundedPreceding, 0))).drop("_start"), "warc-runs")
    ends = rows.groupBy("file", "_run").agg(F.max_by("successor", "offset").alias("to"))
    broken = cut(rows.filter(F.col("_run") > 1).select("file", F.col("_run").alias("next_run"), F.col("offset").alias("to")), "warc-broken")
    jumps = cut(ends.join(broken, ["file", "to"]).select("file", "_run", "next_run", F.col("to").alias("entry")), "warc-jumps")
    reached = cut(ends.filter("_run = 1").select("file", "_run").join(rows.filter("offset = 0").select("file").distinct(), "file", "left_semi").withColumn("entry", F.lit(0).cast("bigint")), "warc-reached")
    hop = jumps.select("file", "_run", "next_run", "entry")
    before = -1
    while not jumps.isEmpty() and (now := reached.count()) != before:
        before = now
        more = reached.select("file", "_run").join(hop, ["file", "_run"]).select("file", F.col("next_run").alias("_run"), "entry")
        after = cut(reached.unionByName(more).distinct(), "warc-reached")
        ahead = hop.select("file", F.col("_run").alias("next_run"), F.col("next_run").alias("after"), F.col("entry").alias("after_entry"))
        hop = cut(hop.join(ahead, ["file", "next_run"]).select("file", "_run", F.col("after").alias("next_run"), F.col("after_entry").alias("entry")), "warc-hop")
        remove(reached)
        reached = after
    entries = reached.groupBy("file", "_run").agg(F.min("entry").alias("_entry"))
    return rows.join(sized(cut(entries, "warc-entries")), ["file", "_run"]).filter("offset >= _entry").drop("_run", "_entry")


def segments(spark, path: str, files: DataFrame | None = None) -> DataFrame:
    """Candidates with offset and successor (null without a header), and what a record read whole says.
    With ``files``, only those files, and each candidate's text up to the next one."""
    length = len(VERSION)
    text = spark.read.option("lineSep", VERSION).text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    if files is not None:
        lines = lines.join(files, "file", "left_semi")
    lines = lines.withColumn("head", F.when(F.instr("value", EOL + EOL) > 0, F.substring_index("value", EOL + EOL, 1))).withColumn("octets", F.octet_length("value").cast("bigint"))
    number = lambda source, pattern: F.expr(f"try_cast(nullif(regexp_extract({source}, '{pattern}', 1), '') as bigint)")
    lines = lines.withColumn("head_octets", F.octet_length("head") + 4).withColumn("content", number("head", r"(?:^|\\r\\n)Content-Length: ([0-9]+)"))
    whole = F.col("head_octets") + F.col("content") + 4 == F.col("octets")
    lines = lines.withColumn("body", F.when(whole, F.substring(F.col("value").cast("binary"), F.col("head_octets") + 1, F.col("content"))))
    field = lambda name: F.regexp_extract(F.col("head"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    lines = lines.select(
        "file", "block", "line", "octets", "head_octets", "content", F.lit(None).cast("string").alias("value") if files is None else F.col("value"),
        field("WARC-Type").alias("kind"), F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("declared"),
        number("head", "WARC-Record-ID: <urn:page:([^>]*)>").alias("page_id"), number("head", "WARC-Refers-To: <urn:page:([^>]*)>").alias("refers_to"),
        F.sha2(payload_of("body"), 256).alias("read_digest"), F.octet_length(payload_of("body")).cast("bigint").alias("read_bytes"),
        number("cast(body as string)", r"\\r\\nContent-Length: ([0-9]+)").alias("stated_bytes"),
    )
    # Offsets from the lengths of what lies before, file by file; only numbers move unless texts are asked for.
    along = Window.partitionBy("file").orderBy("block", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.withColumn("offset", F.sum(F.col("octets") + length).over(along) - F.col("octets") - 2 * length)
    return placed.withColumn("successor", F.col("offset") + length + F.col("head_octets") + F.col("content") + 4).filter("offset >= 0")


def payload_of(body: str) -> Column:
    """What follows the HTTP header of a record's block; null where there is none."""
    text = F.col(body).cast("string")
    return F.when(F.instr(text, EOL + EOL) > 0, F.substring(F.col(body), F.octet_length(F.substring_index(text, EOL + EOL, 1)) + 5, F.octet_length(body)))


def read_warc(spark, path: str) -> DataFrame:
    """Records: file, offset, ``page_id``, ``record_type``, ``payload_digest`` (of the full payload, as read for
    responses and as declared for revisits), ``payload_bytes``, ``refers_to``, ``payload_ok`` (a response's payload has
    its declared digest).  Records that end after their file's end are left out."""
    placed = cut(segments(spark, path).drop("value"), "warc-candidates")
    sizes = placed.groupBy("file").agg(F.max(F.col("offset") + len(VERSION) + F.col("octets")).alias("file_end"))
    good = cut(chain(placed.filter("successor is not null")).join(sizes, "file").filter("successor <= file_end"), "warc-good")

    # Payloads that hold a version line lie in several pieces, which are put together again.
    torn = cut(good.filter("read_digest is null").select("file", "offset", "successor", "head_octets", "content"), "warc-torn")
    if not torn.isEmpty():
        starts = good.select("file", "offset", F.col("offset").alias("of"))
        back = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pieces = segments(spark, path, torn.select("file").distinct()).select("file", "offset", "value").join(starts, ["file", "offset"], "left")
        pieces = pieces.withColumn("of", F.last("of", True).over(back)).select("file", F.col("of").alias("offset"), F.col("offset").alias("at"), "value")
        pieces = pieces.join(torn, ["file", "offset"]).filter("at < successor")
        joined = pieces.groupBy("file", "offset", "head_octets", "content").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]), VERSION).alias("value"))
        bodies = joined.withColumn("body", F.substring(F.col("value").cast("binary"), F.col("head_octets") + 1, F.col("content")))
        bodies = bodies.select("file", "offset", F.sha2(payload_of("body"), 256).alias("torn_digest"), F.octet_length(payload_of("body")).cast("bigint").alias("torn_bytes"))
        good = good.join(bodies, ["file", "offset"], "left").withColumn("read_digest", F.coalesce("read_digest", "torn_digest")).withColumn("read_bytes", F.coalesce("read_bytes", "torn_bytes"))
    revisit = F.col("kind") == "revisit"
    return good.select(
        "file", "offset", "page_id", F.col("kind").alias("record_type"),
        F.when(revisit, F.col("declared")).otherwise(F.col("read_digest")).alias("payload_digest"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("read_bytes")).alias("payload_bytes"),
        "refers_to", (revisit | (F.col("declared") == F.col("read_digest"))).alias("payload_ok"),
    )


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc-archive")
    write_warc(pages, path, id_col, url_col, payload_col)
    return read_warc(pages.sparkSession, path)
