"""Secret scans with DataFrame functions only.

Base patterns give spans by kind.  Besides, candidate strings (long runs of token characters) are searched for in what
base spans and allow-listed strings leave of a text, and scanned by a sliding window whose Shannon entropy is kept up to
date from counts: each step adds one character and takes one away.  A candidate is a secret when a window's entropy
reaches the threshold of its character class.

Entropies are compared in whole millionths of a bit, so results do not depend on summation order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order: pattern, pattern's group that must be long enough, and its least length.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Character classes from narrow to wide: pattern of a whole candidate, least entropy of a window in bits.  Letters alone
#: are scanned where both cases occur, against the highest threshold.
CLASSES = [("hex", r"^[0-9a-fA-F]+$", 3.0), ("upper", r"^[0-9A-Z]+$", 3.3), ("letters", r"^[^0-9]+$", 3.9), ("token", r"^[A-Za-z0-9+/_=-]+$", 3.7)]
#: Strings that are no secrets and are passed over wherever they stand: UUIDs, and words that hold a mark of documentation.
ALLOWED = [
    r"(?<![A-Za-z0-9])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Za-z0-9]*?(?:EXAMPLE|example|SAMPLE|XXXX|xxxx|0000000000|1234567890)[A-Za-z0-9]*",
]
#: Whole candidates that are none: dates and counters, paths of plain words, words in one case, words run together.
#: Repeated groups are possessive (their parts have no letter in common), so that the matcher loops and never recurses.
PLAIN = [
    r"^[0-9/_=+-]++$",
    r"^[a-z]++(?:[/_-]++(?:[a-z]++|[0-9]{1,4}+))++$",
    r"^[^0-9A-Z]++$",
    r"^[^0-9a-z]++$",
    r"^[/_=+-]*+[a-z]*+(?:[A-Z][a-z]{2,}+[/_=+-]*+)++$",
]
#: Characters by which the pieces of a long candidate advance; pieces overlap, so that each window lies in one whole.
PIECE = 4096

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def part(c: int) -> int:
    """c * log2(c) in millionths."""
    return round(c * math.log2(c) * 1e6) if c > 1 else 0


def spans(text: Column, pattern: str, rank: int, kind: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches with their places in code points; short ones are dropped after matching."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(hits.alias("hit"), tested.alias("tested"), F.slice(gaps, 1, F.size(hits)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(state, x):
        begin = (state["at"] + F.char_length(x["gap"])).cast("int")
        end = (begin + F.char_length(x["hit"])).cast("int")
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        more = F.when(F.char_length(x["tested"]) >= least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), more.alias("found"))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(steps, start, step, lambda s: s["found"])).otherwise(F.array().cast(SPAN))


def least_entropy_sum(piece: Column) -> Column:
    """Least sum of c*log2(c) over the windows of a string, from incremental counts; low means high entropy.

    The counts of the 128 codes are eight bits each in 16 numbers, so a step rewrites 16 numbers; it reads the entering and
    the leaving code from the zipped array and never goes back to the string."""
    codes = F.transform(F.slice(F.split(piece, ""), 1, F.char_length(piece)), lambda c: F.ascii(c))
    leaving = F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), codes), 1, F.char_length(piece))
    moves = F.zip_with(codes, leaving, lambda i, o: F.struct(i.alias("enter"), o.alias("leave")))
    gain = F.array(*[F.lit(part(c + 1) - part(c)).cast("bigint") for c in range(WINDOW + 1)])
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), 16).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(part(WINDOW)).cast("bigint").alias("best"), F.lit(1).alias("k")
    )
    one = F.lit(1).cast("bigint")
    bit = lambda code: F.call_function("shiftleft", one, code.bitwiseAND(F.lit(7)) * 8)
    word = lambda code: F.shiftright(code, 3)

    def count(counts, code):
        return F.call_function("shiftright", F.get(counts, word(code)), code.bitwiseAND(F.lit(7)) * 8).bitwiseAND(F.lit(255)).cast("int")

    def step(state, x):
        full = x["leave"] >= 0
        left = F.when(full, state["sum"] - F.get(gain, count(state["counts"], x["leave"]) - 1)).otherwise(state["sum"])
        before = count(state["counts"], x["enter"]) - F.when(x["enter"] == x["leave"], 1).otherwise(0)
        now = left + F.get(gain, before)
        zero = F.lit(0).cast("bigint")
        counts = F.transform(
            state["counts"], lambda c, i: c + F.when(i == word(x["enter"]), bit(x["enter"])).otherwise(zero) - F.when(full & (i == word(x["leave"])), bit(x["leave"])).otherwise(zero)
        )
        return F.struct(counts.alias("counts"), now.alias("sum"), F.when(state["k"] >= WINDOW, F.least(state["best"], now)).otherwise(state["best"]).alias("best"), (state["k"] + 1).alias("k"))

    return F.aggregate(moves, start, step, lambda s: s["best"])


def least_of_pieces(candidate: Column) -> Column:
    """:func:`least_entropy_sum` of a candidate of any length, by overlapping pieces of bounded length."""
    length = F.char_length(candidate)
    firsts = F.sequence(F.lit(0), F.floor((length - WINDOW) / PIECE).cast("int"))
    return F.array_min(F.transform(firsts, lambda p: least_entropy_sum(F.substring(candidate, p * PIECE + 1, F.lit(PIECE + WINDOW - 1)))))


def blanked(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """``text`` with spaces for the matches of ``pattern`` whose ``group`` has at least ``least`` characters; places stay."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    shown = F.zip_with(hits, tested, lambda h, t: F.when(F.char_length(t) >= least, F.repeat(F.lit(" "), F.char_length(h))).otherwise(h))
    parts = F.zip_with(F.split(text, pattern, -1), shown, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.array_join(parts, "")).otherwise(text)


def entropy_spans(text: Column) -> Column:
    """Spans of the secrets among the candidates of ``text``."""
    found = spans(text, CANDIDATE, len(BASE), "entropy")
    words = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))

    def secret(w):
        limit = F.lit(0).cast("bigint")
        for _, pattern, bits in reversed(CLASSES):
            limit = F.when(F.regexp_like(w, F.lit(pattern)), F.lit(part(WINDOW) - round(bits * WINDOW * 1e6)).cast("bigint")).otherwise(limit)
        ok = F.lit(True)
        for pattern in PLAIN:
            ok = ok & ~F.regexp_like(w, F.lit(pattern))
        return F.when(ok, least_of_pieces(w) <= limit).otherwise(False)

    judged = F.zip_with(found, words, lambda s, w: F.struct(s.alias("span"), secret(w).alias("secret")))
    return F.transform(F.filter(judged, lambda x: x["secret"]), lambda x: x["span"])


def joined(spans_col: Column) -> Column:
    ordered = F.array_sort(spans_col)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: list[str] | None = None) -> DataFrame:
    """Per row: id, ``base`` and ``all_spans`` (arrays of start, rank, kind, end in code points, end exclusive).

    Null and empty texts have no spans.  Rows stay rows.  Columns other than id and text are not read.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    base = F.concat(*[spans(text, pattern if kind != "hex" else r"[0-9a-f]{24,}", k, kind, group, least) for k, (kind, pattern, group, least) in enumerate(BASE)])
    rows = rows.withColumn("base", base)
    # A projection for each pattern: nested into one another, they would be copied into one expression of thousands of nodes.
    rows = rows.withColumn("_left", F.when(F.regexp_like(text, F.lit(CANDIDATE)), text))
    for kind, pattern, group, least in BASE:
        rows = rows.withColumn("_left", blanked(F.col("_left"), pattern if kind != "hex" else r"[0-9a-f]{24,}", group, least))
    for pattern in ALLOWED if allowed is None else allowed:
        rows = rows.withColumn("_left", blanked(F.col("_left"), pattern))
    extra = F.when(F.regexp_like("_left", F.lit(CANDIDATE)), entropy_spans(F.col("_left")))
    return rows.select(F.col("_id").alias(id_col), "base", F.concat("base", F.coalesce(extra, F.array().cast(SPAN))).alias("all_spans"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scanned.select(id_col, *[count(kind) for kind, *_ in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span replaced by ``mask``; all rows and columns stay, null texts stay null.
    Overlapping spans are masked as one.  A column ``n_chars`` is brought up to date."""
    scanned = scan_secrets(docs.withColumn("_row", F.struct(*[F.col(c) for c in docs.columns])), "_row", text_col)
    text = F.col("_row").getField(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(state, s):
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["done"], gap, F.lit(mask))).otherwise(state["done"]).alias("done"))

    masked = F.aggregate(F.array_sort("all_spans"), start, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.char_length(text))))
    fixed = F.when(F.size("all_spans") > 0, masked).otherwise(text)
    out = scanned.select("_row", fixed.alias("_fixed"))
    columns = []
    for c in docs.columns:
        value = F.col("_row").getField(c)
        if c == text_col:
            value = F.col("_fixed")
        elif c == "n_chars":
            value = F.when(F.col("_fixed").eqNullSafe(text), value).otherwise(F.char_length("_fixed").cast(docs.schema[c].dataType))
        columns.append(value.alias(c))
    return out.select(*columns)
