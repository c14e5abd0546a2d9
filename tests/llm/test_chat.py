import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import chat
from tidemill.llm.queries import OP12_SQL, op12_chat_formatting

NASTY = ["", None, "\\", "</turn>", "\n</turn>\n", "\\</turn>", "<turn user>\nhi\n</turn>\n", "\\\\<turn", "a\r\n\u2028é👍", "x" * 200_000 + "\\", "</turn>\\n", "### Assistant:"]


def replayed(log):
    """The log's messages, event by event."""
    convs = {}
    for conv, message, seq, kind, role, text in sorted(log, key=lambda e: (str(e[0]), e[2], e[3], e[5] or "")):
        m = convs.setdefault(conv, {})
        if kind == "regenerate":
            for later in [k for k in m if k > message]:
                del m[later]
        old = m.get(message, ("", ""))
        m[message] = (role if role is not None else old[0], (old[1] if kind == "delta" else "") + (text or ""))
    return sorted((str(c), k, *v) for c, m in convs.items() for k, v in m.items())


def frame(spark, log):
    return spark.createDataFrame([(*e, 1, 2) for e in log], "conv_id long, message long, seq long, kind string, role string, text string, conv int, range int")


def folded(spark, log):
    return sorted((str(r.conv_id), r.message, r.role, r.text) for r in chat.fold(frame(spark, log)).collect())


def test_fold(spark):
    log = [
        (1, 0, 0, "start", "user", "he"), (1, 0, 1, "delta", None, "llo"), (1, 1, 2, "start", "assistant", None), (1, 1, 3, "delta", None, "bad"), (1, 2, 4, "start", "user", "why?"),
        (1, 1, 5, "regenerate", None, ""), (1, 1, 6, "delta", None, "good"), (1, 2, 7, "start", "user", "thanks"), (1, 0, 8, "edit", None, "hello!"),
        (2, 3, 0, "delta", None, "no start"), (2, 3, 1, "delta", None, " at all"), (None, 0, 0, "start", "system", "s"), (None, 1, 1, "start", "user", "gone"), (None, 0, 2, "regenerate", None, "t"),
    ]
    assert folded(spark, log) == replayed(log)
    assert folded(spark, [*log, (3, 0, 0, "other", "user", "x"), (3, 0, 0, None, "user", "x")]) == replayed(log)
    assert folded(spark, []) == []
    tie = [(1, 0, 0, "start", "user", "a"), (1, 0, 1, "delta", None, "c"), (1, 0, 1, "delta", None, "b"), (1, 0, 1, "delta", None, "b")]
    assert folded(spark, tie) == [("1", 0, "user", "abbc")]


def test_random_logs_and_one_long_conversation(spark):
    import random

    rng = random.Random(2)
    log = []
    for conv, length in [(k, rng.randrange(1, 25)) for k in range(60)] + [(99, 3000)]:
        top = 0
        for seq in range(length):
            kind = rng.choice(["start", "delta", "delta", "edit"] if rng.random() > 0.08 else ["regenerate"])
            message = rng.randrange(max(1, top - 3), top + 2) if kind != "regenerate" else rng.randrange(max(0, top - 6), top + 1)
            top = max(top, message)
            log.append((conv, message, seq, kind, rng.choice([None, "user", "assistant"]), f"{seq}." if rng.random() > 0.1 else None))
    rng.shuffle(log)
    assert folded(spark, log) == replayed(log)


def turns(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, message int")


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = {c: "".join(t for r, t in m if r == "assistant") for c, m in out.items()}
    return sorted((str(c), len(m), sha("".join(f"{r}\n{t}\n" for r, t in m)), len(loss[c]), sha(loss[c])) for c, m in out.items())


def test_round_trip(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(NASTY)] + [(2, k, ("assistant", "user")[k % 2], t) for k, t in enumerate(NASTY)]
    rows += [(3, 0, "odd\nrole> \\ <turn", "x"), (3, 1, None, "y"), (4, 0, "assistant", "b"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (None, 0, "user", "n"), (None, None, "assistant", "m"), (5, 0, "system", "only")]
    got = chat.digest(chat.format_conversations(turns(spark, rows)))
    assert sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()) == expected(rows)
    assert chat.digest(chat.format_conversations(turns(spark, []))).collect() == []


def test_whole_conversations_read_back(spark):
    rows = [(k, ("user", "assistant")[k % 2], t or "") for k, t in enumerate(NASTY)]
    rendered = chat.render(spark.createDataFrame([(1, *r) for r in rows], "conv_id long, message long, role string, text string")).collect()
    text = "".join(r.formatted for r in sorted(rendered, key=lambda r: r.message))
    back = spark.createDataFrame([(text,)], "formatted string").select(chat.read_back("formatted").alias("turns")).first().turns
    assert [(t.role, t.text) for t in back] == [r[1:] for r in rows]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\</turn>\n a", max_size=30))
def test_escaped_texts_hold_no_mark(text):
    import re

    escaped = re.sub(chat.CONTROL, r"\\\1", text)
    assert chat.CLOSE not in escaped + chat.CLOSE[:-1] and re.sub(chat.ESCAPED, r"\1", escaped) == text


def test_op12_equals_sql(spark, tmp_path):
    con = duckdb.connect()
    for name in ("sf0.001", "sf0.01", "made"):
        d = f"/root/testdata/{name}"
        if name == "made":
            d = str(tmp_path)
            turns(spark, [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(NASTY)] + [(4, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "a"), (6, None, None, None)]).drop("message").coalesce(1).write.parquet(f"{d}/conversations.parquet")
        con.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{d}/conversations.parquet{'/*.parquet' if name == 'made' else ''}')")
        got = op12_chat_formatting(spark, d)
        want = con.sql(OP12_SQL)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
