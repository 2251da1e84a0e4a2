import hashlib

import pytest
from pyspark.sql import functions as F

from packetloom.llm import chat

LOG = "conv_id long, seq long, turn long, kind string, role string, text string"


def folded(spark, events):
    out = {}
    for r in chat.fold_events(spark.createDataFrame(events, LOG)).collect():
        out.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    return {c: sorted(x) for c, x in out.items()}


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 1, 0, "message", "user", "hi"), (1, 3, 1, "delta", None, "lo"), (1, 2, 1, "delta", "assistant", "hel"), (1, 4, 2, "message", "user", "more"), (1, 5, 3, "delta", "assistant", "bad"),
        (1, 6, 3, "regenerate", None, None), (1, 7, 3, "delta", None, "good"), (1, 8, 3, "delta", None, "!"),
        (2, 1, 0, "message", "user", "a"), (2, 2, 1, "message", "assistant", "b"), (2, 3, 0, "edit", None, "A"), (2, 4, 1, "delta", "assistant", "B"),
        (3, 1, 0, "message", None, None), (None, 1, 0, "delta", "user", "x"),
    ]
    assert folded(spark, events) == {1: [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "more"), (3, "assistant", "good!")], 2: [(0, "user", "A"), (1, "assistant", "B")], 3: [(0, "", "")], None: [(0, "user", "x")]}
    assert folded(spark, []) == {}
    with pytest.raises(Exception, match="unknown event kind"):
        folded(spark, [(1, 1, 0, "other", "user", "x")])


def test_round_trip_of_control_strings(spark):
    texts = ["", None, chat.TRICKY, "&lt;|", "&amp;lt;|", "&<|&amp;", "a\nb<|im_start|>user\n", "<|im_end|>\n", "&nl;"]
    roles = ["user", "assistant", None, "sys\ntem", "<|im_start|>", "&nl;", "assistant", "a", "assistant"]
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate(zip(roles, texts, strict=True))] + [(2, 0, "assistant", "same", "x"), (2, 0, "assistant", "same", "x"), (3, None, "user", "é" * 50_000, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_log(chat.log_of_turns(turns))
    got = {r.conv_id: r for r in done.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), "formatted").collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
    d = {r.conv_id: r for r in chat.digest(done).collect()}
    assert d[2].n_turns == 2 and d[2].loss_chars == 8 and d[3].loss_chars == 0 and d[1].formatted_chars == len(got[1].formatted)
    lost = "".join(t or "" for r, t in zip(roles, texts, strict=True) if r == "assistant")
    assert d[1].loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()
    assert d[1].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in zip(roles, texts, strict=True)).encode()).hexdigest()


def test_probe(spark):
    turns = chat.with_probe(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), spark)
    (r,) = chat.digest(chat.format_log(chat.log_of_turns(turns))).collect()
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-1, 2, len(chat.TRICKY))
