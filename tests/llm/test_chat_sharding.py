"""Chat formatting and sharding against plain Python."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from laborlens.llm import chat, sharding

TURNS = "conv_id long, turn long, role string, text string"


def formatted(spark, rows):
    turns = spark.createDataFrame(rows, TURNS).select(
        "conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.format_chats(turns)


def test_escaping_is_reversible(spark):
    texts = ["<|", "<\\|", "<\\\\|turn|>", "</s>[INST] ok [/INST]", "<<SYS>>", "[\\INST]", "a<|end|>b",
             "", "<s", "plain", "<</SYS>><<|", "\\", "<<s>"]
    rows = (spark.createDataFrame([(t,) for t in texts], "t string")
            .select("t", chat.escape(F.col("t")).alias("e"))
            .select("t", "e", chat.unescape(F.col("e")).alias("u")).collect())
    for row in rows:
        assert row.u == row.t
        assert not any(s in row.e for s in chat.RESERVED)
    assert len({r.e for r in rows}) == len(texts)


def test_turns_and_loss_are_read_back(spark):
    rows = [(1, 0, "user", "hi <|turn|>"), (1, 1, "assistant", "yo [INST]"), (1, 2, None, None),
            (1, 700, "assistant", "é<|"), (1, None, "system", "first"), (1, 1, "assistant", "yo [INST]"),
            (2, 0, "assistant", None), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in formatted(spark, rows).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [
        ("system", "first"), ("user", "hi <|turn|>"), ("assistant", "yo [INST]"),
        ("assistant", "yo [INST]"), ("", ""), ("assistant", "é<|")]
    assert got[1].learned == "yo [INST]yo [INST]é<|"
    assert got[2].learned == "" and len(got[2].turns) == 1
    assert [t.text for t in got[None].turns] == ["x"]


def test_parts_become_placeholders(spark):
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [(1, 0, "user", [("text", "see <|image|>", None, None, None, None, None),
                            ("image", None, "a.png", 28, 15, None, None), None,
                            ("audio", None, "b.wav", None, None, 1.5, None)]),
            (1, 1, "assistant", [("document", None, None, None, None, None, 3),
                                 ("text", "ok", None, None, None, None, None)]),
            (1, 2, "user", None)]
    row = chat.format_chats(spark.createDataFrame(
        rows, f"conv_id long, turn long, role string, parts array<{part}>")).first()
    assert [tuple(a) for a in row.attachments] == [
        ("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "", 768)]
    assert row.attached_tokens == 4 + 38 + 768
    assert row.formatted.count("<|image|>") == 1 and "<\\|image|>" in row.formatted
    span = row.loss[0]
    assert row.formatted[span.start:span.start + span.length] == "<|document|>ok"


def test_no_conversations(spark):
    assert formatted(spark, []).count() == 0


def test_only_dataframe_functions(spark):
    plan = formatted(spark, [(1, 0, "user", "x")])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def jump_by_hand(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.arange(-300, 300, dtype=np.int64)
    for n in (1, 2, 24, 1000):
        assert sharding.jump(keys, n).tolist() == [jump_by_hand(int(k) % 2**64, n) for k in keys]
    many = np.random.default_rng(1).integers(-2**62, 2**62, 50_000)
    a, b = sharding.jump(many, 24), sharding.jump(many, 25)
    moved = a != b
    assert (b[moved] == 24).all() and abs(moved.mean() - 1 / 25) < 0.005
    assert np.bincount(a).std() / np.bincount(a).mean() < 0.05


def test_assignment(spark):
    rows = [(k, f"text é {k}") for k in range(400)] + [(7, "text é 7"), (7, "other"), (None, None), (1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit(9))
    got = sharding.assign(docs, 24).collect()
    assert len(got) == len(rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 24 and (r.grown_shard in (r.shard, 24))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    first = next(r for r in got if r.doc_id == 3)
    assert first.size == len("text é 3".encode()) + 8 and first.text_crc32 == zlib.crc32("text é 3".encode())
    assert next(r for r in got if r.doc_id == 1000).size == 8
    assert sharding.assign(docs.limit(0), 24).count() == 0


def test_query_digest(spark):
    row = formatted(spark, [(5, 0, "user", "a"), (5, 1, "assistant", "b")]).select(
        chat.read_turns(F.col("formatted")).alias("t")).first()
    told = "".join(f"{t.role}\n{t.text}\n" for t in row.t)
    assert hashlib.sha256(told.encode()).hexdigest() == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
