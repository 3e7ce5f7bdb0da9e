import hashlib
import random

import pytest

from tidemark.llm import chat

LOG = "conv_id bigint, turn bigint, seq bigint, event string, role string, text string, rendered string"


@pytest.mark.parametrize("text", ["", "plain", r"\### x: </turn> ok", "\\\\", "<turn><turn>", "### ### :", "\n", r"\\<turn>\### ", "é😀"])
@pytest.mark.parametrize("role", ["user", "assistant", "", "a: b", "</turn>\n### x"])
def test_rendered_messages_read_back(role, text):
    rendered, begin, end = chat.render(role, text)
    assert chat.read_back(rendered) == (role, text)
    assert rendered.count("</turn>\n") >= 1 and "</turn>" not in rendered[: -len("</turn>\n")].replace("\\</turn>", "")
    if role == "assistant":
        assert chat.unescape(rendered[begin:end]) == text
    else:
        assert begin is end is None


def test_random_texts_read_back():
    rng = random.Random(4)
    parts = ["\\", "<turn>", "</turn>", "### ", "#", ":", " ", "a", "\n"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert chat.read_back(chat.render("user", text)[0]) == ("user", text)


def test_events_fold_into_messages(spark):
    rows = [
        (1, 0, 0, "message", "user", "hel"), (1, 0, 1, "delta", None, "lo"),
        (1, 1, 0, "delta", "assistant", "fir"), (1, 1, 1, "delta", None, "st"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "second"),
        (1, 2, 0, "message", "user", "typo"), (1, 2, 5, "edit", None, "fixed"),
        (2, None, 0, None, None, None), (None, 0, 0, "message", "user", "lost"),
        (3, 0, 0, "message", "user", "same"), (3, 0, 0, "message", "user", "same"),
    ]
    random.Random(0).shuffle(rows)
    log = spark.createDataFrame([(*r, "clash") for r in rows], LOG)
    found = sorted(((r["conv_id"], r["turn"], r["part"]), chat.read_back(r["rendered"])) for r in chat.formatted(log.filter("conv_id IS NOT NULL AND turn IS NOT NULL")).collect())
    assert found == [
        ((1, 0, 0), ("user", "hello")), ((1, 1, 0), ("assistant", "second")), ((1, 2, 0), ("user", "fixed")),
        ((3, 0, 0), ("user", "same")), ((3, 0, 1), ("user", "same")),
    ]
    digests = {r["conv_id"]: r for r in chat.digests(chat.formatted(log)).collect()}
    assert digests[1]["turns_sha256"] == hashlib.sha256(b"user\nhello\nassistant\nsecond\nuser\nfixed\n").hexdigest()
    assert digests[1]["loss_sha256"] == hashlib.sha256(b"second").hexdigest() and digests[1]["loss_chars"] == 6
    assert digests[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert digests[None]["n_turns"] == 1 and digests[3]["n_turns"] == 2


def test_one_conversation_with_most_rows_and_long_texts(spark):
    rows = [(7, k, 0, "message", "assistant" if k % 2 else "user", "x" * (k % 50), "") for k in range(3000)] + [(8, 0, 0, "message", "user", "y" * 2_000_000, "")]
    digests = {r["conv_id"]: r for r in chat.digests(chat.formatted(spark.createDataFrame(rows, LOG).repartition(8))).collect()}
    assert digests[7]["n_turns"] == 3000
    assert digests[7]["loss_chars"] == sum(k % 50 for k in range(1, 3000, 2))
    assert digests[8]["formatted_chars"] > 2_000_000


def test_empty_log(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], LOG))).count() == 0


def test_events_of_one_sequence_number_have_one_order(spark):
    rows = [(1, 0, 0, e, "user", t, "") for e, t in (("delta", "c"), ("message", "a"), ("edit", "b"), ("message", None))]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        found = [chat.read_back(r["rendered"]) for r in sorted(chat.formatted(spark.createDataFrame(rows, LOG)).collect(), key=lambda r: r["part"])]
        assert found == [("user", ""), ("user", "bc")]


def test_a_table_becomes_a_log_of_all_events_that_folds_back(spark):
    rng = random.Random(9)
    rows = [(k // 6, k % 6, rng.choice(["user", "assistant", None]), rng.choice([None, "", "é😀", "x" * 41, "word " * rng.randint(1, 400)])) for k in range(300)]
    rows += [(7, 1, "user", "again"), (7, 1, "user", "again"), (7, 1, "assistant", "other " * 30), (None, None, None, None), (8, 0, "user", "long " * 200_000)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, event string")
    log = chat.as_log(table)
    counts = {r["event"]: r["count"] for r in log.groupBy("event").count().collect()}
    assert set(counts) == set(chat.EVENTS) and counts["message"] == len(rows)
    assert log.groupBy("conv_id", "turn", "seq").count().filter("count > 1").count() == 0
    messages = [(r["conv_id"], r["turn"], *chat.read_back(r["rendered"])) for r in chat.formatted(log).collect()]
    assert sorted(messages, key=repr) == sorted([(c, t, role or "", text or "") for c, t, role, text in rows], key=repr)
    assert chat.as_log(table.limit(0)).count() == 0
