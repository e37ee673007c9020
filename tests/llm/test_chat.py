"""Prefix-target expansion: whole contexts, masks, escapes and slices against a plain version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, position string, segment int, start long"
BITS = ["<turn", "</turn>", "\\", "\\\\", "\n", "</turn>\n", "<turn user>\n", " ok ", "é", "x", "", ">", "%3E"]


def key(row):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


def conversations(rows):
    """conv -> ordered (role, text)."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (key(r[1:2]), key(r[2:3]), key(r[3:4]))):
        out.setdefault(conv, []).append((role, text or ""))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3, 4) for r in rows], SCHEMA)


def some_rows(seed=0, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "", "to>ol\n%", "Assistant"])
            text = rng.choice([None, "".join(rng.choices(BITS, k=rng.randint(0, 9)))])
            rows.append((conv, rng.choice([t, t, 0, None]), role, text))
    rows += rows[:7]                                   # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("slice_turns", [chat.SLICE, 2])
def test_examples_hold_all_turns_before_and_mask_the_reply(spark, slice_turns):
    rows = some_rows()
    turns, in_order = chat.expand(frame(spark, rows), slice_turns=slice_turns)
    assert not in_order                                 # null turns lie in a slice of their own
    got = {}
    for r in chat.texts(turns, in_order).collect():
        got.setdefault(r["conv_id"], []).append(
            (r["example"], chat.read(r["text"]), chat.unescaped(r["text"][r["loss_start"]:r["loss_stop"]])))
    want = {}
    for conv, said in conversations(rows).items():
        ends = [k for k, (role, _) in enumerate(said) if role == "assistant" or k == len(said) - 1]
        want[conv] = [(n, said[:k + 1], said[k][1] if said[k][0] == "assistant" else "")
                      for n, k in enumerate(ends)]
    assert {c: sorted(v, key=lambda e: e[0]) for c, v in got.items()} == want


@pytest.mark.parametrize("slice_turns", [chat.SLICE, 3])
def test_digests(spark, slice_turns):
    rows = [r for r in some_rows(1) if r[1] is not None] + [(500, t, "user", f"t{t}") for t in range(40)]
    got = {r["conv_id"]: r for r in chat.digests(*chat.expand(frame(spark, rows), slice_turns=slice_turns)).collect()}
    said = conversations(rows)
    assert set(got) == set(said)
    for conv, turns in said.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(
            f"{role or ''}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_template_is_reversible_on_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escaped(df["t"]).alias("e")).collect():
        assert chat.unescaped(r["e"]) == r["t"]
        assert chat.read(f"<turn user>\n{r['e']}\n</turn>\n") == [("user", r["t"])]
    with pytest.raises(ValueError):
        chat.read("<turn user>\nnever closed")


def test_long_text_and_long_conversation(spark):
    rows = [(1, 0, "user", "\\" * 300_000 + "</turn>"), (1, 1, "assistant", "a" * 500_000)]
    rows += [(2, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(3000)]
    got = {r["conv_id"]: r for r in chat.digests(*chat.expand(frame(spark, rows))).collect()}
    assert (got[1]["loss_chars"], got[1]["n_examples"]) == (500_000, 1)
    assert (got[2]["n_turns"], got[2]["n_examples"]) == (3000, 1500)


def test_stored_text_grows_with_the_turns(spark):
    turns, _ = chat.expand(frame(spark, [(1, t, "assistant", "x" * 50) for t in range(400)]))
    assert sum(len(r["segment"]) for r in turns.collect()) < 400 * 100


def test_empty_table(spark):
    assert chat.digests(*chat.expand(frame(spark, []))).collect() == []
    assert chat.texts(*chat.expand(frame(spark, []))).collect() == []


def test_digests_read_the_written_examples(spark, monkeypatch):
    seen, expanded = [], chat.texts

    def texts(turns, in_order):
        out = expanded(turns, in_order)
        seen.append([(r["text"], r["example"]) for r in out.collect()])
        return out.withColumn("text", F.regexp_replace("text", "said", "read"))
    monkeypatch.setattr(chat, "texts", texts)
    rows = [(1, t, "assistant" if t % 2 else "user", f"said {t}") for t in range(4)]
    got = chat.digests(*chat.expand(frame(spark, rows))).collect()[0]
    assert [n for _, n in seen[0]] == [0, 1] and seen[0][1][0].startswith(seen[0][0][0])
    assert got["formatted_chars"] == sum(len(t) for t, _ in seen[0])
    assert got["loss_sha256"] == hashlib.sha256(b"read 1read 3").hexdigest()
    assert got["turns_sha256"] == hashlib.sha256("".join(
        f"{r}\nread {t}\n" for t, r in enumerate(["user", "assistant"] * 2)).encode()).hexdigest()
