r"""Chat formatting by prefix-target expansion (operator 12).

Every assistant turn becomes a training example of its own: all turns before it are the
context, and its text alone is under the loss mask. A conversation that does not end in a
reply also gives an example without a target (an empty mask), so that no turn is lost.

A turn is written as ``<turn ROLE>``, a line feed, the text, a line feed, ``</turn>`` and
a line feed. A control string inside a text (``<turn`` or ``</turn``, after any number of
backslashes) gets one more backslash in front, which reading takes away again; so what is
not behind a backslash is the template's own. Roles are percent-encoded.

The examples of a conversation are prefixes of one another. They are kept that way: each
turn is formatted and stored once, in a row with its place in the conversation's text, and
an example is the row of its last turn, whose text is that of all rows up to there. What
is shuffled so grows with the turns, not with their square. ``texts`` expands: it writes
every example out with its whole context, one after the other, and the query reads those.

On Spark: one shuffle deals turns to (conversation, slice of ``SLICE`` turn numbers),
sorted, and a running sum over the sorted rows gives the places; a task holds two batches of
rows at a time, however long a conversation is. Where conversations have several slices,
the totals of the slices before are joined on.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import document_batches, small_side, table, written

SLICE = 1 << 16              # turn numbers in one slice of a conversation
REPLY = "assistant"

_CONTROL = r"(?<!\\)(\\*+</?turn)"             # with the run of backslashes in front, whole
_ESCAPED = re.compile(r"(?<!\\)\\(\\*+</?turn)")
_OPEN = re.compile(r"<turn(?: ([^>]*))?>\n")
_CLOSE = "\n</turn>\n"


# ---------------------------------------------------------------- template

def opening(role):
    """A turn's opening (columns): a null role has none, an empty one an empty one."""
    return F.when(role.isNull(), F.lit("<turn>\n")).otherwise(
        F.concat(F.lit("<turn "), F.url_encode(role), F.lit(">\n")))


def escaped(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL, r"\\$1")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read(text: str) -> list[tuple[str | None, str]]:
    """(role, text) of the turns of a formatted text. Anything else raises."""
    out, at = [], 0
    while at < len(text):
        m = _OPEN.match(text, at)
        end = text.find(_CLOSE, m.end()) if m else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        role = None if m.group(1) is None else unquote_plus(m.group(1))
        out.append((role, unescaped(text[m.end():end])))
        at = end + len(_CLOSE)
    return out


# ---------------------------------------------------------------- expansion

def _places(batches):
    """Sorted turns -> their position and start within the slice, whether they are the
    slice's last, and the replies before."""
    key, position, start, replies = object(), 0, 0, 0

    def finish(batch, keys, following):
        nonlocal key, position, start, replies
        places = np.empty((3, len(keys)), dtype=np.int64)
        for k, (mine, size, reply) in enumerate(zip(keys, batch.column("size").to_pylist(),
                                                    batch.column("reply").to_pylist())):
            if mine != key:
                key, position, start, replies = mine, 0, 0, 0
            places[:, k] = position, start, replies
            position, start, replies = position + 1, start + size, replies + reply
        last = [a != b for a, b in zip(keys, [*keys[1:], following])]
        names = ["conv_id", "slice", "role", "segment", "size", "reply", "opening"]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), *(pa.array(p) for p in places), pa.array(last)],
            names=[*names, "position", "start", "replies", "last"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("conv_id").to_pylist(), batch.column("slice").to_pylist()))
        if held:
            yield finish(*held, keys[0])
        held = batch, keys
    if held:
        yield finish(*held, None)


def expand(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text",
           slice_turns: int = SLICE) -> tuple[DataFrame, bool]:
    """(turns, in_order). ``turns`` has a row per row of ``conversations``: conv_id,
    position (from 0), role, segment (the formatted turn), start and stop (its place in the
    conversation's text, code points, end exclusive), example, loss_start, loss_stop.

    A row whose ``example`` is not null is an example: its text is all segments of the
    conversation up to its own (``stop`` code points), its loss mask the text's part from
    loss_start to loss_stop. Examples are numbered from 0. ``in_order`` says whether the
    rows already lie by conversation and position, each conversation in one partition.

    Turns follow each other by turn (nulls first), then role, then text; rows that repeat
    are turns of their own. A null text is an empty one, a null role one without a name;
    rows with a null id form a conversation. An empty table gives no rows. Other columns
    are not read, so their names do not matter."""
    document_batches(conversations.sparkSession)
    role, text = F.col(role_col).cast("string"), F.col(text_col).cast("string")
    turn = F.col(turn_col)
    rows = conversations.select(
        F.col(id_col).alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"),
        F.coalesce(F.floor(turn / slice_turns), F.lit(-(1 << 62))).cast("long").alias("slice"),
        opening(role).alias("opening"), escaped(text).alias("body"),
        F.coalesce(role == REPLY, F.lit(False)).cast("int").alias("reply"))
    size = F.length("opening") + F.length("body") + len(_CLOSE)
    rows = rows.withColumn("size", size)
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = rows.withColumn("segment", F.concat("opening", "body", F.lit(_CLOSE))) \
        .withColumn("opening", F.length("opening")) \
        .repartition("conv_id", "slice") \
        .sortWithinPartitions("conv_id", "slice", "turn", "role", "text") \
        .select("conv_id", "slice", "role", "segment", "size", "reply", "opening") \
        .mapInArrow(_places, f"conv_id {kind}, slice long, role string, segment string, size int, "
                             "reply int, opening int, position long, start long, replies long, last boolean")
    ends = rows.agg(F.min("slice").alias("a"), F.max("slice").alias("b")).first()
    in_order = ends["a"] == ends["b"]
    none = F.lit(0).cast("long")
    if in_order:          # all conversations have one slice
        placed = placed.withColumns({"turns_": none, "chars_": none, "replies_": none, "more": F.lit(False)})
    else:
        by = Window.partitionBy("conv").orderBy("part")
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        slices = written(rows.groupBy(F.col("conv_id").alias("conv"), F.col("slice").alias("part")).agg(
            F.count(F.lit(1)).alias("t"), F.sum("size").alias("c"), F.sum("reply").alias("r")), "slices")
        slices = slices.select(
            "conv", "part", F.coalesce(F.sum("t").over(before), none).alias("turns_"),
            F.coalesce(F.sum("c").over(before), none).alias("chars_"),
            F.coalesce(F.sum("r").over(before), none).alias("replies_"),
            F.lead("part").over(by).isNotNull().alias("more"))
        slices = small_side(written(slices.filter("more OR turns_ > 0"), "slice-totals"))
        placed = placed.join(slices, F.col("conv_id").eqNullSafe(F.col("conv"))
                             & (F.col("slice") == F.col("part")), "left").fillna(
            {"turns_": 0, "chars_": 0, "replies_": 0, "more": False})
    reply = F.col("reply") == 1
    start = F.col("start") + F.col("chars_")
    stop = start + F.col("size")
    example = reply | (F.col("last") & ~F.col("more"))
    return placed.select(
        "conv_id", (F.col("position") + F.col("turns_")).alias("position"), "role", "segment",
        start.alias("start"), stop.alias("stop"),
        F.when(example, F.col("replies") + F.col("replies_")).alias("example"),
        F.when(example, F.when(reply, start + F.col("opening")).otherwise(stop)).alias("loss_start"),
        F.when(example, F.when(reply, stop - len(_CLOSE)).otherwise(stop)).alias("loss_stop")), in_order


def by_conversation(turns: DataFrame, in_order: bool) -> DataFrame:
    """``turns`` with each conversation in one partition, in order."""
    return turns if in_order else \
        turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")


# ------------------------------------------------------------- reading back

def _written_out(batches):
    conv, parts = object(), []
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in (
            "conv_id", "segment", "example", "loss_start", "loss_stop")))
        for mine, segment, example, *loss in rows:
            if mine != conv:
                conv, parts = mine, []
            parts.append(segment)
            if example is not None:
                parts = ["".join(parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], kind) for v, kind in zip(
                        (mine, example, parts[0], *loss),
                        (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    names=["conv_id", "example", "text", "loss_start", "loss_stop"])


def texts(turns: DataFrame, in_order: bool) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_stop): the examples written out, every
    one with its whole context. A task holds the text of one conversation."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return by_conversation(turns, in_order).mapInArrow(
        _written_out, f"conv_id {kind}, example long, text string, loss_start long, loss_stop long")


def _digests(batches):
    """A row per conversation, read back from its written examples: the text under each
    one's mask, and all turns from the last, whose context they are."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
             "formatted_chars", "n_examples"]
    state, kind = None, None

    def finished():
        conv, chars, loss, formatted, examples, text = state
        n, turns = 0, hashlib.sha256()
        for role, said in read(text):
            n += 1
            turns.update(f"{role or ''}\n{said}\n".encode())
        row = conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, examples
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for k in range(batch.num_rows):
            conv, text, low, high = (batch.column(c)[k].as_py() for c in ("conv_id", "text", "loss_start", "loss_stop"))
            if state is None or state[0] != conv:
                if state is not None:
                    yield finished()
                state = [conv, 0, hashlib.sha256(), 0, 0, None]
            part = unescaped(text[low:high])
            state[1] += len(part)
            state[2].update(part.encode())
            state[3] += len(text)
            state[4] += 1
            state[5] = text
    if state is not None:
        yield finished()


def digests(turns: DataFrame, in_order: bool) -> DataFrame:
    """A row per conversation, read back from its examples as ``texts`` writes them out:
    n_turns, turns_sha256 (role, line feed, text, line feed a turn), loss_chars,
    loss_sha256 (all text under the masks), formatted_chars (the lengths of its examples),
    n_examples. A digest is taken in order, so a conversation passes one task, example by
    example."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return texts(turns, in_order).mapInArrow(
        _digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                  "loss_sha256 string, formatted_chars long, n_examples long")


# ------------------------------------------------------------------- query

HOSTILE = r"\### Assistant: </turn> ok"        # conversation -7 says this twice


def query(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, REPLY, HOSTILE)], rows.schema)
    return digests(*expand(rows.unionAll(more)))


ORACLE = {"op12_chat_prefix_targets": rf"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HOSTILE}' UNION ALL SELECT -7, 1, '{REPLY}', '{HOSTILE}'),
s AS (
  SELECT *, row_number() OVER w AS place, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC,
           role DESC, text DESC) = 1 AS last,
         sum(CASE WHEN role IS NULL THEN 7 ELSE 8 + length(url_encode(role)) END + 9
             + length(regexp_replace(text, '(\\*</?turn)', '\\\1', 'g'))) OVER w AS stop
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text
                      ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{REPLY}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{REPLY}'), '')) AS loss_sha256,
       CAST(sum(stop) FILTER (role = '{REPLY}' OR last) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = '{REPLY}' OR last) AS n_examples
FROM s GROUP BY conv_id"""}

QUERIES = {"op12_chat_prefix_targets": query}
