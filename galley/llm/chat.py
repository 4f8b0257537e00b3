"""Chat formatting from event logs: messages are folded from streamed deltas, edits and regenerations, then rendered with a loss mask.

A log has one row per event: conv_id, turn (the message's place), message_id, seq, kind, role, text. Logs are dealt out by ranges of
(conv_id, turn, message_id) and sorted by seq, so a task folds its messages one after another and holds one draft at a time; a long
conversation is spread over many tasks. Kinds: `open` names the role, `delta` appends text, `edit` puts its text in place of the draft,
`regenerate` drops the draft, `delete` drops the message for good; any other kind, null included, changes nothing.

The output is `pieces`: whole rendered turns of one conversation, at most PIECE_CHARS characters unless a single turn is longer. The pieces
of a conversation, put together in the order of `at`, are its formatted text; `mask` holds the spans (code points in the piece, end
exclusive) of what assistants said. A turn reads `### role:\\n`, the text, `</turn>\\n`. In texts a backslash comes before every backslash,
before a # that two more # follow, and before the < of `</turn>`; in roles before every colon too.

Edge cases: a null text or role is empty; null conv_id is a conversation of its own; messages of equal turns (null first) come by
message_id; an event delivered twice (same seq, kind and text) counts once, other events of equal seq come by kind, then text; a message without `open` has an empty role;
columns besides those named are ignored; an empty log gives no pieces. A message's events meet in one task, which holds only its draft.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import bounded_batches

#: A piece ends after the turn that fills it.
PIECE_CHARS = 1 << 20
MESSAGE = ["conv_id", "turn", "message_id"]
TRAINED_ROLE = "assistant"

ESCAPED = re.compile(r"\\|#(?=##)|<(?=/turn>)")
ESCAPED_ROLE = re.compile(r"\\|:|#(?=##)|<(?=/turn>)")
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn and where its text stands in it."""
    head = f"### {ESCAPED_ROLE.sub(_with_backslash, role)}:\n"
    body = ESCAPED.sub(_with_backslash, text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def _with_backslash(m: re.Match) -> str:
    return "\\" + m[0]


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted text; anything that isn't a turn raises."""
    found, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        found.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return found


def event_log(rows: DataFrame) -> DataFrame:
    """The log of a chat that ends in the given rows (conv_id, turn, role, text): each message opens, streams a draft, is regenerated
    (assistants) or edited (others), and gets the rest of its text as deltas. Rows of equal turns come by role, then SHA-256 of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    uid = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")  # tells repeated rows apart, which are interchangeable
    named = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.concat_ws(":", role, F.sha2(text.cast("binary"), 256), uid).alias("message_id"))
    half = F.expr("length(text) div 2")
    first, rest = F.expr("left(text, cast(length(text) div 2 AS int))"), F.substring(F.col("text"), half.cast("int") + 1, F.length("text"))
    draft = F.reverse(F.substring("text", 1, 40))
    event = lambda seq, kind, role, text: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    begun = [event(0, "open", F.col("role"), none), event(1, "delta", none, draft)]
    again = [event(2, "regenerate", none, none), event(3, "delta", none, first), event(4, "delta", none, rest)]
    edited = [event(2, "edit", none, first), event(3, "delta", none, rest)]
    events = F.when(F.col("role") == TRAINED_ROLE, F.array(*begun, *again)).otherwise(F.array(*begun, *edited))
    return named.select(*MESSAGE, F.explode(events).alias("e")).select(*MESSAGE, "e.*")


def _messages(batches):
    """(conv_id, turn, message_id, role, text) of each message of sorted events that isn't deleted."""
    key, last, role, draft, gone = None, None, "", [], False
    for batch in batches:
        for *at, seq, kind, named, text in zip(*(batch.column(c).to_pylist() for c in [*MESSAGE, "seq", "kind", "role", "text"]), strict=True):
            if at != key:
                if key is not None and not gone:
                    yield *key, role, "".join(draft)
                key, last, role, draft, gone = at, None, "", [], False
            if (seq, kind, text) == last:
                continue
            last = (seq, kind, text)
            if kind == "open":
                role = named or ""
            elif kind == "delta":
                draft.append(text or "")
            elif kind == "edit":
                draft = [text or ""]
            elif kind == "regenerate":
                draft = []
            elif kind == "delete":
                gone = True
    if key is not None and not gone:
        yield *key, role, "".join(draft)


def _pieces(batches):
    """(conv_id, at, n_turns, formatted, mask, whole): runs of turns of one conversation, cut at PIECE_CHARS."""
    conv, at, turns, mask, size, starts = None, None, [], [], 0, False  # the first run of a task may have begun in the task before

    def piece(whole):
        return conv, at, len(turns), "".join(turns), mask, whole

    for conv_id, turn, message_id, role, text in _messages(batches):
        if turns and (conv_id != conv or size >= PIECE_CHARS):
            yield piece(starts and conv_id != conv)
            starts = conv_id != conv
            turns, mask, size = [], [], 0
        if not turns:
            conv, at = conv_id, {"turn": turn, "message_id": message_id}
        made, start, end = rendered(role, text)
        if role == TRAINED_ROLE:
            mask.append({"start": size + start, "end": size + end})
        turns.append(made)
        size += len(made)
    if turns:
        yield piece(False)  # the last run may go on in the next task


def _batched(rows, schema: pa.Schema, text_at: int):
    """Rows as Arrow batches of some megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at] or "") + 200
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def format_log(log: DataFrame) -> DataFrame:
    """pieces (conv_id, at, n_turns, formatted, mask, whole) of a log; `whole` marks pieces known to hold their whole conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(log.sparkSession)
    events = log.select(*MESSAGE, F.col("seq").cast("long").alias("seq"), "kind", "role", "text")
    dealt = events.repartitionByRange(*MESSAGE).sortWithinPartitions(*MESSAGE, "seq", "kind", "text")
    kinds = {f.name: f.dataType for f in events.schema}
    at = StructType([StructField("turn", kinds["turn"]), StructField("message_id", kinds["message_id"])])
    schema = StructType([StructField("conv_id", kinds["conv_id"]), StructField("at", at), StructField("n_turns", IntegerType()), StructField("formatted", StringType()), StructField("mask", SPANS), StructField("whole", BooleanType())])
    arrow = to_arrow_schema(schema)
    return dealt.mapInArrow(lambda batches: _batched(_pieces(batches), arrow, 3), schema)


def read_pieces(pieces: DataFrame) -> DataFrame:
    """(conv_id, at, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, turns, loss) read back from each piece: digests where
    the piece is whole, else the bytes that they are of."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {f.name: f.dataType for f in pieces.schema}
    schema = StructType([StructField("conv_id", kinds["conv_id"]), StructField("at", kinds["at"])]).add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long").add("turns", "binary").add("loss", "binary")
    arrow = to_arrow_schema(schema)

    def rows(batches):
        for batch in batches:
            for conv_id, at, formatted, mask, whole in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "formatted", "mask", "whole")), strict=True):
                found = parsed(formatted)
                turns = "".join(f"{role}\n{text}\n" for role, text in found).encode()
                trained = "".join(unescaped(formatted[s["start"] : s["end"]]) for s in mask)
                loss = trained.encode()
                digests = (hashlib.sha256(turns).hexdigest(), hashlib.sha256(loss).hexdigest()) if whole else (None, None)
                yield conv_id, at, len(found), digests[0], len(trained), digests[1], len(formatted), None if whole else turns, None if whole else loss

    return pieces.select("conv_id", "at", "formatted", "mask", "whole").mapInArrow(lambda batches: _batched(rows(batches), arrow, 7), schema)


def digests(read: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, its pieces digested in order as they come by."""
    from pyspark.sql.pandas.types import to_arrow_schema

    sums = ["n_turns", "loss_chars", "formatted_chars"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = StructType([next(f for f in read.schema if f.name == n) for n in names])
    arrow = to_arrow_schema(schema)

    def rows(batches):
        conv, begun, n, turns, loss = None, False, [0, 0, 0], None, None
        for batch in batches:
            for conv_id, done, done_loss, more, more_loss, *counts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns_sha256", "loss_sha256", "turns", "loss", *sums)), strict=True):
                if done is not None:
                    yield conv_id, counts[0], done, counts[1], done_loss, counts[2]
                    continue
                if not begun or conv_id != conv:
                    if begun:
                        yield conv, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2]
                    conv, begun, n, turns, loss = conv_id, True, [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                turns.update(more)
                loss.update(more_loss)
                n = [a + b for a, b in zip(n, counts, strict=True)]
        if begun:
            yield conv, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2]

    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.mapInArrow(lambda batches: _batched(rows(batches), arrow, 2), schema)


def planted(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with conversation -7, whose texts hold the template's own control strings."""
    kinds = {f.name: f.dataType for f in rows.schema}
    said = "\\### Assistant: </turn> ok"
    cast: list[Column] = [F.col(c).cast(kinds[c]).alias(c) for c in ("conv_id", "turn", "role", "text")]
    more = rows.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(more.select(*cast))


def round_trip(rows: DataFrame) -> DataFrame:
    """What the formatted pieces of conversations (conv_id, turn, role, text) give back, one row per conversation."""
    return digests(read_pieces(format_log(event_log(rows))))
