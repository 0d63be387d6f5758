"""Operator 11: chat text from logs of conversation events.

A log holds ``open``, ``delta``, ``edit`` and ``regenerate`` events of numbered messages. Events are
dealt by conversation and message and taken by sequence number: what an edit or a regeneration
replaced goes before anything is gathered, so a message costs the memory of its text. Which messages a
regeneration has cut off is a running maximum over the conversation's messages, taken block by block
of their ranges. Each message is rendered to a piece of the conversation's text with the span under the
loss mask, and written; a conversation's text is its pieces in order, so no conversation is held in one place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, slices

#: What stands before and after a text, by role; ``other`` has the role's name in it.
OPENS = {"system": "<<SYS>> ", "user": "<s>[INST] ", "assistant": " "}
CLOSES = {"system": " <</SYS>>", "user": " [/INST]", "assistant": " </s>"}
OTHER_OPENS, OTHER_CLOSES = ("[TURN ", "] "), " [/TURN]"
#: Every control string is one of the first characters followed by one of the rests.
_CONTROL = r"([<\[])(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|TURN |/TURN\])"
_TURN = re.compile(r"<<SYS>> (?P<system>.*?) <</SYS>>|<s>\[INST\] (?P<user>.*?) \[/INST\]|\[TURN (?P<role>(?:[^\]\\]|\\.)*)\] (?P<other>.*?) \[/TURN\]| (?P<assistant>.*?) </s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Messages of a block when cut-off messages are found, about.
BLOCK_ROWS = 1_000_000


def escaped(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    at = 0
    for found in _TURN.finditer(text):
        if found.start() != at:
            break
        at = found.end()
        kind = found.lastgroup
        yield (unescaped(found["role"]) if kind == "other" else kind), unescaped(found[kind])
    if at != len(text):
        raise ValueError(f"no turn begins at character {at}")


def final_messages(events: DataFrame, message: Sequence[str] = ("message",)) -> DataFrame:
    """conv_id, the columns of ``message``, role, text of each message that is left at a log's end.

    ``events``: conv_id, ``message`` (its number in the conversation, one or more columns in order), seq,
    kind, role, text. ``open`` begins a message and sets its role; its text and that of each ``delta``
    are appended; ``edit`` puts its text in place of what was there; ``regenerate`` drops what was there, and every
    later message of the conversation that was opened before. Events of one seq go by kind, role, text; an event that is
    delivered twice counts once. Null texts are empty; a message without ``open``, or with a null role, has the empty
    role; null conversations, numbers and seqs are values that sort first; events of other kinds are ignored.
    An empty log has no messages; other columns are ignored.
    """
    key = ["conv_id", *message]
    events = events.where(F.col("kind").isin("open", "delta", "edit", "regenerate")).select(*key, F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    whole = Window.partitionBy(*key)
    reset = F.max(F.when(F.col("e.kind") != "delta", F.col("e"))).over(whole)
    events = events.withColumn("reset", reset).withColumn("opened", F.max(F.when(F.col("e.kind") == "open", F.col("e"))).over(whole)).withColumn("again", F.max(F.when(F.col("e.kind") == "regenerate", F.struct("e.seq"))).over(whole))
    left = events.where(F.col("reset").isNull() | (F.col("e") >= F.col("reset")))
    parts = F.transform(F.sort_array(F.collect_set("e")), lambda e: F.when(e.kind == "regenerate", "").otherwise(e.text))
    folded = left.groupBy(*key).agg(F.array_join(parts, "").alias("text"), F.first("opened").alias("opened"), F.first("again").alias("again"))
    folded = materialize(folded.select(*key, F.coalesce("opened.role", F.lit("")).alias("role"), "text", F.struct("opened.seq").alias("opened"), "again"), "messages")
    if not folded.where(F.col("again").isNotNull()).limit(1).count():
        return folded.drop("opened", "again")
    return _without_cut_off(folded, key)


def _without_cut_off(folded: DataFrame, key: list[str]) -> DataFrame:
    """Drops messages opened before an earlier message of their conversation was last regenerated."""
    n = max(1, folded.count() // BLOCK_ROWS, int(folded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = materialize(folded.repartitionByRange(n, *key).withColumn("block", F.spark_partition_id()), "message_blocks")
    inside = F.max("again").over(Window.partitionBy("block", "conv_id").orderBy(*key[1:]).rowsBetween(Window.unboundedPreceding, -1))
    # A conversation has one row for each block that it reaches into.
    ends = blocks.groupBy("block", "conv_id").agg(F.max("again").alias("again"))
    earlier = ends.select("block", F.col("conv_id").alias("conv"), F.max("again").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier")).where("earlier is not null")
    marked = blocks.withColumn("inside", inside).join(earlier.hint("shuffle_hash"), (blocks.block == earlier.block) & blocks.conv_id.eqNullSafe(earlier.conv), "left")
    cut = F.greatest("inside", "earlier")
    return marked.where(cut.isNull() | (cut <= F.col("opened"))).select(*key, "role", "text")


def formatted(messages: DataFrame, message: Sequence[str] = ("message",)) -> DataFrame:
    """conv_id, the columns of ``message``, piece, loss_start, loss_chars: the text of each turn, and where in it the
    assistant's (escaped) text lies, in code points from 0; loss_chars is 0 elsewhere. Texts and roles are escaped, so
    ``turns`` gives them back from a piece, or from pieces joined. Null texts and roles are empty."""
    text, role = escaped(F.coalesce("text", F.lit(""))), F.coalesce("role", F.lit(""))
    named = F.concat(F.lit(OTHER_OPENS[0]), F.replace(escaped(role), F.lit("]"), F.lit("\\]")), F.lit(OTHER_OPENS[1]))
    opens, closes = named, F.lit(OTHER_CLOSES)
    for r in OPENS:
        opens, closes = F.when(role == r, OPENS[r]).otherwise(opens), F.when(role == r, CLOSES[r]).otherwise(closes)
    ours = role == "assistant"
    return messages.select("conv_id", *message, F.concat(opens, text, closes).alias("piece"), F.when(ours, F.length(opens)).otherwise(0).cast("long").alias("loss_start"), F.when(ours, F.length(text)).otherwise(0).cast("long").alias("loss_chars"))


def digests(pieces: DataFrame, message: Sequence[str] = ("message",)) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from its
    pieces. A digest takes its bytes in order, so a conversation's pieces pass through one task, sorted and batch by
    batch; nothing of them is kept. A null conv_id is a conversation of its own; without pieces there is no row."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in slices(batches, "piece"):
            for conv, piece, start, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_chars")), strict=True):
                if now is None or now[0] != conv:
                    found += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns(piece):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                loss = unescaped(piece[start : start + size])
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(piece)
            yield _digest_rows(found, names)
            found = []
        if now:
            yield _digest_rows([now], names)

    order = [F.col("conv_id"), *(F.col(c) for c in message)]
    dealt = pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "piece", "loss_start", "loss_chars")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_rows(found: list, names: list[str]) -> pa.RecordBatch:
    rows = [(c, n, t.hexdigest(), k, x.hexdigest(), f) for c, n, t, k, x, f in found]
    kinds = [pa.string() if x.endswith("sha256") else pa.int64() for x in names]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def replayed(conversations: DataFrame, most: int = 64, least: int = 200) -> DataFrame:
    """An event log that ends in the given rows: conv_id, turn, copy, seq, kind, role, text.

    Assistant texts come as deltas after a draft that was regenerated, user texts as a draft that was edited and
    went on, others as deltas. ``copy`` numbers rows that share conversation and turn, by role and text.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).cast("long"))
    step = F.greatest(F.lit(least), F.ceil(F.length("text") / most)).cast("int")
    rows = rows.withColumn("step", step).withColumn("parts", F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / F.col("step")).cast("int") - 1)), lambda i: F.substring(F.col("text"), i * F.col("step") + 1, F.col("step"))))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    deltas = lambda parts: F.transform(parts, lambda x: event("delta", x))
    rest = F.slice("parts", F.lit(2), F.lit(most + 1))
    streamed = F.concat(F.array(event("open", F.lit(""))), deltas(F.slice("parts", F.lit(1), F.lit(1))), F.array(event("delta", F.lit("...")), event("regenerate", F.lit(""))), deltas(F.col("parts")))
    typed = F.concat(F.array(event("open", F.upper(F.col("parts")[0])), event("edit", F.col("parts")[0])), deltas(rest))
    plain = F.concat(F.array(event("open", F.lit(""))), deltas(F.col("parts")))
    log = rows.select("conv_id", "turn", "copy", "role", F.posexplode(F.when(F.col("role") == "assistant", streamed).when(F.col("role") == "user", typed).otherwise(plain)).alias("at", "e"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    seq = F.coalesce(big("turn"), F.lit(-(1 << 63)).cast("decimal(38,0)") - 1) * 1_000_000_000_000 + big("copy") * 1000 + F.col("at")
    return log.select("conv_id", "turn", "copy", seq.cast("decimal(38,0)").alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


#: A conversation whose texts hold control strings of the template.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of the one with control strings, through log, fold, template and written pieces.

    Rows go by turn (null first), then role and text; repeated rows are turns each; null texts and roles are
    empty. An empty table gives the one conversation; other columns are ignored.
    """
    spark = conversations.sparkSession
    fixed = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(fixed)
    by = ("turn", "copy")
    pieces = materialize(formatted(final_messages(replayed(rows), by), by), "chat_pieces")
    return digests(pieces, by)


def sql() -> str:
    """The same rows in DuckDB SQL over the table itself."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    escape = lambda x: f"regexp_replace(replace({x}, '\\', '\\\\'), {quoted(_CONTROL)}, '\\1\\\\\\2', 'g')"
    frame = " ".join(f"when {quoted(r)} then {len(OPENS[r]) + len(CLOSES[r])}" for r in OPENS)
    other = len("".join(OTHER_OPENS)) + len(OTHER_CLOSES)
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values {", ".join(f"({c}, {t}, {quoted(r)}, {quoted(x)})" for c, t, r, x in CONTROL_CONVERSATION)}),
said as (
  select *, case when role = 'assistant' then text else '' end as loss,
         length({escape("text")}) + case role {frame} else {other} + length(replace({escape("role")}, ']', '\\]')) end as chars from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(sum(length(loss)) as bigint) as loss_chars, sha256(string_agg(loss, '' order by turn nulls first, role, text)) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from said group by conv_id
"""
