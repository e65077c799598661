"""Chat formatting by event-sourced reconstruction.

Logs hold events of conversations: a message, deltas that are streamed onto it, edits that
replace it, regenerations that start it anew, deletions. Logs are dealt by conversation and
message, so that a conversation of very many messages is the work of many tasks, and sorted
by sequence; one pass folds the events of a message into its final text and renders it,
holding one message at a time. Rendered turns come in the order of message and part.

The rendered form of a turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. In roles and texts
each ``<``, backslashes, ``|`` gets one backslash more, so that no text holds a control
string, and taking one away restores it. A role's line feeds become ``\\n`` escapes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


#: One row for each event. kind: message (sets role and text), delta (appends), edit
#: (replaces the text), regenerate (empties it), delete (drops the message). part tells
#: messages of one number apart; a log without that column has part 0.
EVENTS = "conv_id bigint, message bigint, part bigint, seq bigint, kind string, role string, text string"
RENDERED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("message", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("rendered", T.StringType()),
        T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType()),
    ]
)


def render(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Final turns: conv_id, message, part, rendered, and the span under the loss mask.

    The span counts code points of ``rendered``; both ends are null where nothing is trained
    on. A conversation's text is its rendered turns, joined in the order of (message, part),
    a null number first. Null texts and roles are empty; unknown kinds are ignored; a delta,
    edit or regeneration without a message makes one of role ''. Repeated events apply as
    often as they stand. Ties of sequence are taken by kind, role and text. Null conversations
    are one of their own. Other columns are left out; no events give no turns.
    """
    cols = ["conv_id", "message", "part", "seq", "kind", "role", "text"]
    if "part" not in events.columns:
        events = events.withColumn("part", F.lit(0).cast("bigint"))
    dealt = events.select(*cols).repartition("conv_id", "message", "part").sortWithinPartitions(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # [key, role, text parts, live]
        out: list[tuple] = []

        def close() -> None:
            if now is None or not now[3]:
                return
            head = f"{START}{escape_role(now[1])}\n"
            body = escape("".join(now[2]))
            span = (len(head), len(head) + len(body)) if now[1] == loss_role else (None, None)
            out.append((*now[0], f"{head}{body}{END}\n", *span))

        for b in batches:
            for c, m, p, _, kind, role, text in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if now is None or now[0] != (c, m, p):
                    close()
                    now = [(c, m, p), "", [], False]
                if kind == "message":
                    now[1:] = role or "", [text or ""], True
                elif kind == "delta":
                    now[2].append(text or "")
                    now[3] = True
                elif kind == "edit":
                    now[2:] = [text or ""], True
                elif kind == "regenerate":
                    now[2:] = [], True
                elif kind == "delete":
                    now[2:] = [], False
                if len(out) >= 2000:
                    yield _batch(out, RENDERED)
                    out.clear()
        close()
        if out:
            yield _batch(out, RENDERED)

    return dealt.mapInArrow(run, RENDERED)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(zip(*rows, strict=True), schema.fields, strict=True)], names=schema.names)


DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the rendered turns in one ordered pass.

    A digest of a whole conversation is sequential, so a conversation is one task's work
    here; it takes the memory of one turn, as digests are updated while turns pass. Rows of a
    conversation that lack turns still give what they hold; no rows give none.
    """
    cols = ["conv_id", "message", "part", "rendered", "loss_start", "loss_end"]
    dealt = rendered.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "message", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        out: list[tuple] = []

        def close() -> None:
            if state is not None:
                conv, n, turns, chars, loss, size = state
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            for c, _, _, text, lo, hi in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if state is None or state[0] != c:
                    close()
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(text)
                for m in _TURN.finditer(text):
                    state[1] += 1
                    state[2].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                if lo is not None:
                    part = unescape(text[lo:hi])
                    state[3] += len(part)
                    state[4].update(part.encode())
            if len(out) >= 2000:
                yield _batch(out, DIGESTS)
                out.clear()
        close()
        if out:
            yield _batch(out, DIGESTS)

    return dealt.mapInArrow(run, DIGESTS)


def events_of(conversations: DataFrame) -> DataFrame:
    """A finished table of turns as events: each row one message, numbered by its turn.

    Rows of equal turn stay apart, in the order of role and text; exact repeats all stay.
    Any turn that fits 64 bits will do, and a null one comes first. Null roles and texts are
    empty; other columns are left out.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("message"), empty("role"), empty("text"))
    w = Window.partitionBy("conv_id", "message").orderBy("role", "text")
    return rows.select(
        "conv_id",
        "message",
        F.row_number().over(w).cast("bigint").alias("part"),
        F.lit(0).cast("bigint").alias("seq"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g'))
      + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
