"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

``format_chats`` turns conversation rows into text segments with a loss flag each.  The
template names the text before and after each role's turn, which roles carry loss and which
role may follow which; joined in order, the segments of a conversation are its training
string.  Control strings inside texts are escaped reversibly: in one pass each escape
character becomes ``E0`` and each control string gets ``E1`` after its first character, so
no control string is left whole, and dropping ``E1`` and reading ``E0`` as ``E`` restores
the text.  ``read_back`` joins the segments and parses the turns from the marks in the string.

Rows of a conversation are ordered by turn, then role, then text, so ties and repeated rows
have one defined order (repeats stay).  Null text is the empty text, a null role the empty
role; conversations with a null id form one conversation of their own.  A conversation that
breaks the turn order is formatted all the same and its segments say ``valid = false`` from
the first broken turn on, with the reason; empty tables give empty results; extra columns
are ignored.

Rows are hash-partitioned by conversation and sorted inside the partition, then streamed:
a task holds one Arrow batch, never a whole conversation, so the longest conversation costs
no more memory than the shortest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"


@dataclass(frozen=True)
class Template:
    """before/after: control text around a turn by role, ``*`` for any other role (its name
    goes into the ``{role}`` slot, escaped).  loss: roles whose text is learnt.  follows:
    state -> roles that may come next; states are the last role, ``""`` is the start."""

    before: dict[str, str]
    after: dict[str, str]
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=dict)
    controls: tuple[str, ...] = ()


#: Control strings in the style of public chat templates.
DEFAULT = Template(
    before={"system": "<<SYS>>", "user": "[INST]", "assistant": "[ANS]", "*": "[ROLE]{role}[/ROLE]"},
    after={"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>", "*": "[/TURN]"},
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)},
    controls=("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[ROLE]", "[/ROLE]", "[/TURN]"),
)


class Codec:
    """Reversible escaping of a template's control strings."""

    def __init__(self, template: Template):
        self.pattern = re.compile("|".join([re.escape(ESCAPE), *sorted(map(re.escape, template.controls), key=len, reverse=True)]))
        self.back = re.compile(f"{ESCAPE}([01])")

    def escape(self, text: str) -> str:
        return self.pattern.sub(lambda m: ESCAPE + "0" if m[0] == ESCAPE else m[0][0] + ESCAPE + "1" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.back.sub(lambda m: ESCAPE if m[1] == "0" else "", text) if ESCAPE in text else text


SEGMENTS = "conv_id long, turn_no long, part int, role string, segment string, loss boolean, valid boolean, error string"
_ARROW = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_()), ("error", pa.string())])


def format_chats(conversations: DataFrame, template: Template = DEFAULT, partitions: int | None = None) -> DataFrame:
    """Segment rows in order within each partition: three a turn (before, text, after)."""
    codec_of, table = template, template.follows

    def machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, state, number, error = Codec(codec_of), object(), "", 0, None
        for batch in batches:
            rows: list[tuple] = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != now:
                    now, state, number, error = conv, "", 0, None
                if error is None and role not in table.get(state, ()):
                    error = f"turn {number}: {role or 'no role'} after {state or 'start'}"
                known = role if role in codec_of.before and role != "*" else "*"
                learnt, fine = role in codec_of.loss, error is None
                rows.append((conv, number, 0, role, codec_of.before[known].replace("{role}", codec.escape(role)), False, fine, error))
                rows.append((conv, number, 1, role, codec.escape(text), learnt, fine, error))
                rows.append((conv, number, 2, role, codec_of.after[known], False, fine, error))
                state, number = role, number + 1
                if len(rows) >= 30_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"))
    dealt = rows.repartition("conv_id") if partitions is None else rows.repartition(partitions, "conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(machine, SEGMENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


TURNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, error string"


class Reader:
    """Turns from a conversation's joined string, by its marks alone.

    No control string stands whole in an escaped text or role, so the first opening mark is the turn's and the first
    closing mark of its role ends it.  Text is fed in pieces; only an open turn is held."""

    def __init__(self, template: Template):
        self.codec, self.after = Codec(template), template.after
        opening, closing = template.before["*"].split("{role}")
        self.roles = {v: k for k, v in template.before.items() if k != "*"}
        known = "|".join(re.escape(m) for m in sorted(self.roles, key=len, reverse=True))
        self.open = re.compile(f"({known})|{re.escape(opening)}(.*?){re.escape(closing)}", re.S)
        self.held, self.text_at, self.role, self.mark, self.seen = "", 0, None, "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that the piece completes."""
        self.held += piece
        while True:
            if self.role is None:
                m = self.open.match(self.held)
                if not m:
                    return
                self.role = self.roles[m[1]] if m[1] else self.codec.unescape(m[2])
                self.mark = self.after.get(self.role if m[1] else "*", self.after["*"])
                self.text_at = self.seen = m.end()
            # A mark may begin in what was searched before.
            end = self.held.find(self.mark, max(self.text_at, self.seen - len(self.mark)))
            if end < 0:
                self.seen = len(self.held)
                return
            yield self.role, self.codec.unescape(self.held[self.text_at : end])
            self.held, self.role = self.held[end + len(self.mark) :], None


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row a conversation from its joined segments, in the partitions and order format_chats gave them.
    Roles and texts are parsed from the joined string; the loss flags only say which characters are learnt."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, started, reader = Codec(template), None, False, Reader(template)
        turns = loss = None
        n = chars = formatted = 0
        valid, error = True, None
        for batch in batches:
            out = []
            for conv, segment, learnt, fine, why in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if not started or conv != now:
                    if started:
                        out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, valid, error))
                    now, started, turns, loss, reader = conv, True, hashlib.sha256(), hashlib.sha256(), Reader(template)
                    n = chars = formatted = 0
                    valid, error = True, None
                formatted += len(segment)
                valid, error = valid and fine, error or why
                for role, text in reader.feed(segment):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                if learnt:
                    text = codec.unescape(segment)
                    loss.update(text.encode())
                    chars += len(text)
            yield _turns(out)
        if started:
            yield _turns([(now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, valid, error)])

    return segments.select("conv_id", "segment", "loss", "valid", "error").mapInArrow(parse, TURNS)


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("error", pa.string())])
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def op2_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations plus conversation -1, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return read_back(format_chats(rows.unionByName(extra)))


#: Everything but formatted_chars and the validity can be said in SQL.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
    replace(text, chr(9243), chr(9243) || '0') AS e
  FROM t
), f AS (
  SELECT *,
    length(regexp_replace(e, '(<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ANS\]|\[/ANS\]|\[ROLE\]|\[/ROLE\]|\[/TURN\])', 'xx\1', 'g')) AS chars,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 20 + length(role) END AS marks,
    CASE coalesce(prev, '') WHEN '' THEN role IN ('system','user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
      WHEN 'assistant' THEN role IN ('user','tool') WHEN 'tool' THEN role = 'assistant' ELSE false END AS fine
  FROM n
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(chars + marks) AS BIGINT) AS formatted_chars,
  bool_and(fine) AS valid,
  arg_min('turn ' || k || ': ' || CASE role WHEN '' THEN 'no role' ELSE role END || ' after ' || CASE coalesce(prev,'') WHEN '' THEN 'start' ELSE prev END, k) FILTER (NOT fine) AS error
FROM f GROUP BY conv_id
"""
