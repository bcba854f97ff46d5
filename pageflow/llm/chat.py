"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  It is
rendered over successive prefixes of a conversation and consecutive outputs are
compared: what the output grows by is the new turn's span, and a template whose
output for k turns is no prefix of that for k + 1 rewrites history.  The turn where it
does is marked ``rewrites``, and the conversation's output is the template's own for all
turns: each turn's span and text are then found again in that, by comparing it with the
outputs of the prefixes and with those for another text.
The text's place in a turn is found by rendering the turn once more with an empty
text: what both share before and after is the template's, the rest the text's.

Prefixes are whole, so a task holds a conversation and takes quadratic time for it.
Only a template marked ``prefix_local``, which renders a turn alike after any turns
(as the default one does, a join over turns), sees beyond ``EXACT`` turns just the
first ``HEAD`` and the last ``TAIL`` ones, in time in proportion and blocks of turns.

Defined results: null texts and roles are empty; rows of equal turn are ordered by
role and text; repeated rows are turns of their own; rows of a null conversation
are one conversation; null turns come first; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S

EXACT, HEAD, TAIL = 24, 4, 8
#: Turns of a block of output.
BLOCK = 64
Template = Callable[[list[tuple[str, str]]], str]
#: Marks of the default template (fixed values): a turn is "### role: text </turn>\n".
START, MIDDLE, END = "### ", ": ", " </turn>\n"


def escape(text: str) -> str:
    """Marks inside a text made harmless, reversibly: ``\\``, ``#`` and ``<`` get a backslash."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\#<:\n])|\\n", lambda m: m[1] or "\n", text)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:").replace("\n", "\\n")


def default_template(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{START}{escape_role(r)}{MIDDLE}{escape(t)}{END}" for r, t in turns)


default_template.prefix_local = True


_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.S)


def parse_default(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin, end of the escaped text) of each turn of an output."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        yield unescape(found[1]), unescape(found[2]), found.start(2), found.end(2)
        at = found.end()


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


class Incremental:
    """Renders a conversation turn by turn; holds a bounded part of it if the template is prefix-local."""

    def __init__(self, render: Template):
        self.render, self.turns, self.output = render, [], render([])
        self.preamble, self.local = self.output, getattr(render, "prefix_local", False)

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        """(what the output grows by, the text's begin and end in it, rewrites)."""
        if self.local and len(self.turns) >= EXACT:
            self.turns = self.turns[:HEAD] + self.turns[-TAIL:]
            self.output = self.render(self.turns)
        before = self.turns
        now = self.render([*before, (role, text)])
        part = _common(self.output, now)
        rewrites = part < len(self.output)
        grown = now[part:]
        blank = self.render([*before, (role, "")])[part:]
        begin = _common(grown, blank)
        end = len(grown) - min(_common(grown[::-1], blank[::-1]), len(blank) - begin)
        # A text may begin or end as the template goes on: what is rendered for another tells.
        probe = self.render([*before, (role, "\x01")])[part:]
        if "\x01" in probe:
            begin, end = probe.index("\x01"), len(grown) - (len(probe) - probe.rindex("\x01") - 1)
        self.turns, self.output = [*before, (role, text)], now
        return grown, begin, max(begin, end), rewrites


def relocated(render: Template, turns: list[tuple[str, str]]) -> list[tuple[int, int, int, int]]:
    """(begin, end, text's begin and end) of each turn in the output for all turns.

    A turn ends where the output for the turns up to it stops being a prefix; a text
    that the output for all turns does not hold has an empty place."""
    full, at, out = render(turns), _common(render([]), render(turns)), []
    for i, (role, _) in enumerate(turns):
        end = len(full) if i == len(turns) - 1 else max(at, _common(render(turns[: i + 1]), full))
        probe = render([*turns[:i], (role, "\x01"), *turns[i + 1 :]])
        if "\x01" in probe:
            begin, stop = probe.index("\x01"), len(full) - (len(probe) - probe.rindex("\x01") - 1)
            out.append((min(at, begin), max(end, stop), begin, max(begin, stop)))
        else:
            out.append((at, end, end, end))
        at = out[-1][1]
    return out


_OUT = "conv_id long, block long, formatted string, spans array<struct<role:string,begin:long,end:long,text_begin:long,text_end:long,rewrites:boolean>>"


def format_chats(rows: DataFrame, render: Template = default_template) -> DataFrame:
    """conv_id, block, formatted, spans: a conversation's output; in blocks of turns
    for a prefix-local template.

    Spans count code points from the block's begin.  Conversations are dealt out
    by id and streamed in turn order: a task holds a bounded part of one, or all of
    it for a template that is not prefix-local."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = S.columns(rows, conv_id="long", turn="long", role="string", text="string")
    dealt = held.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    span = pa.struct([("role", pa.string()), *((c, pa.int64()) for c in ("begin", "end", "text_begin", "text_end")), ("rewrites", pa.bool_())])
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(span))])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(at: tuple, state: Incremental, block: int, parts: list[str], spans: list[dict]) -> tuple:
            if any(s["rewrites"] for s in spans):  # never of a prefix-local template, whose blocks are parts
                for s, (begin, end, text_begin, text_end) in zip(spans, relocated(render, state.turns)):
                    s.update(begin=begin, end=end, text_begin=text_begin, text_end=text_end)
                return *at, block, state.output, spans
            return *at, block, "".join(parts), spans

        local = getattr(render, "prefix_local", False)

        def blocks():
            at, state, block, parts, spans, size = (), None, 0, [], [], 0
            for conv, role, text in S.rows_of(found):
                if (conv,) != at or local and len(spans) == BLOCK:
                    if spans:
                        yield ended(at, state, block, parts, spans)
                    new = (conv,) != at
                    at, state, block = (conv,), Incremental(render) if new else state, 0 if new else block + 1
                    parts, spans = [state.preamble] if new else [], []
                    size = len(parts[0]) if new else 0
                role, text = role or "", text or ""
                grown, begin, end, rewrites = state.add(role, text)
                spans.append({"role": role, "begin": size, "end": size + len(grown), "text_begin": size + begin, "text_end": size + end, "rewrites": rewrites})
                parts.append(grown)
                size += len(grown)
            if spans:
                yield ended(at, state, block, parts, spans)

        yield from S.batches(blocks(), schema, size=256)

    return dealt.mapInArrow(run, _OUT)


def read_digests(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the default template's output.

    The turns are parsed from the text alone; the spans give the loss mask."""
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "formatted", "spans")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, n, turns, loss_chars, loss, chars = (), 0, None, 0, None, 0
            for conv, text, spans in S.rows_of(found):
                if (conv,) != at:
                    if n:
                        yield *at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
                    at, n, turns, loss_chars, loss, chars = (conv,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, said, _, _ in parse_default(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                    n += 1
                for s in spans:
                    if s["role"] == "assistant":
                        said = unescape(text[s["text_begin"] : s["text_end"]])
                        loss_chars += len(said)
                        loss.update(said.encode("utf-8", "replace"))
                chars += len(text)
            if n:
                yield *at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from S.batches(rows(), schema)

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all conversations and conversation -7, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = S.columns(S.table(spark, sf_dir, "conversations"), conv_id="long", turn="long", role="string", text="string").unionByName(own)
    return read_digests(S.saved(format_chats(rows), S.scratch(spark, "chat")))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### : ' || role || ' </turn>' || chr(10)) + length(text)
    + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '#', ''))
    + length(text) - length(replace(text, '<', ''))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
