r"""Chat formatting in budgeted, turn-aligned windows.

Template (control strings in capitals or angle brackets)::

    [SYS]text[/SYS]   [INST]text[/INST]   <s>text</s>   [ROLE]role[/ROLE]text[TURN]
    system            user                assistant     any other role

Inside roles and texts a control string gets a backslash after its first character, and one
that already has some gets one more, so the text comes back exactly: ``</s>`` becomes ``<\/s>``
and ``<\/s>`` becomes ``<\\/s>``.

A conversation is cut by the running sum of its turns' tokens: a window holds the leading
system turn, a limited history of turns that earlier windows held, and as many new turns as
``budget`` allows, at least one. The loss mask covers the text of new assistant turns; history
is repeated without loss, so each assistant text is a target once. Turns are never cut.

Rows are sorted by conversation and turn and then streamed, so a long conversation costs no more
memory than a window and the batch of windows that is being filled (``FLUSH`` characters).
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

_CONTROL = r"(?:/?(?:INST|SYS|ROLE)\]|TURN\]|/?s>)"
_BARE = re.compile(rf"([\[<])(\\*)(?={_CONTROL})")
_ESCAPED = re.compile(rf"([\[<])\\(\\*)(?={_CONTROL})")
_MARK = re.compile(r"\[SYS\]|\[INST\]|<s>|\[ROLE\]")
_END = {"[SYS]": "[/SYS]", "[INST]": "[/INST]", "<s>": "</s>"}
_NAME = {"[SYS]": "system", "[INST]": "user", "<s>": "assistant"}
_OPEN = {v: k for k, v in _NAME.items()}
#: Tokens that a turn's marks count, so that empty turns fill a window too.
MARKS = 2
#: Characters of formatted windows that are gathered before they are handed on.
FLUSH = 4 << 20


def escape(text: str) -> str:
    return _BARE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    body = escape(text)
    mark = _OPEN.get(role)
    head, tail = (mark, _END[mark]) if mark else (f"[ROLE]{escape(role)}[/ROLE]", "[TURN]")
    return head + body + tail, len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; the offsets are those of the escaped text."""
    at = 0
    while at < len(formatted):
        mark = _MARK.match(formatted, at)
        if not mark:
            raise ValueError(f"no turn begins at {at}")
        at, kind, end = mark.end(), mark[0], _END.get(mark[0], "[TURN]")
        role = _NAME.get(kind)
        if role is None:
            to = formatted.index("[/ROLE]", at)
            role, at = unescape(formatted[at:to]), to + 7
        to = formatted.index(end, at)
        yield role, unescape(formatted[at:to]), at, to
        at = to + len(end)


class _Windows:
    """Cuts one conversation, turn by turn."""

    def __init__(self, budget: int, history: int, emit: Callable):
        self.budget, self.history, self.emit = budget, history, emit
        self.system: tuple | None = None
        self.past: deque = deque()  # turns of earlier windows: (tokens, formatted, ...)
        self.new: list = []
        self.n_new = self.n_past = self.n_system = self.number = self.seen = 0

    def add(self, role: str, text: str, tokens: int) -> None:
        tokens += MARKS
        turn = (tokens, role, *render(role, text))
        if not self.seen and role == "system":
            self.system, self.n_system = turn, tokens
        elif self.new and self.n_system + self.n_past + self.n_new + tokens > self.budget:
            self.close()
            self.take(turn)
        else:
            self.take(turn)
        self.seen += 1

    def take(self, turn: tuple) -> None:
        # history gives way to a new turn that would not fit beside it
        while not self.new and self.past and self.n_system + self.n_past + turn[0] > self.budget:
            self.n_past -= self.past.popleft()[0]
        self.new.append(turn)
        self.n_new += turn[0]

    def close(self) -> None:
        if not self.new and not (self.system and not self.number):
            return
        text, loss, at = [], [], 0
        repeated = ([self.system] if self.system else []) + list(self.past)
        for i, (_, role, formatted, start, end) in enumerate([*repeated, *self.new]):
            if i >= len(repeated) and role == "assistant":
                loss += [at + start, at + end]
            text.append(formatted)
            at += len(formatted)
        self.emit(self.number, "".join(text), loss, len(repeated) if self.number else 0, self.n_system + self.n_past + self.n_new)
        self.number += 1
        self.past.extend(self.new)
        self.n_past += self.n_new
        self.new, self.n_new = [], 0
        while self.past and self.n_past > self.history:
            self.n_past -= self.past.popleft()[0]


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, budget: int = 512, history: int = 128, tokens=None) -> DataFrame:
    """Windows of all conversations: conv_id, window, text, loss, repeated, tokens.

    ``loss`` holds flat pairs of code-point offsets into ``text``; ``repeated`` is the number of the
    window's first turns that an earlier window held; ``tokens`` (of a turn, a Column) defaults to the
    text's words. Rows with equal turn numbers are ordered by role and text, a null turn number comes
    first. A null role or text is an empty one; a null conv_id is a conversation of its own. Other
    columns are not carried; an empty table gives no windows. Windows of a conversation are in one
    partition, in order.
    """
    kind = turns.schema[conv_col].dataType
    size = F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")) if tokens is None else tokens
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("tokens"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, key, work = 0, object(), None

        def pack() -> pa.RecordBatch:
            c = list(zip(*out)) or [[]] * 6
            got = pa.RecordBatch.from_arrays([pa.array(c[0], to_arrow_type(kind)), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.list_(pa.int64())), pa.array(c[4], pa.int64()), pa.array(c[5], pa.int64())], ["conv_id", "window", "text", "loss", "repeated", "tokens"])
            out.clear()
            return got

        for batch in batches:
            for conv, role, text, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                before = len(out)
                if work is None or conv != key:
                    if work:
                        work.close()
                    key, work = conv, _Windows(budget, history, lambda *w, conv=conv: out.append((conv, *w)))
                work.add(role, text, n)
                # what counts is what windows hold, repeated system turns and history included
                held += sum(len(w[2]) + 100 for w in out[before:])
                if held > FLUSH:
                    yield pack()
                    held = 0
        if work:
            work.close()
        yield pack()

    return rows.mapInArrow(cut, f"conv_id {kind.simpleString()}, window long, text string, loss array<long>, repeated long, tokens long")


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from what ``format_chats`` wrote.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline per turn, each once), loss_chars and
    loss_sha256 (of the unescaped texts under the mask) and formatted_chars. ``windows`` must still be
    in the order of ``format_chats``; a stored table is to be repartitioned and sorted first.
    """
    kind = windows.schema["conv_id"].dataType

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = object(), None, []

        def finish():
            out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, text, loss, repeated in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "loss", "repeated"))):
                if state is None or conv != key:
                    if state:
                        finish()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(text)
                for i, (role, body, _, _) in enumerate(parse(text)):
                    if i >= repeated:
                        state[0] += 1
                        state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(loss[::2], loss[1::2]):
                    target = unescape(text[a:b])
                    state[2] += len(target)
                    state[3].update(target.encode("utf-8", "surrogatepass"))
            if len(out) > 10_000:
                yield _batch(out, kind)
                out = []
        if state:
            finish()
        yield _batch(out, kind)

    return windows.mapInArrow(look, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple], kind) -> pa.RecordBatch:
    c = list(zip(*rows)) or [[]] * 6
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
