r"""Chat formatting in budgeted windows.

A turn is written ``<s>[INST]role[/INST]text</s>``. Control strings (and the escape character)
inside roles and texts are escaped reversibly, so a text can never forge a turn. A turn costs
the tokens of what is written, role and marks included. Turns of a conversation are laid on a
line by the prefix sums of their costs, and windows are turn-aligned spans of that line: each
window holds the next new turns that fit the budget beside the system turn and a limited
history. The history is shortened until the first new turn fits, and the system turn left out
if the two don't fit without any. The system turn and the history are repeats
and are marked so; the loss mask covers the text of each new assistant turn, and never a
repeat, so every assistant text is a target exactly once.

Conversations are spread by id and sorted by turn; both passes stream over the sorted rows
and hold one window, so a conversation with a third of all rows needs no more memory (its
turns are one sequence and pass through one task).

Edge cases: null texts and roles are empty; turns of equal number are ordered by role and
text; a turn larger than the budget is the only new one of its window, beside the system turn,
and is never cut; a system turn larger than the budget is repeated beside one new turn a window;
a null conv_id is a conversation; an empty table gives no windows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
BUDGET, HISTORY = 1024, 256
TOKENIZER, KEPT = "word_bpe_49k.json", 200_000
_BLANK = re.compile(r"[ \t-\r]+")
_OUT = {"\\": "\\\\"} | {c: f"\\{i}" for i, c in enumerate(CONTROL)}
_IN = {v: k for k, v in _OUT.items()}
_ESC = re.compile("|".join(map(re.escape, _OUT)))
_UNESC = re.compile(r"\\[\\0-3]")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
WINDOWS = "conv_id long, window long, text string, n_turns int, n_repeated int, mask array<struct<start:int,end:int>>"


def escape(s: str) -> str:
    return _ESC.sub(lambda m: _OUT[m[0]], s)


def unescape(s: str) -> str:
    return _UNESC.sub(lambda m: _IN[m[0]], s)


_tokenizer = None
_counts: dict[str, int] = {}


def _count(written: str) -> int:
    """Tokens of a string. The tokenizer drops white space, so words are counted one by one and short ones kept."""
    global _tokenizer
    if _tokenizer is None:
        import public_tokenizers
        from tokenizers import Tokenizer

        _tokenizer = Tokenizer.from_file(str(public_tokenizers.path(TOKENIZER)))
    n = 0
    for w in _BLANK.split(written):
        got = _counts.get(w)
        if got is None:
            got = len(_tokenizer.encode(w, add_special_tokens=False).ids)
            if len(w) <= 64:
                if len(_counts) >= KEPT:
                    _counts.clear()
                _counts[w] = got
        n += got
    return n


def _written(role: str, text: str) -> str:
    """A turn of escaped role and text."""
    return f"<s>[INST]{role}[/INST]{text}</s>"


def tokens(s: str, role: str = "") -> int:
    """The tokens of a turn as it is written."""
    return _count(_written(escape(role), escape(s)))


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


class _Conversation:
    """Windows of one conversation, turn by turn."""

    def __init__(self, conv_id, budget: int, history: int) -> None:  # noqa: ANN001
        self.id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, str, int] | None = None
        self.past: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []
        self.repeats: list[tuple[str, str, int]] = []  # of the window at hand
        self.window = self.seen = 0
        self.sum = self.start = 0  # prefix sums of tokens: at the last turn, and where the window's new turns begin

    def _choose(self, first: int) -> list[tuple[str, str, int]]:
        """The system turn and the last turns of the past that fit beside a first new turn of so many tokens."""
        head = [self.system] if self.window and self.system else []
        if head and first <= self.budget and head[0][2] <= self.budget < first + head[0][2]:
            head = []
        room = min(self.history, self.budget - first - sum(x[2] for x in head))
        return head + _tail(self.past, room)

    def add(self, role: str, text: str) -> Iterator[tuple]:
        role, text = escape(role), escape(text)
        t = (role, text, _count(_written(role, text)))
        if self.new and self.sum + t[2] - self.start + sum(x[2] for x in self.repeats) > self.budget:
            yield self.flush()
        if not self.new:
            self.repeats = self._choose(t[2])
        if not self.seen and role == "system":
            self.system = t
        self.new.append(t)
        self.seen += 1
        self.sum += t[2]

    def flush(self) -> tuple:
        repeats = self.repeats
        parts, mask, at = [], [], 0
        for k, (role, text, _) in enumerate([*repeats, *self.new]):
            head = f"<s>[INST]{role}[/INST]"
            if k >= len(repeats) and role == "assistant":
                mask.append({"start": at + len(head), "end": at + len(head) + len(text)})
            parts.append(_written(role, text))
            at += len(parts[-1])
        row = (self.id, self.window, "".join(parts), len(repeats) + len(self.new), len(repeats), mask)
        own = [t for t in self.new if t is not self.system]
        self.past = _tail([*self.past, *own], self.history)
        self.new, self.start, self.window = [], self.sum, self.window + 1
        return row


def _tail(turns: list[tuple[str, str, int]], most: int) -> list[tuple[str, str, int]]:
    keep, cost = [], 0
    for t in reversed(turns):
        cost += t[2]
        if cost > most:
            break
        keep.append(t)
    return keep[::-1]


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows whose conv_id may be missing; it never passes through a floating-point number."""
    out = pd.DataFrame([r[1:] for r in rows], columns=names[1:])
    out.insert(0, names[0], pd.array([pd.NA if r[0] is None else r[0] for r in rows], dtype="Int64"))
    return out


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window; the windows of a conversation are consecutive rows of one partition."""
    ship(conversations)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, rows, size = None, [], 0
        names = [c.split()[0] for c in WINDOWS.split(", ")]
        for b in batches:
            for c, role, text in zip(b["id"], b["role"], b["text"]):
                c = None if c is None else int(c)
                if conv is None or conv.id != c:
                    if conv is not None:
                        rows.append(conv.flush())
                    conv = _Conversation(c, budget, history)
                for row in conv.add(role or "", text or ""):
                    rows.append(row)
                    size += len(row[2])
                if len(rows) >= 1000 or size > 8_000_000:
                    yield _frame(rows, names)
                    rows, size = [], 0
        if conv is not None:
            rows.append(conv.flush())
        if rows:
            yield _frame(rows, names)

    sorted_ = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    # as a string, or one missing id would turn all of a batch into floating-point numbers
    return sorted_.select(F.col("conv_id").cast("long").cast("string").alias("id"), "role", "text").mapInPandas(run, WINDOWS)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the windows gets back, a row a conversation; streams over ``windows``."""
    ship(formatted)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        names = [c.split()[0] for c in schema.split(", ")]
        done = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for b in batches:
            for c, text, skip, mask in zip(b["id"], b["text"], b["n_repeated"], b["mask"]):
                c = None if c is None else int(c)
                if now is None or now[0] != c:
                    if now is not None:
                        out.append(done(now))
                    now = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[skip:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for m in mask:
                    target = unescape(text[m["start"] : m["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(text)
            if out:
                yield _frame(out, names)
                out = []
        if now is not None:
            yield _frame([done(now)], names)

    return formatted.select(F.col("conv_id").cast("string").alias("id"), "text", "n_repeated", "mask").mapInPandas(run, schema)
