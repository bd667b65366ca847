"""Chat formatting by a finite-state machine over roles.

A declarative template gives each role a header and an end mark, says which role may follow which, and which texts bear
loss. The machine walks a conversation's rows by turn, checks the order of roles and emits text segments, each with its
loss flag. Control strings inside texts get an escape character, so the formatted text reads back to the very turns.

The rows of a conversation are sorted, not gathered: a task streams them and holds one turn (and a running hash) at a
time, so a conversation of any length fits. Its digests are sequential by definition and come from one pass.

Rows: a null text or role counts as empty, a null turn comes first, rows of equal turn go by role and text, repeated
rows are turns of their own, and rows with a null conv_id make up one conversation; an empty table gives no rows. Roles
the template does not name get a general header, and orders it does not allow are formatted all the same and flagged.
The results carry the columns named here, so other columns of the input cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class Template:
    """Headers by role, a header for all others, an end mark, the escape character and the order of roles."""

    headers: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Role "
    close: str = ": "
    end: str = " </turn>\n"
    escape: str = "\\"
    #: What must not stand unescaped in a text: the marks that begin a header and end a turn.
    controls: tuple[str, ...] = ("###", "</turn>")
    loss: frozenset[str] = frozenset({"assistant"})
    #: The machine: for each state (the last role; START) the roles that may come.
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {START: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    final: frozenset[str] = frozenset({"assistant"})

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, self.escape * 2)
        for control in self.controls:
            text = text.replace(control, self.escape + control)
        return text

    def unescaped(self, text: str) -> str:
        marks = "|".join(map(re.escape, (self.escape, *self.controls)))
        return re.sub(re.escape(self.escape) + f"({marks})", r"\1", text)

    def step(self, state: str | None, role: str) -> str | None:
        """The machine's next state; None, for good, once a role may not come."""
        return role if state is not None and role in self.follows.get(state, ()) else None

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn as (text, loss) segments."""
        header = self.headers.get(role)
        if header is None:
            header = self.other + self.escaped(role).replace(self.close, self.escape + self.close) + self.close
        return [(header, False), (self.escaped(text), role in self.loss), (self.end, False)]

    def read(self, segments: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, str]]:
        """Turns read back from formatted text, given in any pieces with their flags: role, text, text under loss."""
        end, held, flags = self.end, "", []
        for piece, loss in segments:
            held += piece
            flags.append((len(piece), loss))
            while (cut := self._end(held)) >= 0:
                body, held = held[:cut], held[cut + len(end) :]
                marked, at, rest = [], 0, []
                for n, flag in flags:
                    upto = at + n
                    if flag and at < cut:
                        marked.append(body[at : min(upto, cut)])
                    if upto > cut + len(end):
                        rest.append((upto - max(at, cut + len(end)), flag))
                    at = upto
                flags = rest
                role, text = self._turn(body)
                yield role, text, self.unescaped("".join(marked))
        if held:
            raise ValueError("text after the last end mark")

    def _end(self, text: str) -> int:
        """Where the first end mark stands that is not escaped."""
        mark = next(c for c in self.controls if c in self.end)
        lead = self.end.index(mark)
        at = text.find(self.end)
        while at >= 0:
            i = at + lead
            n = 0
            while i - n > 0 and text[i - n - 1] == self.escape:
                n += 1
            if n % 2 == 0:
                return at
            at = text.find(self.end, at + 1)
        return -1

    def _turn(self, body: str) -> tuple[str, str]:
        for role, header in self.headers.items():
            if body.startswith(header):
                return role, self.unescaped(body[len(header) :])
        if not body.startswith(self.other):
            raise ValueError("no header")
        own = re.escape(self.escape)
        m = re.match(rf"((?:{own}.|[^{own}])*?){re.escape(self.close)}", body[len(self.other) :], re.S)
        if m is None:
            raise ValueError("no end of a header")
        role = self.unescaped(m[1].replace(self.escape + self.close, self.close))
        return role, self.unescaped(body[len(self.other) + m.end() :])


SEGMENTS = "conv_id long, turn long, part int, role string, segment string, loss boolean, in_order boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _sorted(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    df = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """SEGMENTS in order within each partition: the formatted text of every turn in parts, with loss flags.

    `in_order` says whether the machine allowed the conversation up to that turn.
    """
    made = template or Template()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(batch["conv_id"].array, batch["turn"].array, batch["role"], batch["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if conv != at:
                    at, state = conv, START
                state = made.step(state, role)
                for part, (segment, loss) in enumerate(made.segments(role, text)):
                    rows.append((conv, None if pd.isna(turn) else int(turn), part, role, segment, loss, state is not None))
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "part", "role", "segment", "loss", "in_order"])
            yield out.astype({"conv_id": "Int64", "turn": "Int64"})

    return _sorted(conversations).mapInPandas(run, SEGMENTS)


def digest_chats(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """DIGESTS of the output of format_chats, read back from its text and flags as a stream. Its order must be kept."""
    made = template or Template()

    class Chat:
        """One conversation's running digests; it holds the segments of the turn that is open."""

        def __init__(self, conv: int | None):
            self.conv, self.turns, self.chars, self.loss = conv, 0, 0, 0
            self.all, self.marked, self.open, self.ok, self.last = hashlib.sha256(), hashlib.sha256(), [], True, START

        def add(self, segment: str, loss: bool, in_order: bool) -> None:
            self.chars += len(segment)
            self.ok &= in_order
            self.open.append((segment, loss))
            if segment.endswith(made.end) and not loss:
                for role, text, marked in made.read(self.open):
                    self.turns += 1
                    self.last = role
                    self.all.update(f"{role}\n{text}\n".encode())
                    self.marked.update(marked.encode())
                    self.loss += len(marked)
                self.open = []

        def row(self) -> tuple:
            return self.conv, self.turns, self.all.hexdigest(), self.loss, self.marked.hexdigest(), self.chars, self.ok and self.last in made.final

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat, names = None, [c.split()[0] for c in DIGESTS.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
        for batch in batches:
            rows = []
            for conv, segment, loss, in_order in zip(batch["conv_id"].array, batch["segment"], batch["loss"], batch["in_order"]):
                conv = None if pd.isna(conv) else int(conv)
                if chat is None or conv != chat.conv:
                    if chat:
                        rows.append(chat.row())
                    chat = Chat(conv)
                chat.add(segment, bool(loss), bool(in_order))
            yield frame(rows)
        if chat:
            yield frame([chat.row()])

    return segments.mapInPandas(run, DIGESTS)
