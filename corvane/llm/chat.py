"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Rows are dealt by conversation and sorted by turn; a task streams over them and holds one turn at a time, so one very
long conversation costs no more memory than its longest turn. The machine checks the order of the roles and
emits text segments, each with its loss flag: what opens a turn, the turn's text, and what closes it. Control
strings inside texts are escaped: a backslash goes behind the first character of each, also where backslashes
already stand there, so that taking one away gives the text back.

`read_back` parses formatted segments, again as a stream, and gives the turns that they hold.

Defined cases: a null text counts as empty; a null role as the empty role; roles the template doesn't name are written by
name, never learned from, and break the order; a conversation whose order breaks is formatted all the same and flagged
(`valid` false from the turn on that breaks it); turns of equal number are ordered by role, then text, nulls first; repeated
rows are repeated turns; a null conv_id is a conversation; an empty table gives no segments; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import small_batches

SEGMENTS = "conv_id long, turn_index long, segment long, role string, kind string, text string, loss boolean, valid boolean"
BATCH_CHARS = 1 << 22


@dataclass(frozen=True)
class Role:
    opens: str
    closes: str
    learn: bool = False


@dataclass(frozen=True)
class Template:
    """Roles with the control strings around their texts; `order`: the roles that may follow each state."""

    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>", "<</SYS>>"),
            "user": Role("[INST]", "[/INST]"),
            "assistant": Role("<s>", "</s>", True),
        }
    )
    #: Around the text of a role the template doesn't name; the name, escaped, stands before the bar.
    other: tuple[str, str, str] = ("[ROLE]", "[ROLE|]", "[/ROLE]")
    pad: str = " "
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant", "user")

    def __post_init__(self):
        for a in self.controls:
            for b in self.controls:
                if len(a) < 2 or any(a[i:] == b[: len(a) - i] for i in range(1, len(a))) or (a != b and a in b):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap; escapes could not be told apart")
            if "\\" in a:
                raise ValueError("a control string holds the escape")

    @property
    def controls(self) -> tuple[str, ...]:
        return (*(x for r in self.roles.values() for x in (r.opens, r.closes)), *self.other)

    def compiled(self) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
        parts = sorted(self.controls, key=len, reverse=True)
        body = lambda n: "|".join(rf"{re.escape(c[0])}\\{n}{re.escape(c[1:])}" for c in parts)
        return re.compile(body("*")), re.compile(body("+")), re.compile("|".join(map(re.escape, parts)))


def escape(text: str, found: re.Pattern) -> str:
    return found.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str, found: re.Pattern) -> str:
    return found.sub(lambda m: m[0][0] + m[0][2:], text)


def formatted(conversations: DataFrame, template: Template | None = None, partitions: int | None = None) -> DataFrame:
    """The segments of all conversations; those of one lie together, in order, in one partition."""
    template = template or Template()
    spark = conversations.sparkSession
    small_batches(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        import pyarrow as pa

        names = ("conv_id", "turn_index", "segment", "role", "kind", "text", "loss", "valid")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
        to_escape = template.compiled()[0]
        last, state, valid, index, segment, rows, size = (), "", True, 0, 0, [], 0
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names=list(names))
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                role, text = role or "", text or ""
                if last != (conv,):
                    last, state, valid, index, segment = (conv,), "", True, 0, 0
                valid = valid and role in template.order.get(state, ())
                state = role
                if known := template.roles.get(role):
                    opens, closes, learn = known.opens + template.pad, template.pad + known.closes, known.learn
                else:
                    start, bar, end = template.other
                    opens, closes, learn = start + escape(role, to_escape) + bar + template.pad, template.pad + end, False
                for kind, part, loss in (("open", opens, False), ("text", escape(text, to_escape), learn), ("close", closes, False)):
                    rows.append((conv, index, segment, role, kind, part, loss, valid))
                    segment += 1
                    size += len(part) + 64
                index += 1
                if size > BATCH_CHARS:
                    yield batch_of()
                    rows, size = [], 0
        yield batch_of()

    return turns.mapInArrow(run, SEGMENTS)


class Reader:
    """Takes formatted text with its loss flags, piece by piece, and gives the turns it holds."""

    def __init__(self, template: Template):
        self.template = template
        _, self.escaped, self.control = template.compiled()
        self.opens = {r.opens: name for name, r in template.roles.items()}
        self.closes = {r.closes for r in template.roles.values()} | {template.other[2]}
        self.role: str | None = None
        self.text: list[str] = []
        self.learned: list[str] = []
        self.naming = False

    def feed(self, text: str, loss: bool):
        """Yields (role, text, learned text) of each turn that ends here."""
        at = 0
        for m in self.control.finditer(text):
            self._take(text[at : m.start()], loss)
            at, c = m.end(), m[0]
            if self.naming and c == self.template.other[1]:
                self.role, self.text, self.naming = unescape("".join(self.text), self.escaped), [], False
            elif self.role is None and not self.naming and c in self.opens:
                self.role, self.text = self.opens[c], []
            elif self.role is None and not self.naming and c == self.template.other[0]:
                self.naming, self.text = True, []
            elif self.role is not None and c in self.closes:
                pad = len(self.template.pad)
                whole = "".join(self.text)
                yield self.role, unescape(whole[pad : len(whole) - pad], self.escaped), unescape("".join(self.learned), self.escaped)
                self.role, self.text, self.learned = None, [], []
            else:
                raise ValueError(f"{c!r} out of place in formatted text")
        self._take(text[at:], loss)

    def _take(self, part: str, loss: bool) -> None:
        self.text.append(part)
        if loss:
            self.learned.append(part)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """From `formatted` segments, as they lie: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    template = template or Template()

    def run(batches):
        import pyarrow as pa

        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        last, rows = (), []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=list(names))
        done = lambda: (last[0], n, turns.hexdigest(), learned, loss_hash.hexdigest(), chars, valid)
        for batch in batches:
            for conv, text, loss, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid"))):
                if last != (conv,):
                    if last:
                        rows.append(done())
                    last, n, turns, learned, loss_hash, chars, valid, reader = (conv,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, Reader(template)
                chars += len(text)
                valid = ok
                for role, whole, part in reader.feed(text, loss):
                    n += 1
                    turns.update(f"{role}\n{whole}\n".encode("utf-8", "surrogatepass"))
                    learned += len(part)
                    loss_hash.update(part.encode("utf-8", "surrogatepass"))
            if len(rows) >= 5000:
                yield batch_of()
                rows = []
        if last:
            rows.append(done())
        yield batch_of()

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
