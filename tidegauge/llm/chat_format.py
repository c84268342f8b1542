"""Chat formatting in Spark expressions: sort collected turns, merge equal neighbours, concatenate.

The template writes a turn as ``### Role: text</turn>`` and a line end. Adjacent turns of one role
share a header, and ``<part/>`` stands between their texts, so the rows can be told apart again.
Inside texts and role names a backslash is doubled, and every control string gets a backslash
after its first character: no control string is left in them, and ``unescape`` restores them exactly.

A conversation is collected in two steps: rows of ``TURNS`` consecutive turn numbers become a
segment (sorted, merged and joined in its own task), then the segments of a conversation are put
in order. A long conversation is therefore never sorted, escaped or folded as a whole, and the work
on a segment stays bounded; the text of one conversation is one value of at most 2 GB by nature,
and ``segments`` are the rows for conversations beyond that.

The loss mask is a list of spans (start and length in code points, from 0) of each segment: the
escaped texts of the assistant, without headers, part marks and turn ends.

Defined cases: a null text is empty and so is a null role; a null turn comes first; rows alike in
``turn`` are ordered by role, then text, by their bytes; repeated rows are turns of their own; rows
without a conversation id form one conversation; an empty table gives an empty result. Only the four
columns named are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Turn numbers to a segment.
TURNS = 256


@dataclass(frozen=True)
class Template:
    """Control strings. None may hold a backslash, end as another begins, or be one character long."""

    open: str = "### "
    named: str = ": "
    part: str = "<part/>"
    close: str = "</turn>"
    after: str = "\n"
    loss_role: str = "assistant"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    #: Before the name of any other role.
    other: str = "role "

    def __post_init__(self) -> None:
        marks = (self.open, self.named, self.part, self.close)
        if any(len(m) < 2 or "\\" in m for m in marks):
            raise ValueError("a control string needs two characters and no backslash")
        if any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError("a control string may not end as one begins")
        if len(set(self.names.values())) < len(self.names) or any(n.startswith(self.other) or self.named in n for n in self.names.values()):
            raise ValueError("names of roles must differ from each other and from other roles")

    @property
    def end(self) -> str:
        return self.close + self.after

    def escape(self, text: Column, *more: str) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for mark in (self.open, self.part, self.close, *more):
            out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
        return out

    def header(self, role: Column) -> Column:
        name = F.concat(F.lit(self.other), self.escape(role, self.named))
        for known, shown in self.names.items():
            name = F.when(role == known, F.lit(shown)).otherwise(name)
        return F.concat(F.lit(self.open), name, F.lit(self.named))

    def role(self, name: Column) -> Column:
        """The role of a name as ``header`` writes it."""
        out = unescape(F.substring(name, len(self.other) + 1, 2**31 - 1))
        for known, shown in self.names.items():
            out = F.when(name == shown, F.lit(known)).otherwise(out)
        return out


TEMPLATE = Template()


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _merged(turns: Column) -> Column:
    """Adjacent turns of one role as one struct of the role and its texts."""
    kind = "array<struct<role:string,texts:array<string>>>"

    def step(done: Column, turn: Column) -> Column:
        last = F.element_at(done, -1)
        fresh = F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")))
        longer = F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts")))
        same = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), longer)).otherwise(F.concat(done, fresh))

    return F.aggregate(turns, F.array().cast(kind), step)


def _pieces(merged: Column, form: Template) -> Column:
    """The strings of a segment in order, each with whether it counts for the loss.

    The first header and the last turn's end are left to ``conversations``, which knows the neighbours.
    """

    def plain(s: Column) -> Column:
        return F.array(F.struct(s.alias("s"), F.lit(False).alias("loss")))

    def of_turn(turn: Column, i: Column) -> Column:
        def of_text(text: Column, k: Column) -> Column:
            own = F.array(F.struct(form.escape(text).alias("s"), (turn["role"] == form.loss_role).alias("loss")))
            return F.when(k > 0, F.concat(plain(F.lit(form.part)), own)).otherwise(own)

        texts = F.flatten(F.transform(turn["texts"], of_text))
        return F.when(i > 0, F.concat(plain(F.concat(F.lit(form.end), form.header(turn["role"]))), texts)).otherwise(texts)

    return F.flatten(F.transform(merged, of_turn))


def _spans(pieces: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(done: Column, piece: Column) -> Column:
        size = F.length(piece["s"]).cast("long")
        longer = F.concat(done["spans"], F.array(F.struct(done["at"].alias("start"), size.alias("length"))))
        return F.struct((done["at"] + size).alias("at"), F.when(piece["loss"], longer).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda done: done["spans"])


def _segments(chats: DataFrame, form: Template, turns: int, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = chats.select(
        F.col(conv_col).alias("conv_id"),
        F.floor(F.col(turn_col) / turns).alias("segment"),
        F.struct(F.col(turn_col).alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text")).alias("row"),
    )
    merged = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("row")).alias("rows")).withColumn("merged", _merged(F.col("rows")))
    pieces = merged.select(
        "conv_id",
        "segment",
        F.element_at("merged", 1)["role"].alias("first_role"),
        F.element_at("merged", -1)["role"].alias("last_role"),
        _pieces(F.col("merged"), form).alias("pieces"),
    )
    body = F.concat_ws("", F.transform("pieces", lambda p: p["s"]))
    return pieces.select("conv_id", "segment", "first_role", "last_role", body.alias("body"), _spans(F.col("pieces")).alias("spans"))


def conversations(
    chats: DataFrame,
    form: Template = TEMPLATE,
    turns: int = TURNS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """A row per conversation: conv_id, segments (each a ``formatted`` string and its loss ``spans``).

    The formatted conversation is the concatenation of its segments, ``formatted(segments)``.
    """
    parts = _segments(chats, form, turns, conv_col, turn_col, role_col, text_col)
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "first_role", "last_role", "body", "spans"))).alias("parts"))

    def closed(part: Column, i: Column) -> Column:
        before, behind = F.get("parts", i - 1)["last_role"], F.get("parts", i + 1)["first_role"]
        head = F.when(F.coalesce(before == part["first_role"], F.lit(False)), F.lit(form.part)).otherwise(form.header(part["first_role"]))
        tail = F.when(F.coalesce(behind == part["last_role"], F.lit(False)), F.lit("")).otherwise(F.lit(form.end))
        moved = F.transform(part["spans"], lambda s: F.struct((s["start"] + F.length(head)).alias("start"), s["length"].alias("length")))
        return F.struct(F.concat(head, part["body"], tail).alias("formatted"), moved.alias("spans"))

    return whole.select("conv_id", F.transform("parts", closed).alias("segments"))


def segments(chats: DataFrame, **settings) -> DataFrame:
    """conversations() with a row for each segment: conv_id, segment (from 0), formatted, spans."""
    return conversations(chats, **settings).select("conv_id", F.posexplode("segments").alias("segment", "s")).select("conv_id", "segment", "s.*")


def formatted(segments: str | Column) -> Column:
    return F.concat_ws("", F.transform(segments, lambda s: s["formatted"]))


def turns_of(text: Column, form: Template = TEMPLATE) -> Column:
    """The turns of a formatted conversation, read from its text alone: structs of role and text."""

    def of_turn(turn: Column) -> Column:
        bare = F.substring(turn, len(form.open) + 1, 2**31 - 1)
        name = F.substring_index(bare, form.named, 1)
        texts = F.split(F.substr(bare, F.length(name) + len(form.named) + 1), _literal(form.part), -1)
        role = form.role(name)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    whole = F.split(text, _literal(form.end), -1)
    return F.flatten(F.transform(F.slice(whole, F.lit(1), F.size(whole) - 1), of_turn))


def loss_texts(segments: str | Column) -> Column:
    """The unescaped texts under the loss mask, in order, read from the segments by their spans."""
    by_segment = F.transform(
        segments,
        lambda s: F.transform(s["spans"], lambda x: unescape(F.substr(s["formatted"], (x["start"] + 1).cast("int"), x["length"].cast("int")))),
    )
    return F.flatten(by_segment)


def _literal(mark: str) -> str:
    return f"\\Q{mark}\\E"


def digests(chats: DataFrame, form: Template = TEMPLATE, turns: int = TURNS) -> DataFrame:
    """What the formatted conversations say when read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = conversations(chats, form, turns).select("conv_id", "segments", formatted("segments").alias("formatted"))
    read = read.select(
        "conv_id", turns_of(F.col("formatted"), form).alias("turns"), F.concat_ws("", loss_texts("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")
    )
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
