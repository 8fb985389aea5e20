"""Conversations with typed parts as one text with marked turns, and back.

A turn's content is an array of parts: text, image, audio or document. A
visitor has one method per kind, which says how such a part is written and how
many tokens its placeholder stands for; ``flattened`` sends every part of a turn
through it and keeps what comes back in order. Attachments leave their
reference, their turn and their token count beside the text.

Control strings inside a text are escaped by a mark after their first character
(``<|end|>`` becomes ``<\\|end|>``), and one that is escaped already gets one
more, so taking one mark away from each restores any text. Nothing that a turn
says can open, close or fake a turn.

Turns are written row by row; a shuffle by conversation then orders them, sums
their lengths and joins them. A conversation is one row of the output, so it has
to fit into a row; nothing else is gathered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tamis.llm.text import arrow_map, named, utf8

MARK = "\\"  # put after the first character of a control string in a text
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class Template:
    """Strings that mark turns and parts, and others that texts must not hold unescaped.

    Every control string has two characters at least, the first character of
    any is nowhere else in any, and none holds the mark. That makes the escape
    reversible, and is checked.
    """

    start: str = "<|start|>"
    body: str = "<|message|>"
    end: str = "<|end|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    others: tuple[str, ...] = ("<s>", "</s>", "<pad>", "<unk>", "[INST]", "[/INST]", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
    rests: dict[str, list[str]] = field(init=False, compare=False)

    def __post_init__(self):
        strings = [self.start, self.body, self.end, *self.placeholders.values(), *self.others]
        firsts = {s[:1] for s in strings}
        wrong = [s for s in strings if len(s) < 2 or MARK in s or firsts & set(s[1:])]
        if wrong or len(set(strings)) < len(strings):
            raise ValueError(f"control strings that cannot be escaped reversibly: {wrong or 'some are equal'}")
        object.__setattr__(self, "rests", {f: sorted(s[1:] for s in strings if s[0] == f) for f in sorted(firsts)})

    @property
    def placeholders(self) -> dict[str, str]:
        return {"image": self.image, "audio": self.audio, "document": self.document}

    def control_pattern(self) -> str:
        """Control strings, escaped any number of times."""
        marks = f"(?:{re.escape(MARK)})*"
        return "|".join(f"{re.escape(f)}{marks}(?:{'|'.join(map(re.escape, r))})" for f, r in self.rests.items())

    def _behind_firsts(self, taken: str) -> str:
        marks = f"(?:{re.escape(MARK)})*"
        each = (f"(?<={re.escape(f)}){taken}(?={marks}(?:{'|'.join(map(re.escape, r))}))" for f, r in self.rests.items())
        return "|".join(each)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._behind_firsts(""), re.escape(MARK))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._behind_firsts(re.escape(MARK)), "")


class PartVisitor:
    """What is written for a part, by its kind, and the tokens that its placeholder stands for.

    Override a method for another size rule. Nulls in what a rule needs count
    as zero, so such an attachment stands for no token.
    """

    def __init__(self, template: Template, patch: int = 28, tokens_per_second: float = 25.0, tokens_per_page: int = 1024):
        self.template, self.patch = template, patch
        self.tokens_per_second, self.tokens_per_page = tokens_per_second, tokens_per_page

    def text(self, part: Column) -> Column:
        return self.plain(part["text"])

    def plain(self, text: Column) -> Column:
        """A text by itself, as the content of a turn that has no other part."""
        return self._made(self.template.escape(F.coalesce(text, F.lit(""))))

    def image(self, part: Column) -> Column:
        tiles = [F.ceil(F.coalesce(part[side], F.lit(0)) / self.patch) for side in ("width", "height")]
        return self._attached(part, "image", tiles[0] * tiles[1])

    def audio(self, part: Column) -> Column:
        return self._attached(part, "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.tokens_per_second))

    def document(self, part: Column) -> Column:
        return self._attached(part, "document", F.coalesce(part["pages"], F.lit(0)) * self.tokens_per_page)

    def _attached(self, part: Column, kind: str, n_tokens: Column) -> Column:
        return self._made(F.lit(self.template.placeholders[kind]), F.lit(kind), part["ref"], n_tokens)

    def _made(self, shown: Column, *attachment: Column) -> Column:
        kind, ref, n_tokens = attachment or (F.lit(None), F.lit(None), F.lit(None))
        return F.struct(
            shown.alias("shown"),
            kind.cast("string").alias("kind"),
            ref.cast("string").alias("ref"),
            n_tokens.cast("bigint").alias("n_tokens"),
        )

    def visit(self, part: Column) -> Column:
        """A part of no known kind is read as text."""
        kind = part["kind"]
        cases = F.when(kind == "image", self.image(part)).when(kind == "audio", self.audio(part))
        return cases.when(kind == "document", self.document(part)).otherwise(self.text(part))


def flattened(content: Column, visitor: PartVisitor) -> Column:
    """A turn's parts in order: what is written, and kind, ref and n_tokens of attachments."""
    return F.transform(content, visitor.visit)


def format_conversations(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    content_col: str = "content",
    learn: tuple[str, ...] = ("assistant",),
    template: Template = Template(),
    visitor: PartVisitor | None = None,
) -> DataFrame:
    """One row per conversation: ``id_col, formatted, loss, attachments, n_tokens``.

    ``content_col`` holds a text, or an array of parts (``PART``). ``formatted``
    is the whole conversation; ``loss`` the spans ``start, end`` (code points)
    of what the roles in ``learn`` say, without their markers; ``attachments``
    the placeholders in their order with kind, ref, turn (from 1) and tokens;
    ``n_tokens`` the sum of those. Turns are ordered by ``turn_col`` (nulls
    first), equal ones by what is written for them; repeated rows are turns of
    their own. A null text, content or role is empty, a null role learns
    nothing. Rows without an id are one conversation with a null id. An empty
    table gives an empty table; other columns are ignored, whatever their names.
    """
    visitor = visitor or PartVisitor(template)
    content = F.col(content_col)
    if turns.schema[content_col].dataType.typeName() == "array":
        parts = flattened(content, visitor)
    else:
        parts = F.array(visitor.plain(content))
    rows = turns.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).alias("turn"),
        F.concat(F.lit(template.start), template.escape(F.coalesce(role_col, F.lit(""))), F.lit(template.body)).alias("head"),
        F.coalesce(F.col(role_col).isin(*learn), F.lit(False)).alias("learnt"),
        F.coalesce(parts, F.array().cast("array<struct<shown:string,kind:string,ref:string,n_tokens:bigint>>")).alias("parts"),
    ).select(
        "id",
        "turn",
        "learnt",
        F.length("head").alias("before"),
        F.concat("head", F.array_join(F.col("parts")["shown"], ""), F.lit(template.end)).alias("piece"),
        F.transform(
            F.filter("parts", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"], p["ref"], p["n_tokens"])
        ).alias("attached"),
    )
    order = W.partitionBy("id").orderBy(F.col("turn").asc_nulls_first(), "piece")
    ahead = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1))
    placed = rows.select(
        "*", F.row_number().over(order).cast("long").alias("place"), F.coalesce(ahead, F.lit(0)).alias("ahead")
    )
    start = F.col("ahead") + F.col("before")
    end = F.col("ahead") + F.length("piece") - len(template.end)
    joined = placed.groupBy("id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "place", "piece", "attached", F.when(F.col("learnt"), F.struct(start.alias("start"), end.alias("end"))).alias("span")
                )
            )
        ).alias("turns")
    )
    attachments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.transform(
                t["attached"],
                lambda a: F.struct(
                    a["kind"].alias("kind"), a["ref"].alias("ref"), t["place"].alias("turn"), a["n_tokens"].alias("n_tokens")
                ),
            ),
        )
    )
    return joined.select(
        F.col("id").alias(id_col),
        F.array_join(F.col("turns")["piece"], "").alias("formatted"),
        F.filter(F.col("turns")["span"], lambda s: s.isNotNull()).alias("loss"),
        attachments.alias("attachments"),
    ).withColumn("n_tokens", F.aggregate(F.col("attachments")["n_tokens"], F.lit(0).cast("long"), lambda a, n: a + F.coalesce(n, F.lit(0))))


def read_turns(formatted: Column, attachments: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation: ``role, content``, content as ``kind, text, ref`` of its parts.

    Texts that stood side by side come back as one, empty ones not at all.
    """
    pattern = "|".join(map(re.escape, template.placeholders.values()))
    kinds = F.create_map(*[F.lit(x) for kind, mark in template.placeholders.items() for x in (mark, kind)])

    def turn(raw: Column, at: Column) -> Column:
        said = F.substring_index(raw, template.body, -1)
        said = F.substring(said, F.lit(1), F.length(said) - len(template.end))
        marks = F.regexp_extract_all(said, F.lit(f"({pattern})"))
        own = F.filter(attachments, lambda a: a["turn"] == at + 1)
        shape = "struct<kind:string,text:string,ref:string>"
        texts = F.transform(
            F.split(said, pattern), lambda t: F.struct(F.lit("text"), template.unescape(t), F.lit(None).cast("string")).cast(shape)
        )
        others = F.transform(
            F.arrays_zip(marks.alias("mark"), own["ref"].alias("ref")),
            lambda z: F.struct(kinds[z["mark"]], F.lit(None).cast("string"), z["ref"]).cast(shape),
        )
        pairs = F.flatten(F.zip_with(texts, others, lambda t, o: F.array(t, o)))
        parts = F.filter(pairs, lambda p: p["kind"].isNotNull() & ~((p["kind"] == "text") & (p["text"] == "")))
        return F.struct(template.unescape(F.substring_index(raw, template.body, 1)).alias("role"), parts.alias("content"))

    raw = F.split(formatted, re.escape(template.start))
    return F.transform(F.slice(raw, F.lit(2), F.size(raw)), turn)


def said_text(content: Column) -> Column:
    """The text of a turn's content, attachments left out."""
    return F.array_join(F.filter(content["text"], lambda t: t.isNotNull()), "")


def learnt_texts(formatted: DataFrame, template: Template = Template(), name: str = "learnt") -> DataFrame:
    """Add the texts under the loss mask, one per span, unescaped."""
    body, raw = named(formatted, "body"), named(formatted, "raw")
    keep = formatted.columns

    def each(chunk) -> dict:
        texts, spans = chunk.column(body).to_pylist(), chunk.column("loss").to_pylist()
        cut = []
        for text, own in zip(texts, spans, strict=True):
            text = text.decode("utf-8", "replace")
            cut.append([text[s["start"] : s["end"]] for s in own])
        return {raw: pa.array(cut, pa.list_(pa.string()))}

    rows = formatted.withColumn(body, utf8(F.col("formatted")))
    cut = arrow_map(rows, each, f"`{raw}` array<string>", body, keep)
    return cut.select(*keep, F.transform(raw, template.unescape).alias(name))
