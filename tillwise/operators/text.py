"""Structure of written insights: sections of a text, and its line-by-line outline.

Everything happens inside one row with native array functions; nothing is
shuffled, and a text of any length is processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.strings import strip, without_bold

LONGEST_HEADER = 80

# While an outline is built, the blocks of a text sit in one string, each opened by MARK and the letter of its kind.
# A MARK in the text itself is followed by KEEP instead, so the two cannot be confused.
MARK, KEEP = "\x1e", "k"
HEADING, BULLET, BLANK, PARAGRAPH = "H", "L", "B", "P"
NUMBERED_BOLD = r"(?Us)^\d+\.\s+\*\*(.+?)\*\*(.*)$"


def _header(text: Column) -> Column:
    """``**Header**: body`` or ``Header: body`` as a struct; NULL where there is neither.

    A bold header runs from the first ``**`` to the next ``**:``. A plain one
    is what precedes the first colon, if shorter than 80 characters and without
    a full stop.
    """
    opening = F.instr(text, "**")
    closing = F.locate("**:", text, 1)
    # The closing mark is searched from the opening one on; they may be the same two stars.
    bold = F.when(
        closing > 0,
        F.struct(
            strip(F.substr(text, opening + 2, F.greatest(closing - opening - 2, F.lit(0)))).alias("header"),
            strip(F.substr(text, closing + 3)).alias("body"),
        ),
    )
    colon = F.instr(text, ":")
    before = strip(F.substr(text, F.lit(1), colon - 1))
    plain = F.when(
        (colon > 0) & (F.char_length(before) < LONGEST_HEADER) & ~F.contains(before, F.lit(".")),
        F.struct(without_bold(before).alias("header"), strip(F.substr(text, colon + 1)).alias("body")),
    )
    return F.coalesce(bold, plain)


def text_sections(df: DataFrame, *keys: str, text: str = "text", separator: str = "\n\n") -> DataFrame:
    """One row per non-empty paragraph: its kind, number, header and body.

    ``numbered`` starts with ``1.`` to ``5.``; ``bullet`` with ``-``, ``•`` or
    ``*``; anything else is ``plain``, also a paragraph that starts in bold.
    Without a header the bold marks are taken out of the body.
    """
    parts = F.transform(F.split(F.col(text), _literal(separator)), strip)
    paragraphs = df.select(*keys, F.posexplode(F.filter(parts, lambda p: p != "")).alias("_at", "paragraph"))
    paragraph = F.col("paragraph")
    numbered = paragraph.rlike(r"^[1-5]\.")
    bullet = paragraph.rlike(r"^[-•*]") & ~F.startswith(paragraph, F.lit("**"))
    content = (
        F.when(numbered, strip(F.substr(paragraph, F.lit(3))))
        .when(bullet, strip(F.substr(paragraph, F.lit(2))))
        .otherwise(paragraph)
    )
    return (
        paragraphs.withColumns(
            {
                "section_no": F.col("_at") + 1,
                "kind": F.when(numbered, "numbered").when(bullet, "bullet").otherwise("plain"),
                "number": F.when(numbered, F.substr(paragraph, F.lit(1), F.lit(1)).cast("int")),
                "_content": content,
            }
        )
        .withColumn("_found", _header(F.col("_content")))
        .select(
            *keys,
            "section_no",
            "kind",
            "number",
            F.col("_found.header").alias("header"),
            F.coalesce("_found.body", without_bold(F.col("_content"))).alias("body"),
        )
    )


def _literal(separator: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in separator)


def text_outline(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per block of a text: ``heading``, ``bullet`` or ``paragraph``.

    A line like ``2. **Title** rest`` is a heading, and the rest opens a
    paragraph; ``- item`` is a bullet; other lines up to the next blank line,
    heading or bullet form one paragraph. ``starts_list`` marks the first of a
    run of bullets. A numbered line whose bold mark is never closed stays text.
    """
    lines = F.split(strip(F.col(text)), "\n")
    joined = F.array_join(F.transform(lines, lambda line: _piece(strip(line))), "")
    cut = F.split(F.concat(F.lit(MARK + PARAGRAPH), joined), f"{MARK}(?=[{HEADING}{BULLET}{BLANK}{PARAGRAPH}])")
    blocks = F.transform(
        F.filter(cut, lambda b: b != ""),
        lambda b: F.struct(
            F.substr(b, F.lit(1), F.lit(1)).alias("kind"),
            strip(F.replace(F.substr(b, F.lit(2)), F.lit(MARK + KEEP), F.lit(MARK))).alias("content"),
        ),
    )
    filled = F.filter(blocks, lambda b: (b["kind"] != PARAGRAPH) | (b["content"] != ""))
    # Blank lines only matter for where a list starts; they are not blocks themselves.
    seen = F.transform(
        "_blocks",
        lambda b, i: F.struct(
            b["kind"].alias("kind"),
            b["content"].alias("content"),
            F.when(i > 0, F.get("_blocks", i - 1)["kind"]).alias("previous"),
        ),
    )
    named = df.select(*keys, filled.alias("_blocks")).select(
        *keys, F.posexplode(F.filter(seen, lambda b: b["kind"] != BLANK)).alias("_at", "_block")
    )
    kind = F.col("_block.kind")
    return named.select(
        *keys,
        (F.col("_at") + 1).alias("block_no"),
        F.when(kind == HEADING, "heading").when(kind == BULLET, "bullet").otherwise("paragraph").alias("kind"),
        F.col("_block.content").alias("content"),
        ((kind == BULLET) & ~F.col("_block.previous").eqNullSafe(BULLET)).alias("starts_list"),
    )


def _piece(line: Column) -> Column:
    """What one stripped line adds to the string of blocks."""
    title = F.regexp_extract(line, NUMBERED_BOLD, 1)
    rest = strip(F.regexp_extract(line, NUMBERED_BOLD, 2))
    return (
        F.when(line == "", F.lit(MARK + BLANK + MARK + PARAGRAPH))
        .when(
            title != "",
            # What follows a heading is taken as it is, bold marks and all.
            F.concat(F.lit(MARK + HEADING), _escaped(title), F.lit(MARK + PARAGRAPH), _escaped(rest), F.lit(" ")),
        )
        .when(
            F.startswith(line, F.lit("-")),
            F.concat(F.lit(MARK + BULLET), _escaped(_unbold(F.substr(line, F.lit(2)))), F.lit(MARK + PARAGRAPH)),
        )
        .otherwise(_running(line))
    )


def _running(line: Column) -> Column:
    return F.concat(_escaped(_unbold(line)), F.lit(" "))


def _unbold(line: Column) -> Column:
    return F.regexp_replace(line, r"(?s)\*\*(.+?)\*\*", "$1")


def _escaped(content: Column) -> Column:
    return F.replace(content, F.lit(MARK), F.lit(MARK + KEEP))
