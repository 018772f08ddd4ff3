"""Pages to typed chunks: section headers, table text, block filter and the chunker.

pages: page_no, text, and from a layout extractor blocks array<struct<x0,y0,x1,y1,text>> and
tables array<array<array<string>>>. Reading PDF files is a provider's task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens
from .analysis import bind

CHUNK_TOKENS = 400


def section_header(text: Column) -> Column:
    """struct(section_no, section_title) from the first 15 lines: ``Sec n`` and a title line, or
    ``Sec``, number and title on three lines; the first line that fits decides."""

    def found(lines):
        at = lambda i: F.get(lines, i)
        number = lambda s: F.when(F.trim(s).rlike(r"^[+-]?[0-9]+$"), F.trim(s).try_cast("int"))

        def header(line, i):
            one = F.when(line.startswith("Sec "), number(F.replace(line, F.lit("Sec "), F.lit(""))))
            three = F.when((F.trim(line) == "Sec") & ~line.startswith("Sec ") & at(i + 2).isNotNull(), number(at(i + 1)))
            return F.when(one.isNotNull(), F.struct(one.alias("section_no"), F.trim(at(i + 1)).alias("section_title"))).when(three.isNotNull(), F.struct(three.alias("section_no"), F.trim(at(i + 2)).alias("section_title")))

        return F.get(F.filter(F.transform(F.slice(lines, 1, 15), header), lambda h: h.isNotNull()), F.lit(0))

    return bind(F.split(F.coalesce(text, F.lit("")), "\n"), found)


def table_texts(text: Column, tables: Column) -> Column:
    """array(struct(table_no, text)): rows as cells joined by `` | ``; the k-th table takes the k-th ``Table n.n``."""
    titles = F.regexp_extract_all(text, F.lit(r"Table\s+([0-9]+\.[0-9]+)"), F.lit(1))
    cell = lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\x00"), F.lit("")))
    row = lambda r: F.array_join(F.transform(r, cell), " | ")
    made = F.transform(tables, lambda t, i: F.struct(F.get(titles, i).alias("table_no"), F.array_join(F.transform(t, row), "\n").alias("text")))
    return F.filter(made, lambda t: t["text"] != "")


def narrative(blocks: Column, boxes: Column, header_words: list[str], footer_words: list[str]) -> Column:
    """Text of the blocks from top to bottom without headers, footers and blocks that lie for
    more than half of their area in a table's box; a header's letter line leads."""

    def covered(b):
        def share(t):
            wide = F.least(b["x1"], t["x1"]) - F.greatest(b["x0"], t["x0"])
            high = F.least(b["y1"], t["y1"]) - F.greatest(b["y0"], t["y0"])
            area = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
            return (wide > 0) & (high > 0) & (F.try_divide(wide * high, area) > 0.5)

        return F.exists(boxes, lambda t: F.coalesce(share(t), F.lit(False)))

    holds = lambda text, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))
    footer = lambda text: holds(text, footer_words) | text.rlike(r"^Page\s+[0-9]")
    ordered = F.transform(F.array_sort(F.transform(blocks, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b["x1"].alias("x1"), b["y1"].alias("y1"), F.trim(b["text"]).alias("text")))), lambda b: b)
    some = F.filter(ordered, lambda b: (b["text"] != "") & ~footer(b["text"]))

    def join(rows):
        headers = F.filter(rows, lambda b: holds(b["text"], header_words))
        letter = F.regexp_extract(F.coalesce(F.element_at(F.transform(headers, lambda b: b["text"]), F.lit(-1)), F.lit("")), r"\n([A-Z])\.\s*$", 1)
        body = F.transform(F.filter(rows, lambda b: ~holds(b["text"], header_words) & ~covered(b)), lambda b: b["text"])
        text = F.array_join(body, "\n")
        return F.replace(F.when((letter != "") & (F.size(body) > 0), F.concat(letter, F.lit(".\n"), text)).otherwise(text), F.lit("\x00"), F.lit(""))

    return bind(some, join)


def is_formula(text: Column) -> Column:
    """Holds ``where`` and a line under 80 characters with an equals sign."""
    short = F.exists(F.split(text, "\n"), lambda x: x.contains("=") & (F.length(F.trim(x)) < 80))
    return F.lower(text).contains("where") & short


def context_header(section: Column, title: Column, paragraph: Column, table: Column | None = None) -> Column:
    start = F.concat(F.lit("[Sec "), section.cast("string"), F.lit(" "), F.coalesce(title, F.lit("None")))
    tail = F.when(F.coalesce(paragraph, F.lit("")) != "", F.concat(F.lit(" | "), paragraph)).otherwise(F.lit(""))
    if table is not None:
        tail = F.when(F.coalesce(table, F.lit("")) != "", F.concat(F.lit(" | Table "), table)).otherwise(F.lit(""))
    return F.concat(start, tail, F.lit("]"))


#: State of the fold over a page's lines.
STATE = "struct<text:string,paragraph:string,first:string,major:string,done:array<struct<text:string,paragraph:string>>>"
MAJOR, PARAGRAPH = r"^[A-Z]\.$", r"^[0-9]+(\.[A-Za-z0-9]+)*$"


def split_page(text: Column, limit: int = CHUNK_TOKENS) -> Column:
    """array(struct(text, paragraph)): a heading closes a chunk that is over the limit.

    One fold over the lines in the JVM; a chunk keeps its first paragraph id.
    """

    def line_step(s, raw):
        def step(line):
            major, para = line.rlike(MAJOR), line.rlike(PARAGRAPH)
            close = (major | para) & (estimated_tokens(s["text"]) > limit)
            closed = F.struct(s["text"].alias("text"), F.coalesce(s["first"], s["paragraph"]).alias("paragraph"))
            text = F.when(close, F.lit("")).otherwise(s["text"])
            first = F.when(close, F.lit(None).cast("string")).otherwise(s["first"])
            letter = F.when(major, F.left(line, F.lit(1))).otherwise(s["major"])
            paragraph = F.when(para & ~major, F.when(s["major"] != "", F.concat(s["major"], F.lit("."), line)).otherwise(line)).otherwise(s["paragraph"])
            first = F.when(para & ~major, F.coalesce(first, paragraph)).otherwise(first)
            return F.struct(
                F.when(text == "", line).otherwise(F.concat(text, F.lit("\n"), line)).alias("text"),
                paragraph.alias("paragraph"),
                first.alias("first"),
                letter.alias("major"),
                F.when(close, F.concat(s["done"], F.array(closed))).otherwise(s["done"]).alias("done"),
            ).cast(STATE)

        return bind(raw, step)

    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    none = F.lit(None).cast("string")
    start = F.struct(F.lit("").alias("text"), none.alias("paragraph"), none.alias("first"), F.lit("").alias("major"), F.array().cast("array<struct<text:string,paragraph:string>>").alias("done")).cast(STATE)
    last = lambda s: F.struct(s["text"].alias("text"), F.coalesce(s["first"], s["paragraph"]).alias("paragraph"))
    return F.aggregate(lines, start, line_step, lambda s: F.when(s["text"] != "", F.concat(s["done"], F.array(last(s)))).otherwise(s["done"]))


def chunk_pages(pages: DataFrame, limit: int = CHUNK_TOKENS) -> DataFrame:
    """pages (page_no, section_no, section_title, text, tables array<struct<table_no,text>>) -> chunks.

    Pages without a section give none. Tables come first, each a chunk; chunks stay within pages.
    """
    kept = pages.where(F.col("section_no").isNotNull() & (F.col("section_no") != 0))
    title = F.coalesce("section_title", F.lit(""))
    tables = F.transform(
        F.coalesce("tables", F.array().cast("array<struct<table_no:string,text:string>>")),
        lambda t: F.struct(F.lit("table").alias("content_type"), F.lit(None).cast("string").alias("paragraph_id"), t["table_no"].alias("table_no"), F.concat(context_header(F.col("section_no"), F.col("section_title"), F.lit(None).cast("string"), t["table_no"]), F.lit("\n"), t["text"]).alias("content")),
    )
    texts = F.transform(
        split_page(F.col("text"), limit),
        lambda c: F.struct(F.when(is_formula(c["text"]), "formula").otherwise("narrative").alias("content_type"), c["paragraph"].alias("paragraph_id"), F.lit(None).cast("string").alias("table_no"), F.concat(context_header(F.col("section_no"), F.col("section_title"), c["paragraph"]), F.lit("\n"), c["text"]).alias("content")),
    )
    rows = kept.select("page_no", "section_no", title.alias("__title"), F.posexplode(F.concat(tables, texts)).alias("chunk_no", "c"))
    return rows.select("page_no", "section_no", F.col("__title").alias("section_title"), "chunk_no", "c.*", F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"))


def figure_caption(ocr: Column) -> Column:
    """First line of recognised text that starts a figure's caption."""
    return F.get(F.filter(F.transform(F.split(F.coalesce(ocr, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"(?i)^fig(?:ure|\.)?\s*[0-9]+\.[0-9]+")), F.lit(0))
