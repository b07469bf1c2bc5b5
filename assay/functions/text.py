"""Structure of Markdown reports and tokens of prose, as column functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words of letters and digits, joined by apostrophes or hyphens.
TOKEN = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"


#: Line breaks other than the common one.
ODD_BREAKS = "\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029"


def one_break(text: Column) -> Column:
    """The text with one kind of line breaks; most texts have no others, which searches for single characters tell sooner than a class of them."""
    odd = reduce(or_, (F.contains(text, F.lit(c)) for c in ODD_BREAKS))
    return F.when(odd, F.regexp_replace(text, r"\r\n|[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]", "\n")).otherwise(text)


def _bare(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text)


def lines(text: Column) -> Column:
    """Lines of a text, without the empty one after a final line break."""
    return let(let(text, one_break), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(_bare(t), "\n")))


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC").str.casefold()


def folded(text: Column) -> Column:
    """Compatibility-normalised and case-folded text; what is ASCII stays in the JVM, where lower case is the same."""
    wide = F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False))
    return F.when(wide, _folded(F.when(wide, text))).otherwise(F.lower(text))


def lowered(text: Column) -> Column:
    """Lower case in which an ASCII literal is found wherever it would match without regard to case: four other characters match letters of it, too."""
    wide = "\u212a\u017f\u0130\u0131"
    return F.lower(F.when(reduce(or_, (F.contains(text, F.lit(c)) for c in wide)), F.translate(text, wide, "ksii")).otherwise(text))


def tokens(text: Column, fold: bool = False) -> Column:
    """Words in lower case, or (``fold``) of the :func:`folded` text."""
    return F.regexp_extract_all(folded(text) if fold else F.lower(text), F.lit(f"({TOKEN})"))


def duplicate_lines(text: Column, least_words: int) -> list[Column]:
    """Lines of at least so many words, and how many of them repeat an earlier one."""
    kept = F.filter(F.split(text, "\n"), lambda x: F.size(F.regexp_extract_all(x, F.lit("([^ ]+)"))) >= least_words)
    return [F.size(kept).alias("lines"), (F.size(kept) - F.size(F.array_distinct(kept))).alias("duplicate_lines")]


def cosine(rows: DataFrame, key: str) -> DataFrame:
    """Term-frequency cosine of side 0 and side 1 of every key, from (key, side, token); keys that lack a side have none.

    Counts of both sides meet in one grouping, so there is no join on tokens.
    """
    counts = rows.groupBy(key, "token").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    out = counts.groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("d"), F.sum(F.col("a") * F.col("a")).alias("x"), F.sum(F.col("b") * F.col("b")).alias("y"))
    return out.where("x > 0 and y > 0").select(key, (F.col("d").cast("double") / F.sqrt((F.col("x") * F.col("y")).cast("double"))).alias("cosine"))


def running_sections(rows: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """``section``: how many starts there were up to a row, within its key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(starts.cast("int")).over(w))


def _block(sign: str, group: int) -> str:
    """A fenced block: from a line that begins with three or more signs to one of as many or more and nothing else, or to the end of the text."""
    return rf"({sign}{{3,}}+)[^\n]*[\s\S]*?(?:\n[^\S\n]*\{group}{sign}*[^\S\n]*(?=\n|\z)|\z)"


FENCED = rf"(?m)^[^\S\n]*(?:{_block('`', 1)}|{_block('~', 2)})"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once: expressions that an optimiser merges would make it again for every element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


_LINES = "array<struct<line:string,fenced:boolean>>"


def flagged_lines(text: Column) -> Column:
    """The lines of a text as (line, fenced): whether each belongs to a fenced block, delimiters included.

    The text is cut at its blocks, in one pass; what lies between two blocks ends and begins with a line break, and so with an empty line that is none of its own.
    """
    def marked(part: Column, fenced: bool) -> Column:
        return F.transform(F.split(part, "\n"), lambda x: F.struct(x.alias("line"), F.lit(fenced).alias("fenced")))

    def between(part: Column, i: Column, blocks: Column) -> Column:
        first = F.when(i > 0, 2).otherwise(1)
        return let(marked(part, False), lambda rows: F.slice(rows, first, F.greatest(F.size(rows) - first + 1 - F.when(i < blocks, 1).otherwise(0), F.lit(0))))

    def cut(text: Column) -> Column:
        inside = F.regexp_extract_all(text, F.lit(FENCED), F.lit(0))
        whole = let(inside, lambda blocks: F.flatten(F.zip_with(
            let(F.size(blocks), lambda n: F.transform(F.split(text, FENCED), lambda part, i: between(part, i, n))),
            F.concat(F.transform(blocks, lambda x: marked(x, True)), F.array(F.array().cast(_LINES))), lambda a, b: F.concat(a, b),
        )))
        return F.when(text == "", F.array().cast(_LINES)).otherwise(whole)

    return let(let(let(text, one_break), _bare), cut)


HEADING = r"^(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"


def has_heading(text: Column, level: int) -> Column:
    """Whether a text has a heading of a level outside of fences."""
    return F.exists(flagged_lines(text), lambda x: ~x.fenced & F.startswith(x.line, F.lit("#" * level)) & x.line.rlike(HEADING) & (F.length(F.regexp_extract(x.line, HEADING, 1)) == level))


def with_sections(reports: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """``reports`` with ``sections``, an array of (ordinal, heading, level, start_line, end_line, text), made in the row.

    Headings inside fences do not count; lines before the first heading are a section of level 0 if one of them is not blank.
    """
    def section(x: Column, i: Column, rows: Column, heads: Column) -> Column:
        end = F.coalesce(F.get(heads, i + 1).at, F.size(rows))
        text = F.array_join(F.transform(F.slice(rows, x.at + 1, end - x.at), lambda y: y.line), "\n")
        return F.struct(
            F.trim(F.regexp_extract(x["head"], HEADING, 2)).alias("heading"), F.coalesce(F.length(F.regexp_extract(x["head"], HEADING, 1)), F.lit(0)).alias("level"),
            (x.at + 1).alias("start_line"), end.alias("end_line"), F.btrim(text, F.lit("\n")).alias("text"),
        )

    def parts(rows: Column) -> Column:
        at = F.transform(rows, lambda x, i: F.struct(i.alias("at"), F.when(~x.fenced & F.startswith(x.line, F.lit("#")) & x.line.rlike(HEADING), x.line).alias("head")))
        heads = F.filter(at, lambda x: x["head"].isNotNull() | (x.at == 0))
        return let(heads, lambda h: F.filter(F.transform(h, lambda x, i: section(x, i, rows, h)), lambda x: x.heading.isNotNull() | x.text.rlike(r"\S")))

    found = let(flagged_lines(F.coalesce(text_col, F.lit(""))), parts)
    numbered = F.transform(found, lambda x, i: F.struct(i.alias("ordinal"), *(x[c].alias(c) for c in ("heading", "level", "start_line", "end_line", "text"))))
    return reports.withColumn("sections", numbered)


def exploded(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with an ``x`` for each element of an array: of an outer explode no filter is inferred, which would make the array again to see whether it is empty."""
    return rows.withColumn("x", F.explode_outer(column)).drop(column).where("x is not null")


def sections(reports: DataFrame, key: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """A row per section: key, ordinal, heading, level, start_line, end_line, text."""
    return exploded(with_sections(reports.select(key, text_col), text_col).select(key, "sections"), "sections").select(key, "x.*")


def numbered_steps(text: Column) -> Column:
    """Lines that begin a numbered step."""
    return F.filter(lines(text), lambda x: x.rlike(r"^\s*\d+[.)]\s+"))
