"""Splitting files of several diagrams, and normalising their opening tags.

Lines are the atoms of a file, so blocks are found in one file's array of lines, within one row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, let

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"


def split_keep_ends(c: Column) -> Column:
    """Lines with their line ends."""
    return F.filter(F.split(c, rf"(?<=\n|[\x0b\x0c\x1c-\x1e\u0085  ])|(?<=\r)(?!\n)", -1), lambda x: x != "")


def header(c: Column) -> Column:
    """The leading lines that are blank or comments."""
    return let(split_keep_ends(c), _header)


def _header(ls: Column) -> Column:
    other = F.filter(F.transform(ls, lambda x, i: F.when(is_blank(x) | x.rlike(r"(?U)\A\s*'"), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    return F.array_join(F.slice(ls, 1, F.coalesce(F.get(other, 0), F.size(ls))), "")


def diagram_blocks(c: Column) -> Column:
    """array<string>: from a line that starts with @start... to the next that starts with @end..., any case. A further start drops what
    was open; an open end of file is dropped; so is text outside.

    So a block is an end whose last mark before is a start: lines are read once for marks, and blocks are cut out of the lines.
    """
    return let(split_keep_ends(c), _blocks)


def _blocks(ls: Column) -> Column:
    def mark(x: Column, i: Column) -> Column:
        kind = F.when(x.rlike(r"(?iU)\A\s*@start"), 1).when(x.rlike(r"(?iU)\A\s*@end"), 2)
        return F.when(F.contains(x, F.lit("@")), F.struct(i.alias("at"), kind.alias("kind")))

    def cut(marks: Column) -> Column:
        before = lambda k: F.get(marks, k - 1)
        ends = F.filter(F.transform(marks, lambda m, k: F.struct(before(k)["at"].alias("a"), m["at"].alias("b"), ((m["kind"] == 2) & (before(k)["kind"] == 1)).alias("ok"))), lambda e: e["ok"])
        return F.transform(ends, lambda e: F.array_join(F.slice(ls, e["a"] + 1, e["b"] - e["a"] + 1), ""))

    return let(F.filter(F.transform(ls, mark), lambda m: m["kind"].isNotNull()), cut)


def split_files(files: DataFrame, stem: str = "stem", column: str = "content") -> DataFrame:
    """stem, part int, file_name, content: files of several blocks become a file a block (header and block), others stay as they are."""
    read = files.select(stem, column, split_keep_ends(F.col(column)).alias("_l")).withColumn("_b", _blocks(F.col("_l")))
    many = F.size("_b") > 1
    named = read.withColumn("_h", F.when(many, _header(F.col("_l")))).select(stem, column, "_h", F.posexplode(F.when(many, F.col("_b")).otherwise(F.array(F.lit(None).cast("string")))).alias("_p", "_t"))
    part = F.when(F.col("_t").isNull(), 0).otherwise(F.col("_p") + 1).cast("int")
    name = F.when(F.col("_t").isNull(), F.concat(F.col(stem), F.lit(".puml"))).otherwise(F.format_string("%s_%02d.puml", F.col(stem), F.col("_p") + 1))
    return named.select(stem, part.alias("part"), name.alias("file_name"), F.coalesce(F.concat("_h", "_t"), F.col(column)).alias("content"))


def split_sources(files: DataFrame, column: str = "content") -> DataFrame:
    """The files that split_files replaces: originals are listed, never changed."""
    return files.where(F.size(diagram_blocks(F.col(column))) > 1)


def normalize_tags(c: Column) -> Column:
    """`@startuml{...}` becomes `@startuml`; so does, once a line, `@startuml` with a name (white space, then no parenthesis, bracket or
    backslash), to the line's end. Case matters."""
    bare = F.regexp_replace(c, r"@startuml\{[^}\n]*\}", "@startuml")
    return F.regexp_replace(bare, r"(?md)^(.*?)@startuml[ \t\x0b\x0c\r]+[^(\[\\\n].*$", "$1@startuml")
