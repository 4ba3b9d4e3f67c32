"""Splitting files of several diagrams that are larger than a row: a scan over their lines, in chunks.

Only lines that open or close a block (marks) decide. What a chunk of lines does to the lines behind it is its last mark alone, whatever
stood before: an end closes, a start opens at its line. So chunks are summed up apart from one another, a prefix scan over one small row
a chunk gives each chunk the state that it begins in, and blocks are then found chunk by chunk. One file of any length is thus dealt over
as many tasks as it has chunks; lines are never gathered, and only marks are shuffled.

Blocks are those of operators.blocks: an end whose last mark before is a start; a further start drops what was open, an open end of file
is dropped, and so is text outside. Line numbers are an order within a file: they may have gaps, and are taken to be unique there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Line numbers of a chunk. A task holds the marks of one chunk at a time.
CHUNK = 100_000
#: Line numbers of a cell, by which lines find their block; cells that hold blocks are broadcast up to so many, else lines and cells meet
#: in a shuffle.
CELL, BROADCAST_CELLS = 256, 500_000

START, END = 1, 2


def mark_of(line: Column) -> Column:
    """START, END, or null."""
    kind = F.when(line.rlike(r"(?iU)\A\s*@start"), START).when(line.rlike(r"(?iU)\A\s*@end"), END)
    return F.when(F.contains(line, F.lit("@")), kind)


def marks(lines: DataFrame, file: str = "stem", number: str = "line_no", value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """file, chunk long, at long, kind int of the lines that open or close a block."""
    made = lines.select(F.col(file).alias("file"), F.col(number).cast("long").alias("at"), mark_of(F.col(value)).alias("kind"))
    return made.where("kind IS NOT NULL").select("file", F.floor(F.col("at") / chunk).alias("chunk"), "at", "kind")


def chunk_states(marked: DataFrame) -> DataFrame:
    """file, chunk, before struct<at, kind>: the last mark of all the chunks before (null: none), for every chunk that has marks.

    Summing up a chunk is a map-side aggregate; the scan is over one row a chunk."""
    last = marked.groupBy("file", "chunk").agg(F.max(F.struct("at", "kind")).alias("last"))
    return last.select("file", "chunk", F.lag("last").over(Window.partitionBy("file").orderBy("chunk")).alias("before"))


def block_spans(lines: DataFrame, file: str = "stem", number: str = "line_no", value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """file, part long (from 1 in the file), first_line long, last_line long of every block."""
    marked = marks(lines, file, number, value, chunk)
    states = chunk_states(marked).withColumnsRenamed({"file": "_file", "chunk": "_chunk"})
    known = marked.join(states, marked["file"].eqNullSafe(states["_file"]) & (marked["chunk"] == states["_chunk"])).drop("_file", "_chunk")
    within = Window.partitionBy("file", "chunk").orderBy("at")
    opened = F.coalesce(F.lag(F.struct("at", "kind")).over(within), F.col("before"))
    ends = known.withColumn("opened", opened).where((F.col("kind") == END) & (F.col("opened.kind") == START))
    spans = ends.select("file", "chunk", F.col("opened.at").alias("first_line"), F.col("at").alias("last_line"), F.row_number().over(within).alias("nth"))
    upto = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = spans.groupBy("file", "chunk").agg(F.count("*").alias("n")).select(F.col("file").alias("_file"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    met = spans.join(counts, spans["file"].eqNullSafe(counts["_file"]) & (spans["chunk"] == counts["_chunk"]))
    return met.select(F.col("file").alias(file), (F.col("base") + F.col("nth")).alias("part"), "first_line", "last_line")


def header_ends(lines: DataFrame, file: str = "stem", number: str = "line_no", value: str = "value") -> DataFrame:
    """file, header_end: the number of the first line that is neither blank nor a comment; null where all are."""
    other = ~(is_blank(F.col(value)) | F.col(value).rlike(r"(?U)\A\s*'"))
    return lines.groupBy(F.col(file)).agg(F.min(F.when(other, F.col(number))).alias("header_end"))


def label_lines(lines: DataFrame, spans: DataFrame, file: str = "stem", number: str = "line_no") -> DataFrame:
    """lines with part long: the block that a line is in; null outside of blocks.

    Spans are cut at the borders of cells of CELL line numbers and gathered by cell, so that a line compares itself with the spans of
    its own cell alone, of which there are at most CELL. Lines stay where they are while cells are few enough to be broadcast."""
    cells = F.sequence(F.floor(F.col("first_line") / CELL), F.floor(F.col("last_line") / CELL))
    cut = spans.select(F.col(file).alias("_file"), F.explode(cells).alias("_cell"), F.struct("first_line", "last_line", "part").alias("s"))
    held = cut.groupBy("_file", "_cell").agg(F.collect_list("s").alias("_spans"))
    few = held.count() <= BROADCAST_CELLS
    at = lines.withColumn("_at", F.floor(F.col(number) / CELL))
    met = at.join(F.broadcast(held) if few else held, at[file].eqNullSafe(held["_file"]) & (at["_at"] == held["_cell"]), "left")
    inside = F.filter("_spans", lambda s: (s["first_line"] <= F.col(number)) & (F.col(number) <= s["last_line"]))
    return met.withColumn("part", F.get(inside, F.lit(0))["part"]).select(*[c for c in lines.columns if c != "part"], "part")


def split_lines(lines: DataFrame, file: str = "stem", number: str = "line_no", value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """file, part long, number, value: the lines of the files that splitting makes, in the order of their numbers. Files of several blocks
    become a part a block, each with the file's header lines (which come before all blocks) and its own; others keep all their lines, as
    part 0."""
    spans = block_spans(lines, file, number, value, chunk)
    parts = spans.groupBy(file).agg(F.max("part").alias("_parts")).where("_parts > 1")
    ends = header_ends(lines, file, number, value).withColumnRenamed(file, "_f")
    about = parts.join(ends, F.col(file).eqNullSafe(F.col("_f"))).select("_f", "_parts", "header_end")  # a row a file of several blocks
    known = label_lines(lines, spans, file, number).join(about, F.col(file).eqNullSafe(F.col("_f")), "left")
    head = F.coalesce(F.col(number) < F.col("header_end"), F.lit(False)) & F.col("part").isNull()
    every = F.when(F.col("_parts").isNull(), F.array(F.lit(0).cast("long"))).when(head, F.sequence(F.lit(1).cast("long"), F.col("_parts"))).when(F.col("part").isNotNull(), F.array("part"))
    return known.withColumn("_every", every).where("_every IS NOT NULL").select(file, F.explode("_every").alias("part"), number, value)
