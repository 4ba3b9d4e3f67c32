"""Line, word and relationship metrics of diagram text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .preprocess import BLOCK_COMMENT, is_comment_line, preprocess, strip_inline_comment
from .text import C, M, is_blank, lines, strip, words

#: Arrow forms in their order of preference (fixed values).
ARROWS = (
    r"-+>>|<<-+|->x|x<-|<\|[-.][-.]?|[-.][-.]?\|>|\*[-.][-.]?(?!>)|[-.][-.]?\*|o[-.][-.]?(?!>)|[-.][-.]?o(?![a-zA-Z])"
    r"|\.\.+>|<\.\.+|<[-.][-.]?>|<-+(?!<)|-+>(?!>)"
)
#: What the relationships of a diagram type are called (fixed values); all other types: structural.
CATEGORIES = {
    "class": "structural",
    "object": "structural",
    "component": "structural",
    "deployment": "structural",
    "sequence": "message",
    "timing": "message",
    "state": "flow",
    "activity": "flow",
    "usecase": "association",
}


def loc_metrics(c: Column) -> Column:
    """struct<loc, total_lines, blank_lines, comment_lines> of a raw file with its header comments."""
    raw = lines(c)
    headed = (F.size(raw) >= 3) & F.forall(F.slice(raw, 1, 3), lambda x: x.startswith("'"))
    body = F.when(headed, F.slice(raw, 4, F.size(raw))).otherwise(raw)
    left = lines(F.regexp_replace(F.array_join(body, "\n"), BLOCK_COMMENT, ""))

    def kind(x: Column) -> Column:
        marker = x.rlike(M + r"\A\s*@(start|end)uml\s*\z")
        return F.when(marker, "m").when(is_blank(x), "b").when(is_comment_line(x), "c").when(is_blank(strip_inline_comment(x)), "n").otherwise("l")

    kinds = F.transform(left, kind)
    count = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    return F.struct(count("l").alias("loc"), F.size(raw).alias("total_lines"), count("b").alias("blank_lines"), count("c").alias("comment_lines"))


def arrow_count(c: Column) -> Column:
    """Relationship arrows: leftmost matches of every trimmed line that is no directive."""
    kept = F.filter(F.transform(lines(c), strip), lambda x: (x != "") & ~x.startswith("@") & ~x.startswith("!"))
    return F.aggregate(F.transform(kept, lambda x: F.regexp_count(x, F.lit(ARROWS))), F.lit(0), lambda a, x: a + x)


def relationship_category(primary_type: Column) -> Column:
    out = F.lit("structural")
    for name, category in CATEGORIES.items():
        out = F.when(primary_type == name, category).otherwise(out)
    return out


def relationships(c: Column, primary_type: Column) -> Column:
    """map<category, count> of raw text; empty where there is no arrow."""
    n = arrow_count(preprocess(c))
    return F.when(n > 0, F.create_map(relationship_category(primary_type), n)).otherwise(F.create_map().cast("map<string,int>"))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def truncate_words(raw: Column, cleaned: Column, limit: int = 5000, keep: int = 4000) -> Column:
    """struct<text, truncated>: texts of over `limit` raw words are cut to the first `keep` words of their cleaned form."""
    long = word_count(raw) > limit
    w = words(cleaned)
    return F.struct(F.when(long & (F.size(w) > keep), F.array_join(F.slice(w, 1, keep), " ")).otherwise(cleaned).alias("text"), long.alias("truncated"))


def first_match(c: Column, pattern: str) -> Column:
    return F.regexp_extract(c, C + pattern, 0)
