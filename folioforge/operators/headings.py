"""Headings of layout blocks: test, level, and the path of headings above each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, col, strip
from .prefix import running

# Words that open a heading of a legal text, by the level they stand for (0: none of its own).
KEYWORDS = {
    "ΜΕΡΟΣ": 1, "ΚΕΦΑΛΑΙΟ": 2, "ΑΡΘΡΟ": 3, "ΠΑΡΑΡΤΗΜΑ": 1, "ΕΝΟΤΗΤΑ": 0, "ΠΙΝΑΚΑΣ": 0, "PART": 1, "CHAPTER": 2, "ARTICLE": 3, "SECTION": 3,
    "SUBSECTION": 3, "ANNEX": 1, "APPENDIX": 1, "TABLE": 4, "FIGURE": 4,
}
DEEPEST = 6


def looks_like_heading(text: Column | str) -> Column:
    """3 to 180 characters, no pipe, and either a legal keyword in front or mostly capitals in at most 16 words (a full stop only after at most 4)."""
    s = strip(text)
    keyword = s.rlike(r"(?iuU)^(" + "|".join(KEYWORDS) + r")\b")
    letters = F.regexp_replace(s, r"[^\p{L}]", "")
    n = F.length(letters)
    same = F.size(F.filter(F.split(letters, ""), lambda c: (c != "") & (F.upper(c) == c)))
    words = F.size(F.filter(F.split(s, f"{WS}+"), lambda w: w != ""))
    capitals = (n > 0) & (same >= F.lit(0.85) * n) & (words <= 16) & ~(s.endswith(".") & (words > 4))
    return F.coalesce(F.length(s).between(3, 180) & ~s.contains("|") & (keyword | capitals), F.lit(False))


def guess_level(text: Column | str) -> Column:
    """Level by the keyword that the upper-cased text begins with (no word boundary is asked for); 2 without one."""
    up = F.upper(col(text))
    level = F.lit(2)
    for k, v in reversed([x for x in KEYWORDS.items() if x[1]]):
        level = F.when(up.startswith(k), F.lit(v)).otherwise(level)
    return level


def heading_level(text: Column | str, text_level: Column | str) -> Column:
    """Level of a block that is a heading (its own level up to 6, else by its looks), else null. `text` must be normalised."""
    text, given = col(text), F.coalesce(col(text_level), F.lit(0))
    level = F.when(given > 0, F.least(given, F.lit(DEEPEST))).when(looks_like_heading(text), guess_level(text))
    return F.when(text != "", level).cast("int")


def heading_paths(df: DataFrame, key: str = "doc_key", order: str = "ord", text: str = "text", level: str = "level", extra: dict[str, Column] = {}, blocked: bool = True) -> DataFrame:
    """Add depth and heading_path: the headings above each row, itself included where it is one; both empty before the first.

    A heading takes back every heading at its level or deeper, counted by depth in the path, not by the level written there. With
    the headings numbered i by order and L their levels, the depth is i + min(0, min over j <= i of L_j - j), a running minimum;
    the k-th step of the path is the last heading at depth k. So no row-by-row loop is needed. `extra` adds running sums.
    """
    head = F.col(level).isNotNull()
    df = running(df, key, order, sums={"__i": F.when(head, 1).otherwise(0), **extra}, blocked=blocked)
    df = running(df, key, order, mins={"__m": F.when(head, F.col(level) - F.col("__i"))}, blocked=blocked)
    depth = (F.col("__i") + F.least(F.lit(0), F.coalesce("__m", F.lit(0)))).cast("int")
    df = df.withColumn("depth", depth)
    df = running(df, key, order, lasts={f"__p{k}": F.when(head & (F.col("depth") == k), F.col(text)) for k in range(1, DEEPEST + 1)}, blocked=blocked)
    path = F.slice(F.array(*[f"__p{k}" for k in range(1, DEEPEST + 1)]), F.lit(1), F.col("depth"))
    return df.withColumn("heading_path", path).drop("__i", "__m", *[f"__p{k}" for k in range(1, DEEPEST + 1)])
