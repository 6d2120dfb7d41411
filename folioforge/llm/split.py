"""Problem 4: split oversized chunks at natural boundaries (sparse-table range-maximum index over boundary strengths)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_text

#: Longest piece and the overlap of consecutive pieces, in characters.
LIMIT, OVERLAP = 1800, 250
# A cut lies behind the match: before a heading, at a paragraph, line, sentence, clause, word.
_cuts = re.compile(r"(?P<s6>\n\s*\n(?=#{1,6} ))|(?P<s5>\n\s*\n)|(?P<s4>\n)|(?P<s3>[.!?…][\"”»’)\]]*[ \t]+)|(?P<s2>[;:,—–][ \t]+)|(?P<s1>\s+)")


class Strongest:
    """Positions of cuts with their strengths; the strongest in a range of positions, the rightmost among equals.

    A sparse table of range maxima with as many levels as the widest range asked for needs, so a text of any length fits.
    """

    def __init__(self, text: str, widest: int):
        self.pos: list[int] = []
        keys: list[int] = []  # strength, then place: the maximum breaks ties rightward
        for m in _cuts.finditer(text):
            self.pos.append(m.end())
            keys.append((int(m.lastgroup[1]) << 40) + len(keys))
        self.levels = [keys]
        k = 1
        while k * 2 <= widest and k * 2 <= len(keys):
            low = self.levels[-1]
            self.levels.append([max(a, b) for a, b in zip(low, low[k:])])
            k *= 2

    def best(self, lo: int, hi: int) -> int | None:
        """Position of the strongest cut in [lo, hi], or None."""
        a, b = bisect_left(self.pos, lo), bisect_right(self.pos, hi)
        if a >= b:
            return None
        j = min((b - a).bit_length() - 1, len(self.levels) - 1)
        row = self.levels[j]
        top = max(row[a], row[b - (1 << j)])
        for i in range(a + (1 << j), b - (1 << j), 1 << j):  # only where a range is wider than the top level
            top = max(top, row[i])
        return self.pos[top & ((1 << 40) - 1)]


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, piece) of each piece: at most `limit` characters, each begins `overlap` before the end of the one before.

    The strongest cut in the second half of the permissible window is taken; without any, the piece is cut at the limit.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    if len(text) <= limit:
        return [(0, text)]
    index = Strongest(text, limit)
    out, start = [], 0
    while len(text) - start > limit:
        end = index.best(start + max(limit // 2, overlap + 1), start + limit) or start + limit
        out.append((start, text[start:end]))
        start = end - overlap
    out.append((start, text[start:]))
    return out


def _oversized(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    rows = chunks.select("id", "heading_path", "chunk_type", chunk_text().alias("body")).where(F.length("body") > limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, no, starts, pieces = [], [], [], []
            for i, body in enumerate(pdf["body"]):
                for n, (s, p) in enumerate(pieces_of(body, limit, overlap), 1):
                    at.append(i)
                    no.append(n)
                    starts.append(s)
                    pieces.append(p)
            got = pdf[["id", "heading_path", "chunk_type"]].iloc[at].reset_index(drop=True)
            yield got.assign(piece_no=no, start=starts, piece=pieces)

    return rows.mapInPandas(run, "id string, heading_path array<string>, chunk_type string, piece_no int, start int, piece string")


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Every chunk as pieces of at most `limit` characters: id, heading_path, chunk_type, piece_no (from 1), start, piece.

    A chunk within the limit is one piece and never leaves the JVM; null and blank texts give no piece; rows delivered again
    give their pieces again unless the caller drops them; null ids stay null.
    """
    names = ["id", "heading_path", "chunk_type", "piece_no", "start", "piece"]
    small = chunks.select("id", "heading_path", "chunk_type", chunk_text().alias("piece")).where((F.length("piece") <= limit) & F.col("piece").rlike(r"(?U)\S"))
    small = small.withColumns({"piece_no": F.lit(1), "start": F.lit(0)}).select(names)
    return small.unionByName(_oversized(chunks, limit, overlap).select(names).where(F.col("piece").rlike(r"(?U)\S")))


def found(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ids of the chunks that come out in more than one piece, of `text`, or of `content` where text is null or blank. Null ids are left out."""
    cut = _oversized(chunks.where(F.col("id").isNotNull()), limit, overlap)
    return cut.where("piece_no = 2").select("id").distinct()
