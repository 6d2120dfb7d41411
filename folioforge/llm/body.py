"""Problem 1: keep the main body of web pages (maximum-scoring subsequences over lines).

A page is the sequence of its lines; a line is a tag and the words and word pairs in it. Weights of words and tags are learned by
logistic regression from a bounded sample of pages that :mod:`folioforge.llm.furniture` labels; after that only the weights count.
A line's score is the sum of its weights. One linear scan finds the contiguous regions of greatest score: a region ends at a line
that scores below -DROP, carries lines that score a little below zero along, and is content if its own score reaches LEAST.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_text, scan_groups, seq_block
from .furniture import seed

#: Labelled sample from which the weights are learned: about so many rows of whole pages, chosen by the hash of the page's name (at
#: most twice as many); of a page at most PAGE_ROWS rows, and no row of more than SAMPLE_CHARS characters.
SAMPLE_ROWS, PAGE_ROWS, SAMPLE_CHARS = 32_000, 400, 20_000
#: A line below -DROP ends a region; a region is content if its score reaches LEAST.
DROP, LEAST = 1.0, 0.3
#: Rows of a page that are scanned as one, and rows of the neighbouring blocks that are read along on either side.
BLOCK_ROWS, HALO = 4096, 64
#: Penalty and steps of the fit.
L2, STEPS = 1e-5, 150

_token = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_stop = re.compile(r"[.!?…:;][\"”»’)\]]*$")
_prose = re.compile(r"\w[.!?…][\"”»’)\]]*$")

Lines = list[tuple[str, str]]


def tokens(line: str) -> list[str]:
    return ["#" if t[0].isdigit() else t for t in _token.findall(line.lower())]


def features(tag: str, line: str) -> list[str]:
    """Tag, form, words and word pairs of a line (its ends count as words)."""
    t = tokens(line)
    words = sum(x[0].isalnum() for x in t)
    edged = ["^", *t, "$"]
    form = "<stop>" if _stop.search(line) else "<open>"
    return [f"<tag:{tag}>", form, f"<{(words + 1).bit_length()}>", *dict.fromkeys(t), *dict.fromkeys(map(" ".join, zip(edged, edged[1:])))]


def opened(line: str) -> list[str]:
    """Words of a line above, as features of the title-like lines under it."""
    return ["<under>", *dict.fromkeys(tokens(line))]


def leaves_box(tag: str, line: str) -> bool:
    """Whether a line can't be an entry of a side box, by its form: a table, a sentence, a long line."""
    return tag == "table" or len(line) > 160 or (len(line) > 60 and bool(_prose.search(line)))


def labels(lines: Lines) -> list[str | None]:
    """Kind of furniture of each (tag, line) of a labelled page by fixed whole-line phrases; 'entry' for the lines of a side box; None: body."""
    kinds: list[str | None] = []
    boxed = False
    for tag, line in lines:
        kind = seed(line)
        if kind is not None:
            boxed = kind == "box"
        elif boxed and leaves_box(tag, line.strip()):
            boxed = False
        elif boxed:
            kind = "entry"
        kinds.append(kind)
    return kinds


def fit(rows: list[list[str]], y: list[bool], offset: list[float] | None = None) -> tuple[dict[str, float], float]:
    """Weights and constant of a logistic regression of `y` on bags of features (each row scaled by the root of its size)."""
    if not rows:
        return {}, 0.0
    names: dict[str, int] = {}
    at = np.array([names.setdefault(f, len(names)) for r in rows for f in r])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = len(rows)
    scale = 1 / np.sqrt(np.bincount(of, minlength=n))[of]
    target, base = np.asarray(y, float), np.zeros(n) if offset is None else np.asarray(offset)
    w = np.zeros(len(names) + 1)  # the constant is the last
    mean, var = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        z = np.bincount(of, w[at] * scale, n) + w[-1] + base
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(at, miss[of] * scale, len(names)) / n + L2 * w[:-1], miss.mean())
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        w -= 0.3 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
    return {k: float(w[i]) for k, i in names.items()}, float(w[-1])


class Weights:
    """Learned weights: of a line's own tag and words, and of the words of the line above that opened a box."""

    def __init__(self, own: dict[str, float], const: float, under: dict[str, float], under_const: float):
        self.args = (own, const, under, under_const)
        self._seen: dict[tuple[str, str], float] = {}

    def own(self, tag: str, line: str) -> float:
        key = (tag, line)
        s = self._seen.get(key)
        if s is None:
            if len(self._seen) > 20_000:
                self._seen.clear()
            f = features(tag, line)
            s = self.args[1] + sum(map(self.args[0].get, f, [0.0] * len(f))) / math.sqrt(len(f))
            if len(line) < 200:
                self._seen[key] = s
        return s

    def below(self, line: str) -> float:
        f = opened(line)
        return self.args[3] + sum(map(self.args[2].get, f, [0.0] * len(f))) / math.sqrt(len(f))

    def scores(self, lines: Lines) -> list[float]:
        """Score of each line: its own weights, and the weights of the last line above that looks like furniture, if a box may still be open."""
        own = [self.own(t, x.strip()) for t, x in lines]
        return [s if above is None else s + self.below(above) for s, above in zip(own, above_of(lines, own))]


def above_of(lines: Lines, own: list[float]) -> list[str | None]:
    """For each line the last line above it that scores below zero, unless a table, sentence or long line stands between or the line is one itself."""
    out: list[str | None] = []
    above = None
    for (tag, line), s in zip(lines, own):
        line = line.strip()
        if leaves_box(tag, line):
            above = None
        out.append(above)
        if s < 0:
            above = line
    return out


def learn(pages: Iterable[Lines], label: Callable[[Lines], list[str | None]] = labels) -> Weights:
    """Weights from labelled pages. Entries of boxes read like titles of the body, so only what stands above them teaches to tell them apart."""
    marked = [(p, label(p)) for p in pages]
    flat = [(t, x.strip(), k) for p, ks in marked for (t, x), k in zip(p, ks) if k != "entry"]
    if not flat:
        return Weights({}, 1.0, {}, 0.0)
    own, const = fit([features(t, x) for t, x, _ in flat], [k is None for _, _, k in flat])
    w = Weights(own, const, {}, 0.0)
    rows, y, base = [], [], []
    for p, ks in marked:
        scores = [w.own(t, x.strip()) for t, x in p]
        for k, s, above in zip(ks, scores, above_of(p, scores)):
            if above is not None:
                rows.append(opened(above))
                y.append(k is None)
                base.append(s)
    return Weights(own, const, *fit(rows, y, base))


def best_regions(scores: list[float], drop: float = math.inf) -> list[tuple[int, int, float]]:
    """All contiguous regions [i, j) of greatest score, with their scores, by one linear scan: no part of a region, and no way to
    enlarge it, scores more. A line below -drop is in none."""
    out: list[tuple[int, int, float]] = []
    open_: list[tuple[int, int, float, float]] = []  # start, end, sum of all before the region, sum up to its end
    total = 0.0

    def close() -> None:
        out.extend((i, j, r - l) for i, j, l, r in open_)
        open_.clear()

    for i, s in enumerate(scores):
        if s < -drop:
            close()
            continue
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        while True:
            k = len(open_) - 1
            while k >= 0 and open_[k][2] >= left:
                k -= 1
            if k < 0 or open_[k][3] >= total:
                break
            start, left = open_[k][0], open_[k][2]  # the region grows back over the ones since then
            del open_[k:]
        open_.append((start, i + 1, left, total))
    close()
    return out


def classify(lines: Lines, w: Weights, drop: float = DROP, least: float = LEAST) -> list[tuple[bool, float]]:
    """Whether each line is body, that is in a region that scores at least `least`; and its score."""
    scores = w.scores(lines)
    inside = [False] * len(scores)
    for a, b, s in best_regions(scores, drop):
        if s >= least:
            inside[a:b] = [True] * (b - a)
    return list(zip(inside, scores))


def _rows(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("source_html").isNotNull() & F.col("id").isNotNull()).select(
        "source_html", "id", F.lower(F.coalesce("html_tag", F.lit(""))).alias("tag"), chunk_text().alias("body")
    )


def weights(chunks: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Weights:
    """Weights from the labelled sample (see SAMPLE_ROWS): pages are chosen by the hash of their names."""
    every = max(1, -(-chunks.where("source_html is not null").count() // sample_rows))
    few = _rows(chunks).where(F.pmod(F.xxhash64("source_html"), F.lit(every)) == 0)
    few = few.where((F.length("body") <= SAMPLE_CHARS) & (seq_block(rows=PAGE_ROWS) < 1))
    got = sorted(few.limit(2 * sample_rows).collect(), key=lambda r: (r["source_html"], r["id"], r["tag"], r["body"]))
    pages: dict[str, Lines] = {}
    last = None
    for r in got:
        if r["id"] != last:
            pages.setdefault(r["source_html"], []).extend((r["tag"], x) for x in r["body"].split("\n") if x.strip())
        last = r["id"]
    return learn(pages.values())


def page_lines(chunks: DataFrame, w: Weights | None = None) -> DataFrame:
    """Every non-blank line of the chunks of web pages, with its score and whether it belongs to the page's own body.

    Rows: id, line_no (from 1, blank lines counted), line, is_body, score. Chunks without id or page are left out, one id counts
    once, null text gives no line, an empty table gives no row. Pages are scanned in the order of their ids; a page of more than
    BLOCK_ROWS chunks is scanned in blocks of so many, each read with HALO chunks of its neighbours, so a page of any size fits and
    spreads over tasks.
    """
    w = weights(chunks) if w is None else w
    sent = chunks.sparkSession.sparkContext.broadcast(w.args)  # at most the words and word pairs of the sample
    made: list[Weights] = []

    def scan(key: tuple, cols: dict[str, list]) -> Iterator[tuple]:
        if not made:
            made.append(Weights(*sent.value))
        lines, where, last = [], [], None
        for i, tag, body, own in zip(cols["id"], cols["tag"], cols["body"], cols["own"]):
            if i == last or not body:
                continue
            last = i
            for n, x in enumerate(body.split("\n"), 1):
                if x.strip():
                    lines.append((tag, x))
                    where.append((i, n, own))
        for (i, n, own), (_, x), (is_body, s) in zip(where, lines, classify(lines, made[0])):
            if own:
                yield i, n, x, bool(is_body), float(s)

    at = F.floor(seq_block(rows=HALO))  # in steps of the halo
    per = BLOCK_ROWS // HALO
    edges = F.array_distinct(F.transform(F.array(at, F.greatest(at - 1, F.lit(0)), at + 1), lambda x: F.floor(x / per).cast("int")))
    rows = _rows(chunks).select("*", F.floor(at / per).cast("int").alias("home"), F.explode(edges).alias("block"))
    rows = rows.select("source_html", "block", "id", "tag", "body", (F.col("home") == F.col("block")).alias("own"))
    return scan_groups(rows, ["source_html", "block"], ["id", "tag", "body"], scan, "id string, line_no int, line string, is_body boolean, score double", 4 * BLOCK_ROWS)
