"""Problem 8: evaluation passages in documents (CGK random-walk embedding, bit-sampling LSH over item-sized windows, edit verification).

Windows of the items and of the documents are walked through at random (CGK), so that their edit distance becomes a Hamming distance;
sampled positions of the walk are hashed to a key, several times over; windows that share a key are verified by edit distance. The
items' keys are a table that the documents' keys are joined with, so items of any number take one pass over the documents. Two
bitmaps of bounded size, of the items' short word runs and of their keys, keep windows that can't match from leaving their task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, hash64, mix, written

#: Words of a shared run; words of an item's windows (an item with fewer, down to RUN, is one window); words of a window for each edit that it may differ by.
RUN, WINDOW, PER_EDIT = 12, 24, 8
#: Share of the windows within their edits that must share a key (the number of repetitions follows), most repetitions, sampled positions.
RECALL, MOST_REPEATS, SAMPLED = 0.97, 96, 7
#: Words of the runs that are looked up before any window is walked through.
GRAM = 3
#: Bits of a bitmap for each of its entries, and the most it may have (32 MB); a fuller one only lets more windows through to the join.
BITS, MOST_BITS = 16, 1 << 28
#: Words that a task takes in hand at once.
BATCH_WORDS = 200_000

_PAD = np.uint64(0x51ED270B)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the runs of q words."""
    s = h[: max(0, len(h) - q + 1)].copy()
    for k in range(1, q):
        s = mix(s * _STEP + h[k : k + len(s)])
    return s


class Walk:
    """CGK embedding of windows of `width` words, of which only sampled positions are kept and hashed to one key a repetition.

    A pointer walks along the window; at each step the symbol under it is put out and a random bit of (step, symbol) says whether it
    moves on. Windows at small edit distance soon walk in step again, so edit distance becomes Hamming distance, and equal windows
    agree in every position.
    """

    def __init__(self, width: int, repeats: int, sampled: int):
        self.width = width
        rng = np.random.default_rng([8, width])
        self.salts = rng.integers(1, 1 << 63, (MOST_REPEATS, 2 * width), dtype=np.uint64)[:repeats]
        self.at = [set(map(int, rng.choice(2 * width - 2, min(sampled, width), replace=False))) for _ in range(repeats)]

    def keys(self, h: np.ndarray, starts: np.ndarray, repeat: int) -> np.ndarray:
        """Keys of the windows that begin at `starts` in the word hashes `h`."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        padded = np.append(h, _PAD)
        key = np.full(len(starts), (self.width << 8) + repeat + 1, np.uint64)
        moved = np.zeros(len(starts), np.int64)
        last = max(self.at[repeat])
        for j in range(last + 1):
            here = np.where(moved < self.width, np.minimum(starts + moved, len(h)), len(h))
            symbol = padded[here]
            if j in self.at[repeat]:
                key = mix(key * _STEP + symbol)
            moved += ((mix(symbol ^ self.salts[repeat, j]) >> np.uint64(17)) & np.uint64(1)).astype(np.int64)
        return key


_known_repeats: dict[tuple, int] = {}


def repeats_for(width: int, edits: int, recall: float = RECALL, sampled: int = SAMPLED) -> int:
    """Repetitions after which windows of `width` different words, `edits` of them edited at random, share a key with the wished recall (simulated)."""
    key = (width, edits, recall, sampled)
    if not edits:
        return 1
    if key in _known_repeats:
        return _known_repeats[key]
    rng = np.random.default_rng([9, width, edits])
    trials = 600
    a = rng.integers(1, 1 << 63, (trials, width), dtype=np.uint64)
    b = []
    for row in a:
        w = list(row)
        for _ in range(edits):
            k = int(rng.integers(len(w)))
            w[k : k + 1] = [[], [rng.integers(1, 1 << 63, dtype=np.uint64)], [w[k], rng.integers(1, 1 << 63, dtype=np.uint64)]][int(rng.integers(3))]
        b += (w + list(rng.integers(1, 1 << 63, edits, dtype=np.uint64)))[:width]
    starts = np.arange(trials) * width
    walk, met = Walk(width, MOST_REPEATS, sampled), np.zeros(trials, bool)
    for r in range(MOST_REPEATS):
        met |= walk.keys(a.reshape(-1), starts, r) == walk.keys(np.array(b, np.uint64), starts, r)
        if met.mean() >= recall:
            break
    _known_repeats[key] = r + 1
    return r + 1


def edit_distance(a: list[str], b: list[str], most: int, prefix: bool = False) -> int:
    """Edit distance of two word lists, or most + 1 if it is larger (banded); with `prefix` to that beginning of `a` which is nearest to `b`."""
    big = most + 1
    if len(b) - len(a) > most or (not prefix and len(a) - len(b) > most):
        return big
    prev = [j if j <= most else big for j in range(len(b) + 1)]
    best = prev[-1]
    for i, x in enumerate(a, 1):
        if i - most > len(b):
            break
        lo, hi = max(1, i - most), min(len(b), i + most)
        cur = [big] * (len(b) + 1)
        if i <= most:
            cur[0] = i
        for j in range(lo, hi + 1):
            cur[j] = min(prev[j - 1] + (x != b[j - 1]), prev[j] + 1, cur[j - 1] + 1, big)
        best = min(best, cur[-1])
        if min(cur[lo - 1 : hi + 1]) > most:
            return best if prefix else big
        prev = cur
    return best if prefix else prev[-1]


class Plan:
    """Windows of each width, the edits they may differ by and the walks that find them. widths: width to (edits, repetitions)."""

    def __init__(self, widths: dict[int, tuple[int, int]]):
        self.edits = {w: e for w, (e, _) in widths.items()}
        self.walks = {w: Walk(w, n, SAMPLED if e else 2 * SAMPLED) for w, (e, n) in sorted(widths.items())}

    def keys(self, width: int, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Keys of the windows at `starts`, a row a window."""
        walk = self.walks[width]
        return np.stack([walk.keys(h, starts, r) for r in range(len(walk.at))], 1).view(np.int64)

    @staticmethod
    def gram(width: int, edits: int) -> tuple[int, int]:
        """Length of the word runs by which windows are told, and how many of a matching window's runs must be in an item: an edit destroys at most as many as a run has words."""
        q = GRAM if width - GRAM + 1 - edits * GRAM >= 1 else 1
        return q, width - q + 1 - edits * q


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of a table of one 64-bit column `h`: a bit for each value, made on the cluster; of the driver it takes at most MOST_BITS / 8 bytes."""
    n = hashes.count()
    bits = min(MOST_BITS, 1 << max(10, (n * BITS - 1).bit_length()))
    at = F.expr(f"shiftrightunsigned(h, 7) & {bits - 1}L")  # the low bits stay free for other uses of the hash
    words = hashes.select(at.alias("at")).select(F.shiftright("at", 6).cast("int").alias("k"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("m")).groupBy("k").agg(F.bit_or("m").alias("m"))
    got = words.toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[got["k"].to_numpy()] = got["m"].to_numpy()
    return out.view(np.uint64)


def among(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the bitmap (no value that was put in is missed)."""
    at = (h >> np.uint64(7)) & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _indexed(items: DataFrame, width: int, widths: dict[int, tuple[int, int]]) -> DataFrame:
    """Windows of each item: item_id, width, windows (array of window and keys), grams (hashes of its short runs)."""
    schema = "item_id bigint, width int, windows array<struct<window: string, keys: array<bigint>>>, grams array<bigint>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, seen = Plan(widths), {}
        for pdf in batches:
            out = []
            for item, text in zip(pdf["item_id"], pdf["text"]):
                ws = WORD.findall(text.lower())
                w = min(width, len(ws))
                if w < RUN:
                    continue
                h, starts = hash64(ws, seen), np.arange(len(ws) - w + 1)
                keys = plan.keys(w, h, starts)
                windows = [{"window": " ".join(ws[s : s + w]), "keys": k} for s, k in zip(starts, keys)]
                out.append((item, w, windows, grams(h, plan.gram(w, plan.edits[w])[0]).view(np.int64)))
            yield pd.DataFrame(out, columns=["item_id", "width", "windows", "grams"])

    own = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    return written(items.sparkSession, own.mapInPandas(run, schema), "leak-items")


def passages(docs: DataFrame, items: DataFrame, width: int = WINDOW, edits: int | None = None) -> DataFrame:
    """Documents and items that share a window within its edits: doc_id, item_id, windows (different ones of the document), edits (least).

    Windows have `width` words, those of a shorter item its own number, down to RUN; they may differ by one inserted, deleted or
    replaced word for each PER_EDIT words (or by `edits`). Equal windows are always found, edited ones with a recall of RECALL for
    a window that stands alone. Null ids and texts take no part; items of fewer than RUN words match nothing; repeated rows count once.
    """
    spark = docs.sparkSession
    of = {w: w // PER_EDIT if edits is None else edits for w in range(min(RUN, width), width + 1)}
    plan = {w: (e, repeats_for(w, e)) for w, e in of.items()}
    index = _indexed(items, width, plan)
    have = {r[0] for r in index.select("width").distinct().collect()}  # at most WINDOW - RUN + 1
    plan = {w: p for w, p in plan.items() if w in have}
    rows = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    windows = written(spark, index.select("item_id", F.inline("windows")), "leak-windows")
    grams_ = index.select(F.explode("grams").alias("h")).distinct()
    keys = windows.select(F.explode("keys").alias("h")).distinct()
    sent = spark.sparkContext.broadcast((plan, bitmap(grams_), bitmap(keys)))  # two bitmaps of at most MOST_BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        widths, in_grams, in_keys = sent.value
        plan = Plan(widths)
        seen: dict[str, int] = {}

        def search(ids: list, words: list[str], ends: list[int]) -> Iterator[pd.DataFrame]:
            h = hash64(words, seen)
            end_of = np.repeat(np.asarray(ends), np.diff([0, *ends]))
            common: dict[int, np.ndarray] = {}
            for w in plan.walks:
                e = plan.edits[w]
                q, least = plan.gram(w, e)
                if q not in common:
                    common[q] = np.concatenate([[0], np.cumsum(among(grams(h, q), in_grams))])
                starts = np.flatnonzero(np.arange(len(h)) + w - e <= end_of)
                upto = np.minimum(starts + w - q + 1, len(common[q]) - 1)
                starts = starts[common[q][upto] - common[q][np.minimum(starts, upto)] >= least]
                if not len(starts):
                    continue
                keys = plan.keys(w, h, starts)
                hit = among(keys.view(np.uint64), in_keys)
                out: dict[tuple, np.ndarray] = {}
                for k in np.flatnonzero(hit.any(1)):
                    s = int(starts[k])
                    own = words[s : min(s + w + e, int(end_of[s]))]  # so many words as the window may have
                    out[ids[int(np.searchsorted(ends, s, "right"))], " ".join(own)] = keys[k][hit[k]]
                if out:
                    doc, own = zip(*out)
                    yield pd.DataFrame({"doc_id": doc, "width": w, "own": own, "keys": list(out.values())})

        for pdf in batches:
            ids: list = []
            words: list[str] = []
            ends: list[int] = []
            for i, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                ids.append(i)
                words += WORD.findall(t.lower())
                ends.append(len(words))
                if len(words) >= BATCH_WORDS:
                    yield from search(ids, words, ends)
                    ids, words, ends = [], [], []
            yield from search(ids, words, ends)

    edits_of = {w: e for w, (e, _) in plan.items()}

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, y in zip(pdf["own"], pdf["window"]):
                a, b = x.split(), y.split()
                d = 0 if a[: len(b)] == b else edit_distance(a, b, edits_of[len(b)], True)
                if d <= edits_of[len(b)]:
                    out.append((x, y, d))
            yield pd.DataFrame(out, columns=["own", "window", "edits"])

    hits = written(spark, rows.mapInPandas(run, "doc_id bigint, width int, own string, keys array<bigint>"), "leak-hits")
    # windows are compared once, however many documents and items have them
    ours = hits.groupBy("own", "width").agg(F.first("keys").alias("keys")).select("own", F.explode("keys").alias("key"))
    theirs = windows.groupBy("window").agg(F.first("keys").alias("keys")).select("window", F.explode("keys").alias("key"))
    same = ours.join(theirs, "key").select("own", "window").distinct().mapInPandas(verify, "own string, window string, edits int")
    met = same.join(windows.select("window", "item_id").distinct(), "window").groupBy("own", "item_id").agg(F.min("edits").alias("edits"))
    got = hits.select("doc_id", "own").distinct().join(met, "own")
    return got.groupBy("doc_id", "item_id").agg(F.count("*").cast("int").alias("windows"), F.min("edits").alias("edits"))


def found(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Documents and items that share a run of at least `run` consecutive words: doc_id, item_id.

    Windows of `run` words are searched within one edit, and those whose least edit distance is 0 are the runs: equal windows agree
    in every key, so none is missed. Null ids and texts take no part; items shorter than a run match nothing; repeated rows give one row.
    """
    return passages(docs, items, run, 1).where("edits = 0").select("doc_id", "item_id")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold a passage of an item with small edits, by item-sized windows: doc_id, item_id, windows, edits (least)."""
    return passages(docs, items)


def report(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Each item that leaked: item_id, documents, sources."""
    hits = found(docs, items, run).join(docs.select("doc_id", "source").dropDuplicates(["doc_id"]), "doc_id")
    return hits.groupBy("item_id").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))
