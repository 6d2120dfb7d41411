"""Problem 9: texts cut off before their end (min-hash banding, alignment of near copies, closing-word terminality).

A text that doesn't end with a full stop is looked for in longer near copies: the min-hash bands of nested heads of a text (its first
HEAD words, twice, four times as many, and so on) bring it together with its copies wherever it was cut; the copies are verified on
whole texts and aligned at its closing words, and it is cut if one of them goes on there inside the sentence. What has no such copy
is scored by the terminality of its closing word: how often that word ends a line or sentence, and how often lines of the same form
end without a full stop, over all lines of all texts but their last ones, which alone can be cut.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_CLASSES, WORD, hash64, mix, slices, texts_of, written
from .leak import among, bitmap
from .shingles import Signer

#: Near copies: words of a shingle, least share of the cut text's shingles that the copy holds, bands and rows of the min-hash, words of the shortest head.
WIDTH, SIMILARITY, BANDS, ROWS, HEAD = 5, 0.8, 6, 3, 24
#: Words of the closing run that is looked up in the other copy.
CLOSING = 8
#: Terminality from which a text may end with a word, how many uses the mean rate counts as beside those of the word, and the longest line that needn't be running text.
TERMINAL, WEIGHT, LINE_CHARS = 0.05, 4.0, 110
#: Share of words used once among those at the ends of a form's lines from which a new word is as good there as a known one.
NEW = 0.02
#: Characters at the end of a text in which a full stop with its closing marks, or a sign of omission, stands.
TAIL = 64
#: Entries of the table of words that a task holds before it hands them on.
HELD = 500_000

# Signs of omission that may follow a cut, and closing marks that may follow a full stop.
OMISSION = r"(?:\(more\)|\[more\]|\(continued\)|\[(?:…|\.{3})\]|\((?:…|\.{3})\)|…|\.{3,}|�)"
CLOSE = r"[\"'”“’»«›)\]]"
# Fixed value: how a sentence goes on.
ON = r"[ \t]*[,;]?[ \t]+[^\W\d_A-Z]|[ \t]+\("

_omitted = re.compile(OMISSION + r"$")
_stop = re.compile(rf"[.!?]{CLOSE}*$")
_break = re.compile(rf"(?:\w\w|[^\w\s])[.!?;]{CLOSE}*\s+\S")  # behind an initial stands no end of a sentence
_number = re.compile(r"\W*(?:[0-9]+[.)])+\s+")
_line = re.compile(r"[\r\n]+")
_digits = re.compile(r"[0-9]+")
_on = re.compile(r"\w|" + ON)
#: How a sentence goes on behind a word, and marks behind it at which a text may be cut.
_goes_on, _mark = re.compile(rf"_|{ON}"), re.compile(r"[\W_]*?[,;:(]")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "”“’»«›…·•"


def form(line: str) -> str:
    """Form of a line, by which terminality is counted: 'p' with the end of a sentence inside or long (running text), else 's' and the class of its first sign (a letter, 0 a digit, else the sign), with '|' for a row."""
    if len(line) > LINE_CHARS or _break.search(line, (m := _number.match(line)) and m.end() or 0):
        return "p"
    c = line[0]
    return "s" + ("a" if c.isalpha() else "0" if c.isdigit() else c) + ("|" if " | " in line or "\t" in line else "")


def word_of(token: str) -> str:
    """A token as it is counted: case kept, digits as one sign, no marks around it."""
    return _digits.sub("#", token.strip(_EDGE)) or token


def _whole(text: str) -> int:
    """Where a sign of omission at the end of a text begins, or the text's length."""
    m = _omitted.search(text, max(0, len(text) - TAIL))
    return m.start() if m else len(text)


def ending(text: str) -> tuple[str, str, str, bool]:
    """How a text with anything on it ends: stop, omitted or open; the form of its last line; its closing word; whether that is written like one inside a sentence."""
    bare = text.rstrip()
    if _whole(bare) < len(bare):
        return "omitted", "", "", False
    if _stop.search(bare, max(0, len(bare) - TAIL)):
        return "stop", "", "", False
    line = bare[max(bare.rfind("\n"), bare.rfind("\r")) + 1 :].strip()
    token = line.split()[-1]
    letters = token.strip(_EDGE)
    return "open", form(line), word_of(token), letters.isalpha() and letters[0].islower()


def _end(text: str) -> tuple[str, list[re.Match]]:
    """A text up to its last sign that is no white space or omission, and its last words (more than CLOSING); no words where it can't stop inside a sentence."""
    end = text.rstrip()
    end = end[: _whole(end)].rstrip()
    if not end or not (end[-1].isalnum() or end[-1] in ",;:("):
        return end, []
    back = 400
    while len(words := list(WORD.finditer(end, max(0, len(end) - back)))) <= CLOSING + 1 and back < len(end):  # the first may be only the end of a word
        back *= 4
    return end, words if len(words) > CLOSING else []


def stops_inside(short: str, other: str) -> bool:
    """Whether the end of `short` is found in `other`, and the other goes on there inside the same sentence.

    A number or a word in capitals can't go on inside: an `Annex I` is no cut `Annex II`."""
    end, words = _end(short)
    if not words:
        return False
    closing = end[words[-CLOSING - 1].start() :]  # the last word may be cut, so it is matched as a prefix
    at = other.rfind(closing)
    if at < 0:
        return False
    last = words[-1].group()
    if other[at + len(closing) : at + len(closing) + 1].isalnum() and (last.isdigit() or last.isupper()):
        return False
    return bool(_on.match(other, at + len(closing)))


def _run_hashes(words: list[str], seen: dict[str, int]) -> np.ndarray:
    """Hash of each run of CLOSING - 1 words."""
    h = hash64(words, seen)
    n = max(0, len(h) - CLOSING + 2)
    out = h[:n].copy()
    for k in range(1, CLOSING - 1):
        out = mix(out * _STEP + h[k : n + k])
    return out.view(np.int64)


class Counts:
    """Of each (form, word) over complete lines: how often the word ends such a line without a full stop (open), how often in any way (ends), how often a line or sentence (closing), and how often it is used."""

    def __init__(self) -> None:
        self.used: dict[str, Counter] = defaultdict(Counter)  # of each form its tokens as they are written
        self.last: dict[str, Counter] = defaultdict(Counter)  # and those at the ends of its lines

    def add(self, text: str) -> None:
        lines = [x for x in map(str.strip, _line.split(text)) if x]
        for line in lines[:-1]:
            f, tokens = form(line), line.split()
            self.used[f].update(tokens)
            self.last[f][tokens[-1]] += 1

    def __len__(self) -> int:
        return sum(map(len, self.used.values()))

    def taken(self) -> list[tuple]:
        held: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for f, tokens in self.used.items():
            for t, n in tokens.items():
                own = held[f, word_of(t)]
                own[3] += n
                own[2] += n if _stop.search(t) else 0
        for f, tokens in self.last.items():
            for t, n in tokens.items():
                own = held[f, word_of(t)]
                own[1] += n
                if not _stop.search(t):  # a line ends with a full stop as its last token does
                    own[0] += n
                    own[2] += n
        self.used.clear()
        self.last.clear()
        return [(f, w, *n) for (f, w), n in held.items()]


EXAMINED = "doc_id bigint, source string, c bigint, ending string, form string, word string, small boolean, run bigint, last int, bare boolean, cells array<bigint>, open bigint, ends bigint, closing bigint, uses bigint"


def _examined(docs: DataFrame) -> DataFrame:
    """One pass over the texts. A row for each text (without `uses`): how it ends, its closing run where it may be cut, and its cells;
    and rows of `Counts` (form, word, open, ends, closing, uses), added up in each task."""
    rows = docs.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", "source", F.xxhash64("text").alias("c"), "text")
    names = [x.split()[0] for x in EXAMINED.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def batch(**cols: list | pa.Array) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        got = [cols.get(k, pa.nulls(n, t)) for k, t in zip(names, kinds)]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(got, kinds)], names)

    def counted(counts: Counts) -> pa.RecordBatch:
        cols = map(list, zip(*counts.taken()))
        return batch(**dict(zip(("form", "word", "open", "ends", "closing", "uses"), cols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen, counts = Signer(WIDTH, BANDS, ROWS), {}, Counts()
        for b in (x.slice(i, j - i) for x in batches for i, j in slices(x.column(3).to_pylist())):
            ends, runs, last, bare, heads, of = [], [], [], [], [], []
            texts = b.column(3).to_pylist()
            for k, t in enumerate(texts):
                counts.add(t)
                ends.append(ending(t))
                end, closing = _end(t) if ends[-1][0] == "open" else ("", [])
                runs.append(int(_run_hashes([w.group() for w in closing[-CLOSING:-1]], seen)[0]) if closing else None)
                last.append(len(closing[-1].group()) if closing else 0)
                bare.append(bool(closing) and closing[-1].end() == len(end))
                words = WORD.findall(t.lower())
                n = HEAD
                while n <= len(words):
                    heads.append(words[:n])
                    of.append(k)
                    n *= 2
            cells: list[list[int]] = [[] for _ in texts]
            if heads:
                _, s, starts = signer.sets_of(heads, WIDTH)
                for k, own in zip(of, signer.keys(s, starts).tolist()):
                    cells[k] += own  # heads in order, so the last BANDS cells are those of the longest
            kind, form_, word, small = map(list, zip(*ends))
            yield batch(doc_id=b.column(0), source=b.column(1), c=b.column(2), ending=kind, form=form_, word=word, small=small, run=runs, last=last, bare=bare, cells=cells)
            if len(counts) > HELD:
                yield counted(counts)
        if len(counts):
            yield counted(counts)

    return rows.mapInArrow(run, EXAMINED)


def terminality(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From counts (form, word, open, ends, closing, uses): forms (form, rate: share of the lines of the form that end without a full
    stop; fresh: share of the words at their ends that are used once in all), and words (word, times: how much oftener than the mean
    it ends a line or sentence)."""
    each = counts.groupBy("form", "word").agg(*[F.sum(c).alias(c) for c in ("open", "ends", "closing", "uses")])
    words = each.groupBy("word").agg(F.sum("closing").alias("closing"), F.sum("uses").alias("uses"), F.collect_list(F.struct("form", "open", "ends")).alias("f"))  # forms are few
    rows = words.select("uses", F.inline("f"))
    once = F.when((F.col("uses") == 1) & (F.col("open") == 1), 1).otherwise(0)
    forms = rows.groupBy("form").agg((F.sum("open") / F.sum("ends")).alias("rate"), (F.sum(once) / F.greatest(F.sum("open"), F.lit(1))).alias("fresh"))
    mean = words.agg((F.sum("closing") / F.sum("uses")).alias("mean"))  # one row
    share = (F.col("closing") + F.lit(WEIGHT) * F.col("mean")) / (F.col("uses") + F.lit(WEIGHT))
    return forms, words.crossJoin(F.broadcast(mean)).select("word", (share / F.col("mean")).alias("times"))


def _places(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Each place of the texts (c, text) at which one of the closing runs may stand (all that do, and few others): c, run, next (characters of the word behind it), on (the sentence goes on behind that word), mark (so it may behind a mark)."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap(runs.select(F.col("run").alias("h"))))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in (x.slice(i, j - i) for x in batches for i, j in slices(x.column(1).to_pylist())):
            out = []
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = _run_hashes(WORD.findall(t), seen)[:-1]  # a word must stand behind
                hits = np.flatnonzero(among(own.view(np.uint64), sent.value))
                if len(hits):
                    words = list(WORD.finditer(t))
                    for k in hits:
                        word = words[k + CLOSING - 1]
                        out.append((c, int(own[k]), len(word.group()), bool(_goes_on.match(t, word.end())), bool(_mark.match(t, word.end()))))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["c", "run", "next", "on", "mark"])

    return texts.select("c", "text").mapInArrow(run, "c bigint, run bigint, next int, on boolean, mark boolean")


def _closed(docs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What candidates are made of: ends (cell, run, last, bare, c: texts that may be cut, with the cells of their longest head), places (cell, run, next, on, mark, c: texts in which the closing run of a text of the same cell stands), texts (c, text).

    Only cells with a text that may be cut and another text go on; large ones are split by the closing run, and no partner is dropped.
    """
    spark = docs.sparkSession
    cut = F.explode(F.when(F.col("run").isNotNull(), F.slice("cells", F.greatest(F.size("cells") - BANDS + 1, F.lit(1)), BANDS)))
    ends = texts.where("run is not null and size(cells) > 0").select("run", "last", "bare", "c", cut.alias("cell")).distinct()
    live = ends.groupBy("cell").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    live = written(spark, live, "truncation-live")
    few = live.count() <= BROADCAST_CLASSES
    cells = texts.select("c", F.explode("cells").alias("cell")).join(F.broadcast(live) if few else live, "cell").where("c <> least or least <> most").select("cell", "c").distinct()
    cells = written(spark, cells, "truncation-cells")
    ends = written(spark, ends.join(cells.select("cell").distinct(), "cell", "left_semi"), "truncation-ends")
    either = cells.select("c").unionByName(ends.select("c")).select(F.col("c").alias("a"), F.col("c").alias("b"))
    wanted = texts_of(spark, docs.where("text is not null").select(F.xxhash64("text").alias("c"), "text"), either)
    runs = written(spark, ends.groupBy("run").agg(F.min("last").alias("least")), "truncation-runs")
    few = runs.count() <= BROADCAST_CLASSES
    at = _places(wanted, runs).join(F.broadcast(runs) if few else runs, "run").where("next >= least and (on or mark or next > least)").select("c", "run", "next", "on", "mark").distinct()
    at = written(spark, at, "truncation-places")
    return ends, at.join(cells, "c").join(ends.select("cell", "run").distinct(), ["cell", "run"], "left_semi"), wanted


def _pairs(ends: DataFrame, places: DataFrame) -> DataFrame:
    """Texts in whose cells another text may go on behind their closing run: a (that other), b (the text that may be cut), both hashes of texts."""
    e, p = ends.alias("e"), places.alias("p")
    goes = "p.cell = e.cell and p.run = e.run and p.c <> e.c and (if(e.bare, p.on, p.mark) and p.next = e.last or e.bare and p.next > e.last)"
    return e.join(p, F.expr(goes)).select(F.col("p.c").alias("a"), F.col("e.c").alias("b")).distinct()


def ends_early(docs: DataFrame, examined: DataFrame) -> DataFrame:
    """Texts whose near copy goes on behind the place at which they stop inside a sentence: c (hash of the text), size (its characters).

    Exact copies are one text. One copy that goes on is enough, so each text is first compared with one for each of its cells (that
    in which most can stand behind its closing run), and with all the others only where none of these shows the cut.
    """
    spark = docs.sparkSession
    ends, places, texts = _closed(docs, examined)
    heads = places.groupBy("cell", "run").agg(F.max(F.struct("on", "next", "mark", "c")).alias("h")).select("cell", "run", "h.*")
    first = written(spark, _pairs(ends, heads), "truncation-first")
    early = written(spark, _verified(first, texts), "truncation-early")
    rest = _pairs(ends.join(early, "c", "left_anti"), places).join(first, ["a", "b"], "left_anti")
    return early.unionByName(_verified(written(spark, rest, "truncation-rest"), texts))


def contained(short: list[str], other: list[str]) -> bool:
    """Whether `other` holds at least SIMILARITY of the shingles of `short`."""
    s, t = (set(zip(*(w[k:] for k in range(WIDTH)))) for w in (short, other))
    return len(s & t) >= SIMILARITY * len(s)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b), each b of which a is a near copy that goes on where b stops inside a sentence: c."""
    both = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(b,) for b, x, y in zip(pdf["b"], pdf["ta"], pdf["tb"]) if stops_inside(y, x) and contained(WORD.findall(y.lower()), WORD.findall(x.lower()))]
            yield pd.DataFrame(out, columns=["c"])

    return both.select("b", "ta", "tb").mapInPandas(run, "c bigint").distinct()


def judged(docs: DataFrame) -> DataFrame:
    """Every text with anything on it: doc_id, source, ending (stop, omitted, open), form (of the last line of an open one), early (a near copy goes on), score (terminality of its closing word), truncated.

    Null, empty and blank texts and null ids give no row; repeated rows are judged alike; a short line of a form that no complete line of
    the table has is taken as complete, running text as cut. The score of a word written small is the rate of the form, less if the word ends a
    line or sentence more seldom than the mean, or, if no complete line has it, if fewer than the share NEW of the words at the ends
    of such lines are used once in all; that of a name or number is the rate of the form.
    """
    spark = docs.sparkSession
    all_ = written(spark, _examined(docs), "truncation-examined")
    texts = all_.where("uses is null")
    early = ends_early(docs, texts).withColumn("early", F.lit(True))
    counts = all_.where("uses is not null").select("form", "word", "open", "ends", "closing", "uses")
    rows = texts.where("doc_id is not null").select("doc_id", "source", "c", "ending", "form", "word", "small")
    forms, words = terminality(counts)
    asked = rows.where("ending = 'open' and small").select("word").distinct()
    words = words.join(asked, "word", "left_semi")
    got = rows.join(early, "c", "left").join(words, "word", "left").join(F.broadcast(forms), "form", "left")  # forms: a class of lines each
    # most cut words are new, but few of those that end a heading are; names and numbers, wherever they stand else, may end a line;
    # and no word makes a line of running text end without a full stop
    new = F.least(F.lit(1.0), F.col("fresh") / F.lit(NEW))
    word = F.when(~F.col("small"), 1.0).when(F.col("times").isNull(), new).otherwise(F.least(F.lit(1.0), "times"))
    score = F.when(F.col("rate").isNull(), F.when(F.col("form") == "p", 0.0).otherwise(1.0)).otherwise(F.col("rate") * word)
    got = got.withColumns({"early": F.coalesce("early", F.lit(False)), "score": F.when(F.col("ending") == "open", F.round(score, 6))})
    cut = (F.col("ending") == "omitted") | ((F.col("ending") == "open") & (F.col("early") | (F.col("score") < TERMINAL)))
    return got.select("doc_id", "source", "ending", "form", "early", "score", cut.alias("truncated"))


def found(docs: DataFrame) -> DataFrame:
    """Documents whose text stops inside a word or a running sentence: doc_id. Null, empty and blank texts are no case."""
    return judged(docs).where("truncated").select("doc_id").distinct()


def shares(docs: DataFrame) -> DataFrame:
    """How often each source truncates: source (null kept), documents (with text), truncated, share."""
    got = judged(docs).dropDuplicates(["doc_id"]).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("truncated").cast("bigint")).alias("truncated"))
    return got.withColumn("share", F.round(F.col("truncated") / F.col("documents"), 4))
