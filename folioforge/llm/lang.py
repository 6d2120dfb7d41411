"""Problem 2: language of documents and of segments (nearest of several centroids per language, with rejection)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, text_chunks

#: Two-letter codes of the languages and the three-letter codes that name them.
CODES = {
    "en": "eng", "fr": "fra fre", "de": "deu ger", "es": "spa", "it": "ita", "pt": "por", "nl": "nld dut", "pl": "pol", "el": "ell gre", "sv": "swe",
}
#: Bound of the labelled sample: chunks of each label, by hash of the id, of at most so many characters; sentences of a chunk and of each label taken from them.
SAMPLE_CHUNKS, SAMPLE_CHARS, CHUNK_SENTENCES, SAMPLE_SENTENCES = 250, 20_000, 4, 500
#: Dimensions of the hashed n-gram space, longest n-gram, centroids per language, n-grams of a word and sentences that are taken at once.
DIM, GRAM, CENTROIDS, AT_ONCE, ROWS = 4096, 4, 3, 65_536, 512
#: A segment whose best cosine is under this share of the low (2 %) quantile seen in training is of no known language.
REJECT = 0.6
#: Confidence under which a sentence is given the main language of its chunk's other sentences.
UNSURE = 0.6
#: Characters of running text from which a chunk holds a language.
MIN_CHARS = 60

_markup = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|&#?\w+;|\\[A-Za-z]+\*?|!?\[\[?(?:File:)?|\]\]?(?:\([^()\s]*\))?|\{\{[^{}]*\}\}|[{}*`~_]|'{2,}", re.S)
_sentence = re.compile(r"(?<=[.;!?])[)”»\"]*\s+")
_stop = re.compile(r"[.;!?…][)”»\"’\]]*$")
_paren = re.compile(r"\([^()]{0,59}\)|\([^()]*\d[^()]*\)")  # short insertions and codes are no running text


def named(lang: Column) -> Column:
    """Two-letter code that a label names, or null: case, region, three-letter codes and outer blanks don't matter."""
    pairs = [F.lit(x) for two, three in CODES.items() for k in (two, *three.split()) for x in (k, two)]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)))


def running(text: str | None) -> list[str]:
    """Sentences of running text: lines that are headings, names, codes, tables or list entries give none."""
    out = []
    for line in (text or "").split("\n"):
        line = line.strip()
        if len(line) < 20 or line[0] == "#":
            continue
        if any(x in line for x in "<\\&{[*`~'_"):
            line = _markup.sub(" ", line).strip()
        if not _stop.search(line) and not _sentence.search(line) and len(line) < 90:
            continue
        for s in _sentence.split(line):
            if "(" in s:
                s = _paren.sub("", s)
            s = s.strip()
            if len(s) >= 12 and s.count(" ") >= 2 and not s.isupper():
                out.append(s)
    return out


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(1, GRAM + 1) for i in range(len(w) - n + 1) if w[i : i + n] != " "]


def _bucket(g: str) -> int:
    return xxhash.xxh32_intdigest(g.encode("utf-8", "surrogatepass")) % DIM


def buckets(word: str) -> np.ndarray:
    """Hashed n-grams of a word; numbers have none."""
    return np.array([_bucket(g) for g in grams(word)] if not word.isdigit() else [], np.int64)


def counted(sentences: list[str]) -> np.ndarray:
    """A row of DIM n-gram counts for each sentence."""
    seen: dict[str, np.ndarray] = {}
    out = np.zeros((len(sentences), DIM), np.float32)
    for i, s in enumerate(sentences):
        for w in WORD.findall(s.lower()):
            if w not in seen:
                seen[w] = buckets(w)
            np.add.at(out[i], seen[w], 1)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1."""
    x = counts * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from the rows farthest from one another."""
    c = [x.mean(0)]
    for _ in range(k - 1):
        c.append(x[np.argmin(np.max(x @ np.stack(c).T, 1))])
    c = np.stack(c)
    for _ in range(8):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        at = np.argmax(x @ c.T, 1)
        c = np.stack([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(k)])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


class Model:
    """Centroids in the hashed TF-IDF space, each of a language, and of each language the low quantile of the cosines in the fit.

    Words are hashed and projected on the centroids once and kept (up to a bound); a sentence is the sum of its words, over its length
    in the space, which is counted exactly.
    """

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, floor: np.ndarray):
        self.langs, self.of, self.floor = langs, of, floor
        self.args = (langs, idf, centroids, of, floor)
        self.proj = (centroids.T * idf[:, None]).astype(np.float32)
        self.squares = idf.astype(np.float64) ** 2
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((1024, self.proj.shape[1]), np.float32)
        self.grams: list[np.ndarray] = []

    def _word(self, w: str) -> int:
        i = len(self.seen)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        g = buckets(w)
        for a in range(0, len(g), AT_ONCE):
            self.rows[i] += self.proj[g[a : a + AT_ONCE]].sum(0)
        self.grams.append(g)
        self.seen[w] = i
        return i

    def classify(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: none) and confidence of each sentence."""
        parts = [self._some(sentences[a : a + ROWS]) for a in range(0, len(sentences), ROWS)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0))

    def _some(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.seen) > 200_000:
            self._reset()
        ids: list[int] = []
        ends = []
        seen = self.seen
        for s in sentences:
            ws = WORD.findall(s.lower())
            ids.extend([seen[w] if w in seen else self._word(w) for w in ws])
            ends.append(len(ids))
        n = len(sentences)
        of = np.repeat(np.arange(n), np.diff([0, *ends]))
        sums = np.zeros((n, self.proj.shape[1]), np.float32)
        norm = np.full(n, 1e-9)
        if ids:
            first = np.flatnonzero(np.diff(of, prepend=-1))
            sums[of[first]] = np.add.reduceat(self.rows[ids], first, 0)
            held = [self.grams[i] for i in ids]
            key = np.concatenate(held) + np.repeat(of * DIM, [len(g) for g in held])
            key.sort()
            at = np.flatnonzero(np.diff(key, prepend=-1))
            times = np.diff(np.append(at, len(key))).astype(np.float64)
            norm += np.sqrt(np.bincount(key[at] // DIM, times * times * self.squares[key[at] % DIM], n))
        cos = sums / norm[:, None]
        best = np.full((n, len(self.langs)), -1.0)
        for j, lang in enumerate(self.of):
            best[:, lang] = np.maximum(best[:, lang], cos[:, j])
        top = best.argmax(1)
        c = best[np.arange(len(top)), top]
        e = np.exp(40 * (best - c[:, None]))
        return np.where(c < REJECT * self.floor[top], -1, top), 1.0 / e.sum(1)


def fit(rows: list[tuple[str, str]]) -> Model:
    """Fit on (label, text) rows: wrong labels are dropped by two rounds of one centroid per language, then each language is clustered."""
    data: dict[str, list[str]] = {}
    for lang, text in rows:
        own = data.setdefault(lang, [])
        own.extend(s for s in running(text)[:CHUNK_SENTENCES] if len(s) >= 40 and len(own) < SAMPLE_SENTENCES)
    langs = sorted(k for k, v in data.items() if v)
    if not langs:
        return Model(["en"], np.ones(DIM, np.float32), np.zeros((1, DIM), np.float32), np.zeros(1, int), np.ones(1))
    x = counted([s for k in langs for s in data[k]])
    y = np.concatenate([np.full(len(data[k]), i) for i, k in enumerate(langs)])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = weighted(x, idf)
    keep = np.ones(len(x), bool)
    for _ in range(3):
        c = np.stack([x[keep & (y == i)].mean(0) if (keep & (y == i)).any() else np.zeros(DIM, np.float32) for i in range(len(langs))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        keep = (x @ c.T).argmax(1) == y
    cs, of, floor = [], [], []
    for i in range(len(langs)):
        own = x[keep & (y == i)]
        own = own if len(own) else x[y == i]
        k = _clusters(own, min(CENTROIDS, len(own)))
        cs.append(k)
        of += [i] * len(k)
        floor.append(float(np.quantile((own @ k.T).max(1), 0.02)))
    return Model(langs, idf, np.concatenate(cs), np.array(of), np.array(floor))


def train(chunks: DataFrame) -> Model:
    """Model from a bounded sample of labelled text chunks (see SAMPLE_CHUNKS); the ids are chosen without reading texts."""
    own = text_chunks(chunks).select("id", "lang", "body")
    w = Window.partitionBy("label").orderBy("h", "id")
    chosen = (
        own.select("id", named(F.col("lang")).alias("label"), F.xxhash64("id").alias("h"))
        .where("label is not null")
        .withColumn("k", F.row_number().over(w))
        .where(F.col("k") <= SAMPLE_CHUNKS)
        .select("id", "label")
        .distinct()
    )
    ids = [r[0] for r in chosen.collect()]
    if not ids:
        return fit([])
    # at most SAMPLE_CHUNKS ids of each of ten labels: a bounded broadcast
    rows = own.join(F.broadcast(chosen), "id").where(F.length("body") <= SAMPLE_CHARS).select("id", "label", F.col("body").alias("t")).dropDuplicates(["id"]).orderBy("label", "id").collect()
    return fit([(r["label"], r["t"]) for r in rows])


def segments(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """Each sentence of running text of each text chunk: id, source_pdf, label, segment_no, chars, lang (null: none known), confidence.

    Null and blank texts give no row; the whole text is read, however long; repeated rows of one id count once.
    """
    return _apply(chunks, model, True)


def languages(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """Languages of each text chunk: id, source_pdf, label, lang, chars of running text, confidence (mean by characters)."""
    return _apply(chunks, model, False)


def _apply(chunks: DataFrame, model: Model | None, each: bool) -> DataFrame:
    spark = chunks.sparkSession
    fitted = train(chunks) if model is None else model
    sent = spark.sparkContext.broadcast(fitted.args)  # DIM x 10 languages x CENTROIDS floats
    rows = text_chunks(chunks).select("id", "source_pdf", named(F.col("lang")).alias("label"), "body")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*sent.value)
        for pdf in batches:
            body = pdf["body"].tolist()
            for a in range(0, len(body), 512):
                sentences: list[str] = []
                of: list[int] = []
                no: list[int] = []
                for i in range(a, min(a + 512, len(body))):
                    ss = running(body[i])
                    sentences += ss
                    of += [i] * len(ss)
                    no += range(1, len(ss) + 1)
                if not sentences:
                    continue
                lang, conf = m.classify(sentences)
                got = pd.DataFrame({"i": of, "segment_no": no, "chars": [len(s) for s in sentences], "k": lang, "confidence": conf})
                unsure = (got["confidence"] < UNSURE) & (got["k"] >= 0)
                if unsure.any():  # a sentence between two languages goes with the surer ones of its chunk
                    sure = got[~unsure & (got["k"] >= 0)].groupby(["i", "k"], as_index=False)["chars"].sum()
                    most = sure.sort_values("chars").drop_duplicates("i", keep="last").set_index("i")["k"]
                    got.loc[unsure, "k"] = got.loc[unsure, "i"].map(most).fillna(got.loc[unsure, "k"]).astype(int)
                if not each:
                    got = got[got["k"] >= 0]
                    got["w"] = got["chars"] * got["confidence"]
                    got = got.groupby(["i", "k"], as_index=False)[["chars", "w"]].sum()
                    got["confidence"] = got["w"] / got["chars"]
                if not len(got):
                    continue
                for c in ("id", "source_pdf", "label"):
                    got[c] = pdf[c].to_numpy(object)[got["i"]]
                got["lang"] = [m.langs[k] if k >= 0 else None for k in got["k"]]
                yield got[["id", "source_pdf", "label", *(["segment_no"] if each else []), "lang", "chars", "confidence"]]

    seg = "segment_no int, " if each else ""
    got = rows.mapInPandas(run, f"id string, source_pdf string, label string, {seg}lang string, chars int, confidence double")
    return got


def found(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """Text chunks that hold at least MIN_CHARS of a language other than their label names: id, lang."""
    got = languages(chunks, model)
    return got.where((F.col("chars") >= MIN_CHARS) & ~F.col("lang").eqNullSafe(F.col("label"))).select("id", "lang").distinct()


def documents(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """One language for each source_pdf: lang (of most running text; ties by code), confidence (its share times the mean confidence), chars, languages.

    Rows delivered twice under one id count once. Sources without running text have lang null and confidence 0.
    """
    per = languages(chunks, model).dropDuplicates(["id", "lang"]).groupBy("source_pdf", "lang").agg(
        F.sum("chars").alias("c"), F.sum(F.col("chars") * F.col("confidence")).alias("w")
    )
    best = per.groupBy("source_pdf").agg(
        F.max(F.struct("c", F.col("lang").alias("l"), "w")).alias("b"), F.sum("c").alias("chars"), F.count("*").cast("int").alias("languages")
    )
    sources = text_chunks(chunks).select("source_pdf").distinct()
    return sources.join(best, "source_pdf", "left").select(
        "source_pdf",
        F.col("b.l").alias("lang"),
        F.round(F.coalesce(F.col("b.w") / F.col("chars"), F.lit(0.0)), 4).alias("confidence"),
        F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"),
        F.coalesce("languages", F.lit(0)).alias("languages"),
    )
