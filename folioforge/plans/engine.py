"""Question answering over an index: retrieve, judge, retrieve again, pack, answer, cite. Models are swappable callables."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat, citations, context, index, retrieve
from ..operators.index import Lexical
from ..storage import written
from ..types import data_type


@dataclass(frozen=True)
class Settings:
    """Candidates of each list, results, weight of the vector list, rounds, characters of a context and of a question."""

    candidates: int = retrieve.CANDIDATES
    top: int = retrieve.TOP
    alpha: float = retrieve.ALPHA
    rounds: int = 3
    context_chars: int = context.MAX_CHARS
    question_chars: int = chat.MAX_QUESTION


#: Presets by the reading situation.
INTERFACE, NOTEBOOK = Settings(), Settings(candidates=80, top=14)


def sampling(model: str, temperature: float = 0.0, seed: int = 0, fixed_temperature: tuple[str, ...] = ("gpt-5",)) -> dict:
    """Sampling options of a model call: no temperature for models that fix it, no seed if it is 0."""
    out = {} if model.startswith(fixed_temperature) else {"temperature": temperature}
    return out | ({"seed": seed} if seed else {})


def prompt(question: str, packed: str) -> str:
    """Prompt of an answer: the passages, the question, and how to cite."""
    return (
        f"Passages, each with its number:\n{packed}\n\nQuestion: {question}\n\n"
        "Answer from the passages alone. Put the number of the passage that supports a statement behind it, as in [S2]. "
        "Say so if the passages don't answer the question. Write no list of sources."
    )


def style_prompt(question: str, packed: str) -> str:
    """Prompt over passages of web pages whose headers tell tags and styles: the passages' look may be asked for."""
    return prompt(question, packed) + " Where a passage's header names its HTML tag and its style, use them for questions on layout and appearance, and leave them out otherwise."


def short_prompt(question: str, packed: str) -> str:
    """Prompt of the notebooks: passages and question, with the passages' labels as citations."""
    return f"{packed}\n\nQuestion: {question}\nAnswer shortly, from the passages above only, and name the passage behind each statement as [S1], [S2] and so on."


def judge_prompt(question: str, packed: str) -> str:
    """Prompt of a judging model: whether the passages suffice, as JSON."""
    return f'Passages:\n{packed}\n\nQuestion: {question}\n\nDo the passages suffice for an answer? Reply with JSON alone: {{"sufficient": true or false, "reason": "...", "new_query": "what to search for next, or empty"}}'


def judge_coverage(least: float = 0.5) -> Callable[[str, str], dict]:
    """Default judge without a model: enough if at least so many of the question's words stand in the context; else the missing words are the next query."""

    def judge(question: str, packed: str) -> dict:
        words = [w for w in dict.fromkeys("".join(c if c.isalnum() else " " for c in question.lower()).split()) if len(w) > 3]
        low = packed.lower()
        missing = [w for w in words if w not in low]
        return {"sufficient": len(missing) <= (1 - least) * len(words), "reason": f"{len(missing)} of {len(words)} words missing", "new_query": " ".join(missing)}

    return judge


def extract(question: str, packed: str) -> Iterator[str]:
    """Default answer without a model: the first sentence of each of the first three passages, with its number."""
    for i, section in enumerate(packed.split("\n\n[")[:3], 1):
        body = section.partition("]\n")[2].strip()
        if body:
            yield f"{body.split('. ')[0].rstrip('.')} [S{i}]. "


def steps(judgement: dict | None, current: str) -> str | None:
    """The next query of the loop, or None to stop: enough, nothing new asked, or the same asked again. A judge that failed counts as enough."""
    if judgement is None or judgement.get("sufficient", False):
        return None
    new = str(judgement.get("new_query") or "").strip()
    return new if new and new.lower() != current.strip().lower() else None


def question_of(user_message: str | dict | None, messages: list[dict] | None = None, body: dict | None = None) -> str:
    """The question of a chat call, stripped: the last user message of `messages`; where that is blank or there is none, of the body's messages; else the plain message."""

    def text(content) -> str:
        if isinstance(content, list):
            parts = (x if isinstance(x, str) else x.get("text") or x.get("content") for x in content if isinstance(x, (str, dict)))
            return "\n".join(p for p in parts if isinstance(p, str) and p)
        return content if isinstance(content, str) else ""

    for said in (messages, body.get("messages") if isinstance(body, dict) else None):
        last = next((m for m in reversed(said or []) if isinstance(m, dict) and m.get("role") == "user"), {})
        if question := text(last.get("content")).strip():
            return question
    return text(user_message.get("content") if isinstance(user_message, dict) else user_message).strip()


def open_index(spark: SparkSession, base: str, corpus: str, paths: list[str], docs: Callable[[], DataFrame], model: str = "precomputed", rebuild: bool = False, key: str = "key", text: str = "text") -> Lexical:
    """The stored index of a corpus, built again only if its files, its model or the wish say so. `docs` is called only then."""
    at = index.index_path(base, corpus, model)
    digest = index.fingerprint(spark, paths).first()[0]
    try:
        known = spark.read.parquet(f"{at}/meta")
        known.first()
    except AnalysisException:
        known = None
    if not index.stale(known, digest, model, rebuild):
        return Lexical.read(spark, at)
    built = index.lexical(docs(), key, text).write(at)
    index.meta(spark, corpus, base, paths, built.lengths.count(), digest, model).coalesce(1).write.mode("overwrite").parquet(f"{at}/meta")
    return built


@dataclass
class Engine:
    """An index with its models.

    chunks: key, label, text. embeddings: key, embedding. embed: texts to vectors (None: lexical retrieval only).
    """

    spark: SparkSession
    index: Lexical | None
    chunks: DataFrame
    embeddings: DataFrame | None = None
    embed: Callable[[list[str]], list[list[float]]] | None = None
    scorer: Callable[[list[str], list[str]], list[float]] | None = None
    judge: Callable[[str, str], dict] = field(default_factory=judge_coverage)
    generate: Callable[[str, str], Iterator[str]] = extract
    settings: Settings = INTERFACE
    delay: float = 0.0  # seconds between the parts of an answer that is streamed

    def prepare(self) -> Engine:
        """Keep the index's tables in memory where they fit, else on disk."""
        for t in (self.index.postings, self.index.lengths, self.index.terms, self.index.corpus) if self.index else ():
            t.persist()
        return self

    def close(self) -> None:
        for t in (self.index.postings, self.index.lengths, self.index.terms, self.index.corpus) if self.index else ():
            t.unpersist()

    def retrieve(self, queries: DataFrame, where: str | None = None) -> DataFrame:
        """Ranked passages of a batch of queries (query_id, query, and embedding for hybrid retrieval): query_id, key, place, rerank_score, label, text.

        `where` filters chunks by their metadata before the lists are cut; the statistics of the terms stay those of the whole corpus."""
        if self.index is None:
            return self.spark.createDataFrame([], "query_id int, key string, place int, rerank_score double, label string, text string")
        k, chunks, ix, vectors = self.settings.candidates, self.chunks, self.index, self.embeddings
        if where:
            chunks = chunks.where(where)
            own = chunks.select("key").distinct()
            ix = Lexical(ix.postings.join(own, "key", "left_semi"), ix.lengths.join(own, "key", "left_semi"), ix.terms, ix.corpus)
            vectors = vectors.join(own, "key", "left_semi") if vectors is not None else None
        q = queries.withColumnRenamed("query", "text")
        if vectors is not None and "embedding" in queries.columns:
            found = retrieve.hybrid(ix, vectors, q, k, self.settings.alpha)
        else:
            found = retrieve.bm25(ix, q, k)
        rows = found.join(chunks.select("key", "label", "text"), "key").join(queries.select("query_id", "query"), "query_id")
        return retrieve.rerank(rows, self.settings.top, self.scorer).drop("query", "rank", "score")

    def _round(self, query: str) -> DataFrame:
        row = (0, query, self.embed([query])[0]) if self.embed else (0, query)
        return self.retrieve(self.spark.createDataFrame([row], "query_id int, query string" + (", embedding array<float>" if self.embed else "")))

    def gather_batch(self, questions: DataFrame, where: str | None = None) -> DataFrame:
        """The loop for many questions at once (query_id int, query): query_id, context, included, used_chars, passages (array of key, label, text in their order).

        Each round is one plan over all questions that are still open; judging runs on the executors; what a round found is written to
        the shared folder. Only the number of open questions comes to the driver.
        """
        asked = written(self.spark, questions.select("query_id", "query", F.col("query").alias("current")).distinct(), "loop-open")
        open_, kept = asked, None
        embed, judge = self.embed, self.judge
        for k in range(max(1, self.settings.rounds)):
            now = open_.select("query_id", F.col("current").alias("query"))
            if embed:
                vector = F.pandas_udf(lambda s: pd.Series([[float(x) for x in v] for v in embed(s.tolist())]), data_type("array<float>"))
                now = now.withColumn("embedding", vector("query"))
            got = self.retrieve(now, where).select("query_id", F.lit(k).alias("round"), "place", "key", "label", "text")
            kept = written(self.spark, got if kept is None else kept.unionByName(got), f"loop-{k}")
            order = retrieve.union_rounds(kept.select("query_id", "round", "place", "key")).select("query_id", "key", (F.col("position") - 1).alias("place"))
            ranked = order.join(kept.dropDuplicates(["query_id", "key"]).drop("place", "round"), ["query_id", "key"])
            packed = context.pack(ranked, self.settings.context_chars)
            if k + 1 == self.settings.rounds:
                break
            both = open_.join(packed.select("query_id", "context"), "query_id")

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    out = []
                    for i, first, current, text in zip(pdf["query_id"], pdf["query"], pdf["current"], pdf["context"]):
                        try:
                            said = judge(first, text)
                        except Exception:
                            said = None
                        if (new := steps(said, current)) is not None:
                            out.append((i, first, new))
                    yield pd.DataFrame(out, columns=["query_id", "query", "current"])

            open_ = written(self.spark, both.mapInPandas(run, "query_id int, query string, current string"), f"loop-open-{k}")
            if open_.isEmpty():
                break
        passages = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "key", "label", "text"))).alias("passages"))  # at most rounds x top
        return packed.join(passages, "query_id").withColumn("passages", F.slice("passages", 1, F.col("included")))

    def gather(self, question: str) -> tuple[str, list[dict]]:
        """(context, passages) of one question after up to `rounds` rounds: the batch of one."""
        row = self.gather_batch(self.spark.createDataFrame([(0, question)], "query_id int, query string")).first()
        return (row["context"], [p.asDict() for p in row["passages"]]) if row else ("", [])

    def pipe(self, user_message: str | None, messages: list[dict] | None = None, body: dict | None = None) -> Iterator[str]:
        """Answer of a chat call."""
        return self.answer(question_of(user_message, messages, body))

    def answer(self, question: str) -> Iterator[str]:
        """The answer in parts, then the block of the sources that it cites. A bad question or a failing model is answered by a line saying so."""
        question = (question or "").strip()
        if not question or len(question) > self.settings.question_chars:
            yield "The question is empty." if not question else "The question is too long."
            return
        packed, used = self.gather(question)
        said = []
        try:
            for part in self.generate(question, packed):
                if said and self.delay:
                    time.sleep(self.delay)
                said.append(part)
                yield part
        except Exception as e:
            yield f"The answer failed: {e}"
            return
        yield self.sources("".join(said), used)

    def reply(self, question: str) -> str:
        """The whole answer at once."""
        return "".join(self.answer(question))

    def sources(self, answer: str, used: list[dict]) -> str:
        """Block of the sources that an answer cites, verbatim; an empty string without any."""
        answers = self.spark.createDataFrame([(0, 0, answer)], "answer_id int, query_id int, answer string")
        rows = [(0, i, r["label"], r["text"]) for i, r in enumerate(used)]
        ctx = self.spark.createDataFrame(rows, "query_id int, place int, label string, text string")
        got = citations.sources_block(citations.entries(answers, ctx)).first()
        return got["block"] if got else ""


def post_process(messages: DataFrame) -> DataFrame:
    """Answers with a block of sources (answer_id, content) made clickable: answer_id, content (renumbered), sources (array of group_no, label, quotes)."""
    parts = messages.select("answer_id", citations.split_block("content").alias("s"))
    answers = parts.select("answer_id", F.col("s.visible").alias("answer"))
    order = answers.select("answer_id", F.posexplode(citations.cited("answer")).alias("position", "number"))
    entry = parts.select("answer_id", F.explode("s.entries").alias("e")).select("answer_id", "e.*").dropDuplicates(["answer_id", "number"])
    grouped = citations.groups(order.join(entry, ["answer_id", "number"]))
    chips = grouped.groupBy("answer_id", "group_no", "label").agg(F.array_sort(F.collect_list(F.struct("position", "quote"))).alias("q"))
    chips = chips.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("group_no", "label", F.col("q.quote").alias("quotes")))).alias("sources"))
    return citations.renumber(answers, grouped).join(chips, "answer_id", "left").select("answer_id", F.col("answer").alias("content"), "sources")
