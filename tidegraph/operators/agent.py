"""Prompts for question answering, with and without the graph; the model itself is a function from outside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill, keyword_recall, numbered
from ..plans.tables import kept
from .context import context
from .linking import ordered_distinct
from .metering import USAGE
from .vectors import top_k_batch

# The wording of prompts, from which answers and token counts follow. Names in braces are slots.
FLAT_PROMPT = """Trả lời câu hỏi chỉ dựa trên ngữ cảnh. Nếu ngữ cảnh không đủ, nói không đủ thông tin.

Ngữ cảnh:
{chunks}

Câu hỏi: {question}
Trả lời:"""
GRAPH_PROMPT = """Trả lời câu hỏi chỉ dựa trên ngữ cảnh (đoạn văn bản và dữ kiện từ knowledge graph).
Nêu rõ số Điều luật khi có. Nếu ngữ cảnh không đủ, nói không đủ thông tin.

Dữ kiện knowledge graph:
{facts}

Đoạn văn bản:
{chunks}

Câu hỏi: {question}
Trả lời:"""
JUDGE_PROMPT = """Chấm câu trả lời so với đáp án chuẩn. Trả về JSON {"score": 0|1|2, "reason": "..."}:
2 = đúng và đủ các ý chính, 1 = đúng một phần, 0 = sai hoặc không trả lời được.
Câu hỏi: {question}
Đáp án chuẩn: {gold}
Câu trả lời: {answer}"""


def flat_prompt(question: Column, chunks: Column) -> Column:
    return fill(FLAT_PROMPT, chunks=numbered(chunks), question=question)


def graph_prompt(question: Column, facts: Column, chunks: Column) -> Column:
    listed = F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n")
    return fill(GRAPH_PROMPT, facts=listed, chunks=numbered(chunks), question=question)


def judge_prompt(question: Column, gold: Column, answer: Column) -> Column:
    return fill(JUDGE_PROMPT, question=question, gold=gold, answer=answer)


def _hits(store: DataFrame, questions: DataFrame, embed: Callable[[Column], Column], top_k: int) -> DataFrame:
    asked = questions.select(F.col("question_id").alias("query_id"), embed(F.col("question")).alias("query"))
    # chunks stay where they lie; the hits are few, and what is asked of them more than once reads them as a table
    return kept(top_k_batch(store, asked, top_k, blocks=0).withColumnRenamed("query_id", "question_id"))


def _chunks(hits: DataFrame) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"])
    return hits.groupBy("question_id").agg(listed.alias("chunks"))


class KnowledgeBaseAgent:
    """Flat: the top_k chunks as context."""

    def __init__(self, store: DataFrame, embed: Callable[[Column], Column], llm_fn: Callable[[Column], Column] | None = None) -> None:
        self.store, self.embed, self.llm = store, embed, llm_fn or (lambda prompt: prompt)

    def answer(self, questions: DataFrame, top_k: int = 3) -> DataFrame:
        """questions (question_id, question): (question_id, prompt, answer)."""
        out = questions.join(_chunks(_hits(self.store, questions, self.embed, top_k)), "question_id", "left")
        out = out.withColumn("prompt", flat_prompt(F.col("question"), F.coalesce("chunks", F.array().cast("array<string>"))))
        return out.select("question_id", "prompt", self.llm(F.col("prompt")).alias("answer"))


class GraphRAGAgent:
    """The same chunks, and the facts that the graph gives for their documents."""

    def __init__(self, store: DataFrame, nodes: DataFrame, edges: DataFrame, embed: Callable[[Column], Column], llm_fn: Callable[[Column], Column] | None = None) -> None:
        self.store, self.nodes, self.edges, self.embed, self.llm = store, nodes, edges, embed, llm_fn or (lambda prompt: prompt)

    def answer(self, questions: DataFrame, top_k: int = 3, max_facts: int = 60) -> DataFrame:
        hits = _hits(self.store, questions, self.embed, top_k)
        ids = ordered_distinct(hits.withColumn("doc", F.element_at("metadata", "doc_id")), "question_id", "doc", "rank")
        ids = ids.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc"))), lambda x: x["doc"]).alias("doc_ids"))
        asked = questions.select("question_id", "question").join(ids, "question_id", "left").withColumn("doc_ids", F.coalesce("doc_ids", F.array().cast("array<string>")))
        out = asked.join(context(self.nodes, self.edges, asked, max_facts), "question_id").join(_chunks(hits), "question_id", "left")
        out = out.withColumn("prompt", graph_prompt(F.col("question"), F.col("facts"), F.coalesce("chunks", F.array().cast("array<string>"))))
        return out.select("question_id", "facts", "prompt", self.llm(F.col("prompt")).alias("answer"))


def benchmark(questions: DataFrame, answers: dict[str, DataFrame], judge: Callable[[Column], Column] | None = None) -> DataFrame:
    """questions (question_id, question, gold, must_include) x pipelines (question_id, answer and what usage columns there are):
    (question_id, pipeline, answer, recall, judge, and usage, 0 where a pipeline tells none).

    judge answers a prompt with JSON; a score it does not name counts 0, without a judge the column is null.
    """
    out = None
    for name, rows in answers.items():
        usage = [F.col(c) if c in rows.columns else F.lit(0).alias(c) for c in USAGE]
        one = rows.select("question_id", F.lit(name).alias("pipeline"), "answer", *usage)
        out = one if out is None else out.unionByName(one)
    out = out.join(questions, "question_id")
    score = F.lit(None).cast("int")
    if judge is not None:
        score = F.coalesce(F.get_json_object(judge(judge_prompt(F.col("question"), F.col("gold"), F.col("answer"))), "$.score").cast("int"), F.lit(0))
    return out.select("question_id", "pipeline", "answer", keyword_recall("answer", "must_include").alias("recall"), score.alias("judge"), *USAGE)
