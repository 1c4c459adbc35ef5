"""Remote models over many questions: reranking of candidates and chat with cited context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.functions.remote import Remote, with_answers
from loamspark.operators.answering import prompt, remote_documents

# What the model is told, by task, and the answer where it gives none.
SYSTEM = (
    "你是一个严谨的RAG问答助手。回答时必须优先依据给定资料，不要编造来源中不存在的信息。若资料不足，请明确说不知道或资料不足。"
    "回答尽量简洁；如果资料给出了章节、页码、行号、符号名或 URL 位置，请在答案里自然带出这些定位信息。"
)
INSTRUCTIONS = {
    "book_index": " 如果用户在整理全书或章节索引，请优先按章节/主题结构化输出，并尽量附上页码或定位信息。",
    "table_lookup": " 如果问题是表格或数值查找，请优先引用表格证据；当表格置信度低时，要明确说明该数值证据风险较高。",
    "code_symbol_lookup": " 如果问题是代码定位，请优先回答符号名、文件、行号和相邻实现上下文。",
    "qa_explanation": " 如果问题偏解释型，请先给结论，再用资料中的关键依据展开。",
}
NO_ANSWER = "暂时没有生成可用回答。"
SCORES = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def instruction(task: Column) -> Column:
    return F.coalesce(*[F.when(task == name, F.lit(text)) for name, text in INSTRUCTIONS.items()], F.lit(""))


def messages(citations: DataFrame, questions: DataFrame, most_history: int = 6) -> DataFrame:
    """(question_id, messages): system text with the task's instruction, the last turns, the prompt with its context.

    Questions: question_id, question, task_type, and optional ``history``, an array of
    (role, content) in order.
    """
    asked = questions.join(prompt(citations, questions), "question_id")
    said = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    parts = [said("system", F.concat(F.lit(SYSTEM), instruction(F.col("task_type"))))]
    if "history" in questions.columns:
        turns = F.transform(F.coalesce("history", F.array()), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
        parts.append(F.slice(turns, F.greatest(F.size(turns) - most_history + 1, F.lit(1)), F.lit(most_history)) if most_history else F.slice(turns, 1, 0))
    return asked.select("question_id", F.concat(*parts, said("user", F.col("prompt"))).alias("messages"))


def chat(asked: DataFrame, remote: Remote) -> DataFrame:
    """(question_id, answer) of ``messages``; an empty answer is stated as none."""
    made = with_answers(asked.select("question_id", "messages"), F.struct("messages"), remote, "answer", T.StringType())
    return made.select("question_id", F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.lit(NO_ANSWER)).alias("answer"))


def remote_reranker(remote: Remote, questions: DataFrame, chunks: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A reranker for ``answering.rerank``: one input for each question with its candidates' texts, answered by positions and scores.

    Positions that are none of the candidates' are dropped, as are candidates that the
    service leaves out.
    """
    texts = chunks.select(F.col("id").alias("chunk_id"), remote_documents().alias("text"))

    def rerank(candidates: DataFrame) -> DataFrame:
        # The candidates of a question are a cut list, so they are gathered as one input.
        one = F.struct((-F.col("score")).alias("order"), "chunk_id", "text")
        lists = candidates.join(texts, "chunk_id").groupBy("question_id").agg(F.array_sort(F.collect_list(one)).alias("found"))
        asked = lists.join(questions.select("question_id", "question"), "question_id")
        request = F.struct(F.col("question").alias("query"), F.transform("found", lambda c: c["text"]).alias("documents"))
        answered = with_answers(asked.select("question_id", "found", "question"), request, remote, "scores", SCORES)
        placed = answered.select("question_id", "found", F.explode("scores").alias("s")).where((F.col("s.index") >= 0) & (F.col("s.index") < F.size("found")))
        return placed.select("question_id", F.get("found", F.col("s.index"))["chunk_id"].alias("chunk_id"), F.col("s.score").alias("score"))

    return rerank
