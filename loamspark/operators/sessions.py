"""Conversations as a table of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamspark.functions.text import NEW_SESSION, session_title, strip


def recent_turns(turns: DataFrame, n: int, roles: tuple[str, ...] = ("user", "assistant"), key: str = "session_id", text: str = "content") -> DataFrame:
    """(key, recent): the last n texts of the roles, oldest first; what is further back is cut before it is gathered."""
    order = W.partitionBy(key).orderBy(F.desc("turn"))
    last = turns.where(F.col("role").isin(*roles)).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n)
    row = F.struct("turn", "role", F.col(text).alias("text"))
    gathered = last.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return gathered.select(key, F.transform("rows", lambda r: r["text"]).alias("recent"))


def messages(turns: DataFrame, n: int = 6, key: str = "session_id", text: str = "content") -> DataFrame:
    """(key, messages): the last n turns of users and assistants as (role, content)."""
    order = W.partitionBy(key).orderBy(F.desc("turn"))
    last = turns.where(F.col("role").isin("user", "assistant")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n)
    gathered = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col(text).alias("content")))).alias("rows"))
    return gathered.select(key, F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("messages"))


def history_query(turns: DataFrame, questions: DataFrame, window: int = 4, key: str = "session_id", text: str = "content") -> DataFrame:
    """questions (key, question) with query: the last user turns and the question, blanks dropped, a line each."""
    recent = recent_turns(turns, window, ("user",), key, text)
    parts = F.concat(F.coalesce("recent", F.array().cast("array<string>")), F.array("question"))
    query = F.array_join(F.filter(parts, lambda p: strip(p) != ""), "\n")
    return questions.join(recent, key, "left").select(*questions.columns, query.alias("query"))


def sessions(turns: DataFrame, key: str = "session_id", text: str = "content") -> DataFrame:
    """One row a session: title from its first user turn, number of messages, start of the last one."""
    asked = F.when(F.col("role") == "user", F.struct("turn", F.col(text).alias("t")))
    per = turns.groupBy(key).agg(F.min(asked).alias("first"), F.count("*").alias("turn_count"), F.max_by(F.substring(text, 1, 120), "turn").alias("last_message"))
    title = F.when(F.col("first").isNull(), F.lit(NEW_SESSION)).otherwise(session_title(F.col("first.t")))
    return per.select(key, title.alias("title"), "turn_count", "last_message")


def listed(turns: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions with their times, the latest first."""
    times = turns.groupBy(key).agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return sessions(turns, key).join(times, key).orderBy(F.desc("updated_at"), key)


def appended(turns: DataFrame, exchanges: DataFrame) -> DataFrame:
    """turns with a user and an assistant turn for each exchange (session_id, question, answer, created_at)."""
    last = turns.groupBy("session_id").agg(F.max("turn").alias("last"))
    pair = F.array(F.struct(F.lit(1).alias("step"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(2).alias("step"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    new = exchanges.join(last, "session_id", "left").select("session_id", F.coalesce("last", F.lit(-1)).alias("last"), "created_at", F.explode(pair).alias("x"))
    return turns.unionByName(new.select("session_id", (F.col("last") + F.col("x.step")).cast("int").alias("turn"), "x.role", "x.content", "created_at"))


def seeded(turns: DataFrame, history: DataFrame) -> DataFrame:
    """turns with the given history of sessions that have none yet."""
    return turns.unionByName(history.join(turns.select("session_id").distinct(), "session_id", "left_anti").select(turns.columns))


def deleted(turns: DataFrame, session_id: str) -> DataFrame:
    return turns.where(~F.col("session_id").eqNullSafe(F.lit(session_id)))


