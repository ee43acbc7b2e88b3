"""Chat history tables: listing, search, history windows, turns, titles and summaries.

``chats``: ``user_id, chat_id, title, summary, created_at, updated_at``.
``messages``: ``chat_id, seq, role, content, citations, web_citations`` – order is ``seq``, never a timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.jsonrec import recover_json
from loreweave.functions.text import clamp, clip, contains_ci, placeholder_title, snippet, strip
from loreweave.operators.ranking import join_text, neighbour, top_k

# History and transcript windows, title and summary limits, search defaults.
HISTORY_MESSAGES, HISTORY_MESSAGE_CHARS, HISTORY_CHARS = 10, 2000, 8000
TRANSCRIPT_MESSAGES, TRANSCRIPT_MESSAGE_CHARS, TRANSCRIPT_CHARS = 12, 500, 6000
TITLE_CHARS, SUMMARY_CHARS, SEARCH_LIMIT, SEARCH_WIDTH = 60, 400, 20, 160
SEQ_BLOCK = 4096


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(F.count(F.lit(1)).alias("message_count"))


def list_chats(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Chats with message counts; message bodies are never read. Order by ``updated_at`` when shown."""
    return chats.join(message_counts(messages), "chat_id", "left").na.fill(0, ["message_count"])


def search_chats(requests: DataFrame, chats: DataFrame, messages: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Chats matching ``requests`` (``query_id, user_id, q``), newest update first.

    The match source is the title, else the summary, else the first matching message.
    """
    mine = requests.join(chats, "user_id")
    in_title = contains_ci(F.col("title"), F.col("q"))
    in_summary = F.coalesce(contains_ci(F.col("summary"), F.col("q")), F.lit(False))
    meta = mine.filter(in_title | in_summary).select(
        "query_id", "chat_id", F.when(in_title, F.col("title")).otherwise(F.coalesce("summary", F.lit(""))).alias("meta_text"),
        F.when(in_title, "title").otherwise("summary").alias("meta_source"),
    )
    asked = mine.select("query_id", "chat_id", "q")
    first = (
        messages.select("chat_id", "seq", "content").join(asked, "chat_id").filter(contains_ci(F.col("content"), F.col("q")))
        .groupBy("query_id", "chat_id").agg(F.min_by("content", "seq").alias("body"))
    )
    found = meta.join(first, ["query_id", "chat_id"], "full")
    found = found.select(
        "query_id", "chat_id", F.coalesce("meta_source", F.lit("message")).alias("match_source"),
        F.coalesce("meta_text", "body").alias("_text"),
    )
    rows = found.join(mine, ["query_id", "chat_id"])
    best = top_k(rows, ["query_id"], [F.desc("updated_at"), F.asc("chat_id")], limit, salt_on=["chat_id"])
    counted = best.join(message_counts(messages), "chat_id", "left").na.fill(0, ["message_count"])
    return counted.select(
        "query_id", "rank", "user_id", "chat_id", "title", "message_count", "updated_at", "match_source",
        snippet(F.col("_text"), F.col("q"), SEARCH_WIDTH).alias("snippet"),
    )


def transcript(messages: DataFrame) -> DataFrame:
    """Messages with empty lists for missing citations; sort by (chat_id, seq) when shown."""
    out = messages
    for name in ("citations", "web_citations"):
        kind = messages.schema[name].dataType
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def _fits(df: DataFrame, size, budget: int) -> DataFrame:
    """Keep the newest rows whose running size, counted from the newest, stays within ``budget``."""
    newest_first = Window.partitionBy("chat_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_sum", F.sum(size).over(newest_first)).filter(F.col("_sum") <= budget).drop("_sum")


def load_history(messages: DataFrame, limit: int = HISTORY_MESSAGES, budget: int = HISTORY_CHARS) -> DataFrame:
    """Recent messages of every chat within a message and a character budget."""
    last = top_k(messages.select("chat_id", "seq", "role", "content"), ["chat_id"], [F.desc("seq")], limit, salt_on=["seq"], salts=16)
    cut = last.withColumn("content", clip(F.col("content"), HISTORY_MESSAGE_CHARS))
    return _fits(cut, F.length("content"), budget).drop("rank")


def history_column(history: DataFrame) -> DataFrame:
    """``chat_id, history array<struct<role, content>>`` in seq order (bounded by :func:`load_history`)."""
    items = F.array_sort(F.collect_list(F.struct("seq", "role", "content")))
    return history.groupBy("chat_id").agg(
        F.transform(items, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history")
    )


def next_seq(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Sequence number of the next message: largest plus one (gaps survive), zero for an empty chat."""
    top = messages.groupBy("chat_id").agg((F.max("seq") + 1).alias("next_seq"))
    return chats.select("chat_id").join(top, "chat_id", "left").na.fill(0, ["next_seq"])


def append_turn(chats: DataFrame, messages: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add a question and an answer row per turn (``chat_id, question, answer, next_seq, at``)."""
    rows = turns.select(
        "chat_id", F.inline(F.array(
            F.struct(F.col("next_seq").cast("long").alias("seq"), F.lit("user").alias("role"), F.col("question").alias("content")),
            F.struct((F.col("next_seq") + 1).cast("long").alias("seq"), F.lit("assistant").alias("role"), F.col("answer").alias("content")),
        )),
    )
    touched = turns.groupBy("chat_id").agg(F.max("at").alias("_at"))
    parents = chats.join(touched, "chat_id", "left").withColumn("updated_at", F.greatest("updated_at", "_at")).drop("_at")
    return parents, messages.unionByName(rows, allowMissingColumns=True)


def create_chats(first_queries: DataFrame) -> DataFrame:
    """New chats (``user_id, chat_id, query, at``) with a placeholder title."""
    return first_queries.select(
        "user_id", "chat_id", placeholder_title(F.col("query")).alias("title"), F.lit(None).cast("string").alias("summary"),
        F.col("at").alias("created_at"), F.col("at").alias("updated_at"),
    )


def rename_chats(chats: DataFrame, renames: DataFrame) -> DataFrame:
    """Owner-checked rename (``user_id, chat_id, new_title``)."""
    new = renames.select("user_id", "chat_id", strip(F.col("new_title")).alias("_t"))
    return chats.join(new, ["user_id", "chat_id"], "left").withColumn("title", F.coalesce("_t", "title")).drop("_t")


def delete_chats(chats: DataFrame, messages: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owner-checked delete (``user_id, chat_id``); messages go with their chat."""
    gone = chats.join(deleted.select("user_id", "chat_id").distinct(), ["user_id", "chat_id"], "left_semi").select("chat_id")
    return chats.join(gone, "chat_id", "left_anti"), messages.join(gone, "chat_id", "left_anti")


def summary_transcript(messages: DataFrame) -> DataFrame:
    """Transcript text of the last twelve messages within the character budget (``chat_id, transcript``)."""
    last = top_k(messages.select("chat_id", "seq", "role", "content"), ["chat_id"], [F.desc("seq")], TRANSCRIPT_MESSAGES, salt_on=["seq"], salts=16)
    lines = last.withColumn("role", strip(F.coalesce("role", F.lit("")))).withColumn(
        "content", clamp(F.coalesce("content", F.lit("")), TRANSCRIPT_MESSAGE_CHARS)
    )
    lines = lines.filter((F.col("role") != "") & (F.col("content") != "")).withColumn("line", F.concat_ws(": ", "role", "content"))
    kept = _fits(lines, F.length("line") + 1, TRANSCRIPT_CHARS)
    return kept.groupBy("chat_id").agg(join_text(F.col("line"), [F.col("seq")], "\n").alias("transcript"))


def parse_chat_summary(replies: DataFrame) -> DataFrame:
    """``chat_id, raw`` → ``chat_id, new_title, new_summary`` (blank when unusable)."""

    def text(name: str):
        return F.coalesce(F.try_variant_get("_o", f"$.{name}", "string"), F.lit(""))

    return recover_json(replies, "raw", "_o").select("chat_id", clamp(text("title"), TITLE_CHARS).alias("new_title"), clamp(text("summary"), SUMMARY_CHARS).alias("new_summary"))


def refresh_summaries(chats: DataFrame, parsed: DataFrame) -> DataFrame:
    """Write non-empty summaries; titles only where ``generate_title`` (the first turn)."""
    new = parsed.select("chat_id", "new_title", "new_summary", "generate_title")
    joined = chats.join(new, "chat_id", "left")
    title = F.when(F.col("generate_title"), F.nullif(F.col("new_title"), F.lit("")))
    return (
        joined.withColumn("summary", F.coalesce(F.nullif(F.col("new_summary"), F.lit("")), F.col("summary")))
        .withColumn("title", F.coalesce(title, F.col("title")))
        .drop("new_title", "new_summary", "generate_title")
    )


def pair_turns(messages: DataFrame, block: int = SEQ_BLOCK) -> DataFrame:
    """(question, response) per user message directly followed by an assistant message.

    A response row is never a user row, so pairs cannot overlap and looking one row ahead is exact.
    """
    rows = messages.select("chat_id", "seq", "role", "content")
    ahead = neighbour(rows, ["chat_id"], "seq", {"next_role": "role", "next_content": "content"}, block=block)
    return ahead.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        "chat_id", "seq", F.col("content").alias("question"), F.col("next_content").alias("response")
    )
