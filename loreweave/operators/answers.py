"""Prompt assembly, claim parsing, groundedness, summaries — set-wise over tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.jsonrec import list_field, text_field
from loreweave.functions.text import clip, clip_trimmed, let, strip
from loreweave.operators.ranking import join_text, top_k

# Intents, labels, thresholds and character budgets.
INTENTS = ("chat", "summarize", "explain_graph")
SUPPORT = ("supported", "unsupported", "uncertain")
VERIFIED_AT, PARTIAL_AT, STRICT_AT = 0.85, 0.5, 0.80
ANSWER_CHARS, CONTEXT_CHARS, SIDE_CHARS, FACT_RELATIONS = 4000, 8000, 4000, 6
# Every fact takes its line end at least, so those after that many lie beyond the budget; one more shows that it is exceeded.
FACTS_TOLD = SIDE_CHARS + 2
WEB_CONTENT_CHARS, SUMMARY_POINTS = 1000, 5
SUMMARY_INPUT_CHARS, TLDR_CHARS, LIST_ITEMS, POINT_CHARS, TOPIC_CHARS = 14_000, 600, 8, 280, 80
REFUSAL = (
    "I can't answer this confidently from your documents — strict mode requires high-confidence grounding. "
    "Switch to regular mode in Settings or rephrase your question."
)


def route(use_rag: Column, intent: Column) -> Column:
    """Branch a question takes after intent classification."""
    return (
        F.when(~F.coalesce(use_rag, F.lit(True)), "skip_retrieval")
        .when(intent == "summarize", "fetch_summaries")
        .when(intent == "explain_graph", "retrieve_for_graph")
        .otherwise("retrieve_for_chat")
    )


def parse_intent(obj: Column) -> Column:
    """Intent of a recovered reply object (see :func:`jsonrec.recover_json`), ``chat`` when unusable."""
    said = text_field(obj, "intent")
    return F.when(said.isin(*INTENTS), said).otherwise("chat")


def prompt_id(use_rag: Column, mode: Column, has_documents: Column, has_web: Column) -> Column:
    """Which system prompt applies."""
    strict = mode == "strict"
    return (
        F.when(use_rag & has_documents, F.when(strict, "strict").otherwise("regular"))
        .when(has_web, "web_only")
        .when(use_rag & strict, "no_context")
        .otherwise("pure_knowledge")
    )


def strict_gate(verified: DataFrame) -> DataFrame:
    """Replace low-grounded answers in strict mode; a skipped verification or an equal score passes."""
    refuse = (
        F.col("use_rag") & (F.col("rag_mode") == "strict") & (F.col("verdict") != "skipped")
        & (F.col("groundedness_score") < STRICT_AT)
    )
    return verified.withColumn("refused", F.coalesce(refuse, F.lit(False))).withColumn(
        "answer", F.when(F.col("refused"), REFUSAL).otherwise(F.col("answer"))
    )


def context_block(chunks: DataFrame) -> DataFrame:
    """Numbered passages per question (``query_id, context``)."""
    head = F.format_string("[%d] (doc=%s, chunk=%d, score=%.3f)\n", F.col("rank"), F.col("document_id").cast("string"), F.col("chunk_index"), F.bround("score", 3))
    return chunks.groupBy("query_id").agg(
        join_text(F.concat(head, strip(F.col("text"))), [F.col("rank")], "\n\n").alias("context")
    )


def _fact_head() -> Column:
    about = F.coalesce(F.col("description"), F.lit(""))
    return F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(")"), F.when(about != "", F.concat(F.lit(": "), strip(about))).otherwise(""))


def graph_block(facts: DataFrame) -> DataFrame:
    """Entity headers with arrow lines per question (``query_id, graph``)."""

    def line(r: Column) -> Column:
        arrow = F.when(r["direction"] == "out", "→").otherwise("←")
        far = F.concat(F.lit("    ↝ "), F.array_join(r["relation_chain"], " → "), F.lit(" "), r["other"], F.lit("   ("), r["distance"].cast("string"), F.lit("-hop)"))
        return F.when(r["distance"] > 1, far).otherwise(F.concat(F.lit("    "), arrow, F.lit(" "), r["relation"], F.lit(" "), r["other"]))

    text = F.array_join(F.concat(F.array(_fact_head()), F.transform("relations", line)), "\n")
    return facts.groupBy("query_id").agg(join_text(text, [F.col("rank")], "\n").alias("graph"))


def web_block(results: DataFrame) -> DataFrame:
    item = F.concat(F.lit("[W"), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("url"), F.lit("\n"), clip(F.col("content"), WEB_CONTENT_CHARS))
    return results.groupBy("query_id").agg(join_text(item, [F.col("rank")], "\n\n").alias("web"))


def summaries_block(summaries: DataFrame) -> DataFrame:
    """Document names with TLDR and up to five points per question (``query_id, summaries``)."""
    blank = F.lit("")
    name = F.coalesce(F.nullif(F.col("filename"), blank), F.nullif(F.col("document_id").cast("string"), blank), F.lit("document"))
    tldr = strip(F.coalesce(F.col("tldr"), blank))
    points = F.transform(F.slice(F.coalesce("key_points", F.array().cast("array<string>")), 1, SUMMARY_POINTS), lambda p: F.concat(F.lit("    • "), p))
    lines = F.concat(
        F.array(F.concat(F.lit("- "), name)),
        F.filter(F.array(F.concat(F.lit("    "), tldr)), lambda x: tldr != ""),
        points,
    )
    return summaries.groupBy("query_id").agg(join_text(F.array_join(lines, "\n"), [F.col("rank")], "\n").alias("summaries"))


def user_message(queries: DataFrame, context=None, graph=None, summaries=None, web=None) -> DataFrame:
    """Final user message: the non-empty blocks in fixed order, then the question."""
    parts = [
        (context, "context", "Context passages:\n\n"), (graph, "graph", "Knowledge-graph facts:\n"),
        (summaries, "summaries", "Document summaries:\n"), (web, "web", "Web results:\n\n"),
    ]
    out, sections = queries, []
    for block, column, title in parts:
        if block is not None:
            out = out.join(block.select("query_id", column), "query_id", "left")
            sections.append(F.concat(F.lit(title), F.col(column)))
    if not sections:
        return queries.select("query_id", F.col("query").alias("message"))
    body = F.concat_ws("\n\n", *sections)
    full = F.concat(body, F.lit("\n\nQuestion: "), F.col("query"))
    return out.select("query_id", F.when(body == "", F.col("query")).otherwise(full).alias("message"))


def message_list(system: Column, history: Column, message: Column) -> Column:
    """System message, history, user message as ``array<struct<role, content>>``."""
    entry = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    past = F.coalesce(history, F.array().cast("array<struct<role string, content string>>"))
    return F.concat(F.array(entry("system", system)), past, F.array(entry("user", message)))


def parse_claims(obj: Column) -> Column:
    """Labelled claims of a recovered verifier reply: ``array<struct<pos, text, support, evidence>>``."""
    items = list_field(obj, "claims")

    def field(item: Column, name: str) -> Column:
        # Falsy values (null, "", 0, false) read as blank; other scalars as their text.
        v = F.try_variant_get(item, f"$.{name}", "string")
        return strip(F.when(v.isin("false", "0", "0.0"), "").otherwise(F.coalesce(v, F.lit(""))))

    def build(item: Column, pos: Column) -> Column:
        cited = F.concat_ws(" ", F.nullif(field(item, "quote"), F.lit("")), F.nullif(field(item, "citation"), F.lit("")))
        claim = F.struct(
            pos.cast("int").alias("pos"), field(item, "text").alias("text"), F.lower(field(item, "support")).alias("support"),
            F.when(cited != "", cited).otherwise(field(item, "evidence")).alias("evidence"),
        )
        return F.when(F.startswith(F.schema_of_variant(item), F.lit("OBJECT")), claim)

    made = F.filter(F.transform(items, build), lambda c: (c["text"] != "") & c["support"].isin(*SUPPORT))
    return F.coalesce(made, F.array().cast("array<struct<pos int, text string, support string, evidence string>>"))


def groundedness(answers: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """Mean support per answer (no claims: 1.0), counts, and the unsupported texts in order.

    ``claims``: ``keys, pos, text, support``.
    """
    worth = F.when(F.col("support") == "supported", 1.0).when(F.col("support") == "uncertain", 0.5).otherwise(0.0)
    scored = claims.groupBy(*keys).agg(
        F.avg(worth).alias("score"), F.count(F.lit(1)).alias("total_claims"), F.sum((F.col("support") == "supported").cast("long")).alias("supported_claims"),
        F.array_sort(F.collect_list(F.when(F.col("support") == "unsupported", F.struct("pos", "text")))).alias("_u"),
    )
    return answers.join(scored, keys, "left").withColumn("unsupported_claims", F.coalesce(F.transform("_u", lambda x: x["text"]), F.array().cast("array<string>"))).drop("_u").withColumn(
        "score", F.coalesce("score", F.lit(1.0))
    ).na.fill(0, ["total_claims", "supported_claims"])


def verdict(score: Column, has_claims: Column) -> Column:
    return F.when(~has_claims | (score >= VERIFIED_AT), "verified").when(score >= PARTIAL_AT, "partial").otherwise("unsupported")


def verify(scored: DataFrame, enabled: bool = True) -> DataFrame:
    """Verdict with skip reasons in order: disabled, empty answer, no context, upstream error.

    Needs ``answer, has_context, error, score, total_claims, supported_claims, unsupported_claims``.
    """
    reason = (
        F.when(F.lit(not enabled), "verification disabled")
        .when(strip(F.coalesce("answer", F.lit(""))) == "", "empty answer")
        .when(~F.col("has_context"), "no context to verify against")
        .when(F.col("error").isNotNull(), F.col("error"))
        .otherwise("")
    )
    skipped = F.col("skip_reason") != ""
    return scored.withColumn("skip_reason", reason).select(
        *[c for c in scored.columns if c not in ("score", "total_claims", "supported_claims", "unsupported_claims")],
        "skip_reason",
        F.when(skipped, "skipped").otherwise(verdict(F.col("score"), F.col("total_claims") > 0)).alias("verdict"),
        F.when(skipped, 0.0).otherwise(F.bround("score", 3)).alias("groundedness_score"),
        F.when(skipped, 0).otherwise(F.col("total_claims")).cast("long").alias("total_claims"),
        F.when(skipped, 0).otherwise(F.col("supported_claims")).cast("long").alias("supported_claims"),
        F.when(skipped, F.array().cast("array<string>")).otherwise(F.col("unsupported_claims")).alias("unsupported_claims"),
    )


def verifier_context(answers: DataFrame, chunks: DataFrame, facts: DataFrame, web: DataFrame) -> DataFrame:
    """Verifier prompt per answer (``query_id, answer``) with a character budget for each part."""
    number = lambda tag: F.concat(F.lit(f"[{tag}"), F.col("rank").cast("string"), F.lit("] "))
    passages = chunks.groupBy("query_id").agg(join_text(F.concat(number(""), strip(F.col("text"))), [F.col("rank")], "\n\n").alias("_c"))
    lines = F.transform(
        F.slice("relations", 1, FACT_RELATIONS),
        lambda r: F.concat(F.lit("    → "), F.array_join(r["relation_chain"], " → "), F.lit(" "), r["other"]),
    )
    fact = F.array_join(F.concat(F.array(_fact_head()), lines), "\n")
    told = top_k(facts.select("query_id", "rank", fact.alias("_t")).filter(F.col("_t").isNotNull()), ["query_id"], [F.asc("rank")], FACTS_TOLD, rank="_r")
    known = told.groupBy("query_id").agg(join_text(F.col("_t"), [F.col("rank")], "\n").alias("_f"))
    item = F.concat(number("W"), F.col("title"), F.lit(" — "), F.col("url"), F.lit(": "), strip(F.col("content")))
    pages = web.groupBy("query_id").agg(join_text(item, [F.col("rank")], "\n\n").alias("_w"))
    part = lambda c, n, none: F.coalesce(clip(F.col(c), n), F.lit(none))
    return (
        answers.join(passages, "query_id", "left").join(known, "query_id", "left").join(pages, "query_id", "left")
        .select(
            "query_id",
            F.concat(
                F.lit("Answer to verify:\n"), clip(F.col("answer"), ANSWER_CHARS),
                F.lit("\n\nContext passages:\n"), part("_c", CONTEXT_CHARS, "(no passages retrieved)"),
                F.lit("\n\nKnowledge-graph facts:\n"), part("_f", SIDE_CHARS, "(no graph facts)"),
                F.lit("\n\nWeb results:\n"), part("_w", SIDE_CHARS, "(no web results)"),
            ).alias("message"),
        )
    )


def _short_list(obj: Column, name: str, chars: int) -> Column:
    """Trimmed non-blank strings of a list field: cap the count first, then drop case-insensitive repeats."""
    items = list_field(obj, name)
    texts = F.transform(
        F.filter(items, lambda i: F.schema_of_variant(i) == "STRING"),
        lambda i: strip(F.try_variant_get(i, "$", "string")),
    )
    capped = F.slice(F.transform(F.filter(texts, lambda t: t != ""), lambda t: clip_trimmed(t, chars)), 1, LIST_ITEMS)

    def first_only(v: Column) -> Column:
        low = F.transform(v, F.lower)
        return F.filter(v, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)

    return F.coalesce(let(capped, first_only), F.array().cast("array<string>"))


def parse_summary(obj: Column) -> Column:
    """``struct<tldr, key_points, topics>`` of a recovered summary reply; unusable parts are empty."""
    tldr = clip_trimmed(strip(F.coalesce(text_field(obj, "tldr"), F.lit(""))), TLDR_CHARS)
    return F.struct(
        tldr.alias("tldr"), _short_list(obj, "key_points", POINT_CHARS).alias("key_points"),
        _short_list(obj, "topics", TOPIC_CHARS).alias("topics"),
    )


def summary_input(text: Column) -> Column:
    return F.substring(text, 1, SUMMARY_INPUT_CHARS)


def store_summaries(documents: DataFrame, parsed: DataFrame) -> DataFrame:
    """Write parsed summaries (``user_id, document_id, summary``); an empty one leaves the old values."""
    s = "summary"
    empty = (F.col(f"{s}.tldr") == "") & (F.size(f"{s}.key_points") == 0) & (F.size(f"{s}.topics") == 0)
    fresh = parsed.filter(F.col(s).isNotNull() & ~empty).select("user_id", "document_id", s)
    joined = documents.join(fresh, ["user_id", "document_id"], "left")
    has = F.col(s).isNotNull()

    def pick(column: str, new: Column) -> Column:
        return F.when(has, new).otherwise(F.col(column))

    lists = lambda f: F.when(F.size(f"{s}.{f}") > 0, F.col(f"{s}.{f}"))
    return (
        joined.withColumn("summary_tldr", pick("summary_tldr", F.nullif(F.col(f"{s}.tldr"), F.lit(""))))
        .withColumn("summary_key_points", pick("summary_key_points", lists("key_points")))
        .withColumn("summary_topics", pick("summary_topics", lists("topics")))
        .drop(s)
    )
