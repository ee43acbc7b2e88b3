"""Section-aware chunking: heading scan in the JVM, window split in Arrow batches, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loreweave.functions.text import WHITESPACE, alnum_count, is_heading, split_lines, strip
from loreweave.operators.ranking import join_text

# Default window, overlap, smallest body budget, noise limit, break priorities.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
MIN_BODY_BUDGET = 100
MIN_ALNUM = 80
BREAKS = ("\n\n", "\n", ". ", " ")


def window_spans(body: str, size: int, overlap: int, skip_repeats: bool = False) -> Iterator[tuple[int, int, int]]:
    """Spans ``(ordinal, start, end)`` of the overlapping windows of one section body.

    When a break falls inside the overlap tail, the next window starts one character later and ends at
    the same break, again and again. ``skip_repeats`` jumps over such a run in one step: it computes the
    first start at which the end can move (the break itself, a break of the same or a higher priority
    coming into reach, or the end of the body) and only advances the ordinal.
    """
    n = len(body)
    coming: dict[int, int] = {}
    start = ordinal = 0
    previous = -1
    while start < n:
        limit = min(start + size, n)
        end, level, at = limit, -1, -1
        if limit < n:
            for level, mark in enumerate(BREAKS):
                at = body.rfind(mark, start, limit)
                if at > start:
                    end = at + len(mark)
                    break
            else:
                level = -1
        if not (skip_repeats and end == previous):
            yield ordinal, start, end
        previous = end
        ordinal += 1
        if end >= n:
            return
        following = max(start + 1, end - overlap)
        if skip_repeats and level >= 0 and following == start + 1:
            change = min(at, n - size)
            for rank in range(level + 1):
                mark = BREAKS[rank]
                after = at + 1 if rank == level else start + 1
                seen = coming.get(rank, -2)
                if seen != -1 and seen < after:
                    seen = coming[rank] = body.find(mark, after)
                if seen >= 0:
                    change = min(change, seen + len(mark) - size)
            if change > following:
                ordinal += change - following
                following = change
        start = following


def _split_documents(size: int, overlap: int, drop_noise: bool, stutter: bool, keys: list[str], schema: pa.Schema):
    """Arrow function: documents (lines + heading flags) in, chunk rows out."""
    flush_at = 20_000

    def chunks_of(lines: list[str], heads: list[bool]) -> Iterator[tuple[int, str, int, int]]:
        index = offset = 0
        heading, begin, body = "", 0, []

        def close() -> Iterator[tuple[int, str, int, int]]:
            nonlocal index
            content = "".join(body).strip("\n")
            if not content or not (heading or content.strip()):
                return
            prefix = f"{heading}\n" if heading else ""
            budget = max(size - len(prefix), MIN_BODY_BUDGET)
            base = begin + len(prefix)
            # A repeat has at most ``overlap`` characters: skipping it ahead of the noise rule is exact
            # unless the heading brings heading + piece up to the limit.
            hopeless = drop_noise and overlap + sum(map(str.isalnum, prefix)) < MIN_ALNUM
            last = 0
            for ordinal, a, b in window_spans(content, budget, overlap, hopeless or not stutter):
                yield index + ordinal, prefix + content[a:b], base + a, base + b
                last = ordinal
            index += last + 1

        for line, head in zip(lines, heads):
            if head:
                yield from close()
                heading, begin, body = line.strip(), offset, []
            else:
                body.append(line)
            offset += len(line)
        yield from close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, heads = batch.column("_lines"), batch.column("_heads")
            rows: list[int] = []
            out: list[tuple[int, str, int, int]] = []
            raw: list[int] = []

            def emit() -> pa.RecordBatch:
                picked = pa.array(rows, pa.int64())
                idx, txt, a, b = zip(*out)
                columns = [batch.column(k).take(picked) for k in keys]
                columns += [
                    pa.array(idx, pa.int32()),
                    pa.array(txt, pa.string()),
                    pa.array(a, pa.int64()),
                    pa.array(b, pa.int64()),
                    pa.array(raw, pa.int32()),
                ]
                return pa.RecordBatch.from_arrays(columns, schema=schema)

            for i in range(batch.num_rows):
                mine = list(chunks_of(lines[i].as_py() or [], heads[i].as_py() or []))
                rows += [i] * len(mine)
                out += mine
                raw += [mine[-1][0] + 1] * len(mine) if mine else []
                if len(out) >= flush_at:
                    yield emit()
                    rows, out, raw = [], [], []
            if out:
                yield emit()

    return run


def chunk(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    *,
    text_col: str = "extracted_text",
    keys: tuple[str, ...] = ("user_id", "document_id"),
    drop_noise: bool = False,
    stutter: bool = True,
) -> DataFrame:
    """All chunks of every document: ``keys, chunk_index, text, char_start, char_end, raw_chunks``.

    ``drop_noise`` also applies the meaningful-chunk rule of :func:`keep_meaningful` and lets the
    splitter skip pieces that can never pass it. ``stutter=False`` is the cleaner variant without the
    repeated short pieces; chunk numbers are the same either way.
    """
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap >= size:
        raise ValueError("chunk overlap must be smaller than the chunk size")
    keys = list(keys)
    lines = docs.filter(F.length(text_col) > 0).select(*keys, split_lines(F.col(text_col)).alias("_lines"))
    flagged = lines.withColumn("_heads", F.transform("_lines", is_heading))
    fields = [flagged.schema[k] for k in keys] + [
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("char_start", T.LongType()),
        T.StructField("char_end", T.LongType()),
        T.StructField("raw_chunks", T.IntegerType()),
    ]
    schema = T.StructType(fields)
    run = _split_documents(size, overlap, drop_noise, stutter, keys, to_arrow_schema(schema))
    out = flagged.mapInArrow(run, schema)
    return keep_meaningful(out) if drop_noise else out


def keep_meaningful(chunks: DataFrame, doc_keys: tuple[str, ...] = ("user_id", "document_id")) -> DataFrame:
    """Drop chunks with fewer than 80 letters and digits, unless the document made only one chunk.

    Uses the ``raw_chunks`` column when present, otherwise counts chunks per document.
    """
    if "raw_chunks" not in chunks.columns:
        counts = chunks.groupBy(*doc_keys).agg(F.count(F.lit(1)).alias("raw_chunks"))
        chunks = chunks.join(counts, list(doc_keys))
    return chunks.filter((F.col("raw_chunks") <= 1) | (alnum_count(F.col("text")) >= MIN_ALNUM))


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    """Deterministic chunk id ``<document>-<index>``, so a replay overwrites the same rows."""
    return chunks.withColumn("chunk_id", F.concat_ws("-", F.col("document_id"), F.col("chunk_index")))


def parse_sections(
    docs: DataFrame, *, text_col: str = "extracted_text", keys: tuple[str, ...] = ("user_id", "document_id")
) -> DataFrame:
    """One row per section: ``keys, section, heading, content, source_start, source_end``.

    Relational form of the section scan. Lines of one document are numbered by windows over that
    document, whose text was a single row to begin with; the chunker itself needs no shuffle.
    """
    keys = list(keys)
    per_doc = Window.partitionBy(*keys).orderBy("_pos")
    so_far = per_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = (
        docs.select(*keys, F.posexplode(split_lines(F.col(text_col))).alias("_pos", "_line"))
        .withColumn("_head", is_heading(F.col("_line")))
        .withColumn("_end", F.sum(F.length("_line")).over(so_far))
        .withColumn("section", F.sum(F.col("_head").cast("int")).over(so_far))
    )
    body = F.when(~F.col("_head"), F.col("_line"))
    grouped = lines.groupBy(*keys, "section").agg(
        F.max(F.when(F.col("_head"), strip(F.col("_line")))).alias("heading"),
        F.btrim(join_text(body, [F.col("_pos")], ""), F.lit("\n")).alias("content"),
        F.min(F.col("_end") - F.length("_line")).alias("source_start"),
        F.max("_end").alias("source_end"),
    )
    heading = F.coalesce("heading", F.lit(""))
    kept = grouped.withColumn("heading", heading).filter(
        (F.col("heading") != "") | (F.btrim("content", F.lit(WHITESPACE)) != "")
    )
    return kept.select(*keys, "section", "heading", "content", "source_start", "source_end")


def rebuild_text(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Document text from its stored chunks in index order, else the extracted text; blanks are dropped."""
    joined = chunks.groupBy("user_id", "document_id").agg(
        join_text(F.col("text"), [F.col("chunk_index")], "\n\n").alias("_joined")
    )
    text = F.coalesce(F.col("_joined"), F.col("extracted_text"), F.lit(""))
    return (
        docs.join(joined, ["user_id", "document_id"], "left")
        .select("user_id", "document_id", text.alias("text"))
        .filter(strip(F.col("text")) != "")
    )
