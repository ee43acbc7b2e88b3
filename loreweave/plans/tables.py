"""Engine tables derived from the given star-schema, event and text tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.text import placeholder_title
from loreweave.operators.index import build_index
from loreweave.operators.inverted import Inverted, build_inverted
from loreweave.session import cut_lineage

PASSAGE = 400
BARE = 1_000_000  # added to the id of a row that stands for an edge case
SPREAD_BY = {"documents": "doc_id", "lineitem": "l_orderkey", "pages": "page_id"}


class Tables:
    """Lazy views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def raw(self, name: str) -> DataFrame:
        """A given table. One small file is one task; tables that feed heavy work are spread over the cores
        when the scan has fewer splits than cores, and left alone otherwise."""
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        key = SPREAD_BY.get(name)
        cores = self.spark.sparkContext.defaultParallelism
        if key is None or df.rdd.getNumPartitions() >= cores:
            return df
        return df.repartition(cores, key)

    @cached_property
    def docs(self) -> DataFrame:
        """Documents with owner (language), status, type, summary columns made from the id."""
        d, n = self.raw("documents"), F.col("doc_id")
        status = F.when(n % 10 == 0, "uploaded").when(n % 10 == 1, "processing").when(n % 10 == 2, "failed").otherwise("processed")
        mime = F.when(n % 6 == 0, "text/markdown").when(n % 6 == 1, "TEXT/Plain; charset=utf-8").when(n % 6 == 2, "application/zip").when(
            n % 6 == 3, "application/pdf").when(n % 6 == 4, " image/PNG ").otherwise("text/plain")
        tldr = F.when(n % 3 == 0, F.substring("text", 1, 60))
        points = F.split(F.substring("text", 1, 90), " ")
        return d.select(
            F.col("lang").alias("user_id"), n.cast("string").alias("document_id"), n.alias("doc_id"),
            F.concat(F.lit("My Files/"), F.col("source"), F.lit("..doc #"), n.cast("string"), F.lit("!.txt")).alias("raw_filename"),
            F.concat(F.lit("doc_"), n.cast("string"), F.lit(".txt")).alias("filename"), mime.alias("content_type"),
            F.when(n % 11 == 0, 0).otherwise(F.col("n_chars") * F.when(n % 13 == 0, 100_000).otherwise(1)).cast("long").alias("size_bytes"),
            F.col("text").alias("extracted_text"), status.alias("status"),
            F.when((n % 10 == 2) & (n % 4 == 2), "engine failed").alias("error_message"),
            F.timestamp_seconds(F.lit(1704067200) + n * 60).alias("created_at"),
            tldr.alias("summary_tldr"), F.when(n % 3 == 0, points).alias("summary_key_points"),
            F.when(n % 3 == 0, F.array("lang", "source")).alias("summary_topics"),
        )

    @cached_property
    def parts(self) -> DataFrame:
        """Lines of documents as pages, slides with notes, paragraphs and table rows, and media parts."""
        line = self.raw("documents").select(
            F.col("lang").alias("user_id"), F.col("doc_id"), F.col("doc_id").cast("string").alias("document_id"),
            F.posexplode(F.split("text", "\n")).alias("pos", "text"),
        )
        kind = (
            F.when(F.col("doc_id") % 4 == 0, F.element_at(F.array(F.lit("ocr"), F.lit("visual"), F.lit("audio")), (F.col("pos") % 3 + 1)))
            .when(F.col("doc_id") % 4 == 1, "page")
            .when(F.col("doc_id") % 4 == 2, F.when(F.col("pos") % 3 == 2, "notes").otherwise("slide"))
            .otherwise(F.when(F.col("pos") % 2 == 1, "row").otherwise("paragraph"))
        )
        slide = F.col("doc_id") % 4 == 2
        rows = line.select(
            "user_id", "document_id", "doc_id", kind.alias("kind"),
            F.when(slide, F.floor(F.col("pos") / 3)).otherwise(F.col("pos")).cast("int").alias("_o"),
            F.col("pos").cast("int").alias("position"), "text", F.split("text", r"\. ").alias("cells"),
        )
        return rows.withColumn("ordinal", F.col("_o") + 1).drop("_o", "doc_id")

    @cached_property
    def marked(self) -> DataFrame:
        """Documents whose lines are numbered pages, so that sections exist."""
        page = F.transform(F.split("text", "\n"), lambda t, i: F.concat(F.lit("--- page "), (i + 1).cast("string"), F.lit(" ---\n"), t))
        return self.raw("documents").select(
            F.col("lang").alias("user_id"), F.col("doc_id").cast("string").alias("document_id"),
            F.array_join(page, "\n\n").alias("extracted_text"),
        )

    @cached_property
    def passages(self) -> DataFrame:
        """Plain consecutive windows of whole documents: a chunk table SQL can rebuild quickly."""
        n = F.greatest(F.lit(1), F.ceil(F.length("text") / PASSAGE)).cast("int")
        windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * PASSAGE + 1, F.lit(PASSAGE)))
        rows = self.raw("documents").select("lang", "doc_id", F.posexplode(windows).alias("chunk_index", "text"))
        return rows.select(
            F.col("lang").alias("user_id"), F.col("doc_id").cast("string").alias("document_id"),
            F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "chunk_index", "text",
        )

    @cached_property
    def index(self) -> DataFrame:
        return cut_lineage(build_index(self.passages))

    @cached_property
    def lexical_index(self) -> DataFrame:
        """The index without the vectors, for lexical search alone."""
        return cut_lineage(build_index(self.passages).drop("dense"))

    @cached_property
    def inverted(self) -> Inverted:
        """Postings of the index."""
        return build_inverted(self.index)

    @cached_property
    def questions(self) -> DataFrame:
        """Benchmark texts as questions, and for every tenth another one of punctuation only, which has no lexical terms."""
        i = F.col("item_id")
        user = F.when(i % 5 == 3, "fr").when(i % 5 == 4, "de").when(i % 7 == 2, "es").otherwise("en")
        b = self.raw("benchmark")
        bare = b.filter(i % 10 == 9).select((i + BARE).alias("query_id"), user.alias("user_id"), F.lit("?!").alias("query"))
        return b.select(i.alias("query_id"), user.alias("user_id"), F.col("text").alias("query")).unionByName(bare)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            (F.col("label") % 3).cast("string").alias("user_id"), "vec_id", F.col("label").cast("string").alias("type"),
            F.col("embedding").cast("array<double>").alias("embedding"),
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        """Lines with the names around them. Orders get their customers before lines get their orders, so that the many lines are
        shuffled once less and are stored order by order: what is counted per order later shrinks before it is shuffled."""
        n = self.raw("nation")
        cust = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_nation"), F.col("n_regionkey"))
        supp = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation"))
        bought = (
            self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
            .join(
                self.raw("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").join(cust, "c_nationkey")
                .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")),
                F.col("o_custkey") == F.col("c_custkey"),
            )
        )
        sold = (
            self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
            .join(self.raw("part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.raw("supplier").select("s_suppkey", "s_name", "s_nationkey").join(supp, "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        )
        return cut_lineage(
            sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat(F.lit("u"), F.col("r_regionkey")).alias("user_id"), F.col("o_orderkey").alias("seq"),
                F.col("o_orderkey").cast("string").alias("document_id"), F.col("o_orderdate").alias("seen_at"),
                "c_name", "c_mktsegment", "c_nation", "r_name", "p_name", "p_brand", "s_name", "s_nation", "l_linenumber",
            )
        )

    @property
    def _found(self) -> DataFrame:
        """Entity observations of every order line, repeated as often as lines name them."""
        item = lambda name, kind, about: F.struct(F.col(name).alias("name"), F.lit(kind).alias("type"), about.alias("description"))
        none = F.lit(None).cast("string")
        found = F.array(
            item("c_name", "Organization", F.col("c_mktsegment")), item("p_name", "Product", F.col("p_brand")),
            item("s_name", "Organization", none), item("c_nation", "Location", none),
            item("s_nation", "Location", none), item("r_name", "Location", none),
        )
        rows = self.order_lines.select("user_id", "document_id", "seq", "seen_at", F.inline(found))
        return rows.withColumn("name_lower", F.lower("name"))

    @cached_property
    def observations(self) -> DataFrame:
        """Entity observations of every order, one per (order, key)."""
        return self._found.groupBy("user_id", "document_id", "seq", "seen_at", "name_lower").agg(
            F.min("name").alias("name"), F.min("type").alias("type"), F.min("description").alias("description"),
            F.lit(None).cast("array<double>").alias("embedding"),
        )

    @cached_property
    def raw_edges(self) -> DataFrame:
        edge = lambda s, t, r: F.struct(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(r).alias("relation"))
        found = F.array(
            edge("c_name", "c_nation", "Headquartered in"), edge("c_name", "p_name", "utilizes"),
            edge("s_name", "s_nation", "based  in."), edge("c_nation", "r_name", "situated in"),
        )
        return self.order_lines.select("user_id", "document_id", "seen_at", F.inline(found))

    @cached_property
    def entities(self) -> DataFrame:
        """Entity table folded straight from the observations (what repeated upserts arrive at).

        Spellings are keys of a first aggregate whose values are numbers: that one hashes and shrinks on the map side, where an
        aggregate that holds strings sorts every row. What it leaves, a row per spelling of a key, is folded by first order.
        """
        spelled = self._found.groupBy("user_id", "name_lower", "name", "type", "description").agg(
            F.min("seq").alias("seq"), F.min_by("seen_at", "seq").alias("created_at"), F.max("seen_at").alias("last_seen_at")
        )
        first = [F.min(F.when(F.col(a).isNotNull(), F.struct("seq", a)))[a].alias(a) for a in ("name", "type", "description")]
        return cut_lineage(
            spelled.groupBy("user_id", "name_lower").agg(*first, F.min(F.struct("seq", "created_at"))["created_at"].alias("created_at"), F.max("last_seen_at").alias("last_seen_at"))
            .select("user_id", "name_lower", "name", "type", "description", F.lit(None).cast("array<double>").alias("embedding"), "created_at", "last_seen_at")
        )

    @cached_property
    def entity_docs(self) -> DataFrame:
        return cut_lineage(self._found.select("user_id", "name_lower", "document_id").distinct())

    @cached_property
    def edge_rows(self) -> DataFrame:
        rel = F.when(F.col("relation") == "utilizes", "uses").otherwise("located in")
        return self.raw_edges.select(
            "user_id", F.lower("source").alias("source_lower"), F.lower("target").alias("target_lower"), rel.alias("relation"),
            "document_id", F.col("seen_at").alias("created_at"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        keys = ["user_id", "source_lower", "target_lower", "relation"]
        return cut_lineage(self.edge_rows.groupBy(*keys).agg(F.min("created_at").alias("created_at")))

    @cached_property
    def edge_docs(self) -> DataFrame:
        return cut_lineage(self.edge_rows.select("user_id", "source_lower", "target_lower", "relation", "document_id").distinct())

    @cached_property
    def mentions(self) -> DataFrame:
        """Brands mentioned per order (document) and line number (chunk)."""
        return (
            self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                (F.col("l_orderkey") % 3).cast("string").alias("user_id"), F.col("l_orderkey").cast("string").alias("document_id"),
                F.lower("p_brand").alias("entity"), F.col("l_linenumber").alias("chunk_index"),
                F.col("p_brand").alias("name"), F.lit("Product").alias("type"),
            )
            .distinct()
        )

    @cached_property
    def chats(self) -> DataFrame:
        """Chats titled by their first user turn, every fourth with a summary; and for every ninth another one without messages."""
        m = self.raw("conversations")
        first = m.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
        summary = m.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"))
        c = summary.join(first, "conv_id", "left")
        empty = c.filter(F.col("conv_id") % 9 == 8).select((F.col("conv_id") + BARE).alias("conv_id"), *[F.lit(None).cast("string").alias(x) for x in ("last", "first")])
        c = c.unionByName(empty)
        i = F.col("conv_id")
        return c.select(
            (i % 10).cast("string").alias("user_id"), i.alias("chat_id"),
            placeholder_title(F.coalesce("first", F.lit(""))).alias("title"),
            F.when(i % 4 == 1, F.col("last")).alias("summary"),
            F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("created_at"),
            F.timestamp_seconds(F.lit(1704067200) + i * 3600).alias("updated_at"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        none = F.lit(None).cast("array<string>")
        return self.raw("conversations").select(
            F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"),
            F.when(F.col("role") == "assistant", F.array(F.col("turn").cast("string"))).otherwise(none).alias("citations"),
            none.alias("web_citations"),
        )

    @cached_property
    def web(self) -> DataFrame:
        """Pages as web results of the questions; some lack URL, title or score."""
        i = F.col("page_id")
        body = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
        return self.raw("pages").select(
            (i % 40).alias("query_id"), i.alias("pos"), F.when(i % 17 == 5, "  ").otherwise(F.concat(F.lit(" "), F.col("url"))).alias("url"),
            F.when(i % 13 != 3, F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"),
            body.alias("content"), F.when(i % 11 != 4, F.round(1.0 / (1 + i), 6)).alias("score"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        """One answer per (user, day) of the event stream, with mode and context flags."""
        return self.events.groupBy("answer_id").agg(F.max("user_id").alias("u"), F.max("day").alias("d")).select(
            "answer_id", F.when(F.col("u") % 7 == 0, "strict").when(F.col("u") % 7 == 1, "strict").otherwise("regular").alias("rag_mode"),
            (F.col("u") % 11 != 0).alias("use_rag"), (F.col("d") % 9 != 0).alias("has_context"),
            F.when((F.col("u") + F.col("d")) % 23 == 0, " ").otherwise(F.concat(F.lit("answer "), "answer_id")).alias("answer"),
            F.when((F.col("u") * F.col("d")) % 29 == 1, "upstream 503").alias("error"),
        )

    @cached_property
    def events(self) -> DataFrame:
        day = F.dayofmonth("ts")
        return self.raw("events").select(
            "*", day.alias("day"), F.concat_ws("-", "user_id", day).alias("answer_id")
        )

    @cached_property
    def claims(self) -> DataFrame:
        support = F.when(F.col("event_type").isin("purchase", "view"), "supported").when(F.col("event_type") == "click", "uncertain").otherwise("unsupported")
        return self.events.select(
            "answer_id", F.col("event_id").alias("pos"), F.concat(F.col("event_type"), F.lit(" "), F.col("value").cast("decimal(20,2)").cast("string")).alias("text"), support.alias("support")
        )
