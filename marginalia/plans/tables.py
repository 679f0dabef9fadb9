"""Engine tables made from the given tables, in Spark (column expressions only, no UDFs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions.text import clean_text
from marginalia.plans.joins import spread

TEXT_TABLES = {"documents"}


class Tables:
    """Given parquet tables and the engine tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df

    @staticmethod
    def file_columns() -> dict:
        d = F.col("doc_id")
        return {
            "file_md5": F.md5(d.cast("string")),
            "file_name": F.concat(F.lit("doc_"), d.cast("string"), F.lit(".txt")),
            "user_id": d % 20 + 1,
            "org_tag": F.when(d % 10 == 0, C.DEFAULT_TAG).otherwise(
                F.concat(F.lit("N"), (d % 25).cast("string"))
            ),
            "is_public": d % 7 == 0,
            "kb_profile": F.element_at(
                F.array(*[F.lit(p[0]) for p in C.PROFILES]), (d % 4 + 1).cast("int")
            ),
        }

    def files(self) -> DataFrame:
        created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + interval '1' minute * doc_id")
        return self.raw("documents").select(
            *[c.alias(n) for n, c in self.file_columns().items()],
            F.col("n_chars").alias("total_size"),
            F.lit(C.STATUS_DONE).alias("status"),
            created.alias("created_at"),
        )

    def blocks(self) -> DataFrame:
        """One block per line of a document."""
        lines = self.raw("documents").select(
            "doc_id", "lang",
            F.md5(F.col("doc_id").cast("string")).alias("file_md5"),
            F.posexplode_outer(F.split("text", "\n")).alias("block_index", "text"),  # an inner one would split twice
        ).filter("block_index IS NOT NULL")
        null_text = F.lit(None).cast("string")
        return lines.select(
            "doc_id", "lang", "file_md5", "block_index",
            F.lit("text").alias("type"), "text",
            (F.floor(F.col("block_index") / 20) + 1).cast("int").alias("page"),
            null_text.alias("section"), null_text.alias("sheet"),
            F.lit(None).cast("map<string,string>").alias("row_json"),
            F.lit("tika").alias("source_parser"), F.lit("txt").alias("file_type"),
            null_text.alias("image_path"),
        )

    def part_blocks(self) -> DataFrame:
        """One table-row block per part; a sheet per brand, one workbook per part type."""
        kv = [("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"), ("name", "p_name")]
        row = F.map_from_arrays(
            F.array(*[F.lit(k) for k, _ in kv]), F.array(*[F.col(c).cast("string") for _, c in kv])
        )
        text = F.concat_ws(
            " ; ", *[F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in kv]
        )
        null_text = F.lit(None).cast("string")
        return self.raw("part").select(
            F.md5("p_type").alias("file_md5"),
            F.col("p_partkey").cast("int").alias("block_index"),
            F.when(F.col("p_size") % 10 == 0, "schedule_row").otherwise("table_row").alias("type"),
            text.alias("text"), F.lit(None).cast("int").alias("page"),
            null_text.alias("section"), F.col("p_brand").alias("sheet"),
            row.alias("row_json"), F.lit("xlsx").alias("source_parser"),
            F.lit("xlsx").alias("file_type"), null_text.alias("image_path"),
            F.col("p_partkey").alias("row_no"),
        )

    def chunks(self, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
        """Chunk rows with owner columns; the vector sits on chunk 0 where one exists."""
        from marginalia.operators.chunking import window_pieces

        pieces = self.raw("documents").select(
            "doc_id",
            *[c.alias(n) for n, c in self.file_columns().items()],
            # an inner explode makes Spark filter on the pieces first, which would clean and cut the texts twice
            F.posexplode_outer(window_pieces(clean_text(F.col("text")), size, overlap)).alias(
                "chunk_id", "text_content"
            ),
        )
        return pieces.filter("chunk_id IS NOT NULL")

    def chunk_vectors(self) -> DataFrame:
        """Index rows: chunk 0 of each document with the embedding of the same id."""
        files = self.raw("documents").select(
            "doc_id", *[c.alias(n) for n, c in self.file_columns().items()], F.lit(0).alias("chunk_id")
        )
        vec = self.raw("embeddings").select(
            F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")
        )
        return files.join(vec, "doc_id", "left")

    def chunk_quality(self) -> DataFrame:
        """Quality per document for chunks of labelled documents."""
        return self.raw("labels").select(
            F.md5(F.col("doc_id").cast("string")).alias("file_md5"),
            F.when(F.col("toxic") == 1, "rejected")
            .when(F.col("quality") == 1, "accepted")
            .otherwise("weak")
            .alias("quality_status"),
        )

    def child_quality(self) -> DataFrame:
        """Quality rows keyed (file_md5, chunk_id)."""
        return (
            self.chunks().select("file_md5", "chunk_id").join(self.chunk_quality(), "file_md5")
        )

    def queries(self) -> DataFrame:
        q = F.col("item_id")
        return self.raw("benchmark").select(
            q.alias("query_id"),
            (q % 20 + 1).alias("user_id"),
            F.col("text").alias("query"),
            F.element_at(F.array(*[F.lit(p[0]) for p in C.PROFILES]), (q % 4 + 1).cast("int")).alias(
                "profile"
            ),
        )

    def questions(self) -> DataFrame:
        """All logged questions: benchmark items and user turns of conversations."""
        b = self.raw("benchmark").select(
            F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("question_id"),
            (F.col("item_id") % 4).alias("p"), F.col("text").alias("question"),
        )
        c = self.raw("conversations").filter("role = 'user'").select(
            F.concat_ws("_", F.lit("c"), "conv_id", "turn").alias("question_id"),
            (F.col("conv_id") % 4).alias("p"), F.col("text").alias("question"),
        )
        profile = F.element_at(F.array(*[F.lit(p[0]) for p in C.PROFILES]), (F.col("p") + 1).cast("int"))
        return b.unionByName(c).select("question_id", "question", profile.alias("profile"))

    def users(self) -> DataFrame:
        u = F.col("user_id")
        return self.raw("events").select("user_id").distinct().filter(u > 0).select(
            u,
            F.when(u == 1, C.ADMIN_ROLE).otherwise("USER").alias("role"),
            F.concat(F.lit("R"), (u % 5).cast("string"), F.lit(", S"), (u % 10).cast("string"), F.lit(",")).alias(
                "org_tags"
            ),
        )

    def org_tags(self) -> DataFrame:
        r = self.raw("region").select(
            F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("tag_id"),
            F.lit(None).cast("string").alias("parent_tag"),
        )
        n = self.raw("nation").select(
            F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("tag_id"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent_tag"),
        )
        s = self.raw("supplier").select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("tag_id"),
            F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("parent_tag"),
        )
        return r.unionByName(n).unionByName(s)

    def usage_events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        status = (
            F.when(F.col("event_type") == "signup", "no_evidence")
            .when(F.col("event_type") == "error", "error")
            .otherwise("success")
        )
        intents = ["fact_lookup", "flow_query", "layout_query", "schedule_query", "compare_query", "timeline_query", " "]
        return self.raw("events").select(
            "event_id", "user_id", status.alias("status"),
            F.element_at(F.array(*[F.lit(i) for i in intents]), k % 7 + 1).alias("intent"),
            F.element_at(F.array(*[F.lit(p[0]) for p in C.PROFILES]), (F.col("user_id") % 4 + 1).cast("int")).alias(
                "selected_profile"
            ),
            (k % 5).alias("retrieval_count"), (k % 3).alias("source_count"),
            F.floor(F.col("value") * 100).cast("int").alias("latency_ms"),
            F.col("ts").alias("created_at"),
            F.concat(F.lit("question "), F.col("event_id").cast("string")).alias("question_text"),
        )

    def messages(self) -> DataFrame:
        ts = F.expr(
            "timestamp_ntz'2024-01-01 00:00:00' + interval '1' hour * conv_id + interval '1' minute * turn"
        )
        return self.raw("conversations").select(
            F.col("conv_id").alias("conversation_id"),
            (F.col("conv_id") % 20 + 1).alias("user_id"),
            F.col("turn").alias("seq"), "role", F.col("text").alias("content"), ts.alias("ts"),
        )

    def relation_edges(self) -> DataFrame:
        """customer -> supplier -> nation -> region; one file per customer nation."""
        cust = self.raw("customer").select("c_custkey", "c_name", "c_nationkey")
        sup = self.raw("supplier").select("s_suppkey", "s_name", "s_nationkey")
        nat = self.raw("nation")
        reg = self.raw("region")
        pairs = (
            self.raw("lineitem").select("l_orderkey", "l_suppkey").distinct()
            .join(self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select("o_custkey", "l_suppkey").distinct()
            .join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        )
        file_no = F.col("c_nationkey").cast("long")
        one = pairs.select(
            file_no.alias("file_no"), F.col("c_name").alias("src"), F.col("s_name").alias("dst"),
            F.lit("依赖").alias("relation_type"),
        )
        two = pairs.join(nat, F.col("s_nationkey") == F.col("n_nationkey")).select(
            file_no.alias("file_no"), F.col("s_name").alias("src"), F.col("n_name").alias("dst"),
            F.lit("连接").alias("relation_type"), F.col("n_regionkey"),
        ).distinct()
        three = two.join(reg, F.col("n_regionkey") == F.col("r_regionkey")).select(
            "file_no", F.col("dst").alias("src"), F.col("r_name").alias("dst"), F.lit("输出").alias("relation_type")
        ).distinct()
        edges = one.unionByName(two.drop("n_regionkey")).unionByName(three)
        key = F.concat_ws("->", "src", "relation_type", "dst")
        return edges.select(
            F.md5(F.concat(F.lit("nation"), F.col("file_no").cast("string"))).alias("file_md5"),
            F.concat(F.lit("graph_"), F.col("file_no").cast("string")).alias("file_name"),
            key.alias("edge_id"), "src", "dst", "relation_type",
            (F.length("src") % 7).alias("page"),
        )

    def sheet_cells(self) -> DataFrame:
        """row = customer, column = month of order, fill = order status; one sheet per nation of 25."""
        month = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")
        return self.raw("orders").select(
            F.md5((F.col("o_custkey") % 25).cast("string")).alias("file_md5"),
            F.concat(F.lit("sheet_"), (F.col("o_custkey") % 25).cast("string")).alias("sheet"),
            F.col("o_custkey").cast("int").alias("row"), month.cast("int").alias("col"),
            F.col("o_orderstatus").alias("fill_sig"),
        ).groupBy("file_md5", "sheet", "row", "col").agg(F.min("fill_sig").alias("fill_sig"))

    def upload_parts(self) -> DataFrame:
        """Parts received so far; line numbers leave gaps below the largest, which are the parts still missing."""
        return self.raw("lineitem").select(
            F.md5(F.col("l_orderkey").cast("string")).alias("file_md5"),
            (F.col("l_linenumber") - 1).alias("chunk_index"),
        ).distinct()

    def upload_totals(self) -> DataFrame:
        return self.raw("lineitem").groupBy(F.md5(F.col("l_orderkey").cast("string")).alias("file_md5")).agg(
            F.max("l_linenumber").alias("total_chunks")
        )

    def parse_requests(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.raw("events").select(
            "event_id", "user_id",
            F.md5(F.concat("event_type", k.cast("string"))).alias("file_md5"),
            F.when(k != 0, F.concat(F.lit("file_"), k.cast("string"))).alias("file_name"),
            F.concat(F.lit("docs/"), F.col("user_id").cast("string")).alias("storage_path"),
            "ts",
        )

    def unit_parents(self) -> DataFrame:
        """Chunks as parents: three units a file, scores by length, status by label."""
        p = self.chunks().select("file_md5", "chunk_id", "text_content").join(self.chunk_quality(), "file_md5", "left")
        return p.select(
            "file_md5", F.col("chunk_id").alias("parent_chunk_id"), F.concat(F.lit("u"), (F.col("chunk_id") % 3).cast("string")).alias("document_unit_key"),
            "text_content", (F.length("text_content") % 100).alias("quality_score"), F.coalesce("quality_status", F.lit("weak")).alias("quality_status"),
        )

    def visual_pages(self) -> DataFrame:
        v = F.col("vec_id")
        return self.raw("embeddings").select(
            v.alias("visual_page_id"),
            F.md5(v.cast("string")).alias("file_md5"), F.concat(F.lit("u"), (v % 3).cast("string")).alias("document_unit_key"),
            (v % 20 + 1).alias("user_id"),
            F.when(v % 10 == 0, C.DEFAULT_TAG).otherwise(F.concat(F.lit("N"), (v % 25).cast("string"))).alias("org_tag"),
            (v % 7 == 0).alias("is_public"),
            F.element_at(F.array(*[F.lit(p[0]) for p in C.PROFILES]), (v % 4 + 1).cast("int")).alias("kb_profile"),
            F.concat(F.lit("sheet_"), F.col("label").cast("string")).alias("sheet"),
            F.concat(F.lit("page:"), (v % 40 + 1).cast("string")).alias("page_label"),
            F.when(v % 10 == 0, "pending_provider").otherwise("indexed").alias("status"),
            F.element_at(F.array(F.lit("accepted"), F.lit("weak"), F.lit("rejected")), (v % 3 + 1).cast("int")).alias(
                "quality_status"
            ),
            F.col("embedding").alias("vector"),
        )
