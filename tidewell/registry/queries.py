"""One query per operator, over the given tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.text import clean_text, preview
from tidewell.functions.vectors import as_floats
from tidewell.operators.chatlog import append_exchanges, new_turns, turns_after
from tidewell.operators.chunk import chunk_documents
from tidewell.operators.embed import embed, embed_distinct
from tidewell.operators.ids import dense_ids, unique_id
from tidewell.operators.knn import nearest
from tidewell.operators.lookup import fetch_hits, rows_with_ids
from tidewell.operators.pivots import build_pivot_index, find_nearest_by_pivots
from tidewell.partitioning import spread
from tidewell.plans import agent, faq
from tidewell.plans.ingest import Database, increments, ingest_table
from tidewell.plans.index import id_mapping, load_index, save_index, search_index
from tidewell.plans.layers import Layers, build_chunks, build_layers, raw_documents
from tidewell.plans.refresh import read_layer, refresh_layer
from tidewell.plans.retrieval import retrieve
from tidewell.registry import samples
from tidewell.sinks.tables import (
    CatalogTarget,
    PathTarget,
    append_run_record,
    ensure_schema,
    index_stats,
    use_schema,
)
from tidewell.sinks.versions import VersionedTable
from tidewell.sources.jdbc import measured_split, read_jdbc
from tidewell.sources.tables import catalog_table, inline_rows, parquet_table, values_view
from tidewell.streaming.incremental import (
    DEFAULT_WATERMARK,
    LoadLog,
    high_watermark,
    incremental_load,
    latest_versions,
    logged_load,
    newer_than,
    resolve_watermark,
)
from tidewell.streaming.kept import merge_latest, merge_turns
from tidewell.workspace import Workspace

# The part of the orders that is already there when the first load runs.
FIRST_LOAD_UNTIL = "1998-06-30 00:00:00"

# Where orders can be read over JDBC; an embedded database otherwise.
JDBC_URL_SETTING = "spark.tidewell.jdbc.url"
EMBEDDED_DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"

ORDER_COLUMNS = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
)

_layers: dict[tuple[str, str], Layers] = {}


def document_layers(spark: SparkSession, folder: str) -> Layers:
    """The layer tables of the documents, built once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _layers:
        _layers[key] = fresh_layers(spark, folder)
    return _layers[key]


def fresh_layers(spark: SparkSession, folder: str) -> Layers:
    with Workspace(spark, "staged") as workspace:
        return build_layers(**_layer_arguments(spark, folder, workspace))


def _layer_arguments(spark: SparkSession, folder: str, workspace: Workspace) -> dict:
    return {
        "spark": spark,
        "documents": parquet_table(spark, folder, "documents"),
        "schema": f"tidewell_{uuid.uuid4().hex}",
        "workspace": workspace,
        "source_file": "doc_id",
        "text": "text",
        "dense": True,
        "location": Workspace(spark, "layers").path("tables"),
    }


def _catalog_target(spark: SparkSession, table: str) -> CatalogTarget:
    workspace = Workspace(spark, "raw")
    schema = f"tidewell_{uuid.uuid4().hex}"
    ensure_schema(spark, schema, workspace.path("tables"))
    return CatalogTarget(spark, f"{schema}.{table}")


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# -- incremental load ---------------------------------------------------------


def _orders_database(spark: SparkSession, folder: str) -> tuple[str, dict[str, str]]:
    """URL and properties of a database that holds the table ``ORDERS``.

    Without the setting it is an embedded one, filled here.
    """
    url = spark.conf.get(JDBC_URL_SETTING, None)
    if url is not None:
        return url, {}
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(
            f"set {JDBC_URL_SETTING}: an embedded database is visible only "
            "inside the process that holds it"
        )
    url = f"jdbc:derby:memory:tidewell{uuid.uuid4().hex};create=true"
    properties = {"driver": EMBEDDED_DRIVER}
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)
    (
        parquet_table(spark, folder, "orders")
        .select(*[F.col(c).alias(c.upper()) for c in ORDER_COLUMNS])
        .write.format("jdbc")
        .options(url=url, dbtable="ORDERS", batchsize=5000, **properties)
        .option(
            "createTableColumnTypes",
            "O_ORDERSTATUS VARCHAR(1), O_ORDERPRIORITY VARCHAR(64)",
        )
        .save()
    )
    return url, properties


def ingest_jdbc_full(spark: SparkSession, folder: str) -> DataFrame:
    """Orders through a JDBC source, read in parallel ranges of the key."""
    url, properties = _orders_database(spark, folder)
    split = measured_split(
        spark, url, "ORDERS", properties, "O_ORDERKEY",
        partitions=spark.sparkContext.defaultParallelism,
    )
    orders = read_jdbc(spark, url, "ORDERS", properties, split)
    return _as_text(orders.toDF(*[c.lower() for c in orders.columns]), "o_orderdate")


def ingest_increment_split(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of the later dates loaded over JDBC, in ranges cut for the increment alone."""
    url, properties = _orders_database(spark, folder)
    orders = parquet_table(spark, folder, "orders").select(*ORDER_COLUMNS)
    target = _catalog_target(spark, "orders")
    earlier = orders.where(F.col("o_orderdate") <= F.lit(FIRST_LOAD_UNTIL).cast("timestamp_ntz"))
    incremental_load(earlier.withColumn("load_no", F.lit(1).cast("bigint")), target, "o_orderdate")
    read = increments(spark, Database(url, properties), "", "ORDERS", "O_ORDERDATE", "O_ORDERKEY")

    def source(watermark: str | None) -> DataFrame:
        rows = read(watermark)
        return rows.toDF(*[c.lower() for c in rows.columns]).withColumn(
            "load_no", F.lit(2).cast("bigint")
        )

    incremental_load(source, target, "o_orderdate")
    return _as_text(target.read(), "o_orderdate")


def ingest_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Two loads of orders into one table: the earlier dates, then what is new."""
    orders = parquet_table(spark, folder, "orders").select(*ORDER_COLUMNS)
    target = _catalog_target(spark, "orders")
    earlier = orders.where(F.col("o_orderdate") <= F.lit(FIRST_LOAD_UNTIL).cast("timestamp_ntz"))
    incremental_load(earlier.withColumn("load_no", F.lit(1).cast("bigint")), target, "o_orderdate")
    incremental_load(orders.withColumn("load_no", F.lit(2).cast("bigint")), target, "o_orderdate")
    return _as_text(target.read(), "o_orderdate")


def ingest_early_dates(spark: SparkSession, folder: str) -> DataFrame:
    """A first load of orders dated 150 years earlier, the finished ones without a date."""
    orders = parquet_table(spark, folder, "orders").select(*ORDER_COLUMNS)
    early = F.expr("if(o_orderstatus = 'F', NULL, o_orderdate - INTERVAL 150 YEARS)")
    target = _catalog_target(spark, "orders")
    incremental_load(orders.withColumn("o_orderdate", early), target, "o_orderdate")
    return _as_text(target.read(), "o_orderdate")


def ingest_no_new_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Two loads of all events; the second finds nothing and writes nothing."""
    events = parquet_table(spark, folder, "events")
    target = _catalog_target(spark, "events")
    first = incremental_load(events, target, "ts")
    again = incremental_load(events, target, "ts", floor=resolve_watermark(target, "ts"))
    return target.read().agg(
        F.lit(first.new_records).cast("bigint").alias("first_load"),
        F.lit(again.new_records).cast("bigint").alias("second_load"),
        F.lit(again.watermark).alias("second_watermark"),
        F.count(F.lit(1)).alias("rows_in_target"),
    )


def ingest_inclusive(spark: SparkSession, folder: str) -> DataFrame:
    """A load that also takes late rows sharing the highest watermark.

    At first only the open orders of the latest date are there.
    """
    orders = parquet_table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderdate"
    )
    target = _catalog_target(spark, "orders")
    early = orders.where("o_orderstatus = 'O'").withColumn("load_no", F.lit(1).cast("bigint"))
    incremental_load(early, target, "o_orderdate")
    incremental_load(
        orders.withColumn("load_no", F.lit(2).cast("bigint")),
        target, "o_orderdate", key="o_orderkey", inclusive=True,
    )
    return _as_text(target.read(), "o_orderdate")


def high_watermarks(spark: SparkSession, folder: str) -> DataFrame:
    """Where the next load of each table would start; a missing table has the default."""
    found = [
        high_watermark(parquet_table(spark, folder, table), column).withColumn(
            "table_name", F.lit(table)
        )
        for table, column in (
            ("orders", "o_orderdate"), ("events", "ts"), ("lineitem", "l_shipdate"),
        )
    ]
    absent = PathTarget(spark, Workspace(spark, "absent").path("none"))
    missing = found[0].select(
        F.lit(resolve_watermark(absent, "ts") or DEFAULT_WATERMARK).alias("watermark"),
        F.lit("missing").alias("table_name"),
    )
    rows = missing
    for one in found:
        rows = rows.unionByName(one)
    return rows.select("table_name", "watermark")


def new_record_count(spark: SparkSession, folder: str) -> DataFrame:
    """Lines shipped after the last order date."""
    orders = parquet_table(spark, folder, "orders")
    watermark = high_watermark(orders, "o_orderdate").first()["watermark"]
    return newer_than(
        parquet_table(spark, folder, "lineitem"), "l_shipdate", watermark
    ).agg(F.count(F.lit(1)).alias("new_records"))


def append_merge_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Customers appended twice, each time with a column the other lacks."""
    customer = parquet_table(spark, folder, "customer")
    target = PathTarget(spark, Workspace(spark, "evolving").path("customer"))
    target.append(customer.select("c_custkey", "c_name", "c_acctbal"))
    target.append(customer.select("c_custkey", "c_name", "c_mktsegment"))
    return target.read().select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def ingest_named(spark: SparkSession, folder: str) -> DataFrame:
    """Orders ingested over JDBC into ``catalog.schema.table``, read by their bare name."""
    url, properties = _orders_database(spark, folder)
    schema = f"tidewell_{uuid.uuid4().hex}"
    ensure_schema(spark, schema, Workspace(spark, "raw").path("tables"))
    ingest_table(
        spark, Database(url, properties), "", "ORDERS", schema, "O_ORDERDATE",
        target_catalog="spark_catalog", split_column="O_ORDERKEY",
    )
    before = spark.catalog.currentDatabase()
    use_schema(spark, schema)
    try:
        orders = catalog_table(spark, "orders")
        return _as_text(orders.toDF(*[c.lower() for c in orders.columns]), "o_orderdate")
    finally:
        use_schema(spark, before)


def ingest_logged(spark: SparkSession, folder: str) -> DataFrame:
    """Events loaded by days of a week, each load starting from the log of the ones before."""
    events = parquet_table(spark, folder, "events")
    target = _catalog_target(spark, "events")
    records = PathTarget(spark, Workspace(spark, "loads").path("log"))
    log = LoadLog(records, "events")
    for until in ("2024-01-08", "2024-01-15", None):
        known = events if until is None else events.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
        logged_load(known, target, "ts", log)
    loads = records.read().select("load_no", "new_records", "started_from", "watermark")
    return loads.crossJoin(F.broadcast(target.read().agg(F.count(F.lit(1)).alias("rows_in_target"))))


def replace_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Customers replaced twice, the second time with another column and from the first version."""
    customer = parquet_table(spark, folder, "customer")
    table = _versioned(spark, "customer")
    first = table.replace(customer.select("c_custkey", F.lower("c_name").alias("c_name")))
    segments = customer.select("c_custkey", "c_mktsegment")
    both = first.join(segments, "c_custkey").withColumn("c_name", F.upper("c_name"))
    return table.replace(both)


def _versioned(spark: SparkSession, table: str) -> VersionedTable:
    schema = f"tidewell_{uuid.uuid4().hex}"
    ensure_schema(spark, schema, Workspace(spark, "versions").path("tables"))
    return VersionedTable(spark, schema, table)


def latest_after_two_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Latest versions of orders as state that the second load is merged into."""
    state = _versioned(spark, "orders_latest")
    for load in _order_loads(spark, folder):
        merge_latest(state, load, "o_orderkey", "o_orderdate", buckets=_buckets(spark))
    return _as_text(state.read(), "o_orderdate")


def _buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _order_loads(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Orders, then the open ones closed a week later, as further versions."""
    orders = parquet_table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"
    )
    closed = orders.where("o_orderstatus = 'O'").withColumns(
        {
            "o_orderstatus": F.lit("F"),
            "o_orderdate": F.expr("o_orderdate + INTERVAL 7 DAYS"),
        }
    )
    return [orders, closed]


def bronze_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest versions of all orders ever loaded."""
    orders, closed = _order_loads(spark, folder)
    versions = orders.unionByName(closed)
    return _as_text(latest_versions(versions, "o_orderkey", "o_orderdate"), "o_orderdate")


# -- views and raw documents --------------------------------------------------


def policy_view(spark: SparkSession, folder: str) -> DataFrame:
    """A view over values, joined in SQL with the turns it describes."""
    parquet_table(spark, folder, "conversations").createOrReplaceTempView("conversation_turns")
    values_view(spark, "speakers", ("id", "topic", "content"), samples.SPEAKERS)
    return spark.sql(
        """
        SELECT t.conv_id, t.turn, CAST(s.id AS BIGINT) AS id, s.topic, s.content
        FROM conversation_turns t JOIN speakers s ON s.topic = t.role
        """
    )


def docs_inline(spark: SparkSession, folder: str) -> DataFrame:
    """Rows given in the program next to those of the table, cleaned alike."""
    given = inline_rows(spark, samples.DOCUMENTS)
    documents = parquet_table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("source_file"), F.col("text").alias("raw_content")
    )
    return spread(documents).unionByName(given).withColumn(
        "cleaned_content", clean_text(F.col("raw_content"))
    ).select("source_file", "cleaned_content")


def bronze_documents(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_documents(parquet_table(spark, folder, "documents"), "doc_id", "text")
    return raw.select(
        "source_file", "raw_content", F.col("ingestion_time").isNotNull().alias("has_time")
    )


# -- text ---------------------------------------------------------------------


def clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = parquet_table(spark, folder, "documents").select("doc_id", "text")
    return spread(documents).select(
        "doc_id", clean_text(F.col("text")).alias("cleaned_content")
    )


def clean_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = parquet_table(spark, folder, "pages").select("page_id", "html")
    return spread(pages).select("page_id", clean_text(F.col("html")).alias("cleaned_content"))


def _document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    documents = parquet_table(spark, folder, "documents").select("doc_id", "text")
    return chunk_documents(spread(documents), "doc_id", text_col="text")


def preview_chunks(spark: SparkSession, folder: str) -> DataFrame:
    line = preview(F.col("doc_id").cast("string"), F.col("chunk_text"))
    return _document_chunks(spark, folder).select("doc_id", "chunk_no", line.alias("preview"))


def chunk_ids_unique(spark: SparkSession, folder: str) -> DataFrame:
    ids = _document_chunks(spark, folder).select(unique_id().alias("chunk_id"))
    return ids.agg(
        F.count(F.lit(1)).alias("num_chunks"), F.countDistinct("chunk_id").alias("num_ids")
    )


def chunk_ids_dense(spark: SparkSession, folder: str) -> DataFrame:
    numbered = dense_ids(
        _document_chunks(spark, folder).drop("chunk_text"),
        Workspace(spark, "ids"),
        ["doc_id", "chunk_no"],
    )
    return numbered.select("doc_id", "chunk_no", "chunk_id")


def medallion_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The raw and the chunk layer built anew; the latter as its table has it."""
    with Workspace(spark, "staged") as workspace:
        return build_chunks(**_layer_arguments(spark, folder, workspace))[1]


def layers_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """The vector layer of an earlier state of the documents, brought up to date.

    Earlier, one source had other texts, one was not there yet, and one had further
    documents that are gone now.
    """
    documents = parquet_table(spark, folder, "documents")
    name = F.col("doc_id").cast("string").alias("source_file")
    now = documents.select(name, F.col("text").alias("raw_content"))
    other = F.when(F.col("source") == "src1", F.concat("text", F.lit(" as it was"))).otherwise(F.col("text"))
    earlier = documents.where("source <> 'src2' or source is null").select(name, other.alias("raw_content"))
    gone = documents.where("source = 'src3'").select(
        F.concat(F.lit("old "), "doc_id").alias("source_file"), F.col("text").alias("raw_content")
    )
    place = Workspace(spark, "layer").path("refreshed")
    for version in (earlier.unionByName(gone), now):
        with Workspace(spark, "refresh") as workspace:
            refresh_layer(version, place, workspace)
    return read_layer(spark, place).select(
        "source_file",
        "chunk_no",
        "chunk_text",
        F.size(F.array_remove("embedding", F.lit(0).cast("float"))).cast("bigint").alias("n_components"),
    )


# -- vectors ------------------------------------------------------------------


def embed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The non-zero components of every chunk's vector."""
    return _components(embed(_document_chunks(spark, folder), "chunk_text"))


def embed_distinct_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The same, each distinct chunk of the whole corpus encoded once."""
    workspace = Workspace(spark, "distinct")
    cut = workspace.stage(_document_chunks(spark, folder), "chunks")
    return _components(embed_distinct(cut, "chunk_text", workspace))


def _components(vectors: DataFrame) -> DataFrame:
    # The outer form has no filter on the vectors inferred, which would encode twice.
    return vectors.select(
        "doc_id", "chunk_no", F.posexplode_outer("embedding").alias("position", "weight")
    ).where("weight <> 0").select(
        "doc_id",
        "chunk_no",
        F.col("position").cast("bigint").alias("position"),
        F.round(F.col("weight").cast("double"), 7).alias("weight"),
    )


def index_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Size and dimension of the vectors, recorded in a run table."""
    target = _catalog_target(spark, "index_runs")
    append_run_record(
        index_stats(parquet_table(spark, folder, "embeddings")), target, "index_creation"
    )
    return target.read().select("run_name", "num_vectors", "embedding_dim")


def vector_positions(spark: SparkSession, folder: str) -> DataFrame:
    vectors = parquet_table(spark, folder, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return id_mapping(vectors, Workspace(spark, "mapping"))


def _label_examples(vectors: DataFrame) -> DataFrame:
    """The lowest-numbered vector of every label, written once for repeated use."""
    # The least id in a hash aggregate; one of the whole vectors would sort them all.
    first = vectors.groupBy("label").agg(F.min("vec_id").alias("vec_id")).drop("label")
    examples = vectors.join(first, "vec_id", "left_semi").select(
        F.col("label").cast("bigint").alias("label"),
        as_floats(F.col("embedding")).alias("embedding"),
    )
    return Workspace(vectors.sparkSession, "examples").stage(examples, "labels")


def knn_l2_top3(spark: SparkSession, folder: str) -> DataFrame:
    """For each label's example, the three nearest of all vectors."""
    vectors = parquet_table(spark, folder, "embeddings")
    return nearest(_label_examples(vectors), vectors, 3, query_id="label", corpus_id="vec_id")


def knn_pivot_index(spark: SparkSession, folder: str) -> DataFrame:
    """The same through an index of cells around pivots."""
    vectors = parquet_table(spark, folder, "embeddings")
    index = build_pivot_index(vectors, Workspace(spark, "pivots"), "vec_id")
    found = find_nearest_by_pivots(
        _label_examples(vectors), index, 3, query_id="label", corpus_id="vec_id"
    )
    return found.rows


def knn_k_exceeds_n(spark: SparkSession, folder: str) -> DataFrame:
    """For each vector the label examples by distance: one more asked for than there are."""
    vectors = parquet_table(spark, folder, "embeddings")
    examples = _label_examples(vectors)
    return nearest(
        vectors, examples, examples.count() + 1, query_id="vec_id", corpus_id="label"
    ).drop("l2")


def nearest_one(spark: SparkSession, folder: str) -> DataFrame:
    """For each vector the label of the nearest example."""
    vectors = parquet_table(spark, folder, "embeddings")
    return nearest(
        vectors, _label_examples(vectors), 1, query_id="vec_id", corpus_id="label"
    ).select("vec_id", "label", "squared_l2")


# -- retrieval and answers ----------------------------------------------------


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return parquet_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def retrieve_context(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest document chunks of every benchmark text."""
    layers = document_layers(spark, folder)
    return retrieve(_questions(spark, folder), layers.vectors, texts=layers.chunks)


def retrieve_uncleaned(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the questions encoded as they are written."""
    layers = document_layers(spark, folder)
    return retrieve(
        _questions(spark, folder), layers.vectors, clean_queries=False, texts=layers.chunks
    )


def retrieve_saved_index(spark: SparkSession, folder: str) -> DataFrame:
    """Search in the saved form of an index, positions mapped back to ids."""
    vectors = parquet_table(spark, folder, "embeddings")
    workspace = Workspace(spark, "index")
    save_index(vectors, workspace.path("saved"), workspace, id_col="vec_id")
    index = load_index(spark, workspace.path("saved"), "vec_id")
    hits = search_index(_label_examples(vectors), index, query_id="label")
    names = vectors.select("vec_id", F.col("label").cast("bigint").alias("hit_label"))
    return fetch_hits(hits, names, "vec_id").select(
        "label", "rank", "vec_pos", "vec_id", "hit_label", "squared_l2"
    )


def lookup_chunks_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks whose id is among the labelled document numbers."""
    ids = parquet_table(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"))
    chunks = document_layers(spark, folder).chunks
    return rows_with_ids(chunks, ids, "chunk_id").select("chunk_id", "source_file", "chunk_text")


def _prepared(spark: SparkSession, folder: str, cited: bool = False) -> DataFrame:
    return agent.with_context(
        _questions(spark, folder), retrieve_context(spark, folder), cited
    )


def assemble_context(spark: SparkSession, folder: str) -> DataFrame:
    return _prepared(spark, folder).select("query_id", "context")


def assemble_cited_context(spark: SparkSession, folder: str) -> DataFrame:
    return _prepared(spark, folder, cited=True).select("query_id", "context")


def format_sources(spark: SparkSession, folder: str) -> DataFrame:
    return agent.answer_with_sources(
        _questions(spark, folder), retrieve_context(spark, folder)
    ).select("query_id", "response")


def build_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _prepared(spark, folder).select("query_id", "prompt")


def answer_questions(spark: SparkSession, folder: str) -> DataFrame:
    return agent.answer_questions(_questions(spark, folder), retrieve_context(spark, folder))


def answer_generated(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a generator that quotes its prompt, and refuses long ones."""
    return agent.answer_generated(
        _questions(spark, folder),
        retrieve_context(spark, folder),
        samples.Excerpts,
        Workspace(spark, "answers"),
        max_length=160,
    ).select("query_id", "answer", "failure")


def answer_with_sources(spark: SparkSession, folder: str) -> DataFrame:
    return agent.answer_with_sources(
        _questions(spark, folder), retrieve_context(spark, folder)
    )


def _closing_exchanges(log: DataFrame) -> DataFrame:
    """One exchange a conversation, which repeats its last message."""
    return log.groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("question"),
        F.concat(F.lit("Turns so far: "), F.count(F.lit(1)).cast("string")).alias("answer"),
    )


def append_chat_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation continued by one exchange."""
    log = parquet_table(spark, folder, "conversations")
    return append_exchanges(log, _closing_exchanges(log))


def new_chat_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The same, but only what a saved log would be given."""
    log = parquet_table(spark, folder, "conversations")
    return new_turns(log, _closing_exchanges(log))


def new_chat_turns_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The same from the last turns kept as state; the log is not read for it."""
    log = parquet_table(spark, folder, "conversations")
    state = _versioned(spark, "last_turns")
    merge_turns(state, log, buckets=_buckets(spark))
    exchanges = Workspace(spark, "chat").stage(_closing_exchanges(log), "exchanges")
    turns = Workspace(spark, "chat").stage(turns_after(state.read(), exchanges), "turns")
    merge_turns(state, turns, buckets=_buckets(spark))
    return turns


def policy_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The knowledge entry nearest to every conversation turn."""
    entries = values_view(spark, "knowledge", ("id", "topic", "content"), samples.ENTRIES)
    turns = parquet_table(spark, folder, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias(
            "query_id"
        ),
        F.col("text").alias("question"),
    )
    return faq.nearest_entry(turns, entries)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ingest_jdbc_full": ingest_jdbc_full,
    "ingest_increment_split": ingest_increment_split,
    "ingest_incremental": ingest_incremental,
    "ingest_early_dates": ingest_early_dates,
    "ingest_no_new_rows": ingest_no_new_rows,
    "ingest_inclusive": ingest_inclusive,
    "high_watermark": high_watermarks,
    "new_record_count": new_record_count,
    "append_merge_schema": append_merge_schema,
    "ingest_named": ingest_named,
    "ingest_logged": ingest_logged,
    "replace_versions": replace_versions,
    "bronze_latest": bronze_latest,
    "latest_after_two_loads": latest_after_two_loads,
    "policy_view": policy_view,
    "docs_inline": docs_inline,
    "bronze_documents": bronze_documents,
    "clean_documents": clean_documents,
    "clean_pages": clean_pages,
    "chunk_documents": _document_chunks,
    "preview_chunks": preview_chunks,
    "chunk_ids_unique": chunk_ids_unique,
    "chunk_ids_dense": chunk_ids_dense,
    "medallion_chunks": medallion_chunks,
    "layers_refresh": layers_refresh,
    "embed_chunks": embed_chunks,
    "embed_distinct_chunks": embed_distinct_chunks,
    "index_stats": index_statistics,
    "id_mapping": vector_positions,
    "knn_l2_top3": knn_l2_top3,
    "knn_pivot_index": knn_pivot_index,
    "knn_k_exceeds_n": knn_k_exceeds_n,
    "nearest_one": nearest_one,
    "retrieve_context": retrieve_context,
    "retrieve_uncleaned": retrieve_uncleaned,
    "retrieve_saved_index": retrieve_saved_index,
    "lookup_chunks_by_id": lookup_chunks_by_id,
    "assemble_context": assemble_context,
    "assemble_cited_context": assemble_cited_context,
    "format_sources": format_sources,
    "build_prompts": build_prompts,
    "answer_questions": answer_questions,
    "answer_generated": answer_generated,
    "answer_with_sources": answer_with_sources,
    "append_chat_turns": append_chat_turns,
    "new_chat_turns": new_chat_turns,
    "new_chat_turns_kept": new_chat_turns_kept,
    "policy_nearest": policy_nearest,
}
