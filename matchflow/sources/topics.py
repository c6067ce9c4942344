"""Topics: Kafka when its connector is on the classpath, directories otherwise.

A *directory topic* stores topic records as JSON lines
``{"partition", "offset", "timestamp", "key", "value"}`` (value as UTF-8
text), one directory per topic; it is read with a fixed schema, in batch or
as a stream (``readStream.schema(...).json(dir)``), so tests and offline
runs use exactly the code path a Kafka deployment uses after ``load()``.

S1-S5, S11; the landing zone (S3) and raw tables (S4).
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchflow.schemas import schema_of

DIR_TOPIC_SCHEMA = T.StructType([
    T.StructField("partition", T.IntegerType(), True),
    T.StructField("offset", T.LongType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("key", T.StringType(), True),
    T.StructField("value", T.StringType(), True),
])


def kafka_available(spark: SparkSession) -> bool:
    """True when the Kafka data source can be loaded."""
    try:
        jvm = spark.sparkContext._jvm
        jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:
        return False


def read_kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True,
               starting: str | None = None, min_partitions: int | None = None,
               fail_on_data_loss: bool = False) -> DataFrame:
    """Topic source. A stream starts from ``latest`` and a batch read from
    ``earliest`` (the only word that Kafka batch reads take) unless told.
    ``fail_on_data_loss`` is off for streams as in the source app; readers that
    rebuild a state from the log turn it on.
    ``min_partitions`` splits the offset ranges of a topic with few partitions
    (the source app's topics have one) over that many tasks."""
    r = (spark.readStream if stream else spark.read).format("kafka")
    r = (r.option("kafka.bootstrap.servers", servers).option("subscribe", topic)
          .option("startingOffsets", starting or ("latest" if stream else "earliest")))
    if min_partitions:
        r = r.option("minPartitions", str(min_partitions))
    if stream:
        r = r.option("failOnDataLoss", str(fail_on_data_loss).lower())
    else:
        r = r.option("endingOffsets", "latest")
    return r.load()


def write_kafka(df: DataFrame, servers: str, topic: str) -> None:
    """One write for the whole DataFrame (``key``/``value`` columns)."""
    (df.write.format("kafka").option("kafka.bootstrap.servers", servers)
       .option("topic", topic).save())


#: Records of a file of a directory topic. Files are compressed, so one is read by one task.
FILE_RECORDS = 100_000


def topic_dir(root: str, topic: str) -> str:
    return f"{root.rstrip('/')}/topic={topic}"


def write_dir_topic(records: DataFrame, root: str, topic: str, mode: str = "append",
                    batch_id: int | None = None) -> None:
    """Append topic records ``(partition, offset, timestamp, key, value)`` to a
    directory topic. Binary key/value are stored as UTF-8 text. With
    ``batch_id`` the records go to their own ``batch=<id>`` sub-directory, so
    a producer retrying a batch overwrites it instead of duplicating it."""
    cols = []
    for f in DIR_TOPIC_SCHEMA.fields:
        c = F.col(f.name) if f.name in records.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    path = topic_dir(root, topic)
    if batch_id is not None:
        path = f"{path}/batch={batch_id}"
    records.select(*cols).write.mode(mode).option("maxRecordsPerFile", FILE_RECORDS).json(path, compression="gzip")


def read_dir_topic(spark: SparkSession, root: str, topic: str, stream: bool = False,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Read a directory topic as topic records (batch or stream)."""
    path = topic_dir(root, topic)
    if stream:
        r = spark.readStream.schema(DIR_TOPIC_SCHEMA)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        df = r.json(path)
    else:
        df = spark.read.schema(DIR_TOPIC_SCHEMA).json(path)
    return df.withColumn("topic", F.lit(topic))


def write_landing(records: DataFrame, root: str, mode: str = "append") -> None:
    """S3: every message's JSON value, one line each, under ``topic=<name>``.

    One file per task and trigger (never one per message); the topic column
    becomes the directory partition."""
    (records.select(F.col("value").cast("string").alias("value"), "topic")
            .write.mode(mode).partitionBy("topic").text(root))


def read_raw(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """External-table read of one landing directory with its fixed schema;
    malformed lines become all-null rows, as with a JSON SerDe."""
    return spark.read.schema(schema_of(entity)).json(topic_dir(root, entity))


def upsert_batch(state: DataFrame, upserts: DataFrame, key: str, order: str) -> DataFrame:
    """Apply a batch of client upserts (replace by key) to a state table:
    the union goes through the same latest-per-key aggregate as the log."""
    from matchflow.operators.state import latest_per_key
    return latest_per_key(state.unionByName(upserts), key, order)
