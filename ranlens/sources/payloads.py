"""Events that arrive as JSON: message values, message bodies and files.

A payload that is no JSON object is not lost: it is told from the good ones in the pass that parses them, with the
reason, and goes to the quarantine table as the text that came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ranlens.schemas import BRONZE

#: The columns beside those of an event: the text of a payload that failed, and why it did.
PAYLOAD, FAILURE = "payload", "failure"
#: Why a payload gives no event: it is NULL or blank, it is cut off or malformed, or it is JSON of another kind.
EMPTY, BROKEN, NO_OBJECT = "empty", "broken", "no_object"
CORRUPT = "_corrupt"


def _failure(text: Column, corrupt: Column) -> Column:
    begun = F.ltrim(text).startswith("{")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), EMPTY)
        .when(corrupt.isNotNull(), F.when(begun, BROKEN).otherwise(NO_OBJECT))
        .when(~begun, NO_OBJECT)
    )


def judged_payload(messages: DataFrame, value_col: str = "value", schema: T.StructType = BRONZE) -> DataFrame:
    """The event columns of the JSON object in a text or binary column, and ``payload`` and ``failure`` where there is none.

    Use ``value`` for a Kafka source and ``body`` for Event Hubs. One row a message; the message is parsed once.
    """
    with_corrupt = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema), T.StructField(CORRUPT, T.StringType())])
    text = F.col(value_col).cast("string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # Rows of a generator are not looked through: a test of the reason does not parse the payload again.
    parsed = messages.select(text.alias(PAYLOAD)).select(PAYLOAD, F.inline(F.array(F.from_json(PAYLOAD, with_corrupt, options))))
    failure = _failure(F.col(PAYLOAD), F.col(CORRUPT))
    judged = parsed.select(*schema.names, PAYLOAD, failure.alias(FAILURE))
    return judged.withColumn(PAYLOAD, F.when(F.col(FAILURE).isNotNull(), F.col(PAYLOAD)))


def parse_payload(messages: DataFrame, value_col: str = "value", schema: T.StructType = BRONZE) -> DataFrame:
    """The events of the messages that hold one; ``judged_payload`` has the others, too."""
    return events_of(judged_payload(messages, value_col, schema))


def events_of(judged: DataFrame) -> DataFrame:
    """The rows that are events, in the columns of events."""
    return judged.where(F.col(FAILURE).isNull()).drop(PAYLOAD, FAILURE)


def failures_of(judged: DataFrame, now: Column | None = None) -> DataFrame:
    """The payloads that failed, as the quarantine table keeps them."""
    stamp = F.current_timestamp() if now is None else now
    return judged.where(F.col(FAILURE).isNotNull()).select(PAYLOAD, FAILURE, stamp.alias("received_at"))


def observed_payloads(judged: DataFrame, name: str = "payloads") -> DataFrame:
    """The same rows, with the number of messages and of failed ones of each batch in the query progress."""
    return judged.observe(name, F.count("*").alias("rows"), F.count(FAILURE).alias("failed"))


def stream_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The judged messages of a Kafka topic (needs the Kafka connector on the class path)."""
    source = spark.readStream.format("kafka").options(**options)
    return judged_payload(source.option("kafka.bootstrap.servers", servers).option("subscribe", topic).load())


def stream_json_dir(
    spark: SparkSession, path: str, schema: T.StructType = BRONZE, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The judged lines of JSON-lines files as they arrive in a directory; blank lines are no payloads."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return judged_payload(reader.load(path).where(F.trim("value") != ""), "value", schema)
