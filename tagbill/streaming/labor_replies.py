"""ST1-ST4: labor replies arriving as a stream of mail notifications.

Two forms. ``run_reply_join`` takes both sides as streams: the notifications and the reply
sheets. Redelivered messages are dropped by Spark's keyed state (``dropDuplicates``, whose
store is checkpointed, so a batch costs the same after many epochs), and the weeks that were
notified are joined with the sheets' rows, stream with stream and without a watermark: either
side may come first, at any distance. File sinks write each epoch once. A week's later sheet
replaces its earlier one on read.

``run_labor_reply_stream`` is for replies that lie in a table:

``readStream`` over a notification folder → filter (client state, message id,
subject phrase, week in the subject) → ``foreachBatch``:

* redelivered notifications are dropped by an anti-join with the message ids
  of earlier epochs (ST2; the reference appends a second copy),
* the week's labor rows are written as one keyed unit per week, so a repeated
  reply for a week replaces rather than doubles it,
* each epoch writes into its own ``epoch=<n>`` folder with overwrite, so a
  replayed epoch after a failure rewrites the same files (exactly-once output),
* there is no watermark: late replies still count (ST3).

``Trigger.availableNow`` runs the same query as an incremental batch (ST4).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.labor import REPACK_SUBJECT, labor_rows
from ..operators.state import numbered_folders
from ..schemas import LABOR_CHARGES, NOTIFICATION, REPLY_ROW
from ..session import ensure_checkpoint_dir

WEEK_IN_SUBJECT = r"\d{4}-\d{2}-\d{2}"   # fixed value: how a subject names its week
CLIENT_STATE = "tagbill"


def notifications_from_events(events: DataFrame) -> DataFrame:
    """Mail notifications derived from the ``events`` table (one per event).

    Purchases carry the labor subject with a billing week (Sundays from 1995-01-08
    on, picked by event id); signups carry the phrase but no week; every 50th
    notification has a foreign client state.
    """
    week = F.date_format(F.date_add(F.lit("1995-01-08").cast("date"),
                                    (F.pmod("event_id", F.lit(360)) * 7).cast("int")), "yyyy-MM-dd")
    subject = (F.when(F.col("event_type") == "purchase",
                      F.concat(F.lit("RE: " + REPACK_SUBJECT + " "), week))
               .when(F.col("event_type") == "signup", F.lit("Re: " + REPACK_SUBJECT.lower()))
               .otherwise(F.lit("Weekly report")))
    return events.select(
        F.col("event_id").cast("string").alias("message_id"),
        F.when(F.pmod("event_id", F.lit(50)) == 0, F.lit("other")).otherwise(F.lit(CLIENT_STATE))
        .alias("client_state"),
        subject.alias("subject"), F.col("ts").cast("timestamp").alias("received_at"),
        F.lit(None).cast("string").alias("week_folder"))


def accepted(notes: DataFrame, expected_state: str | None = CLIENT_STATE) -> DataFrame:
    """Expected client state (if configured), id present, phrase in subject, week found."""
    ok = F.col("message_id").isNotNull() & F.lower("subject").contains(REPACK_SUBJECT.lower())
    if expected_state:
        ok = ok & (F.col("client_state") == expected_state)
    week = F.regexp_extract("subject", WEEK_IN_SUBJECT, 0)
    return notes.filter(ok).withColumn("week", week).filter(F.col("week") != "")


def run_labor_reply_stream(spark: SparkSession, inbox: str, replies: DataFrame, base: str,
                           hourly_rate: str = "18.75") -> dict[str, str]:
    """Process every notification in ``inbox`` once; return the state folders.

    ``replies`` holds ops' reply rows keyed by ``week_end`` (what the reply
    attachment for that week contains).
    """
    messages_dir, labor_dir = f"{base}/state/messages", f"{base}/state/labor_charges"
    # every epoch reads the replies, so they are worked out once a run and not once an epoch
    staged = f"{base}/replies/x{uuid.uuid4().hex}"
    replies.write.parquet(staged)
    replies = spark.read.schema(replies.schema).parquet(staged)

    def committed_ids(before: int) -> DataFrame:
        """Message ids of earlier epochs; a replayed epoch must not see its own."""
        done = [n for n in numbered_folders(spark, messages_dir, "epoch=") if n < before]
        if not done:
            return spark.createDataFrame([], "message_id string")
        return spark.read.parquet(*[f"{messages_dir}/epoch={n}" for n in done]).select("message_id")

    def process(batch: DataFrame, epoch: int) -> None:
        # merged, not broadcast: the log of messages doesn't pass through the driver
        fresh = (batch.dropDuplicates(["message_id"])
                 .join(committed_ids(epoch).hint("merge"), "message_id", "left_anti"))
        taken = f"{messages_dir}/epoch={epoch}"
        fresh.select("message_id", "week", "received_at").write.mode("overwrite").parquet(taken)
        weeks = spark.read.schema("week string").parquet(taken).distinct()
        rows = labor_rows(replies.join(weeks, replies["week_end"] == weeks["week"], "left_semi"),
                          F.col("_week"), hourly_rate)
        rows.write.mode("overwrite").parquet(f"{labor_dir}/epoch={epoch}")

    stream = (spark.readStream.schema(NOTIFICATION).option("maxFilesPerTrigger", 4).parquet(inbox)
              .transform(accepted)
              .writeStream.foreachBatch(process)
              .option("checkpointLocation", f"{base}/checkpoint")
              .trigger(availableNow=True).start())
    stream.awaitTermination()
    return {"messages": messages_dir, "labor": labor_dir}


def labor_from_stream(spark: SparkSession, labor_dir: str) -> DataFrame:
    """The labor rows the stream recorded, one unit per week (latest epoch wins for a week)."""
    done = numbered_folders(spark, labor_dir, "epoch=")
    if not done:
        return spark.createDataFrame([], LABOR_CHARGES)
    df = (spark.read.option("basePath", labor_dir).parquet(*[f"{labor_dir}/epoch={n}" for n in done])
          .withColumn("_e", F.col("epoch")))
    # last epoch per week by a (partially aggregated) group-by, joined back on the week
    last = df.groupBy("week_end").agg(F.max("_e").alias("_last"))
    return (df.join(last, "week_end").filter(F.col("_e") == F.col("_last"))
            .select(*[f.name for f in LABOR_CHARGES.fields]))


def stage_inbox(spark: SparkSession, notes: DataFrame, replay_fraction_mod: int = 7) -> str:
    """Write notifications into a fresh folder under the shared checkpoint dir, then
    replay every 7th message as a second file (redelivery)."""
    base = f"{ensure_checkpoint_dir(spark)}/labor-stream-{uuid.uuid4().hex}"
    notes.write.parquet(f"{base}/inbox/0")
    notes.filter(F.pmod(F.col("message_id").cast("long"), F.lit(replay_fraction_mod)) == 0) \
        .write.parquet(f"{base}/inbox/1")
    return base


# ------------------------------------------------- both sides as streams
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run_once(spark: SparkSession, rows: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has landed since the last run; state is kept on disk, not on the heap."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        (rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start()).awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_reply_join(spark: SparkSession, notes_inbox: str, replies_inbox: str, base: str,
                   hourly_rate: str = "18.75") -> dict[str, str]:
    """Take in new notifications and new reply sheets; the folders of the message log and the labor rows.

    ``notes_inbox`` holds notifications, ``replies_inbox`` reply rows (``REPLY_ROW``), both as Parquet files.
    """
    def notes() -> DataFrame:
        return spark.readStream.schema(NOTIFICATION).parquet(notes_inbox).transform(accepted)

    messages = f"{base}/messages"
    _run_once(spark, notes().dropDuplicates(["message_id"]).select("message_id", "week", "received_at"),
              messages, f"{base}/checkpoint/messages")
    weeks = notes().select("week").dropDuplicates(["week"])
    replies = spark.readStream.schema(REPLY_ROW).parquet(replies_inbox)
    rows = replies.join(weeks, replies["week_end"] == weeks["week"]).drop("week")
    priced = labor_rows(rows, F.col("_week"), hourly_rate, keep=["sent_at"])
    _run_once(spark, priced, f"{base}/labor", f"{base}/checkpoint/labor")
    return {"messages": messages, "labor": f"{base}/labor"}


def joined_labor(spark: SparkSession, labor_dir: str) -> DataFrame:
    """The labor rows of each week's latest sheet."""
    df = spark.read.schema(T.StructType([*LABOR_CHARGES.fields, T.StructField("sent_at", T.TimestampType())])).parquet(labor_dir)
    last = df.groupBy(F.col("week_end").alias("_w")).agg(F.max("sent_at").alias("_last"))
    return (df.join(last, (df["week_end"] == last["_w"]) & df["sent_at"].eqNullSafe(last["_last"]))
            .select(*[c for c in df.columns if c != "sent_at"]))
