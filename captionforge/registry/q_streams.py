"""File streams; a stream result equals the batch result, so the oracles are the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from captionforge.functions.rand import hash_uniform
from captionforge.operators import buckets as B
from captionforge.operators.schema import cast_column, remove_columns, rename_columns
from captionforge.plans import training_set
from captionforge.registry import query, sqltext as S, table
from captionforge.registry.inputs import CAPTIONED, bucketed, captioned
from captionforge.registry.q_sampling import BATCH, batches_sql
from captionforge.session import materialize, scratch_path
from captionforge.streaming import streams


def _run(spark, stream):
    out = scratch_path(spark, "stream")
    streams.run_available(stream, out, scratch_path(spark, "progress"))
    return spark.read.schema(stream.schema).parquet(out)


def _staged(spark, df, order, shards=4):
    path = scratch_path(spark, "staged")
    streams.stage_shards(df, order, shards, path)
    return streams.stream_files(spark, path, df.schema, files_per_trigger=2)


@query("stream_from_table", "SELECT event_id, event_type, value FROM events")
def stream_from_table(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return _run(spark, _staged(spark, events, ["event_id"]))


@query("stream_map", f"SELECT doc_id, {S.capitalize(S.strip_all('recaption'))} AS recaption FROM ({CAPTIONED})")
def stream_map(spark, sf_dir):
    rows = captioned(spark, sf_dir).select("doc_id", "recaption")
    return _run(spark, training_set.clean_captions(_staged(spark, rows, ["doc_id"]), ["recaption"]))


@query("stream_filter", "SELECT event_id, value FROM events WHERE event_type <> 'error' AND value > 5")
def stream_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    stream = streams.stream_filter(_staged(spark, events, ["event_id"]), (F.col("event_type") != "error") & (F.col("value") > 5))
    return _run(spark, stream.drop("event_type"))


@query("stream_columns", "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, value FROM events")
def stream_columns(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    stream = remove_columns(_staged(spark, events, ["event_id"]), ["event_type"])
    return _run(spark, cast_column(rename_columns(stream, {"event_id": "id"}), "user_id", "string"))


@query("stream_shuffle", f"SELECT event_id, round({S.uniform(9, 'event_id')}, 9) AS place FROM events")
def stream_shuffle(spark, sf_dir):
    out = scratch_path(spark, "stream")
    stream = _staged(spark, table(spark, sf_dir, "events").select("event_id"), ["event_id"])
    streams.shuffle_buffer(stream, ["event_id"], 9, out, scratch_path(spark, "progress"))
    return spark.read.parquet(out).select("event_id", F.round("place", 9).alias("place"))


@query("stream_shuffle_reservoir", f"""SELECT event_id, round({S.uniform(9, 'event_id')}, 9) AS place,
  CAST(floor({S.uniform(9, 'event_id', S.quote('stay'))} * 3) AS BIGINT) AS stays FROM events""")
def stream_shuffle_reservoir(spark, sf_dir):
    """A row may leave the shuffle up to two micro-batches after it came."""
    out = scratch_path(spark, "stream")
    events = table(spark, sf_dir, "events").select("event_id")
    path = scratch_path(spark, "staged")
    streams.stage_shards(events, ["event_id"], 6, path)
    stream = streams.stream_files(spark, path, events.schema, files_per_trigger=1)
    streams.shuffle_reservoir(stream, ["event_id"], 9, 3, out, scratch_path(spark, "progress"))
    last = streams.last_epoch(spark, out)
    streams.drain(spark, events.schema, out, last, ["event_id"])
    rows = spark.read.parquet(f"{out}/rows")
    # the last ones are drained before their time
    stays = F.floor(hash_uniform(9, F.col("event_id"), F.lit("stay")) * 3)
    due = F.least(F.col("came") + stays, F.lit(last + 1))
    return rows.where(F.col("epoch") == due).select("event_id", F.round("place", 9).alias("place"), stays.cast("long").alias("stays"))


@query("stream_incremental", "SELECT event_id, event_type FROM events UNION ALL SELECT doc_id, lang FROM documents")
def stream_incremental(spark, sf_dir):
    """A run, a second run with nothing new, and a run after new files arrived."""
    path, out, progress = (scratch_path(spark, n) for n in ("incoming", "stream", "progress"))
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    late = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("lang").alias("event_type"))
    events.write.parquet(path)
    run = lambda: streams.run_available(streams.stream_files(spark, path, events.schema), out, progress)
    run()
    run()
    late.write.mode("append").parquet(path)
    run()
    return spark.read.parquet(out)


@query("stream_batches", batches_sql(47))
def stream_batches(spark, sf_dir):
    """All batches of an epoch, requested as a stream of small batch-id ranges."""
    rows = bucketed(spark, sf_dir)
    counts = rows.groupBy("bucket_size").agg(F.count(F.lit(1)).alias("n"))
    stats = materialize(B.kept_buckets(counts, BATCH), "buckets")
    n_batches = B.bucket_epoch_len(stats, BATCH).first()["n_batches"]
    draws = materialize(B.draw_buckets(stats, n_batches, 47), "draws")
    index = materialize(B.bucket_index(rows.join(stats.select("bucket_size"), "bucket_size", "left_semi")), "index")
    starts = spark.range(0, n_batches, 64).select(
        F.col("id").alias("first_batch"), F.least(F.col("id") + 63, F.lit(n_batches - 1)).alias("last_batch"))
    requests = _staged(spark, starts, ["first_batch"], shards=2)
    return _run(spark, streams.planned_batches(requests, draws, stats, index, BATCH, 47))
