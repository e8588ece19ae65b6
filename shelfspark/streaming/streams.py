"""Structured Streaming forms of ingestion, deduplication, windows and price changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfspark.operators.quality import clean_listings, validate, with_listing_hash
from shelfspark.operators.history import price_changes, split_null_keys
from shelfspark.operators.skew import first_per_key, join_group_table
from shelfspark.schemas import LISTING
from shelfspark.session import checkpointed, scratch_path
from shelfspark.sources.buckets import BUCKETS, KeyedState
from shelfspark.sources.store import KEYS, folders, publish, read_version, remove, upsert, vacuum, versions

EVENT_TIME = "event_time"
DEFAULT_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_listings(
    spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = LISTING, **options: str
) -> DataFrame:
    """Listing files as they land in a folder."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def with_event_time(df: DataFrame, ts: str) -> DataFrame:
    """Event time as zoned timestamp; watermarks refuse zoneless ones. The session zone is UTC."""
    return df.withColumn(EVENT_TIME, F.col(ts).cast("timestamp"))


def stream_dedup(df: DataFrame, delay: str, ts: str = "scraped_at") -> DataFrame:
    """First sighting of every hash; repeats within the delay are dropped."""
    return with_event_time(df, ts).withWatermark(EVENT_TIME, delay).dropDuplicatesWithinWatermark(["data_hash"])


def stream_daily_counts(df: DataFrame, delay: str, ts: str = "scraped_at") -> DataFrame:
    """Rows per day."""
    windowed = with_event_time(df, ts).withWatermark(EVENT_TIME, delay).groupBy(F.window(EVENT_TIME, "1 day"))
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "n")


def stream_weekly_mean(df: DataFrame, delay: str, ts: str = "scraped_at") -> DataFrame:
    """Mean price per week ending on Sunday. Windows start four days after the epoch's Thursday, on Monday."""
    week = F.window(EVENT_TIME, "7 days", "7 days", "4 days")
    windowed = with_event_time(df, ts).withWatermark(EVENT_TIME, delay).groupBy(week)
    return windowed.agg(F.avg("price").alias("mean_price")).select(
        F.date_add(F.to_date("window.start"), 6).alias("week"), "mean_price"
    )


# --- price changes ----------------------------------------------------------------------------------

CHANGE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("previous_price", T.DoubleType()),
        T.StructField("recorded_at", T.TimestampNTZType()),
        T.StructField("late", T.BooleanType()),
    ]
)


#: Packed rows of a bucket of products: waiting ticks, and last ticks.
_LAST_TICK = pa.schema([("source", pa.string()), ("product_id", pa.string()), ("price", pa.float64()), ("recorded_at", pa.timestamp("us"))])
_TICK = _LAST_TICK.append(pa.field("id", pa.int64()))
#: Buckets of products in keyed state; fixed as long as a checkpoint lives.
STATE_BUCKETS = 64
#: Bytes of pieces that are put into the state at once.
PIECE_BYTES = 16 << 20


class PriceChanges(StatefulProcessor):
    """Keeps the last price and time per product; reports changes, and late ticks marked as such."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double, recorded_at timestamp_ntz, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(rows)).sort_values(["recorded_at", "id"])
        price, seen, seen_id = self.last.get() if self.last.exists() else (None, None, None)
        if seen is not None:
            # An exact tie with the stored tick is decided by id, as in the batch order.
            late = (ticks["recorded_at"] < seen) | ((ticks["recorded_at"] == seen) & (ticks["id"] <= seen_id))
        else:
            late = pd.Series(False, index=ticks.index)
        fresh = ticks[~late]
        before = fresh["price"].shift(1)
        if len(fresh):
            before.iloc[0] = price if price is not None else float("nan")
            end = fresh.iloc[-1]
            self.last.update((float(end["price"]), end["recorded_at"].to_pydatetime(), int(end["id"])))
        changed = fresh.assign(previous_price=before, late=False)
        changed = changed[changed["previous_price"].isna() | (changed["price"] != changed["previous_price"])]
        dropped = ticks[late].assign(previous_price=float("nan"), late=True)
        yield pd.concat([changed, dropped])[[f.name for f in CHANGE.fields]]

    def close(self) -> None:
        pass


class OrderedPriceChanges(StatefulProcessor):
    """Holds ticks back until the watermark has passed them, then compares them in order of time and id.

    A key is a bucket of products, so the calls to the state store, which are slow, grow with the buckets and batches, not with the
    products. State of a bucket: its waiting ticks in pieces by stretches of ``step`` milliseconds, and the last released tick of
    each of its products; both as packed tables. A tick older than the watermark comes too late and is told so. A timer stands at
    the end of the first stretch with waiting ticks. A product without a tick for ``keep`` milliseconds is forgotten.
    """

    def __init__(self, step: int, keep: int | None):
        self.step, self.keep = max(step, 1), keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "stretch long, rows binary")
        self.last = handle.getValueState("last", "rows binary")

    def _wake_after(self, moment: int) -> None:
        self.handle.registerTimer((moment // self.step + 1) * self.step)

    def _pieces(self, ticks: pd.DataFrame) -> list[tuple]:
        stretches = ticks.groupby(_millis(ticks["recorded_at"]) // self.step)
        return [(int(stretch), _pack(part[_TICK.names], _TICK)) for stretch, part in stretches]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        passed = timer_values.getCurrentWatermarkInMs()
        pieces, first = [], None
        for ticks in rows:
            late = ticks["recorded_at"].isna()
            if passed:
                late |= ticks["recorded_at"] < pd.Timestamp(passed, unit="ms")
            if not late.all():
                pieces += self._pieces(ticks[~late])
                stretch = min(piece[0] for piece in pieces)
                first = stretch if first is None else min(first, stretch)
                if sum(len(piece[1]) for piece in pieces) > PIECE_BYTES:
                    self.waiting.appendList(pieces)
                    pieces = []
            if late.any():
                yield ticks[late].assign(previous_price=float("nan"), late=True)[[f.name for f in CHANGE.fields]]
        if pieces:
            self.waiting.appendList(pieces)
        if first is not None:
            self._wake_after(first * self.step)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        passed = timerValues.getCurrentWatermarkInMs()
        held, rest = {}, []
        for stretch, rows in self.waiting.get():
            if stretch * self.step < passed:
                held.setdefault(stretch, []).append(rows)
            else:
                rest.append((stretch, rows))
        if not held and self.keep is None:
            return
        packed = self.last.get()
        last = _unpack(packed[0]) if packed else None
        # One stretch is unpacked after the other.
        for stretch in sorted(held):
            ticks = pd.concat([_unpack(rows) for rows in held.pop(stretch)], ignore_index=True)
            free = ticks["recorded_at"] < pd.Timestamp(passed, unit="ms")
            if not free.all():
                rest += self._pieces(ticks[~free])
            if free.any():
                changed, last = self._compare(ticks[free], last)
                yield changed
        if rest:
            self.waiting.put(rest)
            self._wake_after(min(stretch for stretch, _ in rest) * self.step)
        else:
            self.waiting.clear()
        if last is not None and self.keep is not None:
            forgotten = _millis(last["recorded_at"]) + self.keep
            last = last[forgotten >= passed]
            if len(last):
                self._wake_after(int(forgotten[forgotten >= passed].min()))
        if last is not None and len(last):
            self.last.update((_pack(last, _LAST_TICK),))
        else:
            self.last.clear()

    def _compare(self, ticks: pd.DataFrame, last: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The changes among the ticks, and the last ticks after them."""
        keys = list(KEYS)
        rows = ticks.sort_values([*keys, "recorded_at", "id"])
        if last is not None:
            rows = pd.concat([last.assign(id=0, known=True), rows.assign(known=False)], ignore_index=True).sort_values(keys, kind="stable")
        else:
            rows = rows.assign(known=False)
        of_product = rows.groupby(keys, sort=False)
        before = of_product["price"].shift(1)
        if self.keep is not None:
            before[(rows["recorded_at"] - of_product["recorded_at"].shift(1)) > pd.Timedelta(self.keep, "ms")] = float("nan")
        changed = rows.assign(previous_price=before, late=False)[~rows["known"] & (before.isna() | (rows["price"] != before))]
        return changed[[f.name for f in CHANGE.fields]], rows.drop_duplicates(keys, keep="last")[_LAST_TICK.names]

    def close(self) -> None:
        pass


def _pack(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_pandas()


def _millis(moments: pd.Series) -> pd.Series:
    return (moments - pd.Timestamp(0)) // pd.Timedelta(1, "ms")


def _interval_millis(spark: SparkSession, interval: str) -> int:
    length = F.expr(f"CAST(INTERVAL {interval} AS INTERVAL DAY TO SECOND)")
    return spark.range(1).select(length.alias("i")).first().i // timedelta(milliseconds=1)


def _ticks_only(ticks: DataFrame) -> DataFrame:
    rows, _ = split_null_keys(ticks.where(F.col("price").isNotNull()), KEYS)
    return rows.select(*KEYS, "id", F.col("price").cast("double").alias("price"), "recorded_at")


def keyed_price_changes(ticks: DataFrame) -> DataFrame:
    """First sightings and price changes as ticks arrive; ticks older than the last one are marked late.

    Keyed state, one row per product, in the RocksDB state store. A product's ticks of one micro-batch meet in one
    task, so the source must bound its micro-batches (maxBytesPerTrigger, maxFilesPerTrigger). For micro-batches of
    any size there is :func:`price_change_batches`.
    """
    changes = _ticks_only(ticks).groupBy(*KEYS).transformWithStateInPandas(
        PriceChanges(), outputStructType=CHANGE, outputMode="append", timeMode="none"
    )
    previous = F.when(~F.isnan("previous_price"), F.col("previous_price"))
    return changes.withColumn("previous_price", previous)


def stream_price_changes(ticks: DataFrame, delay: str, keep: str | None = None, buckets: int = STATE_BUCKETS) -> DataFrame:
    """First sightings and price changes in order of time, whatever order ticks arrive in within ``delay``.

    Ticks wait until the watermark, the newest time seen less ``delay``, has passed them; ticks older than it, or without a
    time, are marked late and change nothing. So the changes equal those of the batch form over all ticks that are not late.
    With ``keep`` (``"90 days"``), a tick that comes longer than that after the one before is a first sighting again, and the
    state of products without newer ticks is given up.

    Keyed state in the RocksDB store, by ``buckets`` of products: the packed ticks of a bucket within the delay (some 40 bytes
    each), those of an eighth of it unpacked, and the last ticks of its products must fit a task. For more there is :func:`price_change_batches`. A checkpoint keeps its number of buckets.
    """
    step = _interval_millis(ticks.sparkSession, delay) // 8
    kept = None if keep is None else _interval_millis(ticks.sparkSession, keep)
    # The column with the watermark stays out of the state's input: Spark would drop late rows there unseen.
    rows = _ticks_only(with_event_time(ticks, "recorded_at").withWatermark(EVENT_TIME, delay))
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")
    changes = rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        OrderedPriceChanges(step, kept), outputStructType=CHANGE, outputMode="append", timeMode="eventTime"
    )
    previous = F.when(~F.isnan("previous_price"), F.col("previous_price"))
    return changes.withColumn("previous_price", previous)


LAST = T.StructType([CHANGE[c] for c in (*KEYS, "id", "price", "recorded_at")])
_PENDING = T.StructType([*LAST.fields, T.StructField("slice", T.LongType()), T.StructField("batch", T.LongType())])


def _slice(width: int) -> Column:
    """Number of the stretch of ``width`` microseconds a tick lies in."""
    return F.expr(f"unix_micros(CAST(recorded_at AS TIMESTAMP)) - pmod(unix_micros(CAST(recorded_at AS TIMESTAMP)), {width}L)")


def price_change_batches(
    root: str, delay: str | None = None, buckets: int = BUCKETS, tidy_every: int = 10
) -> Callable[[DataFrame, int], None]:
    """Batch function with the same results, for micro-batches of any size and with hot products.

    Below ``root``: ``changes/batch=N``, and ``last``, the last tick of every product as :class:`KeyedState`, of which a batch
    reads and writes only what its products touch. With ``delay``, ticks wait in ``pending/batch=N/slice=S`` until
    the watermark has passed their slice, an eighth of the delay; waiting ticks are written once and read once.
    ``progress/v=N`` tells the newest time seen. Everything a batch writes is replaced when it is repeated. Every
    ``tidy_every`` batches, runs and slices that no repetition can need are removed.

    Without ``delay``, ticks not newer than the last one of their product are late; with it, those behind the watermark,
    and those without a time.
    """

    def state(spark: SparkSession) -> KeyedState:
        return KeyedState(spark, f"{root}/last", LAST, KEYS, ("recorded_at", "id"), buckets)

    def against_last(ticks: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Ticks newer than the last one of their product, the others, and the last ones themselves."""
        known = ticks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).join(last, list(KEYS), "left")
        known = checkpointed(known.select(*KEYS, "_n", F.col("id").alias("_id"), F.col("recorded_at").alias("_at"), F.col("price").alias("_price")))
        is_late = F.coalesce(F.struct(F.col("recorded_at"), F.col("id")) <= F.when(F.col("_at").isNotNull(), F.struct("_at", "_id")), F.lit(False))
        marked = checkpointed(join_group_table(ticks, known, KEYS, "_n").select(*ticks.columns, is_late.alias("_late")))
        seeds = known.where(F.col("_at").isNotNull()).select(
            *KEYS, F.col("_id").alias("id"), F.col("_price").alias("price"), F.col("_at").alias("recorded_at")
        )
        return marked.where("NOT _late").drop("_late"), marked.where("_late").drop("_late"), seeds

    def released(ticks: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """Ticks that the watermark passes with this batch, and the late ones of the batch."""
        spark = ticks.sparkSession
        width = max(_interval_millis(spark, delay) * 1000 // 8, 1)
        progress = read_version(spark, f"{root}/progress", before=batch_id)
        before = progress.first().seen if progress is not None else None
        newest = ticks.agg(F.max(F.expr("unix_micros(CAST(recorded_at AS TIMESTAMP))"))).first()[0]
        seen = max((m for m in (before, newest) if m is not None), default=None)
        edge = lambda m: None if m is None else (m - 8 * width) // width * width
        passed, passing = edge(before), edge(seen)
        late = F.col("recorded_at").isNull() | (F.lit(False) if passed is None else _slice(width) < passed)
        waiting = ticks.where(~late).withColumn("slice", _slice(width))
        waiting.write.mode("overwrite").partitionBy("slice").parquet(f"{root}/pending/batch={batch_id:09d}")
        publish(spark.createDataFrame([(seen,)], "seen long"), f"{root}/progress", batch_id)
        held = spark.read.schema(_PENDING).option("basePath", f"{root}/pending").parquet(f"{root}/pending").where(F.col("batch") <= batch_id)
        lower = F.lit(True) if passed is None else F.col("slice") >= passed
        upper = F.lit(False) if passing is None else F.col("slice") < passing
        return held.where(lower & upper).select(*LAST.names), ticks.where(late)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ticks, last = _ticks_only(batch), state(spark)
        late = seeds = ticks.where(F.lit(False))
        if delay is not None:
            # What the watermark passes is newer than all that was released before.
            free, late = released(checkpointed(ticks), batch_id)
            fresh = checkpointed(free)
        else:
            fresh = ticks
        if last.manifest(batch_id):
            if delay is None:
                ticks = checkpointed(ticks)
                fresh, late, seeds = against_last(ticks, last.read(batch_id, last.touched(ticks)))
            else:
                named = fresh.select(*KEYS).distinct()
                seeds = last.read(batch_id, last.touched(fresh)).join(named, list(KEYS), "left_semi").select(*LAST.names)
        rows = fresh.withColumn("_seed", F.lit(False)).unionByName(seeds.withColumn("_seed", F.lit(True)))
        changes = price_changes(rows, KEYS).where(~F.col("_seed")).drop("_seed").withColumn("late", F.lit(False))
        dropped = late.withColumns({"previous_price": F.lit(None).cast("double"), "late": F.lit(True)})
        names = [f.name for f in CHANGE.fields]
        changes.select(*names).unionByName(dropped.select(*names)).write.mode("overwrite").parquet(
            f"{root}/changes/batch={batch_id:09d}"
        )
        last.add(first_per_key(fresh, list(KEYS), ("recorded_at", "id"), last=True), batch_id)
        if (batch_id + 1) % tidy_every == 0:
            last.vacuum()
            tidy(spark, batch_id)

    def tidy(spark: SparkSession, batch_id: int) -> None:
        """Remove the slices that batches before this one released; this one may have to be repeated."""
        progress = read_version(spark, f"{root}/progress", before=batch_id) if delay is not None else None
        seen = progress.first().seen if progress is not None else None
        if seen is None:
            return
        width = max(_interval_millis(spark, delay) * 1000 // 8, 1)
        passed = (seen - 8 * width) // width * width
        for batch in folders(spark, f"{root}/pending"):
            for name in folders(spark, f"{root}/pending/{batch}"):
                if name.startswith("slice=") and int(name[6:]) < passed:
                    remove(spark, f"{root}/pending/{batch}/{name}")
        vacuum(spark, f"{root}/progress", 2)

    return run


def run_price_changes(ticks: DataFrame, name: str, delay: str | None = None) -> DataFrame:
    """Run price changes over everything available now and read them."""
    root = scratch_path(ticks.sparkSession, name)
    _run_batches(ticks, root, price_change_batches(root, delay))
    return ticks.sparkSession.read.schema(CHANGE).parquet(f"{root}/changes").drop("batch")


# --- ingestion --------------------------------------------------------------------------------------


def ingest(root: str, compact_every: int = 10, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """Batch function: clean, validate, append to the log, and now and then fold the log into the product table.

    Below ``root``: ``checked/batch=N/outcome=accepted`` and ``=rejected`` rows, and ``products/v=N``, the table.
    Repeating a batch replaces its own folders, so a retry adds nothing twice. A batch costs its own size;
    the table is rewritten only every ``compact_every`` batches, and its newest ``keep`` versions stay, besides those
    that are being read.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = with_listing_hash(validate(clean_listings(batch)))
        keyed = F.col("source").isNotNull() & F.col("product_id").isNotNull()
        reason = F.when(~keyed, "null key").otherwise(F.array_join("validation_errors", "; "))
        outcome = F.when(keyed & F.col("is_valid"), "accepted").otherwise("rejected")
        # Written once, split by folder: the cleaning does not run a second time.
        checked.withColumns({"reason": reason, "outcome": outcome}).write.mode("overwrite").partitionBy(
            "outcome"
        ).parquet(f"{root}/checked/batch={batch_id:09d}")
        if (batch_id + 1) % compact_every == 0:
            compact(spark, root, batch_id)
            vacuum(spark, f"{root}/products", max(keep, 2))

    return run


def checked_rows(
    spark: SparkSession, root: str, outcome: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Accepted or rejected rows of the log, all batches or those from first to last."""
    rows = spark.read.parquet(f"{root}/checked").where(F.col("outcome") == outcome)
    if first is not None:
        rows = rows.where(F.col("batch").between(first, last))
    return rows.drop("outcome", "batch")


def compact(spark: SparkSession, root: str, batch_id: int) -> None:
    """Fold the log since the previous table version into a new version."""
    table = f"{root}/products"
    earlier = [v for v in versions(spark, table) if v < batch_id]
    first = earlier[-1] + 1 if earlier else 0
    rows = checked_rows(spark, root, "accepted", first, batch_id).drop("reason")
    current = read_version(spark, table, before=batch_id)
    base = rows.where(F.lit(False)) if current is None else current
    merged, _ = upsert(base, rows, ("scraped_at", "data_hash", "price"))
    publish(merged, table, batch_id)


# --- running to completion --------------------------------------------------------------------------


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now and read what it wrote.

    Append goes to a Parquet file sink. Complete results replace each other, one folder per micro-batch, of
    which the last one counts.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{root}/out").outputMode("append").start().awaitTermination()
        return spark.read.parquet(f"{root}/out")

    def replace(batch: DataFrame, batch_id: int) -> None:
        publish(batch, f"{root}/out", batch_id)

    writer.foreachBatch(replace).outputMode(mode).start().awaitTermination()
    return read_version(spark, f"{root}/out")


def _run_batches(stream: DataFrame, root: str, run: Callable[[DataFrame, int], None]) -> None:
    """A run that was ended goes on where its checkpoint stands; the batch it was in is done again."""
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(run).start().awaitTermination()


def run_ingest(stream: DataFrame, name: str, compact_every: int = 10) -> str:
    """Run ingestion over everything available now and fold what is left; returns the root folder."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    _run_batches(stream, root, ingest(root, compact_every))
    logged = spark.read.parquet(f"{root}/checked").agg(F.max("batch")).first()[0]
    if logged is not None and logged not in versions(spark, f"{root}/products"):
        compact(spark, root, int(logged))
    return root


def use_rocksdb(spark: SparkSession) -> None:
    """State store required by keyed state; set only where the session names none of its own."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, DEFAULT_STATE_STORE) == DEFAULT_STATE_STORE:
        spark.conf.set(name, STATE_STORE)
