"""The incremental behaviours as Structured Streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sitefit.operators.compliance import revalidate
from sitefit.plans.edits import edited_items, folded
from sitefit.session import scratch_folder, stored


def event_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the input folder as a file stream."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream: DataFrame, sink, mode: str = "append") -> None:
    """Run a stream over everything available now; its state and progress live in the shared folder."""
    where = f"{scratch_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


#: Columns of an edit that the state needs, and what the edits of an item add up to.
EDIT = "micros long, seq long, op string, dxc long, dyc long, new_type string, new_species string, lawn boolean"
STATE = "dxc long, dyc long, last_type string, last_species string, life string, touched boolean, edits long"
NOTHING_YET = (0, 0, None, None, None, False, 0)
#: The state store that keeps keyed state on disk and in the query's checkpoint.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def applied(state: tuple, edit: tuple) -> tuple:
    """The state after one edit: nothing happens to a deleted item except a restore, and a point never becomes a lawn or a lawn a point."""
    dxc, dyc, last_type, last_species, life, touched, edits = state
    _, _, op, mx, my, new_type, new_species, lawn = edit
    present = life != "delete"
    if not ((op == "restore" and not present) or (op != "restore" and present and (op != "retype" or lawn == (new_type == "lawn")))):
        return state
    if op == "move":
        dxc, dyc = dxc + mx, dyc + my
    elif op == "retype":
        last_type = new_type
    elif op == "patch":
        last_species = new_species
    else:
        life = op
    return dxc, dyc, last_type, last_species, life, touched or op in ("move", "retype", "patch"), edits + 1


class ItemState(StatefulProcessor):
    """An item's edits, folded in the order of (ts, seq) although they arrive in any order within the watermark's delay.

    ``settled`` holds what lies behind the watermark, ``waiting`` the edits after it. Every micro-batch that brings edits gives
    the item's state with the waiting ones on top; edits that the watermark passes move from one to the other, when the item gets
    an edit or its timer runs out, so ``waiting`` holds no more than the edits of one delay.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", STATE)
        self.waiting = handle.getListState("waiting", EDIT)

    def settle(self, fresh: list[tuple], watermark: int) -> tuple:
        late = sorted([*(tuple(x) for x in self.waiting.get()), *fresh], key=lambda e: (e[0], e[1]))
        done = [e for e in late if e[0] <= watermark * 1000]
        left = late[len(done):]
        state = tuple(self.settled.get()) if self.settled.exists() else NOTHING_YET
        for edit in done:
            state = applied(state, edit)
        if done:
            self.settled.update(state)
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        for edit in left:
            state = applied(state, edit)
        return state

    def handleInputRows(self, key, rows, timerValues):
        fresh = [(r.micros, r.seq, r.op, r.dxc, r.dyc, r.new_type, r.new_species, r.lawn) for r in rows]
        yield Row(item_id=key[0], **dict(zip(_STATE_NAMES, self.settle(fresh, timerValues.getCurrentWatermarkInMs()), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.settle([], timerValues.getCurrentWatermarkInMs())  # what it gives has been given already
        return iter(())

    def close(self) -> None:
        pass


_STATE_NAMES = [part.split()[0] for part in STATE.split(", ")]


def item_states(edits: DataFrame, items: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of item states (item_id, dxc .. edits) from a stream of edits; edits of unknown items have no effect.

    Edits that come later than ``delay`` behind the newest one seen are dropped.
    """
    spark = edits.sparkSession
    spark.conf.set(*STORE)
    c = F.col
    known = items.select("item_id", (c("planting_type") == "lawn").alias("lawn"))
    rows = edits.join(known, "item_id").select("item_id", c("ts").cast("timestamp").alias("ts"), F.unix_micros(c("ts").cast("timestamp")).alias("micros"), c("seq").cast("long").alias("seq"), "op", c("dxc").cast("long").alias("dxc"), c("dyc").cast("long").alias("dyc"), "new_type", "new_species", "lawn")
    return rows.withWatermark("ts", delay).groupBy("item_id").transformWithState(ItemState(), f"item_id long, {STATE}", "Update", "eventTime")


def keep_states(states: DataFrame, path: str) -> None:
    """Every micro-batch's changed states as a table; a batch written twice after a failure overwrites itself."""
    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    drain(states, sink, "update")


def latest(states: DataFrame) -> DataFrame:
    """The last state of every item in a table that ``keep_states`` wrote."""
    rows = states.groupBy("item_id").agg(F.max_by(F.struct(*_STATE_NAMES), "batch").alias("s"))
    return rows.select("item_id", "s.*")


def plan_state(spark: SparkSession, path: str, items: DataFrame) -> DataFrame:
    """Current items from the states kept so far."""
    return folded(items, latest(spark.read.parquet(path)))


def keep_verdicts(states: DataFrame, items: DataFrame, edges: DataFrame, path: str) -> None:
    """Re-checks the plan as edited so far around every micro-batch's items; writes states and verdicts batch by batch.

    A micro-batch is judged on the plan after it: its items with their new places and kinds, the trees near them, and the trees
    near where they stood before.
    """
    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/states/batch={number}")
        changed = spark.read.parquet(f"{path}/states/batch={number}")
        known = spark.read.schema(f"item_id long, {STATE}, batch int").parquet(f"{path}/states")
        touched = items.join(changed.select("item_id"), "item_id", "left_semi")
        now = stored(edited_items(items, latest(known.filter(F.col("batch") <= number))))
        was = edited_items(touched, latest(known.filter(F.col("batch") < number)))
        verdicts = revalidate(now, touched, edges, was=was)
        gone = touched.join(now, "item_id", "left_anti").select("site_id", "item_id", F.lit(None).cast("long").alias("setback_violations"), F.lit(None).cast("long").alias("spacing_violations"))
        verdicts.unionByName(gone).write.mode("overwrite").parquet(f"{path}/verdicts/batch={number}")

    drain(states, sink, "update")


def open_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The last verdict of every item that was ever re-checked and is still in the plan."""
    rows = spark.read.parquet(f"{path}/verdicts")
    last = rows.groupBy("site_id", "item_id").agg(F.max_by(F.struct("setback_violations", "spacing_violations"), "batch").alias("v"))
    return last.select("site_id", "item_id", "v.*").filter("setback_violations IS NOT NULL")


def progress(events: DataFrame, path: str) -> None:
    """Running counts per (plan, type); the latest complete state replaces the previous one."""
    counts = events.groupBy("plan_key", "event_type").count()

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state")

    drain(counts, sink, "complete")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
