"""Encoding, first-fit packing and interval sampling on streams."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from tessera.config import metric_sinks
from tessera.functions.template import CODE_POINTS, Additive
from tessera.operators import transcripts
from tessera.operators.encode import EncodeConfig, encode, kept
from tessera.operators.events import stepped_metrics
from tessera.operators.packing import Packer, Placement
from tessera.sources.corpora import log_table

LOG = logging.getLogger(__name__)


def encode_stream(conversations: DataFrame, cfg: EncodeConfig) -> DataFrame:
    """Encoding is row by row, so a stream takes the same plan as a table."""
    return kept(encode(conversations, cfg))


#: The state store that states of several columns and timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACED = "shard int, example_id long, window_id long, segment int, offset int, length int"


class PackProcessor(StatefulProcessor):
    """The pool of a shard: a list of members of its open windows, and the number of windows that left.

    Named columns, so that a later version can read a state that an earlier one wrote.
    """

    def __init__(self, max_length: int, open_windows: int, idle_ms: int | None):
        self.max_length, self.open_windows, self.idle_ms = max_length, open_windows, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getListState("members", "slot int, example_id long, length int")
        self.windows = handle.getValueState("windows", "emitted long")

    def _pool(self) -> Packer:
        packer = Packer(self.max_length, self.open_windows)
        packer.emitted = self.windows.get()[0] if self.windows.exists() else 0
        for slot, members in groupby(self.members.get() if self.members.exists() else [], key=lambda m: m[0]):
            packer.held.append([(example, size) for _, example, size in members])
            packer.room.append(self.max_length - sum(size for _, size in packer.held[slot]))
        return packer

    def _keep(self, packer: Packer) -> None:
        self.windows.update((packer.emitted,))
        members = [(slot, example, size) for slot, held in enumerate(packer.held) for example, size in held]
        self.members.put(members) if members else self.members.clear()

    def _rows(self, shard: int, placed: list[Placement], sizes: dict[int, int]) -> pd.DataFrame:
        return pd.DataFrame([(shard, example, window, segment, offset, sizes[example]) for example, window, segment, offset in placed], columns=[c.split()[0] for c in PLACED.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        packer = self._pool()
        sizes = {example: size for held in packer.held for example, size in held}
        placed: list[Placement] = []
        batch = pd.concat(list(rows))
        batch = batch.sort_values(["order_key", "example_id"], na_position="last")
        for example, size in zip(batch["example_id"], batch["length"], strict=True):
            if pd.isna(size):
                placed += packer.flush()
                continue
            sizes[int(example)] = int(size)
            placed += packer.add(int(example), int(size))
        self._keep(packer)
        if self.idle_ms is not None:
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._rows(key[0], placed, sizes)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        packer = self._pool()
        sizes = {example: size for held in packer.held for example, size in held}
        placed = packer.flush()
        self._keep(packer)
        yield self._rows(key[0], placed, sizes)

    def close(self) -> None:
        pass


def pack_stream(lengths: DataFrame, max_length: int, *, open_windows: int = 8, idle_ms: int | None = 60_000) -> DataFrame:
    """(shard, example_id, window_id, segment, offset, length) of windows as they leave the pool.

    ``lengths`` has shard, example_id, order_key and length. Each shard keeps its
    own pool, at most ``open_windows`` windows of ids and lengths. A row without
    a length ends its shard: the pool is flushed, as at the end of a table. A
    stream that has no end flushes a pool that got no row for ``idle_ms``; that
    is where it can differ from a table. Timers keep a query running, so one
    that is to end by itself (``availableNow``) takes ``idle_ms=None`` and leaves
    open windows in its state for the next run.
    """
    lengths.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    processor = PackProcessor(max_length, open_windows, idle_ms)
    mode = "None" if idle_ms is None else "ProcessingTime"
    return lengths.groupBy("shard").transformWithStateInPandas(processor, PLACED, "Append", mode)


class BatchFolders:
    """A sink for foreachBatch, once a batch: each has a folder of its own, which a replay writes anew, so it adds no row."""

    def __init__(self, path: str, form: str = "parquet"):
        self.path, self.form = path.rstrip("/"), form

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(self.form).save(f"{self.path}/batch-{batch_id:012d}")

    def read(self, spark: SparkSession, schema: str | StructType) -> DataFrame:
        """All batches; a folder that a lost writer left without its mark of success is written again by the replay."""
        return spark.read.schema(schema).format(self.form).option("recursiveFileLookup", "true").load(self.path)


class IntervalSampler:
    """Runs ``action`` on batches that hold a sampling step. Any error disables it for good; the stream goes on."""

    def __init__(self, every: int, action: Callable[[DataFrame, int], Any]):
        self.every, self.action, self.enabled = every, action, True

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if not self.enabled:
            return
        step = F.col("step")
        due = batch.where((step > 0) & (step % self.every == 0)) if self.every > 0 else batch.limit(0)
        try:
            if not due.isEmpty():
                self.action(due, batch_id)
        except Exception:
            self.enabled = False
            LOG.exception("sampling failed and is off from now on")


def transcript_action(
    settings: dict[str, Any], build_sampler: Callable[[], Any], log: Callable[[DataFrame], None] | None = None, template: Additive = CODE_POINTS
) -> Callable[[DataFrame, int], None]:
    """What an ``IntervalSampler`` does at a sampling step by ``config.transcript_settings``.

    All prompts are asked at each due step; records are appended to the
    recipe's file, once a batch, and their table log goes to ``log`` if the recipe wants it.
    The sampler is built when it is first needed.
    """
    built: list[Any] = []

    def act(due: DataFrame, batch_id: int) -> None:
        if not built:
            built.append(build_sampler())
        rows = transcripts.asked(due, settings["prompts"], settings["system_prompt"], template)
        said = transcripts.sample(rows, built[0], max_new_tokens=settings["max_new_tokens"], start=settings["reasoning_start"], end=settings["reasoning_end"]).persist()
        try:
            transcripts.append_jsonl(said, settings["output_path"], batch_id)
            if log is not None and settings["log_to_wandb"]:
                log(log_table(said, transcripts.LOGGED))
            LOG.info("%d transcripts, of which %d stopped by themselves with their reasoning open", said.count(), transcripts.unclosed(said).count())
        finally:
            said.unpersist()

    return act


def sample_stream(steps: DataFrame, sampler: IntervalSampler, checkpoint: str) -> StreamingQuery:
    return steps.writeStream.foreachBatch(sampler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sinks(config: dict[str, Any], factories: dict[str, Callable[[dict[str, Any]], Callable[[DataFrame], None]]]) -> list[Callable[[DataFrame], None]]:
    """The sinks that a recipe asks for, opened by the factory of their kind; a tracked run gets stepped metrics only."""
    opened = [(kind, factories[kind](options)) for kind, options in metric_sinks(config)]
    stepped = lambda sink: lambda batch: sink(stepped_metrics(batch))
    return [stepped(sink) if kind == "wandb" else sink for kind, sink in opened]


def fan_out(batch: DataFrame, sinks: list[Callable[..., None]], batch_id: int | None = None) -> None:
    """Hands one batch to several metric sinks, read once; sinks by batch get its number too."""
    held = batch.persist()
    try:
        for sink in sinks:
            sink(held, batch_id) if isinstance(sink, BatchFolders) else sink(held)
    finally:
        held.unpersist()
