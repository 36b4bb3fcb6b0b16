"""Structured Streaming: run events, confirmations with expiry, and windowed activity (the last an extension)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Fixed value: seconds that a run waits for its confirmation.
CONFIRMATION_TTL = 86_400


def read_events(spark: SparkSession, folder: str, glob: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet event files in a folder, with the schema that they have."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    stream = spark.readStream.schema(reader.parquet(folder).schema).option("maxFilesPerTrigger", files_per_trigger)
    return (stream.option("pathGlobFilter", glob) if glob else stream).parquet(folder)


def step_frames(events: DataFrame) -> DataFrame:
    """Server-sent frames: one `data: {...}` string for each event."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct(*events.columns)), F.lit("\n\n")).alias("frame"))


def parse_frames(text: DataFrame) -> DataFrame:
    """(pos, body), with the other columns of `text`, of the frames in its `buffer` that have come to their end."""
    parts = F.split("buffer", "\n\n", -1)
    frames = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.startswith(x, F.lit("data: ")))  # behind the last end is an unfinished one
    return text.select(*[c for c in text.columns if c != "buffer"], F.posexplode(frames).alias("pos", "frame")).withColumn("body", F.substr("frame", F.lit(7))).drop("frame")


#: The state store that streams with several states a key need; set it as spark.sql.streaming.stateStore.providerClass.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FRAMES = "pos int, body string, n_steps long, last_tag string, done boolean"


#: Numbers of the chunks that wait together as one value of the state.
_WAITING = 64


class _Frames(StatefulProcessor):
    """A run's unfinished frame, its open step, and the chunks that came before their turn, which are kept by stretches of their numbers.

    Each call of the state goes to the JVM and back, so a batch takes a few for a run and not one for a chunk.
    """

    def __init__(self, key: str, silence_ms: int | None):
        self.row, self.silence_ms = Row(key, *(c.split()[0] for c in _FRAMES.split(", "))), silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {} if self.silence_ms is None else {"ttlDurationMs": self.silence_ms}
        self.run = handle.getValueState("run", "next_seq long, tail binary, pos int, n_steps long, last_tag string, done boolean, ahead long", **ttl)
        self.early = handle.getMapState("early", "stretch long", "seqs array<long>, chunks array<binary>", **ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 (Spark's names)
        # ahead: no chunk above it waits
        turn, tail, pos, n, tag, done, ahead = self.run.get() or (0, b"", 0, 0, None, False, -1)
        fresh: dict[int, bytes] = {}
        for r in rows:
            if r["seq"] >= turn:  # a chunk that was read before came twice
                fresh.setdefault(int(r["seq"]), bytes(r["chunk"]))
        held: dict[int, dict[int, bytes]] = {}
        changed = set()

        def waiting(seq):
            at = seq // _WAITING
            if at not in held:
                value = self.early.getValue((at,)) if at <= ahead // _WAITING else None
                held[at] = {int(i): bytes(x) for i, x in zip(*value)} if value else {}
            return held[at]

        while turn in fresh or (turn <= ahead and turn in waiting(turn)):
            early = waiting(turn).pop(turn, None) if turn <= ahead else None
            if early is not None:
                changed.add(turn // _WAITING)
            chunk = fresh.pop(turn, early)
            turn += 1
            *whole, tail = (bytes(tail) + chunk).split(b"\n\n")
            for frame in whole:
                if not frame.startswith(b"data: "):
                    continue
                body = frame[6:].decode(errors="replace")
                kind, name = _kind(body)
                if kind == "step":
                    n, tag = n + 1, name
                done = done or kind in ("done", "error")
                yield self.row(*key, pos, body, n, tag, done)
                pos += 1
        for seq, chunk in fresh.items():
            waiting(seq)[seq] = chunk
            changed.add(seq // _WAITING)
        for at in changed:
            if held[at]:
                self.early.updateValue((at,), (list(held[at]), list(held[at].values())))
            else:
                self.early.removeKey((at,))
        self.run.update((turn, bytes(tail), pos, n, tag, done, max([ahead, *fresh])))

    def close(self) -> None:
        pass


def _kind(body: str) -> tuple[str | None, str | None]:
    """The type and tag of an event; neither for what is no JSON object."""
    try:
        event = json.loads(body)
    except ValueError:
        return None, None
    if not isinstance(event, dict):
        return None, None
    return event.get("type"), None if event.get("tag") is None else str(event["tag"])


def frames_stream(chunks: DataFrame, key: str = "run_id", silence_ms: int | None = None) -> DataFrame:
    """(key, pos, body, n_steps, last_tag, done): the frames of a stream of chunks(key, seq, chunk), bytes cut anywhere.

    A run's chunks are numbered from 0; one that comes early waits for those before it, one that comes twice counts once. A
    frame leaves when its end has come, with the steps up to it, the last one's tag and whether the run is done. silence_ms: a
    run's state goes that long after its last chunk; such a stream looks for it without end, so the trigger availableNow
    does not stop it. Null numbers and chunks are left out; a body that is no JSON object is
    a frame and no step. The session's state store has to be `ROCKS`.
    """
    some = chunks.where("seq is not null and chunk is not null").select(key, F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"))
    kind = dict(some.dtypes)[key]
    return some.groupBy(key).transformWithState(_Frames(key, silence_ms), f"`{key}` {kind}, {_FRAMES}", "Append", "None" if silence_ms is None else "ProcessingTime")


def steps(events: DataFrame) -> DataFrame:
    """(run_id, n_steps, last_tag, done) of events(run_id, seq, type, tag): the last step of a run that is not done is still going."""
    is_step = F.col("type") == "step"
    return events.groupBy("run_id").agg(F.count_if(is_step).alias("n_steps"), F.max_by("tag", F.when(is_step, F.col("seq"))).alias("last_tag"), F.bool_or(F.col("type").isin("done", "error")).alias("done"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) (extension); on a stream, events later than `late` are left out."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n) (extension)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def confirmations_batch(stashes: DataFrame, resolves: DataFrame, ttl: int | None = CONFIRMATION_TTL) -> DataFrame:
    """(run_id, outcome, resolved_at) of stashes(run_id, ts) and resolves(run_id, ts, accept), each run once.

    The first answer within the time counts: accepted or rejected; none: expired. ttl None: nothing expires.
    """
    within = F.col("r.ts") >= F.col("s.ts")
    if ttl is not None:
        within = within & (F.col("r.ts") < F.col("s.ts") + F.expr(f"interval {int(ttl)} seconds"))
    first = stashes.groupBy("run_id").agg(F.min("ts").alias("ts"))
    met = first.alias("s").join(resolves.alias("r"), (F.col("s.run_id") == F.col("r.run_id")) & within, "left").select("s.run_id", F.col("r.ts").alias("at"), "r.accept")
    best = met.withColumn("k", F.row_number().over(W.partitionBy("run_id").orderBy(F.asc_nulls_last("at")))).where("k = 1")
    return best.select("run_id", F.when(F.col("at").isNull(), "expired").when(F.col("accept"), "accepted").otherwise("rejected").alias("outcome"), F.col("at").alias("resolved_at"))


_OUT = "run_id string, outcome string, resolved_at timestamp"
_STATE = "stashed_ms long"


def confirmations_stream(events: DataFrame, ttl: int | None = CONFIRMATION_TTL, late: str = "10 minutes") -> DataFrame:
    """The same outcomes from a stream of events(run_id, kind, ts, accept); kind is stash or resolve.

    A run's state is the time of its stash; it goes with the first answer, or when the watermark passes its expiry. An
    answer without a stash is `unknown`.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, out = key[0], []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run_id": [run], "outcome": ["expired"], "resolved_at": [pd.NaT]})
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        waiting = state.get[0] if state.exists else None
        for r in rows.itertuples(index=False):
            now = int(r.ts.value // 1_000_000)
            if r.kind == "stash":
                waiting = now if waiting is None else waiting
            elif waiting is not None:
                expired = ttl is not None and now >= waiting + ttl * 1000
                out.append((run, "expired" if expired else "accepted" if r.accept else "rejected", pd.NaT if expired else r.ts))
                waiting = None
            else:
                out.append((run, "unknown", r.ts))
        if waiting is not None:
            state.update((waiting,))
            if ttl is not None:
                state.setTimeoutTimestamp(max(waiting + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["run_id", "outcome", "resolved_at"])

    return events.withWatermark("ts", late).groupBy("run_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def commit_sink(location: str):
    """A foreachBatch writer that appends accepted runs as versions; one writer, numbered after the versions that are there.

    Each batch leaves the last number behind in `<location>.heads`, where the next one takes it up, so a batch reads no
    versions; only where the batch before left none are all versions looked through. A batch that runs again replaces its own.
    """
    from lodeline.operators import versions
    from lodeline.sources.files import available

    at = location.rstrip("/")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where("outcome = 'accepted'").select(F.lit("default").alias("project_id"), F.col("resolved_at").alias("created_at"), F.col("run_id").alias("commit_id"), F.lit(epoch).alias("epoch"))
        start = None
        if available(spark, f"{at}.heads/epoch={epoch - 1}"):
            start = spark.read.schema("project_id string, head int").parquet(f"{at}.heads/epoch={epoch - 1}")
        elif available(spark, at):
            start = versions.head(spark.read.schema("project_id string, version_n int, epoch int").parquet(at).where(F.col("epoch") < epoch))
        versions.chain(fresh, start).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(at)
        heads = spark.createDataFrame([], "project_id string, version_n int") if start is None else start.select("project_id", F.col("head").alias("version_n"))
        if available(spark, f"{at}/epoch={epoch}"):
            heads = heads.union(spark.read.parquet(f"{at}/epoch={epoch}").select("project_id", "version_n"))
        versions.head(heads).coalesce(1).write.mode("overwrite").parquet(f"{at}.heads/epoch={epoch}")

    return write
