"""Scoring, keep-first and counts on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dashboard import priority_counts
from ..operators.quality import split_payloads
from ..plans.scoring import RULES, score
from ..schema import REQUEST_MAIL
from ..sources import snapshots, store

DELAY = "1 day"
#: Groups that keep-first deals message ids to; fixed for a stream's checkpoint.
GROUPS = 1024


def read_requests(spark: SparkSession, folder: str, schema=REQUEST_MAIL) -> DataFrame:
    """Requests that arrive as JSON files in a folder."""
    return spark.readStream.schema(schema).json(folder)


def score_stream(
    requests: DataFrame, model: PipelineModel | None = None, model_used: str = RULES
) -> DataFrame:
    """Score the valid requests of a stream; the same plan as in batch."""
    valid, _ = split_payloads(requests)
    return score(valid, model, model_used)


def _state_types(schema: T.StructType) -> pa.Schema:
    """How rows are held; moments as the session shows them."""
    own = to_arrow_schema(schema)
    moment = lambda t: pa.timestamp("us") if pa.types.is_timestamp(t) else t
    return pa.schema([("_until", pa.int64()), ("_out", pa.int64()), *((f"_{i}", moment(f.type)) for i, f in enumerate(own))])


def _packed(rows: list[tuple], types: pa.Schema) -> bytes:
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, types) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns)))


def _frame(rows: list[list], schema: T.StructType) -> pd.DataFrame:
    """Rows as pandas; whole numbers stay whole beside nulls."""
    kinds = {"byte": "Int8", "short": "Int16", "integer": "Int32", "long": "Int64", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]"}
    kind = [kinds.get(f.dataType.typeName(), "object") for f in schema.fields]
    return pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype=kind[i]) for i, f in enumerate(schema.fields)})


def keep_first_stream(mail: DataFrame, event_time: str = "date", delay: str = DELAY, order: str = "path") -> DataFrame:
    """The row of each message id that comes first by ``order``, whatever order the copies arrive in.

    A message id waits for copies until the watermark has passed its earliest event time by
    ``delay``; then its first row is given out and its state is dropped. Copies later than the
    watermark are dropped. Undated mail has no place in event time: an id of which only undated
    rows have come is given out one ``delay`` of the watermark after it was first seen, so its
    state ends as well. An id holds one row. Ids are dealt to ``GROUPS`` groups by a hash, since a
    group costs a call, whatever it holds; a group's state is the rows of its ids that wait.
    """
    schema = mail.schema
    names = schema.names
    at, name = names.index(order), names.index("message_id")
    types = _state_types(schema)
    wait = mail.sparkSession.sql(f"SELECT CAST(INTERVAL {delay} AS INTERVAL DAY TO SECOND) AS d").first()["d"]
    wait = int(wait.total_seconds() * 1000)
    # Rows without event time do not move the watermark and are never late.
    marked = mail.withColumn("_event", F.col(event_time).cast("timestamp")).withColumn("_at", F.unix_millis("_event"))
    # pandas would make floats of whole numbers beside nulls.
    whole = [f.name for f in schema.fields if isinstance(f.dataType, T.IntegralType)]
    marked = marked.withColumns({f"_no_{c}": F.col(c).isNull() for c in whole} | {c: F.coalesce(c, F.lit(0).cast(schema[c].dataType)) for c in whole})

    def values(column: pd.Series, missing: pd.Series) -> list:
        if pd.api.types.is_datetime64_any_dtype(column):
            return [None if x is pd.NaT else x.to_pydatetime() for x in column]
        return [None if no else x for x, no in zip(column.tolist(), missing)]

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Of each id in a group's new rows its earliest event time and its first row."""
        given = pd.concat(list(batches), ignore_index=True)
        given["_id"] = pd.factorize(given["message_id"], use_na_sentinel=False)[0]
        times = given.groupby("_id")["_at"].min().to_dict()
        best = given.sort_values(order, kind="stable").drop_duplicates("_id")
        rows = zip(*(values(best[c], best[f"_no_{c}"] if c in whole else best[c].isna()) for c in names))
        for own, row in zip(best["_id"].tolist(), rows):
            yield None if pd.isna(times[own]) else int(times[own]), row

    def first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = {row[name]: (until, out, row) for until, out, *row in _unpacked(state.get[0])} if state.exists else {}
        new = {} if state.hasTimedOut else {row[name]: (time, row) for time, row in firsts(batches)}
        ended = []
        for own, (until, out, row) in list(held.items()):
            if own in new or out >= now:
                continue
            if until < 0:  # first seen when there was no watermark yet: its wait begins now
                held[own] = (now + wait, now + wait, row)
            else:
                ended.append(row)
                del held[own]
        for own, (time, row) in new.items():
            until, _, best = held.get(own, (None, None, None))
            if time is not None:
                until = time + wait if until is None or until < 0 else min(until, time + wait)
            if best is None or (row[at] or "") < (best[at] or ""):
                best = row
            if until is None:
                until = now + wait if now > 0 else -1
            held[own] = (until, max(until, now + 1), best)
        if held:
            state.update((_packed([(until, out, *row) for until, out, row in held.values()], types),))
            state.setTimeoutTimestamp(max(min(out for _, out, _ in held.values()), now, 1))
        elif state.exists:
            state.remove()
        if ended:
            yield _frame(ended, schema)

    return (
        marked.withWatermark("_event", delay)
        .withColumn("_group", F.pmod(F.xxhash64("message_id"), F.lit(GROUPS)))
        .groupBy("_group")
        .applyInPandasWithState(first, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    )


def count_stream(scored: DataFrame) -> DataFrame:
    """Running rows per priority; for complete or update mode."""
    return priority_counts(scored)


def write_to_store(
    scored: DataFrame, path: str, checkpoint: str, rejects: str | None = None
) -> StreamingQuery:
    """Append a scored stream to the result store, batch by batch.

    The quality gate and the partitioning are those of the batch store. A batch that is
    replayed after a failure replaces what its first run has written.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, path, rejects, batch_id)

    return (
        scored.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write an append-mode stream as Parquet files; a restart repeats nothing."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest totals of a complete-mode aggregation at ``path``; :func:`.snapshots.read` reads them."""

    def replace(batch: DataFrame, version: int) -> None:
        snapshots.write(batch, path, version)

    return (
        stream.writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def as_json_requests(mail: DataFrame) -> DataFrame:
    """Mail rows as request objects, for writing a request folder."""
    return mail.select(*(F.col(f.name).cast(f.dataType) for f in REQUEST_MAIL.fields))
