"""The exact result cache as a Structured Streaming query.

Requests arrive as files of (worker, seq, text); each worker's cache is keyed state that
survives restarts with the query's checkpoint. Within a trigger a worker's requests are
taken by seq, so a replay in many triggers equals the batch replay if requests arrive in
order.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import query_key
from ..operators.caches import ExactCache

REQUEST = "worker long, seq long, text string"


def requests(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replay_exact(stream: DataFrame, size: int = 10_000) -> DataFrame:
    """(worker, seq, hit): streaming counterpart of operators.caches.replay_exact."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = ExactCache(size)
        if state.exists:
            cache.kept = OrderedDict((k, True) for k in state.get[0])
        rows = pd.concat(list(parts), ignore_index=True).sort_values("seq", kind="stable")
        hits = [cache.ask(k) for k in rows["key"]]
        state.update((list(cache.kept),))
        yield pd.DataFrame({"worker": rows["worker"].to_numpy(), "seq": rows["seq"].to_numpy(), "hit": pd.array(hits, dtype="boolean")})

    keyed = stream.select("worker", "seq", query_key(F.col("text")).alias("key"))
    return keyed.groupBy("worker").applyInPandasWithState(run, "worker long, seq long, hit boolean", "keys array<string>", "append", GroupStateTimeout.NoTimeout)


def write(replayed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there and stops; call again for more."""
    return replayed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
