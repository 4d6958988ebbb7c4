"""Items of reports whose lines arrive over many micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from dossier.config import RetrievalConfig
from dossier.functions.lineage import cut
from dossier.operators.index import LexicalIndex
from dossier.operators.retrieval import Scorer
from dossier.operators.text import item_texts, marked_lines
from dossier.plans.retrieve import retrieve

LINE_SCHEMA = "report_id string, line_no long, line string, ts timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ReportItems(StatefulProcessor):
    """The open item of each report, and lines that the watermark has not reached.

    A line waits until the watermark has passed its time: none that belongs before it can still come. Then lines are taken
    in the order of their numbers; a line that starts an item gives out the one before. A report without lines for
    `idle_ms` of event time gives out its last item and is forgotten.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "line_no long, ms long, starts boolean, no int, part string")
        self.open = handle.getValueState("open", "item_line long, item_no int, parts array<string>")
        self.latest = handle.getValueState("latest", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = self.latest.get()[0] if self.latest.exists() else 0
        for part in rows:
            lines = [
                (int(n), int(ms), bool(s), int(no) if s else None, t)
                for n, ms, s, no, t in zip(part["line_no"], part["ms"], part["starts"], part["no"], part["part"])
            ]
            self.waiting.appendList(lines)
            for ms in {line[1] for line in lines}:
                self.handle.registerTimer(ms)
                latest = max(latest, ms)
        self.latest.update((latest,))
        self.handle.registerTimer(latest + self.idle_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due, rest = sorted(w for w in waiting if w[1] <= now), [w for w in waiting if w[1] > now]
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        item = tuple(self.open.get()) if self.open.exists() else None
        done = []
        for line_no, _, starts, no, part in due:
            if starts:
                if item:
                    done.append(item)
                item = (line_no, no, [part])
            elif item and part:
                item = (item[0], item[1], [*item[2], part])
        if not rest and self.latest.exists() and now >= self.latest.get()[0] + self.idle_ms:
            if item:
                done.append(item)
            self.open.clear()
            self.latest.clear()
        elif due and item:
            self.open.update(item)
        if done:
            lines, numbers, parts = zip(*done)
            yield pd.DataFrame({"report_id": key[0], "item_line": lines, "item_no": numbers, "parts": [list(p) for p in parts]})

    def close(self) -> None:
        pass


def stream_report_items(lines: DataFrame, lateness: str = "1 minute", idle: str = "10 minutes") -> DataFrame:
    """report_id, item_line, item_no, text of a stream of lines (report_id, line_no, line, ts), as `numbered_items` in batch.

    Lines of a report may be spread over any number of micro-batches and come out of order within `lateness`; later ones
    are dropped. Event times of a report must not fall with line numbers. State per report: its open item and the lines of
    the last `lateness`. Start the query under `rocksdb_state`.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    marked = marked_lines(lines.withWatermark("ts", lateness), "ts")
    rows = marked.select(
        "report_id", "line_no", F.unix_millis("ts").alias("ms"), "starts",
        F.coalesce(F.col("no").try_cast("int"), F.lit(0)).alias("no"), F.coalesce("part", F.lit("")).alias("part"), "ts",
    )
    items = rows.groupBy("report_id").transformWithStateInPandas(
        ReportItems(idle_ms), "report_id string, item_line long, item_no int, parts array<string>", "append", "EventTime"
    )
    return item_texts(items)


class rocksdb_state:
    """Queries started inside keep their state in RocksDB, which keyed timers need; the session's setting comes back after."""

    def __init__(self, spark: SparkSession) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(_PROVIDER, None)
        self.conf.set(_PROVIDER, _ROCKSDB)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.conf.unset(_PROVIDER)
        else:
            self.conf.set(_PROVIDER, self.before)


def stream_item_evidence(
    lines: DataFrame, out_path: str, checkpoint: str, kb: DataFrame, encode, kb_name: str, scorer: Scorer | None = None,
    cfg: RetrievalConfig = RetrievalConfig(), index: LexicalIndex | None = None, lateness: str = "1 minute", idle: str = "10 minutes",
) -> StreamingQuery:
    """Evidence for items as they close, whatever batches their lines came in; a repeated batch replaces its own folder."""

    def audit(items: DataFrame, batch_id: int) -> None:
        asked = items.select(
            F.lit(kb_name).alias("kb"), F.concat_ws("#", "report_id", F.col("item_line").cast("string")).alias("query_id"),
            "report_id", "item_no", "text",
        )
        queries = cut(encode(asked))
        ranked = retrieve(queries, kb, scorer, cfg, index)
        ranked.join(queries.select("kb", "query_id", "report_id", "item_no"), ["kb", "query_id"]).write.mode("overwrite").parquet(
            f"{out_path}/batch_id={batch_id}"
        )

    with rocksdb_state(lines.sparkSession):
        return (
            stream_report_items(lines, lateness, idle).writeStream.outputMode("append").foreachBatch(audit)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
