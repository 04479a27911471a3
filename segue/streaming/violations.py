"""Stateful output-gap check per mix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "mix_id long, out_start long, expected long, kind string"
#: Groups of mixes that share a state row, so that a call of the processor judges many mixes at once.
BUCKETS = 1024
ORDER = ["out_start", "tie", "track_id", "src_start", "src_end"]


class RunningEnd(StatefulProcessor):
    """Keeps the furthest output ends of a bucket of mixes and reports rows that do not start there.

    Rows of one micro-batch are judged in output order, however they are cut into chunks. Rows of
    later batches are judged against the furthest end so far, so a mix must arrive in order of
    batches, as it does from a renderer that writes its timeline forward.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("furthest_ends", "mix binary, furthest binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        named = key[0] >= 0  # rows without a mix have a bucket of their own
        pdf = pdf.assign(mix_id=pdf["mix_id"] if named else 0).sort_values(["mix_id", *ORDER], kind="stable").reset_index(drop=True)
        mix, ends = (np.frombuffer(x, dtype="int64") for x in (self.ends.get() if self.ends.exists() else (b"", b"")))
        known = pd.Series(ends, index=mix)
        before = known.reindex(pdf["mix_id"], fill_value=0).to_numpy()
        by_mix = pdf["mix_id"].to_numpy()
        after = pdf.groupby("mix_id", sort=False)["out_end"].cummax().clip(lower=pd.Series(before))
        shifted = after.groupby(by_mix, sort=False).shift(1)
        expected = shifted.where(shifted.notna(), before).astype("int64").clip(lower=0)
        bad = pdf["out_start"].to_numpy() != expected.to_numpy()
        if bad.any():
            start, want = pdf["out_start"].to_numpy()[bad], expected.to_numpy()[bad]
            yield pd.DataFrame({"mix_id": by_mix[bad] if named else pd.array([None] * len(start), dtype="Int64"), "out_start": start, "expected": want,
                                "kind": ["output_gap" if s > w else "output_overlap" for s, w in zip(start, want)]})
        last = after.groupby(by_mix, sort=False).last().astype("int64")
        ends = pd.concat([known[~known.index.isin(last.index)], last])
        self.ends.update(tuple(x.to_numpy(dtype="int64").tobytes() for x in (ends.index, ends)))

    def close(self) -> None:
        pass


def gap_stream(spark: SparkSession, events: DataFrame) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    bucket = F.when(F.col("mix_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("mix_id"), F.lit(BUCKETS)))
    return events.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(RunningEnd(), outputStructType=SCHEMA, outputMode="append", timeMode="none")
