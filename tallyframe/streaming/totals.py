"""Ordered totals on a stream, with typed state: records apply in the order of `seq` however they arrive, and the end of a key's records is an event.

Early records wait in a map state by seq (in the state store, not in memory), so arrival may be shuffled without a bound on a group; a record seen before is told as
`repeated` and counts once; where records wait for a missing one longer than `patience_ms`, a timer tells the gap. The step of a record is three numbers worked out in
columns before the state (operators.scan.step), so nothing here interprets a program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import values as V
from ..functions.picture import Picture
from ..operators.scan import stepped

OUT = "key string, seq long, kind string, units long"


class OrderedTotals(StatefulProcessor):
    def __init__(self, limit: int, signed: bool, initial: int, patience_ms: int | None):
        self.limit, self.signed, self.initial, self.patience = limit, signed, initial, patience_ms

    def init(self, handle):
        self.handle = handle
        self.total = handle.getValueState("total", "next long, units long, ended boolean")
        self.early = handle.getMapState("early", "seq long", "c long, up long, down long, last boolean")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        nxt, units, ended = self.total.get() if self.total.exists() else (1, self.initial, False)
        out, here = [], {}
        for pdf in rows:
            for seq, c, up, down, last in zip(pdf["seq"], pdf["c"], pdf["up"], pdf["down"], pdf["last"]):
                seq = int(seq)
                if seq < nxt or seq in here or self.early.containsKey((seq,)):
                    out.append((key[0], seq, "repeated", None))
                else:
                    here[seq] = (int(c), int(up), int(down), bool(last))
        while True:
            step = here.pop(nxt, None)
            if step is None:
                if not self.early.containsKey((nxt,)):
                    break
                step = self.early.getValue((nxt,))
                self.early.removeKey((nxt,))
            if ended:
                out.append((key[0], nxt, "ignored", None))
            elif step[3]:
                out.append((key[0], nxt, "total", units))
                ended = True
            else:
                units = stepped(units, *map(int, step[:3]), self.limit, self.signed)
            nxt += 1
        for seq, step in here.items():
            self.early.updateValue((seq,), step)
        self.total.update((nxt, units, ended))
        if here and self.patience is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield pd.DataFrame(out, columns=["key", "seq", "kind", "units"]).astype({"units": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        nxt = self.total.get()[0]
        waits = next(iter(self.early.keys()), None) is not None
        yield pd.DataFrame([(key[0], int(nxt), "gap", None)] if waits else [], columns=["key", "seq", "kind", "units"]).astype({"units": "Int64"})

    def close(self):
        pass


def ordered_totals(events: DataFrame, steps: Column, p: Picture, initial: int = 0, patience_ms: int | None = None) -> DataFrame:
    """A stream of events (key string, seq long from 1 without gaps, last boolean: the end of the key's records) -> rows OUT.

    kind: `total` at a key's end, with the total in units of the picture's last place; `repeated`; `ignored` after the end; `gap`. The session's state store has to be RocksDB.
    """
    own = events.select("key", "seq", "last", steps.alias("s")).select("key", "seq", "s.c", "s.up", "s.down", "last")
    processor = OrderedTotals(10**p.digits, p.signed, initial, patience_ms)
    mode = "none" if patience_ms is None else "processingTime"
    return own.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="append", timeMode=mode)


def number(units: Column, p: Picture) -> Column:
    return (units.cast("decimal(18,0)") * V.power_of_ten(-p.scale)).cast(p.spark_type)


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream without timers over what there is now, into Parquet under path, and reads that. A stream with timers has no last batch: start it yourself."""
    spark = stream.sparkSession
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
