"""Incremental candles: event-time buckets closed by explicit marks, late trades refused, gaps poison buckets.

Each micro-batch folds its trades into partial buckets in a table; finality comes from marks in the stream (source says: all before
this instant is known), never from a delay that would drop late data silently.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "instrument string, bucket_us long, open double, high double, low double, close double, volume double, trade_count long, state string"
_STATE = "closed_to long, buckets string"


def live_candles(stream: DataFrame, width_us: int) -> DataFrame:
    """CLOSED candles of a stream (kind: trade, mark or gap; instrument, ts_us, until_us, trade_id, price, size), and LATE rows for refused trades.

    A mark closes all buckets that end at or before its ts_us. A trade before the last mark comes out as a LATE row, never dropped. A gap
    [ts_us, until_us) poisons the buckets that it touches: they are never emitted. Empty buckets are omitted."""
    import json

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed_to, buckets = (state.get[0], json.loads(state.get[1])) if state.exists else (-(1 << 62), {})
        rows = pd.concat(list(frames))
        out = []
        rank = {"trade": 0, "gap": 1, "mark": 2}
        rows = rows.assign(rank=rows["kind"].map(rank)).sort_values(["rank", "ts_us", "trade_id"])
        for r in rows.itertuples():
            if r.kind == "trade":
                b = r.ts_us - r.ts_us % width_us
                if b + width_us <= closed_to:
                    out.append((key[0], b, r.price, r.price, r.price, r.price, r.size, 1, "LATE"))
                    continue
                x = buckets.get(str(b))
                if x == "poisoned":
                    continue
                at = [int(r.ts_us), str(r.trade_id)]
                if x is None:
                    buckets[str(b)] = [at, r.price, r.price, r.price, at, r.price, r.size, 1]
                else:
                    if at < x[0]:
                        x[0], x[1] = at, r.price
                    if at > x[4]:
                        x[4], x[5] = at, r.price
                    x[2], x[3], x[6], x[7] = max(x[2], r.price), min(x[3], r.price), x[6] + r.size, x[7] + 1
            elif r.kind == "gap":
                for b in range(int(r.ts_us - r.ts_us % width_us), int(r.until_us), width_us):
                    buckets[str(b)] = "poisoned"
            else:
                closed_to = max(closed_to, int(r.ts_us))
        for b in sorted((int(b) for b in buckets if int(b) + width_us <= closed_to)):
            x = buckets.pop(str(b))
            if x != "poisoned":
                out.append((key[0], b, x[1], x[2], x[3], x[5], x[6], x[7], "CLOSED"))
        state.update((closed_to, json.dumps(buckets)))
        yield pd.DataFrame(out, columns=["instrument", "bucket_us", "open", "high", "low", "close", "volume", "trade_count", "state"])

    return stream.groupBy("instrument").applyInPandasWithState(step, OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)
