"""Keyed state processors: online ratings and early-stopped votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from answerloom.operators.boards import K_FACTOR, START_RATING, fold_votes

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark) -> None:
    """Keyed state needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


_FOLDED = 100_000


def _coded_votes(rows: Iterator[pd.DataFrame]):
    """Arrays of seq, winner and loser, and the names that the last two are numbers of.

    A vote takes 16 bytes, whatever the names are.
    """
    numbers: dict[str | None, int] = {}
    parts = []
    for chunk in rows:
        codes, found = pd.factorize(pd.concat([chunk["winner"], chunk["loser"]]), use_na_sentinel=False)
        found = [None if pd.isna(name) else name for name in found]
        codes = np.array([numbers.setdefault(name, len(numbers)) for name in found], dtype=np.int32)[codes]
        parts.append((chunk["seq"].to_numpy(), codes[: len(chunk)], codes[len(chunk) :]))
    seq, winner, loser = (np.concatenate(x) for x in zip(*parts))
    return seq, winner, loser, list(numbers)


class RatingProcessor(StatefulProcessor):
    """Ratings of one arena; votes not newer than the last one taken are rejected."""

    def __init__(self, k: float = K_FACTOR, start: float = START_RATING):
        self.k, self.start = k, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getMapState("ratings", "model string", "rating double")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        seq, winner, loser, names = _coded_votes(rows)
        late = np.zeros(len(seq), dtype=bool) if last is None else ~(seq > last)
        rejected = int(late.sum())
        order = np.argsort(seq, kind="stable")
        order = order[~late[order]]
        known = {}
        for i in np.union1d(winner[order], loser[order]):
            if self.ratings.containsKey((names[i],)):
                known[names[i]] = self.ratings.getValue((names[i],))[0]

        def pairs():
            for at in range(0, len(order), _FOLDED):
                part = order[at : at + _FOLDED]
                for i, j in zip(winner[part].tolist(), loser[part].tolist()):
                    yield names[i], names[j]

        after = fold_votes(known, pairs(), self.k, self.start)
        for model, rating in after.items():
            self.ratings.updateValue((model,), (float(rating),))
        if len(order):
            self.last.update((int(seq[order].max()),))
        if not after:
            return
        yield pd.DataFrame(
            {
                "arena": pd.Series([key[0]] * len(after), dtype=object),
                "model": pd.Series(list(after), dtype=object),
                "rating": [float(x) for x in after.values()],
                "rejected": rejected,
            }
        ).astype({"rejected": "int64"})

    def close(self) -> None:
        pass


RATING_SCHEMA = "arena string, model string, rating double, rejected long"


def online_elo(votes: DataFrame, k: float = K_FACTOR, start: float = START_RATING) -> DataFrame:
    """ST3: ratings per arena as votes arrive, in ``seq`` order inside a micro-batch.

    Each batch emits the new ratings of the models it touched.
    """
    use_keyed_state(votes.sparkSession)
    return votes.groupBy("arena").transformWithStateInPandas(
        statefulProcessor=RatingProcessor(k, start),
        outputStructType=RATING_SCHEMA,
        outputMode="Update",
        timeMode="None",
    )


class MajorityProcessor(StatefulProcessor):
    """Counts per answer until an answer of an item has more than half of all samples.

    One key is a bucket of items, so a call takes many items at once and the state of a bucket is
    read and written once a batch, as two packed tables: the open items, and the counts of those
    that are not decided. All state of an item goes when its last sample has arrived. With
    ``idle_ms`` an item without new samples for that long is emitted undecided, if it is, and
    forgotten.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "open binary, counts binary")

    def _load(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        if not self.held.exists():
            return _OPEN.empty_table().to_pandas(), _COUNTS.empty_table().to_pandas()
        return tuple(pa.ipc.open_stream(bytes(x)).read_all().to_pandas() for x in self.held.get())

    def _keep(self, items: pd.DataFrame, counts: pd.DataFrame) -> None:
        """Hold these tables; the bucket has one timer, for its item that is due first."""
        if self.idle_ms is not None:
            for expiry in list(self.handle.listTimers()):
                self.handle.deleteTimer(expiry)
        if items.empty:
            self.held.clear()
            return
        self.held.update((_packed(items, _OPEN), _packed(counts, _COUNTS)))
        if self.idle_ms is not None:
            self.handle.registerTimer(int(items["due"].min()))

    def _rows(self, key, items, answers, used) -> pd.DataFrame:
        named = pd.Series(items, dtype=object) if key[0] >= 0 else pd.Series([None] * len(items), dtype=object)
        return pd.DataFrame(
            {"item": named, "final_answer": pd.Series(answers, dtype=object), "n_used": pd.Series(used, dtype="int64")}
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        items, counts = self._load()
        new = pd.concat(list(rows), ignore_index=True).sort_values("sample_idx", kind="stable")
        new = new.merge(items[["item", "arrived", "done"]], "left", "item")
        new = new.merge(counts, "left", ["item", "answer"])
        new["done"] = new["done"].eq(True)
        new["arrived"] = new["arrived"].fillna(0).astype("int64") + new.groupby("item").cumcount() + 1
        alike = new.groupby(["item", "answer"], dropna=False).cumcount() + 1
        won = (new["n"].fillna(0).astype("int64") + alike) * 2 > new["num_samples"]
        ending = (won | (new["arrived"] == new["num_samples"])) & ~new["done"]
        found = new[ending].drop_duplicates("item")
        final = found["answer"].where(won[found.index], None)

        last = new.drop_duplicates("item", keep="last")
        open_ = last[~(last["arrived"] >= last["num_samples"])][["item", "arrived", "done"]]
        open_ = open_.assign(
            done=open_["done"] | open_["item"].isin(found["item"]),
            due=0 if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.idle_ms,
        )
        items = pd.concat([items[~items["item"].isin(last["item"])], open_], ignore_index=True)
        undecided = items.loc[~items["done"].astype(bool), "item"]
        counts = pd.concat([counts, new[["item", "answer"]].assign(n=1)], ignore_index=True)
        counts = counts[counts["item"].isin(undecided)]
        counts = counts.groupby(["item", "answer"], dropna=False, as_index=False)["n"].sum()
        self._keep(items, counts)
        if len(found):
            answers = [None if pd.isna(x) else x for x in final]
            yield self._rows(key, found["item"].tolist(), answers, found["arrived"].tolist())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        items, counts = self._load()
        now = max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        idle = items["due"] <= now
        gone, items = items[idle], items[~idle]
        self._keep(items, counts[counts["item"].isin(items["item"])])
        gone = gone[~gone["done"].astype(bool)]
        if len(gone):
            yield self._rows(key, gone["item"].tolist(), [None] * len(gone), gone["arrived"].tolist())

    def close(self) -> None:
        pass


MAJORITY_SCHEMA = "item long, final_answer string, n_used long"


_OPEN = pa.schema([("item", pa.int64()), ("arrived", pa.int64()), ("done", pa.bool_()), ("due", pa.int64())])
_COUNTS = pa.schema([("item", pa.int64()), ("answer", pa.string()), ("n", pa.int64())])
BUCKETS = 1024


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def online_majority(
    samples: DataFrame, idle_ms: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """ST4: emit an item once, when an answer passes half of ``num_samples``.

    Items whose samples run out without a majority are emitted with a NULL answer, as are
    items that got no sample for ``idle_ms``. Items keep state only until their last sample
    or that timer; counts only until they are decided. Items are dealt to ``buckets``; a batch
    rewrites the open items of the buckets it meets, so very many open items want more of them.
    ``buckets`` belongs to the checkpoint and stays as it is over restarts.
    """
    use_keyed_state(samples.sparkSession)
    item = F.col("item").cast("long")
    # Samples without an item are one item, in a bucket of its own.
    bucket = F.when(item.isNull(), -1).otherwise(F.pmod(F.xxhash64(item), F.lit(buckets))).cast("long")
    rows = samples.select(
        bucket.alias("bucket"), F.coalesce(item, F.lit(0).cast("long")).alias("item"), "sample_idx",
        F.col("answer").cast("string").alias("answer"), "num_samples",
    )
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=MajorityProcessor(idle_ms),
        outputStructType=MAJORITY_SCHEMA,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
