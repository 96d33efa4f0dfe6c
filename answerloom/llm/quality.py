"""Quality by compression: does a text shrink more beside good or beside bad examples?

Two zstandard dictionaries are trained, one from texts labelled good and one from texts
labelled bad. A text is compressed with either in blocks; the difference of the compressed
sizes, divided by their sum or by the text's length, says which dictionary knows it better.
A logistic curve over these sizes turns them into a probability that the label is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from answerloom.llm.common import bounded_batches, fresh, share

#: Bounds of the fit. About so many labelled texts a class feed a dictionary, each with one
#: piece of so many bytes; about so many labelled rows calibrate the score.
DICTIONARY_TEXTS = 1500
PIECE_CHARS = 2048
DICTIONARY_BYTES = 64 << 10
CALIBRATION_ROWS = 20_000
BLOCK_BYTES = 2048
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs: two dictionaries and the curve (empty: no labels of both kinds)."""

    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


class _Sizer:
    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for data in (good, bad):
            words = zstandard.ZstdCompressionDict(data)
            words.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words))

    def features(self, text: str | None) -> tuple[float, ...]:
        """Compressed-size differences of the whole text, and of its most one-sided blocks."""
        data = (text or "").encode()
        good = bad = 0
        shares = []
        for at in range(0, max(len(data), 1), BLOCK_BYTES):
            block = data[at : at + BLOCK_BYTES]
            g, b = (len(c.compress(block)) for c in self.pair)
            good, bad = good + g, bad + b
            shares.append((g - b) / (g + b))
        length = len(data) + 16
        return (
            (good - bad) / (good + bad), good / length, bad / length,
            max(shares), min(shares), (good - bad) / length,
        )


def _spread(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Constant, standardised sizes (held within six deviations) and their products."""
    z = np.clip((x - centre) / scale, -6, 6)
    k = z.shape[1]
    products = [z[:, i] * z[:, j] for i in range(k) for j in range(i, k)]
    return np.column_stack([np.ones(len(z)), z, *products])


def _logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Penalised logistic fit; Newton steps are halved until the loss falls."""
    w = np.zeros(rows.shape[1])
    keep = np.full(len(w), ridge)
    keep[0] = 1e-6

    def loss(v):
        m = rows @ v
        return np.logaddexp(0, m).sum() - labels @ m + 0.5 * (keep * v * v).sum()

    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -35, 35)))
        hess = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag(keep)
        step = np.linalg.solve(hess, rows.T @ (labels - p) - keep * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        now, before = loss(w), now
        if before - now < 1e-7 * max(1.0, now):
            break
    return w


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too short examples to train on
        return b"".join(pieces)[:DICTIONARY_BYTES] or b"\0" * 8


def fit_quality(
    labelled: DataFrame,
    text: str = "text",
    label: str = "label",
    key: str = "doc_id",
    dictionary_texts: int = DICTIONARY_TEXTS,
    calibration_rows: int = CALIBRATION_ROWS,
) -> QualityModel:
    """Fit on a bounded sample of ``labelled`` (``text``, ``label`` 0 or 1, ``key``).

    Rows with a null text or label teach nothing. About ``dictionary_texts`` rows a class,
    chosen by a hash of text and key (copies of one text are chosen apart), give one piece of ``PIECE_CHARS`` characters each to the
    dictionaries; about ``calibration_rows`` rows fit the curve. Without both labels the
    model has no curve and every score is 0.5.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(
        F.col(text).alias("text"), F.col(label).cast("int").alias("label"),
        F.xxhash64(text, key).alias("mark"),
    )
    rows = rows.where("text IS NOT NULL AND label IN (0, 1)")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return QualityModel(b"\0" * 8, b"\0" * 8, np.zeros(6), np.ones(6), np.zeros(0))
    room = F.greatest(F.length("text") - PIECE_CHARS + 1, F.lit(1))
    start = (F.pmod(F.xxhash64("mark", F.lit("start")), room) + 1).cast("int")
    wanted = None
    for value, n in counts.items():
        mine = (F.col("label") == value) & share(F.col("mark"), n, dictionary_texts)
        wanted = mine if wanted is None else wanted | mine
    taken = rows.where(wanted).select("label", F.substring("text", start, PIECE_CHARS).alias("piece"))
    found = sorted((r["label"], r["piece"]) for r in taken.collect())
    good, bad = (_dictionary([p.encode() for v, p in found if v == k]) for k in (1, 0))
    sizes = _feature_udf(good, bad)
    sample = rows.where(share(F.col("mark"), sum(counts.values()), calibration_rows))
    got = sample.select("label", sizes("text").alias("x")).toPandas()
    x, y = np.array(got["x"].tolist(), dtype=float), got["label"].to_numpy(dtype=float)
    order = np.lexsort([*x.T, y])  # sums of doubles in one order, whatever the row order
    x, y = x[order], y[order]
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return QualityModel(good, bad, centre, scale, _logistic(_spread(x, centre, scale), y))


def _feature_udf(good: bytes, bad: bytes):
    @F.pandas_udf("array<double>")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = _Sizer(good, bad)
        for texts in batches:
            yield pd.Series([sizer.features(t) for t in texts], index=texts.index)

    return sizes


def _score_udf(model: QualityModel):
    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = _Sizer(model.good, model.bad)
        for texts in batches:
            if not len(model.weights) or not len(texts):
                yield pd.Series(np.full(len(texts), 0.5))
                continue
            x = np.array([sizer.features(t) for t in texts], dtype=float)
            margin = _spread(x, model.centre, model.scale) @ model.weights
            yield pd.Series(1 / (1 + np.exp(-np.clip(margin, -35, 35))))

    return score


def score_quality(
    docs: DataFrame, model: QualityModel, text: str = "text", name: str = "score"
) -> DataFrame:
    """Add the probability that a text's label is 1; a null text counts as empty.

    Rows, order of columns and other columns are untouched. ``name`` must be free: see
    ``common.fresh``. Equal texts get equal scores, an empty table stays empty.
    """
    if fresh(docs, name) != name:
        raise ValueError(f"the table has a column {name} already")
    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, _score_udf(model)(F.col(text)))


def drop_low_quality(
    docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Rows scoring ``threshold`` or more, with the columns of ``docs``."""
    mark = fresh(docs, "quality_score")
    return score_quality(docs, model, text, mark).where(F.col(mark) >= threshold).drop(mark)
