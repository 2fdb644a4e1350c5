"""Quality classifier: texts compressed with a dictionary of good and one of bad text; the difference becomes a score."""
from __future__ import annotations

import functools
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import ready, slices

#: Labelled texts per class that are learned from at most (the bound of the sample), and bytes taken of all texts of a class.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 16 << 20
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
#: Texts meet the dictionaries in pieces of so many bytes: a long piece is soon its own best dictionary, and sizes differ less.
PIECE = 1 << 10


class Model(NamedTuple):
    """Two dictionaries, and offset and slope of the normalised difference."""
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


@functools.lru_cache(4)
def compressors(model: Model):
    import zstandard as z
    return [z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d)) if d else z.ZstdCompressor(level=LEVEL) for d in (model.good, model.bad)]


def difference(text: bytes, model: Model) -> float:
    """How many more bytes of 100 the text takes with the bad dictionary than with the good one, piece by piece."""
    good, bad = compressors(model)
    pieces = [text[i: i + PIECE] for i in range(0, max(1, len(text)), PIECE)]
    return 100 * sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces) / (len(text) + 16)


def features(texts: list[bytes], model: Model) -> np.ndarray:
    return np.array([(1.0, difference(t, model)) for t in texts], float).reshape(-1, 2)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(texts: list[bytes], limit: int) -> bytes:
    """A dictionary of at most ``limit`` bytes trained on the texts; where they are too few, the texts themselves."""
    import zstandard as z
    parts = [t[i: i + 2048] for t in texts for i in range(0, len(t), 2048)]
    try:
        return z.train_dictionary(limit, parts).as_bytes()
    except z.ZstdError:
        return b"".join(texts)[:limit]


def train(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from at most ``sample_rows`` labelled texts of each class, those whose hashed key comes first.

    ``allowed`` says of a row whether its label may be seen. Two thirds of the sample make the
    dictionaries, the rest offset and slope, so that the score is calibrated on texts the dictionaries have
    not seen. Keys and sizes alone are ranked; only the chosen texts are read. Null labels, null keys and empty texts teach nothing. Whole texts are taken that fit into
    ``sample_bytes`` of a class; one that does not is passed over. With one class missing, every text scores the share of class 1.
    """
    sizes = docs.where(allowed & (F.octet_length(text) > 0)).select(F.col(key).alias("k"), F.octet_length(text).alias("size"))
    known = sizes.join(labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).alias("y")).distinct(), "k")
    picked: list[tuple[int, int]] = []
    for y in (0, 1):
        room = sample_bytes
        for r in known.where((F.col("y") == y) & (F.col("size") <= sample_bytes)).orderBy(F.xxhash64("k"), "k", "size").limit(sample_rows).collect():
            if r.size <= room:
                room -= r.size
                picked.append((r.k, y))
    sample: dict[int, list[bytes]] = {0: [], 1: []}
    if picked:  # at most 2 x sample_rows keys, so they are broadcast
        few = docs.sparkSession.createDataFrame(sorted(set(picked)), "k long, y int")
        texts = docs.where(allowed & (F.octet_length(text) > 0)).join(F.broadcast(few), F.col(key) == F.col("k")).select("y", F.encode(F.col(text), "utf-8").alias("t"), "k")
        for r in sorted(texts.collect(), key=lambda r: (zlib.crc32(str(r.k).encode()), bytes(r.t))):
            sample[r.y].append(bytes(r.t))
    bad, good = sample[0], sample[1]
    if not bad or not good:
        share = min(max(len(good) / max(1, len(good) + len(bad)), 0.01), 0.99) if good or bad else 0.5
        return Model(b"", b"", (float(np.log(share / (1 - share))), 0.0))
    learn = [[t for i, t in enumerate(ts) if i % 3 < 2] for ts in (bad, good)]
    tune = [[t for i, t in enumerate(ts) if i % 3 == 2 or len(ts) < 3] for ts in (bad, good)]
    draft = Model(dictionary(learn[1], DICTIONARY_BYTES), dictionary(learn[0], DICTIONARY_BYTES), ())
    x = features([*tune[0], *tune[1]], draft)
    y = np.array([0] * len(tune[0]) + [1] * len(tune[1]), float)
    return draft._replace(weights=tuple(fit(x, y).tolist()))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the chance of label 1 in ``into``, from the difference of the whole text alone; null and empty texts are scored as empty.

    Repeated rows are scored each and alike; an empty table gives an empty one; ``into`` must be a new column.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    schema = docs.select("*", F.lit(0.0).alias(into)).schema

    def run(batches):
        m = shared.value
        w = np.array(m.weights)
        for b in slices(batches, text):
            x = features([t or b"" for t in b.column(text).cast(pa.large_binary()).to_pylist()], m)
            s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, into])
    return docs.mapInArrow(run, schema)
