"""Toxicity by compression distance.

Two dictionaries are made: zstandard trains one on windows of ordinary texts;
the other is the same one followed by beginnings of words that toxic texts have
and ordinary ones lack, picked by document frequency and log-odds. (Not the
dealt method, which trains both; README says what was measured.) A window of
a text that the toxic dictionary compresses shorter than the ordinary one
speaks for toxicity. Thresholds on that gain are counted over all windows of
the whole text, and a logistic curve, fitted to labelled rows, makes the counts
a score from 0 to 1.

Training reads labelled rows outside the held-out fold only, and a bounded
sample of them (``ORDINARY`` and ``TOXIC`` rows for dictionaries, ``CURVE`` rows
for the curve, chosen by a hash of the key). Scoring reads every row and only
its text. Upper and lower case count alike.

Null and empty texts have no window that speaks for anything and get the
curve's value at zero. Repeated rows score alike. Rows without a label are
scored; labels that are null or without a document are ignored. A null key
is not held out. Where a key occurs more than once, one of its texts is learned
from. Without labels of both kinds nothing can be learned: every text scores 1 if
all known rows are toxic, else 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import hash_int

WINDOW, STEP = 64, 48
# Rows to learn from, and characters of each for the dictionaries (a stretch from a hashed place).
ORDINARY, TOXIC, CURVE, EXCERPT = 3000, 1500, 6000, 4000
DICTIONARY_BYTES = 1 << 14
# What sets toxic texts apart: beginnings of words in at least this share of them, and e^3 times likelier than elsewhere.
SHARE, LOG_ODDS = 0.04, 3.0
# Gains in bytes whose windows are counted.
GAINS = (2, 3, 4, 5, 6)
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = ()
    # The score of every text, where there was nothing to learn from.
    always: float | None = None


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 3 == 1, F.lit(False))


def windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STEP), STEP)]


@lru_cache(maxsize=4)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=13, chain_log=13, search_log=4, min_match=5, strategy=zstandard.STRATEGY_LAZY,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how)


def features(model: Model, text: bytes) -> list[float]:
    """Logs of how many windows gain so many bytes, the largest gain, and the log of the number of windows."""
    ordinary, toxic = compressor(model.ordinary).compress, compressor(model.toxic).compress
    parts = windows(text.lower())
    gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in parts])
    counts = [(gain >= g).sum() for g in GAINS]
    n = len(parts)
    # Counts over what a text of this length has by chance, too: long texts are not toxic for being long.
    return [*np.log1p(counts), *(np.array(counts) / (n + 4.0)), max(int(gain.max()), 0) / 4.0, np.log1p(n)]


def _beginnings(text: bytes) -> set[bytes]:
    out = set()
    for word in text.translate(_LETTERS).split():
        word = b" " + word + b" "
        out.update(word[:k] for k in range(5, min(len(word), 14) + 1))
    return out


# ASCII letters in lower case and all bytes of other letters; everything else is a blank.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def train_dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> Model:
    here, there = Counter(), Counter()
    for text in toxic:
        here.update(_beginnings(text))
    for text in ordinary:
        there.update(_beginnings(text))

    def odds(b: bytes) -> float:
        return np.log((here[b] + 0.5) / (len(toxic) + 1) / ((there[b] + 0.5) / (len(ordinary) + 1)))

    telling = {b for b, c in here.items() if c >= max(2, SHARE * len(toxic)) and odds(b) >= LOG_ODDS}
    chosen: dict[bytes, int] = {}
    for b in sorted(telling):
        if b[:-1] in telling:
            continue
        # From the shortest telling beginning on, as long as most of its texts go the same way.
        longest = b
        while on := [x for x in telling if x[:-1] == longest and here[x] >= 0.6 * here[b]]:
            longest = max(on, key=lambda x: (here[x], x))
        chosen[longest] = here[b]
    samples = [w for text in ordinary for w in windows(text.lower())]
    try:
        common = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        common = b" ".join(samples)[-DICTIONARY_BYTES:]
    # The most frequent last: what is nearest to a window is cheapest to point at.
    return Model(common, common + b"".join(sorted(chosen, key=lambda b: (chosen[b], b))))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: float = 2.0, ridge: float = 0.5) -> tuple[float, ...]:
    """Logistic regression by Newton steps; toxic rows count ``weight`` times."""
    x = np.column_stack([np.ones(len(x)), x])
    w, by = np.zeros(x.shape[1]), np.where(y == 1, weight, 1.0)
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (by * (y - p)) - penalty * w
        bend = (x * (by * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def score(weights: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ np.array(weights), -30, 30)))


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    known = (
        labels.where(~held_out(key) & F.col(f"`{label}`").isin(0, 1))
        .groupBy(F.col(f"`{key}`").alias("key")).agg(F.max(f"`{label}`").alias("label"))
    )
    order = hash_int(F.lit("sample"), F.col("key"))

    def sample(label_value: int, rows: int) -> DataFrame:
        return known.where(F.col("label") == label_value).orderBy(order, "key").limit(rows)

    texts = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # At most ORDINARY + TOXIC keys of 16 bytes: a bounded broadcast.
    picked = texts.join(F.broadcast(sample(0, ORDINARY).unionAll(sample(1, TOXIC))), "key")
    room = F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1
    excerpt = F.substring("text", (F.lit(1) + hash_int(F.lit("from"), F.col("key")) % room).cast("int"), F.lit(EXCERPT))
    # One text a key, however often the key occurs: at most ORDINARY + TOXIC rows.
    rows = picked.groupBy("key", "label").agg(F.min(excerpt).alias("text")).orderBy("key").collect()
    toxic = [r.text.encode() for r in rows if r.label == 1]
    ordinary = [r.text.encode() for r in rows if r.label == 0]
    if not toxic or not ordinary:
        return Model(b"", b"", always=float(bool(toxic)))
    model = train_dictionaries(ordinary, toxic)
    # At most 2 * CURVE keys, again.
    measured = texts.join(F.broadcast(sample(0, CURVE).unionAll(sample(1, CURVE))), "key")
    measured = _measure(measured.groupBy("key", "label").agg(F.min("text").alias("text")), model).orderBy("key").toPandas()
    x = np.stack(measured["x"].to_numpy())
    return Model(model.ordinary, model.toxic, fit_curve(x, measured["label"].to_numpy()))


def _measure(df: DataFrame, model: Model) -> DataFrame:
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(model, t.as_buffer().to_pybytes()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], ["key", "label", "x"]
            )

    kinds = dict(df.dtypes)
    return df.select("key", "label", F.encode("text", "UTF-8").alias("text")).mapInArrow(
        measured, f"key {kinds['key']}, label {kinds['label']}, x array<double>"
    )


def toxicity(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` for each row. The model (two dictionaries of 16 KB) goes with the task."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.always is None:
                x = [features(model, t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
                s = score(model.weights, np.array(x).reshape(len(x), -1)) if x else np.zeros(0)
            else:
                s = np.full(batch.num_rows, model.always)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(s)], ["key", "held_out", "score"])

    rows = df.select(
        F.col(f"`{key}`").alias("key"), held_out(key).alias("held_out"), F.encode(F.col(f"`{text}`"), "UTF-8").alias("text")
    )
    return rows.mapInArrow(scored, rows.select("key", "held_out").schema.add("score", "double")).select(
        F.col("key").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
