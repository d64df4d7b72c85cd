"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words and word shapes hash into a fixed number of bins. Each bin has a sparse random index vector; its context
vector is the sum of the index vectors that stand near it, counted in whole numbers over every text of the corpus.
A document is the mean of its bins' context and index vectors. A network of two layers is fitted with numpy on a
bounded sample of labelled documents, and a temperature chosen on a part of that sample calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import small_batches

BINS, DIMS, NONZERO, REACH = 8192, 48, 4, 2
#: The most labelled rows that a fit sees, and the most word forms that a worker remembers.
FIT_ROWS, REMEMBERED = 20_000, 150_000
THRESHOLD = 0.3
#: Tokens at which a text's own features weigh one half.
DOUBT = 32
_SHAPE = re.compile(r"[^\W\d_]+")


class _Bins(dict):
    """Word form -> its bin and, 16 bits higher, the bin of its shape."""

    def __missing__(self, form: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        text = form.decode("utf-8", "replace")
        letters = "".join(_SHAPE.findall(text))
        rest = _SHAPE.sub("a", text)
        case = "u" if len(letters) > 1 and letters.isupper() else "t" if letters[:1].isupper() else "l"
        core = zlib.crc32(letters.lower().encode()) % (BINS - 2)
        shape = zlib.crc32(f"\0{case}{rest}{len(letters) // 12}".encode()) % (BINS - 2)
        found = core | shape << 16
        if len(form) <= 64:
            self[form] = found
        return found


REPEATED = BINS - 1


def tokens(body: bytes, bins: _Bins) -> np.ndarray:
    """The bins of a text: for each word its own and that of its shape, or REPEATED where the word before is the same."""
    both = np.fromiter(map(bins.__getitem__, body.split()), np.int32)
    out = np.empty(2 * len(both), np.int32)
    out[::2], out[1::2] = both & 0xFFFF, both >> 16
    if len(both) > 1:
        out[3::2][both[1:] == both[:-1]] = REPEATED
    return out


def index_vectors() -> np.ndarray:
    """Sparse random vectors of the bins: the same in every task, so they are never sent."""
    draw = np.random.default_rng(20_240_229)
    out = np.zeros((BINS, DIMS), np.int8)
    rows = np.repeat(np.arange(BINS), NONZERO)
    out[rows, draw.permuted(np.tile(np.arange(DIMS), (BINS, 1)), axis=1)[:, :NONZERO].ravel()] = draw.choice([-1, 1], BINS * NONZERO)
    return out


def _bodies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))


def context_sums(texts: Iterator[np.ndarray]) -> np.ndarray:
    """Sums of the index vectors that stand within 2 * REACH places of each bin, in whole numbers. Contexts end with their text.

    Texts are worked on in a row, with a wall of empty places behind each that is as wide as a context reaches.
    """
    index, reach = index_vectors(), 2 * REACH
    at = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]  # where each bin's non-zero entries stand
    sign = np.take_along_axis(index, at, 1).astype(np.float64)
    at, sign = np.vstack([at, at[:1]]), np.vstack([sign, np.zeros((1, NONZERO))])  # the bin of the wall adds nothing
    total = np.zeros((BINS + 1) * DIMS, np.int64)
    wall = np.full(reach, BINS, np.int32)

    def add(row: np.ndarray) -> None:
        for low in range(0, len(row), 600_000):
            high = min(len(row), low + 600_000)
            for step in range(1, reach + 1):
                left, right = row[low : min(high, len(row) - step)], row[low + step : min(high, len(row) - step) + step]
                for here, near in ((right, left), (left, right)):
                    for k in range(NONZERO):
                        total[:] += np.bincount(here.astype(np.int64) * DIMS + at[near, k], sign[near, k], len(total)).astype(np.int64)

    held, size = [], 0
    for seq in texts:
        held += [seq, wall]
        size += len(seq) + reach
        if size > 300_000:
            add(np.concatenate(held))
            held, size = [], 0
    if size:
        add(np.concatenate(held))
    return total[: BINS * DIMS]


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bins = _Bins()
    total = context_sums(tokens(body, bins) for batch in batches for body in batch["body"])
    yield pd.DataFrame({"sums": [total.tobytes()]})


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BINS * DIMS, np.int64)
    for batch in batches:
        for one in batch["sums"]:
            total += np.frombuffer(one, np.int64)
    yield pd.DataFrame({"sums": [total.tobytes()]})


def context_vectors(df: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Unit context vectors of the bins over all of df. One table of 3 MB a partition, summed 16 to 1 in rounds."""
    parts = _bodies(df, id_col, text_col).mapInPandas(_contexts, "sums binary")
    left = max(1, df.rdd.getNumPartitions())
    while left > 1:
        left = -(-left // 16)
        parts = parts.repartition(left).mapInPandas(_summed, "sums binary")
    total = np.zeros(BINS * DIMS, np.int64)
    for row in parts.collect():
        total += np.frombuffer(row["sums"], np.int64)
    vectors = total.reshape(BINS, DIMS).astype(np.float64)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)


def _pooled(body: bytes, bins: _Bins, table: np.ndarray) -> np.ndarray:
    seq = tokens(body, bins)
    count = np.bincount(seq, minlength=BINS)
    seen = np.flatnonzero(count)
    mean = count[seen] @ table[seen] / max(1, len(seq))
    return np.append(mean, np.log1p(len(seq)))


def _scaled(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features, drawn to the centre where a text has few tokens: a mean of a handful says little."""
    tokens = np.expm1(x[:, -1:])
    return (x - centre) / spread * (tokens / (tokens + DOUBT))


@dataclass
class QualityModel:
    """Word vectors, network and temperature: about 7 MB, whatever the corpus."""

    table: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(_scaled(x, self.centre, self.spread) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(table: np.ndarray, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, hidden: int = 24, rounds: int = 60) -> QualityModel:
    """Adam on the rows outside calibrate; the temperature is the best of a grid on the rows inside it."""
    draw = np.random.default_rng(7)
    fit_x, fit_y = (x[~calibrate], y[~calibrate]) if (~calibrate).any() else (x, y)
    centre, spread = fit_x.mean(0), fit_x.std(0) + 1e-6
    model = QualityModel(table, centre, spread, draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z = _scaled(fit_x, centre, spread)
    weights = [model.w1, model.b1, model.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(rounds):
        order = draw.permutation(len(z))
        for k in range(0, len(z), 256):
            rows = order[k : k + 256]
            hid = np.tanh(z[rows] @ weights[0] + weights[1])
            off = (1 / (1 + np.exp(-(hid @ weights[2] + weights[3]))) - fit_y[rows]) / len(rows)
            back = np.outer(off, weights[2]) * (1 - hid**2)
            slopes = [z[rows].T @ back + 1e-4 * weights[0], back.sum(0), hid.T @ off + 1e-4 * weights[2], off.sum(keepdims=True)]
            step += 1
            for w, m, v, g in zip(weights, first, second, slopes, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.b2 = float(weights[3][0])
    if calibrate.any():
        logits = model.logits(x[calibrate])
        model.temperature = float(min(np.geomspace(0.25, 8, 60), key=lambda t: _loss(logits / t, y[calibrate])))
    return model


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Word vectors from all of df, network from at most fit_rows labelled rows, chosen by a hash of the identifier.

    Rows with a null identifier or label teach nothing; an identifier with several labels takes the largest. Of rows
    that repeat an identifier each may teach, but fit_rows bounds the rows that reach the driver, whatever repeats.
    Without labelled rows every score is the same one half.
    """
    context = context_vectors(df, id_col, text_col)
    table = np.hstack([context, index_vectors() / np.sqrt(NONZERO)])
    known = labels.select(F.col(id_col).alias("known"), F.col(label_col).alias("label")).dropna().groupBy("known").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("known"), "known").limit(fit_rows).toPandas()  # fit_rows bounds it
    ids = df.sparkSession.createDataFrame(sample.astype({"known": "int64", "label": "int64"}) if len(sample) else [], "known long, label long")
    width = table.shape[1] + 1

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = _Bins()
        for batch in batches:
            rows = [_pooled(x, bins, table).astype(np.float32).tobytes() for x in batch["body"]]
            yield pd.DataFrame({"doc": batch["doc"], "label": batch["label"], "x": rows})

    taught = _bodies(df, id_col, text_col).join(F.broadcast(ids), F.col("doc") == F.col("known")).select("doc", "label", "body")
    few = taught.mapInPandas(pooled, "doc long, label long, x binary").orderBy(F.xxhash64("doc"), "doc", F.xxhash64("x"), "x").limit(fit_rows)
    rows = few.toPandas()
    if rows.empty or rows["label"].nunique() < 2:
        same = 0.0 if rows.empty else 4.0 if rows["label"].iloc[0] >= 1 else -4.0
        return QualityModel(table, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), same)
    rows = rows.sort_values(["doc", "x"])
    x = np.stack([np.frombuffer(v, np.float32) for v in rows["x"]]).astype(np.float64)
    part = np.array([zlib.crc32(f"calibrate {d}".encode()) % 6 == 0 for d in rows["doc"]])
    return fit_network(table, x, (rows["label"].to_numpy() >= 1).astype(np.float64), part)


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, score for each row, whole texts; null texts are scored as empty ones. No shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # of fixed size, see QualityModel

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bins = sent.value, _Bins()
        for batch in batches:
            x = [_pooled(body.as_py(), bins, model.table) for body in batch["body"]]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(model.probability(np.stack(x)) if x else np.zeros(0))], ["doc", "score"])

    rows = _bodies(df, id_col, text_col)
    return rows.mapInArrow(scored, f"doc {dict(rows.dtypes)['doc']}, score double")


def held_out(id_col: str) -> F.Column:
    """The fifth of the identifiers whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def drop_rejected(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that score below threshold, with its own columns. Rows that repeat an identifier are judged one by one.

    The text travels with the score, so no row is looked up by its identifier.
    """
    model = fit(df, labels.where(~held_out(id_col)), id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    inner = [f"c{k}" for k in range(len(names))]
    rows = df.toDF(*inner)
    column = inner[names.index(text_col)]

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bins = sent.value, _Bins()
        for batch in batches:
            if len(batch):
                x = np.stack([_pooled(body.as_py() or b"", bins, model.table) for body in batch[column].cast(pa.binary())])
                yield batch.filter(pa.array(model.probability(x) >= threshold))

    return rows.mapInArrow(passed, rows.schema).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels.where(~held_out("doc_id")))
    scored = score(docs, model)
    return scored.select(F.col("doc").alias("doc_id"), held_out("doc").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
