"""Language identification by a byte convolutional network, written and trained in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

WINDOW = 128  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16  # per width
SAMPLE = 1_000  # labelled documents per language to learn from, at most
CUTS = (128, 128, 48, 16)  # characters of the windows taken from each of them
STEPS = 500  # of training at least
CHUNK = 256  # windows computed at once
UNKNOWN = "und"


@dataclass
class ByteCnn:
    """Per width w: a table (w, 256, FILTERS) that gives each byte's part in each filter."""

    labels: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def new(labels: list[str], seed: int = 0) -> ByteCnn:
        rng = np.random.default_rng(seed)
        tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        size = FILTERS * len(WIDTHS)
        return ByteCnn(labels, tables, np.zeros(size, np.float32),
                       rng.normal(0, 0.1, (size, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def pooled(self, data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of each filter over each window (before the bias), and where it stands."""
        best, places = [], []
        for w, table in zip(WIDTHS, self.tables):
            n = data.shape[1] - w + 1
            conv = sum(table[k][data[:, k: k + n]] for k in range(w))
            at = conv.argmax(axis=1)
            best.append(np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0, :])
            places.append(at)
        return np.concatenate(best, axis=1), places

    def train(self, data: np.ndarray, target: np.ndarray, rate: float = 0.01, batch: int = 256) -> ByteCnn:
        """Cross-entropy with Adam; max pooling sends each gradient to one place of a window."""
        rng = np.random.default_rng(1)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        mean, square, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(max(8, -(-STEPS * batch // len(data)))):
            order = rng.permutation(len(data))
            for start in range(0, len(data), batch):
                some = order[start: start + batch]
                x, y = data[some], target[some]
                value, places = self.pooled(x)
                hidden = np.maximum(value + self.bias, 0)
                p = _softmax(hidden @ self.out + self.out_bias)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.out.T) * (hidden > 0)
                grads = []
                for i, (w, at) in enumerate(zip(WIDTHS, places)):
                    g = np.zeros_like(self.tables[i])
                    part = back[:, i * FILTERS: (i + 1) * FILTERS]
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(x, at + k, axis=1), np.arange(FILTERS)), part)
                    g[:, 0] = 0  # byte 0 pads and stays zero
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                t += 1
                for q, g, m, s in zip(params, grads, mean, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        return self


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Reader:
    """A trained network for many windows: two neighbouring bytes are looked up at once."""

    def __init__(self, net: ByteCnn):
        self.net = net
        for t in net.tables:
            t[:, 0] = 0
        self.pairs = [[(t[k][:, None] + t[k + 1][None]).reshape(-1, FILTERS) for k in range(0, w - 1, 2)]
                      for w, t in zip(WIDTHS, net.tables)]

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """Softmax of each window (rows of bytes)."""
        out = []
        for start in range(0, len(data), CHUNK):
            x = data[start: start + CHUNK].astype(np.intp)
            two = x[:, :-1] * 256 + x[:, 1:]
            best = []
            for w, table, pairs in zip(WIDTHS, self.net.tables, self.pairs):
                n = x.shape[1] - w + 1
                conv = pairs[0].take(two[:, :n], axis=0)
                for k, p in enumerate(pairs[1:], 1):
                    conv += p.take(two[:, 2 * k: 2 * k + n], axis=0)
                if w % 2:
                    conv += table[w - 1].take(x[:, w - 1:], axis=0)
                best.append(conv.max(axis=1))
            hidden = np.maximum(np.concatenate(best, axis=1) + self.net.bias, 0)
            out.append(_softmax(hidden @ self.net.out + self.net.out_bias))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Label, score (its mean probability over all bytes) and certainty of each whole text.

        certainty: mean over all bytes of the probability of each window's own best label.
        """
        labels, scores, certain = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.net.labels:
            return labels, scores, certain
        start = 0
        while start < len(texts):  # about 4 MB of text at a time; a longer one by itself
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < 1 << 22):
                size += len(texts[stop] or "")
                stop += 1
            known = [i for i in range(start, stop) if texts[i] and has_letter(texts[i])]
            start = stop
            if not known:
                continue
            raw = [texts[i].lower().encode() for i in known]
            data = windows(raw)
            n = np.array([-(-len(r) // WINDOW) for r in raw])
            weight = (data != 0).sum(axis=1)[:, None]
            first = np.cumsum(n) - n
            each = self.probabilities(data)
            whole = np.maximum(np.add.reduceat(weight, first), 1)
            p = np.add.reduceat(each * weight, first) / whole
            best = np.add.reduceat(each.max(axis=1)[:, None] * weight, first) / whole
            for i, row, sure in zip(known, p, best[:, 0]):
                k = int(row.argmax())
                labels[i], scores[i], certain[i] = self.net.labels[k], min(1.0, float(row[k])), min(1.0, float(sure))
        return labels, scores, certain


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows(raw: list[bytes]) -> np.ndarray:
    """All bytes of non-empty texts, each cut into windows; the last is padded with zeros."""
    padded = b"".join(r.ljust(-(-len(r) // WINDOW) * WINDOW, b"\0") for r in raw)
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)


def learn(labelled: DataFrame, key: str = "id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> ByteCnn:
    """Fits the network on the driver from a bounded sample of rows with a label.

    At most ``sample`` documents per language, by least hash of the key, with a few
    windows each at hashed places: some hundred bytes a document, whatever the corpus.
    A count per language gives the hash below which about that many lie, so nothing
    is sorted.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40)).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return ByteCnn.new([])
    below = F.lit(1 << 40)
    for k, n in counts.items():
        below = F.when(F.col("lang") == k, F.lit(min(1 << 40, int((1 << 40) * 1.2 * sample / n) + 1))).otherwise(below)
    room = [F.greatest(F.char_length("text") - n, F.lit(0)) + 1 for n in CUTS]
    cuts = [F.substr("text", F.pmod(F.xxhash64("h", F.lit(i)), room[i]).cast("int") + 1, F.lit(n)).alias(f"w{i}")
            for i, n in enumerate(CUTS)]
    found = sorted(rows.where(F.col("h") < below).select("lang", "h", *cuts).collect())
    taken, kept = dict.fromkeys(counts, 0), []
    for r in found:
        if taken[r["lang"]] < sample:
            taken[r["lang"]] += 1
            kept += [(w, r["lang"]) for w in r[2:] if w and has_letter(w)]
    labels = sorted({k for _, k in kept})
    net = ByteCnn.new(labels)
    if len(labels) > 1:
        raw = np.concatenate([windows([w.lower().encode()[:WINDOW]]) for w, _ in kept])
        net.train(raw, np.array([labels.index(k) for _, k in kept]))
    return net


@lru_cache(maxsize=1)
def _reader(model: bytes) -> Reader:
    return Reader(pickle.loads(model))


def identify(
    docs: DataFrame, net: ByteCnn, *keep: Column | str, text_col: str = "text", label_col: str = "lang_pred",
    score_col: str = "score", certain_col: str | None = None,
) -> DataFrame:
    """``keep`` with label and score for every row, from its whole text; certainty too if it has a name.

    Null texts and texts without a letter are ``und`` with score 0, as is everything
    when nothing could be learned. Repeated rows are rows; an empty table gives an
    empty one. Rows keep their partition; no shuffle.
    """
    rows = docs.select(*keep)
    kept = rows.schema
    at = keep.index(text_col) if text_col in [k for k in keep if isinstance(k, str)] else len(keep)
    if at == len(keep):
        rows = docs.select(*keep, docs[text_col].alias("text to read"))
    schema = StructType([*kept.fields, StructField(label_col, StringType()), StructField(score_col, DoubleType())])
    if certain_col:
        schema = schema.add(certain_col, DoubleType())
    names, width = schema.names, len(kept)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared.value)
        for b in batches:
            labels, *numbers = reader.predict(b.column(at).to_pylist())
            arrays = [*b.columns[:width], pa.array(labels, pa.string()), *[pa.array(x, pa.float64()) for x in numbers]]
            yield pa.RecordBatch.from_arrays(arrays[:len(names)], names)

    return rows.mapInArrow(run, schema)
