"""Language identification with a byte convolutional network in numpy.

Bytes of a window of fixed length go through an embedding, filters of several
widths, max pooling over the window and a softmax. A text is cut into windows from
its first to its last byte; its label probabilities are the mean over them,
weighted by their bytes. All whole texts are read, batch by batch.

Training takes a bounded sample of labelled rows to the driver: at most
``per_label`` rows of each label, those with the smallest hash of id and text, and at
most ``windows_per_row`` windows of each, spread over the text. Labels are few (they
are the classes of the softmax); more than ``MAX_LABELS`` is an error. The model is a
few kilobytes and goes to the tasks in the function's closure.

Null texts, empty ones and those without a letter are ``und`` with score 0, as are all
texts when no labelled row was given. Rows are judged each for itself, null ids
are kept, other columns than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import encoded, id_out, ids_and_texts, map_texts

MAX_LABELS = 500
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Windows that are convolved at the same time.
BLOCK = 256


@dataclass(frozen=True)
class Settings:
    window: int = 256
    embedding: int = 4
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 8
    per_label: int = 600
    windows_per_row: int = 3
    rounds: int = 30
    rate: float = 0.01
    batch: int = 64
    seed: int = 7


@dataclass
class Model:
    labels: list[str]
    settings: Settings
    table: np.ndarray = field(repr=False)  # byte -> embedding
    kernel: np.ndarray = field(repr=False)  # filters of all widths, padded to the widest
    bias: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)
    offset: np.ndarray = field(repr=False)

    @property
    def widest(self) -> int:
        return max(self.settings.widths)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """Bytes (n, length) to embedded neighbourhoods (n * length, widest * embedding), padded by zero bytes."""
        n, length = windows.shape
        padded = np.zeros((n, length + self.widest - 1), dtype=np.uint8)
        padded[:, :length] = windows
        embedded = self.table[padded].reshape(n, -1)
        size = self.settings.embedding
        views = np.lib.stride_tricks.sliding_window_view(embedded, self.widest * size, axis=1)[:, ::size]
        return np.ascontiguousarray(views).reshape(n * length, -1)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        n, length = windows.shape
        maps = (self._patches(windows) @ self.kernel).reshape(n, length, -1)
        return np.maximum(maps.max(1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """For windows (n, length) of bytes, zero beyond the end of a text."""
        out = np.empty((len(windows), len(self.labels)), dtype=np.float32)
        for at in range(0, len(windows), BLOCK):
            scores = self.pooled(windows[at : at + BLOCK]) @ self.weight + self.offset
            scores = np.exp(scores - scores.max(1, keepdims=True))
            out[at : at + BLOCK] = scores / scores.sum(1, keepdims=True)
        return out


def cut_windows(text: bytes, length: int) -> np.ndarray:
    """The whole text in windows; the last one ends in zero bytes."""
    n = max(1, -(-len(text) // length))
    return np.frombuffer(text.ljust(n * length, b"\0"), dtype=np.uint8).reshape(n, length)


def train(texts: list[bytes], labels: list[str], settings: Settings = Settings()) -> Model | None:
    """Train on windows spread over each text."""
    cut = []
    for text in texts:
        windows = cut_windows(text, settings.window)
        cut.append(windows[np.unique(np.linspace(0, len(windows) - 1, settings.windows_per_row).round().astype(int))])
    return train_on_windows(cut, labels, settings)


def train_on_windows(cut: list[np.ndarray], labels: list[str], settings: Settings = Settings()) -> Model | None:
    """Adam on the cross-entropy; the same rows in the same order give the same model."""
    s, names = settings, sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(s.seed)
    of = [names.index(label) for windows, label in zip(cut, labels) for _ in windows]
    x, y = np.concatenate(cut), np.array(of)
    widest, maps = max(s.widths), s.filters * len(s.widths)
    mask = np.zeros((widest * s.embedding, maps), dtype=np.float32)
    for k, width in enumerate(s.widths):
        mask[: width * s.embedding, k * s.filters : (k + 1) * s.filters] = 1
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    model = Model(
        names, s, normal(256, s.embedding, scale=1.0), normal(*mask.shape, scale=0.3) * mask,
        np.zeros(maps, np.float32), normal(maps, len(names), scale=0.2), np.zeros(len(names), np.float32),
    )
    model.table[0] = 0
    # rare labels count as much as frequent ones
    share = np.bincount(y, minlength=len(names))
    weight_of = (len(y) / (len(names) * np.maximum(share, 1))).astype(np.float32)
    moments = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in ("table", "kernel", "bias", "weight", "offset")}
    step = 0
    for _ in range(s.rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), s.batch):
            rows = order[at : at + s.batch]
            step += 1
            for name, slope in _slopes(model, x[rows], y[rows], weight_of, mask).items():
                m, v = moments[name]
                m *= 0.9
                m += 0.1 * slope
                v *= 0.999
                v += 0.001 * slope * slope
                change = s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                getattr(model, name).__isub__(change.astype(np.float32))
    return model


def _slopes(model: Model, x: np.ndarray, y: np.ndarray, weight_of: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    n, length = x.shape
    patches = model._patches(x)
    maps = (patches @ model.kernel).reshape(n, length, -1)
    top = maps.argmax(1)  # (n, filters)
    value = np.take_along_axis(maps, top[:, None], 1)[:, 0] + model.bias
    hidden = np.maximum(value, 0)
    scores = hidden @ model.weight + model.offset
    scores = np.exp(scores - scores.max(1, keepdims=True))
    scores /= scores.sum(1, keepdims=True)
    scores[np.arange(n), y] -= 1
    scores *= weight_of[y][:, None] / n
    back = (scores @ model.weight.T) * (value > 0)
    # only the place of the maximum of each filter has a slope
    rows = np.arange(n)[:, None] * length + top
    at_top = patches[rows]  # (n, filters, widest * embedding)
    kernel = np.einsum("nf,nfk->kf", back, at_top) * mask
    to_patch = back[:, :, None] * model.kernel.T[None]  # (n, filters, widest * embedding)
    table = np.zeros_like(model.table)
    padded = np.zeros((n, length + model.widest - 1), dtype=np.uint8)
    padded[:, :length] = x
    size = model.settings.embedding
    for k in range(model.widest):
        np.add.at(table, padded[np.arange(n)[:, None], top + k], to_patch[:, :, k * size : (k + 1) * size])
    table[0] = 0
    return {
        "kernel": kernel, "table": table, "bias": back.sum(0), "weight": hidden.T @ scores, "offset": scores.sum(0),
    }


def spread_windows(text: Column, settings: Settings) -> Column:
    """The windows of a text that training takes, as ``train`` does: first, last and evenly between; bytes, the last one short."""
    data = F.encode(text, "UTF-8")
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(data) / settings.window) - 1)
    steps = max(1, settings.windows_per_row - 1)
    picks = [F.bround(last * F.lit(float(k)) / F.lit(float(steps))).cast("int") for k in range(settings.windows_per_row)]
    return F.transform(F.array_distinct(F.array(*picks)), lambda at: F.substring(data, at * settings.window + 1, F.lit(settings.window)))


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Train on a bounded sample of the rows with a label and a letter.

    Windows are cut before rows are drawn, so neither a task nor the driver holds whole
    texts: the driver gets ``2 * per_label * windows_per_row`` windows for each label.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
    ).where(r"label IS NOT NULL AND text RLIKE '\\p{L}'")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if not counts:
        return None
    # the rows below a hash mark that leaves half as many again, then the smallest hashes of those
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    marks = [(r.label, int(min(1.0, 1.5 * settings.per_label / r.n) * (1 << 30))) for r in sorted(counts)]
    below = None
    for label, mark in marks:
        own = (F.col("label") == label) & (F.col("_draw") <= mark)
        below = own if below is None else below | own
    near = rows.withColumn("_draw", draw).where(below)
    near = near.select("label", "_draw", "doc_id", spread_windows(F.col("text"), settings).alias("windows"))
    bound = len(marks) * settings.per_label
    sample = near.orderBy("_draw", "doc_id", "windows").limit(2 * bound).collect()
    cut, labels, taken = [], [], dict.fromkeys([m[0] for m in marks], 0)
    for row in sample:
        if taken[row.label] < settings.per_label:
            taken[row.label] += 1
            cut.append(np.concatenate([cut_windows(bytes(w), settings.window) for w in row.windows]))
            labels.append(row.label)
    return train_on_windows(cut, labels, settings)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of each row, from its text alone."""

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = encoded(batch, "text")
            labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model and LETTER.search(t.decode())]
            for at in range(0, len(known), BLOCK):
                some = known[at : at + BLOCK]
                for i, mean in zip(some, _means(model, [texts[i] for i in some])):
                    labels[i], scores[i] = model.labels[int(mean.argmax())], min(1.0, float(mean.max()))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

        return step

    rows = ids_and_texts(docs, id_col, text_col)
    return map_texts(rows, build, "doc_id long, lang_pred string, score double").select(id_out(), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model | None, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of texts that have a letter and a language with ``min_score`` at least.

    Without a model (no labelled rows) only texts without a letter go.
    """

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = encoded(batch, text_col)
            keep = np.array([bool(LETTER.search(t.decode())) for t in texts], dtype=bool)
            known = np.flatnonzero(keep) if model else []
            for at in range(0, len(known), BLOCK):
                some = known[at : at + BLOCK]
                keep[some] = _means(model, [texts[i] for i in some]).max(1) >= min_score
            return batch.filter(pa.array(keep))

        return step

    return map_texts(docs, build, docs.schema)


def _means(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities of each text."""
    length = model.settings.window
    cut = [cut_windows(t, length) for t in texts]
    chances = model.probabilities(np.concatenate(cut))
    counts = np.array([len(c) for c in cut])
    weights = np.full(len(chances), length, dtype=np.float64)
    ends = np.cumsum(counts)
    weights[ends - 1] = [len(t) - (len(c) - 1) * length for t, c in zip(texts, cut)]
    sums = np.add.reduceat(chances * weights[:, None], ends - counts, axis=0)
    return sums / np.array([len(t) for t in texts])[:, None]
