"""Quality by a byte-level convolutional network, trained and run in numpy.

Bytes are embedded; learned filters of ``WIDTH`` bytes slide over every byte; each chunk
of the text keeps the largest response of each filter (chunks overlap by ``WIDTH - 1``
bytes, so no window is lost between two); the mean, the largest and the least of the
chunks' responses go to one logistic unit. A text of any length is covered whole, a slab
of chunks at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.llm.common import add_columns, sample_texts, small_batches

#: Labelled texts sampled to train on (by a hash of their id).
SAMPLE = 4000
#: Numbers per byte, bytes per filter, filters; chunks advance by STRIDE = WIDTH * STEPS bytes.
DIM, WIDTH, FILTERS, STEPS = 6, 7, 32, 36
STRIDE = WIDTH * STEPS
#: Chunks in one matrix product; texts in a training step, passes, rate.
SLAB, BATCH, EPOCHS, RATE = 1024, 32, 10, 0.01


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    shift: np.ndarray  # FILTERS
    head: np.ndarray  # 3 * FILTERS
    bias: np.ndarray  # 1

    @classmethod
    def new(cls, seed: int = 0, bias: float = 0.0) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return cls(make(0.5, 256, DIM), make(0.3, WIDTH * DIM, FILTERS), np.zeros(FILTERS, np.float32), make(0.1, 3 * FILTERS), np.array([bias], np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.head, self.bias]


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, chunks per text)``: a row of bytes per chunk, with the first WIDTH bytes of
    what follows it in its text; beyond the text's end zero bytes."""
    chunks = np.array([max(1, -(-len(t) // STRIDE)) for t in texts], np.int64)
    out = np.zeros((int(chunks.sum()), STRIDE + WIDTH), np.uint8)
    at = 0
    for t, n in zip(texts, chunks.tolist(), strict=True):
        padded = np.zeros(n * STRIDE + WIDTH, np.uint8)
        padded[: len(t)] = np.frombuffer(t, np.uint8)
        out[at : at + n, :STRIDE] = padded[: n * STRIDE].reshape(n, STRIDE)
        out[at : at + n, STRIDE:] = padded[STRIDE + np.arange(n)[:, None] * STRIDE + np.arange(WIDTH)]
        at += n
    return out, chunks


def respond(net: Network, data: np.ndarray, chunks: int, places: bool = False):
    """Largest response of each filter per chunk, and where in its row the window starts.

    A window starts in its chunk and may reach ``WIDTH - 1`` bytes into the next. Windows
    that start at the same offset modulo WIDTH lie end to end, so that each of the WIDTH
    products needs no copy; the last one of a row is not the chunk's own.
    """
    out = np.empty((chunks, FILTERS), np.float32)
    where = np.empty((chunks, FILTERS), np.int64) if places else None
    for a in range(0, chunks, SLAB):
        b = min(chunks, a + SLAB)
        e = np.zeros(((b - a) * (STRIDE + WIDTH) + WIDTH, DIM), np.float32)
        e[:-WIDTH] = net.embed[data[a:b].ravel()]
        for r in range(WIDTH):
            windows = e[r : r + (b - a) * (STRIDE + WIDTH)].reshape(-1, WIDTH * DIM)
            y = (windows @ net.filters).reshape(b - a, STEPS + 1, FILTERS)[:, :STEPS]
            if places:
                k = y.argmax(1)
                y = np.take_along_axis(y, k[:, None], 1)[:, 0]
                start = k * WIDTH + r
            else:
                y = y.max(1)
            if r == 0:
                out[a:b] = y
                if places:
                    where[a:b] = start
            else:
                if places:
                    where[a:b] = np.where(y > out[a:b], start, where[a:b])
                np.maximum(out[a:b], y, out=out[a:b])
    return np.maximum(out + net.shift, 0), where


def combine(z: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Mean, largest and least of the chunks' responses, per text."""
    at = np.cumsum(chunks) - chunks
    mean = np.add.reduceat(z, at, axis=0) / chunks[:, None]
    return np.concatenate((mean, np.maximum.reduceat(z, at, axis=0), np.minimum.reduceat(z, at, axis=0)), axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def score(net: Network, texts: list[str | None]) -> np.ndarray:
    """The probability of label 1 of each whole text."""
    if not texts:
        return np.zeros(0)
    data, chunks = lay_out([(t or "").encode("utf-8", "replace") for t in texts])
    z, _ = respond(net, data, int(chunks.sum()))
    return sigmoid(combine(z, chunks) @ net.head + net.bias[0]).astype(float)


def gradients(net: Network, texts: list[bytes], y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy and its gradient by each parameter."""
    data, chunks = lay_out(texts)
    n, total = len(texts), int(chunks.sum())
    z, where = respond(net, data, total, places=True)
    x = combine(z, chunks)
    p = sigmoid(x @ net.head + net.bias[0])
    loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
    d = ((p - y) / n).astype(np.float32)
    owner = np.repeat(np.arange(n), chunks)
    top, low = x[:, FILTERS : 2 * FILTERS], x[:, 2 * FILTERS :]
    dx = d[:, None] * net.head[None]
    dz = dx[owner, :FILTERS] / chunks[owner][:, None]
    at = np.cumsum(chunks) - chunks
    for part, best in ((dx[:, FILTERS : 2 * FILTERS], top), (dx[:, 2 * FILTERS :], low)):
        hit = (z == best[owner]).astype(np.float32)
        dz += hit / np.add.reduceat(hit, at, axis=0)[owner] * part[owner]
    dz *= z > 0
    c, f = np.nonzero(dz)
    g = dz[c, f]
    seen = data[c[:, None], where[c, f][:, None] + np.arange(WIDTH)]
    windows = net.embed[seen].reshape(-1, WIDTH * DIM)
    one = np.zeros((len(g), FILTERS), np.float32)
    one[np.arange(len(g)), f] = g
    back = (g[:, None] * net.filters.T[f]).reshape(-1, DIM)
    embed = np.stack([np.bincount(seen.ravel(), back[:, j], 256) for j in range(DIM)], axis=1)
    return float(loss), [embed.astype(np.float32), windows.T @ one, dz.sum(0), x.T @ d, d.sum(keepdims=True)]


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 0) -> Network:
    """Adam on mean cross-entropy, texts in a random order each pass.

    Without labels, or with one label only, the network answers that label's share.
    """
    y = np.array(labels, np.float32)
    share = (y.sum() + 0.5) / (len(y) + 1)
    net = Network.new(seed, float(np.log(share / (1 - share))))
    if len(set(labels)) < 2:
        net.head[:] = 0
        return net
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    rng, params = np.random.default_rng(seed), net.params()
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    steps = epochs * -(-len(data) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            _, grads = gradients(net, [data[i] for i in part], y[part])
            step += 1
            rate = RATE * (1 - step / (steps + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * a / (np.sqrt(b) + 1e-8)
    return net


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Train on at most ``sample`` labelled rows among those ``learn_from`` (a condition on
    the id), and on as many whole texts as keep within a bound of characters. Where an id has
    several labels the largest counts."""
    known = labels.where(learn_from & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(id_col, F.col(label_col).cast("int").alias("label")).groupBy(id_col).agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = sample_texts(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col), sample, id_col, text_col)
    table = rows.select(text_col, "label").toArrow()
    return train(table.column(0).to_pylist(), table.column(1).to_pylist())


def classify(docs: DataFrame, net: Network, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability that the whole text has label 1.
    ``keep``: the columns to return beside it.

    Null texts are scored as empty ones (a chunk of padding). Only the text is looked at.
    Repeated rows and null ids are answered row by row; a column named like the new one is
    replaced; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    return add_columns(docs, text_col, lambda: lambda texts: [pa.array(score(sent.value, texts), pa.float64())], "score double", keep)
