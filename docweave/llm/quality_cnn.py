"""A byte-level convolutional network in numpy that gives a text the probability of being good.

The text's bytes are cut into overlapping chunks that cover all of it. Each of a few learned filters, WIDTH bytes wide, answers at
every byte; the strongest answer in a chunk is pooled, and the mean and the maximum over chunks of all filters' answers
are combined into one probability. Chunks of CHUNK bytes start every CHUNK / 2, so answers are formed once in halves and a chunk
is the larger of two.

Training sees a bounded sample of labelled rows (max_rows of the fewest md5, of at most max_bytes) and runs on the driver in a
time that doesn't depend on the corpus; scoring is one Arrow pass without a shuffle.

Defined results: null and empty texts are one empty chunk and get a score too; with no labels of both kinds every score is the
share of good labels, or 0.5 without any; repeated rows are scored each; other columns than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import text_groups

WIDTH, FILTERS, CHUNK, PAD = 5, 8, 512, 256
HALF = CHUNK // 2
#: Halves that are convolved at once, and bytes of the texts that are scored together.
BLOCK, BATCH_BYTES = 256, 1 << 19
SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS, BATCH, RATE, SHRINK = 2400, 1 << 15, 8, 48, 0.03, 1e-4


def halves(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in rows of HALF with the WIDTH - 1 that follow (PAD beyond the end), and each text's first row."""
    raw = [(t or "").encode() for t in texts]
    n = np.array([max(1, -(-len(r) // HALF)) for r in raw])
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    out = np.full((int(first[-1]), HALF + WIDTH - 1), PAD, np.uint16)
    for r, at, rows in zip(raw, first, n, strict=False):
        b = np.full(rows * HALF + WIDTH - 1, PAD, np.uint16)
        b[: len(r)] = np.frombuffer(r, np.uint8)
        out[at : at + rows] = np.lib.stride_tricks.sliding_window_view(b, HALF + WIDTH - 1)[::HALF]
    return out, first


@dataclass
class Network:
    """filters: (WIDTH, 257, FILTERS), the last byte value standing for beyond the end; weights of the means, then of the maxima."""

    filters: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float

    def answers(self, rows: np.ndarray) -> np.ndarray:
        out = self.filters[0][rows[:, :HALF]]
        for k in range(1, WIDTH):
            out += self.filters[k][rows[:, k : k + HALF]]
        return out

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The strongest answer of each filter in each half."""
        return np.concatenate([self.answers(rows[i : i + BLOCK]).max(axis=1) for i in range(0, len(rows), BLOCK)]) if len(rows) else np.zeros((0, FILTERS), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        rows, first = halves(texts)
        chunks, at, _ = overlapped(np.tanh(self.pooled(rows) + self.shift), first)
        n = np.diff(at)[:, None]
        found = np.concatenate([np.add.reduceat(chunks, at[:-1]) / n, np.maximum.reduceat(chunks, at[:-1])], axis=1)
        return 1 / (1 + np.exp(-(found @ self.weights + self.bias).astype(np.float64)))


def overlapped(pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of two neighbouring halves of one text (of one, if it has no more), each text's first chunk, and the half each filter's answer is from."""
    n = np.diff(first)
    lone = n == 1
    keep = np.ones(len(pooled), bool)
    keep[first[1:][~lone] - 1] = False
    left = np.flatnonzero(keep)
    right = np.where(np.repeat(lone, n)[left], left, left + 1)
    source = np.where(pooled[right] > pooled[left], right[:, None], left[:, None])
    return np.maximum(pooled[left], pooled[right]), np.concatenate([[0], np.cumsum(np.maximum(1, n - 1))]).astype(np.int64), source


def train(texts: list[str | None], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Stochastic gradient descent (with Adam's steps) on the log loss; gradients pass the maxima to the byte where they were found."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network((rng.standard_normal((WIDTH, PAD + 1, FILTERS)) * 0.15).astype(np.float32), np.zeros(FILTERS, np.float32), (rng.standard_normal(2 * FILTERS) * 0.1).astype(np.float32), float(np.log(share / (1 - share))))
    if len(set(labels)) < 2:
        net.weights[:] = 0
        return net
    state = [net.filters, net.shift, net.weights, np.array([net.bias], np.float32)]
    first_moment, second_moment, step = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state], 0
    rows_all, first_all = halves(texts)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            pick = order[s : s + BATCH]
            spans = [np.arange(first_all[i], first_all[i + 1]) for i in pick]
            rows, first = rows_all[np.concatenate(spans)], np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int64)
            best, where = zip(*((a.max(axis=1), a.argmax(axis=1)) for a in (net.answers(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK))), strict=True)
            active = np.tanh(np.concatenate(best) + net.shift)
            where = np.concatenate(where)
            chunks, at, source = overlapped(active, first)
            n = np.diff(at)[:, None]
            highest = np.maximum.reduceat(chunks, at[:-1])
            found = np.concatenate([np.add.reduceat(chunks, at[:-1]) / n, highest], axis=1)
            p = 1 / (1 + np.exp(-(found @ net.weights + state[3][0])))
            wrong = ((p - y[pick]) / len(pick)).astype(np.float32)
            back = wrong[:, None] * net.weights
            doc = np.repeat(np.arange(len(pick)), n[:, 0])
            top = chunks == highest[doc]
            from_chunks = (back[:, :FILTERS] / n)[doc] + back[:, FILTERS:][doc] * top / np.add.reduceat(top, at[:-1])[doc]
            from_halves = np.zeros_like(active)
            np.add.at(from_halves, (source, np.arange(FILTERS)), from_chunks)
            from_halves *= 1 - active**2
            grad = np.zeros_like(net.filters)
            row = np.arange(len(rows))[:, None]
            for k in range(WIDTH):
                np.add.at(grad[k], (rows[row, where + k], np.arange(FILTERS)), from_halves)
            grads = [grad + SHRINK * net.filters, from_halves.sum(axis=0), found.T @ wrong + SHRINK * net.weights, np.array([wrong.sum()], np.float32)]
            step += 1
            for q, g, a, b in zip(state, grads, first_moment, second_moment, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.bias = float(state[3][0])
    return net


def held_out(id_col: str):
    """Rows that training never sees: every fifth by the checksum of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Network:
    """A network trained on labelled rows of docs that aren't held out: of the first max_rows labels by the id's md5, those with texts of at most max_bytes.

    Of several such texts with one id, the one with the least hash is taken, and of several labels the lower one.
    """
    told = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & ~held_out("_id") & F.col("_id").isNotNull())
    some = told.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).filter(F.octet_length("_text") <= max_bytes)
    # At most max_rows ids: small enough to send to every task.
    each = texts.join(F.broadcast(some), "_id").groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("_hash"), "_text")).alias("_least"))
    rows = sorted(each.select("_id", "_label", "_least._text").collect(), key=lambda r: (str(r["_id"]), r["_text"]))
    return train([r["_text"] for r in rows], [r["_label"] for r in rows])


def score(docs: DataFrame, net: Network, text_col: str = "text", to: str = "score", keep_text: bool = False) -> DataFrame:
    """docs with each row's probability, and without text_col unless it is to be kept (as the last column but one)."""
    import pickle

    from pyspark.sql import types as T

    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))
    rest = [c for c in docs.columns if c not in (text_col, to)]
    fed = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`"))
    names = [*rest, *([text_col] if keep_text else []), to]

    def run(batches: Iterator):
        import pyarrow as pa

        net = pickle.loads(held.value)
        for b in batches:
            text, found = b.column(b.num_columns - 1), [np.zeros(0)]
            found += map(net.score, text_groups(text, BATCH_BYTES))
            yield pa.RecordBatch.from_arrays([*b.columns[: None if keep_text else -1], pa.array(np.concatenate(found))], names=names)

    return fed.mapInArrow(run, T.StructType([*(fed.schema[c] for c in names[:-1]), T.StructField(to, T.DoubleType())]))
