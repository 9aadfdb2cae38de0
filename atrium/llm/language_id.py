"""Operator 8: language identification by a byte convolutional network, in numpy.

A text's UTF-8 bytes are cut into windows of 256.  Each byte has a small learned vector; filters of
width 2, 3 and 4 slide over them, the maximum of each filter over the window is taken (ReLU first), and a
linear layer gives a logit for each language.  A text's logits are the mean over its windows by their
bytes, so every byte counts.  Training uses windows of a bounded sample of labelled rows, drawn from all places
of their texts by hash.

Defined cases: text that is null or has no letter is "und" with score 0, and so is everything if there are no
labelled rows; rows without a language are not learned from; every row of the input gives a row, and equal texts the same label and score to the last bit, whatever their neighbours; equal
logits go to the language that is first by name; an empty table gives no row; a text of any length is cut into windows whole, and its
windows are looked at 64 at a time; only the id, the text and the columns asked for are read, whatever the names of others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrium.llm.common import short_batches, smallest

WINDOW = 256
WIDTHS = (2, 3, 4)
_LETTER = regex.compile(r"\p{L}")


def _columns(x: np.ndarray, width: int) -> np.ndarray:
    """(n, length, d) -> (n, length - width + 1, width * d): what each filter place sees."""
    n, length, d = x.shape
    x = np.ascontiguousarray(x)
    view = np.lib.stride_tricks.as_strided(x, (n, length - width + 1, width * d), (x.strides[0], x.strides[1], x.strides[2]))
    return np.ascontiguousarray(view)


@dataclass
class Network:
    labels: list[str]
    vectors: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    out_shift: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], d: int = 4, filters: int = 16, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        vectors = rng.standard_normal((256, d)).astype("float32") * 0.5
        vectors[0] = 0
        made = [(rng.standard_normal((w * d, filters)) / np.sqrt(w * d)).astype("float32") for w in WIDTHS]
        size = filters * len(WIDTHS)
        return cls(labels, vectors, made, [np.zeros(filters, "float32") for _ in WIDTHS], np.zeros((size, len(labels)), "float32"), np.zeros(len(labels), "float32"))

    def responses(self) -> list[list[np.ndarray]]:
        """For each width and place within it, what each of the 256 bytes adds to each filter."""
        d = self.vectors.shape[1]
        return [[self.vectors @ f[o * d : (o + 1) * d] for o in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]

    def pooled(self, windows: np.ndarray, responses: list[list[np.ndarray]] | None = None) -> np.ndarray:
        """The filters' maxima over each window, 64 windows at a time (memory stays in cache).

        Every number is a sum of table entries in a fixed order, so a window's are the same to the last bit whatever stands beside it;
        products of matrices would round by the shape of the block.
        """
        responses, parts = responses or self.responses(), []
        for i in range(0, len(windows), 64):
            codes, row = windows[i : i + 64].astype("intp"), []
            for tables, shift in zip(responses, self.shifts, strict=True):
                n = codes.shape[1] - len(tables) + 1
                z = np.take(tables[0], codes[:, :n], axis=0)
                for o in range(1, len(tables)):
                    z += np.take(tables[o], codes[:, o : o + n], axis=0)
                row.append(np.maximum(z.max(axis=1) + shift, 0))
            parts.append(np.concatenate(row, axis=1))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.out)), "float32")

    def logits(self, windows: np.ndarray, responses: list[list[np.ndarray]] | None = None) -> np.ndarray:
        total = np.zeros((len(windows), len(self.labels)), "float32")
        for hidden, weights in zip(self.pooled(windows, responses).T, self.out, strict=True):  # in this order for every window
            total += hidden[:, None] * weights
        return total + self.out_shift

    def train(self, windows: np.ndarray, truth: np.ndarray, epochs: int = 4, least_steps: int = 600, batch: int = 64, rate: float = 0.01, seed: int = 4) -> None:
        """Adam on the softmax loss; only the places of the maxima have a gradient."""
        rng = np.random.default_rng(seed)
        weights = [self.vectors, *self.filters, *self.shifts, self.out, self.out_shift]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step, k = 0, len(WIDTHS)
        epochs = max(epochs, -(-least_steps * batch // len(windows)))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                raw = windows[chosen]
                x = self.vectors[raw]
                cols = [_columns(x, w) for w in WIDTHS]
                z = [c @ f + s for c, f, s in zip(cols, self.filters, self.shifts, strict=True)]
                best = [v.argmax(axis=1) for v in z]
                top = [np.take_along_axis(v, b[:, None], 1)[:, 0] for v, b in zip(z, best, strict=True)]
                hidden = np.maximum(np.concatenate(top, axis=1), 0)
                score = hidden @ self.out + self.out_shift
                p = np.exp(score - score.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(chosen)), truth[chosen]] -= 1
                p /= len(chosen)
                back = (p @ self.out.T) * (hidden > 0)
                grads = [np.zeros_like(self.vectors), *[np.zeros_like(f) for f in self.filters], *[None] * k, hidden.T @ p, p.sum(axis=0)]
                for i, w in enumerate(WIDTHS):
                    g = back[:, i * self.filters[i].shape[1] : (i + 1) * self.filters[i].shape[1]]
                    seen = np.take_along_axis(cols[i], best[i][:, :, None], 1)  # what each maximum saw: (n, filters, width * d)
                    grads[1 + i] = np.einsum("nfc,nf->cf", seen, g)
                    grads[1 + k + i] = g.sum(axis=0)
                    to = g[:, :, None] * self.filters[i].T[None]
                    places = raw[np.arange(len(raw))[:, None, None], best[i][:, :, None] + np.arange(w)]
                    np.add.at(grads[0], places.ravel(), to.reshape(-1, self.vectors.shape[1]))
                grads[0][0] = 0
                step += 1
                for w, g, a, b in zip(weights, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)


def windows_of(data: bytes) -> np.ndarray:
    padded = data + bytes(-len(data) % WINDOW)
    return np.frombuffer(padded, "uint8").reshape(-1, WINDOW)


def fit(df: DataFrame, learn_from: Column, sample_rows: int = 3000, windows_each: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Network | None:
    """Trains on windows of at most ``sample_rows`` rows (those of smallest hash) for which ``learn_from`` holds."""
    size = F.greatest(F.length(text_col) - WINDOW, F.lit(0)) + 1
    cut = F.array(*[F.substring(F.col(text_col), (F.pmod(F.xxhash64(F.col(id_col), F.lit(i)), size) + 1).cast("int"), F.lit(WINDOW)) for i in range(windows_each)])
    labelled = df.filter(learn_from & F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    marked = labelled.select(F.col(label_col).alias("label"), cut.alias("cut"), F.xxhash64(F.col(id_col), F.lit("sample")).alias("h"))
    rows = sorted(smallest(marked, "h", sample_rows).collect(), key=lambda r: (r.h, r.label, r.cut))
    if not rows:
        return None
    labels = sorted({r.label for r in rows})
    parts = [(windows_of(c.encode("utf-8", "replace"))[0], labels.index(r.label)) for r in rows for c in r.cut if c]
    network = Network.fresh(labels)
    network.train(np.stack([w for w, _ in parts]), np.array([y for _, y in parts]))
    return network


def predict(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", more: list[str] | None = None) -> DataFrame:
    """``id_col`` (and the columns ``more``) with lang_pred and score of every whole text."""
    short_batches(df.sparkSession)
    columns = [id_col, *(more or [])]
    shared = df.sparkSession.sparkContext.broadcast(network)  # a few thousand weights
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in columns], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        responses = net.responses() if net is not None else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            known = [i for i, t in enumerate(texts) if net is not None and t and _LETTER.search(t)]
            label, score = ["und"] * len(texts), [0.0] * len(texts)
            for at in range(0, len(known), 32):
                own = known[at : at + 32]
                data = [texts[i].encode("utf-8", "replace") for i in own]
                cut = [windows_of(d) for d in data]
                doc = np.repeat(np.arange(len(own)), [len(c) for c in cut])
                weight = np.concatenate([np.r_[np.full(len(c) - 1, WINDOW), len(d) - WINDOW * (len(c) - 1)] for c, d in zip(cut, data, strict=True)])
                logits = net.logits(np.concatenate(cut), responses)
                mean = np.stack([np.bincount(doc, logits[:, j] * weight, len(own)) for j in range(len(net.labels))], axis=1) / np.bincount(doc, weight)[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for i, row in zip(own, p, strict=True):
                    label[i], score[i] = net.labels[int(row.argmax())], float(row.max())
            kept = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(label), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])

    return df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: its id's CRC-32 is divisible by 5 (a null id's never is)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns only from rows that are not held out."""
    network = fit(df, ~held_out())
    rows = df.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, network, more=["held_out"])
