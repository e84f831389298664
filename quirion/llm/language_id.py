"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, labels every position with a probability for each language, and a
document's probabilities are the means over its positions. It is trained here in numpy by backpropagation through time
on windows of ``WINDOW`` bytes of a bounded sample of labelled documents: ``DOCUMENTS`` of each of the ``LANGUAGES`` that
most documents have. Texts are read whole, in stretches of ``STRETCH`` bytes, a quarter of a short page, that each start from an empty state.

Training sees the text and label of sampled documents only; predictions see the text only.

Defined results: a null text, and one without a letter, is ``und`` with score 0; so is every text if no labelled document
can be learned from. Documents with a null label are predicted but not learned from. Null ids count as held in; repeated
rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirion.llm import common

#: Bytes of a window to learn from, bytes that are read in one go, and the width of each direction's state.
WINDOW, STRETCH, HIDDEN = 64, 256, 12
#: The sample: documents of each language, windows of each, and languages.
DOCUMENTS, WINDOWS, LANGUAGES = 400, 4, 200
PAD = 256
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent directions and a softmax at every position.

    ``table`` holds what each byte adds to the gates (update, reset, new) of each direction; the padding byte keeps the
    update gate shut, so states pass it unchanged.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape, scale: (scale * rng.standard_normal(shape)).astype(np.float32)
        self.params = {
            "table": draw(2, PAD + 1, 3 * hidden, scale=0.3),
            "inner": draw(2, hidden, 3 * hidden, scale=hidden**-0.5),
            "out": draw(2 * hidden, len(languages), scale=(2 * hidden) ** -0.5),
            "bias": np.zeros(len(languages), np.float32),
        }
        self._shut()

    def _shut(self) -> None:
        self.params["table"][:, PAD] = 0
        self.params["table"][:, PAD, : self.hidden] = 40

    def states(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States of both directions at every position: (windows, positions, twice the width)."""
        table, inner, n = self.params["table"], self.params["inner"], self.hidden
        size, steps = x.shape
        h = np.zeros((2, size, n), np.float32)
        out = np.empty((size, steps, 2 * n), np.float32)
        for t in range(steps):
            back = steps - 1 - t
            gates = np.stack([table[0][x[:, t]], table[1][x[:, back]]])
            inside = h @ inner
            zr = sigmoid(gates[..., : 2 * n] + inside[..., : 2 * n])
            z, r = zr[..., :n], zr[..., n:]
            new = np.tanh(gates[..., 2 * n :] + r * inside[..., 2 * n :])
            if trace is not None:
                trace.append((h, z, r, new, inside[..., 2 * n :]))
            h = new + z * (h - new)
            out[:, t, :n], out[:, back, n:] = h[0], h[1]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, languages)."""
        logits = self.states(x) @ self.params["out"] + self.params["bias"]
        e = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions, and its gradients by backpropagation through time."""
        n, (size, steps) = self.hidden, x.shape
        trace: list = []
        states = self.states(x, trace)
        logits = states @ self.params["out"] + self.params["bias"]
        e = np.exp(logits - logits.max(axis=-1, keepdims=True))
        p = e / e.sum(axis=-1, keepdims=True)
        real = x != PAD
        count = max(1, int(real.sum()))
        at = p[np.arange(size), :, y]
        loss = float(-np.log(np.maximum(at, 1e-9))[real].sum() / count)
        d = p
        d[np.arange(size), :, y] -= 1
        d *= real[..., None] / np.float32(count)
        flat = d.reshape(-1, d.shape[-1])
        grads = {"out": states.reshape(-1, 2 * n).T @ flat, "bias": flat.sum(axis=0)}
        outer = d @ self.params["out"].T
        table, inner, inner_t = np.zeros_like(self.params["table"]), np.zeros_like(self.params["inner"]), self.params["inner"].transpose(0, 2, 1)
        carry = np.zeros((2, size, n), np.float32)
        for t in reversed(range(steps)):
            back = steps - 1 - t
            h, z, r, new, inside = trace[t]
            dh = carry + np.stack([outer[:, t, :n], outer[:, back, n:]])
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (h - new) * z * (1 - z)
            d_r = d_new * inside * r * (1 - r)
            gates = np.concatenate([d_z, d_r, d_new], axis=-1)
            within = np.concatenate([d_z, d_r, d_new * r], axis=-1)
            inner += h.transpose(0, 2, 1) @ within
            np.add.at(table[0], x[:, t], gates[0])
            np.add.at(table[1], x[:, back], gates[1])
            carry = dh * z + within @ inner_t
        grads |= {"table": table, "inner": inner}
        return loss, grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 2) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        losses, step, total = [], 0, max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order, seen = rng.permutation(len(x)), []
            for k in range(0, len(x), batch):
                some = order[k : k + batch]
                loss, grads = self.gradients(x[some], y[some])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                for name, g in grads.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    mean[name] += 0.1 * (g - mean[name])
                    square[name] += 0.001 * (g * g - square[name])
                    change = mean[name] / (1 - 0.9**step) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
                    self.params[name] -= (rate * (1 - 0.9 * step / total) * change).astype(np.float32)
                self._shut()
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its pooled probability for each text."""
        known = [k for k, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not known or not self.languages:
            return names, scores
        data = [texts[k].encode("utf-8", "replace") for k in known]
        sizes = np.array([len(d) for d in data])
        rows = -(-sizes // STRETCH)
        x = np.full((int(rows.sum()), min(STRETCH, int(sizes.max()))), PAD, np.int16)
        firsts = np.cumsum(rows) - rows
        for d, first, n in zip(data, firsts, rows, strict=True):
            x[first : first + n].reshape(-1)[: len(d)] = np.frombuffer(d, np.uint8)
        sums = np.empty((len(x), len(self.languages)))
        for k in range(0, len(x), 512):
            some = x[k : k + 512]
            sums[k : k + 512] = (self.probabilities(some) * (some != PAD)[..., None]).sum(axis=1)
        pooled = np.add.reduceat(sums, firsts, axis=0) / sizes[:, None]
        best = pooled.argmax(axis=1)
        for k, b, p in zip(known, best, pooled, strict=True):
            names[k], scores[k] = self.languages[b], min(1.0, float(p[b]))
        return names, scores


def held_out(id_col: str) -> Column:
    """Whether the checksum of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 6) -> Network:
    """Trains a network on a bounded sample of the labelled documents that aren't held out.

    Of each language, the ``DOCUMENTS`` documents with the least hashes of id and text are taken, repeated rows once, and
    ``WINDOWS`` windows of each at places that follow from the hash.
    """
    draw = F.xxhash64(F.lit(seed), id_col, text_col)
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.approx_count_distinct(draw).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Network([])
    # Twice the share that would do on average; the least hashes of each language are picked from these.
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * DOCUMENTS + 50) / r["n"])) for r in counts], "__lang string, __share double")
    position = F.shiftrightunsigned(draw, 33).cast("double") / float(1 << 31)
    spread = F.greatest(F.length(text_col) - WINDOW, F.lit(0)) + 1
    windows = [F.col(text_col).substr((F.pmod(F.xxhash64(draw, F.lit(k)), spread) + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS)]
    near = labelled.join(F.broadcast(share), F.col(lang_col) == F.col("__lang")).filter(position < F.col("__share"))
    sample = near.select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.array(*windows).alias("windows"))
    sample = sample.dropDuplicates(["lang", "draw"]).orderBy("draw").limit(LANGUAGES * 4 * DOCUMENTS).collect()
    taken: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["draw"] % (1 << 64), r["windows"])):
        own = taken.setdefault(r["lang"], [])
        if len(own) < DOCUMENTS:
            own.append(r["windows"])
    x, y = [], []
    for k, lang in enumerate(languages):
        for part in (w for ws in taken.get(lang, []) for w in ws if w):
            data = part.encode()[:WINDOW]
            x.append(np.concatenate([np.frombuffer(data, np.uint8).astype(np.int16), np.full(WINDOW - len(data), PAD, np.int16)]))
            y.append(k)
    network = Network(languages)
    if x:
        network.train(np.stack(x), np.array(y))
    return network


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``held_out``, ``lang_pred`` and ``score``. There is no shuffle."""
    given = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    kind = given.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            names, scores = network.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["id", "held_out", "lang_pred", "score"])

    return given.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, network: Network, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of documents whose language is told with a score of ``least`` or more, unchanged."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            names, scores = network.predict(batch.column(place).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
