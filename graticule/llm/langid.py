"""Language identification with a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a text in stretches of bytes, forwards and backwards, and gives every byte position a probability for
each language; a document's probabilities are the means over its positions. Training is backpropagation through time
on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from graticule.llm.common import crc_bucket, mapped, small_batches

HIDDEN = 8
STRETCH = 128  # bytes read in one go, in training and in use
TRAIN_ROWS = 400  # sampled rows a language, about
TRAIN_CHARACTERS = 1024  # of each sampled row, at a place that depends on its hash
LANGUAGES = 200  # the most frequent ones are learned in any case, and share these many times ``TRAIN_ROWS`` with all others
LEAST_ROWS = 20  # of a language beyond these
STEPS, BATCH, RATE = 400, 192, 0.01
ROWS_AT_ONCE = 2048


def tanh_gate(x: np.ndarray) -> np.ndarray:
    """The logistic function of 2x, in place."""
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class Direction:
    """One gated recurrent layer. ``x``: input (3 * unit, byte), ``u``: recurrent weights (3 * unit, unit), in the order
    update, reset, candidate. Rows of a batch come last everywhere, so that every operation runs over long stretches.

    The logistic gates take half their sum, since logistic(x) = (1 + tanh(x / 2)) / 2.
    """

    x: np.ndarray
    u: np.ndarray

    def run(self, data: np.ndarray, keep: bool = False):
        """States (time, unit, row) for bytes (time, row). A byte of 256 is padding."""
        steps, rows = data.shape
        h = self.u.shape[1]
        states = np.zeros((steps + 1, h, rows), np.float32)
        saved = []
        mixed, recurrent, change = (np.empty((n * h, rows), np.float32) for n in (3, 3, 1))
        for t in range(steps):
            before, after = states[t], states[t + 1]
            np.take(self.x, data[t], axis=1, out=mixed, mode="clip")
            np.matmul(self.u, before, out=recurrent)
            gates = mixed[: 2 * h]
            gates += recurrent[: 2 * h]
            tanh_gate(gates)
            update, reset, candidate, inner = gates[:h], gates[h:], mixed[2 * h :], recurrent[2 * h :]
            np.multiply(reset, inner, out=change)
            candidate += change
            np.tanh(candidate, out=candidate)
            np.subtract(before, candidate, out=after)
            after *= update
            after += candidate
            if keep:
                saved.append((update.copy(), reset.copy(), candidate.copy(), inner.copy()))
        return (states, saved) if keep else states[1:]

    def backward(self, data: np.ndarray, states: np.ndarray, saved: list, grad: np.ndarray):
        """Gradients of ``x`` and ``u`` from those of the states."""
        steps, rows = data.shape
        h = self.u.shape[1]
        du, flowing = np.zeros_like(self.u), np.zeros((h, rows), np.float32)
        sums = np.empty((3 * h, steps, rows), np.float32)
        for t in reversed(range(steps)):
            update, reset, candidate, inner = saved[t]
            before = states[t]
            d = grad[t] + flowing
            d_candidate = d * (1 - update) * (1 - candidate * candidate)
            d_update = d * (before - candidate) * update * (1 - update) * 2
            d_inner = d_candidate * reset
            d_reset = d_candidate * inner * reset * (1 - reset) * 2
            into = np.concatenate([d_update, d_reset, d_inner])
            du += into @ before.T
            flowing = self.u.T @ into + d * update
            sums[: 2 * h, t], sums[2 * h :, t] = into[: 2 * h], d_candidate
        ids = data.reshape(-1)
        dx = np.stack([np.bincount(ids, row.reshape(-1), minlength=257) for row in sums]).astype(np.float32)
        return dx, du


@dataclass
class Network:
    languages: list[str]
    forth: Direction
    back: Direction
    out: np.ndarray  # (language, 2 * units + 1); the last column is the bias

    def weights(self) -> list[np.ndarray]:
        return [self.forth.x, self.forth.u, self.back.x, self.back.u, self.out]

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (time, language, row) for bytes (time, row), padded at the end with 256."""
        h = self.forth.u.shape[1]
        scores = np.matmul(self.out[:, :h], self.forth.run(data))
        scores += np.matmul(self.out[:, h : 2 * h], self.back.run(data[::-1]))[::-1]
        scores += self.out[:, -1:]
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def label_positions(self, text: str) -> list[str]:
        """The likeliest language at every byte of a text."""
        data = text.encode("utf-8", "replace")
        best = self.positions(cut_stretches([data])[0].T).argmax(axis=1).T.reshape(-1)[: len(data)]
        return [self.languages[i] for i in best]

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text; texts must not be empty."""
        stretches, owner, length = cut_stretches(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        order = np.argsort(length, kind="stable")  # short stretches together need few steps
        for start in range(0, len(order), ROWS_AT_ONCE):
            rows = order[start : start + ROWS_AT_ONCE]
            longest = int(length[rows].max())
            found = self.positions(np.ascontiguousarray(stretches[rows, :longest].T))
            if length[rows[0]] < longest:
                found *= (np.arange(longest)[:, None] < length[rows])[:, None, :]
            np.add.at(sums, owner[rows], found.sum(axis=0).T)
        return sums / sums.sum(axis=1, keepdims=True)


def cut_stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in stretches (row, byte) padded with 256, the text each row belongs to, and its length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(STRETCH, sizes[owner] - place * STRETCH)
    padded = np.full((len(owner), STRETCH), 256, np.int64)
    padded[np.arange(STRETCH) < length[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    return padded, owner, length


def start_network(languages: list[str], rng: np.random.Generator) -> Network:
    def direction() -> Direction:
        x = rng.normal(0, 0.3, (3 * HIDDEN, 257)).astype(np.float32)
        return Direction(x, rng.normal(0, HIDDEN**-0.5, (3 * HIDDEN, HIDDEN)).astype(np.float32))

    return Network(languages, direction(), direction(), rng.normal(0, 0.1, (len(languages), 2 * HIDDEN + 1)).astype(np.float32))


def gradients(net: Network, data: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradients."""
    h = net.forth.u.shape[1]
    steps, n = data.shape
    forth, saved_forth = net.forth.run(data, keep=True)
    back, saved_back = net.back.run(data[::-1], keep=True)
    both = np.concatenate([forth[1:], back[1:][::-1], np.ones((steps, 1, n), np.float32)], axis=1)
    scores = np.matmul(net.out, both)
    scores -= scores.max(axis=1, keepdims=True)
    probability = np.exp(scores)
    probability /= probability.sum(axis=1, keepdims=True)
    weight = (data < 256).astype(np.float32)
    total, rows = weight.sum(), np.arange(n)
    loss = float(-(np.log(probability[:, label, rows] + 1e-9) * weight).sum() / total)
    probability[:, label, rows] -= 1
    probability *= weight[:, None, :] / total
    d_out = np.matmul(probability, both.transpose(0, 2, 1)).sum(axis=0)
    d_both = np.matmul(net.out.T, probability)
    dfx, dfu = net.forth.backward(data, forth, saved_forth, d_both[:, :h])
    dbx, dbu = net.back.backward(data[::-1], back, saved_back, d_both[::-1, h : 2 * h])
    return loss, [dfx, dfu, dbx, dbu, d_out]


def train_network(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 11) -> Network:
    """Adam on random stretches, every language equally often. Same rows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    net = start_network(languages, rng)
    stretches, owner, length = cut_stretches(texts)
    kind = np.array([languages.index(name) for name in labels])[owner]
    by_language = [np.flatnonzero((kind == i) & (length >= min(32, length[kind == i].max()))) for i in range(len(languages))]
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        label = rng.integers(len(languages), size=BATCH)
        rows = np.array([rng.choice(by_language[i]) for i in label])
        _, grads = gradients(net, np.ascontiguousarray(stretches[rows].T), label)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for w, g, m, v in zip(net.weights(), grads, first, second):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network from a bounded sample of the rows where ``learn`` holds and text and language are there.

    About ``TRAIN_ROWS`` rows of each language, chosen by the hash of their identifiers, and a stretch of at most
    ``TRAIN_CHARACTERS`` of each. Beyond ``LANGUAGES`` all that have ``LEAST_ROWS`` rows are learned too, each from fewer
    rows and all in more steps. Two jobs, or three then: they count languages and read the sample. None if there is nothing
    to learn.
    """
    rows = docs.where(learn & F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull())
    counts = docs.where(learn & F.col(lang).isNotNull()).groupBy(F.col(lang).alias("l")).count()
    ranked = counts.orderBy(F.desc("count"), "l")
    first = {r["l"]: r["count"] for r in ranked.limit(LANGUAGES).collect()}
    if not first:
        return None
    more = {r["l"]: r["count"] for r in counts.where(F.col("count") >= LEAST_ROWS).collect()} if len(first) == LANGUAGES else {}
    sizes = first | more
    each = TRAIN_ROWS if len(sizes) <= LANGUAGES else max(LEAST_ROWS, TRAIN_ROWS * LANGUAGES // len(sizes))
    share = {name: min(1.0, each / n) for name, n in sizes.items()}
    luck = F.pmod(F.xxhash64(F.col(doc_id), F.lit(3)), F.lit(1 << 20)) / (1 << 20)
    place = F.pmod(F.xxhash64(F.col(doc_id), F.lit(4)), F.greatest(F.char_length(text) - TRAIN_CHARACTERS, F.lit(1))) + 1
    wanted = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    sample = (
        rows.where(luck < F.try_element_at(wanted, F.col(lang)))
        .select(F.col(lang).alias("l"), F.substring(F.col(text), place, F.lit(TRAIN_CHARACTERS)).alias("t"), luck.alias("u"))
        .where("trim(t) <> ''").orderBy("u", "l", "t").limit(2 * each * len(share)).toPandas()
    )
    if sample.empty:
        return None
    steps = STEPS * -(-len(share) // LANGUAGES)
    return train_network([t.encode("utf-8", "replace") for t in sample["t"]], sample["l"].tolist(), steps)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the mean probability of that language over all positions of the whole text.

    A text that is missing or has no letter gets ``und`` and 0.0, and so does every text without a network. Columns of
    those names that ``docs`` already has are replaced. Rows are independent and nothing is shuffled; the network has a
    few thousand weights and is sent with the tasks.
    """
    kept = docs.drop("lang_pred", "score")
    schema = StructType(list(kept.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            texts = batch.column(text).to_pylist()
            known = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
            best, score = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                found = net.documents([texts[i].encode("utf-8", "replace") for i in known])
                for i, p in zip(known, found):
                    best[i], score[i] = net.languages[int(p.argmax())], min(1.0, float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"]
            )

    return mapped(kept, run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that are never learned from."""
    return crc_bucket(doc_id, 3) == 1


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts all rows: identifier, ``held_out``, ``lang_pred``, ``score``.

    Only the text is used for a prediction. Repeated rows give equal results, other columns are ignored, and an empty
    table gives an empty result.
    """
    net = fit(docs, ~held_out(doc_id), doc_id, text, lang)
    chosen = docs.select(F.col(doc_id).alias("id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    found = predict(chosen, net).drop("text")
    return found.withColumnRenamed("id", doc_id)
