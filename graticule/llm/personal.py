"""Personal data by fixed patterns, carried to similar places by a skip-chain conditional random field.

Patterns find the base spans: mail addresses, IP addresses, card numbers and telephone numbers. Tokens that hold a digit or
an at sign may be any of these kinds or none; all other words are none by definition, so the chain falls apart at them
without loss. Neighbouring tokens share a potential. So do distant tokens of a document that are repeated or similar (the
same text, digits, last digits, or address once written forms of "at" and "dot" are undone): each such group has a
node of its own, to which all its members are tied, so that the number of ties grows with the tokens and not with their
pairs. Base spans are observed. Loopy message passing over a whole document then gives the other tokens a belief, and
those believed to be a kind become spans of it.

Weights are learned in numpy by pseudo-likelihood: the label of each token given its shape and the labels of its
neighbours and of its groups, with the token's own base span hidden.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import mapped, small_batches, stored

KINDS = ["email", "ip", "card", "phone"]
NONE = len(KINDS)  # the label of a token that is nothing personal
LABELS = NONE + 1
TIES = ["text", "digits", "tail", "address"]  # what a group's members have in common
TRAIN_TOKENS = 4_000  # tokens of each label to learn from, those whose hash is smallest
BELIEF = 0.5  # from which a token becomes a span
ROUNDS, SETTLED, DAMPING = 30, 1e-4, 0.3
TIE = 6.0  # what a tie weighs before anything is learned, and where its weight returns to without examples

# The patterns of base spans. A mail address is found from its at sign.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match ends where digits end, so the next one starts where digits start
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

CHUNK = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")  # a word with a digit or an at sign
WRITTEN = re.compile(r"[\[({](?:at|AT)[\])}]")
DOT = re.compile(r"[\[({]dot[\])}]", re.IGNORECASE)
NUMERIC = re.compile(r"[0-9+().\-/]+")
NO_DIGITS = re.compile(r"[^0-9]+")
EDGES = "()[]{}<>\"'.,;:!?*#$%&|"
BETWEEN = EDGES + " \t\r\n"
PERSONAL = re.compile("[0-9@]")  # in every base span


def passes_luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def mail_spans(text: str) -> Iterator[tuple[int, int]]:
    """Matches of an address pattern, leftmost first, without reading a long run of letters more than once."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            after = found.end()
        at = text.find("@", max(after, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, by kind and start, in code points."""
    spans = [(0, *span) for span in mail_spans(text)]
    spans += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NO_DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and passes_luhn(digits):
            spans.append((2, *m.span()))
    spans += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(NO_DIGITS.sub("", m[0])) <= 15]
    return spans


def token_places(text: str) -> list[tuple[int, int]]:
    """Where the tokens stand that may be personal data: words with a digit or an at sign, also a written one, without the
    punctuation around them. Words of digits and their separators that follow each other after single spaces are one."""
    found = {m.span() for m in CHUNK.finditer(text)}
    stop = 0
    for m in WRITTEN.finditer(text):
        if m.start() < stop:
            continue  # in the word just found
        start, stop = m.span()
        while start and not text[start - 1].isspace():
            start -= 1
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        found.add((start, stop))
    places: list[tuple[int, int]] = []
    numeric_before = False
    for start, stop in sorted(found):
        numeric = NUMERIC.fullmatch(text, start, stop) is not None
        if numeric and numeric_before and start == places[-1][1] + 1 and text[start - 1] == " ":
            places[-1] = (places[-1][0], stop)
        else:
            places.append((start, stop))
        numeric_before = numeric
    trimmed = []
    for start, stop in places:
        word = text[start:stop]
        left = len(word) - len(word.lstrip(EDGES))
        kept = word.strip(EDGES)
        if word[left - 1 : left] == "(" and kept[:1].isdigit() and ")" in kept:  # an area code
            left, kept = left - 1, f"({kept}"
        if kept:
            trimmed.append((start + left, start + left + len(kept)))
    return trimmed


def shape(word: str, before: str, after: str) -> list[str]:
    """What the potentials of a single token look at. Whether a pattern matches is not among it."""
    digits = NO_DIGITS.sub("", word)
    parts = NO_DIGITS.sub(" ", word).split()
    letters = any(map(str.isalpha, word))
    head, sign, tail = word.partition("@")
    return [
        "bias",
        f"digits {min(len(digits), 20)}",
        f"parts {min(len(parts), 6)}",
        f"letters {letters}",
        f"plus {word[0] == '+'}",
        f"at {bool(sign)} head {bool(head)} dot {'.' in tail}",
        f"dots {min(word.count('.'), 5)} letters {letters}",
        f"bytes {len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)} {word.count('.') == 3}",
        f"check {13 <= len(digits) <= 19 and passes_luhn(digits)}",
        f"separators {''.join(sorted(set(word) & set(' -().+/')))}",
        f"before {before}",
        f"after {after}",
    ]


def ties_of(word: str) -> list[tuple[int, str]]:
    """What a token may have in common with distant ones."""
    digits = NO_DIGITS.sub("", word)
    found = [(0, word.lower())]
    if len(digits) >= 7:
        parts = NO_DIGITS.sub(" ", word).split()
        four = len(parts) == 4 and all(len(p) < 4 for p in parts)
        found.append((1, ".".join(p.lstrip("0") or "0" for p in parts) if four else digits))
        if len(digits) >= 10 and not four:
            found.append((2, digits[-9:]))
    undone = DOT.sub(".", WRITTEN.sub("@", word)).lower()
    if "@" in undone:
        found.append((3, undone))
    return found


class Graph:
    """The tokens of a batch of documents, their groups, and what is observed."""

    def __init__(self, texts: list[str | None]) -> None:
        texts = [t if t and PERSONAL.search(t) else None for t in texts]  # no base span, so nothing to carry either
        self.base = [base_spans(t) if t else [] for t in texts]
        self.places: list[tuple[int, int, int]] = []  # document, start, end
        self.shapes: list[list[str]] = []
        observed, linked, members, kinds = [], [], [], []
        groups: dict[tuple, int] = {}
        for n, text in enumerate(texts):
            spans = sorted((a, b, kind) for kind, a, b in self.base[n])
            low, last = 0, None
            for start, stop in token_places(text) if text else ():
                while low < len(spans) and spans[low][1] <= start:
                    low += 1
                over: Counter = Counter()
                at = low
                while at < len(spans) and spans[at][0] < stop:
                    a, b, kind = spans[at]
                    over[kind] += max(0, min(b, stop) - max(a, start))
                    at += 1
                over += Counter()  # drops what only touches
                token = len(self.places)
                # With several kinds, the one that covers most; of equals, the first listed.
                observed.append(min(over, key=lambda k: (-over[k], k)) if over else -1)
                linked.append(last is not None and not text[last:start].strip(BETWEEN))
                last = stop
                word = text[start:stop]
                for tie in ties_of(word):
                    members.append(token)
                    kinds.append(groups.setdefault((n, *tie), len(groups)))
                self.places.append((n, start, stop))
                before, after = text[max(0, start - 40) : start].split(), text[stop : stop + 40].split()
                self.shapes.append(shape(word, before[-1].lower() if before else "", after[0].lower() if after else ""))
        self.observed = np.array(observed, np.int64)
        self.chained = np.flatnonzero(np.array(linked, bool))  # tokens that follow the one before without a word between
        sizes = np.bincount(kinds, minlength=len(groups)) if kinds else np.zeros(0, np.int64)
        shared = [sizes[g] > 1 for g in kinds]
        self.tied = np.array([m for m, s in zip(members, shared) if s], np.int64)
        old = np.array([g for g, s in zip(kinds, shared) if s], np.int64)
        named, self.group = np.unique(old, return_inverse=True)
        tie_of = np.array([tie for _, tie, _ in groups], np.int64) if groups else np.zeros(0, np.int64)
        self.tie = tie_of[named][self.group] if len(named) else np.zeros(0, np.int64)
        self.n_groups = len(named)


class Field:
    """Potentials: of a token's shape, of neighbours, and of a tie between a token and the node of its group."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, chain: np.ndarray, ties: np.ndarray) -> None:
        self.names, self.weights, self.chain, self.ties = names, weights, chain, ties

    def unary(self, shapes: list[list[str]]) -> np.ndarray:
        known = [[self.names[f] for f in s if f in self.names] for s in shapes]
        row = np.repeat(np.arange(len(known)), list(map(len, known)))
        flat = np.array([f for s in known for f in s], np.int64)
        return np.stack([np.bincount(row, self.weights[flat, k], len(shapes)) for k in range(LABELS)], axis=1).astype(float)

    def beliefs(self, graph: Graph) -> np.ndarray:
        """Probabilities of the labels of each token, by damped message passing until nothing moves by more than a ten
        thousandth, or for 30 rounds."""
        own = self.unary(graph.shapes)
        seen = np.flatnonzero(graph.observed >= 0)
        own[seen] = -50.0
        own[seen, graph.observed[seen]] = 50.0
        to_left, to_right = np.zeros((2, len(graph.chained), LABELS))  # to the earlier and to the later token
        to_group, to_token = np.zeros((2, len(graph.tied), LABELS))
        right, left = graph.chained, graph.chained - 1
        tie = self.ties[graph.tie][:, :, None] * np.eye(LABELS) if len(graph.tie) else np.zeros((0, LABELS, LABELS))

        def total() -> np.ndarray:
            held = own.copy()
            np.add.at(held, left, to_left)
            np.add.at(held, right, to_right)
            np.add.at(held, graph.tied, to_token)
            return held

        for _ in range(ROUNDS):
            held = total()
            new_left = passed(held[right] - to_right, self.chain.T)
            new_right = passed(held[left] - to_left, self.chain)
            new_group = passed_through(held[graph.tied] - to_token, tie)
            nodes = np.zeros((graph.n_groups, LABELS))
            np.add.at(nodes, graph.group, new_group)
            new_token = passed_through(nodes[graph.group] - new_group, tie)
            moved = 0.0
            for old, new in ((to_left, new_left), (to_right, new_right), (to_group, new_group), (to_token, new_token)):
                change = (1 - DAMPING) * (new - old)
                old += change
                moved = max(moved, float(np.abs(change).max(initial=0.0)))
            if moved < SETTLED:
                break
        return softmax(total())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def passed(held: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """A message in logarithms: the sum over the sender's labels, whose largest entry is 0."""
    out = np.log(np.maximum(np.exp(held - held.max(axis=1, keepdims=True)) @ np.exp(potential), 1e-300))
    return out - out.max(axis=1, keepdims=True)


def passed_through(held: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Messages over ties, each with its own symmetric potential."""
    if not len(held):
        return held
    out = np.einsum("ni,nij->nj", np.exp(held - held.max(axis=1, keepdims=True)), np.exp(potentials))
    out = np.log(np.maximum(out, 1e-300))
    return out - out.max(axis=1, keepdims=True)


def examples(graph: Graph) -> Iterator[tuple[int, list[str], list[int], list[float]]]:
    """(label, shape, labels of the neighbours, shares) of each token with a sure label: a base span, or none without a base
    span in any of its groups. A neighbour of -1 is no token. Shares are those of each label among the other members of
    its groups, by tie: what is similar to a base span but no match itself is left for the field to decide."""
    labels = np.where(graph.observed >= 0, graph.observed, NONE)
    counts = np.zeros((graph.n_groups, LABELS))
    np.add.at(counts, (graph.group, labels[graph.tied]), 1)
    shares = np.zeros((len(labels), len(TIES), LABELS))
    others = counts[graph.group]
    others[np.arange(len(graph.tied)), labels[graph.tied]] -= 1
    shares[graph.tied, graph.tie] = others / others.sum(axis=1, keepdims=True) if len(others) else 0
    unsure = (labels == NONE) & (shares[:, :, :NONE].sum(axis=(1, 2)) > 0)
    before, after = np.full((2, len(labels)), -1)
    before[graph.chained], after[graph.chained - 1] = labels[graph.chained - 1], labels[graph.chained]
    for i in np.flatnonzero(~unsure).tolist():
        yield int(labels[i]), graph.shapes[i], [int(before[i]), int(after[i])], shares[i].ravel().tolist()


def learn(rows: list[tuple[int, list[str], list[int], list[float]]], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximises the pseudo-likelihood of the examples by gradient ascent with momentum; shapes met twice or more have
    weights. Ties decay to ``TIE`` instead of 0 and stay positive, so that a group never sets its members apart."""
    met = Counter(f for _, s, _, _ in rows for f in s)
    names = {f: i for i, f in enumerate(sorted(f for f, n in met.items() if n > 1))}
    labels = np.array([r[0] for r in rows], np.int64)
    known = [[names[f] for f in s if f in names] for _, s, _, _ in rows]
    row, flat = np.repeat(np.arange(len(rows)), list(map(len, known))), np.array([f for s in known for f in s], np.int64)
    sides = np.array([r[2] for r in rows], np.int64).reshape(-1, 2)
    shares = np.array([r[3] for r in rows]).reshape(-1, len(TIES), LABELS)
    wanted = np.eye(LABELS)[labels]
    # Each label counts alike, however rare.
    sizes = np.bincount(labels, minlength=LABELS)
    weigh = (1.0 / np.maximum(sizes, 1))[labels][:, None] / max(1, (sizes > 0).sum())
    params = [np.zeros((len(names), LABELS)), np.zeros((LABELS, LABELS)), np.full((len(TIES), LABELS), TIE)]
    speed = [np.zeros_like(p) for p in params]
    has = [np.flatnonzero(sides[:, s] >= 0) for s in (0, 1)]

    def slopes_at(weights: np.ndarray, chain: np.ndarray, ties: np.ndarray) -> list[np.ndarray]:
        scores = np.stack([np.bincount(row, weights[flat, k], len(rows)) for k in range(LABELS)], axis=1).astype(float)
        scores[has[0]] += chain[sides[has[0], 0]]
        scores[has[1]] += chain.T[sides[has[1], 1]]
        scores += (shares * ties).sum(axis=1)
        error = (wanted - softmax(scores)) * weigh
        of_weights, of_chain = np.zeros_like(weights), np.zeros_like(chain)
        for k in range(LABELS):
            of_weights[:, k] = np.bincount(flat, error[row, k], len(names))
        np.add.at(of_chain, sides[has[0], 0], error[has[0]])
        np.add.at(of_chain.T, sides[has[1], 1], error[has[1]])
        return [of_weights, of_chain, (shares * error[:, None, :]).sum(axis=0)]

    for _ in range(steps if rows else 0):
        for p, v, s, rest in zip(params, speed, slopes_at(*params), (0.0, 0.0, TIE)):
            v *= 0.9
            v += rate * (s - decay * (p - rest))
            p += v
        np.maximum(params[2], 0.0, out=params[2])
    return Field(names, *params)


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = TRAIN_TOKENS) -> Field:
    """Learns from at most ``most`` tokens of each label, those whose hash of document and place is smallest. All texts
    are read for it, once, and their tokens written to the shared folder; about half as many more than wanted reach the
    driver, however many there are. Without tokens every potential is even."""

    names = ["place", "label", "shape", "sides", "shares"]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for n, example in enumerate(examples(Graph([t]))):
                    place = hashlib.blake2b(f"{i}:{n}".encode(), digest_size=8).digest()
                    rows.append((int.from_bytes(place, "big", signed=True), *example))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    chosen = candidates(docs, doc_id, text).where(F.col("text").rlike("[0-9@]"))
    every = mapped(chosen, run, "place long, label int, shape array<string>, sides array<int>, shares array<double>")
    every = stored(every, "tokens")
    rows = []
    for label, n in sorted(map(tuple, every.groupBy("label").count().collect())):
        share = 1.5 * most / n  # places are even, so that about half as many more than wanted lie below this share of them
        while True:
            limit = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
            found = every.where((F.col("label") == label) & (F.col("place") <= limit)).collect()
            if len(found) >= min(n, most):
                break
            share *= 4
        rows += sorted(found, key=lambda r: (r.place, r.shape))[:most]
    rows = [(r.label, r.shape, r.sides, r.shares) for r in rows]
    return learn(rows)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{stop}" for kind, start, stop in spans)


def carried(graph: Graph, labels: np.ndarray) -> np.ndarray:
    """Whether groups lead from a token to a base span of its kind, over tokens of that kind. What no base span supports is
    what the patterns say it is."""
    reached = graph.observed >= 0
    kind = labels[graph.tied]
    while True:
        held = np.zeros((graph.n_groups, LABELS), bool)
        from_ = reached[graph.tied]
        held[graph.group[from_], kind[from_]] = True
        more = graph.tied[(kind >= 0) & held[graph.group, kind] & ~from_]
        if not len(more):
            return reached
        reached[more] = True


def found_spans(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, both by kind and start."""
    graph = Graph(texts)
    every = [list(b) for b in graph.base]
    if len(graph.places):
        beliefs = field.beliefs(graph)
        best = beliefs.argmax(axis=1)
        likely = (graph.observed < 0) & (best != NONE) & (beliefs.max(axis=1) >= BELIEF)
        for i in np.flatnonzero(likely & carried(graph, np.where(likely, best, graph.observed))).tolist():
            n, start, stop = graph.places[i]
            every[n].append((int(best[i]), start, stop))
    return [(base, sorted(spans)) for base, spans in zip(graph.base, every)]


def find(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The identifier; ``n_email``, ``n_ip``, ``n_card`` and ``n_phone``, the base spans of each kind; ``base_sha256`` of
    their description (``kind:start:end`` in code points, by kind and start, joined by commas); and ``spans``, the
    description of all spans: base spans, which always stay, and those that the field adds.

    Missing and empty texts have no spans. Documents are independent: repeated rows give repeated results, an empty table
    an empty one, and other columns are ignored. Without ``field`` it is fitted on the same documents, which runs a job at
    once. Texts without a digit or an at sign have no tokens and no span. Nothing is shuffled but the sample to learn
    from. A task holds a batch of texts of 4 MB, or one longer text, with its tokens.
    """
    field = field or fit(docs, doc_id, text)
    chosen = candidates(docs, doc_id, text)
    kind = chosen.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((field.names, field.weights, field.chain, field.ties))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Field(*shared.value)
        for batch in small_batches(batches, "text"):
            spans = found_spans(batch.column("text").to_pylist(), learned)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in spans], pa.int64()) for k in range(NONE)]
            digests = pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in spans])
            held = [batch.column("id"), *counts, digests, pa.array([told(every) for _, every in spans])]
            yield pa.RecordBatch.from_arrays(held, ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = f"id {kind}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    return mapped(chosen, run, schema).withColumnRenamed("id", doc_id)
