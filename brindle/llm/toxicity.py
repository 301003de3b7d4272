"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is the sum of an embedding of the word (by hash) and the embeddings of its character n-grams (by hash, with
marks for the word's ends), so that unknown words with known stems have an input too. A text is cut into all windows of
``window`` words at every ``stride`` words, so that windows overlap and together hold every word. Over a window run a
forward and a backward gated recurrent unit; attention weights pool their states, and a logistic unit scores the window.
A text's score is that of its highest window.

Training: at most ``most_docs`` labelled rows of each class, those with the smallest hash of their id, and of each all
windows, which are cut when they are used. A toxic text says only that some window is toxic, so after a first pass over all
windows a positive text teaches through its highest window; others teach through all. Adam, fixed seed, fixed steps.

Nulls: a null or empty text is one window of no words and gets a score; a null label or id of a training row makes it no
training row; with only one class the score is that class's share. Ties do not matter, repeated rows score alike, and a
very long text is scored over all its windows in bounded batches. An empty table gives no rows. Of the documents only id
and text are read, so further columns can have any name; lang, source and id are no inputs.
"""

from __future__ import annotations

import base64
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, free_name, kept, trim

WINDOW = 48
STRIDE = 32
HIDDEN = 8
WORD_ROWS = 1 << 14
GRAM_ROWS = 1 << 14
GRAMS = (3, 4, 5)
THRESHOLD = 0.7
MOST_DOCS = 1500
STEPS = 480
#: Words whose inputs a worker keeps.
WORDS_KEPT = 200_000
#: Windows that are computed at once.
BATCH = 2048
#: Words whose windows are prepared together.
GROUP_WORDS = STRIDE * 4096


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word the row of its embedding; the rows of all its n-grams, with the words that they belong to."""
    rows = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_ROWS
    data = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    grams, owners = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        code = np.zeros(len(data) - n + 1, np.int64)
        for k in range(n):
            code = (code * 263 + data[k : len(data) - n + 1 + k]) & 0xFFFFFFFF
        inside = owner[: len(code)] == owner[n - 1 :]
        code = (code[inside] * 2654435761 + n * 40503) & 0xFFFFFFFF
        grams.append(((code >> 13) % GRAM_ROWS).astype(np.int32))
        owners.append(owner[: len(inside)][inside].astype(np.int32))
    if not grams:
        return rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return rows, np.concatenate(grams), np.concatenate(owners)


def _sums(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Columns of ``values`` (rows, entries) added up by owner: (n, rows)."""
    out = np.empty((n, len(values)), np.float32)
    for k, row in enumerate(values):
        out[:, k] = np.bincount(owners, row, minlength=n)
    return out


def _runs(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows of ``values`` added up over consecutive runs of ``counts`` rows; a run can be empty."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights, forward pass and gradients. ``dim`` inputs, ``HIDDEN`` units in each direction."""

    def __init__(self, seed: int = 7, dim: int = 12, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        f = lambda *shape, scale=0.3: (r.standard_normal(shape) * scale).astype(np.float32)
        self.dim, self.hidden, self.share = dim, hidden, None
        self.w = {"words": f(WORD_ROWS, dim, scale=0.05), "grams": f(GRAM_ROWS, dim, scale=0.05), "a": f(2 * hidden), "out": f(2 * hidden), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": f(dim, 3 * hidden), f"h{d}": f(hidden, 3 * hidden), f"c{d}": np.zeros(3 * hidden, np.float32)}

    def embed(self, words: list[bytes]) -> np.ndarray:
        """Inputs of words: the word's row and the mean of its n-grams' rows."""
        return self.inputs(*_hashes(words))

    def inputs(self, rows: np.ndarray, grams: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Inputs from the rows of words and of their n-grams."""
        count = np.bincount(owners, minlength=len(rows))
        if np.any(owners[1:] < owners[:-1]):
            grams = grams[np.argsort(owners, kind="stable")]
        out, scale = self.w["words"][rows], 2 / np.sqrt(np.maximum(count, 1))
        for k, column in enumerate(self.w["grams"].T.copy()):  # one column at a time: words have many n-grams
            out[:, k] += _runs(column[grams], count) * scale
        return out

    def gates(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """What the gates of both directions take from each row of word inputs."""
        return {d: inputs @ self.w[f"x{d}"] + self.w[f"c{d}"] for d in "fb"}

    def run(self, gates: dict[str, np.ndarray], at: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Scores (logits) of windows. ``at``: (windows, steps) row numbers of ``gates``; what lies beyond ``lengths`` has no effect.

        States are kept as (units, windows), so that each gate's numbers lie together.
        """
        n, steps = at.shape
        h, memory = self.hidden, {}
        live = np.arange(steps)[:, None] < lengths
        full = int(lengths.min()) if n else 0
        both = np.empty((steps, 2 * h, n), np.float32)
        across = np.ascontiguousarray(at.T)
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            taken = np.ascontiguousarray(gates[d][across].transpose(0, 2, 1))
            turn = np.ascontiguousarray(self.w[f"h{d}"].T)
            state, kept_ = np.zeros((h, n), np.float32), []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x, y = taken[t], turn @ state
                zr = _sigmoid(x[: 2 * h] + y[: 2 * h])
                z, r = zr[:h], zr[h:]
                new = np.tanh(x[2 * h :] + r * y[2 * h :])
                if keep:
                    kept_.append((t, state, z, r, y[2 * h :], new))
                after = new + z * (state - new)
                state = after if t < full else np.where(live[t], after, state)
                both[t, part] = state
            memory[d] = kept_
        weight = np.where(live, self.w["a"] @ both, -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,thn->hn", weight, both)
        logit = self.w["out"] @ pooled + self.w["bias"][0]
        return (logit, (both, weight, pooled, memory, live)) if keep else logit

    def gradients(self, inputs, at, lengths, label, each) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss; under ``inputs`` that of the rows of word inputs."""
        logit, (both, weight, pooled, memory, live) = self.run(self.gates(inputs), at, lengths, keep=True)
        h, w = self.hidden, self.w
        dl = ((_sigmoid(logit) - label) * each / each.sum()).astype(np.float32)
        g = {"out": pooled @ dl, "bias": np.array([dl.sum()], np.float32), "inputs": np.zeros_like(inputs)}
        dp = w["out"][:, None] * dl
        dw = np.einsum("hn,thn->tn", dp, both)
        da = weight * (dw - (weight * dw).sum(axis=0))
        g["a"] = np.einsum("tn,thn->h", da, both)
        dboth = weight[:, None, :] * dp + da[:, None, :] * w["a"][:, None]
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            steps = []
            gh, carry = np.zeros_like(w[f"h{d}"]), np.zeros((h, len(label)), np.float32)
            for t, state, z, r, y, new in reversed(memory[d]):
                ds = carry + dboth[t, part]
                live_ds = np.where(live[t], ds, 0)
                dz, dn = live_ds * (state - new) * z * (1 - z), live_ds * (1 - z) * (1 - new**2)
                dr = dn * y * r * (1 - r)
                dy = np.concatenate([dz, dr, dn * r])
                steps.append((at[:, t], np.concatenate([dz, dr, dn])))
                gh += state @ dy.T
                carry = np.where(live[t], live_ds * z, ds) + w[f"h{d}"] @ dy
            dx_all = _sums(np.concatenate([x for _, x in steps], axis=1), np.concatenate([x for x, _ in steps]), len(inputs))
            dx_all[0] = 0
            g[f"h{d}"], g[f"c{d}"], g[f"x{d}"] = gh, dx_all.sum(axis=0), inputs.T @ dx_all
            g["inputs"] += dx_all @ w[f"x{d}"].T
        return g


def windows(n: int) -> list[tuple[int, int]]:
    """The overlapping windows over ``n`` words; they hold every word, and no words make one empty window."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [(s, s + WINDOW) for s in starts] + [(n - WINDOW, n)]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fit(texts: list[str], labels: list[int], steps: int = STEPS, batch: int = 192, seed: int = 7) -> Network:
    """Train on labelled texts."""
    net, r = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.share = float(y.mean()) if len(y) else 0.5
        return net
    number: dict[bytes, int] = {}
    stream, spans, owner, base = [], [], [], 0
    for k, text in enumerate(texts):
        words = words_of(text)
        stream.append(np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int32, len(words)))
        spans += [(base + a, b - a) for a, b in windows(len(words))]
        owner += [k] * (len(spans) - len(owner))
        base += len(words)
    stream = np.concatenate([*stream, np.zeros(WINDOW, np.int32)])
    start, sizes = np.array(spans).T
    lengths, owner = np.maximum(1, sizes), np.array(owner)
    del spans

    def at(some) -> np.ndarray:
        """The words of windows; 0 is padding."""
        return np.where(np.arange(WINDOW) < sizes[some, None], stream[start[some, None] + np.arange(WINDOW)], 0)

    rows, grams, owners = _hashes([b"", *number])
    order = np.argsort(owners, kind="stable")
    grams, owners = grams[order], owners[order]
    del order
    first = np.searchsorted(owners, np.arange(len(rows) + 1))
    label = y[owner]
    negative, positive = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
    hard, by_length = negative, np.argsort(lengths, kind="stable")
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    for step in range(steps):
        if step >= steps // 4 and step % 60 == 0:  # of a positive text the highest window, and the hardest others
            gates = net.gates(net.inputs(rows, grams, owners))
            score = np.empty(len(lengths), np.float32)
            for k in range(0, len(lengths), BATCH):
                some = by_length[k : k + BATCH]
                score[some] = net.run(gates, at(some), lengths[some])
            best = np.lexsort((score, owner))
            last = best[np.append(np.flatnonzero(np.diff(owner[best])), len(best) - 1)]
            positive = last[label[last] == 1]
            hard = negative[np.argsort(-score[negative])[: max(64, len(negative) // 20)]]
        pick = np.concatenate([r.choice(hard, batch // 4), r.choice(negative, batch // 4), r.choice(positive, batch // 2)])
        used, local = np.unique(at(pick), return_inverse=True)
        local = local.reshape(len(pick), WINDOW)
        if used[0] != 0:
            used, local = np.concatenate([[0], used]), local + 1
        count = first[used + 1] - first[used]
        flat = grams[np.repeat(first[used] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        scale = (2 / np.sqrt(np.maximum(count, 1)))[:, None].astype(np.float32)
        inputs = net.w["words"][rows[used]] + _runs(net.w["grams"][flat], count) * scale
        g = net.gradients(inputs, local, lengths[pick], label[pick], np.ones(len(pick), np.float32))
        dx = g.pop("inputs")
        g["words"], g["grams"] = _sums(dx.T, rows[used], WORD_ROWS), _sums(np.repeat((dx * scale).T, count, axis=1), flat, GRAM_ROWS)
        rate = 0.02 * (1 - step / steps) + 0.001
        for k, v in g.items():
            m, s = moment[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            net.w[k] -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(np.float32)
    return net


class Scorer:
    """Scores texts with a network; inputs of words are kept from text to text."""

    def __init__(self, net: Network):
        self.net, self.number = net, {}
        self.inputs = np.zeros((WORDS_KEPT, net.dim), np.float32)
        self.inputs[0] = net.embed([b""])[0]

    def ids(self, words: list[bytes]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.number))
        if new:
            at = len(self.number) + 1
            if at + len(new) > len(self.inputs):
                self.number.clear()
                new, at = list(dict.fromkeys(words)), 1
                if at + len(new) > len(self.inputs):
                    self.inputs = np.concatenate([self.inputs, np.zeros((len(new), self.net.dim), np.float32)])
            self.number |= zip(new, range(at, at + len(new)))
            self.inputs[at : at + len(new)] = self.net.embed(new)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The highest window's probability of every text."""
        if self.net.share is not None:
            return np.full(len(texts), self.net.share)
        out = np.full(len(texts), -np.inf)
        group, size = [], 0
        for k, text in enumerate(texts):
            words = words_of(text)
            for low in range(0, max(1, len(words)), GROUP_WORDS):  # a very long text in parts that overlap
                part = words[low : low + GROUP_WORDS + WINDOW]
                group.append((k, part))
                size += len(part)
                if size >= GROUP_WORDS:
                    self._group(group, out)
                    group, size = [], 0
        if group:
            self._group(group, out)
        return _sigmoid(out)

    def _group(self, group: list[tuple[int, list[bytes]]], out: np.ndarray) -> None:
        ids = self.ids([w for _, part in group for w in part])
        spans, owner, base = [], [], 0
        for k, part in group:
            spans += [(base + a, b - a) for a, b in windows(len(part))]
            owner += [k] * (len(spans) - len(owner))
            base += len(part)
        start, length = np.array(spans).T
        order = np.argsort(length, kind="stable")
        padded = np.concatenate([ids, np.zeros(WINDOW, np.int64)])
        used, local = np.unique(padded, return_inverse=True)
        gates = self.net.gates(self.inputs[used])
        owner = np.array(owner)
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            steps = max(1, int(length[some].max()))
            at = local[start[some, None] + np.arange(steps)]
            logit = self.net.run(gates, at, np.maximum(1, length[some]))
            np.maximum.at(out, owner[some], logit)


def sample(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", label_id: str = "doc_id", most_docs: int = MOST_DOCS) -> pd.DataFrame:
    """At most ``most_docs`` labelled rows of each class, by the smallest hash of the id."""
    marks = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    parts = [marks.where(F.col("label") == c).orderBy(*order).limit(most_docs) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # at most 2 * most_docs rows of two numbers
    return rows.toPandas().drop_duplicates("id").sort_values("id")


def train(docs: DataFrame, labels: DataFrame, **where) -> Network:
    rows = sample(docs, labels, **where)
    net = _fitted(rows)
    trim()
    return net


def _fitted(rows: pd.DataFrame) -> Network:
    return fit([t if isinstance(t, str) else "" for t in rows["text"]], rows["label"].astype(int).tolist())


def score(text: Column, net: Network) -> Column:
    """The score of a text column, 0 to 1."""
    data = base64.b64encode(zlib.compress(pickle.dumps((net.w, net.share, net.dim, net.hidden)))).decode()

    def made() -> Scorer:
        own = Network()
        own.w, own.share, own.dim, own.hidden = pickle.loads(zlib.decompress(base64.b64decode(data)))
        return Scorer(own)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = kept(("scorer", zlib.crc32(data.encode())), made)
        for part in parts:
            yield pd.Series(scorer.scores([x if isinstance(x, str) else None for x in part]))

    return scored(text)


def held_out(id_column: str = "doc_id") -> Column:
    """True for rows whose labels are not learned from: the crc32 of the id as text has remainder 1 by 3."""
    return crc_of_id(id_column) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    net = train(rows, labels.where(~held_out("doc_id")))
    scored = rows.select("doc_id", held_out().alias("held_out"), score(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is ``threshold`` or more."""
    net = train(docs, labels.where(~held_out("doc_id")), id_column=id_column, text=text)
    name = free_name(docs, "score__")
    return docs.withColumn(name, score(F.col(text), net)).where(F.col(name) < threshold).select(*docs.columns)
