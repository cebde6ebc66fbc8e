"""Toxicity: a bidirectional gated recurrent network with attention pooling.

The input of a step is a word vector (hashed lower-cased word) and the scaled sum of
its character vectors (hashed trigrams and word beginnings of 4 to 7 bytes); a forward and a backward recurrence run over a
window of words, attention weights pool their states, and a linear unit gives the
window's logit. Windows overlap by a third and all of a text are scored. A logistic
unit joins the highest window logits, the expected number of toxic windows and the
number of windows to the score of the text.

Trained in numpy on windows of a bounded sample of labelled texts. Which windows
of a toxic text are toxic is not known: training starts with those whose words
speak most for the label and goes on with those that the network itself rates
highest; highly rated windows of clean texts serve as the other class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Texts, chunks, mix

WORDS, CHARS, SIZE, HIDDEN = 1 << 17, 1 << 16, 8, 8
BEGINNINGS = (4, 5, 6, 7)
TOP = 4
WINDOW, STRIDE = 24, 16
#: Labelled texts to fit on at most, half of them toxic if there are enough.
SAMPLE_ROWS = 2048
BATCH = 4096


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Words:
    """Distinct words of a chunk: hashed word numbers and character trigrams, and each position's word."""

    def __init__(self, texts: Texts):
        # signs around a word do not belong to it
        raw = texts.data
        letter = (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
        count = np.concatenate([[0], np.cumsum(letter)])
        inner = count[texts.ends] > count[texts.starts]
        at = np.flatnonzero(letter)
        starts, ends = texts.starts.copy(), texts.ends.copy()
        starts[inner], ends[inner] = at[count[texts.starts][inner]], at[count[texts.ends][inner] - 1] + 1
        h = texts.span_hash(starts, ends)
        _, first, self.of = np.unique(h, return_index=True, return_inverse=True)
        self.number = (h[first] >> np.uint64(40)).astype(np.int64) % WORDS
        starts, ends = starts[first], ends[first]
        widths = ends - starts
        word = np.repeat(np.arange(len(first)), widths)
        pos = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths) + starts[word]
        code = raw.astype(np.uint32)
        before = np.where(pos > starts[word], code[pos - 1], 1)
        after = np.where(pos + 1 < ends[word], code[np.minimum(pos + 1, len(code) - 1)], 2)
        owner, gram = [word], [mix(((before << 16) | (code[pos] << 8) | after).astype(np.uint64))]
        for size in BEGINNINGS:
            long_ = np.flatnonzero(widths >= size)
            owner.append(long_)
            gram.append(texts.span_hash(starts[long_], starts[long_] + size))
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.word = owner[order]
        self.gram = ((np.concatenate(gram) >> np.uint64(40)).astype(np.int64) % CHARS)[order]
        self.scale = 1 / np.sqrt(np.maximum(np.bincount(self.word, minlength=len(first)), 1))[:, None]

    def __len__(self):
        return len(self.number)

    def grams_of(self, used):
        """Trigrams of some words, and which of them each belongs to."""
        starts = np.searchsorted(self.word, used)
        widths = np.searchsorted(self.word, used, "right") - starts
        at = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths) + np.repeat(starts, widths)
        return self.gram[at], np.repeat(np.arange(len(used)), widths)

    def vectors(self, p, used=None) -> np.ndarray:
        used = np.arange(len(self)) if used is None else used
        grams, of = self.grams_of(used)
        chars = np.stack([np.bincount(of, v[grams], len(used)) for v in p["chars"].T], 1)
        return np.concatenate([p["words"][self.number[used]], chars * self.scale[used]], 1).astype(np.float32)


def windows(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first position and length of all overlapping windows; texts without words have none."""
    count = np.where(per_text > 0, np.maximum(-(-(per_text - WINDOW) // STRIDE), 0) + 1, 0)
    text = np.repeat(np.arange(len(per_text)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = (np.cumsum(per_text) - per_text)[text] + step * STRIDE
    return text, first, np.minimum(WINDOW, per_text[text] - step * STRIDE)


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = 2 * SIZE, HIDDEN
    p = {"words": rng.normal(0, 0.1, (WORDS, SIZE)), "chars": rng.normal(0, 0.3, (CHARS, SIZE))}
    for way in "fb":
        p["x" + way] = rng.normal(0, 0.4, (d, 3 * h))
        p["h" + way] = rng.normal(0, 0.3, (h, 3 * h))
        p["c" + way] = np.zeros(3 * h)
    p |= {"attend": rng.normal(0, 0.3, 2 * h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _recur(p, way, x, there):
    """States of one direction; ``x`` has the projected inputs in time order of that direction."""
    n, h = len(there[0]), HIDDEN
    state, trace = np.zeros((n, h), np.float32), []
    u_gates, u_new = p["h" + way][:, : 2 * h], p["h" + way][:, 2 * h :]
    for xt, mask in zip(x, there, strict=True):
        gates = _sigmoid(xt[:, : 2 * h] + state @ u_gates)
        z, r = gates[:, :h] * mask, gates[:, h:]
        new = np.tanh(xt[:, 2 * h :] + (r * state) @ u_new)
        before, state = state, state + z * (new - state)
        trace.append((before, z, r, new, state))
    return trace


def forward(p, projected, index, there):
    """Logits of windows. ``index`` has rows of ``projected`` by window and step, ``there`` marks real steps."""
    steps = index.shape[1]
    masks = [there[:, t : t + 1] for t in range(steps)]
    at = np.ascontiguousarray(index.T)
    forth = _recur(p, "f", (np.take(projected[0], at[t], 0) for t in range(steps)), masks)
    back = _recur(p, "b", (np.take(projected[1], at[t], 0) for t in reversed(range(steps))), masks[::-1])[::-1]
    states = np.stack([np.concatenate([a[4], b[4]], 1) for a, b in zip(forth, back, strict=True)], 1)
    weight = states @ p["attend"]
    weight = np.where(there > 0, weight, -1e9)
    weight = np.exp(weight - weight.max(1, keepdims=True))
    weight /= weight.sum(1, keepdims=True)
    pooled = (weight[:, :, None] * states).sum(1)
    return pooled @ p["out"] + p["bias"][0], (forth, back, states, weight, pooled)


def project(p, vectors):
    return vectors @ p["xf"] + p["cf"], vectors @ p["xb"] + p["cb"]


def _recur_back(p, way, trace, d_states, masks):
    """Gradients of the projected inputs and the recurrent weights of one direction."""
    h, u = HIDDEN, p["h" + way]
    d_u, d_x, d_state = np.zeros_like(u), [], np.zeros_like(d_states[0])
    for (before, z, r, new, _), mask, d_out in zip(reversed(trace), reversed(masks), reversed(d_states), strict=True):
        d = d_state + d_out
        d_z, d_new = d * (new - before) * mask, d * z
        d_pre = d_new * (1 - new * new)
        d_rh = d_pre @ u[:, 2 * h :].T
        # z already holds the mask, which is 0 or 1
        d_gates = np.concatenate([d_z * z * (1 - z), d_rh * before * r * (1 - r)], 1)
        d_u[:, : 2 * h] += before.T @ d_gates
        d_u[:, 2 * h :] += (r * before).T @ d_pre
        d_state = d * (1 - z) + d_rh * r + d_gates @ u[:, : 2 * h].T
        d_x.append(np.concatenate([d_gates, d_pre], 1))
    return d_x[::-1], d_u


def gradients(p, vectors, index, there, y):
    """Loss and gradients of all network weights and of the input vectors."""
    logit, (forth, back, states, weight, pooled) = forward(p, project(p, vectors), index, there)
    q = _sigmoid(logit)
    loss = -np.mean(np.where(y > 0, np.log(q + 1e-9), np.log(1 - q + 1e-9)))
    d = ((q - y) / len(y)).astype(np.float32)
    g = {"out": d @ pooled, "bias": np.array([d.sum()], np.float32)}
    d_pooled = d[:, None] * p["out"]
    d_weight = (states * d_pooled[:, None, :]).sum(2)
    d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
    g["attend"] = np.einsum("nt,ntk->k", d_score, states)
    d_states = weight[:, :, None] * d_pooled[:, None, :] + d_score[:, :, None] * p["attend"]
    steps, h = index.shape[1], HIDDEN
    masks = [there[:, t : t + 1] for t in range(steps)]
    xf, g["hf"] = _recur_back(p, "f", forth, [d_states[:, t, :h] for t in range(steps)], masks)
    xb, g["hb"] = _recur_back(p, "b", back[::-1], [d_states[:, t, h:] for t in reversed(range(steps))], masks[::-1])
    xb = xb[::-1]
    d_steps = np.concatenate([np.stack(xf, 1), np.stack(xb, 1)], 2) * there[:, :, None]
    order = np.argsort(index, axis=None, kind="stable")
    used, begin = np.unique(index.ravel()[order], return_index=True)
    d_projected = np.zeros((len(vectors), 6 * h), d_steps.dtype)
    d_projected[used] = np.add.reduceat(d_steps.reshape(-1, 6 * h)[order], begin, axis=0)
    for way, part in (("f", d_projected[:, : 3 * h]), ("b", d_projected[:, 3 * h :])):
        g["x" + way], g["c" + way] = vectors.T @ part, part.sum(0)
    d_vectors = d_projected[:, : 3 * h] @ p["xf"].T + d_projected[:, 3 * h :] @ p["xb"].T
    return loss, g, d_vectors


def _index(words: Words, first, length):
    steps = np.arange(WINDOW)
    there = (steps < length[:, None]).astype(np.float32)
    at = np.minimum(first[:, None] + steps, len(words.of) - 1)
    return words.of[at], there


def window_logits(p, words: Words, first, length) -> np.ndarray:
    projected = project(p, words.vectors(p))
    out = np.zeros(len(first), np.float32)
    for a in range(0, len(first), BATCH):
        index, there = _index(words, first[a : a + BATCH], length[a : a + BATCH])
        out[a : a + BATCH] = forward(p, projected, index, there)[0]
    return out


def text_features(p, texts: Texts) -> np.ndarray:
    """Of each text: its ``TOP`` highest window logits, log of the expected number of toxic windows, log of all."""
    n = len(texts)
    out = np.zeros((n, TOP + 2))
    out[:, :TOP], out[:, TOP] = -LIMIT, -LIMIT
    if not len(texts.starts):
        return out
    words = Words(texts)
    text, first, length = windows(np.bincount(texts.doc, minlength=n))
    return _join(text, window_logits(p, words, first, length), out)


LIMIT = 8.0


def _join(text, logit, out):
    """Fill the features of :func:`text_features` from the logits of all windows."""
    logit = np.clip(logit, -LIMIT, LIMIT)
    order = np.lexsort((-logit, text))
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    top = rank < TOP
    out[text[top], rank[top]] = logit[order][top]
    n = len(out)
    out[:, TOP] = np.maximum(np.log(np.bincount(text, _sigmoid(logit), n) + 1e-9), -LIMIT)
    out[:, TOP + 1] = np.log1p(np.bincount(text, minlength=n))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights and, last, the bias of a logistic unit; both classes weigh alike. Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
    w = np.zeros(x.shape[1])
    penalty = decay * np.eye(len(w)) / 10
    for _ in range(steps):
        q = _sigmoid(x @ w)
        g = x.T @ (weight * (q - y)) + penalty @ w
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + penalty
        w = w - np.clip(np.linalg.solve(h + 1e-9 * np.eye(len(w)), g), -2, 2)
    return w


def fit(column: pa.Array, toxic: np.ndarray, rounds: int = 2, epochs: int = 5, rate: float = 0.02, seed: int = 7):
    """Network weights from labelled texts, and those of the logistic unit (``join``).

    Without texts of both classes all texts get the same score: high if all are toxic, else low.
    """
    p = initial(seed)
    if not len(column) or toxic.all() or not toxic.any():
        p["join"] = np.zeros(TOP + 3)
        p["join"][-1] = 2.0 if len(column) and toxic.all() else -2.0
        return p
    texts = next(chunks(column, 1 << 62, len(column)))[1]
    words, per_text = Words(texts), np.bincount(texts.doc, minlength=len(texts))
    text, first, length = windows(per_text)
    speaks = _evidence(np.unique(texts.doc * len(words) + words.of), len(words), toxic)
    np.maximum.at(p["words"][:, 0], words.number, (speaks / 4).astype(np.float32))
    doc_word = np.unique(texts.doc * len(words) + words.of)
    grams, of = words.grams_of(doc_word % len(words))
    hints = _evidence(np.unique((doc_word // len(words))[of] * CHARS + grams), CHARS, toxic)
    p["chars"][:, 0] = hints / 4
    np.maximum.at(speaks, words.word, hints[words.gram])
    index, there = _index(words, first, length)
    rating = np.where(there > 0, speaks[index], -np.inf).max(1)
    rng = np.random.default_rng(seed)
    moments: dict[str, list] = {}
    step = 0
    for round_ in range(rounds):
        order = np.lexsort((-rating, text))
        rank = np.empty(len(text), np.int64)
        starts = np.searchsorted(text[order], text[order])
        rank[order] = np.arange(len(text)) - starts
        # one window of every toxic text, two of every clean one, and any others of clean texts
        chosen = np.where(toxic[text] == 1, rank < 1, (rank < 2) | (rng.random(len(text)) < 0.05))
        chosen = np.flatnonzero(chosen)
        for _ in range(epochs):
            rng.shuffle(chosen)
            for a in range(0, len(chosen), 256):
                some = chosen[a : a + 256]
                index, there = _index(words, first[some], length[some])
                used, local = np.unique(index, return_inverse=True)
                vectors = words.vectors(p, used)
                _, g, d_vectors = gradients(p, vectors, local.reshape(index.shape), there, toxic[text[some]])
                step += 1
                number = words.number[used]
                np.subtract.at(p["words"], number, rate * 10 * d_vectors[:, :SIZE])
                grams, of = words.grams_of(used)
                np.subtract.at(p["chars"], grams, rate * 10 * (d_vectors[:, SIZE:] * words.scale[used])[of])
                for name, grad in g.items():
                    m = moments.setdefault(name, [np.zeros_like(grad), np.zeros_like(grad)])
                    m[0] = 0.9 * m[0] + 0.1 * grad
                    m[1] = 0.999 * m[1] + 0.001 * grad * grad
                    p[name] -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        rating = window_logits(p, words, first, length)
    empty = np.zeros((len(texts), TOP + 2))
    empty[:, : TOP + 1] = -LIMIT
    p["join"] = _logistic(_join(text, rating, empty), toxic)
    return p


def _evidence(pairs: np.ndarray, kinds: int, toxic: np.ndarray) -> np.ndarray:
    """How much each kind speaks for toxicity: z of the shares of texts that hold it.

    ``pairs`` are distinct ``text * kinds + kind``.
    """
    label, kind = toxic[pairs // kinds], pairs % kinds
    have = np.stack([np.bincount(kind[label == v], minlength=kinds) for v in (0, 1)])
    total = np.array([(toxic == 0).sum(), (toxic == 1).sum()])[:, None]
    share = have.sum(0) / total.sum()
    return (have[1] / total[1] - have[0] / total[0]) / np.sqrt(share * (1 - share) * (1 / total).sum() + 1e-12)


def train(docs: DataFrame, labels: DataFrame, learn: str, sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Fit on at most ``sample_rows`` labelled texts among those where the SQL condition ``learn`` holds.

    Half of them toxic if there are enough, by the smallest hashes of their ids.
    Null labels do not count; of several labels of an id the highest does. Texts
    are whole; where those of a class have more than ``FIT_CHARS`` characters, its
    longest ones stay away, but never all.
    """
    rated = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(learn)
    rated = rated.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    half = [rated.where(c).orderBy(*order).limit(sample_rows // 2) for c in ("toxic > 0", "toxic <= 0")]
    chosen = half[0].union(half[1])
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long"), text).join(F.broadcast(chosen), "doc_id")
    longest = _longest_kept(rows.groupBy(F.col("toxic") > 0, F.length("text")).count().collect())
    limit = F.when(F.col("toxic") > 0, longest[True]).otherwise(longest[False])
    rows = rows.where(F.length("text") <= limit)
    # the sample is bounded, so one task can hold it; an executor has the memory for the fit, the driver need not
    parts = rows.select("doc_id", "text", "toxic").repartition(1).mapInArrow(_fit_task, "name string, data binary, shape string")
    weights = {r["name"]: np.frombuffer(r["data"], np.float32).reshape(_shape(r["shape"])) for r in parts.collect()}
    return weights or fit(pa.array([], pa.string()), np.zeros(0, np.int64))


def _shape(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(",")))


def _fit_task(batches):
    parts = [b for b in batches if b.num_rows]
    if parts:
        table = pa.Table.from_batches(parts).sort_by("doc_id")
        weights = fit(table["text"].combine_chunks(), (table["toxic"].to_numpy() > 0).astype(np.int64))
        for name, w in weights.items():
            yield pa.RecordBatch.from_pydict(
                {"name": [name], "data": [w.astype(np.float32).tobytes()], "shape": [",".join(map(str, w.shape))]}
            )


#: Characters of one class that the fit may take, see :func:`train`.
FIT_CHARS = 1 << 23


def _longest_kept(lengths) -> dict[bool, int]:
    """Per class the greatest length up to which all its texts fit; its least length at least.

    ``lengths`` are (toxic, characters, texts), of a bounded sample.
    """
    kept, total = {}, {}
    for toxic, chars, texts in sorted(map(tuple, lengths)):
        total[toxic] = total.get(toxic, 0) + chars * texts
        if toxic not in kept or total[toxic] <= FIT_CHARS:
            kept[toxic] = chars
    return {c: kept.get(c, 0) for c in (True, False)}


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``(doc_id, score, predicted)``: probability of toxicity of each whole text.

    All overlapping windows are scored; the text's score joins its highest window scores and
    the evidence counted over the text.

    Texts that are null, empty or blank have no window and score 0. Equal texts
    score equally; repeated rows are scored one by one; an empty table gives an
    empty table. Only ``text`` enters the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        p = shared.value
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                value = _sigmoid(text_features(p, texts) @ p["join"][:-1] + p["join"][-1])
                value = np.where(np.bincount(texts.doc, minlength=len(texts)) > 0, value, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)),
                        pa.array(value),
                        pa.array((value >= 0.5).astype(np.int32)),
                    ],
                    ["doc_id", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
