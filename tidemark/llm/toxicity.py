"""Operator 4: toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word enters as a hashed word embedding next to the average of its hashed character n-gram embeddings. Windows of words overlap;
in each a forward and a backward gated recurrent layer read the words, attention pools their states and a linear layer gives a logit.
A text scores as its worst window; every word of every text is in one or two. What white space does not part (Chinese or Thai lines,
words joined by dots, underscores or U+00A0) counts as one word only up to 64 bytes; longer words are parted at other signs and Unicode
spaces, and what is still longer is cut into overlapping pieces, so that each of its n-grams enters a window. Training (numpy, Adam) knows labels of whole texts only:
the windows of a text share its gradient in proportion to how toxic they already look.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import U, Words, mix, span_hashes, text_slices
from .decontam import fold

WORD_BITS, GRAM_BITS = 14, 14
WORD_DIMS, GRAM_DIMS = 8, 16
HIDDEN = 8
WINDOW, STRIDE = 12, 8
GRAMS = (3, 4)
LONG = 64  # bytes; longer words are cut
PIECE, STEP = 16, 12  # pieces overlap by the longest n-gram
TRAIN_PER_CLASS = 1000
TRAIN_WORDS = 1000  # only texts of at most so many words are drawn for training
SLICE = 1 << 20
BLOCK, INPUTS = 2048, 4096  # windows and distinct words that are always computed together
DIGITS = 6


def unicode_spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to U+00A0, U+2000-200B, U+202F or U+3000."""
    out = np.zeros(len(data), bool)
    two = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xA0))
    a, b, c = data[:-2], data[1:-1], data[2:]
    three = np.flatnonzero((a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8B) | (c == 0xAF)) | (a == 0xE3) & (b == 0x80) & (c == 0x80))
    for places, size in ((two, 2), (three, 3)):
        for k in range(size):
            out[places + k] = True
    return out


def cut_long(data: np.ndarray, solid: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds and documents of the words with those of over LONG bytes replaced by their parts and pieces, in the order of the text."""
    far = np.flatnonzero(hi - lo > LONG)
    if not len(far):
        return lo, hi, doc
    good = solid & ~unicode_spaces(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[lo[far]] = edge[hi[far]] = True
    start = np.flatnonzero(good & (~np.concatenate(([False], good[:-1])) | edge[:-1]))
    end = np.flatnonzero(good & (~np.concatenate((good[1:], [False])) | edge[1:])) + 1
    owner = np.searchsorted(lo[far], start, side="right") - 1
    mine = (owner >= 0) & (start < hi[far][owner])
    start, end, owner = start[mine], end[mine], doc[far][owner[mine]]
    size = end - start
    count = np.where(size > LONG, -(-(size - PIECE) // STEP) + 1, 1)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    low, high, cut = np.repeat(start, count), np.repeat(end, count), np.repeat(size > LONG, count)
    first, last = low + k * STEP, np.where(cut, np.minimum(low + k * STEP + PIECE, high), high)
    # no piece begins or ends inside a character
    for _ in range(3):
        first = first - ((first > low) & (data[first] & 0xC0 == 0x80))
        last = last + ((last < high) & (data[np.minimum(last, len(data) - 1)] & 0xC0 == 0x80))
    near = hi - lo <= LONG
    lo, hi, doc = np.concatenate((lo[near], first)), np.concatenate((hi[near], last)), np.concatenate((doc[near], np.repeat(owner, count)))
    order = np.argsort(lo, kind="stable")
    return lo[order], hi[order], doc[order]


class Tokens:
    """Distinct words of a slice of texts with their embedding buckets, and where the words stand."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        data = fold(words.data)
        solid = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
        places = np.flatnonzero(solid)
        low, high = np.searchsorted(places, words.start), np.searchsorted(places, words.end)
        some = high > low
        lo, hi, self.doc = cut_long(data, solid, places[low[some]], places[high[some] - 1] + 1, words.doc[some])
        bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.first, self.n = bounds[:-1], np.diff(bounds)
        h = span_hashes(data, lo, hi)
        _, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.bucket = (h[first] >> U(64 - WORD_BITS)).astype(np.int64)
        self.grams(data, lo[first], hi[first])

    def grams(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Buckets of the n-grams of each distinct word, with a border byte before and after it."""
        size = hi - lo
        width = size + 2
        at = np.concatenate(([0], np.cumsum(width)[:-1])) if len(lo) else np.zeros(0, np.int64)
        total = int(width.sum())
        owner = np.repeat(np.arange(len(lo)), width)
        place = np.arange(total) - np.repeat(at, width)
        inside = (place > 0) & (place <= size[owner]) if total else np.zeros(0, bool)
        flat = np.full(total, 32, np.uint64)
        flat[inside] = data[(lo[owner] + place - 1)[inside]]
        owners, buckets = [], []
        for gram in GRAMS:
            m = total - gram + 1
            if m <= 0:
                continue
            h = np.zeros(m, np.uint64)
            for k in range(gram):
                h = h * U(0x9E3779B97F4A7C15) + flat[k:k + m] + U(1)
            ok = owner[:m] == owner[gram - 1:]
            owners.append(owner[:m][ok])
            buckets.append(mix(h[ok] + U(gram)) >> U(64 - GRAM_BITS))
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        bucket = (np.concatenate(buckets) if buckets else np.zeros(0, np.uint64)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        self.gram_owner, self.gram = owner[order], bucket[order]
        self.n_grams = np.bincount(self.gram_owner, minlength=len(lo))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows x WINDOW) numbers of distinct words, -1 past the end of a text; and the text of each window. A text without words has none."""
        count = np.where(self.n > 0, np.maximum(0, -(-(self.n - WINDOW) // STRIDE)) + 1, 0)
        doc = np.repeat(np.arange(len(self.n)), count)
        k = np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count) if len(doc) else doc
        # the last window ends with the text
        start = np.minimum(k * STRIDE, np.maximum(self.n[doc] - WINDOW, 0))
        at = start[:, None] + np.arange(WINDOW)
        ok = at < self.n[doc][:, None]
        word = self.word[np.minimum(self.first[doc][:, None] + at, max(len(self.word) - 1, 0))] if len(self.word) else at
        return np.where(ok, word, -1), doc


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


@dataclass
class Network:
    """Parameters by name; float32."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng, d, h = np.random.default_rng(seed), WORD_DIMS + GRAM_DIMS, HIDDEN
        shapes = {"word": (1 << WORD_BITS, WORD_DIMS), "gram": (1 << GRAM_BITS, GRAM_DIMS), "attend": (2 * h, h), "query": (h,), "out": (2 * h,), "bias": (1,)}
        for side in ("f", "b"):
            shapes |= {f"in_{side}": (d, 3 * h), f"rec_{side}": (h, 3 * h), f"off_{side}": (3 * h,)}
        scale = {"word": 0.1, "gram": 0.3, "bias": 0.0, "off_f": 0.0, "off_b": 0.0}
        return cls({k: (rng.normal(0, scale.get(k, 1 / np.sqrt(s[0])), s)).astype(np.float32) for k, s in shapes.items()})

    def inputs(self, t: Tokens, block: int = 1 << 15) -> np.ndarray:
        """Input vector of each distinct word, ``block`` words at a time."""
        total = np.zeros((len(t.bucket), GRAM_DIMS), np.float32)
        bound = np.concatenate(([0], np.cumsum(t.n_grams)))
        for i in range(0, len(total), block):
            j = min(i + block, len(total))
            grams, has = self.p["gram"][t.gram[bound[i]:bound[j]]], i + np.flatnonzero(t.n_grams[i:j])
            if len(grams):
                total[has] = np.add.reduceat(grams, bound[has] - bound[i], axis=0)
        return np.concatenate((self.p["word"][t.bucket], total / np.maximum(t.n_grams, 1)[:, None].astype(np.float32)), 1)

    def gate_inputs(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each distinct word feeds into the gates of both directions; the last row is that of a place past the end."""
        padded = np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))
        return {side: padded @ self.p[f"in_{side}"] + self.p[f"off_{side}"] for side in "fb"}

    def forward(self, gates: dict[str, np.ndarray], windows: np.ndarray, keep: bool = False):
        """Logits of windows of distinct words; with ``keep`` also what the gradient needs."""
        n, steps, h = len(windows), windows.shape[1], HIDDEN
        mask = (windows >= 0).astype(np.float32)
        states = np.zeros((n, steps, 2 * h), np.float32)
        trail: dict = {"mask": mask}
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            rec, state, kept = self.p[f"rec_{side}"], np.zeros((n, h), np.float32), []
            at = 0 if side == "f" else h
            for t in order:
                g = gates[side][windows[:, t]]  # -1 is the last row
                u = state @ rec[:, :2 * h]
                zr = sigmoid(g[:, :2 * h] + u)
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h:] + (r * state) @ rec[:, 2 * h:])
                m = mask[:, t:t + 1]
                new = state + m * z * (c - state)
                if keep:
                    kept.append((t, state, z, r, c))
                state = new
                states[:, t, at:at + h] = state
            trail[side] = kept
        hidden = np.tanh(states @ self.p["attend"])
        score = np.where(mask > 0, hidden @ self.p["query"], -1e9)
        weight = np.exp(score - score.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = (weight[:, :, None] * states).sum(1)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        trail |= {"states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
        return (logit, trail) if keep else logit

    def backward(self, x: np.ndarray, windows: np.ndarray, trail: dict, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters above the inputs, and of the inputs of the distinct words."""
        h, g = HIDDEN, {}
        mask, states, hidden, weight, pooled = (trail[k] for k in ("mask", "states", "hidden", "weight", "pooled"))
        g["bias"], g["out"] = np.array([d_logit.sum()]), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = (states * d_pooled[:, None, :]).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        g["query"] = np.einsum("nth,nt->h", hidden, d_score)
        d_pre = d_score[:, :, None] * self.p["query"] * (1 - hidden ** 2)
        g["attend"] = np.einsum("nts,nth->sh", states, d_pre)
        d_states = weight[:, :, None] * d_pooled[:, None, :] + d_pre @ self.p["attend"].T
        padded = np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))
        d_x = np.zeros((len(padded), x.shape[1]), np.float32)
        for side in ("f", "b"):
            rec, w_in, at = self.p[f"rec_{side}"], self.p[f"in_{side}"], 0 if side == "f" else h
            d_rec, d_in, d_off, d_state = np.zeros_like(rec), np.zeros_like(w_in), np.zeros(3 * h, np.float32), np.zeros((len(windows), h), np.float32)
            for t, state, z, r, c in reversed(trail[side]):
                d_new, m = d_state + d_states[:, t, at:at + h], mask[:, t:t + 1]
                d_c = d_new * m * z * (1 - c ** 2)
                d_z = d_new * m * (c - state) * z * (1 - z)
                back = d_c @ rec[:, 2 * h:].T
                d_r = back * state * r * (1 - r)
                gate = np.concatenate((d_z, d_r, d_c), 1)
                d_rec[:, :2 * h] += state.T @ gate[:, :2 * h]
                d_rec[:, 2 * h:] += (r * state).T @ d_c
                word = windows[:, t]
                d_in += padded[word].T @ gate
                d_off += gate.sum(0)
                np.add.at(d_x, word, gate @ w_in.T)
                d_state = d_new * (1 - m * z) + back * r + gate[:, :2 * h] @ rec[:, :2 * h].T
            g |= {f"rec_{side}": d_rec, f"in_{side}": d_in, f"off_{side}": d_off}
        return g, d_x[:-1]

    def score(self, texts: pa.Array) -> np.ndarray:
        """Largest window probability of each text; a text without words has the probability of an empty window.

        Matrix products round differently in other shapes, so words and windows are always computed in blocks of one size, the last one filled
        up, and the result is rounded: a text's score does not depend on the texts that share its batch.
        """
        t = Tokens(texts)
        windows, doc = t.windows()
        best = np.full(len(texts), self.p["bias"][0], np.float32)
        if len(windows):
            x = self.inputs(t)
            filled = np.concatenate((x, np.zeros((-len(x) % INPUTS, x.shape[1]), np.float32)))
            parts = [self.gate_inputs(filled[i:i + INPUTS]) for i in range(0, len(filled), INPUTS)]
            # the last row of each part is that of a place past the end
            gates = {side: np.concatenate([part[side][:-1] for part in parts][:-1] + [parts[-1][side]]) for side in "fb"}
            full = np.concatenate((windows, np.full((-len(windows) % BLOCK, windows.shape[1]), -1, windows.dtype)))
            logit = np.concatenate([self.forward(gates, full[i:i + BLOCK]) for i in range(0, len(full), BLOCK)])[:len(windows)]
            has = t.n > 0
            best[has] = np.maximum.reduceat(logit, np.searchsorted(doc, np.flatnonzero(has)))
        return np.round(sigmoid(best.astype(np.float64)), DIGITS)


def train(texts: list[str], labels: list[int], epochs: int = 6, steps: int = 150, batch: int = 48, rate: float = 0.02, top: int = 6, seed: int = 11) -> Network | None:
    """Fit on whole labelled texts, ``epochs`` times over and for ``steps`` steps at least; None unless both labels occur."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    order = rng.permutation(len(y))
    read = []
    for at in range(0, len(order), batch):
        some = order[at:at + batch]
        t = Tokens(pa.array([texts[i] for i in some], pa.large_string()))
        if len(t.word):
            read.append((some, t, *t.windows()))
    if not read:
        return None
    epochs = max(epochs, -(-steps // len(read)))
    step, total = 0, epochs * len(read)
    for _ in range(epochs):
        for k in rng.permutation(len(read)):
            some, t, windows, doc = read[k]
            x = net.inputs(t)
            gates = net.gate_inputs(x)
            logit = np.concatenate([net.forward(gates, windows[i:i + 2048]) for i in range(0, len(windows), 2048)])
            # the worst windows of each text stand for it
            by = np.lexsort((-logit, doc))
            rank = np.arange(len(by)) - np.searchsorted(doc[by], doc[by])
            used = by[rank < top]
            owner = doc[used]
            logit, trail = net.forward(gates, windows[used], keep=True)
            peak = np.full(len(some), -np.inf, np.float32)
            np.maximum.at(peak, owner, logit)
            soft = np.exp(logit - peak[owner])
            soft /= np.bincount(owner, soft, minlength=len(some))[owner]
            text_logit = np.bincount(owner, soft * logit, minlength=len(some))
            error = (sigmoid(text_logit) - y[some]) / len(some)
            grads, d_x = net.backward(x, windows[used], trail, (soft * error[owner]).astype(np.float32))
            g_word = np.zeros_like(net.p["word"])
            np.add.at(g_word, t.bucket, d_x[:, :WORD_DIMS])
            g_gram = np.zeros_like(net.p["gram"])
            live = np.abs(d_x).sum(1)[t.gram_owner] > 0
            np.add.at(g_gram, t.gram[live], (d_x[:, WORD_DIMS:] / np.maximum(t.n_grams, 1)[:, None])[t.gram_owner[live]])
            grads |= {"word": g_word, "gram": g_gram}
            step += 1
            now = rate * min(1.0, step / 20) * (1 - step / (total + 1))
            for k, g in grads.items():
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                net.p[k] = (net.p[k] - now * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return net


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int, max_words: int) -> list:
    """At most ``per_class`` labelled ids of each label, drawn by a hash of the id, and their whole texts if these are not too long.

    ``docs`` has doc_id and text, ``labels`` doc_id and label. What reaches the driver is bounded by both parameters.
    """
    sample = None
    for value in (0, 1):
        some = labels.where((F.col("label") == value) & learn).groupBy("doc_id").agg(F.max("label").alias("label"))
        some = some.withColumn("lot", F.xxhash64("doc_id")).orderBy("lot", "doc_id").limit(per_class)
        sample = some if sample is None else sample.unionByName(some)
    short = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= 16 * max_words) & (F.size(F.split("text", r"\s+")) <= max_words))
    rows = short.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label", "lot").agg(F.min("text").alias("text")).collect()
    return sorted(rows, key=lambda r: (r["lot"], r["doc_id"], r["label"]))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, per_class: int = TRAIN_PER_CLASS, max_words: int = TRAIN_WORDS,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """A network fitted on labelled documents outside ``held_out`` (a condition on doc_id); None unless both labels occur among them."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    marks = labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("doc_id IS NOT NULL")
    learn = ~F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(True)
    known = labelled(rows, marks, learn, per_class, max_words)
    return train([r["text"] for r in known], [r["label"] for r in known])


def scores_of(net: Network | None, text: pa.Array) -> np.ndarray:
    """Score of every text of an Arrow column, in slices of bounded size."""
    if net is None or not len(text):
        return np.zeros(len(text))
    batch = pa.RecordBatch.from_arrays([text], ["text"])
    return np.concatenate([net.score(b.column("text")) for b in text_slices([batch], SLICE)])


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.7, per_class: int = TRAIN_PER_CLASS, max_words: int = TRAIN_WORDS,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``threshold``) for every document.

    ``held_out`` is a condition on doc_id: labels of such documents are never looked at. Learns from at most ``per_class`` labelled
    texts of each label with at most ``max_words`` words; labels other than 0 and 1 and null ids or texts teach nothing. Whole texts are
    scored in overlapping windows. A null, empty or wordless text gets the score of an empty window; without texts of both labels to learn
    from all scores are 0. A null id stays null; repeated rows are scored each time; an empty table gives no rows; further columns are
    ignored.
    """
    net = fit(docs, labels, held_out, per_class, max_words, id_col, text_col, label_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = scores_of(net, b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    return rows.select("doc_id", "text", held.alias("held_out")).mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.7, text_col: str = "text", **fitting) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns, and nothing is shuffled.

    Only the text travels to Python; the rows wait in the JVM for their verdicts. Scores are those of ``score_toxicity``: null, empty and wordless
    texts have that of an empty window, repeated rows stay or go together, null ids are no different from others, an empty table stays empty.
    """
    net = fit(docs, labels, held_out, text_col=text_col, **fitting)

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield pa.array(scores_of(net, text) < threshold)

    return docs.where(clean(docs[text_col].cast("string")))
