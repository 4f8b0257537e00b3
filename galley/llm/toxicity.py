"""Toxicity: a bidirectional gated recurrent network over characters and words with attention pooling, trained in numpy.

A word (lower-cased letters and digits; longer ones in parts of WORD_CHARS characters) is read by a character-level two-way GRU;
its end states and a hashed word vector feed a word-level two-way GRU over a window of words; attention pools the states
and a logistic unit scores the window. All overlapping windows of a text are scored, the highest decides, and a logistic curve
over that maximum, fitted on the labelled sample, is the score.

Fitting takes a bounded sample (`per_class` labelled documents, chosen by a hash of the id) to the driver. Labels are
of whole documents, so the first windows to learn from are those whose character n-grams stand out by their document frequencies in
the classes; later rounds choose by the network itself: the best windows of toxic texts, the worst of the others.

Edge cases: a null text counts as empty; a text without words scores 0; without labels of both classes every text scores
0; equal texts score alike (up to rounding of single precision); ids and other columns never reach the network; an empty table gives
an empty one.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh_name

WORD_CHARS, WINDOW, STRIDE = 12, 32, 16
WORDS = re.compile(r"[^\W_]{1,%d}" % WORD_CHARS)
CHARS, BUCKETS, H_CHAR, H_WORD = 128, 1 << 14, 8, 8
#: Labelled documents of each class (harmless, toxic) that the network learns from, at most.
PER_CLASS = (2400, 800)
THRESHOLD = 0.3
#: Share of toxic documents that the scores are calibrated for; held-out harmless texts reach further up than those learnt from.
PRIOR = 0.1
#: Words whose vectors a worker keeps before it starts afresh.
CACHE = 200_000


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def window_starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Starts of overlapping windows that cover n words; the last ends with the text."""
    if n <= window:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - window, stride)
    return np.append(starts, n - window)


def _sigmoid(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


# ---- two-way GRU: axis 1 of every array is the direction; sequences are padded at their ends


def gru(x, u, b, mask=None, keep=False):
    """x (T, 2, B, 3H): input parts; u (2, H, 3H); b (2, 1, H). States (T, 2, B, H), and what the way back needs."""
    steps, _, n, h3 = x.shape
    h = h3 // 3
    state = np.zeros((2, n, h), np.float32)
    states = np.empty((steps, 2, n, h), np.float32)
    saved = []
    for t in range(steps):
        a = np.matmul(state, u)
        gates = _sigmoid(x[t, :, :, : 2 * h] + a[:, :, : 2 * h])
        z, r = gates[:, :, :h], gates[:, :, h:]
        inner = a[:, :, 2 * h :] + b
        new = np.tanh(x[t, :, :, 2 * h :] + r * inner)
        after = new + z * (state - new)
        if mask is not None:
            after = state + mask[t][None, :, None] * (after - state)
        if keep:
            saved.append((state, z, r, inner, new))
        state = after
        states[t] = state
    return states, saved


def gru_back(d_states, saved, u, mask=None):
    """Gradients of x, u and b for gradients of all states."""
    steps, _, n, h = d_states.shape
    dx = np.empty((steps, 2, n, 3 * h), np.float32)
    du, db = np.zeros_like(u), np.zeros((2, 1, h), np.float32)
    carry = np.zeros((2, n, h), np.float32)
    back = u.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        state, z, r, inner, new = saved[t]
        d = carry + d_states[t]
        rest = 0.0
        if mask is not None:
            m = mask[t][None, :, None]
            rest, d = d * (1 - m), d * m
        d_new = d * (1 - z) * (1 - new * new)
        d_inner = d_new * r
        d_z = d * (state - new) * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_inner], axis=2)
        dx[t] = np.concatenate([d_z, d_r, d_new], axis=2)
        du += np.matmul(state.transpose(0, 2, 1), d_a)
        db += d_inner.sum(axis=1, keepdims=True)
        carry = rest + d * z + np.matmul(d_a, back)
    return dx, du, db


def _both_ways(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """ids (B, T) -> (T, 2, B): as they are, and each reversed within its length."""
    n, steps = ids.shape
    at = lengths[:, None] - 1 - np.arange(steps)[None, :]
    turned = np.take_along_axis(ids, np.maximum(at, 0), axis=1)
    return np.stack([ids.T, turned.T], axis=1)


def split_gates(array: np.ndarray, h: int) -> list[np.ndarray]:
    """Weights by gate for fast_gru: signs and a factor 2 are folded in, so that each gate needs one exponential."""
    return [np.ascontiguousarray(array[..., g * h : (g + 1) * h] * np.float32(k)) for g, k in enumerate((-1.0, -1.0, 2.0))]


def split_table(table: np.ndarray) -> list[list[np.ndarray]]:
    """(rows, 2, 3H) by direction and gate, scaled as split_gates says."""
    return [split_gates(table[:, way], table.shape[2] // 3) for way in (0, 1)]


def fast_gru(table: list[list[np.ndarray]], ids: np.ndarray, u: list[np.ndarray], r_bias: np.ndarray, every: bool):
    """The states of sequences of equal length, ids (B, T) into a split table: all of them (T, B, 2H) or the last (B, 2H)."""
    n, steps = ids.shape
    h = u[0].shape[2]
    turned = np.ascontiguousarray(ids.T)
    shape = (2, n, h)
    state = np.zeros(shape, np.float32)
    both = np.empty((steps if every else 1, n, 2 * h), np.float32)
    x, a = np.empty((3, *shape), np.float32), np.empty(shape, np.float32)
    with np.errstate(over="ignore"):
        for t in range(steps):
            for way, row in ((0, turned[t]), (1, turned[steps - 1 - t])):
                for g in range(3):
                    np.take(table[way][g], row, axis=0, out=x[g, way], mode="clip")
            z, r, new = x
            for g, gate in ((0, z), (1, r)):
                gate += np.matmul(state, u[g], out=a)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
            np.matmul(state, u[2], out=a)
            a += r_bias
            a *= r
            new += a
            np.exp(new, out=new)
            new += 1
            np.divide(-2, new, out=new)
            new += 1
            state -= new
            state *= z
            state += new
            if every:
                both[t, :, :h] = state[0]
                both[steps - 1 - t, :, h:] = state[1]
    if not every:
        both[0, :, :h], both[0, :, h:] = state
    return both if every else both[0]


class Network:
    """Parameters p and the passes of the network."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        p = {
            "char": draw(2, CHARS, 3 * H_CHAR) * 0.3, "cu": draw(2, H_CHAR, 3 * H_CHAR) / H_CHAR**0.5, "cb": np.zeros((2, 1, H_CHAR), np.float32),
            "join": draw(2 * H_CHAR, 6 * H_WORD) / (2 * H_CHAR) ** 0.5, "hashed": draw(BUCKETS, 6 * H_WORD) * 0.05, "wb": np.zeros(6 * H_WORD, np.float32),
            "wu": draw(2, H_WORD, 3 * H_WORD) / H_WORD**0.5, "wr": np.zeros((2, 1, H_WORD), np.float32),
            "aw": draw(2 * H_WORD, H_WORD) / (2 * H_WORD) ** 0.5, "ab": np.zeros(H_WORD, np.float32), "av": draw(H_WORD), "out": draw(2 * H_WORD) * 0.5, "bias": np.zeros(1, np.float32),
        }
        return cls(p)

    def char_inputs(self, chars, lengths):
        ways = _both_ways(chars, lengths)
        return ways, np.stack([self.p["char"][0][ways[:, 0]], self.p["char"][1][ways[:, 1]]], axis=1)

    def word_table(self, pieces: list[str], batch: int = 1024) -> np.ndarray:
        """(pieces, 2, 3H): what each word gives to both directions of the word GRU. Words of equal length go together, so no step is padded."""
        table = np.empty((len(pieces), 6 * H_WORD), np.float32)
        chars, u, r = split_table(self.p["char"].transpose(1, 0, 2)), split_gates(self.p["cu"], H_CHAR), self.p["cb"] * np.float32(2)
        lengths = np.array([len(w) for w in pieces])
        for size in np.unique(lengths):
            same = np.flatnonzero(lengths == size)
            for low in range(0, len(same), batch):
                at = same[low : low + batch]
                table[at] = fast_gru(chars, char_ids([pieces[i] for i in at], int(size)), u, r, False) @ self.p["join"]
        table += self.p["hashed"][hash_ids(pieces)] + self.p["wb"]
        return table.reshape(len(pieces), 2, 3 * H_WORD)

    def pooled(self, states):
        """Attention over states (B, T, 2H): the logits; the parts for the way back."""
        inner = np.tanh(states @ self.p["aw"] + self.p["ab"])
        weight = inner @ self.p["av"]
        return inner, weight

    def logits(self, table: list[list[np.ndarray]], ids: np.ndarray) -> np.ndarray:
        """Of windows of equal length: ids (B, T) into a split table."""
        both = fast_gru(table, ids, split_gates(self.p["wu"], H_WORD), self.p["wr"] * np.float32(2), True)
        _, weight = self.pooled(both)
        weight = np.exp(weight - weight.max(axis=0))
        value = both @ self.p["out"]
        return (weight * value).sum(axis=0) / weight.sum(axis=0) + self.p["bias"][0]

    def learn(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Loss and gradients on windows ids (B, T), padded at the end."""
        p = self.p
        size = np.array([len(w) for w in pieces])
        chars = char_ids(pieces, int(size.max()))
        ways, xc = self.char_inputs(chars, size)
        c_mask = (np.arange(chars.shape[1])[:, None] < size[None, :]).astype(np.float32)
        c_states, c_saved = gru(xc, p["cu"], p["cb"], c_mask, True)
        ends = c_states[-1].transpose(1, 0, 2).reshape(len(pieces), -1)
        hashed = hash_ids(pieces)
        table = (ends @ p["join"] + p["hashed"][hashed] + p["wb"]).reshape(len(pieces), 2, 3 * H_WORD)
        w_ways = _both_ways(ids, lengths)
        x = np.stack([table[w_ways[:, 0], 0], table[w_ways[:, 1], 1]], axis=1)
        steps = ids.shape[1]
        mask = (np.arange(steps)[:, None] < lengths[None, :]).astype(np.float32)
        states, saved = gru(x, p["wu"], p["wr"], mask, True)
        turn = np.maximum(lengths[None, :] - 1 - np.arange(steps)[:, None], 0)
        back = np.take_along_axis(states[:, 1], turn[:, :, None], axis=0)
        both = np.concatenate([states[:, 0], back], axis=2)
        inner, a = self.pooled(both)
        a = np.where(mask > 0, a, -1e9)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        value = both @ p["out"]
        logit = (a * value).sum(axis=0) + p["bias"][0]
        prob = _sigmoid(logit)
        loss = -(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum() / weight.sum()
        d_logit = (weight * (prob - y) / weight.sum()).astype(np.float32)
        g = {"bias": np.array([d_logit.sum()], np.float32)}
        d_value = a * d_logit
        g["out"] = np.einsum("tb,tbh->h", d_value, both)
        d_both = d_value[:, :, None] * p["out"]
        d_a = d_logit * a * (value - (a * value).sum(axis=0))
        g["av"] = np.einsum("tb,tbh->h", d_a, inner)
        d_inner = d_a[:, :, None] * p["av"] * (1 - inner * inner)
        g["aw"] = np.einsum("tbi,tbj->ij", both, d_inner)
        g["ab"] = d_inner.sum(axis=(0, 1))
        d_both = d_both + d_inner @ p["aw"].T
        d_states = np.empty_like(states)
        d_states[:, 0] = d_both[:, :, :H_WORD]
        d_states[:, 1] = np.take_along_axis(d_both[:, :, H_WORD:], turn[:, :, None], axis=0) * mask[:, :, None]
        dx, g["wu"], g["wr"] = gru_back(d_states, saved, p["wu"], mask)
        d_table = np.zeros_like(table)
        for way in (0, 1):
            d_table[:, way] = _summed(w_ways[:, way].ravel(), dx[:, way].reshape(-1, 3 * H_WORD), len(pieces))
        d_flat = d_table.reshape(len(pieces), -1)
        g["wb"] = d_flat.sum(axis=0)
        g["hashed"] = _summed(hashed, d_flat, BUCKETS)
        g["join"] = ends.T @ d_flat
        d_ends = (d_flat @ p["join"].T).reshape(len(pieces), 2, H_CHAR).transpose(1, 0, 2)
        d_c = np.zeros_like(c_states)
        d_c[-1] = d_ends
        dxc, g["cu"], g["cb"] = gru_back(d_c, c_saved, p["cu"], c_mask)
        g["char"] = np.stack([_summed(ways[:, way].ravel(), dxc[:, way].reshape(-1, 3 * H_CHAR), CHARS) for way in (0, 1)])
        return float(loss), g


def _summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows summed by their place."""
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[places] = np.add.reduceat(rows[order], first, axis=0)
    return out


def char_ids(pieces: list[str], size: int) -> np.ndarray:
    """(pieces, size) code points folded into CHARS classes; ASCII keeps its own, padding is 0."""
    code = np.array(pieces, dtype=f"<U{size}").view(np.uint32).reshape(len(pieces), size)
    return np.where(code < 128, code, 1 + (code * np.uint32(2654435761) >> np.uint32(7)) % np.uint32(31)).astype(np.int64)


def hash_ids(pieces: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) for w in pieces], np.int64) % BUCKETS


class Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Scorer:
    """Scores texts; keeps the vectors of the words it has met, up to CACHE of them."""

    def __init__(self, params: dict[str, np.ndarray], slope: float, shift: float):
        self.net, self.slope, self.shift = Network(params), slope, shift
        self.known = Numbers()
        self.table = split_table(np.empty((0, 2, 3 * H_WORD), np.float32))

    def ids_of(self, texts_words: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE:
            self.known, self.table = Numbers(), [[g[:0] for g in way] for way in self.table]
        before = len(self.known)
        out = [np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)) for ws in texts_words]
        if len(self.known) > before:
            more = split_table(self.net.word_table(list(self.known)[before:]))
            self.table = [[np.concatenate([x, y]) for x, y in zip(old, new)] for old, new in zip(self.table, more)]
        return out

    def window_logits(self, ids: list[np.ndarray], batch: int = 1024):
        """(text, start, logit) of all windows of all texts."""
        where, starts = [], []
        for i, x in enumerate(ids):
            s = window_starts(len(x))
            where.append(np.full(len(s), i))
            starts.append(s)
        where, starts = np.concatenate(where), np.concatenate(starts)
        size = np.minimum(np.array([len(x) for x in ids])[where], WINDOW)
        flat = np.concatenate(ids) if len(ids) else np.empty(0, np.int64)
        offset = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        logits = np.empty(len(where), np.float32)
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            for low in range(0, len(at), batch):
                part = at[low : low + batch]
                windows = flat[(offset[where[part]] + starts[part])[:, None] + np.arange(length)[None, :]]
                logits[part] = self.net.logits(self.table, windows)
        return where, starts, logits

    def best(self, texts: list[str | None]) -> np.ndarray:
        """The highest window logit of each text; -inf without words."""
        ids = self.ids_of([words(t) for t in texts])
        where, _, logits = self.window_logits(ids)
        top = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(top, where, logits)
        return top

    def scores(self, texts: list[str | None]) -> np.ndarray:
        top = self.best(texts).astype(np.float64)
        with np.errstate(over="ignore"):
            return np.where(np.isneginf(top), 0.0, 1 / (1 + np.exp(-(self.slope * top + self.shift))))


# ---- fitting


def _parts(word: str) -> list[int]:
    """The word, its first and its last four characters, hashed."""
    return [zlib.crc32(x.encode()) & 0x3FFFF for x in (f"<{word}>", f"<{word[:4]}", f"{word[-4:]}>")]


def first_windows(vocabulary: list[str], docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """How much each word or its ends speak for the toxic class, by document frequencies."""
    parts = np.array([_parts(w) for w in vocabulary])
    df = np.zeros((2, 1 << 18), np.float32)
    for own, label in zip(docs, y):
        df[int(label), np.unique(parts[own])] += 1
    odds = np.log((df[1] + 0.5) / (y.sum() + 1)) - np.log((df[0] + 0.5) / (len(y) - y.sum() + 1))
    return odds[parts].max(axis=1)


def word_odds(hashed: np.ndarray, docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Where the words' own vectors start from: how much a bucket speaks for the toxic class, less where few documents have it."""
    df = np.zeros((2, BUCKETS), np.float32)
    for own, label in zip(docs, y):
        df[int(label), np.unique(hashed[own])] += 1
    odds = np.log((df[1] + 0.5) / (y.sum() + 1)) - np.log((df[0] + 0.5) / (len(y) - y.sum() + 1))
    return np.where(df[1] > 0, np.clip(odds, 0, None) * df[1] / (df[1] + 3), 0) * np.float32(0.3)


def fit(texts: list[str | None], labels: list[int], rounds: tuple[int, ...] = (150, 100, 70), seed: int = 7) -> tuple[dict, float, float] | None:
    """(parameters, slope, shift), or None without both classes."""
    seen: dict[str, int] = {}
    for t, label in zip(texts, labels):
        seen.setdefault(t or "", int(label))
    numbers, docs, y = Numbers(), [], []
    for t, label in seen.items():
        ws = words(t)
        if ws:
            docs.append(np.fromiter(map(numbers.__getitem__, ws), np.int32, len(ws)))
            y.append(label)
    y = np.array(y, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    vocabulary = list(numbers)
    rng = np.random.default_rng(seed)
    net = Network.new(seed)
    net.p["hashed"] += word_odds(hash_ids(vocabulary), docs, y)[:, None] * rng.normal(0, 1, 6 * H_WORD).astype(np.float32)

    def logits():
        scorer = Scorer(net.p, 1, 0)
        scorer.table = split_table(net.word_table(vocabulary))
        return scorer.window_logits(docs)[2]

    starts = [window_starts(len(d)) for d in docs]
    owner, start = np.repeat(np.arange(len(docs)), [len(s) for s in starts]), np.concatenate(starts)
    strength = first_windows(vocabulary, docs, y)
    value = np.array([np.sort(strength[docs[i][s : s + WINDOW]])[-2:].sum() for i, s in zip(owner, start)], np.float32)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, harmless = 0, np.flatnonzero(y[owner] == 0)
    for number, batches in enumerate(rounds):
        if number:
            value = logits()
        good, bad = _chosen(owner, value, y)
        for _ in range(batches):
            # Half the harmless windows are the hardest ones, half are any, so that no common word is taken for a sign.
            pick = np.concatenate([rng.choice(good, 32), rng.choice(bad, 32), rng.choice(harmless, 32)])
            step += 1
            windows = [docs[owner[i]][start[i] : start[i] + WINDOW] for i in pick]
            _step(net, vocabulary, windows, np.repeat([1.0, 0.0], (32, 64)).astype(np.float32), moments, step)
    top = np.full(len(docs), -np.inf, np.float32)
    np.maximum.at(top, owner, logits())
    slope, shift = _logistic(top.astype(np.float64), y)
    return net.p, slope, shift


def _chosen(owner: np.ndarray, value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two best windows of each document: of toxic ones to learn as such, of the others as hard harmless ones."""
    order = np.lexsort((-value, owner))
    own = owner[order]
    first = np.searchsorted(own, own)
    top = order[np.arange(len(order)) - first < 2]
    return top[y[owner[top]] == 1], top[y[owner[top]] == 0]


def _step(net: Network, vocabulary: list[str], windows: list[np.ndarray], y, moments, step, rate=0.01) -> float:
    own, at = np.unique(np.concatenate(windows), return_inverse=True)
    pieces = [vocabulary[i] for i in own]
    lengths = np.array([len(w) for w in windows])
    ids = np.zeros((len(windows), lengths.max()), np.int64)
    ids[np.arange(ids.shape[1])[None, :] < lengths[:, None]] = at
    loss, g = net.learn(pieces, ids, lengths, y, np.ones(len(y), np.float32))
    norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
    for k, x in g.items():
        x = x * min(1.0, 5.0 / (norm + 1e-9)) + (2e-5 * net.p[k] if k == "hashed" else 0)
        m, v = moments[k]
        m += 0.1 * (x - m)
        v += 0.01 * (x * x - v)
        net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return loss


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 200, penalty: float = 0.001) -> tuple[float, float]:
    """Slope and shift of a logistic curve, classes weighing as PRIOR says."""
    weight = np.where(y == 1, PRIOR / max(y.sum(), 1), (1 - PRIOR) / max((1 - y).sum(), 1))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p) + 1e-6 * weight
        ga, gb = (g * x).sum() + penalty * (a - 1), g.sum() + 1e-3 * penalty * b
        haa, hab, hbb = (h * x * x).sum() + penalty, (h * x).sum(), h.sum() + 1e-3 * penalty
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(abs(da), abs(db), 1.0)
        a, b = a - da / size, b - db / size
    return float(a), float(b)


# ---- the jobs



def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic): labelled rows, at most per_class of each class, whose crc32(id) mod 4 is not 2, lowest hash first."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.filter((mark % 4 != 2) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    ranked = known.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi").withColumn("order", F.xxhash64("doc_id"))
    chosen = [ranked.filter(F.col("toxic") == k).orderBy("order", "doc_id").limit(per_class[k]) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    # The sum of per_class is a bound that the data cannot exceed; rows that repeat an id count once.
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit_on(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, id_col: str = "doc_id", text_col: str = "text"):
    rows = sorted((r["text"] or "", r["toxic"]) for r in labelled_sample(docs, labels, per_class, id_col, text_col).collect())
    return fit([t for t, _ in rows], [x for _, x in rows])


def score_texts(docs: DataFrame, model, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns in keep and the score of each row's whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    inner = fresh_name([*keep, name], "_text")
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        scorer = Scorer(*shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(inner).to_pylist()
            found = np.zeros(len(texts))
            if scorer:
                for low in range(0, len(texts), 256):
                    found[low : low + 256] = scorer.scores(texts[low : low + 256])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.float64())], names=[*keep, name])

    return docs.selectExpr(*[f"`{c}`" for c in keep], f"`{text_col}` AS `{inner}`").mapInArrow(run, schema)
