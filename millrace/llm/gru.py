"""A bidirectional gated recurrent network with attention pooling, in numpy.

A window of words is read in both directions. A word's input is the sum of two hashed word vectors,
the scaled sum of its hashed character 3- to 5-grams, so words that share only letters share
strength, and what a table of counts says of the word and of its grams. Attention pools the states
of a window; a linear layer gives its logit.

Gates and states are squashed by x / (1 + abs(x)), which costs a third of exp in numpy: the gates
by half of one more than that.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Punctuation that is not part of a word at its ends.
EDGES = b".,;:!?\"'()[]{}<>*%&$#-_"
#: Longer words are read in pieces of this many bytes.
LONGEST_WORD = 64
GRAMS = (3, 4, 5)
GRAM_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Columns of an input that counts give.
COUNTED = 2


class Shape:
    """Sizes of the network."""

    def __init__(self, hidden: int = 8, word_dim: int = 16, char_dim: int = 12, bits: int = 15):
        self.hidden, self.word_dim, self.char_dim, self.bits = hidden, word_dim, char_dim, bits


def new_parameters(shape: Shape, seed: int) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    h, d = shape.hidden, shape.word_dim + shape.char_dim + COUNTED
    normal = lambda scale, *size: draw.normal(0, scale, size).astype(np.float32)
    return {
        "words": normal(0.05, 1 << shape.bits, shape.word_dim),
        "chars": normal(0.025, 1 << shape.bits, shape.char_dim),
        "into": normal(d**-0.5, d, 6 * h),
        "bias": np.zeros(6 * h, np.float32),
        "again": normal(h**-0.5, 2, h, 3 * h),
        "attend": normal(0.1, 2 * h),
        "out": normal(0.3, 2 * h),
        "out_bias": np.zeros(1, np.float32),
    }


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word a 64-bit hash; 32-bit hashes of its character grams, and where a word's start."""
    cores = [w.strip(EDGES) or w for w in words]
    hashes = np.array([xxhash.xxh64_intdigest(c) for c in cores], np.uint64)
    marked = [f"\x02{c.decode('utf-8', 'replace')}\x03" if c else "\x02\x01\x03" for c in cores]
    length = np.array([len(m) for m in marked], np.int64)
    letters = np.frombuffer("".join([*marked, "\0" * max(GRAMS)]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), length)
    end = np.repeat(np.cumsum(length), length)
    at = np.arange(len(word))
    code, owners, grams = np.zeros(len(word), np.uint64), [], []
    for k in range(max(GRAMS)):
        code = (code + letters[k : k + len(word)] + np.uint64(1)) * GRAM_MULTIPLIER
        code ^= code >> np.uint64(29)
        if k + 1 in GRAMS:
            whole = at + k + 1 <= end
            owners.append(word[whole])
            grams.append((code[whole] * GRAM_MULTIPLIER >> np.uint64(32)).astype(np.uint32))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return hashes, np.concatenate(grams)[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def word_inputs(p: dict[str, np.ndarray], hashes: np.ndarray, grams: np.ndarray, starts: np.ndarray, counted: np.ndarray) -> np.ndarray:
    a, b, chars = _buckets(p, hashes, grams)
    letters = np.add.reduceat(p["chars"][chars], starts[:-1]) / np.sqrt(np.diff(starts))[:, None].astype(np.float32)
    return np.concatenate([p["words"][a] + p["words"][b], letters, counted], 1)


def _buckets(p: dict[str, np.ndarray], hashes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two word vectors and of the grams' vectors."""
    last = np.uint64(len(p["words"]) - 1)
    return (hashes & last).astype(np.int64), (hashes >> np.uint64(32) & last).astype(np.int64), (grams & np.uint32(len(p["chars"]) - 1)).astype(np.int64)


def projected(p: dict[str, np.ndarray], hashes: np.ndarray, grams: np.ndarray, starts: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each word adds to the gates of the two directions."""
    both = word_inputs(p, hashes, grams, starts, counted) @ p["into"] + p["bias"]
    half = both.shape[1] // 2
    return np.ascontiguousarray(both[:, :half]), np.ascontiguousarray(both[:, half:])


def _squashed(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def every_window_logits(p: dict[str, np.ndarray], forth: np.ndarray, back: np.ndarray, ids: np.ndarray, window: int, block: int = 4096) -> np.ndarray:
    """Logits of the windows from each word of ids on, the last at the end; ids fill one window at least.

    Windows that follow each other read the same words one step apart, so a block's words are looked
    up once. States hold a row for each unit. Gates are kept doubled, so halves go into the weights.
    """
    h = p["again"].shape[1]
    again = np.ascontiguousarray(p["again"].transpose(0, 2, 1))
    again[:, 2 * h :] *= np.float32(0.5)
    read = np.stack([p["attend"].reshape(2, h), p["out"].reshape(2, h)], 1)
    out = np.empty(len(ids) - window + 1, np.float32)
    one, half = np.float32(1), np.float32(0.5)
    for start in range(0, len(out), block):
        n = min(block, len(out) - start)
        some = ids[start : start + n + window - 1]
        into = [np.ascontiguousarray(table[some].T) for table in (forth, back)]
        found = np.zeros((window, 2, n), np.float32)
        gates, both, size = np.empty((3 * h, n), np.float32), np.empty((2 * h, n), np.float32), np.empty((2 * h, n), np.float32)
        for k in (0, 1):
            state = np.zeros((h, n), np.float32)
            for t in range(window):
                at = window - 1 - t if k else t
                x = into[k][:, at : at + n]
                np.matmul(again[k], state, out=gates)
                np.add(gates[: 2 * h], x[: 2 * h], out=both)
                np.abs(both, out=size)
                size += one
                both /= size
                both += one
                new, width = gates[2 * h :], size[:h]
                new *= both[h:]
                new += x[2 * h :]
                np.abs(new, out=width)
                width += one
                new /= width
                state -= new
                state *= both[:h]
                state *= half
                state += new
                found[at] += read[k] @ state
        weight, value = found[:, 0], found[:, 1]
        weight = np.exp(weight - weight.max(0))
        out[start : start + n] = (value * weight).sum(0) / weight.sum(0) + p["out_bias"]
    return out


def window_logits(p: dict[str, np.ndarray], forth: np.ndarray, back: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Logits of windows (T x N indexes of words, whose projections forth and back hold)."""
    return _read(p, np.stack([forth[windows], back[windows[::-1]]], 1))[0]


def _read(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]:
    """Logits of windows from their inputs (T x 2 x N x 3h), and what their gradients need."""
    steps, _, n, _ = x.shape
    h = p["again"].shape[1]
    state = np.zeros((2, n, h), np.float32)
    kept = []
    for t in range(steps):
        gates = state @ p["again"]
        both = (_squashed(x[t, :, :, : 2 * h] + gates[:, :, : 2 * h]) + 1) * np.float32(0.5)
        z, r = both[:, :, :h], both[:, :, h:]
        new = _squashed(x[t, :, :, 2 * h :] + r * gates[:, :, 2 * h :])
        kept.append((state, z, r, new, gates[:, :, 2 * h :]))
        state = new + z * (state - new)
    ends = np.stack([k[0] for k in kept[1:]] + [state])
    states = np.concatenate([ends[:, 0], ends[::-1, 1]], 2)
    score = states @ p["attend"]
    soft = np.exp(score - score.max(0))
    soft /= soft.sum(0)
    pooled = (states * soft[:, :, None]).sum(0)
    return pooled @ p["out"] + p["out_bias"], kept, states, soft, pooled


def _scatter(size: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of values by their place."""
    return np.stack([np.bincount(at, c, size) for c in values.T], 1).astype(np.float32)


def gradients(p: dict[str, np.ndarray], features: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted mean logistic loss; features are those of the words that windows index."""
    inputs = word_inputs(p, *features)
    table = inputs @ p["into"] + p["bias"]
    steps, n = windows.shape
    h = p["again"].shape[1]
    x = table[windows].reshape(steps, n, 2, 3 * h)
    x = np.stack([x[:, :, 0], x[::-1, :, 1]], 1)
    logit, kept, states, soft, pooled = _read(p, x)

    d_logit = ((1 / (1 + np.exp(-np.clip(logit, -50, 50))) - target) * weight / weight.sum()).astype(np.float32)
    g = {"out": pooled.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["out"]
    d_soft = (states * d_pooled).sum(2)
    d_score = soft * (d_soft - (soft * d_soft).sum(0))
    g["attend"] = np.tensordot(d_score, states, 2)
    d_states = soft[:, :, None] * d_pooled + d_score[:, :, None] * p["attend"]
    d_ends = np.stack([d_states[:, :, :h], d_states[::-1, :, h:]], 1)
    d_state = np.zeros((2, n, h), np.float32)
    g["again"] = np.zeros_like(p["again"])
    dx = np.empty_like(x)
    back = p["again"].transpose(0, 2, 1)
    slope = lambda s: (1 - np.abs(s)) ** 2  # of the squashed value s
    for t in range(steps - 1, -1, -1):
        before, z, r, new, gate = kept[t]
        d_state = d_state + d_ends[t]
        d_new = d_state * (1 - z) * slope(new)
        gate_slope = lambda v: slope(2 * v - 1) * np.float32(0.5)
        d_gates = np.concatenate([d_state * (before - new) * gate_slope(z), d_new * gate * gate_slope(r), d_new * r], 2)
        dx[t, :, :, : 2 * h], dx[t, :, :, 2 * h :] = d_gates[:, :, : 2 * h], d_new
        g["again"] += before.transpose(0, 2, 1) @ d_gates
        d_state = d_state * z + d_gates @ back
    d_table = _scatter(len(table), windows.reshape(-1), np.concatenate([dx[:, 0], dx[::-1, 1]], 2).reshape(steps * n, -1))
    g["into"], g["bias"] = inputs.T @ d_table, d_table.sum(0)
    d_inputs = d_table @ p["into"].T
    hashes, grams, starts, _ = features
    a, b, chars = _buckets(p, hashes, grams)
    dim, letters = p["words"].shape[1], p["chars"].shape[1]
    g["words"] = _scatter(len(p["words"]), np.concatenate([a, b]), np.concatenate([d_inputs[:, :dim]] * 2))
    of = np.repeat(np.arange(len(hashes)), np.diff(starts))
    g["chars"] = _scatter(len(p["chars"]), chars, (d_inputs[:, dim : dim + letters] / np.sqrt(np.diff(starts))[:, None].astype(np.float32))[of])
    return g


class Adam:
    """Vectors of words and grams are also drawn to zero, so that rare ones say little."""

    def __init__(self, p: dict[str, np.ndarray], rate: float, decay: float):
        self.p, self.rate, self.decay, self.n = p, rate, decay, 0
        self.mean = {k: np.zeros_like(v) for k, v in p.items()}
        self.square = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.n += 1
        rate = self.rate * (1 - 0.999**self.n) ** 0.5 / (1 - 0.9**self.n)
        for k, v in g.items():
            m, s = self.mean[k], self.square[k]
            m += np.float32(0.1) * (v - m)
            s += np.float32(0.001) * (v * v - s)
            if k in ("words", "chars"):
                self.p[k] *= np.float32(1 - self.rate * self.decay)
            self.p[k] -= np.float32(rate) * m / (np.sqrt(s) + np.float32(1e-6))


def window_starts(n: int, window: int, stride: int) -> np.ndarray:
    """Starts of overlapping windows that cover n words, the last at the end."""
    if n <= window:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - window, stride), n - window)


def windows_of(ids: np.ndarray, window: int, stride: int) -> np.ndarray:
    """N x window ids; a text shorter than a window is repeated until it fills one."""
    if len(ids) < window:
        return np.resize(ids, (1, window))
    return ids[window_starts(len(ids), window, stride)[:, None] + np.arange(window)]
