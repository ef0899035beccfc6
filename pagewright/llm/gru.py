"""A gated recurrent language model over symbols, in numpy.

Symbols are the ``head`` (the end of a text and the most frequent words, in classes of ``IN_CLASS``), then
one symbol for each form class of the other repeated words, one for words seen once or never, and the start.
The output is factored: the class from the state, then, for head classes, the word from the state; in the other
classes words have fixed shares. Training is truncated backpropagation through time: windows of ``WINDOW``
steps over parallel streams, the state carried from window to window and cleared at the start of a text; in training a text of over
4,096 words is several parts, each from a cleared state. Scoring carries the state through the whole text.
"""

from __future__ import annotations

import numpy as np

IN_CLASS = 32
HEAD = 1024
FORMS = 32
HIDDEN = 24
WINDOW = 16
STREAMS = 256

HEAD_CLASSES = HEAD // IN_CLASS
CLASSES = HEAD_CLASSES + FORMS + 1
RARE = HEAD + FORMS
START = RARE + 1
SHAPES = {
    "gates": (START + 1, 3 * HIDDEN), "state": (HIDDEN, 3 * HIDDEN), "to_class": (HIDDEN, CLASSES), "class_bias": (CLASSES,),
    "to_word": (HEAD_CLASSES, HIDDEN, IN_CLASS), "word_bias": (HEAD_CLASSES, IN_CLASS),
}
#: Bias of what cannot occur.
NEVER = -30.0


def class_of(symbol: np.ndarray) -> np.ndarray:
    return np.where(symbol < HEAD, symbol // IN_CLASS, symbol - HEAD + HEAD_CLASSES)


def packed(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in SHAPES]).astype(np.float32)


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def started(head_counts: np.ndarray, form_counts: np.ndarray, rare: int, seed: int = 11) -> dict[str, np.ndarray]:
    """Random gates, and output biases that give the counts' shares."""
    rng = np.random.default_rng(seed)
    params = {k: rng.normal(0, 0.08, shape).astype(np.float32) for k, shape in SHAPES.items()}
    head = np.zeros(HEAD)
    head[: len(head_counts)] = head_counts
    head = head.reshape(HEAD_CLASSES, IN_CLASS)
    with np.errstate(divide="ignore"):
        params["word_bias"] = np.maximum(np.log(head / np.maximum(head.sum(1, keepdims=True), 1)), NEVER).astype(np.float32)
        mass = np.concatenate([head.sum(1), form_counts, [max(rare, 1)]])
        params["class_bias"] = np.maximum(np.log(mass / mass.sum()), NEVER).astype(np.float32)
    return params


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _step(p: dict, symbols: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    a, u = p["gates"][symbols], h @ p["state"]
    zr = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    un = u[:, 2 * HIDDEN :]
    n = np.tanh(a[:, 2 * HIDDEN :] + r * un)
    return n + z * (h - n), z, r, n, un


def _exps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(x) up to a factor for each row, and the log of each row's sum of exp(x)."""
    top = x.max(1, keepdims=True) if len(x) and max(x.max(), -x.min()) > 80 else 0.0
    e = np.exp(x - top)
    return e, np.log(e @ np.ones(x.shape[1], x.dtype)) + np.ravel(top)


def log_chances(p: dict, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the chance of each target's class, and of its word where it is in the head."""
    cls = class_of(target)
    x = h @ p["to_class"] + p["class_bias"]
    out = x[np.arange(len(h)), cls] - _exps(x)[1]
    order = np.argsort(cls.astype(np.int16), kind="stable")
    ends = np.searchsorted(cls[order], np.arange(HEAD_CLASSES + 1))
    for k in range(HEAD_CLASSES):
        at = order[ends[k] : ends[k + 1]]
        if len(at):
            x = h[at] @ p["to_word"][k] + p["word_bias"][k]
            out[at] += x[np.arange(len(at)), target[at] - k * IN_CLASS] - _exps(x)[1]
    return out


def _windows(source: np.ndarray, target: np.ndarray, streams: int):
    """(source, target) of windows, steps by streams, and whether a new set of streams begins. The symbols that the
    streams do not divide come last, as one stream."""
    length = len(target) // streams
    for width, begin, end in ((streams, 0, streams * length), (1, streams * length, len(target))):
        own = [x[begin:end].reshape(width, -1).T for x in (source, target)]
        for s in range(0, len(own[0]), WINDOW):
            yield own[0][s : s + WINDOW], own[1][s : s + WINDOW], not s


def train(p: dict, sequences: list[np.ndarray], rate: float = 0.04) -> dict:
    """One pass over all sequences of symbols (each a text's part)."""
    if not sequences:
        return p
    target = np.concatenate(sequences)
    first = np.cumsum([0, *map(len, sequences[:-1])])
    source = np.concatenate([[START], target[:-1]])
    source[first] = START
    streams = max(1, min(STREAMS, len(target) // (4 * WINDOW)))
    steps = sum(1 for _ in _windows(source, target, streams))
    p = {k: v.copy() for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for s, (x, y, begins) in enumerate(_windows(source, target, streams)):
        if begins:
            h = np.zeros((x.shape[1], HIDDEN), np.float32)
        g, h = _gradients(p, x, y, h)
        pace = rate * (1 - 0.9 * s / steps)
        one, two = 1 - 0.9 ** (s + 1), 1 - 0.99 ** (s + 1)
        norm = np.sqrt(sum(float(np.vdot(q, q)) for q in g.values()))
        for k, q in g.items():
            q *= min(1.0, 1.0 / (norm + 1e-9)) * min(1.0, x.size / (WINDOW * WINDOW))  # the few last symbols move little
            m[k] += 0.1 * (q - m[k])
            q *= q
            v[k] += 0.01 * (q - v[k])
            p[k] -= (pace / one) * m[k] / (np.sqrt(v[k] * (1 / two)) + 1e-6)
    return p


def _gradients(p: dict, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
    steps, streams = x.shape
    kind, two = p["state"].dtype, 2 * HIDDEN
    before, z, r, n, un, state = np.empty((6, steps, streams, HIDDEN), kind)
    fresh = (x != START).astype(kind)[:, :, None]
    given = p["gates"][x]
    for t in range(steps):
        np.multiply(h, fresh[t], out=before[t])
        u = before[t] @ p["state"]
        zr = _sigmoid(given[t, :, :two] + u[:, :two])
        z[t], r[t], un[t] = zr[:, :HIDDEN], zr[:, HIDDEN:], u[:, two:]
        np.tanh(given[t, :, two:] + r[t] * un[t], out=n[t])
        h = state[t] = n[t] + z[t] * (before[t] - n[t])
    flat, target = state.reshape(-1, HIDDEN), y.ravel()
    cls, rows, total = class_of(target), np.arange(len(target)), len(target)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d, _ = _exps(flat @ p["to_class"] + p["class_bias"])
    d /= (d @ np.ones(CLASSES, kind))[:, None] * total
    d[rows, cls] -= 1 / total
    g["to_class"], g["class_bias"] = flat.T @ d, d.sum(0)
    d_flat = d @ p["to_class"].T
    order = np.argsort(cls.astype(np.int16), kind="stable")
    ends = np.searchsorted(cls[order], np.arange(HEAD_CLASSES + 1))
    order = order[: ends[-1]]
    of_class = [(k, slice(ends[k], ends[k + 1])) for k in range(HEAD_CLASSES) if ends[k] < ends[k + 1]]
    own, d = flat[order], np.empty((len(order), IN_CLASS), kind)
    for k, at in of_class:
        d[at] = own[at] @ p["to_word"][k] + p["word_bias"][k]
    d = _exps(d)[0]
    d /= (d @ np.ones(IN_CLASS, kind))[:, None] * total
    d[np.arange(len(order)), target[order] - cls[order] * IN_CLASS] -= 1 / total
    back = np.empty_like(own)
    for k, at in of_class:
        g["to_word"][k], g["word_bias"][k] = own[at].T @ d[at], d[at].sum(0)
        back[at] = d[at] @ p["to_word"][k].T
    d_flat[order] += back
    d_states, d_next = d_flat.reshape(steps, streams, HIDDEN), 0.0
    to_n, to_z, to_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), un * r * (1 - r)
    du, d_gates = np.empty((steps, streams, 3 * HIDDEN), kind), np.empty((steps, streams, 3 * HIDDEN), kind)
    for t in range(steps - 1, -1, -1):
        dh = d_states[t] + d_next
        dn = dh * to_n[t]
        d_gates[t, :, :HIDDEN], d_gates[t, :, HIDDEN:two], d_gates[t, :, two:] = dh * to_z[t], dn * to_r[t], dn
        du[t, :, :two] = d_gates[t, :, :two]
        np.multiply(dn, r[t], out=du[t, :, two:])
        d_next = (dh * z[t] + du[t] @ p["state"].T) * fresh[t]
    g["state"] = before.reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN)
    symbols = x.ravel()
    order = np.argsort(symbols.astype(np.int16), kind="stable")
    own, begin = np.unique(symbols[order], return_index=True)
    g["gates"][own] = np.add.reduceat(d_gates.reshape(-1, 3 * HIDDEN)[order], begin, axis=0)
    return g, h


def score(p: dict, symbols: np.ndarray, offsets: np.ndarray, at_once: int = 1 << 13) -> np.ndarray:
    """log_chances of all symbols of many texts; the state runs through each whole text.

    Texts go side by side, the longest first, so that those still running are always the first ones.
    """
    sizes = np.diff(offsets)
    by_size = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[by_size] = np.arange(len(sizes))
    text = np.repeat(np.arange(len(sizes)), sizes)
    t = np.arange(len(symbols)) - offsets[text]
    running = np.bincount(t, minlength=1)  # texts that have a symbol at each step
    begin = np.concatenate([[0], np.cumsum(running)])
    place = begin[t] + rank[text]
    target = np.empty(len(symbols), np.int64)
    target[place] = symbols
    source = np.full(len(symbols), START, np.int64)
    later = t > 0
    source[place[later]] = symbols[np.flatnonzero(later) - 1]
    out = np.empty(len(symbols), np.float32)
    h = np.zeros((len(sizes), HIDDEN), np.float32)
    states, since = [], 0
    for k in range(len(running) if len(symbols) else 0):
        h = _step(p, source[begin[k] : begin[k + 1]], h[: running[k]])[0]
        states.append(h)
        if begin[k + 1] - since >= at_once or k == len(running) - 1:
            out[since : begin[k + 1]] = log_chances(p, np.concatenate(states), target[since : begin[k + 1]])
            states, since = [], begin[k + 1]
    return out[place]
