"""A small causal self-attention model over classes of subwords, trained and run in numpy."""

from __future__ import annotations

import numpy as np

#: Context, how far windows move on, width of a state, classes of subwords that begin a word and that don't.
CONTEXT, STEP, WIDTH, STARTS, INSIDES = 32, 16, 16, 32, 31
CLASSES = STARTS + INSIDES + 1
#: Frequent subwords by which subwords are told apart, on either side.
COLUMNS = 512
#: The last class is the end of a text, which also stands before its beginning.
END = CLASSES - 1
#: Windows that are scored together: few enough for their arrays to stay in a core's cache.
BATCH = 256
#: And those that are trained on together.
FEW = 16
#: Windows of a training step.
TOGETHER = 64
_SHAPES = {"e": (CLASSES, WIDTH), "p": (CONTEXT, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH),
           "o": (WIDTH, WIDTH), "u": (WIDTH, CLASSES), "b": (CLASSES,)}
_MASK = np.triu(np.full((CONTEXT, CONTEXT), -1e9, np.float32), 1)
_SEEN = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))


def initial(counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """Random weights, with the classes' frequencies as the bias of the output."""
    rng = np.random.default_rng(seed)
    w = {n: (rng.normal(size=s) * 0.25).astype(np.float32) for n, s in _SHAPES.items()}
    w["u"] *= 0.2
    w["b"] = np.log((counts + 0.5) / (counts + 0.5).sum()).astype(np.float32)
    return pack(w)


def pack(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in _SHAPES]).astype(np.float32)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n, s in _SHAPES.items():
        size = int(np.prod(s))
        out[n] = flat[at : at + size].reshape(s)
        at += size
    return out


def gradient(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss in nats and its gradient over windows of classes x with next classes y (-1: none).

    Windows are gone through a few at a time, so that what is made for them stays in a core's cache.
    """
    total, loss, m = {n: np.zeros(s, w["e"].dtype) for n, s in _SHAPES.items()}, 0.0, max(1, int((y >= 0).sum()))
    for lo in range(0, len(x), FEW):
        loss += _add_gradient(w, x[lo : lo + FEW], y[lo : lo + FEW], total, m)
    return loss / m, total


def _add_gradient(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, g: dict[str, np.ndarray], m: int) -> float:
    n, t = x.shape
    s = np.float32(WIDTH**-0.5)
    flat = lambda c: c.reshape(-1, c.shape[-1])
    h0 = w["e"][x]
    h0 += w["p"][:t]
    h1 = flat(h0)
    q, k, v = ((h1 @ w[c]).reshape(n, t, -1) for c in "qkv")
    a = q @ k.transpose(0, 2, 1)
    a *= s
    np.exp(np.minimum(a, 60, out=a), out=a)
    a *= _SEEN[:t, :t]
    a /= a.sum(-1, keepdims=True)
    z = a @ v
    h = h1 + flat(z) @ w["o"]
    d = h @ w["u"]
    d += w["b"]
    np.exp(np.minimum(d, 60, out=d), out=d)
    d /= d.sum(-1, keepdims=True)
    rows = np.flatnonzero(y.ravel() >= 0)
    target = y.ravel()[rows]
    loss = -float(np.log(np.maximum(d[rows, target], 1e-9)).sum())
    d[rows, target] -= 1
    if len(rows) < len(d):
        d *= (y.ravel() >= 0)[:, None]
    d /= np.float32(m)
    g["u"] += h.T @ d
    g["b"] += d.sum(0)
    dh = d @ w["u"].T
    g["o"] += flat(z).T @ dh
    dz = (dh @ w["o"].T).reshape(z.shape)
    ds = dz @ v.transpose(0, 2, 1)
    ds -= np.einsum("ntc,ntc->nt", dz, z)[..., None]  # the weighted mean of ds: sum over a * ds = dz . z
    ds *= a
    ds *= s
    dq, dk, dv = ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dz
    for c, dc in zip("qkv", (dq, dk, dv)):
        g[c] += h1.T @ flat(dc)
        dh += flat(dc) @ w[c].T
    g["p"][:t] += dh.reshape(n, t, -1).sum(0)
    one = np.zeros((x.size, CLASSES), dh.dtype)
    one[np.arange(x.size), x.ravel()] = 1
    g["e"] += one.T @ dh
    return loss


def train(flat: np.ndarray, windows: np.ndarray, least_steps: int, rate: float = 0.01, batch: int = TOGETHER, seed: int = 1) -> np.ndarray:
    """Adam over all windows (rows of CONTEXT + 1 classes, -1 after a text's end), again and again up to least_steps."""
    rng, w = np.random.default_rng(seed), flat.astype(np.float32).copy()
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    whole = max(1, -(-len(windows) // batch))
    total = max(1, -(-least_steps // whole)) * whole
    while step < total:
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            rows = windows[order[lo : lo + batch]]
            _, g = gradient(unpack(w), np.maximum(rows[:, :-1], 0), rows[:, 1:])
            g = pack(g)
            step += 1
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            now = rate * min(1.0, 2.0 * (1 - step / (total + 1)))
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def log_probabilities(w: dict[str, np.ndarray], classes: np.ndarray, first: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural logs for texts laid end to end: of each class given those before it in its text, and of a word's
    beginning (any class for which starts is true) at that place.

    first: where each text begins, and the end of the last. Texts are cut into windows that overlap by CONTEXT - STEP.
    The first window of a text scores all its places, later ones their last STEP, so each is scored once with
    at least that much context before it. All windows of a kind are run as one masked batch.
    """
    out, begin = np.empty(len(classes), np.float32), np.empty(len(classes), np.float32)
    length = np.diff(first)
    before = np.empty(len(classes), classes.dtype)
    before[1:] = classes[:-1]
    before[first[:-1][length > 0]] = END
    padded = np.concatenate([before, np.zeros(CONTEXT, before.dtype)]).astype(np.int64) * CONTEXT
    # states, keys and values depend on class and place alone: all there are, made once
    states = (w["e"][:, None] + w["p"]).reshape(-1, WIDTH)
    queries, keys, values = (states @ w["q"]) * np.float32(WIDTH**-0.5), states @ w["k"], states @ w["v"]
    # a column of ones makes the sum of weights, two columns those of all classes and of a word's beginnings
    values = np.concatenate([values, np.ones((len(values), 1), np.float32)], 1)
    sums = np.stack([np.ones(CLASSES), starts], 1).astype(np.float32)
    more = np.maximum(0, -(-(length - CONTEXT) // STEP))
    later = np.repeat(np.arange(len(length)), more)
    nth = np.arange(len(later)) - (np.cumsum(more) - more)[later] + 1
    for at, scored, lo in ((first[:-1][length > 0], np.minimum(length[length > 0], CONTEXT), 0),
                           (first[:-1][later] + nth * STEP, np.minimum(length[later] - nth * STEP, CONTEXT) - (CONTEXT - STEP), CONTEXT - STEP)):
        for part in range(0, len(at), BATCH):
            a, n = at[part : part + BATCH], scored[part : part + BATCH]
            width = int(n.max()) + lo
            x = padded[a[:, None] + np.arange(width)] + np.arange(width)
            tail = x[:, lo:]
            s = queries[tail] @ keys[x].transpose(0, 2, 1)
            s += _MASK[lo:width, :width]
            np.exp(np.minimum(s, 60, out=s), out=s)
            valid = np.arange(width - lo) < n[:, None]
            z = (s @ values[x])[valid]
            h = states[tail[valid]] + (z[:, :-1] / z[:, -1:]) @ w["o"]
            p = h @ w["u"]
            p += w["b"]
            np.exp(np.minimum(p, 60, out=p), out=p)
            where = (a[:, None] + lo + np.arange(width - lo))[valid]
            total = np.log(p @ sums)
            out[where] = np.log(p[np.arange(len(where)), classes[where]]) - total[:, 0]
            begin[where] = total[:, 1] - total[:, 0]
    return out, begin
