"""A small causal self-attention model in numpy: one layer over windows of subword ids.

The next id is predicted in two steps, its class and its place in the class, so
that a prediction costs two short softmaxes instead of one over all ids.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np

WINDOW = 32
# A window takes over so many positions of the one before as context only.
OVERLAP = 8
WIDTH = 16
HIDDEN = 32
# Windows of one training step.
BATCH = 256
CLASSES = 64
PER_CLASS = 64
IDS = CLASSES * PER_CLASS
END = IDS - 1
# Windows worked on at once: their attention weights fit a processor's cache.
CHUNK = 64
# So many chunks' states are turned into probabilities at once, so that each class has enough of them.
OUTPUT_CHUNKS = 48
# Rows of logits worked on at once, for the same reason.
ROWS = 2048
# Rows of one matrix product: BLAS multiplies matrices of this size without copies of them.
BLOCK = 256
# Weights changed at once.
SOME = 32768
# Sums of exponentials beyond these bounds are made again with the row's largest logit taken off.
LEAST, MOST = 1e-15, 1e15

CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))

Weights = dict[str, np.ndarray]
SHAPES = {
    "embed": (IDS, WIDTH),
    "place": (WINDOW, WIDTH),
    "qkv": (WIDTH, 3 * WIDTH),
    "out": (WIDTH, WIDTH),
    "up": (WIDTH, HIDDEN),
    "up_bias": (HIDDEN,),
    "down": (HIDDEN, WIDTH),
    "cls": (WIDTH, CLASSES),
    "cls_bias": (CLASSES,),
    "member": (CLASSES, WIDTH, PER_CLASS),
    "member_bias": (CLASSES, PER_CLASS),
}


def initial(counts: np.ndarray, seed: int = 0) -> Weights:
    """Small random weights; the biases are the smoothed log shares of `counts` (one per id), so training starts from those."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.normal(size=s) * (0.3 if k in ("embed", "place") else s[0] ** -0.5 if len(s) == 2 else 0.05)).astype(np.float32) for k, s in SHAPES.items()}
    grid = (counts + 0.1).reshape(CLASSES, PER_CLASS)
    w["up_bias"] = np.zeros(HIDDEN, np.float32)
    w["cls"] *= 0.1
    w["cls_bias"] = np.log(grid.sum(1) / grid.sum()).astype(np.float32)
    w["member_bias"] = np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32)
    return w


SIZE = sum(math.prod(shape) for shape in SHAPES.values())


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray, dtype=np.float32) -> Weights:
    """The weights that lie in `values`, whose memory they share if it is of `dtype`."""
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = math.prod(shape)
        out[k] = values[at : at + n].reshape(shape).astype(dtype, copy=False)
        at += n
    return out


class Room:
    """Arrays kept from step to step, because the system hands out new ones of this size page by page."""

    def __init__(self, dtype=np.float32):
        self.dtype = dtype
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, self.dtype)
        return self.held[name][:n].reshape(shape)


def product(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """a @ b by blocks of rows: small products need no copies of their factors."""
    n = len(a) // BLOCK * BLOCK
    np.matmul(a[:n].reshape(-1, BLOCK, a.shape[1]), b, out=out[:n].reshape(-1, BLOCK, b.shape[1]))
    if n < len(a):
        np.matmul(a[n:], b, out=out[n:])
    return out


def row_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b by blocks of rows."""
    n = len(a) // BLOCK * BLOCK
    return np.matmul(a[:n].reshape(-1, BLOCK, a.shape[1]).transpose(0, 2, 1), b[:n].reshape(-1, BLOCK, b.shape[1])).sum(0) + a[n:].T @ b[n:]


def turned(w: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(w.T)


def with_bias(room: Room, name: str, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights with their bias as a last row; it meets a column of ones."""
    out = room(name, *weights.shape[:-2], weights.shape[-2] + 1, weights.shape[-1])
    out[..., :-1, :], out[..., -1, :] = weights, bias
    return out


def scaled_qkv(w: Weights) -> np.ndarray:
    """The weights of queries, keys and values, those of queries times the scale of the scores (a power of two)."""
    out = w["qkv"].copy()
    out[:, :WIDTH] *= WIDTH**-0.5
    return out


def states(w: Weights, x: np.ndarray, room: Room | None = None, r: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """All layers for windows x (windows x WINDOW); position i sees positions up to i. States go to `r`, if given, before a column of ones.

    `e` has the exponentials of the scores and `total` their sums, once for each place of
    a row: attention weights are their quotients, which are never made, as rows of WIDTH
    are divided in their place.
    """
    room = room or Room(w["embed"].dtype)
    b, n = x.shape
    rows = b * n
    h = room("h", rows, WIDTH)
    np.take(w["embed"], x.reshape(-1), axis=0, out=h, mode="clip")
    h.reshape(b, n * WIDTH)[:] += w["place"][:n].reshape(-1)
    qkv = product(h, scaled_qkv(w), room("qkv", rows, 3 * WIDTH)).reshape(b, n, 3 * WIDTH)
    q, k, v = qkv[:, :, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]
    e, total = room("e", b, n, n), room("total", rows, WIDTH)
    ones = np.ones((n, WIDTH), room.dtype)
    for most in (None, 40):
        np.matmul(q, k.transpose(0, 2, 1), out=e)
        if most:  # exp stays finite; larger scores do not occur in trained weights
            np.minimum(e, most, out=e)
        np.exp(e, out=e)
        e *= CAUSAL[:n, :n]
        product(e.reshape(rows, n), ones, total)
        if not rows or total.max() < math.exp(40):
            break
    o = np.matmul(e, v, out=room("o", b, n, WIDTH)).reshape(rows, WIDTH)
    o /= total
    z = product(o, w["out"], room("z", rows, WIDTH))
    z += h
    u = product(z, w["up"], room("u", rows, HIDDEN))
    u += w["up_bias"]
    np.maximum(u, 0, out=u)
    if r is None:
        r = room("r", rows, WIDTH + 1)
    np.add(product(u, w["down"], room("down", rows, WIDTH)), z, out=r[:, :WIDTH])
    r[:, WIDTH] = 1
    return {"h": h, "q": q, "k": k, "v": v, "e": e, "total": total, "o": o, "z": z, "u": u, "r": r[:, :WIDTH], "r1": r}


def final_states(w: Weights, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The states at the masked positions `at`."""
    return states(w, x)["r"][np.flatnonzero(at)]


def blocks(y: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Rows of ascending ids y in blocks of at most ROWS, each as class, first row and end."""
    edges = np.searchsorted(y, np.arange(CLASSES + 1) * PER_CLASS).tolist()
    held: list[tuple[int, int, int]] = []
    for c in range(CLASSES):
        for a in range(edges[c], edges[c + 1], ROWS):
            b = min(a + ROWS, edges[c + 1])
            if held and b - held[0][1] > ROWS:
                yield held
                held = []
            held.append((c, a, b))
    if held:
        yield held


def exponentials(parts: list[tuple[np.ndarray, np.ndarray]], e: np.ndarray, ends: list[tuple[int, int]], right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """e: exponentials of the logits, which are the products of `parts`, one at each of `ends`. Returns the sums of the rows, and the logits at `right`."""
    ones = np.ones(e.shape[1], e.dtype)

    def logits():
        for (r, weights), (a, b) in zip(parts, ends, strict=True):
            product(r, weights, e[a:b])

    logits()
    picked = e.reshape(-1)[right]
    np.exp(e, out=e)
    total = e @ ones
    if not (total.min() > LEAST and total.max() < MOST):
        logits()
        most = e.max(1)
        e -= most[:, None]
        picked -= most
        np.exp(e, out=e)
        total = e @ ones
    return total, picked


def layers(w: Weights, r: np.ndarray, y: np.ndarray, room: Room) -> Iterator[tuple]:
    """Both softmaxes for states r (a column of ones last) before ascending ids y, block by block.

    Gives whether the class is what is predicted, the parts of the block (class, first
    row, end), their exponentials, the sums, the logits of what is right and where those stand.
    """
    cls, member = with_bias(room, "cls", w["cls"], w["cls_bias"]), with_bias(room, "member", w["member"], w["member_bias"])
    steps = np.arange(ROWS) * PER_CLASS
    classes, places = y // PER_CLASS, y % PER_CLASS
    first = ((0, a, min(a + ROWS, len(y))) for a in range(0, len(y), ROWS))
    for outer, parts in itertools.chain(((True, [p]) for p in first), ((False, p) for p in blocks(y))):
        start, end = parts[0][1], parts[-1][2]
        e = room("logits", end - start, PER_CLASS)
        right = steps[: end - start] + (classes if outer else places)[start:end]
        made = [(r[a:b], cls if outer else member[c]) for c, a, b in parts]
        total, picked = exponentials(made, e, [(a - start, b - start) for _, a, b in parts], right)
        yield outer, parts, e, total, picked, right


def log_probabilities(w: Weights, r: np.ndarray, y: np.ndarray, room: Room | None = None) -> np.ndarray:
    """Natural logarithm of the probability of id y[i] after state r[i]; the places of a class are worked on together."""
    room = room or Room(w["embed"].dtype)
    return log_probabilities_at(w, np.append(r, np.ones((len(r), 1), r.dtype), axis=1), np.arange(len(r)), y, room)


def log_probabilities_at(w: Weights, r: np.ndarray, at: np.ndarray, y: np.ndarray, room: Room) -> np.ndarray:
    """Those of id y[i] after state r[at[i]], where r has a column of ones last."""
    y = y.astype(np.int16)
    order = np.argsort(y, kind="stable")
    y = y[order]
    r = np.take(r, at[order], axis=0, out=room("ordered", len(y), WIDTH + 1), mode="clip")
    # States too long for exp in single precision are shortened.
    most = 60 / max(np.abs(w["cls"]).sum(0).max(), np.abs(w["member"]).sum(1).max(), 1e-6)
    if len(y) and max(r.max(), -r.min()) > most:
        np.clip(r[:, :WIDTH], -most, most, out=r[:, :WIDTH])
    out = np.zeros(len(y), room.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        for _, parts, _, total, picked, _ in layers(w, r, y, room):
            out[parts[0][1] : parts[-1][2]] += picked - np.log(total)
    back = np.empty_like(out)
    back[order] = out
    return back


def window_rows(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each of `first` WINDOW ids from there on, and before them the one that comes before."""
    line = np.concatenate([[END], ids, np.full(WINDOW, END)]).astype(np.int16)
    return np.lib.stride_tricks.sliding_window_view(line, WINDOW + 1)[first]


def windows(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of several sequences that lie in `ids` one after the other.

    Returns inputs, targets and a mask of what is scored (windows x WINDOW), and
    the sequence of each window. Every id is scored in exactly one window; inputs
    are the ids before, with END at the very start. Sequences have one id at least.
    """
    step = WINDOW - OVERLAP
    per = 1 + np.maximum(0, -(-(counts - WINDOW) // step))
    owner = np.repeat(np.arange(len(counts)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    first = number * step
    # What a window has beyond its sequence is not scored.
    rows = window_rows(ids, starts[owner] + first)
    rows[number == 0, 0] = END
    inside = np.arange(WINDOW) < (counts[owner] - first)[:, None]
    scored = inside & ((number == 0)[:, None] | (np.arange(WINDOW) >= OVERLAP))
    return rows[:, :WINDOW], rows[:, 1:], scored, owner


def score(w: Weights, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence."""
    total = np.zeros(len(counts))
    if not len(counts):
        return total
    x, y, scored, owner = windows(ids, starts, counts)
    room = Room()
    with np.errstate(over="ignore", invalid="ignore"):
        for a in range(0, len(x), CHUNK * OUTPUT_CHUNKS):
            part = slice(a, min(a + CHUNK * OUTPUT_CHUNKS, len(x)))
            r = room("r", (part.stop - a) * WINDOW, WIDTH + 1)
            for b in range(a, part.stop, CHUNK):
                c = min(b + CHUNK, part.stop)
                states(w, x[b:c], room, r[(b - a) * WINDOW : (c - a) * WINDOW])
            mask = scored[part]
            logs = log_probabilities_at(w, r, np.flatnonzero(mask), y[part][mask], room)
            total += np.bincount(np.repeat(owner[part], mask.sum(1)), weights=logs, minlength=len(counts))
    return total / np.log(10)


def gradients(w: Weights, x: np.ndarray, y: np.ndarray, mask: np.ndarray, room: Room | None = None) -> tuple[Weights, float]:
    """Gradient of the mean negative log probability over the masked positions, and that mean."""
    with np.errstate(over="ignore", invalid="ignore"):
        return all_gradients(w, x, y, mask, room or Room(w["embed"].dtype))


def all_gradients(w: Weights, x: np.ndarray, y: np.ndarray, mask: np.ndarray, room: Room) -> tuple[Weights, float]:
    s = states(w, x, room)
    b, n = x.shape
    rows = b * n
    at = np.flatnonzero(mask.ravel())
    m = max(1, len(at))
    g = unflat(room("g", SIZE), room.dtype)
    ids = y.ravel()[at].astype(np.int16)
    order = np.argsort(ids, kind="stable")
    at, ids = at[order], ids[order]

    # The output layers, in the order of ids.
    r = np.take(s["r1"], at, axis=0, out=room("ordered", len(at), WIDTH + 1), mode="clip")
    dr, loss = room("dr", len(at), WIDTH), 0.0
    g_cls, g_member = np.zeros((WIDTH + 1, CLASSES), room.dtype), room("g_member", CLASSES, WIDTH + 1, PER_CLASS)
    g_member[:] = 0
    cls_back = turned(w["cls"])
    for outer, parts, d, total, picked, right in layers(w, r, ids, room):
        start, end = parts[0][1], parts[-1][2]
        loss -= float((picked - np.log(total)).sum())
        d *= (1 / (total * m))[:, None]
        d.reshape(-1)[right] -= 1 / m
        if outer:
            g_cls += row_products(r[start:end], d)
            product(d, cls_back, dr[start:end])
            continue
        back = room("back", end - start, WIDTH)
        for c, i, j in parts:
            g_member[c] += r[i:j].T @ d[i - start : j - start]
            np.matmul(d[i - start : j - start], w["member"][c].T, out=back[i - start : j - start])
        dr[start:end] += back
    g["cls"][:], g["cls_bias"][:] = g_cls[:-1], g_cls[-1]
    g["member"][:], g["member_bias"][:] = g_member[:, :-1], g_member[:, -1]
    full = room("full", rows, WIDTH)
    if len(at) < rows:
        full[:] = 0
        full[at] = dr
    else:
        back = np.empty(rows, np.int64)
        back[at] = np.arange(rows)
        np.take(dr, back, axis=0, out=full, mode="clip")

    u, e, total = s["u"], s["e"], s["total"]
    g["down"][:] = row_products(u, full)
    du = product(full, turned(w["down"]), room("du", rows, HIDDEN))
    du *= u > 0
    g["up"][:], g["up_bias"][:] = row_products(s["z"], du), np.ones(rows, room.dtype) @ du
    dz = product(du, turned(w["up"]), room("dz", rows, WIDTH))
    dz += full
    g["out"][:] = row_products(s["o"], dz)
    # Attention weights are e / total, so what goes back to them is divided before the products with e.
    do = product(dz, turned(w["out"]), room("do", rows, WIDTH))
    do /= total
    along = np.einsum("ij,ij->i", do, s["o"])
    do = do.reshape(b, n, WIDTH)
    dqkv = room("dqkv", b, n, 3 * WIDTH)
    np.matmul(e.transpose(0, 2, 1), do, out=dqkv[:, :, 2 * WIDTH :])
    ds = np.matmul(do, s["v"].transpose(0, 2, 1), out=room("ds", b, n, n))
    ds -= along.reshape(b, n, 1)
    ds *= e
    np.matmul(ds, s["k"], out=dqkv[:, :, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), s["q"], out=dqkv[:, :, WIDTH : 2 * WIDTH])
    dqkv = dqkv.reshape(rows, 3 * WIDTH)
    g["qkv"][:] = row_products(s["h"], dqkv)
    g["qkv"][:, :WIDTH] *= WIDTH**-0.5
    dz += product(dqkv, turned(scaled_qkv(w)), room("down", rows, WIDTH))
    # Rows of one id lie together after a sort, so each id is added up once.
    used = x.reshape(-1).astype(np.int16)
    order = np.argsort(used, kind="stable")
    used = used[order]
    first = np.flatnonzero(np.concatenate([[rows > 0], used[1:] != used[:-1]]))
    g["embed"][:] = 0
    g["embed"][used[first]] = np.add.reduceat(np.take(dz, order, axis=0, out=full, mode="clip"), first)
    g["place"][:] = 0
    g["place"][:n] = dz.reshape(b, n, WIDTH).sum(0)
    return g, loss / m


def train(w: Weights, x: np.ndarray, y: np.ndarray, mask: np.ndarray, rate: float = 0.01, batch: int = BATCH) -> Weights:
    """Adam over the windows in the order given, once."""
    room = Room()
    values = flat(w)
    w = unflat(values)
    one, two = np.zeros_like(values), np.zeros_like(values)
    # So many weights at a time that what a step reads of them stays in the cache.
    parts = [(values[a : a + SOME], room("g", SIZE)[a : a + SOME], one[a : a + SOME], two[a : a + SOME]) for a in range(0, SIZE, SOME)]
    for t, a in enumerate(range(0, len(x), batch), 1):
        gradients(w, x[a : a + batch], y[a : a + batch], mask[a : a + batch], room)
        for v, g, first, second in parts:
            some = room("some", len(v))
            first *= 0.9
            first += np.multiply(g, 0.1, out=some)
            second *= 0.99
            np.multiply(g, 0.01, out=some)
            some *= g
            second += some
            np.divide(second, 1 - 0.99**t, out=some)
            np.sqrt(some, out=some)
            some += 1e-6
            np.divide(first, some, out=some)
            some *= rate / (1 - 0.9**t)
            v -= some
    return w
