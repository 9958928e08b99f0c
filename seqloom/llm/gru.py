"""A bidirectional gated recurrent network over bytes, in numpy.

Text is cut into segments of ``SEGMENT`` bytes; each is read forwards and backwards from a zero
state (the padding of a short one keeps it zero), all segments of a batch side by side, and every byte
gets class probabilities. Training is backpropagation through time over whole segments, by Adam, with
the loss at every position. One more class stands for no language that was learned: its examples
are the others' with their letters exchanged, by another permutation each time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEGMENT = 64
HIDDEN = 10
MOST_HIDDEN = 48
#: Examples of a training step, and steps; more steps for more classes than fit a quarter of a batch.
BATCH, STEPS = 96, 220
#: Segments that are run side by side; it bounds memory.
SIDE_BY_SIDE = 2048


@dataclass
class Network:
    """``table`` (256, 3H): what a byte adds to update gate, reset gate and candidate; one of each per direction."""

    table: list[np.ndarray]
    recur: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    labels: list[str]  # the class behind the last one is that of no learned language, if ``train`` made the network

    @classmethod
    def new(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 7, classes: int | None = None) -> Network:
        n = classes or len(labels)
        r = np.random.default_rng(seed)
        make = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            [make(256, 3 * hidden, scale=0.3) for _ in range(2)],
            [make(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)],
            make(2 * hidden, n, scale=0.3),
            np.zeros(n, np.float32),
            labels,
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.recur, self.out, self.bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _run(table: np.ndarray, recur: np.ndarray, bytes_: np.ndarray, order: range, keep: bool, there: np.ndarray | None = None):
    """States (T, N, H) of one direction, zero where ``there`` (T, N) is; with ``keep`` also what backpropagation needs."""
    n, h = bytes_.shape[1], recur.shape[0]
    states = np.zeros((bytes_.shape[0], n, h), np.float32)
    state, kept = np.zeros((n, h), np.float32), []
    gates_w, cand_w = np.ascontiguousarray(recur[:, : 2 * h]), np.ascontiguousarray(recur[:, 2 * h :])
    for t in order:
        x = table[bytes_[t]]
        gates = _sigmoid(x[:, : 2 * h] + state @ gates_w)
        update, reset = gates[:, :h], gates[:, h:]
        held = reset * state
        cand = np.tanh(x[:, 2 * h :] + held @ cand_w)
        new = state + update * (cand - state)
        if there is not None:
            new *= there[t][:, None]
        if keep:
            kept.append((t, state, update, reset, held, cand))
        states[t] = state = new
    return states, kept


def probabilities(net: Network, bytes_: np.ndarray, there: np.ndarray | None = None) -> np.ndarray:
    """(T, N, classes) for segments as columns of ``bytes_`` (T, N); ``there`` is 0 at padding, if there is any."""
    t = bytes_.shape[0]
    forward, _ = _run(net.table[0], net.recur[0], bytes_, range(t), False, there)
    backward, _ = _run(net.table[1], net.recur[1], bytes_, range(t - 1, -1, -1), False, there)
    h = forward.shape[2]
    logits = forward @ net.out[:h] + backward @ net.out[h:] + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def _back(table, recur, bytes_, kept, d_states, there):
    """Gradients of table and recur, from those of the states at every position."""
    h = recur.shape[0]
    d_table, d_recur = np.zeros_like(table), np.zeros_like(recur)
    carry = np.zeros_like(d_states[0])
    d_x = np.empty((carry.shape[0], 3 * h), np.float32)
    for t, state, update, reset, held, cand in reversed(kept):
        d = (d_states[t] + carry) * there[t][:, None]
        d_cand = d * update * (1 - cand * cand)
        d_update = d * (cand - state) * update * (1 - update)
        d_held = d_cand @ recur[:, 2 * h :].T
        d_reset = d_held * state * reset * (1 - reset)
        d_x[:, :h], d_x[:, h : 2 * h], d_x[:, 2 * h :] = d_update, d_reset, d_cand
        np.add.at(d_table, bytes_[t], d_x)
        d_recur[:, : 2 * h] += state.T @ d_x[:, : 2 * h]
        d_recur[:, 2 * h :] += held.T @ d_cand
        carry = d * (1 - update) + d_held * reset + d_x[:, : 2 * h] @ recur[:, : 2 * h].T
    return d_table, d_recur


def loss_and_gradients(net: Network, bytes_: np.ndarray, label: np.ndarray, weight: np.ndarray):
    """Cross-entropy at every position. bytes_ and weight (0 at padding): (T, N); label: (N,)."""
    t, n = bytes_.shape
    there = (weight > 0).astype(np.float32)
    forward, kept_f = _run(net.table[0], net.recur[0], bytes_, range(t), True, there)
    backward, kept_b = _run(net.table[1], net.recur[1], bytes_, range(t - 1, -1, -1), True, there)
    h = forward.shape[2]
    logits = forward @ net.out[:h] + backward @ net.out[h:] + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    total = weight.sum()
    picked = p[:, np.arange(n), label]
    loss = float(-(np.log(np.maximum(picked, 1e-12)) * weight).sum() / total)
    d = p
    d[:, np.arange(n), label] -= 1
    d *= (weight / total)[:, :, None]
    flat = d.reshape(t * n, -1)
    d_out = np.concatenate([forward.reshape(t * n, h).T @ flat, backward.reshape(t * n, h).T @ flat])
    tf, rf = _back(net.table[0], net.recur[0], bytes_, kept_f, d @ net.out[:h].T, there)
    tb, rb = _back(net.table[1], net.recur[1], bytes_, kept_b, d @ net.out[h:].T, there)
    return loss, [tf, tb, rf, rb, d_out, flat.sum(axis=0)]


def exchanged(text: str, r: np.random.Generator) -> str:
    """``text`` with its letters exchanged among themselves: words of no language, with the spaces of one."""
    letters = sorted({c for c in text.lower() if c.isalpha()})
    other = dict(zip(letters, r.permutation(letters).tolist(), strict=True))
    return "".join(other.get(c, c) for c in text.lower())


def train(samples: list[str], labels: list[str], steps: int | None = None, batch: int = BATCH, rate: float = 0.02, seed: int = 11) -> Network:
    """Fit on texts of any length; each step takes a random segment of ``batch`` of them, classes in turn, so in equal parts."""
    names = sorted(set(labels))
    classes = len(names) + 1
    net, r = Network.new(names, min(MOST_HIDDEN, max(HIDDEN, classes)), classes=classes), np.random.default_rng(seed)
    steps = steps or STEPS * max(1, -(-4 * classes // batch))
    by: dict[str, list[str]] = {}
    for text, name in zip(samples, labels, strict=True):
        if text:
            by.setdefault(name, []).append(text)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parameters()]
    turn = 0
    for step in range(1, steps + 1):
        bytes_, weight = np.zeros((SEGMENT, batch), np.uint8), np.zeros((SEGMENT, batch), np.float32)
        label = (turn + np.arange(batch)) % classes
        turn = (turn + batch) % classes
        for i, c in enumerate(label):
            some = by.get(names[c if c < len(names) else r.integers(len(names))]) or [" "]
            text = some[r.integers(len(some))]
            s = (text if c < len(names) else exchanged(text, r)).encode("utf-8", "replace")
            at = int(r.integers(max(1, len(s) - SEGMENT + 1)))
            part = np.frombuffer(s[at : at + SEGMENT], np.uint8)
            bytes_[: len(part), i], weight[: len(part), i] = part, 1
        _, grads = loss_and_gradients(net, bytes_, label, weight)
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        now = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for p, g, m in zip(net.parameters(), grads, moments, strict=True):
            g = g * scale
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p -= (now * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(documents, classes): the mean over all bytes of each text of the probabilities at them."""
    sizes = np.array([len(t) for t in texts])
    counts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), counts)
    total = np.zeros((len(texts), len(net.bias)))
    if not len(owner):
        return total
    padded = b"".join(t + b"\0" * (-len(t) % SEGMENT) for t in texts)
    segments = np.frombuffer(padded, np.uint8).reshape(-1, SEGMENT)
    last = np.cumsum(counts) - 1
    length = np.full(len(owner), SEGMENT)
    full = counts > 0
    length[last[full]] = sizes[full] - (counts[full] - 1) * SEGMENT
    for at in range(0, len(segments), SIDE_BY_SIDE):
        mask = (np.arange(SEGMENT)[:, None] < length[at : at + SIDE_BY_SIDE]).astype(np.float32)
        p = probabilities(net, np.ascontiguousarray(segments[at : at + SIDE_BY_SIDE].T), mask)
        sums = np.einsum("tnc,tn->nc", p, mask)
        np.add.at(total, owner[at : at + SIDE_BY_SIDE], sums)
    return total / np.maximum(sizes, 1)[:, None]
