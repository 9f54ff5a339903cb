"""A character-level bidirectional LSTM with a CRF on top, in numpy: training, and decoding of overlapping windows."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from loomwork.llm.pii_labels import TYPES

#: Characters of a window and how many two neighbouring windows share.
WINDOW, OVERLAP = 256, 64
TAGS = ["O", *[f"{p}-{t}" for t in TYPES for p in "BI"]]
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_model.npz")
_CHARS = [chr(c) for c in range(32, 127)] + ["\n", "\t"]
_OTHER = {name: len(_CHARS) + k for k, name in enumerate(("upper", "lower", "digit", "space", "bullet", "mark"))}
VOCABULARY = len(_CHARS) + len(_OTHER)


def _char_ids() -> np.ndarray:
    table = np.full(0x110000, _OTHER["mark"], np.uint8)
    for c in range(127, 0x3000):
        ch = chr(c)
        if ch.isspace():
            table[c] = _OTHER["space"]
        elif ch.isdigit():
            table[c] = _OTHER["digit"]
        elif ch.isupper():
            table[c] = _OTHER["upper"]
        elif ch.isalpha():
            table[c] = _OTHER["lower"]
    table[[0x2022, 0x25CF, 0x2013, 0x2014, 0xB7]] = _OTHER["bullet"]
    for k, ch in enumerate(_CHARS):
        table[ord(ch)] = k
    table[13] = table[10]
    return table


_IDS = _char_ids()


def encode(text: str) -> np.ndarray:
    """A number for each code point."""
    return _IDS[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def legal_moves() -> np.ndarray:
    """0 where a tag may follow another, a large negative number where it may not."""
    moves = np.zeros((len(TAGS), len(TAGS)), np.float32)
    for i, a in enumerate(TAGS):
        for j, b in enumerate(TAGS):
            if b[0] == "I" and a[2:] != b[2:]:
                moves[i, j] = -1e4
    return moves


def start(hidden: int = 48, width: int = 24, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {"E": rng.normal(0, 0.3, (VOCABULARY, width))}
    for d in "fb":
        p["W" + d] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * hidden))
        p["U" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        bias = np.zeros(4 * hidden)
        bias[hidden : 2 * hidden] = 1.0  # remember by default
        p["b" + d] = bias
    p["Wo"] = rng.normal(0, 0.1, (2 * hidden, len(TAGS)))
    p["bo"] = np.zeros(len(TAGS))
    p["T"] = rng.normal(0, 0.1, (len(TAGS), len(TAGS)))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(p: dict, d: str, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, hidden) of one direction; ids are (time, batch), already reversed for backward."""
    hidden = p["U" + d].shape[0]
    scale = np.full(4 * hidden, 0.5, np.float32)  # sigmoid by tanh: one call for all four gates
    scale[2 * hidden : 3 * hidden] = 1.0
    table, u = (p["E"] @ p["W" + d] + p["b" + d]) * scale, p["U" + d] * scale
    steps, batch = ids.shape
    h = np.zeros((batch, hidden), np.float32)
    c = np.zeros((batch, hidden), np.float32)
    out, memory = np.empty((steps, batch, hidden), np.float32), []
    for t in range(steps):
        z = h @ u
        z += table[ids[t]]
        np.tanh(z, out=z)
        i, f, g, o = z[:, :hidden] * 0.5 + 0.5, z[:, hidden : 2 * hidden] * 0.5 + 0.5, z[:, 2 * hidden : 3 * hidden], z[:, 3 * hidden :] * 0.5 + 0.5
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        last, h = h, o * tc
        out[t] = h
        if keep:
            memory.append((i, f, g.copy(), o, before, tc, last))
    return out, memory


def emissions(p: dict, ids: np.ndarray) -> np.ndarray:
    """Scores (batch, time, tags) of windows of character numbers (batch, time)."""
    x = ids.T
    f, _ = _lstm(p, "f", x, False)
    b, _ = _lstm(p, "b", x[::-1], False)
    hidden = f.shape[2]
    out = f @ p["Wo"][:hidden] + b[::-1] @ p["Wo"][hidden:] + p["bo"]
    return out.transpose(1, 0, 2)


class Viterbi:
    """Best tags of a few sequences under scores (sequence, time, tags), which may come in several pieces. Only one back
    pointer a character and tag is kept."""

    def __init__(self, moves: np.ndarray):
        self.moves, self.best, self.back = moves, None, []

    def feed(self, scores: np.ndarray, live: np.ndarray) -> None:
        """The next piece: scores (sequence, time, tags); live (time): how many sequences, longest first, still go on."""
        n, steps, _ = scores.shape
        back = np.zeros((steps, n, scores.shape[2]), np.int8)
        at, into = 0, np.ascontiguousarray(self.moves.T)
        if self.best is None:
            self.best, at = scores[:, 0] + self.moves[0], 1  # a text begins as if after O
        for t in range(at, steps):
            k = live[t]
            total = self.best[:k, None, :] + into
            chosen = total.argmax(axis=2)
            back[t, :k] = chosen
            self.best[:k] = np.take_along_axis(total, chosen[:, :, None], 2)[:, :, 0] + scores[:k, t]
        self.back.append(back)

    def paths(self, lengths: np.ndarray) -> list[np.ndarray]:
        back = np.concatenate(self.back) if len(self.back) > 1 else self.back[0]
        n = len(lengths)
        path = np.zeros((len(back), n), np.int8)
        now = self.best.argmax(axis=1)  # frozen at each sequence's own end
        rows = np.arange(n)
        for t in range(int(lengths.max()) - 1, -1, -1):
            k = int(np.searchsorted(-lengths, -t, "left"))  # sequences longer than t come first
            path[t, :k] = now[:k]
            now[:k] = back[t, rows[:k], now[:k]]
        return [path[:m, i] for i, m in enumerate(lengths)]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradients(p: dict, ids: np.ndarray, tags: np.ndarray, fixed: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood a character and its gradient."""
    n, steps = ids.shape
    x = ids.T
    hf, mf = _lstm(p, "f", x, True)
    hb, mb = _lstm(p, "b", x[::-1], True)
    hidden = hf.shape[2]
    both = np.concatenate((hf, hb[::-1]), axis=2)
    e = (both @ p["Wo"] + p["bo"]).astype(np.float64)
    moves = (p["T"] + fixed).astype(np.float64)
    alpha = np.empty_like(e)
    alpha[0] = moves[0] + e[0]
    for t in range(1, steps):
        alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + moves, 1) + e[t]
    whole = _logsumexp(alpha[-1], 1)
    beta = np.zeros_like(e)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsumexp(moves[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    de = np.exp(alpha + beta - whole[None, :, None])
    dt = np.zeros_like(moves)
    dt[0] += de[0].sum(axis=0)
    for t in range(1, steps):
        pair = alpha[t - 1][:, :, None] + moves + (e[t] + beta[t])[:, None, :] - whole[:, None, None]
        dt += np.exp(pair).sum(axis=0)
    y, rows = tags.T, np.arange(n)
    gold = moves[0][y[0]] + e[0][rows, y[0]]
    np.subtract.at(dt, (np.zeros(n, int), y[0]), 1)
    de[0][rows, y[0]] -= 1
    for t in range(1, steps):
        gold = gold + moves[y[t - 1], y[t]] + e[t][rows, y[t]]
        np.subtract.at(dt, (y[t - 1], y[t]), 1)
        de[t][rows, y[t]] -= 1
    count = n * steps
    de = (de / count).astype(np.float32)
    grad = {"T": (dt / count).astype(np.float32) * (fixed == 0), "bo": de.sum(axis=(0, 1)), "Wo": np.einsum("tbh,tbk->hk", both, de, optimize=True)}
    dboth = de @ p["Wo"].T
    grad["E"] = np.zeros_like(p["E"])
    for d, memory, seq, dh_all in (("f", mf, x, dboth[:, :, :hidden]), ("b", mb, x[::-1], dboth[::-1, :, hidden:])):
        u = p["U" + d]
        du, dz_sum = np.zeros_like(u), np.zeros((VOCABULARY, 4 * hidden), np.float32)
        dh, dc = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, g, o, before, tc, last = memory[t]
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - tc**2)
            dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g**2), dh * tc * o * (1 - o)), axis=1)
            du += last.T @ dz
            np.add.at(dz_sum, seq[t], dz)
            dh, dc = dz @ u.T, dc * f
        grad["U" + d] = du
        grad["b" + d] = dz_sum.sum(axis=0)
        grad["W" + d] = p["E"].T @ dz_sum
        grad["E"] += dz_sum @ p["W" + d].T
    return float((whole - gold).sum() / count), grad


def windows(length: int) -> list[int]:
    """Starts of the windows that cover a text."""
    step = WINDOW - OVERLAP
    return list(range(0, max(1, length - OVERLAP), step))


def text_scores(p: dict, ids: list[np.ndarray], begin: int, stop: int, batch: int = 256) -> list[np.ndarray]:
    """Scores (characters, tags) of the characters begin..stop of each text; where windows overlap, their scores are averaged
    with weights that fall towards a window's ends. begin must be the start of a window."""
    tags = len(TAGS)
    out = [np.zeros((max(0, min(stop, len(x)) - begin), tags), np.float32) for x in ids]
    mass = [np.zeros(len(o), np.float32) for o in out]
    ramp = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).clip(max=OVERLAP).astype(np.float32)
    where = [(k, a) for k, x in enumerate(ids) for a in windows(len(x)) if len(x) and begin - WINDOW < a < stop]
    blank = _IDS[10]
    for at in range(0, len(where), batch):
        part = where[at : at + batch]
        grid = np.full((len(part), WINDOW), blank, np.uint8)  # always the same width, so no text depends on others
        for r, (k, a) in enumerate(part):
            piece = ids[k][a : a + WINDOW]
            grid[r, : len(piece)] = piece
        got = emissions(p, grid)
        for r, (k, a) in enumerate(part):
            low, high = max(a, begin), min(len(ids[k]), a + WINDOW, stop)
            if low < high:
                weight = ramp[low - a : high - a].copy()
                if a == 0:  # a text's own ends are no seams
                    weight[: WINDOW // 2] = np.maximum(weight[: WINDOW // 2], 1)
                out[k][low - begin : high - begin] += got[r, low - a : high - a] * weight[:, None]
                mass[k][low - begin : high - begin] += weight
    for o, m in zip(out, mass, strict=True):
        o /= np.maximum(m, 1e-6)[:, None]
    return out


#: Characters of a text that are scored at once; a longer one comes in sections of so many, decoded as one all the same.
SECTION = (WINDOW - OVERLAP) * 1024


def decode_texts(p: dict, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of each text. The windows of all texts are scored together, overlapping scores are averaged, and one path of
    tags is decoded over each whole text, so no window's end decides anything."""
    ids = [encode(t) for t in texts]
    moves = p["T"] + legal_moves()
    tags: list[np.ndarray] = [np.zeros(0, np.int8)] * len(ids)
    order = sorted((k for k in range(len(ids)) if len(ids[k])), key=lambda k: -len(ids[k]))
    long = [[k] for k in order if len(ids[k]) > SECTION]
    short = [k for k in order if len(ids[k]) <= SECTION]
    groups = long
    for k in short:  # texts of like length together, at most 4 * SECTION characters with all as long as the first
        if groups is long or (len(groups[-1]) + 1) * len(ids[groups[-1][0]]) > 4 * SECTION:
            groups = [*groups, []]
        groups[-1].append(k)
    for group in groups:
        some = [ids[k] for k in group]
        lengths = np.array([len(x) for x in some])
        decoder = Viterbi(moves)
        for begin in range(0, int(lengths.max()), SECTION):
            steps = min(SECTION, int(lengths.max()) - begin)
            got = text_scores(p, some, begin, begin + steps)
            grid = np.zeros((len(some), steps, len(TAGS)), np.float32)
            for r, g in enumerate(got):
                grid[r, : len(g)] = g
            live = np.searchsorted(-lengths, -(begin + np.arange(steps)), "left")
            decoder.feed(grid, live)
        for k, path in zip(group, decoder.paths(lengths), strict=True):
            tags[k] = path
    return [_spans(t) for t in tags]


def _spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of equal types."""
    out: list[tuple[int, int, str]] = []
    for k in np.flatnonzero(tags):
        kind, begins = TYPES[(tags[k] - 1) // 2], (tags[k] - 1) % 2 == 0
        if out and out[-1][1] == k and out[-1][2] == kind and not begins:
            out[-1] = (out[-1][0], int(k) + 1, kind)
        else:
            out.append((int(k), int(k) + 1, kind))
    return out


def save(p: dict, path: str = WEIGHTS) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in p.items()})


@lru_cache(maxsize=2)
def load_model(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}
