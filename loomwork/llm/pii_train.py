"""Fits the tagger: python -m loomwork.llm.pii_train DATA_DIR. Writes pii_model.npz beside this file.

Labelled spans come from rules and from the names that profiles state, over at most SAMPLE rows of resumes; digits are
varied from epoch to epoch so that the tagger learns shapes and contexts. HELD_OUT of the rows only measure.
"""

from __future__ import annotations

import sys
import time
from multiprocessing import Pool

import numpy as np

from loomwork.llm import pii_model as m
from loomwork.llm.pii_labels import TYPES, first_names, label, name_pattern

SAMPLE, HELD_OUT, EPOCHS, BATCH, WORKERS = 2800, 400, 36, 256, 8


def read(folder: str) -> list[tuple[str, str | None]]:
    import pyarrow.parquet as pq

    t = pq.read_table(f"{folder}/resumes.parquet", columns=["raw_text", "parsed_profile"]).to_pylist()
    rows = [(r["raw_text"], ((r["parsed_profile"] or {}).get("contact") or {}).get("name")) for r in t if r["raw_text"] and r["raw_text"].strip()]
    return rows[:SAMPLE]


def tags_of(text: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(text), np.int8)
    for a, b, kind in spans:
        k = TYPES.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def cut(texts: list[str], tags: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for text, y in zip(texts, tags, strict=True):
        x = m.encode(text).copy()
        digits = np.flatnonzero((x >= 16) & (x <= 25))  # the numbers of 0 to 9
        vary = digits[rng.random(len(digits)) < rng.choice([0.0, 0.3, 1.0])]
        x[vary] = rng.integers(16, 26, len(vary))
        for a in m.windows(len(x)):
            a = max(0, a + int(rng.integers(-40, 41)))
            piece, tag = x[a : a + m.WINDOW], y[a : a + m.WINDOW]
            if len(piece) < 8 or (not tag.any() and rng.random() > 0.5):
                continue
            gx, gy = np.full(m.WINDOW, m.encode("\n")[0], np.uint8), np.zeros(m.WINDOW, np.int8)
            gx[: len(piece)], gy[: len(tag)] = piece, tag
            # a window may begin inside a span
            inside = (gy[0] > 0) and (gy[0] % 2 == 0)
            if inside:
                gy[0] -= 1
            xs.append(gx)
            ys.append(gy)
    return np.stack(xs), np.stack(ys)


def _job(args: tuple) -> tuple[float, dict]:
    p, x, y = args
    return m.gradients(p, x, y.astype(np.int64), m.legal_moves())


def measure(p: dict, texts: list[str], tags: list[list[tuple[int, int, str]]]) -> dict[str, tuple[float, float]]:
    got = m.decode_texts(p, texts)
    out = {}
    for kind in TYPES:
        a = {(k, *s) for k, spans in enumerate(got) for s in spans if s[2] == kind}
        b = {(k, *s) for k, spans in enumerate(tags) for s in spans if s[2] == kind}
        out[kind] = (len(a & b) / max(1, len(a)), len(a & b) / max(1, len(b)))
    return out


def main(folder: str) -> None:
    rows = read(folder)
    names = name_pattern(first_names(n for _, n in rows))
    rng = np.random.default_rng(1)
    order = rng.permutation(len(rows))
    texts = [rows[k][0] for k in order]
    spans = [label(t, names) for t in texts]
    held, train = slice(0, HELD_OUT), slice(HELD_OUT, None)
    tags = [tags_of(t, s) for t, s in zip(texts, spans, strict=True)]
    p = m.start()
    mean, square = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    began, step = time.time(), 0
    with Pool(WORKERS) as pool:
        for epoch in range(EPOCHS):
            x, y = cut(texts[train], tags[train], rng)
            at = rng.permutation(len(x))
            total, n = 0.0, 0
            for s in range(0, len(at) - BATCH + 1, BATCH):
                parts = np.array_split(at[s : s + BATCH], WORKERS)
                got = pool.map(_job, [(p, x[q], y[q]) for q in parts])
                grad = {k: sum(g[1][k] for g in got) / len(got) for k in p}
                norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                step += 1
                progress = (epoch + s / len(at)) / EPOCHS
                rate = 8e-3 * min(1, step / 20) * (1 - progress) ** 0.7 + 1e-4
                for k, g in grad.items():
                    g = g * min(1.0, 0.25 / (norm + 1e-9))
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
                total, n = total + sum(g[0] for g in got) / len(got), n + 1
            score = {k: tuple(round(v, 3) for v in q) for k, q in measure(p, texts[held], spans[held]).items()}
            print(epoch, round(total / max(1, n), 5), score, round(time.time() - began), flush=True)
    m.save(p)


if __name__ == "__main__":
    main(sys.argv[1])
