"""The suffix tree as an automaton, of counts that fit one machine: what the
tables of ``salesdeck.llm.lm_scoring`` are tested against."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from salesdeck.llm.lm_scoring import END

SEGMENT = 512
#: Contexts that are expanded at a time.
CHUNK = 4096


@dataclass
class Automaton:
    """``classes``: column of each byte; ``step`` and ``log10``: next state
    (times the columns) and log probability, flat."""
    classes: np.ndarray
    step: np.ndarray
    log10: np.ndarray


def suffix_tree(d: np.ndarray, pair: np.ndarray, n: np.ndarray, depth: int) -> Automaton:
    """The automaton of the retained contexts, of counts that fit one machine:
    what the tables are tested against."""
    order = np.lexsort((pair, d))
    d, pair, n = d[order], pair[order], n[order]
    seen = np.unique(pair & 255) if len(pair) else np.empty(0, np.int64)
    classes = np.full(256, len(seen), np.int64)
    classes[seen] = np.arange(len(seen))
    width = len(seen) + 1  # the last column: any byte that was never seen
    total = float(n[d == 0].sum())

    keys: list[np.ndarray] = []      # contexts of each level, sorted
    probs: list[np.ndarray] = []     # their smoothed distributions
    retained: list[np.ndarray] = []
    for level in range(depth + 1):
        here = slice(*np.searchsorted(d, [level, level + 1]))
        contexts, row = np.unique(pair[here] >> 8, return_inverse=True)
        if level == 0 and not len(contexts):
            contexts = np.zeros(1, np.int64)
        smooth, gains = np.empty((len(contexts), width), np.float32), np.ones(len(contexts))
        for at in range(0, len(contexts), CHUNK):  # rows are sorted by context
            part = slice(*(np.searchsorted(row, [at, at + CHUNK]) + here.start))
            counts = np.zeros((min(CHUNK, len(contexts) - at), width))
            counts[row[part.start - here.start:part.stop - here.start] - at, classes[pair[part] & 255]] = n[part]
            if level == 0:
                smooth[:] = (counts + 0.5) / (total + 128.0)
                continue
            some = contexts[at:at + CHUNK] & ((1 << 8 * (level - 1)) - 1)
            parent = probs[level - 1][np.searchsorted(keys[level - 1], some)].astype(np.float64)
            kinds = (counts > 0).sum(axis=1, keepdims=True)
            mixed = (counts + kinds * parent) / (counts.sum(axis=1, keepdims=True) + kinds)
            gain = (counts * np.log(mixed / parent)).sum(axis=1)
            smooth[at:at + CHUNK] = mixed
            gains[at:at + CHUNK] = gain - 0.5 * kinds[:, 0] * np.log(max(total, 2))
        keys.append(contexts)
        probs.append(smooth)
        retained.append(gains > 0)
    for level in range(depth, 1, -1):  # parts of a retained context
        whole = keys[level][retained[level]]
        for part in (whole >> 8, whole & ((1 << 8 * (level - 1)) - 1)):
            retained[level - 1][np.searchsorted(keys[level - 1], part)] = True

    first = np.cumsum([0] + [int(r.sum()) for r in retained])
    states = [k[r] for k, r in zip(keys, retained, strict=True)]
    step = np.zeros((first[-1], width), np.int32)
    log10 = np.concatenate([np.log10(p[r]) for p, r in zip(probs, retained, strict=True)])
    del probs
    for level, contexts in enumerate(states):
        rows = slice(first[level], first[level + 1])
        for length in range(1, min(level + 1, depth) + 1):  # the longest that is found stays
            if not len(states[length]):
                break
            ends = (contexts & ((1 << 8 * (length - 1)) - 1))[:, None] << 8 | seen[None, :]
            at = np.minimum(np.searchsorted(states[length], ends), len(states[length]) - 1)
            step[rows, :-1] = np.where(states[length][at] == ends, first[length] + at, step[rows, :-1])
    return Automaton(classes, (step * np.int32(width)).ravel(), log10.ravel())


def run_automaton(tree: Automaton, texts: list[bytes], depth: int, segment: int = SEGMENT) -> np.ndarray:
    """log10 probability of each text.  Texts are cut into segments that run
    in step; a segment first reads the ``depth`` bytes before it, which settle
    its state."""
    pad = bytes([END]) * depth
    columns = tree.classes[np.frombuffer(b"".join(pad + t for t in texts), np.uint8)].astype(np.int32)
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths + depth) - lengths
    pieces = -(-lengths // segment)
    owner = np.repeat(np.arange(len(texts)), pieces)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begins[owner] + index * segment
    size = np.minimum(segment, lengths[owner] - index * segment)
    order = np.argsort(-size, kind="stable")
    start, size, owner = start[order], size[order], owner[order]
    state, score = np.zeros(len(start), np.int32), np.zeros(len(start))
    active = np.searchsorted(-size, -np.arange(segment), side="left")  # segments longer than j
    for j in range(-depth, segment):
        k = len(start) if j < 0 else int(active[j])
        if not k:
            break
        at = state[:k] + columns[start[:k] + j]
        if j >= 0:
            score[:k] += tree.log10[at]
        state[:k] = tree.step[at]
    return np.bincount(owner, score, len(texts))
