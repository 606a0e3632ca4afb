"""Personal data by a character BiLSTM with CRF transitions, over base rules.

The base rules find e-mail addresses, IP addresses, payment cards and phone
numbers by pattern and check.  A bidirectional LSTM over character classes
with a linear-chain CRF on top (numpy) finds spans in forms that the patterns
miss: spaced or spelled-out addresses, phone numbers without a country code,
cards and IP addresses with other separators.  It is trained here on windows
of a bounded sample: spans labelled by the base rules, the same spans written
in such forms, and dates, times and versions as what is none; windows with a
match that fails its check are left out.  A text is read in overlapping
windows; each window is decoded by itself and the spans are then reconciled
over the whole text: parts of one span that windows cut are joined, of
conflicting spans the one nearest to the middle of its window stays, and a
span must pass the check of its kind (a card's last digit, for example).

Every span holds a digit, an @ or a bracketed "at", so a window without any of
these decodes to nothing and is not run.  Spans of the base rules always stay;
a found span that overlaps one of its kind adds nothing.

Nulls: a null text is empty.  Repeated rows give equal spans.  No text with a
digit or an @ to learn from: the base rules alone.  Empty table: no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesdeck.llm.common import read, save_shared

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Documents that labelled windows are taken from, and windows.
SAMPLE_DOCUMENTS = 600
SAMPLE_WINDOWS = 3000
#: Documents looked at for each one of the sample; if fewer than one in so
#: many holds a digit or an @, the sample is smaller.
SAMPLE_SPARE = 32
WINDOW, STRIDE = 64, 32
HIDDEN, EMBEDDED = 16, 8
BATCH, STEPS, RATE = 64, 500, 0.03
#: Windows with a labelled span in another form, and with what is none in its place.
FORMS, OTHERS = 4, 2
TRIGGER = re.compile(r"[0-9@]|[(\[]\s?at\s?[)\]]", re.I)
NUMBERS = re.compile(r"[0-9]+")
#: What an address has between its parts, in any form.
AT = re.compile(r"\s?(?:@|[(\[]\s?at\s?[)\]])\s?", re.I)
DOT = re.compile(r"\s?(?:\.|[(\[]\s?dot\s?[)\]])\s?", re.I)

#: Character classes: one for each of these signs, then lower and upper case,
#: digits, other letters, white space and all else.
SIGNS = "@.+-_%()[]/:=,\" "
CLASSES = len(SIGNS) + 6
#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
FORBIDDEN = -1e4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passed) of every match of the base patterns."""
    found = []
    if "@" in text:
        found += [("email", *m.span(), True) for m in EMAIL.finditer(text)]
    if TRIGGER.search(text):
        found += [("ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
                  for m in IP.finditer(text)]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            found.append(("card", *m.span(), 12 <= len(digits) <= 19 and luhn(digits)))
        found += [("phone", *m.span(), 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15) for m in PHONE.finditer(text)]
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of ``KINDS``."""
    return sorted((s[:3] for s in matches(text) if s[3]), key=lambda s: (s[1], KINDS.index(s[0])))


def doubtful(text: str) -> list[tuple[int, int]]:
    """Matches that only fail a check on their digits: neither personal data
    for sure nor free of it, so they say nothing about either."""
    least = {"email": 0, "ip": 4, "card": 12, "phone": 9}
    return [(a, b) for kind, a, b, passed in matches(text) if not passed and sum("0" <= c <= "9" for c in text[a:b]) >= least[kind]]


# -------------------------------------------------------------- other forms

def other_form(kind: str, span: str, rng: np.random.Generator) -> str:
    """A labelled span as it is written where the patterns don't look."""
    if kind == "email":
        local, host = span.split("@", 1)
        at, dot = [(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."), (" @ ", " . "), ("[at]", "[dot]")][rng.integers(6)]
        return local + at + host.replace(".", dot)
    digits = NUMBERS.findall(span)
    if kind == "ip":
        return ["[.]", " . ", "(.)", "[dot]"][rng.integers(4)].join(digits)
    run = "".join(digits)
    if kind == "card":
        return [".", "/", "  ", " - ", "_"][rng.integers(5)].join(run[i:i + 4] for i in range(0, len(run), 4))
    run = "0" + run[-9:] if rng.integers(2) else run[-10:].rjust(10, "0")
    a, b, c = run[:3], run[3:6], run[6:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{run[:4]}/{run[4:]}", f"{run[:4]} {run[4:7]} {run[7:]}", f"({run[:4]}) {run[4:]}"][rng.integers(6)]


def no_span(rng: np.random.Generator) -> str:
    """Numbers that are nobody's: dates, times, versions, amounts, hashes."""
    d = rng.integers(0, 10, 12)
    year, month, day = 1950 + int(rng.integers(90)), 1 + int(rng.integers(12)), 1 + int(rng.integers(28))
    return [f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{day}/{month}/{year}", f"{d[0]}{d[1]}:{d[2]}{d[3]}:{d[4]}{d[5]}",
            f"{year}-{month:02}-{day:02} {d[0]}{d[1]}:{d[2]}{d[3]}", f"v{d[0]}.{d[1]}{d[2]}.{d[3]}", f"{d[0]},{d[1]}{d[2]}{d[3]},{d[4]}{d[5]}{d[6]}.{d[7]}{d[8]}",
            f"{year}", f"{d[0]}{d[1]}%", f"token = \"{int(rng.integers(1 << 62)):016x}{int(rng.integers(1 << 62)):016x}\"",
            f"{year}-{1 + year}", f"({d[0]}{d[1]})", f"[{d[0]}] {d[1]}{d[2]} {d[3]}{d[4]}"][rng.integers(13)]


def put_in(text: str, a: int, b: int, form: str, rng: np.random.Generator) -> tuple[str, int, int]:
    """A window of ``text`` with ``form`` in place of ``a:b``, and where it lies."""
    before = int(rng.integers(0, max(1, WINDOW - len(form))))
    left = text[max(0, a - before):a]
    return (left + form + text[b:b + WINDOW])[:WINDOW], len(left), min(WINDOW, len(left) + len(form))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ------------------------------------------------------------------ windows

def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a digit, an @ or a bracketed "at"; every
    place of the text lies in two windows (one at its ends)."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    starts = set()
    for m in TRIGGER.finditer(text):
        w = m.start() // STRIDE
        starts |= {i for i in (w - 1, w) if 0 <= i <= last}
        if w > last:
            starts.add(last)
    return [i * STRIDE for i in sorted(starts)]


def class_table() -> np.ndarray:
    """Class of each code point below 256; above, letters and others are told by ``encode``."""
    table = np.full(256, CLASSES - 1, np.int8)
    for c in range(256):
        s = chr(c)
        if s in SIGNS:
            table[c] = SIGNS.index(s)
        elif "a" <= s <= "z":
            table[c] = len(SIGNS)
        elif "A" <= s <= "Z":
            table[c] = len(SIGNS) + 1
        elif "0" <= s <= "9":
            table[c] = len(SIGNS) + 2
        elif s.isalpha():
            table[c] = len(SIGNS) + 3
        elif s.isspace():
            table[c] = len(SIGNS) + 4
    return table


def encode(parts: list[str], table: np.ndarray) -> np.ndarray:
    """(time, window) classes; windows are filled up with white space."""
    points = np.frombuffer("".join(p.ljust(WINDOW, "\n") for p in parts).encode("utf-32-le"), np.uint32)
    return np.where(points < 256, table[np.minimum(points, 255)], len(SIGNS) + 3).reshape(len(parts), WINDOW).T


def tags_of(start: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Tags of a window; a span cut by its edges is tagged as far as it shows."""
    tags = np.zeros(WINDOW, np.int8)
    for kind, a, b in spans:
        a, b = max(a - start, 0), min(b - start, WINDOW)
        if a < b:
            k = 1 + 2 * KINDS.index(kind)
            tags[a:b] = k + 1
            tags[a] = k
    return tags


# -------------------------------------------------------------------- model

def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    model = {"emb": rng.normal(0, 0.5, (CLASSES, EMBEDDED)), "out": draw(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS),
             "trans": np.zeros((TAGS, TAGS))}
    for side in "fb":
        model[f"x{side}"], model[f"h{side}"] = draw(EMBEDDED, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)
        model[f"b{side}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # gates: input, forget, output, cell
    return model


def allowed() -> np.ndarray:
    """Inside may only follow begin or inside of its kind."""
    mask = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        mask[:, inside] = FORBIDDEN
        mask[[inside - 1, inside], inside] = 0
    return mask


def lstm(drive: np.ndarray, weights: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (time, window, HIDDEN) for gate drives (time, window, 4 HIDDEN)."""
    steps, lanes, _ = drive.shape
    h, c = np.zeros((lanes, HIDDEN), drive.dtype), np.zeros((lanes, HIDDEN), drive.dtype)
    states = np.empty((steps, lanes, HIDDEN), drive.dtype)
    for t in range(steps):
        z = drive[t] + h @ weights
        gates = 0.5 * (1 + np.tanh(0.5 * z[:, :3 * HIDDEN]))
        cell = np.tanh(z[:, 3 * HIDDEN:])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        before, c = c, f * c + i * cell
        squashed = np.tanh(c)
        states[t] = o * squashed
        if keep is not None:
            keep.append((gates, cell, before, squashed, h))
        h = states[t]
    return states


def lstm_back(grad: np.ndarray, weights: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate drives and of the recurrent weights."""
    steps, lanes, _ = grad.shape
    dh, dc = np.zeros((lanes, HIDDEN)), np.zeros((lanes, HIDDEN))
    drives, dw = np.empty((steps, lanes, 4 * HIDDEN)), np.zeros_like(weights)
    for t in range(steps - 1, -1, -1):
        gates, cell, before, squashed, h = kept[t]
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - squashed * squashed)
        dz = drives[t]
        dz[:, :HIDDEN], dz[:, HIDDEN:2 * HIDDEN], dz[:, 2 * HIDDEN:3 * HIDDEN] = dc * cell, dc * before, dh * squashed
        dz[:, :3 * HIDDEN] *= gates * (1 - gates)
        dz[:, 3 * HIDDEN:] = dc * i * (1 - cell * cell)
        dw += h.T @ dz
        dh, dc = dz @ weights.T, dc * f
    return drives, dw


def emissions(model: dict[str, np.ndarray], x: np.ndarray, keep: dict[str, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tag scores (time, window, TAGS) and the hidden states below them."""
    both = []
    for side, seen in (("f", x), ("b", x[::-1])):
        drive = (model["emb"] @ model[f"x{side}"] + model[f"b{side}"])[seen]
        states = lstm(drive, model[f"h{side}"], None if keep is None else keep.setdefault(side, []))
        both.append(states if side == "f" else states[::-1])
    hidden = np.concatenate(both, axis=2)
    return hidden @ model["out"] + model["out_b"], hidden


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def crf_gradient(scores: np.ndarray, trans: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of ``tags`` (time, window) and its gradients."""
    steps, lanes, _ = scores.shape
    one = np.eye(TAGS)
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = scores[t] + log_sum(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = log_sum(trans + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    z = log_sum(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - z[None, :, None]) - one[tags]
    d_trans = np.zeros_like(trans)
    for t in range(1, steps):
        pair = np.exp(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t])[:, None, :] - z[:, None, None])
        d_trans += pair.sum(axis=0) - one[tags[t - 1]].T @ one[tags[t]]
    gold = np.take_along_axis(scores, tags[:, :, None].astype(int), 2).sum() + trans[tags[:-1], tags[1:]].sum()
    return float(z.sum() - gold) / lanes, d_scores / lanes, d_trans / lanes


def train(x: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on windows (time, window) with their tags."""
    model, mask, rng = new_model(seed), allowed(), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, x.shape[1], min(BATCH, x.shape[1]))
        bx, by = x[:, pick], tags[:, pick]
        keep: dict[str, list] = {}
        scores, hidden = emissions(model, bx, keep)
        _, d_scores, d_trans = crf_gradient(scores, model["trans"] + mask, by)
        grad = {"trans": d_trans, "out_b": d_scores.sum(axis=(0, 1)),
                "out": hidden.reshape(-1, 2 * HIDDEN).T @ d_scores.reshape(-1, TAGS), "emb": np.zeros_like(model["emb"])}
        d_hidden = d_scores @ model["out"].T
        for side, seen, part in (("f", bx, d_hidden[:, :, :HIDDEN]), ("b", bx[::-1], d_hidden[::-1, :, HIDDEN:])):
            drives, grad[f"h{side}"] = lstm_back(part, model[f"h{side}"], keep[side])
            table = np.zeros((CLASSES, 4 * HIDDEN))  # drives come from a table by class
            np.add.at(table, seen.ravel(), drives.reshape(-1, 4 * HIDDEN))
            grad[f"b{side}"] = table.sum(axis=0)
            grad[f"x{side}"] = model["emb"].T @ table
            grad["emb"] += table @ model[f"x{side}"].T
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model[k] = model[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in model.items()}


def decode(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Best tags (time, window)."""
    scores, _ = emissions(model, x)
    trans = model["trans"] + allowed().astype(np.float32)
    back = np.empty(scores.shape, np.int8)
    best = scores[0]
    for t in range(1, len(scores)):
        reach = best[:, :, None] + trans
        back[t] = reach.argmax(axis=1)
        best = reach.max(axis=1) + scores[t]
    tags = np.empty(scores.shape[:2], np.int8)
    tags[-1] = best.argmax(axis=1)
    lanes = np.arange(scores.shape[1])
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = back[t][lanes, tags[t]]
    return tags


def window_spans(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of one window; an inside without a begin (a span cut by the window's start) begins one."""
    spans: list[tuple[str, int, int]] = []
    open_kind, start = 0, 0
    for t, tag in enumerate([*tags.tolist(), 0]):
        kind = (tag + 1) // 2
        if open_kind and (kind != open_kind or tag == 2 * kind - 1):
            spans.append((KINDS[open_kind - 1], start, t))
            open_kind = 0
        if kind and not open_kind:
            open_kind, start = kind, t
    return spans


def plausible(kind: str, span: str) -> bool:
    """The check that follows the model: a span can be of its kind at all."""
    if kind == "email":
        parts = AT.split(span)
        names = [] if len(parts) != 2 else [parts[0], *DOT.split(parts[1])]
        return len(names) > 2 and all(names)
    digits = NUMBERS.findall(span)
    count = sum(map(len, digits))
    if kind == "ip":
        return len(digits) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in digits)
    if kind == "card":
        return 12 <= count <= 19 and luhn("".join(digits))
    # a bare run of digits is no phone number, nor are four numbers in a row of an address
    return 9 <= count <= 15 and (len(digits) > 1 or span[0] in "+(0") and not (len(digits) == 4 and max(map(len, digits)) <= 3)


def reconcile(text: str, found: list[tuple[int, str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of a whole text from (window start, kind, start, end) of its windows."""
    by_kind: dict[str, list[list]] = {}
    for w, kind, a, b in sorted(found, key=lambda s: (s[2], s[3])):
        off = abs((a + b) / 2 - (w + WINDOW / 2))
        cut = (a == w and a > 0) or (b == w + WINDOW and b < len(text))
        runs = by_kind.setdefault(kind, [])
        last = runs[-1] if runs else None
        if last and a < last[1]:
            if cut or last[3]:       # parts of one span
                last[1], last[2], last[3] = max(last[1], b), min(last[2], off), False
            elif off < last[2]:      # two readings of one place
                last[:] = [a, b, off, cut]
        else:
            runs.append([a, b, off, cut])
    ranked = sorted((off, a, b, kind) for kind, runs in by_kind.items() for a, b, off, _ in runs)
    chosen: list[tuple[str, int, int]] = []
    for _, a, b, kind in ranked:
        if plausible(kind, text[a:b]) and not any(a < y and x < b for _, x, y in chosen):
            chosen.append((kind, a, b))
    return chosen


def find_spans(texts: list[str], model: dict[str, np.ndarray] | None, table: np.ndarray) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    found: list[list] = [[] for _ in texts]
    if model is not None:
        places = [(i, w) for i, t in enumerate(texts) for w in windows_of(t)]
        for at in range(0, len(places), 512):
            some = places[at:at + 512]
            tags = decode(model, encode([texts[i][w:w + WINDOW] for i, w in some], table))
            for lane, (i, w) in enumerate(some):
                if tags[:, lane].any():
                    found[i] += [(w, k, w + a, min(w + b, len(texts[i]))) for k, a, b in window_spans(tags[:, lane])
                                 if w + a < len(texts[i])]
    out = []
    for text, sure, some in zip(texts, base, found, strict=True):
        more = [s for s in reconcile(text, some) if not any(s[0] == k and s[1] < b and a < s[2] for k, a, b in sure)] if some else []
        out.append((sure, sorted([*sure, *more], key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


# -------------------------------------------------------------------- Spark

#: Digits beside the spans of a window from which on it may hold a span that the patterns miss.
UNTOLD = 4


def training_windows(text: str) -> list[tuple[str, bytes]]:
    """Windows of ``text`` with their tags: as they are, with spans in other
    forms, and with numbers that are no spans.  What may hold a span that the
    base rules miss says nothing and is left out.  The same on every run."""
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    spans, unsure = base_spans(text), doubtful(text)

    def told(start: int, end: int, near: list[tuple[str, int, int]]) -> bool:
        """Whether a part of the text is known to hold no span but ``near``."""
        if any(a < end and start < b for a, b in unsure):
            return False
        rest, at = [], start
        for _, a, b in sorted(near, key=lambda s: s[1]):
            rest.append(text[at:max(at, a)])
            at = max(at, b)
        rest.append(text[at:max(at, end)])
        return not any(AT.search(x) for x in rest) and sum("0" <= c <= "9" for x in rest for c in x) < UNTOLD

    rows, none = [], bytes(WINDOW)
    for w in windows_of(text):
        near = [s for s in spans if s[1] < w + WINDOW and s[2] > w]
        if not told(w, w + WINDOW, near):
            continue
        rows.append((text[w:w + WINDOW], tags_of(w, near).tobytes()))
    for kind, a, b in spans:
        if not told(max(0, a - WINDOW), b + WINDOW, [(kind, a, b)]):
            continue
        for _ in range(FORMS):
            part, start, end = put_in(text, a, b, other_form(kind, text[a:b], rng), rng)
            rows.append((part, tags_of(0, [(kind, start, end)]).tobytes()))
        for _ in range(OTHERS):
            rows.append((put_in(text, a, b, no_span(rng), rng)[0], none))
    return rows


def labelled_windows(docs: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Windows with tags from a bounded sample, the same on every run: the
    documents of least key hash that hold a digit or an @, their windows cut
    by a task, of those the ones of least hash."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row for t in batch["text"] for row in training_windows(t)], columns=["part", "tags"])

    # a hash share of the documents first, so that what is sorted for the
    # sample doesn't grow with the input or its partitions
    share = min(1.0, SAMPLE_DOCUMENTS * SAMPLE_SPARE / max(1, docs.count()))
    draw = F.shiftrightunsigned(F.xxhash64("key"), 11) / float(1 << 53)
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")) \
        .filter((draw < share) & F.col("text").rlike("[0-9@]")) \
        .orderBy(draw, "text").limit(SAMPLE_DOCUMENTS)
    # as many with spans as without, so that no long text of the one kind makes up the sample
    windows = save_shared(picked.select("text").mapInPandas(cut, "part string, tags binary"), "pii-windows")
    spanned = F.col("tags") != F.lit(bytes(WINDOW))
    rows = [r for some in (spanned, ~spanned)
            for r in windows.filter(some).orderBy(F.xxhash64("part"), "part").limit(SAMPLE_WINDOWS // 2).collect()]
    if not rows:
        return None
    tags = np.frombuffer(b"".join(bytes(r.tags) for r in rows), np.int8).reshape(len(rows), WINDOW).T
    return encode([r.part for r in rows], class_table()), tags


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``found``: ``base`` and ``spans`` as kind:start:end lists in
    code points, ``counts`` of the base spans of each kind."""
    sample = labelled_windows(docs, key, text)
    model = None if sample is None else train(*sample)
    table = class_table()

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = find_spans([t or "" for t in texts], model, table)
            yield pd.DataFrame({"base": [joined(b) for b, _ in found], "spans": [joined(s) for _, s in found],
                                "counts": [[sum(k == kind for k, _, _ in b) for kind in KINDS] for b, _ in found]})

    finder = F.pandas_udf(find, "base string, spans string, counts array<long>")
    return docs.select(F.col(key), finder(F.col(text)).alias("found"))


def op5_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [F.get("found.counts", F.lit(i)).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2("found.base", 256).alias("base_sha256"), F.col("found.spans").alias("spans"),
                        F.when(F.col("found.spans") == "", 0).otherwise(F.size(F.split("found.spans", ","))).cast("long").alias("n_spans"))
