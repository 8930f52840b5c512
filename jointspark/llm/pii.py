"""Personal data: pattern spans, and a character-level bidirectional LSTM with CRF transitions.

Patterns with checks (parts of an address, Luhn sum, digit counts) give the base spans.  They also
label the windows that the network learns from: at most ``SAMPLE_WINDOWS`` distinct windows, those
with the smallest hashes.  All four kinds hold a digit or an ``@``, so the network reads every stretch of
every whole text within ``REACH`` characters of one, as windows that overlap by half.  The scores that
overlapping windows give to a character are averaged, weighted by how much of its surroundings a window sees,
and one best path of tags is decoded over a whole stretch, so a span may be longer than a window.  Spans that
overlap a base span, or an earlier one, are dropped.  Base spans always stay.

A null text is empty and has no spans.  Repeated rows give equal rows; of equal spans one stays; null ids stay
null; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE, REACH = 64, 32, 24
#: Windows that the network is fitted on, at most.
SAMPLE_WINDOWS = 2000
TAGS = 1 + 2 * len(KINDS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits are taken whole: a start inside a run of digits could only fail as its first digit did.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


def _class_table() -> np.ndarray:
    table = np.full(128, 19, np.int8)
    table[48:58] = 1
    table[97:123] = 2
    table[65:91] = 3
    for k, marks in enumerate(("@", ".", "-", "+", "(", ")", " ", "\t\n\x0b\f\r", "_", "%", "\"'", ":", "/", ","), 4):
        for c in marks:
            table[ord(c)] = k
    return table


_CLASSES = _class_table()
N_CLASSES = 20


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASSES[np.minimum(points, 127)], 18).astype(np.int8)


def window_starts(text: str) -> list[int]:
    """Starts of the windows over every stretch near a digit or ``@``."""
    stretches: list[list[int]] = []
    for m in _CUE.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = b
        else:
            stretches.append([a, b])
    return [s for a, b in stretches for s in range(a, max(a + 1, b - STRIDE), STRIDE)]


def windows(text: str, starts: list[int]) -> np.ndarray:
    """(window, position) character classes; 0 beyond the text."""
    known = np.concatenate([classes(text), np.zeros(WIDTH, np.int8)])
    return known[np.array(starts, np.int64)[:, None] + np.arange(WIDTH)] if starts else np.zeros((0, WIDTH), np.int8)


def labels(spans: list[tuple[int, int, int]], starts: list[int]) -> np.ndarray:
    """Tags of every window; of spans that overlap, the later one's, as far as it reaches."""
    out = np.zeros((len(starts), WIDTH), np.int8)
    for s, kind, e in spans:
        for row in range(bisect.bisect_right(starts, s - WIDTH), bisect.bisect_left(starts, e)):
            at = starts[row]
            a, b = max(s - at, 0), min(e - at, WIDTH)
            out[row, a:b] = 2 + 2 * kind
            if s >= at:
                out[row, a] = 1 + 2 * kind
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _forbidden() -> np.ndarray:
    """Transitions into the inside of a kind from anything but that kind."""
    out = np.zeros((TAGS, TAGS))
    for kind in range(len(KINDS)):
        out[:, 2 + 2 * kind] = -1e4
        out[1 + 2 * kind, 2 + 2 * kind] = out[2 + 2 * kind, 2 + 2 * kind] = 0
    return out


@dataclass
class Tagger:
    p: dict[str, np.ndarray]

    @staticmethod
    def new(hidden: int = 16, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {}
        for way in "fb":
            p["w" + way] = rng.normal(0, 0.3, (N_CLASSES, 4 * hidden))
            p["u" + way] = rng.normal(0, 0.25, (hidden, 4 * hidden))
            p["c" + way] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        p["o"], p["q"] = rng.normal(0, 0.3, (2 * hidden, TAGS)), np.zeros(TAGS)
        p["t"] = np.zeros((TAGS, TAGS))
        return Tagger(p)

    def _run(self, x: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """Hidden states (position, window, hidden) of one direction; x is (position, window)."""
        w, u, c = (self.p[k + way] for k in "wuc")
        hidden = u.shape[0]
        h = s = np.zeros((x.shape[1], hidden))
        out = np.zeros((*x.shape, hidden))
        inputs = w + c
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = inputs[x[t]] + h @ u
            i, f, o = (_sigmoid(z[:, k * hidden : (k + 1) * hidden]) for k in range(3))
            g = np.tanh(z[:, 3 * hidden :])
            before, previous = s, h
            s = f * s + i * g
            tanh = np.tanh(s)
            h = out[t] = o * tanh
            if keep is not None:
                keep.append((t, i, f, o, g, before, tanh, previous))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        states = np.concatenate([self._run(x, way, None if keep is None else keep.setdefault(way, [])) for way in "fb"], axis=2)
        if keep is not None:
            keep["states"] = states
        return states @ self.p["o"] + self.p["q"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for classes x and tags y, both (position, window)."""
        keep: dict = {}
        e = self.emissions(x, keep)
        steps, n, _ = e.shape
        moves = self.p["t"] + _forbidden()
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + moves, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(moves + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsum(alpha[-1], 1)
        cols = np.arange(n)
        gold = e[np.arange(steps)[:, None], cols, y].sum(axis=0) + moves[y[:-1], y[1:]].sum(axis=0)
        d = np.exp(alpha + beta - total[:, None])
        g = {"t": np.zeros((TAGS, TAGS))}
        for t in range(1, steps):
            g["t"] += np.exp(alpha[t - 1][:, :, None] + moves + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.add.at(g["t"], (y[:-1].ravel(), y[1:].ravel()), -1)
        d[np.arange(steps)[:, None], cols, y] -= 1
        states = keep["states"]
        hidden = states.shape[2] // 2
        g["o"], g["q"] = np.einsum("tnh,tnk->hk", states, d), d.sum(axis=(0, 1))
        back = d @ self.p["o"].T
        for k, way in enumerate("fb"):
            u = self.p["u" + way]
            gw, gu, gc = np.zeros_like(self.p["w" + way]), np.zeros_like(u), np.zeros_like(self.p["c" + way])
            dh, ds = np.zeros((n, hidden)), np.zeros((n, hidden))
            for t, i, f, o, c, before, tanh, previous in reversed(keep[way]):
                dh = dh + back[t][:, k * hidden : (k + 1) * hidden]
                ds = ds + dh * o * (1 - tanh**2)
                dz = np.concatenate([ds * c * i * (1 - i), ds * before * f * (1 - f), dh * tanh * o * (1 - o), ds * i * (1 - c**2)], axis=1)
                np.add.at(gw, x[t], dz)
                gu += previous.T @ dz
                gc += dz.sum(axis=0)
                dh, ds = dz @ u.T, ds * f
            g["w" + way], g["u" + way], g["c" + way] = gw, gu, gc
        return float((total - gold).mean()), {key: value / n for key, value in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 64, rate: float = 0.02, seed: int = 7) -> float:
        """Adam on (window, position) classes and tags; returns the last mean loss."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        loss = 0.0
        for step in range(1, steps + 1):
            rows = rng.choice(len(x), min(batch, len(x)), replace=False)
            loss, g = self.gradients(x[rows].T.astype(np.int64), y[rows].T.astype(np.int64))
            norm = np.sqrt(sum((a**2).sum() for a in g.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, a in g.items():
                a = a * scale
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return loss

    def tags(self, x: np.ndarray) -> np.ndarray:
        """Best tags of (window, position) classes, each window by itself."""
        return self.paths(self.emissions(x.T.astype(np.int64))).T

    def paths(self, e: np.ndarray) -> np.ndarray:
        """Best tags of (position, sequence, tag) scores."""
        moves = self.p["t"] + _forbidden()
        score, back = e[0], np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            reach = score[:, :, None] + moves
            back[t] = reach.argmax(axis=1)
            score = reach.max(axis=1) + e[t]
        out = np.zeros(e.shape[:2], np.int8)
        out[-1] = score.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t][np.arange(e.shape[1]), out[t]]
        return out


#: Weight of a window's score at each of its positions: how far the nearer end is.
_SEEN = (np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1]) + 1.0)[:, None]
#: Window positions that are scored together.
_SCORED = 1 << 18


def stretch_tags(tagger: Tagger, x: np.ndarray, starts: list[int]) -> list[tuple[int, np.ndarray]]:
    """(first position, tags) of each stretch of windows that overlap or touch; stretches of like length are decoded together."""
    e = np.concatenate([tagger.emissions(x[a : a + _SCORED // WIDTH].T.astype(np.int64)).transpose(1, 0, 2) for a in range(0, len(x), _SCORED // WIDTH)])
    at = np.array(starts, np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > WIDTH]))
    until = np.append(first[1:], len(at))
    merged = []
    for a, b in zip(first, until, strict=True):
        n = int(at[b - 1] - at[a]) + WIDTH
        total, weight = np.zeros((n, TAGS)), np.zeros((n, 1))
        for k in range(a, b):
            here = slice(int(at[k] - at[a]), int(at[k] - at[a]) + WIDTH)
            total[here] += e[k] * _SEEN
            weight[here] += _SEEN
        merged.append(total / weight)
    out: list = [None] * len(merged)
    order = sorted(range(len(merged)), key=lambda k: len(merged[k]))
    while order:
        group, size = [], 0
        while order and (not group or (len(merged[order[0]]) <= 2 * len(merged[group[0]]) and size + len(merged[order[0]]) <= _SCORED)):
            size += len(merged[order[0]])
            group.append(order.pop(0))
        longest = len(merged[group[-1]])
        scores = np.zeros((longest, len(group), TAGS))
        scores[:, :, 1:] = -1e4  # beyond a stretch's end, only "outside" is possible
        for j, k in enumerate(group):
            scores[: len(merged[k]), j] = merged[k]
        tags = tagger.paths(scores)
        for j, k in enumerate(group):
            out[k] = (int(at[first[k]]), tags[: len(merged[k]), j])
    return out


def _plausible(kind: int, part: str) -> bool:
    digits = sum("0" <= c <= "9" for c in part)
    return "@" in part[1:-1] if kind == 0 else part.count(".") == 3 and digits >= 4 if kind == 1 else digits >= 12 if kind == 2 else 7 <= digits <= 15


def reconciled(text: str, stretches: list[tuple[int, np.ndarray]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those of the network that overlap none, in one sweep from the left."""
    covered: list[list[int]] = []
    for s, _, e in base:
        if covered and s < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    out, next_, free = list(base), 0, 0
    for at, row in stretches:
        for i in np.flatnonzero(row % 2 == 1).tolist():
            kind, j = (int(row[i]) - 1) // 2, i + 1
            while j < len(row) and row[j] == 2 + 2 * kind:
                j += 1
            s, e = at + i, min(at + j, len(text))
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            while next_ < len(covered) and covered[next_][1] <= s:
                next_ += 1
            if free <= s < e and (next_ == len(covered) or e <= covered[next_][0]) and _plausible(kind, text[s:e]):
                out.append((s, kind, e))
                free = e
    return sorted(out)


def tagged(texts: list[str], tagger: Tagger | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; windows of all texts are tagged together in bounded batches."""
    base = [base_spans(t) for t in texts]
    starts = [window_starts(t) if tagger else [] for t in texts]
    found: list[list] = [[] for _ in texts]
    held, rows = [], 0
    for k in range(len(texts)):
        if starts[k]:
            held.append(k)
            rows += len(starts[k])
        if held and (rows >= 4096 or k == len(texts) - 1):
            # Texts are laid out far enough apart that no stretch reaches from one into the next.
            shift = np.cumsum([0, *(starts[j][-1] + 4 * WIDTH for j in held)])
            x = np.concatenate([windows(texts[j], starts[j]) for j in held])
            for at, tags in stretch_tags(tagger, x, [int(d) + s for j, d in zip(held, shift, strict=False) for s in starts[j]]):
                own = int(np.searchsorted(shift, at, "right")) - 1
                found[held[own]].append((at - int(shift[own]), tags))
            held, rows = [], 0
    return [(base[k], reconciled(text, found[k], base[k]) if found[k] else base[k]) for k, text in enumerate(texts)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in spans)


def _labelled(batches):
    for batch in batches:
        for text in batch.column(0).to_pylist():
            starts = window_starts(text or "")
            if starts:
                x, y = windows(text, starts), labels(base_spans(text), starts)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in y], pa.binary())], names=["x", "y"])


#: Bytes of text for which one window of the sample is drawn at least, where there are so many windows.
_DRAWN = 4096


def learned(docs: DataFrame, text_column: str, sample: int = SAMPLE_WINDOWS) -> Tagger | None:
    """A tagger fitted on the sample's windows, the same on every run; None where no text has a digit or ``@``.

    A window is drawn by its hash in the task that finds it, so only a share that shrinks with the corpus leaves a task.
    """
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    share = min(1.0, sample * _DRAWN / max(size, 1))

    def drawn(batches):
        for batch in _labelled(batches):
            keep = [zlib.crc32(x) < share * 2**32 for x in batch.column(0).to_pylist()]
            if any(keep):
                yield batch.filter(pa.array(keep))

    found = docs.select(F.col(text_column).alias("text")).mapInArrow(drawn, "x binary, y binary").groupBy("x").agg(F.min("y").alias("y"))
    rows = found.orderBy(F.xxhash64("x"), "x").limit(sample).collect()
    if not rows:
        return None
    x = np.array([np.frombuffer(bytes(r["x"]), np.int8) for r in rows])
    y = np.array([np.frombuffer(bytes(r["y"]), np.int8) for r in rows])
    tagger = Tagger.new()
    tagger.fit(x, y)
    return tagger


def detected(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE_WINDOWS) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; the counts are of base spans."""
    tagger = learned(docs, text_column, sample)

    def run(batches):
        for batch in batches:
            rows = []
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                for base, spans in tagged([t or "" for t in texts[at : at + 256].to_pylist()], tagger):
                    counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                    rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become the first one's."""
    parts, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            parts += [text[at:s], f"<{KINDS[kind].upper()}>"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, text_column: str = "text", sample: int = SAMPLE_WINDOWS) -> DataFrame:
    """``docs`` with personal data masked in its text; null texts stay null, other columns are untouched."""
    tagger = learned(docs, text_column, sample)
    place = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            out = []
            texts = batch.column(place)
            for at in range(0, len(texts), 256):
                given = texts[at : at + 256].to_pylist()
                for text, (_, spans) in zip(given, tagged([t or "" for t in given], tagger), strict=True):
                    out.append(masked_text(text, spans) if spans else text)
            columns = [pa.array(out, texts.type) if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
