"""Secret scans: patterns, and a character convolutional network over candidates in their context (operator 4).

The patterns find the base spans. Every other long token that could be a key is a candidate: the network reads its
characters with those around it and scores it. It is trained here in numpy on labelled findings, its scores are calibrated
on findings it has not seen, and its threshold is the highest that keeps at least RECALL of the true ones among those.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import in_arrow

# The base patterns in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
LEAST_VALUE = 6

#: A candidate: a token of 16 characters or more.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
BEFORE, INSIDE, AFTER = 24, 64, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Windows that are scored at a time.
HELD = 4096
RECALL = 0.98
FINDINGS, EPOCHS, SEED = 5000, 7, 17
_CODES = np.full(256, 1, np.int64)  # 1: anything else
for _k, _c in enumerate(string.digits + string.ascii_letters + string.punctuation + " \n"):
    _CODES[ord(_c)] = _k + 2
N_CODES = int(_CODES.max()) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: leftmost matches of each pattern that do not overlap, the too short ones dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens that could be keys and overlap no known span."""
    return [m.span() for m in CANDIDATE.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in known)]


def windows(start: int, stop: int) -> list[tuple[int, int]]:
    """The windows of a candidate: itself, or INSIDE characters each over all of it, half of them shared with the next."""
    if stop - start <= INSIDE:
        return [(start, stop)]
    return [*((a, a + INSIDE) for a in range(start, stop - INSIDE, INSIDE // 2)), (stop - INSIDE, stop)]


def encode(text: str, start: int, stop: int) -> np.ndarray:
    """Codes of a window of a candidate and of what stands around it; 0 pads."""
    out = np.zeros(WIDTH, np.int64)
    for part, at in ((text[max(0, start - BEFORE) : start], None), (text[start:stop], BEFORE), (text[stop : stop + AFTER], BEFORE + INSIDE)):
        codes = _CODES[np.frombuffer(part.encode("latin-1", "replace"), np.uint8)]
        at = BEFORE - len(codes) if at is None else at
        out[at : at + len(codes)] = codes
    return out


def labelled_findings(n: int = FINDINGS, seed: int = SEED, unseen: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """n findings, reviewed as secret (1) or not (0), drawn by kind: keys of several providers and random keys behind words
    that announce them, against identifiers, checksums of files, versions, dates, links, long words, names, numbers and rules. Of a finding
    longer than a window, one window is drawn. unseen: kinds of both that the network is never trained on, to measure it."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    low, alnum = string.ascii_lowercase, string.ascii_letters + string.digits
    word = lambda: pick(low, int(rng.integers(3, 9)))
    keys = [
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "sk_live_" + pick(alnum, 24),
        lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24),
        lambda: "eyJ" + pick(alnum + "_-", int(rng.integers(30, 80))),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: pick(alnum + "+/", int(rng.integers(24, 64))) + "=",
        lambda: pick(alnum, int(rng.integers(20, 48))),
        lambda: pick(string.ascii_letters, int(rng.integers(20, 48))),
        lambda: pick(alnum + "+/", int(rng.integers(65, 600))),
    ]
    others = [
        lambda: f"{word()}_{word()}_{rng.integers(1, 99)}_{word()}",
        lambda: f"{word()}-{word()}-{word()}-{rng.integers(1900, 2100)}",
        lambda: f"{word()}/{word()}/{word()}{rng.integers(0, 99)}/{word()}",
        lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: f"{rng.integers(2000, 2030)}-{rng.integers(10, 12)}-{rng.integers(10, 28)}T{rng.integers(10, 23)}",
        lambda: f"{word()}{word()}{word()}{word()}{rng.integers(0, 999)}",
        lambda: f"v{rng.integers(1, 30)}-{word()}-build{rng.integers(100, 99999)}-{word()}",
        lambda: "=" * int(rng.integers(8, 20)) + f"{word()}{rng.integers(1, 9)}" + "=" * 8,
        lambda: "".join(word() for _ in range(int(rng.integers(6, 12)))),
        lambda: "".join(word().capitalize() for _ in range(int(rng.integers(6, 12)))),
        lambda: "".join(word() for _ in range(int(rng.integers(3, 12)))).upper(),
        lambda: ["-", "_", "/"][int(rng.integers(3))].join(word() for _ in range(int(rng.integers(6, 40)))),
        lambda: pick(string.digits, int(rng.integers(16, 40))),
        lambda: ["-", "=", "_", "/", "+", "-="][int(rng.integers(6))] * int(rng.integers(16, 100)),
    ]
    if unseen:
        keys = [
            lambda: "glpat-" + pick(alnum + "_-", 20),
            lambda: "SG_" + pick(alnum + "_-", 22) + "-" + pick(alnum, 43),
            lambda: "npm_" + pick(alnum, 36),
            lambda: pick(alnum + "+/", 86) + "==",
            lambda: "hf_" + pick(string.ascii_letters, 34),
            lambda: "-".join(pick(string.ascii_uppercase + string.digits, 5) for _ in range(5)),
        ]
        others = [
            lambda: f"{word()}_{word()}_{word()}_{word()}",
            lambda: f"/{word()}/{word()}/{rng.integers(2000, 2030)}/{rng.integers(10, 12)}/{word()}-{word()}",
            lambda: f"{rng.integers(10, 99)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}-{rng.integers(1000, 9999)}-{rng.integers(10, 99)}",
            lambda: "_".join(word() for _ in range(int(rng.integers(4, 9)))).upper(),
            lambda: "--".join(word() for _ in range(int(rng.integers(4, 9)))),
        ]
    x, y = np.empty((n, WIDTH), np.int64), np.arange(n) % 2
    for k in range(n):
        made = (keys if y[k] else others)[int(rng.integers(len(keys if y[k] else others)))]()
        said = [" the key is ", "auth: ", "Bearer ", "export KEY=", " "][int(rng.integers(5))] if y[k] else [" see ", " file ", "id: ", " ", "order "][int(rng.integers(5))]
        text = f"{word()} {word()} {word()}{said}{made}{['', '.', chr(10), ' ' + word()][int(rng.integers(4))]}"
        start = text.index(made)
        own = windows(start, start + len(made))
        x[k] = encode(text, *own[int(rng.integers(len(own)))])
    order = rng.permutation(n)
    return x[order], y[order]


@dataclass
class CharCNN:
    """Embedded characters, one convolution with ReLU, the maximum and the mean over places, a logistic unit."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    taps: int = 5

    @classmethod
    def fresh(cls, seed: int, dims: int = 8, filters: int = 24, taps: int = 5) -> CharCNN:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (N_CODES, dims)), rng.normal(0, (2 / (taps * dims)) ** 0.5, (taps * dims, filters)), np.zeros(filters), rng.normal(0, 0.2, 2 * filters + 1), taps=taps)

    def forward(self, x: np.ndarray) -> tuple:
        e = self.embed[x] * (x > 0)[:, :, None]
        windows = np.lib.stride_tricks.sliding_window_view(e, self.taps, axis=1).transpose(0, 1, 3, 2)
        flat = windows.reshape(len(x), WIDTH - self.taps + 1, -1)
        h = np.maximum(flat @ self.kernel + self.bias, 0)
        top = h.argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1), np.ones((len(x), 1))], 1)
        return flat, h, top, pooled, pooled @ self.out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of a secret."""
        logits = np.concatenate([self.forward(x[k : k + 256])[-1] for k in range(0, len(x), 256)] or [np.empty(0)])
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -50, 50)))

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean log loss for embed, kernel, bias and out."""
        flat, h, top, pooled, logit = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y)[:, None] / len(x)
        n = h.shape[2]
        back = d * self.out[None]
        dh = np.repeat(back[:, None, n : 2 * n] / h.shape[1], h.shape[1], 1)
        np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + back[:, None, :n], 1)
        dh *= h > 0
        dflat = (dh @ self.kernel.T).reshape(len(x), h.shape[1], self.taps, -1)
        dembed = np.zeros_like(self.embed)
        for k in range(self.taps):
            np.add.at(dembed, x[:, k : k + h.shape[1]], dflat[:, :, k])
        dembed[0] = 0
        return [dembed, np.einsum("nlf,nlk->fk", flat, dh, optimize=True), dh.sum((0, 1)), (pooled * d).sum(0)]


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED, epochs: int = EPOCHS, recall: float = RECALL) -> CharCNN:
    """Adam on four fifths of the findings; calibration and threshold on the rest."""
    cut = len(x) * 4 // 5
    net, rng = CharCNN.fresh(seed), np.random.default_rng(seed)
    params = [net.embed, net.kernel, net.bias, net.out]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(cut)
        for k in range(0, cut, 64):
            t += 1
            for p, g, a, b in zip(params, net.step(x[order[k : k + 64]], y[order[k : k + 64]]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.004 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    logits, truth = net.forward(x[cut:])[-1], y[cut:]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt's scaling
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -50, 50)))
        a, b = a - 0.1 * float(((p - truth) * logits).mean()), b - 0.1 * float((p - truth).mean())
    net.scale = a, b
    true = np.sort(net.scores(x[cut:])[truth == 1])
    net.threshold = float(true[int((1 - recall) * len(true))]) if len(true) else 0.5
    return net


@functools.cache
def trained(n: int = FINDINGS, seed: int = SEED) -> CharCNN:
    return train(*labelled_findings(n, seed), seed)


def all_spans(texts: list[str], net: CharCNN) -> list[list[tuple[int, int, int]]]:
    """For each text its base spans and the network's, as (start, kind, end), sorted. A candidate counts by its best window."""
    out: list[list[tuple[int, int, int]]] = []
    found: set[tuple[int, int, int]] = set()
    where, inputs = [], []

    def score() -> None:
        if inputs:
            found.update(one for one, x in zip(where, net.scores(np.stack(inputs)), strict=True) if x >= net.threshold)
            where.clear()
            inputs.clear()

    for k, text in enumerate(texts):
        out.append(base_spans(text))
        for a, b in candidates(text, out[-1]):
            for window in windows(a, b):
                where.append((k, a, b))
                inputs.append(encode(text, *window))
                if len(inputs) == HELD:
                    score()
    score()
    for k, a, b in found:
        out[k].append((a, 3, b))
    return [sorted(x) for x in out]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def mask(text: str, spans: list[tuple[int, int, int]], by: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced."""
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], by]
            at = b
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, net: CharCNN | None = None, keep: tuple = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, masked for every row of docs (doc_id, text), and the columns in
    keep. masked is the text without its secrets, null where there are none.

    A null text is empty: no spans. Rows are independent: repeats give repeats, an empty table an empty result.
    """
    net = net or trained()
    own = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"))
    names = own.columns
    at = names.index("text") if "text" in names else len(names)  # a kept text is not sent twice

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            found = all_spans(texts, net)
            rows = []
            for text, spans in zip(texts, found, strict=True):
                base = [x for x in spans if x[1] < 3]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*(sum(x[1] == k for x in base) for k in range(3)), digest, joined(spans), mask(text, spans) if spans else None))
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], [*names, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "masked"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    given = own if "text" in names else docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    return in_arrow(given, scan, schema + ", n_assign long, n_access long, n_hex long, base_sha256 string, spans string, masked string")
