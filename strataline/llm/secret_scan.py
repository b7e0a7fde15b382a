"""Secret scanning: fixed patterns plus a character convolutional network over candidates in context.

Base spans come from three patterns (leftmost, not overlapping, per kind).  Candidates are all maximal runs of key
characters of MIN_RUN or more, whatever they are made of, or what base spans leave uncovered of them (without joining
marks at the cut); a small convolutional network in numpy reads every whole candidate (in overlapping windows, the highest
score counts) with CONTEXT characters on both sides.  It is trained here, on labelled findings drawn by a seeded generator
of key formats (with and without digits) and look-alikes; a logistic recalibration is fitted on a second part, and the
threshold is the highest that keeps MIN_RECALL of the secrets of that part, found as scan() finds them: in texts, by runs.
Candidates over the threshold are added as kind `model`; base spans always stay.

Texts are scanned whole, in Arrow batches without any shuffle; the network is a fixed 40 KB sent with the task.

Defined results: null text counts as empty; texts without spans give an empty array; spans count code points, end
exclusive, sorted by start, then kind in the order assign, access, hex, model; an uncovered run of any length is one candidate;
repeated rows give repeated results; an empty table gives an empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

import math
import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_append

KINDS = ("assign", "access", "hex", "model")
MIN_RUN, CONTEXT, WIDTH, MIN_RECALL, SEED = 16, 20, 40, 0.98, 20240
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)
_MARKS = "+/_.=-"
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start, then kind.  An access or hex match lies within a run of key characters."""
    runs = [m.span() for m in _RUN.finditer(text)] if runs is None else runs
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for lo, hi in runs:
        if hi - lo >= 20:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, lo, hi) if m.end() - m.start() >= 20]
            found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, lo, hi)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


# --- the network -----------------------------------------------------------------------------------------------------

_CODES = np.full(0x110000, 1, np.uint8)  # 0 outside the text, 1 any other character
for _i, _c in enumerate(string.ascii_letters + string.digits + "+/_.=-:\"' \n<>()[]{},;@#?&%$!*|\\"):
    _CODES[ord(_c)] = _i + 2
VOCAB, DIM, TAPS, FILTERS, LENGTH = 100, 8, 5, 24, 2 * CONTEXT + WIDTH


def windows(text: str, lo: int, hi: int) -> list[np.ndarray]:
    """Character codes (and whether they belong to the candidate) of the windows that cover text[lo:hi]."""
    out = []
    for at in [*range(lo, max(lo + 1, hi - WIDTH + 1), WIDTH // 2), *([hi - WIDTH] if hi - lo > WIDTH else [])]:
        part = text[max(0, at - CONTEXT): at + WIDTH + CONTEXT]
        codes = np.zeros((2, LENGTH), np.uint8)
        shift = max(0, CONTEXT - at)
        codes[0, shift: shift + len(part)] = _CODES[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes[1, CONTEXT: CONTEXT + min(WIDTH, hi - at)] = 1
        out.append(codes)
    return out


class Network:
    """Embedding, one convolution, pooling (largest over candidate and over context, mean over candidate), two layers."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.w = {
            "emb": f(VOCAB, DIM, scale=0.5), "conv": f(TAPS * (DIM + 1), FILTERS, scale=0.2), "cb": np.zeros(FILTERS, np.float32),
            "h": f(3 * FILTERS, 16, scale=0.15), "hb": np.zeros(16, np.float32), "o": f(16, 1, scale=0.3), "ob": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, n, steps = self.w, len(x), LENGTH - TAPS + 1
        inside = x[:, 1].astype(np.float32)
        full = np.concatenate((w["emb"][x[:, 0]], inside[:, :, None]), axis=2)
        cols = np.concatenate([full[:, t: t + steps] for t in range(TAPS)], axis=2)
        act = np.maximum(cols @ w["conv"] + w["cb"], 0)
        mid = inside[:, TAPS // 2: TAPS // 2 + steps, None]
        masked, outer = act * mid, act * (1 - mid)
        top, side = masked.argmax(1), outer.argmax(1)
        size = np.maximum(mid.sum(1), 1)
        feat = np.concatenate((masked.max(1), outer.max(1), masked.sum(1) / size), axis=1)
        hid = np.maximum(feat @ w["h"] + w["hb"], 0)
        return (hid @ w["o"] + w["ob"])[:, 0], (x, cols, act, mid, top, side, size, feat, hid, n, steps)

    def gradients(self, err: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        x, cols, act, mid, top, side, size, feat, hid, n, steps = kept
        w, g = self.w, {}
        e = err[:, None].astype(np.float32)
        g["o"], g["ob"] = hid.T @ e, e.sum(0)
        dh = (e @ w["o"].T) * (hid > 0)
        g["h"], g["hb"] = feat.T @ dh, dh.sum(0)
        df = dh @ w["h"].T
        da = (df[:, None, 2 * FILTERS:] / size[:, None]) * mid
        i, j = np.arange(n)[:, None], np.arange(FILTERS)[None]
        np.add.at(da, (i, top, j), df[:, :FILTERS])
        np.add.at(da, (i, side, j), df[:, FILTERS: 2 * FILTERS])
        da *= act > 0
        g["conv"], g["cb"] = np.einsum("nsc,nsf->cf", cols, da, optimize=True), da.sum((0, 1))
        dc = (da @ w["conv"].T).reshape(n, steps, TAPS, DIM + 1)[..., :DIM]
        ge = np.zeros_like(w["emb"])
        for t in range(TAPS):
            np.add.at(ge, x[:, 0, t: t + steps].ravel(), dc[:, :, t].reshape(-1, DIM))
        g["emb"] = ge
        return g

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        z = np.concatenate([self.forward(x[i: i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def labelled(n: int, seed: int) -> list[tuple[str, int, int, bool]]:
    """n labelled findings (text, start, end, is a secret), half of each, from a seeded generator."""
    r = random.Random(seed)
    pick = lambda chars, a, b=None: "".join(r.choice(chars) for _ in range(r.randint(a, b or a)))
    letters, digits = string.ascii_lowercase, string.digits
    mixed, b64, caps = string.ascii_letters + digits, string.ascii_letters + digits + "+/", string.ascii_uppercase + digits
    syllables = "an er th in on re ti es or te en at ed nd to it is ou ea hi ng st le che ra mo la ver sch tion que ment eau".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(r.randint(0, k)))
    yes = [
        lambda: pick(mixed, 24, 64), lambda: pick(b64, 30, 70) + r.choice(["", "=", "=="]), lambda: "ghp_" + pick(mixed, 36),
        lambda: "sk_live_" + pick(mixed, 24, 40), lambda: "sk-" + pick(mixed, 40, 48), lambda: "xoxb-" + pick(digits, 11) + "-" + pick(mixed, 24),
        lambda: "AIza" + pick(mixed + "_-", 35), lambda: "eyJ" + pick(mixed, 20, 40) + "." + pick(mixed + "_-", 30, 60) + "." + pick(mixed + "_-", 20, 43),
        lambda: "glpat-" + pick(mixed + "_-", 20), lambda: pick(caps, 20, 32), lambda: pick(letters + digits, 20, 40), lambda: pick("0123456789ABCDEF", 32, 64),
        lambda: pick(string.ascii_letters, 24, 48), lambda: pick(string.ascii_letters, 28, 44), lambda: pick(letters, 24, 40), lambda: pick(string.ascii_uppercase, 24, 40),
        lambda: "AKIA" + pick(caps, 16), lambda: pick("0123456789abcdef", 24, 40), lambda: "npm_" + pick(mixed, 36), lambda: "SG." + pick(mixed, 22) + "." + pick(mixed, 43),
    ]
    hexa = "0123456789abcdef"
    no = [
        lambda: "-".join([word() for _ in range(r.randint(3, 7))] + [pick(digits, 1, 5)]), lambda: "/".join([word() for _ in range(r.randint(3, 6))] + [pick(digits, 1, 4)]),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}-{r.randint(0, 59):02d}-{r.randint(0, 59):02d}Z",
        lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: word() * 2 + word().capitalize() + word().capitalize() + pick(digits, 1, 3) + word() * 2,
        lambda: "_".join(word() for _ in range(4)) + "_v" + pick(digits, 1, 2), lambda: "x" + pick(digits, 16, 30), lambda: pick(digits, 4) + "-" + pick(digits, 4) + "-" + pick(digits, 4) + "-" + pick(letters, 4),
        lambda: word() + "." + word() + "." + word() * 2 + "." + pick(digits, 1, 3) + ".html", lambda: "www." + word() * 3 + r.choice([".com/", ".org/", ".net/"]) + word() + pick(digits, 1, 4),
        lambda: r.choice(["=", "-", "_", "."]) * r.randint(14, 30) + word() + pick(digits, 1), lambda: word() * 4 + pick(digits, 1, 2), lambda: "ISBN-" + pick(digits, 3) + "-" + pick(digits, 10) + word(),
        lambda: (word() * 5).upper() + pick(digits, 1, 2), lambda: word() * 3 + "." + word() * 2 + pick(digits, 1, 4), lambda: "/usr/lib/" + word() * 2 + "/" + word() + pick(digits, 1) + ".so." + pick(digits, 1, 2),
    ]
    no += [
        lambda: "".join(word() for _ in range(r.randint(5, 9))), lambda: "-".join(word() for _ in range(r.randint(4, 9))), lambda: "/".join(word() for _ in range(r.randint(4, 8))),
        lambda: "".join(word().capitalize() for _ in range(r.randint(3, 7))), lambda: "_".join(word() for _ in range(r.randint(4, 7))), lambda: (word() * 6).upper(), lambda: pick(digits, 16, 30),
        lambda: r.choice("=-_.+/") * r.randint(16, 70), lambda: r.choice(["=-", "-.", "_-", "+-"]) * r.randint(8, 30), lambda: word() + "." * r.randint(14, 40) + pick(digits, 1, 3),
        lambda: word() * 2 + "." * r.randint(2, 4) + word() * 3 + "." + word(), lambda: "/" + word() + "/" + word() * 2 + "/" + word() + "." + word()[:3],
    ]
    lead = ["key: ", "auth=", "Bearer ", 'credential = "', "export KEY=", '"access": "', "use ", "", "", "pw ", "private key ", "sign: "]
    plain = ["see ", "at ", "file ", "", "", "", "version ", "id ", "http://", "from ", '"name": "', "# "]
    out = []
    for i in range(n):
        secret = i % 2 == 0
        value = r.choice(yes if secret else no)()
        if len(value) < MIN_RUN:
            value += pick(letters, MIN_RUN) if not secret else pick(mixed, MIN_RUN)
        front = prose(6) + " " + (r.choice(lead) if secret and r.random() < 0.6 else r.choice(plain))
        out.append((front + value + r.choice([" ", '" ', ". ", "\n", ", ", ""]) + prose(6), len(front), len(front) + len(value), secret))
    return out


@lru_cache(maxsize=1)
def trained(seed: int = SEED, n_train: int = 7000, n_calibrate: int = 3000, epochs: int = 6) -> Network:
    """The network with its calibration and threshold; the same on every run."""
    net, r = Network(seed), np.random.default_rng(seed)
    rows = labelled(n_train, seed + 1)
    x, y = np.array([windows(t, a, b)[0] for t, a, b, _ in rows]), np.array([s for *_, s in rows], np.float32)
    m1, m2, step = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}, 0
    for epoch in range(epochs):
        order = r.permutation(len(x))
        for lo in range(0, len(x), 64):
            b, step = order[lo: lo + 64], step + 1
            z, kept = net.forward(x[b])
            g = net.gradients((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) / len(b), kept)
            for k, v in g.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                net.w[k] -= (0.004 * (0.5 ** (epoch // 2)) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    # second part: each finding is scored by the candidates that scan() sees in its text, as far as they touch it
    held = [(t, parts, s) for t, a, b, s in labelled(n_calibrate, seed + 2) if (parts := [p for p in candidates(t, base_spans(t)) if p[0] < b and a < p[1]])]
    z = np.array([max(max(net.forward(np.array(windows(t, *p)))[0]) for p in parts) for t, parts, _ in held])
    good = np.array([s for *_, s in held], np.float64)
    scale, shift = 1.0, 0.0
    for _ in range(50):  # logistic recalibration by Newton's method
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
        u, d = p - good, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(d * z * z).sum() + 1.0, (d * z).sum()], [(d * z).sum(), d.sum()]])
        change = np.linalg.solve(h, [(u * z).sum() + (scale - 1), u.sum()])
        scale, shift = scale - change[0], shift - change[1]
        if np.abs(change).max() < 1e-9:
            break
    net.scale, net.shift = float(scale), float(shift)
    p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
    ranked = np.sort(p[good > 0])
    net.threshold = float(ranked[math.floor((1 - MIN_RECALL) * len(ranked))])
    return net


def uncovered(text: str, lo: int, hi: int, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The parts of a run outside all base spans, without marks where a span was cut off, of MIN_RUN or more."""
    parts, at = [], lo
    for s, e in [*((s, e) for _, s, e in base if s < hi and lo < e), (hi, hi)]:  # by start
        a, b = at, max(at, s)
        while a < b and at > lo and text[a] in _MARKS:
            a += 1
        while a < b and b < hi and text[b - 1] in _MARKS:
            b -= 1
        if b - a >= MIN_RUN:
            parts.append((a, b))
        at = max(at, e)
    return parts


def candidates(text: str, base: list[tuple[str, int, int]], runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """All that the network reads: every run of key characters, or its parts outside base spans."""
    runs = [m.span() for m in _RUN.finditer(text)] if runs is None else runs
    return [part for run in runs for part in uncovered(text, *run, base)]


def scan(texts: list[str | None], net: Network) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, score) of every span of each text."""
    out, inputs, owners = [], [], []
    for row, text in enumerate(texts):
        text = text or ""
        runs = [m.span() for m in _RUN.finditer(text)]
        base = base_spans(text, runs)
        out.append([(k, s, e, 1.0) for k, s, e in base])
        for lo, hi in candidates(text, base, runs):
            w = windows(text, lo, hi)
            inputs += w
            owners += [(row, lo, hi)] * len(w)
    if inputs:
        best: dict[tuple[int, int, int], float] = {}
        for owner, p in zip(owners, net.score(np.array(inputs)).tolist()):
            best[owner] = max(p, best.get(owner, 0.0))
        for (row, lo, hi), p in best.items():
            if p >= net.threshold:
                out[row].append(("model", lo, hi, p))
    for spans in out:
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def find_secrets(docs: DataFrame, text_col: str = "text", net: Network | None = None) -> DataFrame:
    """docs with `spans`: array of (kind, start, end, score)."""
    net = net or trained()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def fn(batch):
        rows = scan(batch.column(text_col).to_pylist(), net)
        return [pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in row] for row in rows], pa.list_(kind))]

    return arrow_append(docs, [T.StructField("spans", T.ArrayType(SPAN, True))], text_col, fn)
