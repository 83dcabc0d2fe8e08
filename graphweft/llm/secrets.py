"""Secret scans: patterns, and a character convolutional network over every candidate in its context.

Plain findings come from fixed patterns. Every other long, mixed token is a candidate; the network reads its characters
with those before and behind it and scores it. The network (embedding, two convolution widths, max and mean pooling,
one hidden layer) is written in numpy and trained with Adam on labelled findings: (text, start, end, label). Without a
labelled table a generator of TRAIN_ROWS findings with a fixed seed stands in (keys of usual shapes in usual places
against words, paths, dates, identifiers, numbers and links). Scores are calibrated by Platt's scaling on held-out
findings, and the threshold is the highest that still recalls RECALL of the held-out secrets.

Training runs on the driver over that bounded set; a model of a few kilobytes goes to the tasks.

Edge cases: a null text is empty and has no findings; offsets count code points; candidates of any length are scored
whole, in windows of WIDTH characters with the highest score kept; rows are independent, so repeated rows and null ids
pass through; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .spans import Span, digest, joined, scan_texts

KINDS = ("assign", "access", "hex", "learned")
#: Documented bounds of the training set and the model.
TRAIN_ROWS, WIDTH, CONTEXT, RECALL, SEED = 6000, 48, 16, 0.97, 11
MIN_CANDIDATE = 12

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_CANDIDATE},}}")
_LETTER, _NUMERAL = re.compile("[A-Za-z]"), re.compile("[0-9]")


def _ascii_lower(text: str) -> str:
    if text.isascii():
        return text.lower()
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def patterns(text: str) -> list[Span]:
    """Plain findings, leftmost and non-overlapping within each kind."""
    out, low, starts = [], _ascii_lower(text), []
    for word in _KEYWORDS:
        at = low.find(word)
        while at >= 0:
            starts.append(at)
            at = low.find(word, at + 1)
    done = 0
    for at in sorted(starts):
        m = _ASSIGN.match(text, at) if at >= done else None
        if m:
            done = m.end()
            if m.end(2) - m.start(2) >= 6:
                out.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def candidates(text: str, plain: list[Span] = ()) -> list[tuple[int, int]]:
    """Tokens, and what plain findings leave of them, of at least MIN_CANDIDATE characters with a digit and a letter, or of twice as many letters
    in both cases. One sweep over tokens and findings."""
    out, found, k = [], sorted((a, b) for _, a, b in plain), 0
    for m in _CANDIDATE.finditer(text):
        at, end, pieces = m.start(), m.end(), []
        while k < len(found) and found[k][0] < end:
            a, b = found[k]
            if a > at:
                pieces.append((at, a))
            at = max(at, b)
            if b > end:
                break  # it may reach into the next token
            k += 1
        if at < end:
            pieces.append((at, end))
        for a, b in pieces:
            if b - a >= MIN_CANDIDATE:
                w = text[a:b]
                letters = _LETTER.search(w)
                if letters and (_NUMERAL.search(w) or (b - a >= 2 * MIN_CANDIDATE and not w.islower() and not w.isupper() and not w.istitle() and w.isalpha())):
                    out.append((a, b))
    return out


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """Rows of CONTEXT + WIDTH + CONTEXT codes: windows that cover the whole candidate. 0 pads, 1 is any other character."""
    codes = np.frombuffer(text[max(0, start - CONTEXT):end + CONTEXT].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where((codes >= 32) & (codes < 127), codes - 30, np.minimum(codes, 1))
    lead, size = min(start, CONTEXT), end - start
    before, mid, after = codes[:lead], codes[lead:lead + size], codes[lead + size:]
    starts = np.arange(0, max(size - WIDTH // 2, 1), WIDTH // 2)
    out = np.zeros((len(starts), 2 * CONTEXT + WIDTH), np.int64)
    out[:, CONTEXT - lead:CONTEXT] = before
    padded = np.append(mid, np.zeros(WIDTH, np.int64))
    out[:, CONTEXT:CONTEXT + WIDTH] = padded[starts[:, None] + np.arange(WIDTH)]
    out[:, CONTEXT + WIDTH:CONTEXT + WIDTH + len(after)] = after
    return out


class CharNet:
    """Embedding, convolutions of widths 3 and 5, max and mean pooling, one hidden layer, logistic output."""

    EMBED, FILTERS, HIDDEN, WIDTHS = 8, 12, 16, (3, 5)

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.3, (97, self.EMBED))}
        for w in self.WIDTHS:
            self.p[f"k{w}"] = r.normal(0, 1 / np.sqrt(w * self.EMBED), (w * self.EMBED, self.FILTERS))
            self.p[f"b{w}"] = np.zeros(self.FILTERS)
        n = 2 * self.FILTERS * len(self.WIDTHS)
        self.p |= {"h": r.normal(0, 1 / np.sqrt(n), (n, self.HIDDEN)), "hb": np.zeros(self.HIDDEN), "o": r.normal(0, 0.3, self.HIDDEN), "ob": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        e = self.p["e"][x]
        keep, pooled = {"x": x, "e": e}, []
        for w in self.WIDTHS:
            win = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - w + 1, -1)
            a = np.maximum(win @ self.p[f"k{w}"] + self.p[f"b{w}"], 0)
            keep[w] = (win, a)
            pooled += [a.max(1), a.mean(1)]
        f = np.concatenate(pooled, 1)
        h = np.maximum(f @ self.p["h"] + self.p["hb"], 0)
        keep |= {"f": f, "hid": h}
        return h @ self.p["o"] + self.p["ob"][0], keep

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def _gradients(self, z: np.ndarray, y: np.ndarray, s: dict) -> dict:
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = {"o": s["hid"].T @ d, "ob": np.array([d.sum()])}
        dh = np.outer(d, self.p["o"]) * (s["hid"] > 0)
        g |= {"h": s["f"].T @ dh, "hb": dh.sum(0)}
        df, at, de = dh @ self.p["h"].T, 0, np.zeros_like(s["e"])
        for w in self.WIDTHS:
            win, a = s[w]
            dmax, dmean = df[:, at:at + self.FILTERS], df[:, at + self.FILTERS:at + 2 * self.FILTERS]
            at += 2 * self.FILTERS
            da = np.repeat(dmean[:, None, :] / a.shape[1], a.shape[1], 1)
            rows, cols = np.indices(dmax.shape)
            da[rows, a.argmax(1), cols] += dmax
            da *= a > 0
            g[f"k{w}"], g[f"b{w}"] = np.einsum("nti,ntf->if", win, da), da.sum((0, 1))
            dw = (da @ self.p[f"k{w}"].T).reshape(len(z), a.shape[1], w, self.EMBED)
            for j in range(w):
                de[:, j:j + a.shape[1]] += dw[:, :, j]
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], s["x"], de)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = SEED) -> CharNet:
        r, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // 64)):
                t += 1
                z, s = self._forward(x[rows])
                for k, g in self._gradients(z, y[rows], s).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> CharNet:
        """Platt's scaling with his smoothed targets, then the highest threshold with the wanted recall."""
        z, a, b = self.logits(x), 1.0, 0.0
        ones = y.sum()
        soft = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = p * (1 - p) + 1e-9
            hess = np.array([[w @ (z * z) + 1e-3, w @ z], [w @ z, w.sum() + 1e-3]])
            step = np.linalg.solve(hess, np.array([(p - soft) @ z + 1e-3 * (a - 1), (p - soft).sum()]))
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.scale, self.shift = a, b
        hits = np.sort(self.scores(x)[y == 1])
        self.threshold = float(hits[int(np.floor((1 - recall) * len(hits)))]) if len(hits) else 0.5
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(x) + self.shift)))


def labelled_findings(n: int = TRAIN_ROWS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """Generated findings with labels: secrets of usual shapes (1), and long tokens that are none (0)."""
    r = np.random.default_rng(seed)
    # Alphabets and word parts to draw from.
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(r.choice(list(chars), k))
    syl = lambda k: "".join(r.choice(["ta", "re", "on", "en", "sch", "ler", "mi", "do", "ing", "tion", "ver", "al", "qu", "es"], k))
    out = []
    for i in range(n):
        label = i % 2
        if label:
            size = int(r.integers(14, 60))
            shape = [low + up + num, low + up + num + "+/", low + num, num + "abcdef", up + num, low + up + num + "_-"][int(r.integers(6))]
            word = [pick(shape, size), ["sk_", "pk_", "ghp_", "xox-"][int(r.integers(4))] + pick(low + up + num, size), "eyJ" + pick(low + up + num, size)][int(r.integers(3))]
        else:
            word = [
                lambda: "-".join(syl(2) for _ in range(4)) + pick(num, 2), lambda: "/".join(syl(2) for _ in range(4)) + "/" + pick(num, 3) + ".html",
                lambda: f"20{pick(num, 2)}-{pick('01', 2)}-{pick('012', 2)}_{syl(3)}", lambda: "_".join(syl(2) for _ in range(3)) + "_v" + pick(num, 1),
                lambda: syl(3).title() + syl(2).title() + syl(3).title() + pick(num, 1), lambda: "www." + syl(4) + ".example.org/" + pick(num, 2),
                lambda: syl(9) + pick(num, 2), lambda: "mail" + pick(num, 1) + "." + syl(2) + [".com", ".example.net"][int(r.integers(2))], lambda: ".".join([syl(2), syl(3), "v" + pick(num, 1), syl(2), pick(num, 2)]),
                lambda: "-".join(pick(num + "abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: f"20{pick(num, 2)}-0{pick('123456789', 1)}-1{pick(num, 1)}T1{pick(num, 1)}:0".replace(":", "") + pick(num, 2) + "Z",
                lambda: "".join(syl(2).title() for _ in range(5)), lambda: syl(2) + "-" + ".".join(pick(num, 1) for _ in range(3)) + "-" + syl(2) + ".tar.gz",
            ][int(r.integers(13))]().ljust(MIN_CANDIDATE, "e")
        before = [syl(3) + " ", "key: ", "auth=", '"', "(", "id ", "see ", "use "][int(r.integers(8))]
        text = syl(4) + " " + before + word + [" ", '"', ", ", ") ", "\n"][int(r.integers(5))] + syl(3)
        start = text.index(word)
        out.append((text, start, start + len(word), label))
    return out


def trained(findings: list[tuple[str, int, int, int]] | None = None) -> CharNet:
    """A net fitted on three quarters of the findings, and calibrated on the last quarter."""
    findings = labelled_findings() if findings is None else findings
    x = np.concatenate([encoded(t, a, b)[:1] for t, a, b, _ in findings])
    y = np.array([f[3] for f in findings], float)
    cut = len(x) * 3 // 4
    return CharNet().fit(x[:cut], y[:cut]).calibrate(x[cut:], y[cut:])


@functools.cache
def default_net() -> CharNet:
    return trained()


def learned(text: str, net: CharNet, plain: list[Span]) -> list[Span]:
    """Candidates outside plain findings whose calibrated score reaches the threshold."""
    spans = candidates(text, plain)
    if not spans:
        return []
    windows = [encoded(text, a, b) for a, b in spans]
    scores = net.scores(np.concatenate(windows))
    ends = np.cumsum([len(w) for w in windows])
    return [("learned", a, b) for (a, b), n, e in zip(spans, map(len, windows), ends, strict=True) if scores[e - n:e].max() >= net.threshold]


COLUMNS = [("n_assign", pa.int64(), "bigint"), ("n_access", pa.int64(), "bigint"), ("n_hex", pa.int64(), "bigint"),
           ("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string"), ("n_learned", pa.int64(), "bigint")]


def find(docs: DataFrame, net: CharNet | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of plain findings by kind, their digest, all findings, and the number of learned ones, per document."""
    net = net or default_net()

    def setup():
        def row(text: str) -> tuple:
            plain = patterns(text)
            added = learned(text, net, plain)
            kinds = [k for k, _, _ in plain]
            return (*[kinds.count(k) for k in KINDS[:3]], digest(plain, KINDS), joined(plain + added, KINDS), len(added))
        return row
    return scan_texts(docs, id_col, text_col, setup, COLUMNS)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
