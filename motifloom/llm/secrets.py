"""Secret scan: fixed patterns, and a character convolutional network over every candidate and its context.

The patterns find what certainly looks like a secret. The network reads every candidate together with the characters
around it: each pattern match, long tokens that mix letters with digits or small with capital letters (also those that
reach beyond a pattern match), what follows a credential word, passwords in urls, and the body of private keys. Of those
that no pattern has found it adds what it holds for secrets; of pattern matches it tells which it doubts. It is trained
here, in numpy, on generated labelled findings; its scores are calibrated on findings it has not been fitted to, and its
threshold is the highest one that still reaches a given recall on them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
OTHER = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SWITCH = re.compile(r"[a-z][A-Z]")
VALUE = re.compile(
    r"""\b(?:pwd|pass(?:word|wd|phrase|code)?|secret|token|key|auth|bearer|credentials?|login)["']?(\x20*[:=]\x20*|\x20is\x20|\x20)["']?([^\s"'<>,;]{6,}+)""",
    re.IGNORECASE | re.ASCII,
)
URL_LOGIN = re.compile(r"://[^\s/:@]++:([^\s/@]{3,}+)@")
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----\s*((?:[A-Za-z0-9+/=]{16,}\s+)*[A-Za-z0-9+/=]{4,})")
WINDOWS = 2048  # read at once
MARGIN, INNER = 24, 64  # characters of context on each side, and of the candidate, in a window
SPANS = "id bigint, spans array<struct<kind:string,start:int,stop:int,score:double,sure:boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("sure", pa.bool_())])
_SPANS = pa.schema([("id", pa.int64()), ("spans", pa.list_(_SPAN))])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the pattern matches, per kind leftmost and not overlapping, too short ones dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def other_candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Candidates that do not lie inside a pattern match, leftmost and longest first, not overlapping each other."""
    found = []
    for m in OTHER.finditer(text):
        token = m[0]
        if any(map(str.isdigit, token)) and not token.isdigit() or len(SWITCH.findall(token)) > 2:
            found.append((m.start(), m.end()))
    for m in VALUE.finditer(text):
        if m[1].strip() in (":", "=") or not m[2].rstrip(".!?)").isalpha():
            found.append(m.span(2))
    found += [m.span(1) for pattern in (URL_LOGIN, PRIVATE_KEY) for m in pattern.finditer(text)]
    out, done, at, reach = [], 0, 0, 0
    taken = sorted(taken)
    for start, stop in sorted(found, key=lambda x: (x[0], -x[1])):
        while at < len(taken) and taken[at][0] <= start:
            reach, at = max(reach, taken[at][1]), at + 1
        if stop > reach and start >= done:
            out.append((start, stop))
            done = stop
    return out


def windows(text: str, start: int, stop: int) -> list[tuple[str, int]]:
    """(characters, first inner place) of each window over a candidate; long candidates get several."""
    step = INNER * 3 // 4
    return [(text[max(0, a - MARGIN) : min(a + INNER, stop) + MARGIN], min(a, MARGIN), min(INNER, stop - a)) for a in range(start, max(start + 1, stop - INNER + step), step)]


def encode(rows: list[tuple[str, int, int]]) -> np.ndarray:
    """Windows as symbol numbers and inside marks: int64 [n, length, 2]."""
    out = np.zeros((len(rows), MARGIN * 2 + INNER, 2), dtype=np.int64)
    for i, (chars, lead, inner) in enumerate(rows):
        codes = np.frombuffer(chars.encode("utf-32-le"), dtype="<u4")
        at = MARGIN - lead
        out[i, at : at + len(codes), 0] = np.where(codes < 128, codes, 128) + 1
        out[i, MARGIN : MARGIN + inner, 1] = 1
    return out


@dataclass
class CharCNN:
    """Embedding, one convolution, max over places, one hidden layer."""

    emb: np.ndarray
    conv: np.ndarray
    conv_b: np.ndarray
    hid: np.ndarray
    hid_b: np.ndarray
    out: np.ndarray
    out_b: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    WIDTH = 5

    @classmethod
    def fresh(cls, rng, dims: int = 8, filters: int = 24, hidden: int = 16) -> CharCNN:
        draw = lambda *shape: rng.normal(0, (2 / shape[0]) ** 0.5, shape)
        return cls(rng.normal(0, 0.5, (130, dims)), draw(cls.WIDTH * (dims + 1), filters), np.zeros(filters), draw(filters, hidden), np.zeros(hidden), draw(hidden, 1), np.zeros(1))

    def weights(self) -> list[np.ndarray]:
        return [self.emb, self.conv, self.conv_b, self.hid, self.hid_b, self.out, self.out_b]

    def forward(self, x: np.ndarray):
        data = np.concatenate([self.emb[x[..., 0]], x[..., 1:]], axis=2)
        n, length, e = data.shape
        view = np.lib.stride_tricks.sliding_window_view(data, self.WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - self.WIDTH + 1, self.WIDTH * e)
        maps = view @ self.conv + self.conv_b
        at = maps.argmax(axis=1)
        top = np.take_along_axis(maps, at[:, None], axis=1)[:, 0]
        pooled = np.maximum(top, 0)
        hidden = np.maximum(pooled @ self.hid + self.hid_b, 0)
        return view, at, top, pooled, hidden, (hidden @ self.out + self.out_b)[:, 0]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        view, at, top, pooled, hidden, logit = self.forward(x)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y))[:, None]
        d_hid = (d @ self.out.T) * (hidden > 0)
        d_top = (d_hid @ self.hid.T) * (top > 0)
        picked = view[np.arange(len(x))[:, None], at]  # [n, filters, width * e]: only the largest place learns
        d_conv = np.einsum("nf,nfw->wf", d_top, picked)
        d_view = (d_top[:, :, None] * self.conv.T[None]).reshape(len(x), -1, self.WIDTH, self.emb.shape[1] + 1)[..., :-1]
        symbols = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(self.WIDTH), 0]
        d_emb = np.zeros_like(self.emb)
        np.add.at(d_emb, symbols, d_view)
        return [d_emb, d_conv, d_top.sum(0), pooled.T @ d_hid, d_hid.sum(0), hidden.T @ d, d.sum(0)]


def _words(rng, n: int) -> str:
    parts = ("an", "de", "er", "in", "la", "mo", "ne", "or", "re", "sta", "the", "ti", "un", "ve")
    return " ".join("".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(n))


def training_findings(n: int = 4500, seed: int = 11) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Generated labelled findings: (text, start, stop) and 1 for a secret, 0 for a harmless look-alike."""
    rng = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, k: "".join(rng.choice(list(chars), k))
    hexed = lambda k: draw("0123456789abcdef", k)
    secret = (
        lambda: ("", "AKIA" + draw(upper + digits, 16), ""),
        lambda: (f"{rng.choice(['password', 'passwd', 'secret', 'Token', 'api_key'])}{rng.choice(['=', ': ', ' = '])}", hexed(int(rng.integers(12, 41))), ""),
        lambda: ("token = " + '"', hexed(40), '"'),
        lambda: (f"{rng.choice(['key', 'auth', 'credential', 'Authorization: Bearer', ''])} ", draw(lower + upper + digits, int(rng.integers(24, 48))), ""),
        lambda: ("secret_access_key ", draw(lower + upper + digits + "+/", 40), ""),
        lambda: ("", f"{draw(lower, 3)}_{draw(lower + upper + digits, 36)}", ""),
        lambda: ("", f"eyJ{draw(lower + upper + digits, 20)}", f".eyJ{draw(lower + upper + digits, 30)}"),
        lambda: (f"{rng.choice(['pwd', 'passphrase', 'password', 'login', 'auth key'])}{rng.choice([': ', '=', ' is '])}", draw(lower + upper + digits + "!#$%&*+?", int(rng.integers(8, 18))), ""),
        lambda: (f"{rng.choice(['postgres', 'https', 'ftp'])}://{draw(lower, 5)}:", draw(lower + upper + digits + "!#$%", int(rng.integers(8, 16))), f"@{draw(lower, 6)}.org/"),
        lambda: (f"{rng.choice(['key', 'token', 'value', ''])} ", draw(lower + upper, int(rng.integers(24, 44))), ""),
        lambda: ("-----BEGIN RSA PRIVATE KEY-----\n", draw(lower + upper + digits + "+/", 64), "\n"),
    )
    harmless = (
        lambda: (rng.choice(["commit ", "sha1 ", "checksum ", "digest: ", "ETag "]), hexed(40), ""),
        lambda: ("id ", f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}", ""),
        lambda: ("", "_".join(_words(rng, 3).split()) + f"_{rng.integers(1, 2030)}", ""),
        lambda: ("https://example.org/", "/".join(_words(rng, 3).split()) + f"/{rng.integers(1, 99999)}", ""),
        lambda: ("call ", "-".join(draw(digits, 4) for _ in range(4)), ""),
        lambda: ("", f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}-{'-'.join(_words(rng, 2).split())}", ""),
        lambda: ("data:image/png;base64,", draw(lower + upper + digits + "+/", int(rng.integers(30, 64))), "=="),
        lambda: ("", "".join(w.title() for w in _words(rng, 4).split()) + str(rng.integers(1, 99)), ""),
        lambda: ("", _words(rng, 3).replace(" ", "-") + f"-v{rng.integers(1, 9)}", ""),
        lambda: ("IBAN ", draw(upper, 2) + draw(digits, 18), ""),
        lambda: ("", _words(rng, 1) + "".join(w.title() for w in _words(rng, 4).split()), ""),
        lambda: (f"{rng.choice(['key', 'token', 'secret', 'login', 'password'])}{rng.choice([' ', ' ', ': '])}", _words(rng, 2).replace(" ", rng.choice(["", "-"])), rng.choice(["", ".", ","])),
        lambda: ("", "=" * int(rng.integers(8, 20)) + draw(digits, 4) + "=" * 8, ""),
    )
    rows, labels = [], []
    for i in range(n):
        label = i % 2
        kinds = secret if label else harmless
        before, core, after = kinds[int(rng.integers(len(kinds)))]()
        lead = _words(rng, int(rng.integers(0, 6))) + " " + str(before)
        rows.append((lead + core + after + " " + _words(rng, int(rng.integers(0, 6))), len(lead), len(lead) + len(core)))
        labels.append(label)
    return rows, np.array(labels, dtype=float)


@lru_cache(maxsize=2)
def trained_network(recall: float = 0.97, seed: int = 11, epochs: int = 8) -> CharCNN:
    """Fit on four fifths of the findings (Adam); calibrate and set the threshold on the last fifth."""
    rows, y = training_findings(seed=seed)
    x = encode([windows(*row)[0] for row in rows])
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 10 >= 8
    fit_x, fit_y = x[~held], y[~held]
    net = CharCNN.fresh(rng)
    mean, square, t = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()], 0
    for _ in range(epochs):
        order = rng.permutation(len(fit_y))
        for i in range(0, len(order), 64):
            t += 1
            for w, g, m, v in zip(net.weights(), net.gradients(fit_x[order[i : i + 64]], fit_y[order[i : i + 64]]), mean, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.005 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw, goal = net.raw(x[held]), y[held]
    a, b = 1.0, 0.0
    for _ in range(400):  # calibration: a logistic fit of the held-out labels on the raw scores
        error = 1 / (1 + np.exp(-(a * raw + b))) - goal
        a, b = a - 0.05 * (error * raw).mean(), b - 0.05 * error.mean()
    net.slope, net.shift = float(a), float(b)
    positives = np.sort(net.scores(x[held])[goal == 1])
    net.threshold = float(positives[int(np.floor((1 - recall) * len(positives)))])
    return net


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", recall: float = 0.97) -> DataFrame:
    """Find secrets in every whole text. Returns doc_id and spans (kind, start, stop, score, sure), one row per input row.

    Spans are in code points, stop exclusive, ordered by start, then kind as in KINDS. Pattern matches always stay; score
    is the network's, and sure tells whether it reaches the threshold. Spans of kind `model` are candidates the network
    adds. Null and empty texts give no spans; long candidates are read in windows, all of them; repeated rows give
    repeated results; an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained_network(recall))  # a few thousand numbers

    def scan(batches):
        net = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                found, rows, owner = [], [], []
                for text_ in batch.column(1).to_pylist():
                    text_ = text_ or ""
                    base = base_spans(text_)
                    spans = base + [(a, b, "model") for a, b in other_candidates(text_, base)]
                    for a, b, _ in spans:
                        part = windows(text_, a, b)
                        rows += part
                        owner.append(len(part))
                    found.append(spans)
                scores = np.concatenate([np.zeros(0), *(net.scores(encode(rows[i : i + WINDOWS])) for i in range(0, len(rows), WINDOWS))])
                best = iter(np.maximum.reduceat(scores, np.cumsum([0, *owner[:-1]])).tolist() if owner else ())
                out = []
                for spans in found:
                    scored = sorted((a, KINDS.index(kind), b, next(best)) for a, b, kind in spans)
                    named = ({"kind": KINDS[k], "start": a, "stop": b, "score": s, "sure": s >= net.threshold} for a, k, b, s in scored)
                    out.append([x for x in named if x["sure"] or x["kind"] != "model"])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS.field("spans").type)], schema=_SPANS)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), body(text).alias("text"))
    return rows.mapInArrow(scan, SPANS).withColumnRenamed("id", doc_id)
