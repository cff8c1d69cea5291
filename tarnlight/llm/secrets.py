"""Secret scanning: rules propose, a character convolutional network decides the rest.

Rules find assignments of credentials, access keys and long hex strings; these findings
always stay.  Every other token of letters, digits and key punctuation that has both a
letter and a digit is a candidate.  The network, written in numpy, reads each candidate
with the characters around it: embedding (inside and outside the candidate differ), one
convolution, maximum and mean over the places, one hidden layer.  It is trained on a
seeded set of labelled findings (keys of many shapes against identifiers, paths, dates,
prose and numbers), its logits are calibrated on a second set (Platt), and the threshold
is the largest up to 0.9 that keeps a recall of ``RECALL`` on a third.

Base rules, each leftmost and non-overlapping in itself, failing matches dropped:
``assign`` with a value of 6 or more characters, ``access`` of 20 or more, ``hex`` of 24
or more.  Kind ``token``: candidates over the threshold that touch no base finding.

Cases: null and empty texts have no findings; long candidates are read in overlapping
windows and take the highest score; repeated rows are scanned one by one; offsets count
code points, end exclusive.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnlight.llm import shared

KINDS = ("assign", "access", "hex", "token")
#: Recall that the threshold must keep; shortest candidate; characters read before and after, and at once.
RECALL, SHORTEST, AROUND, READ = 0.98, 16, 16, 64
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_ANY_CASE = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", w) for w in _WORDS)
ASSIGN = re.compile(rf"""(?:{_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
_STEMS = ("passw", "secret", "token", "api")


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_HEX, _DIGIT, _ALPHA = _mask("0123456789abcdef"), _mask(string.digits), _mask(string.ascii_letters)
_TOKEN = _mask(string.ascii_letters + string.digits + "+/_=.-")


def long_runs(data: np.ndarray, offs: np.ndarray, chars: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a byte class of at least ``least`` bytes, not crossing texts."""
    n = len(data)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = np.flatnonzero(~chars[data])
    # a text boundary ends a run without taking a byte
    ends = np.concatenate([stop, offs[1:]])
    begins = np.concatenate([stop + 1, offs[:-1]])
    ends, begins = np.sort(ends), np.sort(begins)
    ok = ends - begins >= least
    return begins[ok], ends[ok]


class CharNet:
    """A small character CNN with hand-written gradients."""

    CODES = 97  # printable ASCII, one for the rest, one for padding

    def __init__(self, seed: int = 9, embed: int = 8, filters: int = 24, reach: int = 5, hidden: int = 16):
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.standard_normal(shape) * np.sqrt(2 / shape[0])
        self.reach = reach
        self.p = {"e": rng.standard_normal((2 * self.CODES, embed)) * 0.3, "w": init(reach * embed, filters), "b": np.zeros(filters), "h": init(2 * filters, hidden), "c": np.zeros(hidden), "o": init(hidden, 1), "d": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        p = self.p
        e = p["e"][x]
        places = x.shape[1] - self.reach + 1
        cols = np.concatenate([e[:, i : i + places] for i in range(self.reach)], 2)
        z = cols @ p["w"] + p["b"]
        a = np.maximum(z, 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1)], 1)
        u = np.maximum(pooled @ p["h"] + p["c"], 0)
        return cols, z, top, pooled, u, (u @ p["o"] + p["d"])[:, 0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 3) -> None:
        """Adam on the logistic loss."""
        p, rng, step = self.p, np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
        filters = len(p["b"])
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                own = x[order[i : i + batch]]
                cols, z, top, pooled, u, out = self._forward(own)
                d = ((1 / (1 + np.exp(-np.clip(out, -60, 60))) - y[order[i : i + batch]]) / len(own))[:, None]
                du = (d @ p["o"].T) * (u > 0)
                dp = du @ p["h"].T
                da = np.repeat(dp[:, None, filters:] / z.shape[1], z.shape[1], 1)
                np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, :filters], 1)
                dz = da * (z > 0)
                dc = dz @ p["w"].T
                de = np.zeros((*own.shape, p["e"].shape[1]))
                for k in range(self.reach):
                    de[:, k : k + z.shape[1]] += dc[:, :, k * de.shape[2] : (k + 1) * de.shape[2]]
                ge = np.zeros_like(p["e"])
                np.add.at(ge, own, de)
                flat = cols.reshape(-1, cols.shape[2])
                grad = {"e": ge, "w": flat.T @ dz.reshape(-1, filters), "b": dz.sum((0, 1)), "h": pooled.T @ du, "c": du.sum(0), "o": u.T @ d, "d": d.sum(0)}
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, rounds: int = 200) -> None:
        """Platt scaling with his smoothed targets, by Newton steps on two parameters."""
        s = self.logits(x)
        many = y.sum()
        y = np.where(y == 1, (many + 1) / (many + 2), 1 / (len(y) - many + 2))
        a, b = 1.0, 0.0
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(a * s + b, -60, 60)))
            r, w = q - y, q * (1 - q) + 1e-6
            g = np.array([(r * s).sum() + 1e-3 * (a - 1), r.sum()])
            h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum()]])
            da, db = np.linalg.solve(h, g)
            a, b = a - np.clip(da, -0.5, 0.5), b - np.clip(db, -0.5, 0.5)
            if abs(da) + abs(db) < 1e-9:
                break
        self.scale, self.shift = float(a), float(b)

    def constrain(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """The largest threshold, up to 0.9, that keeps the recall on these findings."""
        found = np.sort(self.probability(x)[y == 1])
        self.threshold = min(0.9, float(found[int(np.floor((1 - recall) * len(found)))]))


def codes(before: str, inside: str, after: str) -> np.ndarray:
    """Network input of one window: fixed length, padded with the padding code."""
    pad = CharNet.CODES - 1
    of = lambda s: [ord(c) - 32 if 32 <= ord(c) < 127 else 95 for c in s]
    out = [pad] * (AROUND - len(before)) + of(before) + [c + CharNet.CODES for c in of(inside)] + of(after)
    return np.array((out + [pad] * (2 * AROUND + READ))[: 2 * AROUND + READ], np.int64)


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """All windows of READ characters of a candidate, half overlapping."""
    step = READ // 2
    places = range(start, max(start + 1, end - step), step) if end - start > READ else [start]
    return [codes(text[max(0, a - AROUND) : a], text[a : min(end, a + READ)], text[min(end, a + READ) : min(end, a + READ) + AROUND]) for a in places]


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Seeded examples (text, start, end, secret) of many shapes."""
    rng = random.Random(seed)
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    alnum, low = string.ascii_letters + string.digits, string.ascii_lowercase
    syllables = "the ing and er on re th tion in an en de la ment que sch ge ung ció dad os".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    name = lambda: "".join(c for c in word() if c in low) or "data"
    secret = [
        lambda: pick(alnum, 20, 44), lambda: pick(alnum + "+/", 32, 64) + rng.choice(["", "=", "=="]), lambda: pick(alnum + "_-", 24, 48),
        lambda: pick(string.ascii_uppercase + string.digits, 20, 40), lambda: pick("0123456789ABCDEF", 24, 64), lambda: pick("0123456789abcdef", 18, 23),
        lambda: rng.choice(["ghx_", "sk_live_", "xoxo-", "pk-", "npx_"]) + pick(alnum, 20, 36), lambda: ".".join(["eyJ" + pick(alnum + "_-", 15, 30), pick(alnum + "_-", 20, 50), pick(alnum + "_-", 20, 43)]),
    ]
    plain = [
        lambda: "-".join(name() for _ in range(rng.randint(3, 5))) + str(rng.randint(0, 99)), lambda: "_".join(name() for _ in range(rng.randint(2, 4))) + f"_v{rng.randint(1, 20)}",
        lambda: "/".join(name() for _ in range(rng.randint(3, 6))) + f"/{rng.randint(1, 9999)}", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}",
        lambda: "www." + name() + name() + ".org/" + name() + str(rng.randint(0, 999)), lambda: name().title() + name().title() + name().title() + str(rng.randint(0, 9)),
        lambda: f"{name()}.{name()}.{name()}.{rng.randint(0, 99)}.{rng.randint(0, 99)}", lambda: rng.choice(["a", "x", "-", "="]) * rng.randint(14, 40) + str(rng.randint(0, 9)),
        lambda: (name() * 8)[: rng.randint(16, 40)] + str(rng.randint(0, 9)), lambda: f"{name()}{rng.randint(1000, 9999)}{name()}{rng.randint(10, 99)}{name()}{name()}",
    ]
    hints = ["key=", "key: ", "auth ", "Bearer ", "credential=", "pw ", "SECRET_", "private ", "login:"]
    out = []
    for i in range(n):
        y = i % 2
        token = rng.choice(secret if y else plain)()
        left = " ".join(word() for _ in range(rng.randint(0, 4))) + rng.choice([" ", "\n", "", "=", '"', ": "])
        if rng.random() < (0.35 if y else 0.08):
            left += rng.choice(hints)
        right = rng.choice([" ", "\n", "", '"', ". ", ", "]) + " ".join(word() for _ in range(rng.randint(0, 4)))
        out.append((left + token + right, len(left), len(left) + len(token), y))
    return out


@functools.lru_cache(maxsize=2)
def trained(size: int = 4000, seed: int = 20) -> CharNet:
    """The network after training, calibration and the choice of its threshold; same every time."""
    sets = []
    for k, n in enumerate((size, size // 4, size // 4)):
        rows = labelled_findings(n, seed + k)
        sets.append((np.stack([windows(t, a, b)[0] for t, a, b, _ in rows]), np.array([r[3] for r in rows], float)))
    net = CharNet()
    net.fit(*sets[0])
    net.calibrate(*sets[1])
    net.constrain(*sets[2])
    return net


def base_findings(text: str, hexes: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind."""
    found = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexes is None:
        hexes = [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]
    return sorted(found + [(a, 2, b) for a, b in hexes])


def _by_row(data: np.ndarray, offs: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Byte spans as code point spans of their texts."""
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(begins.tolist(), ends.tolist()):
        row = int(np.searchsorted(offs, a, side="right")) - 1
        out.setdefault(row, []).append((a, b))
    for row, spans in out.items():
        own = data[offs[row] : offs[row + 1]]
        past = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)]) if (own >= 0x80).any() else None
        base = int(offs[row])
        out[row] = [(a - base, b - base) if past is None else (int(past[a - base]), int(past[b - base])) for a, b in spans]
    return out


def scan(docs: DataFrame, text_col: str = "text", net: CharNet | None = None) -> DataFrame:
    """All columns of ``docs`` with ``findings``: array of (kind, start, end, score), base first by rule order.

    Base findings come by start, then kind; ``token`` findings are merged in by start.
    Base findings are scored too, for information.
    """
    spark = docs.sparkSession
    shared.tune(spark)
    held = spark.sparkContext.broadcast(net or trained())
    box = shared.boxed(docs, text_col)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def work(stream):
        model = held.value
        for batch in stream:
            for part in shared.slices(batch):
                texts = part.column("text").to_pylist()
                data, offs = shared.buffer_of(part.column("text"))
                hexes = _by_row(data, offs, *long_runs(data, offs, _HEX, 24))
                begins, ends = long_runs(data, offs, _TOKEN, SHORTEST)
                digits, letters = (np.concatenate([[0], np.cumsum(m[data])]) for m in (_DIGIT, _ALPHA))
                mixed = (digits[ends] > digits[begins]) & (letters[ends] > letters[begins])
                tokens = _by_row(data, offs, begins[mixed], ends[mixed])
                rows, asked, owner = [], [], []
                for i, text in enumerate(texts):
                    text = text or ""
                    found = [[a, k, b, 0.0] for a, k, b in base_findings(text, hexes.get(i, []))]
                    begins_at = [f[0] for f in found]
                    reach = list(itertools.accumulate((f[2] for f in found), max))
                    for a, b in tokens.get(i, []):
                        while a < b and text[a] in ".-":
                            a += 1
                        while b > a and text[b - 1] in ".-":
                            b -= 1
                        if b - a >= SHORTEST and not ((n := bisect.bisect_left(begins_at, b)) and reach[n - 1] > a):
                            found.append([a, 3, b, 0.0])
                    for f in found:
                        for w in windows(text, f[0], f[2]):
                            asked.append(w)
                            owner.append(f)
                    rows.append(found)
                if asked:
                    for f, q in zip(owner, model.probability(np.stack(asked)).tolist()):
                        f[3] = max(f[3], q)
                kept = [[{"kind": KINDS[k], "start": a, "end": b, "score": q} for a, k, b, q in sorted(r, key=lambda f: (f[0], f[1])) if k < 3 or q >= model.threshold] for r in rows]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kept, pa.list_(item))], ["row", "text", "findings"])

    out = box.mapInArrow(work, shared.boxed_schema(box, findings="array<struct<kind:string,start:long,end:long,score:double>>"))
    return shared.unboxed(out, docs, text_col, ["findings"])

