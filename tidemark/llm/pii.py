"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The patterns find what has a fixed form (e-mail, IP address, card, telephone).
The random field labels runs of words with digits or at-signs by their shapes
and neighbours and adds what the patterns miss, such as telephone numbers
without a country code. It looks at the plain words around a run as well. It is
trained on the driver from a small labelled table that a seeded generator writes;
its weights are a few thousand numbers. Words without a digit or at-sign are
outside by construction, so decoding touches only the runs between them.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._common import text_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Rows of the labelled table, passes and step of the training.
TRAIN_ROWS, TRAIN_STEPS, TRAIN_RATE = 2_400, 150, 0.15
_SPACE = " \t\n\r\x0b\x0c"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@][^\x20\x09-\x0D]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; linear also in long runs that come close."""
    out, end, p = [], 0, text.find("@")
    while p >= 0:
        a = p
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < p and (m := _DOMAIN.match(text, p + 1)):
            out.append((a, m.end()))
            end = m.end()
        else:
            end = p + 1
        p = text.find("@", end)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in four):
                    out.append((at, at + size))
                at += size + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find, by kind and then start."""
    return [(k, a, b) for k, f in zip(KINDS, (emails, addresses, cards, phones)) for a, b in f(text)]


# -- the random field ---------------------------------------------------------


def shape(word: str) -> str:
    """Digits become 9, letters a, runs of over four are cut to four."""
    out = "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", out)


#: Plain words that say what comes next.
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "from", "gateway", "ping"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "pay"),
    "phone": ("call", "tel", "phone", "telephone", "fax", "mobile", "dial", "text"),
    "other": ("in", "the", "of", "and", "page", "year", "order", "version", "room", "about", "number", "chapter"),
}
_CUES = {w for words in CUES.values() for w in words}


def cue(word: str) -> str:
    """A plain word as a feature: itself if it is a cue, else unknown; nothing at the edge of a text."""
    low = word.lower().strip(".,;:!?()[]\"'")
    return low if low in _CUES else "?" if word else ""


def features(words: list[str], before: str = "", after: str = "") -> list[list[str]]:
    """The features of each word of a run: its own shape and counts, the shapes beside it, and the plain words around the run."""
    row = ["", *words, ""]
    shapes = [shape(w.strip(".,;:!?")) for w in row]
    near, far = f"b={cue(before)}", f"f={cue(after)}"
    out = []
    for k, w in enumerate(words, 1):
        n = sum("0" <= c <= "9" for c in w)
        size = n if n < 12 else 12
        out.append([f"s={shapes[k]}", f"d={size}", f"l={shapes[k - 1] if any(c.isdigit() for c in row[k - 1]) else ''}", f"r={shapes[k + 1] if any(c.isdigit() for c in row[k + 1]) else ''}", f"at={'@' in w}", f"plus={'+' in w}", f"par={'(' in w}", f"dot={min(w.strip('.').count('.'), 4)}", f"dash={min(w.count('-'), 4)}", f"slash={'/' in w or ':' in w}", f"alpha={any(c.isalpha() for c in w)}", near, far, f"{near} d={size} {len(words)}"])
    return out


def labelled_rows(n: int = TRAIN_ROWS, seed: int = 5) -> list[tuple[list[str], list[str], str, str]]:
    """The labelled table: runs of words with digits or at-signs, each word with its kind, and the plain words before and behind."""
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    a = lambda lo, hi: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(lo, hi)))
    makers = {
        "email": [lambda: [f"{a(2, 8)}.{d(2)}@{a(3, 8)}{d(1)}.example.com"], lambda: [f"{a(3, 8)}@{a(3, 9)}.{a(2, 3)}"], lambda: [f"{a(2, 6)}_{d(2)}@{a(3, 8)}.{a(2, 3)}"]],
        "ip": [lambda: [".".join(str(rnd.randint(0, 255)) for _ in range(4))]],
        "card": [lambda: [d(16)], lambda: [d(4) for _ in range(4)], lambda: ["-".join(d(4) for _ in range(4))]],
        "phone": [lambda: [f"+{rnd.randint(1, 99)}", f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"{d(3)}-{d(3)}-{d(4)}"], lambda: [f"{d(3)}.{d(3)}.{d(4)}"], lambda: [f"+{d(2)}", d(3), d(3), d(4)], lambda: [f"+{d(11)}"], lambda: [f"0{d(2)}", d(7)]],
        "other": [lambda: [d(rnd.randint(1, 9))], lambda: [f"{d(4)}-{d(2)}-{d(2)}"], lambda: [f"{d(2)}:{d(2)}"], lambda: [f"{d(1)}.{d(rnd.randint(1, 4))}"], lambda: [f"{d(1)}.{d(2)}.{d(1)}"], lambda: [f"{a(2, 8)}{d(rnd.randint(1, 8))}"], lambda: [f"{d(2)}/{d(2)}/{d(4)}"], lambda: [f"${d(3)}.{d(2)}"], lambda: [f"{d(3)}%"], lambda: [f"@{a(3, 9)}"], lambda: [f"{a(3, 8)}_{a(2, 5)}{d(6)}{a(3, 9)}{d(4)}"], lambda: [f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}"], lambda: [f"{a(2, 4).upper()}{d(16)}"], lambda: [f"{d(5)}", f"{d(2)}"], lambda: [f"https://{a(4, 9)}.example.net/{a(2, 5)}/{d(5)}"]],
    }
    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(rnd.choice((1, 1, 1, 2, 3))):
            kind = rnd.choice(("email", "ip", "card", "phone", "other", "other", "other", "other"))
            got = rnd.choice(makers[kind])()
            got[-1] += rnd.choice(("", "", "", ".", ","))
            words += got
            tags += [kind] * len(got)
        # half of the runs have a plain word before them that fits the first kind, or any; bare long numbers count as telephone numbers behind such a word only
        before = rnd.choice(CUES[tags[0]]) if rnd.random() < 0.5 else rnd.choice(("", a(2, 8), a(2, 8)))
        if rnd.random() < 0.12:
            dial = rnd.random() < 0.5
            words, tags, before = [d(rnd.choice((7, 9, 10, 10, 11)))], ["phone" if dial else "other"], rnd.choice(CUES["phone" if dial else "other"])
        out.append((words, tags, before, rnd.choice(("", a(2, 8)))))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def unknown(feature: str) -> str:
    """The name under which rare features of a kind are learnt."""
    return f"{feature.partition('=')[0]}=unknown"


class Field:
    """Weights of the field: one row per feature and label, and label transitions."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.names, self.emit, self.step = names, emit, step

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        """Label scores of each word. What training did not see, or saw once, has the weights of the unknown."""
        out = np.zeros((len(rows), len(LABELS)))
        for k, row in enumerate(rows):
            out[k] = self.emit[[self.names[x] for f in row if (x := f if f in self.names else unknown(f)) in self.names]].sum(axis=0)
        return out

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi labels of many runs at once: one numpy step for each word position."""
        if not runs:
            return []
        size = np.array([len(r) for r in runs])
        order = np.argsort(-size, kind="stable")
        longest = int(size[order[0]])
        back = [None] * longest
        best = np.array([runs[i][0] for i in order])
        ends = np.zeros(len(runs), np.int64)
        for t in range(1, longest):
            live = int((size[order] > t).sum())
            cand = best[:live, :, None] + self.step[None]
            back[t] = cand.argmax(axis=1)
            best[:live] = cand.max(axis=1) + np.array([runs[i][t] for i in order[:live]])
        ends = best.argmax(axis=1)
        out = [np.zeros(len(r), np.int64) for r in runs]
        for row, i in enumerate(order):
            y = ends[row]
            for t in range(size[i] - 1, -1, -1):
                out[i][t] = y
                if t:
                    y = back[t][row, y]
        return out


@functools.lru_cache(maxsize=2)
def train(rows: int = TRAIN_ROWS, seed: int = 5) -> Field:
    """Maximum likelihood with a small penalty: forward-backward and Adam over the labelled table."""
    data = labelled_rows(rows, seed)
    seqs = [(features(w, before, after), [LABELS.index(t) for t in tags]) for w, tags, before, after in data]
    times = Counter(x for f, _ in seqs for row in f for x in row)
    seqs = [([[x if times[x] > 1 else unknown(x) for x in row] for row in f], y) for f, y in seqs]
    names: dict[str, int] = {}
    for f, _ in seqs:
        for row in f:
            for x in row:
                names.setdefault(x, len(names))
    L = len(LABELS)
    longest = max(len(y) for _, y in seqs)
    width = len(seqs[0][0][0])
    X = np.full((len(seqs), longest, width), len(names))
    Y = np.zeros((len(seqs), longest), np.int64)
    on = np.zeros((len(seqs), longest), bool)
    for i, (f, y) in enumerate(seqs):
        for t, row in enumerate(f):
            X[i, t], Y[i, t], on[i, t] = [names[x] for x in row], y[t], True
    emit, step = np.zeros((len(names) + 1, L)), np.zeros((L, L))
    moments = [np.zeros_like(w) for w in (emit, step, emit, step)]
    used = X[on]  # the features of each word
    for it in range(1, TRAIN_STEPS + 1):
        s = np.zeros((*on.shape, L))
        s[on] = emit[used].sum(axis=1)
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[:, 0] = s[:, 0]
        for t in range(1, longest):
            nxt = _logsum(a[:, t - 1, :, None] + step[None], 1) + s[:, t]
            a[:, t] = np.where(on[:, t, None], nxt, a[:, t - 1])
        z = _logsum(a[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            nxt = _logsum(step[None] + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(on[:, t + 1, None], nxt, 0)
        post = np.where(on[:, :, None], np.exp(a + b - z[:, None, None]), 0)
        gold = np.where(on[:, :, None], np.eye(L)[Y], 0)
        miss = (gold - post)[on]
        g_emit = np.stack([np.bincount(used.ravel(), np.repeat(miss[:, y], width), len(emit)) for y in range(L)], axis=1)
        g_step = np.zeros_like(step)
        for t in range(1, longest):
            pair = np.exp(a[:, t - 1, :, None] + step[None] + (s[:, t] + b[:, t])[:, None, :] - z[:, None, None])
            g_step += ((gold[:, t - 1, :, None] * gold[:, t][:, None, :]) - pair)[on[:, t]].sum(axis=0)
        for k, (w, g) in enumerate(((emit, g_emit), (step, g_step))):
            g = g / len(seqs) - 1e-4 * w
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * g * g
            w += TRAIN_RATE * (moments[k] / (1 - 0.9**it)) / (np.sqrt(moments[k + 2] / (1 - 0.99**it)) + 1e-8)
        emit[-1] = 0
    return Field(names, emit[:-1], step)


def runs_of(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words with a digit or at-sign, as bounds of their words."""
    spans: list[tuple[int, int]] = []
    for m in _MARK.finditer(text):
        a = m.start()
        while a and text[a - 1] not in _SPACE:
            a -= 1
        spans.append((a, m.end()))
    runs: list[list[tuple[int, int]]] = []
    for a, b in spans:
        if runs and a - runs[-1][-1][1] <= 2 and not text[runs[-1][-1][1] : a].strip(_SPACE):
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
    return runs


def _beside(text: str, at: int, step: int) -> str:
    """The word that ends before ``at``, or begins from it on."""
    edge = at - 1 if step < 0 else at
    while 0 <= edge < len(text) and text[edge] in _SPACE:
        edge += step
    far = edge
    while 0 <= far < len(text) and text[far] not in _SPACE:
        far += step
    return text[far + 1 : edge + 1] if step < 0 else text[edge:far]


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """What the field finds in each text: neighbouring words of one kind are one span, outer punctuation left out."""
    where, words = [], []
    for i, text in enumerate(texts):
        for run in runs_of(text):
            where.append((i, run))
            words.append(features([text[a:b] for a, b in run], _beside(text, run[0][0], -1), _beside(text, run[-1][1], 1)))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, run), labels in zip(where, field.decode([field.scores(w) for w in words])):
        k = 0
        while k < len(run):
            j = k
            while j + 1 < len(run) and labels[j + 1] == labels[k]:
                j += 1
            if labels[k]:
                a, b = run[k][0], run[j][1]
                while b > a and texts[i][b - 1] in ".,;:!?":
                    b -= 1
                if LABELS[labels[k]] != "card" or luhn("".join(c for c in texts[i][a:b] if "0" <= c <= "9")):  # a wrong check digit is no card
                    out[i].append((LABELS[labels[k]], a, b))
            k = j + 1
    return out


def merged(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """All spans by kind and start: what the field adds must not touch a pattern's span."""
    extra = [(k, a, b) for k, a, b in more if not any(x < b and a < y for _, x, y in base)]
    return sorted([*base, *extra], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_spans(docs: DataFrame) -> DataFrame:
    """Counts and spans for each row of ``docs`` (doc_id, text; other columns are left alone).

    Offsets count code points, the end is exclusive. A null text counts as
    empty. A map over the input without any exchange.
    """
    field = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_batches(batch):
                rows = []
                for doc_id, text, more in zip(ids, texts, field_spans(texts, field)):
                    base = base_spans(text)
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    every = merged(base, more)
                    rows.append((doc_id, *counts, hashlib.sha256(told(base).encode()).hexdigest(), told(every), len(every) - len(base)))
                long, text_ = pa.int64(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (long, long, long, long, long, text_, text_, long))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in angle brackets; other columns stay, ``n_chars`` follows the text.

    Overlapping spans are replaced as one, named after the one that starts
    first. A null text stays null.
    """
    field = train()
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = []
            for text, more in zip(texts, field_spans([t or "" for t in texts], field)):
                if text is None:
                    new.append(None)
                    continue
                out, end = [], 0
                for kind, a, b in sorted(merged(base_spans(text), more), key=lambda s: (s[1], -s[2])):
                    if a >= end:
                        out += [text[end:a], f"<{kind}>"]
                    end = max(end, b)
                new.append("".join([*out, text[end:]]))
            cols = list(batch.columns)
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
