"""Personal data: fixed patterns plus a linear-chain CRF over word-shape features.

Base spans (email, ip, card, phone) are leftmost non-overlapping matches of the
fixed patterns that pass their test; failing matches are dropped.  A
conditional random field, trained from a small labelled table, adds spans that the patterns
cannot see: `jane [at] example [dot] com`, `(415) 555-2671`, `192[.]0[.]2[.]1`.

Tokens are runs of digits, runs of letters and single other characters.  The
model labels a token as outside, or as beginning or continuing one of the four
kinds, from the shapes of the token and its neighbours.  A token farther than
REACH tokens from any digit, `@` or bracketed at/dot is outside by constraint, so
the chain of a text falls apart exactly into windows around those; reach counts tokens, however long.
Windows of a batch are decoded together by Viterbi in numpy; a text of any length is read in
time that grows with it, in bounded tables.

Added spans must pass their kind's test (digits, Luhn, four parts up to 255, an
at-sign or its spelling) and never overlap a base span or each other.

Defined cases: null text is empty and has no spans; texts are read whole; equal
texts get equal spans; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii_examples import MARKED

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = 6

# Fixed patterns of the base spans, e-mail addresses aside.
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),  # a match always begins where digits begin
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|[_]|\w")
_ANCHOR = re.compile(r"[0-9]+|@|[\[(]\s?(?:at|AT|At|dot|DOT|Dot)\s?[\])]")
#: Tokens of a window that is decoded by itself, tokens that wait for a common decoding, cells of a padded table, contexts whose scores a task remembers.
LONG, WAITING, CELLS, KNOWN = 512, 20_000, 1 << 15, 50_000


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in s.split(".")))
    if kind == "card":
        d = digits(s)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits(s)) <= 15
    return True


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, found from each at-sign: what stands before it and what follows is read once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = at + 1  # no later match reaches back over this sign
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns."""
    out = [(a, b, "email") for a, b in emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in BASE.items():
            if kind != "phone" or "+" in text:
                out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if passes(kind, m[0])]
    return out


# --------------------------------------------------------------------- features

_CUES = {
    w: name
    for name, words in {
        "tel": "phone call tel fax mobile cell telefon téléphone telephone llame ring reach number handy móvil",
        "mail": "email mail write contact address correo adresse",
        "card": "card visa mastercard credit charged paid tarjeta karte carte",
        "net": "ip host server address from log",
        "at": "at",
        "dot": "dot",
    }.items()
    for w in words.split()
}


def shape(token: str) -> str:
    c = token[0]
    if "0" <= c <= "9":
        return f"d{min(len(token), 6)}"
    if c.isalpha():
        low = token.lower()
        if low in _CUES and len(token) <= 10:
            return "cue-" + _CUES[low]
        return "X" if token.isupper() else ("Xx" if c.isupper() else "x")
    return c if ord(c) < 128 else "other"


def context(shapes: list[str], gaps: list[bool], i: int) -> tuple[str, ...]:
    """What the features of token i look at: five shapes around it, and whether white space stands before it and the next two."""
    n = len(shapes)
    if 2 <= i < n - 2:
        near = shapes[i - 2 : i + 3]
    else:
        near = [shapes[j] if 0 <= j < n else "edge" for j in range(i - 2, i + 3)]
    return (*near, *[("1" if gaps[j] else "0") if j < n else "e" for j in (i, i + 1, i + 2)])


def features(about: tuple[str, ...]) -> list[str]:
    """Names of the features of a token's context."""
    a, b, c, d, e, g, g1, g2 = about
    return [
        "bias", f"0={c}", f"-1={b}", f"+1={d}", f"-2={a}", f"+2={e}", f"-10={b}|{c}", f"01={c}|{d}", f"-101={b}|{c}|{d}",
        f"-2-1={a}|{b}", f"12={d}|{e}", f"g={g}{g1}|{c}", f"012={c}|{d}|{e}|{g1}{g2}",
    ]


def _starts_allowed() -> np.ndarray:
    """allowed[a, b]: label b may follow label a; I-x only after B-x or I-x."""
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            ok[:, j] = [a[1:] == b[1:] for a in LABELS]
    return ok


_OK = _starts_allowed()
_NEVER = -1e6


@dataclass
class Chain:
    """Weights of the field."""

    index: dict[str, int]
    emit: np.ndarray  # features x labels
    move: np.ndarray  # labels x labels
    known: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict)

    def scores(self, rows: list[tuple[str, ...]]) -> np.ndarray:
        """Label scores of tokens given as contexts; those met before are remembered, KNOWN at most."""
        out = np.empty((len(rows), len(LABELS)))
        for r, about in enumerate(rows):
            got = self.known.get(about)
            if got is None:
                ids = [self.index[n] for n in features(about) if n in self.index]
                got = self.emit[ids].sum(0)
                if len(self.known) < KNOWN:
                    self.known[about] = got
            out[r] = got
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of a padded batch (windows x tokens x labels); every window lies between outside tokens."""
    n, t, k = scores.shape
    back = np.zeros((n, t, k), np.int8)
    best = scores[:, 0] + move[0]
    for i in range(1, t):
        through = best[:, :, None] + move
        back[:, i] = through.argmax(1)
        step = through.max(1) + scores[:, i]
        best = np.where((i < lengths)[:, None], step, best)
    out = np.zeros((n, t), np.int8)
    now = (best + move[:, 0]).argmax(1)
    for i in range(t - 1, -1, -1):
        inside = i < lengths
        out[:, i] = np.where(inside, now, 0)
        now = np.where(inside & (i > 0), back[np.arange(n), i, now], now)
    return out


def fit(examples: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.15, ridge: float = 0.003) -> Chain:
    """Maximises the conditional likelihood by Adam; gradients by forward-backward over the padded table."""
    index: dict[str, int] = {}
    for rows, _ in examples:
        for names in rows:
            for n in names:
                index.setdefault(n, len(index))
    n, t, k = len(examples), max(len(r) for r, _ in examples), len(LABELS)
    hot = np.zeros((n, t, len(next(iter(examples))[0][0])), np.int64)
    gold, length = np.zeros((n, t), np.int64), np.array([len(r) for r, _ in examples])
    for i, (rows, labels) in enumerate(examples):
        for j, names in enumerate(rows):
            hot[i, j] = [index[x] for x in names]
            gold[i, j] = labels[j]
    inside = np.arange(t) < length[:, None]
    emit, move = np.zeros((len(index), k)), np.where(_OK, 0.0, _NEVER)
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    truth = np.eye(k)[gold] * inside[..., None]
    lse = lambda x, ax: np.log(np.exp(x - (m := x.max(ax, keepdims=True))).sum(ax)) + m.squeeze(ax)
    for r in range(1, rounds + 1):
        s = emit[hot].sum(2)
        f, b = np.zeros((n, t, k)), np.zeros((n, t, k))
        f[:, 0] = s[:, 0] + move[0]
        for i in range(1, t):
            f[:, i] = np.where(inside[:, i, None], lse(f[:, i - 1][:, :, None] + move, 1) + s[:, i], f[:, i - 1])
        b[:, t - 1] = move[:, 0]
        for i in range(t - 2, -1, -1):
            step = lse(move[None] + (s[:, i + 1] + b[:, i + 1])[:, None, :], 2)
            b[:, i] = np.where(inside[:, i + 1, None], step, move[:, 0])
        z = lse(f[:, t - 1] + move[:, 0], 1)
        p = np.exp(np.clip(f + b - z[:, None, None], -700, 0)) * inside[..., None]
        g_emit = np.zeros_like(emit)
        np.add.at(g_emit, hot.ravel(), np.repeat((truth - p).reshape(-1, k), hot.shape[2], axis=0))
        g_move = np.zeros_like(move)
        for i in range(1, t):
            pair = f[:, i - 1][:, :, None] + move + (s[:, i] + b[:, i])[:, None, :] - z[:, None, None]
            g_move -= (np.exp(np.clip(pair, -700, 0)) * inside[:, i, None, None]).sum(0)
            np.add.at(g_move, (gold[inside[:, i], i - 1], gold[inside[:, i], i]), 1.0)
        for w, g, m, v in ((emit, g_emit - ridge * n * emit, state[0], state[1]), (move, np.where(_OK, g_move - ridge * n * move, 0.0), state[2], state[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        move[~_OK] = _NEVER
    return Chain(index, emit, move)


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def _described(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, ...]]:
    shapes = [shape(text[a:b]) for a, b in spans]
    gaps = [i > 0 and spans[i - 1][1] < spans[i][0] for i in range(len(spans))]
    return [context(shapes, gaps, i) for i in range(len(spans))]


def train(marked: list[str] | None = None) -> Chain:
    """Fits the chain on labelled rows such as `call {phone:(415) 555-2671} now`."""
    examples = []
    for row in marked if marked is not None else MARKED.strip().splitlines():
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w+):([^{}]*)\}", row):
            text += row[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        text += row[at:]
        tokens, labels = tokens_of(text), []
        for a, _ in tokens:
            own = next((s for s in spans if s[0] <= a < s[1]), None)
            labels.append(0 if own is None else LABELS.index(("B-" if a == own[0] else "I-") + own[2]))
        examples.append(([features(c) for c in _described(text, tokens)], labels))
    return fit(examples)


def _last_tokens(text: str, low: int, end: int, n: int) -> list[tuple[int, int]]:
    """The last n tokens of text[low:end], looking back no farther than they need."""
    reach = 256
    while True:
        start = max(low, end - reach)
        got = tokens_of(text, start, end)
        if start == low or len(got) > n:  # the first one may be cut
            return got[-n:]
        reach *= 2


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text within REACH tokens of a digit run, at-sign or bracketed at/dot, as (start, end)."""
    some = lambda a, b, n: [m.span() for m in itertools.islice(_TOKEN.finditer(text, a, b), n)]
    group, done = None, 0
    for m in itertools.chain(_ANCHOR.finditer(text), [None]):
        if group is not None and m is not None and len(some(group[1], m.start(), 2 * REACH + 1)) <= 2 * REACH:
            group[1] = m.end()
            continue
        if group is not None:
            after = some(group[1], m.start() if m else len(text), REACH)
            before = _last_tokens(text, done, group[0], REACH)
            done = after[-1][1] if after else group[1]
            yield (before[0][0] if before else group[0]), done
        group = [m.start(), m.end()] if m else None


def _long_labels(text: str, spans: np.ndarray, chain: Chain) -> np.ndarray:
    """Best labels of one long window: scores are made LONG tokens at a time, back pointers take a few bytes a token."""
    n, at = len(spans), 0
    back, best = np.zeros((n, len(LABELS)), np.int8), None
    while at < n:
        low, high = max(0, at - 2), min(n, at + LONG + 2)
        part = [(int(a), int(b)) for a, b in spans[low:high]]
        shapes = [shape(text[a:b]) for a, b in part]
        gaps = [low + i > 0 and int(spans[low + i - 1][1]) < a for i, (a, _) in enumerate(part)]
        todo = range(at, min(n, at + LONG))
        for i, score in zip(todo, chain.scores([context(shapes, gaps, i - low) for i in todo])):
            if best is None:
                best = score + chain.move[0]
            else:
                through = best[:, None] + chain.move
                back[i] = through.argmax(0)
                best = through.max(0) + score
        at += LONG
    out, now = np.zeros(n, np.int8), int((best + chain.move[:, 0]).argmax())
    for i in range(n - 1, -1, -1):
        out[i], now = now, back[i, now]
    return out


def _labelled_spans(text: str, spans: list | np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """The labelled stretches that pass their kind's test."""
    for i in np.flatnonzero(labels % 2 == 1).tolist():  # B-x
        j = i + 1
        while j < len(labels) and labels[j] == labels[i] + 1:
            j += 1
        start, end, kind = int(spans[i][0]), int(spans[j - 1][1]), LABELS[labels[i]][2:]
        if added_passes(kind, text[start:end]):
            yield start, end, kind


def added_spans(texts: list[str], chain: Chain) -> list[list[tuple[int, int, str]]]:
    """What the field finds in each text, tested but not yet held against base spans.

    Short windows are decoded together in padded tables of at most CELLS tokens, long ones one by one.
    """
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    batch: list[tuple[int, list, list]] = []
    size = 0

    def decode():
        scores = chain.scores([c for _, _, about in batch for c in about])
        lengths = np.array([len(s) for _, s, _ in batch])
        order = np.argsort(lengths, kind="stable")
        first, at = np.concatenate(([0], np.cumsum(lengths))), 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and (upto + 1 - at) * lengths[order[upto]] <= CELLS:
                upto += 1
            part = order[at:upto]
            padded = np.zeros((len(part), lengths[part].max(), len(LABELS)))
            for r, w in enumerate(part):
                padded[r, : lengths[w]] = scores[first[w] : first[w + 1]]
            for w, labels in zip(part, viterbi(padded, lengths[part], chain.move)):
                t, spans, _ = batch[w]
                found[t] += _labelled_spans(texts[t], spans, labels[: lengths[w]])
            at = upto

    for t, text in enumerate(texts):
        for a, b in windows(text):
            spans = [m.span() for m in itertools.islice(_TOKEN.finditer(text, a, b), LONG + 1)]
            if len(spans) > LONG:
                flat = np.fromiter((x for m in _TOKEN.finditer(text, a, b) for x in m.span()), np.int64)
                found[t] += _labelled_spans(text, flat.reshape(-1, 2), _long_labels(text, flat.reshape(-1, 2), chain))
                continue
            batch.append((t, spans, _described(text, spans)))
            size += len(spans)
            if size > WAITING:
                decode()
                batch, size = [], 0
    if batch:
        decode()
    return found


def added_passes(kind: str, s: str) -> bool:
    """The test of a span that the field proposes."""
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+\s?(?:@|[\[(]\s?at\s?[\])])\s?[\w-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[\w-]+)+", s, re.I))
    if kind == "ip":
        parts = re.split(r"\s?[\[(]?\.[\])]?\s?", s)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits(s)) <= 19 and luhn(digits(s))
    return 9 <= len(digits(s)) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", s)) and bool(re.search(r"[ ().-]", s))


def all_spans(texts: list[str], chain: Chain) -> list[tuple[list, list]]:
    """For each text its base spans and the added ones, both as (start, end, kind)."""
    out = []
    for text, more in zip(texts, added_spans(texts, chain)):
        base = base_spans(text)
        extra: list[tuple[int, int, str]] = []
        taken, at, reached = sorted(base), 0, 0
        for s in sorted(more):
            while at < len(taken) and taken[at][0] < s[1]:  # base spans that begin before this one ends
                reached = max(reached, taken[at][1])
                at += 1
            if reached <= s[0] and (not extra or extra[-1][1] <= s[0]):
                extra.append(s)
        out.append((base, extra))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


SPANS = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def find(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, and all spans of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(chain or train())  # the size of the model does not depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = all_spans([t or "" for t in b.column(1).to_pylist()], sent.value)
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in got], pa.string())
            spans = pa.array([listed(base + extra) for base, extra in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, spans, pa.array([len(e) for _, e in got], pa.int64())], [c.split()[0] for c in SPANS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SPANS)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by <KIND>; where spans overlap, one mark for the stretch."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """docs, all columns, with personal data in text replaced and n_chars, if there is one, counted anew."""
    sent = docs.sparkSession.sparkContext.broadcast(chain or train())
    names, schema = docs.columns, docs.schema
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cols = b.column(at).to_pylist(), list(b.columns)
            new = [t if t is None else redacted(t, base + extra) for t, (base, extra) in zip(texts, all_spans([t or "" for t in texts], sent.value))]
            cols[at] = pa.array(new, b.column(at).type)
            if size is not None:
                changed = [len(n) if n is not None and n != t else c for n, t, c in zip(new, texts, b.column(size).to_pylist())]
                cols[size] = pa.array(changed, b.column(size).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)
