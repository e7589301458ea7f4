"""Personal data: fixed patterns, and what a linear-chain conditional random field over word shapes adds to them.

Tokens are runs of letters, runs of digits and single marks. Their features are shapes alone: case and length, digits of the number
they are part of and whether its check digit holds, and the shapes beside them; hashed, each has a weight per tag. The field is trained
on a small labelled table: a few written examples and a bounded sample of what the patterns find, and do not find, in the corpus, also
rewritten into forms that the patterns miss. It is decoded by Viterbi over many sequences at a time. A sequence is what stands within
`REACH` tokens of a digit, an `@` or the word `dot` on its line; elsewhere none of the four kinds is looked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytetext import LOWER_VALUE, Texts, mix, span_hash, texts_of

KINDS = ["email", "ip", "card", "phone"]
TAGS = 1 + 2 * len(KINDS)  # 0 outside; 1 + 2 k begins kind k, 2 + 2 k goes on with it
SAMPLE = 120  # snippets of each kind, and of none, that the field learns from
REACH = 6
BUCKETS = 1 << 15
ROUNDS = 60
CELLS = 1 << 18  # tokens decoded at a time

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Written examples: what a kind looks like, and what only resembles it.
EXAMPLES = [
    "write to {email:mara.lind@mail.example.org} for more", "mail {email:k_ode77@post.example.com}, please", "reach {email:jo at example dot org} or not",
    "send it to {email:ana.b at mail dot example dot com} today", "the host {ip:10.24.7.201} was down", "from {ip:192.168.0.14} to {ip:172.16.254.3}",
    "paid with {card:4012 8888 8888 1881} yesterday", "card {card:5555555555554444} was used", "number {card:4111.1111.1111.1111} on file",
    "call {phone:+44 20 7946 0958} before noon", "phone {phone:(201) 555-0123} or", "ring {phone:201-555-0147} tonight", "tel {phone:+1 (743) 555-0199} now",
    "or call {phone:(640) 555-0116} instead", "mobile {phone:(312) 555-0175}, evenings", "fax {phone:718-555-0132}; desk {phone:(929) 555-0108}",
    "in 2023 there were 1500 of 12,000", "version 4.0 and 3.1.2 came", "order 8271 6643 9127 0034 shipped", "at 10:30 on 12.05.2021 near", "section 4.2.1.7.3 of part 12",
    "token = \"9c41e6d20b7f\" is set", "see @chapter 4 and page 117-119", "id 4929884416273302 failed", "the dot at 5 is a point", "300.400.500.600 is none",
]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find: leftmost non-overlapping per kind, failing ones dropped, none tried again."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at  # a match holds one @, so its local part is the run before it
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            found.append((start, 0, end))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- tokens and their shapes ---------------------------------------------------------------------

LETTER, DIGIT, SPACE, MARK = range(4)
CLASS = np.full(256, MARK, np.int8)
CLASS[0x80:] = LETTER
for _low, _high, _class in (("A", "Z", LETTER), ("a", "z", LETTER), ("0", "9", DIGIT)):
    CLASS[ord(_low) : ord(_high) + 1] = _class
CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
_WORDS = [span_hash(LOWER_VALUE[np.frombuffer(w, np.uint8)], np.array([0]), np.array([len(w)]))[0] for w in (b"at", b"dot")]


def _dots(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The word `dot`, in any case."""
    out = end - start == 3
    at = start[out]
    out[out] = (data[at] | 32 == ord("d")) & (data[at + 1] | 32 == ord("o")) & (data[at + 2] | 32 == ord("t"))
    return out


@dataclass
class Tokens:
    """Tokens of the sequences in a slice: begin and end byte, text, first token of each sequence, and hashed features."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray
    features: np.ndarray


def tokens_of(texts: Texts) -> Tokens:
    data = texts.data
    kind = CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[texts.offsets] = True
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == MARK)
    change |= edge
    cuts = np.flatnonzero(change)
    start, end = cuts[:-1], cuts[1:]
    solid = kind[start] != SPACE if len(start) else np.zeros(0, bool)
    start, end = start[solid], end[solid]
    signal = np.flatnonzero((kind[start] == DIGIT) | (data[start] == ord("@")) | _dots(data, start, end)) if len(start) else np.zeros(0, np.int64)
    text = np.searchsorted(texts.offsets, start, "right") - 1
    line = np.concatenate([[0], np.cumsum(data == 0x0A)])[start] + text  # a sequence stays on its line
    near = np.zeros(len(start) + 1, np.int64)
    np.add.at(near, np.maximum(signal - REACH, np.searchsorted(line, line[signal])), 1)
    np.add.at(near, np.minimum(signal + REACH + 1, np.searchsorted(line, line[signal], "right")), -1)
    held = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    start, end, text, line = start[held], end[held], text[held], line[held]
    begins = np.ones(len(held), bool)
    begins[1:] = (np.diff(held) > 1) | (np.diff(line) > 0)
    first = np.append(np.flatnonzero(begins), len(held))
    return Tokens(start, end, text, first, _features(data, start, end, kind[start] if len(start) else kind[:0], begins))


def _numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For digit tokens: a code of the number they are part of, its parts set apart by one space, dot or dash."""
    gap = np.where(end[:-1] + 1 == start[1:], data[np.minimum(end[:-1], len(data) - 1)], 0)
    goes_on = np.zeros(len(start), bool)
    goes_on[1:] = np.isin(gap, [0x20, 0x2D, 0x2E]) & ~begins[1:]
    number = np.cumsum(~goes_on) - 1
    size = end - start
    upto = np.concatenate([[0], np.cumsum(size)])
    digit = data[np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)].astype(np.int64) - 48
    of = np.repeat(number, size)
    many = np.bincount(of)
    place = np.cumsum(many)[of] - 1 - np.arange(len(of))
    double = digit * (1 + place % 2)
    holds = np.bincount(of, double - 9 * (double > 9)).astype(np.int64) % 10 == 0
    parts = np.bincount(number)
    dots = np.bincount(number[1:], (goes_on[1:] & (gap == 0x2E)).astype(float), minlength=len(parts)).astype(np.int64)
    code = ((np.minimum(many, 20) * 2 + ((many >= 12) & holds)) * 8 + np.minimum(parts, 6)) * 3 + np.where(dots == 0, 0, np.where(dots == parts - 1, 1, 2))
    return code[number] + 1


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    n = len(start)
    if not n:
        return np.zeros((0, 9), np.int64)
    size = end - start
    shape = 400 + data[start].astype(np.int64)  # a mark is its own shape
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    uppers = upper[end] - upper[start]
    case = np.where(uppers == 0, 0, np.where(uppers == size, 1, np.where((uppers == 1) & (data[start] <= 90), 2, 3)))
    letters = kind == LETTER
    shape[letters] = (np.searchsorted([2, 3, 4, 7], size, "right") * 4 + case)[letters]
    short = np.flatnonzero(letters & (size <= 3))
    word = span_hash(LOWER_VALUE[data], start[short], end[short])
    for i, known in enumerate(_WORDS):
        shape[short[word == known]] = 50 + i
    digits = np.flatnonzero(kind == DIGIT)
    value = np.full(len(digits), 999)
    three = digits[size[digits] <= 3]
    value[size[digits] <= 3] = sum(np.where(size[three] > j, (data[np.maximum(end[three] - 1 - j, 0)].astype(np.int64) - 48) * 10**j, 0) for j in range(3))
    shape[digits] = 100 + np.minimum(size[digits], 20) * 2 + (value > 255)
    number = np.zeros(n, np.int64)
    if len(digits):
        breaks = np.cumsum(begins)[digits]
        number[digits] = _numbers(data, start[digits], end[digits], np.concatenate([[True], np.diff(breaks) > 0]))

    def beside(values: np.ndarray, step: int) -> np.ndarray:
        out = np.full(n, 999)
        seq = np.cumsum(begins)
        if n > abs(step):
            a, b = (slice(step, None), slice(None, -step)) if step < 0 else (slice(None, -step), slice(step, None))
            a, b = (slice(-step, None), slice(None, step)) if step < 0 else (a, b)
            same = seq[a] == seq[b]
            out[a] = np.where(same, values[b], 999)
        return out

    glued = np.zeros(n, np.int64)
    glued[1:] = (start[1:] == end[:-1]) & ~begins[1:]
    after = beside(glued, 1)
    before, behind = beside(shape, -1), beside(shape, 1)
    parts = [
        (shape, glued, after), (before, glued), (behind, after), (before, shape, behind), (number, beside(number, -1) == number), (number, shape),
        (beside(shape, -2), shape), (beside(shape, 2), shape), (beside(number, -1), beside(number, 1), shape),
    ]
    out = np.empty((n, len(parts)), np.int64)
    for j, part in enumerate(parts):
        h = np.full(n, j + 1, np.uint64)
        for x in part:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64))
        out[:, j] = (h % np.uint64(BUCKETS)).astype(np.int64)
    return out


# --- the field -------------------------------------------------------------------------------------

# What may follow what: kind k goes on only behind itself; a sequence cannot begin inside a kind.
FOLLOWS = np.zeros((TAGS, TAGS), bool)
FOLLOWS[:, [0, *range(1, TAGS, 2)]] = True
for _k in range(len(KINDS)):
    FOLLOWS[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True
BARRED = np.where(FOLLOWS, 0.0, -1e9)
OPENS = np.where([t == 0 or t % 2 for t in range(TAGS)], 0.0, -1e9)


@dataclass
class Field:
    weights: np.ndarray  # BUCKETS x TAGS
    moves: np.ndarray  # TAGS x TAGS


def _padded(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token of each (sequence, step), and which steps there are."""
    size = np.diff(first)
    steps = np.arange(size.max())
    there = steps < size[:, None]
    return np.where(there, first[:-1, None] + steps, 0), there


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def train(features: np.ndarray, tags: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Maximum likelihood with a small quadratic penalty by full gradients (forward-backward) and adaptive steps."""
    used, ids = np.unique(features, return_inverse=True)
    ids = ids.reshape(features.shape)
    at, there = _padded(first)
    b, t = at.shape
    w, moves = np.zeros((len(used), TAGS)), np.zeros((TAGS, TAGS))
    gold_w, gold_moves = np.zeros_like(w), np.zeros_like(moves)
    for j in range(ids.shape[1]):
        np.add.at(gold_w, (ids[:, j], tags), 1.0)
    inner = np.ones(len(tags), bool)
    inner[first[:-1]] = False
    inside = np.flatnonzero(inner)
    np.add.at(gold_moves, (tags[inside - 1], tags[inside]), 1.0)
    seen = [np.zeros_like(w), np.zeros_like(moves)]
    for _ in range(rounds):
        emit = w[ids].sum(1)[at]
        trans = moves + BARRED
        alpha, beta = np.zeros((t, b, TAGS)), np.zeros((t, b, TAGS))
        alpha[0] = emit[:, 0] + OPENS
        for s in range(1, t):
            alpha[s] = np.where(there[:, s, None], _logsum(alpha[s - 1][:, :, None] + trans, 1) + emit[:, s], alpha[s - 1])
        for s in range(t - 2, -1, -1):
            beta[s] = np.where(there[:, s + 1, None], _logsum(trans + (emit[:, s + 1] + beta[s + 1])[:, None, :], 2), beta[s + 1])
        whole = _logsum(alpha[-1], 1)
        share = np.exp(alpha + beta - whole[None, :, None]).transpose(1, 0, 2)[there]
        place = at[there]
        expect = np.zeros_like(w)
        for j in range(ids.shape[1]):
            np.add.at(expect, ids[place, j], share)
        pair = np.zeros_like(moves)
        for s in range(1, t):
            on = there[:, s]
            pair += np.exp(alpha[s - 1][on][:, :, None] + trans + (emit[on, s] + beta[s][on])[:, None, :] - whole[on, None, None]).sum(0)
        for x, g, total in ((w, gold_w - expect - 0.05 * w, seen[0]), (moves, gold_moves - pair - 0.05 * moves, seen[1])):
            total += g * g
            x += 0.5 * g / np.sqrt(total + 1e-8)
    weights = np.zeros((BUCKETS, TAGS))
    weights[used] = w
    return Field(weights, moves)


def decode(field: Field, tokens: Tokens) -> np.ndarray:
    """The likeliest tag of every token (Viterbi), sequences of like length together."""
    tags = np.zeros(len(tokens.start), np.int8)
    size = np.diff(tokens.first)
    order = np.argsort(size, kind="stable")
    trans = field.moves + BARRED
    lo = 0
    while lo < len(order):
        cells = size[order[lo:]] * np.arange(1, len(order) - lo + 1)
        hi = lo + max(1, int(np.searchsorted(cells, CELLS, "right")))
        some = order[lo:hi]
        steps = int(size[some[-1]])
        there = np.arange(steps) < size[some][:, None]
        at = np.where(there, tokens.first[some][:, None] + np.arange(steps), tokens.first[some][:, None])
        score = field.weights[tokens.features[at[:, 0]]].sum(1) + OPENS
        back = np.empty((steps, len(some), TAGS), np.int8)
        for s in range(1, steps):
            ways = score[:, :, None] + trans
            back[s] = ways.argmax(1)
            score = np.where(there[:, s, None], ways.max(1) + field.weights[tokens.features[at[:, s]]].sum(1), score)
        tag = score.argmax(1)
        for s in range(steps - 1, -1, -1):
            on = there[:, s]
            tags[at[on, s]] = tag[on]
            if s:
                tag = np.where(on, back[s][np.arange(len(some)), tag], tag)
        lo = hi
    return tags


def _likely(kind: int, said: str) -> bool:
    """What the kind asks of any form: enough digits, a check digit that holds, four bytes, a host."""
    digits = re.sub(r"[^0-9]", "", said)
    if kind == 0:
        return ("@" in said or re.search(r"\bat\b", said, re.I) is not None) and ("." in said or re.search(r"\bdot\b", said, re.I) is not None)
    if kind == 1:
        parts = re.findall(r"[0-9]+", said)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def tagged_spans(tokens: Tokens, tags: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, begin byte, kind, end byte) of every run of one kind."""
    out = []
    heads = np.flatnonzero((tags > 0) & (tags % 2 == 1))
    for i in heads:
        j = i + 1
        while j < len(tags) and tags[j] == tags[i] + 1:
            j += 1
        out.append((int(tokens.text[i]), int(tokens.start[i]), int(tags[i] - 1) // 2, int(tokens.end[j - 1])))
    return out


# --- the labelled table ----------------------------------------------------------------------------


def _signals(texts: Texts) -> np.ndarray:
    """Texts with a digit or @: in no others do the patterns find anything."""
    hits = np.concatenate([[0], np.cumsum((CLASS[texts.data] == DIGIT) | (texts.data == ord("@")))])
    return np.flatnonzero(np.diff(hits[texts.offsets]))


def _snippet(text: str, start: int, end: int) -> str:
    """The span with some 60 characters of its line around it, cut at spaces."""
    line = text.rfind("\n", 0, start) + 1
    stop = text.find("\n", end)
    stop = len(text) if stop < 0 else stop
    lo = line if start - line <= 60 else text.find(" ", start - 60, start) + 1 or start
    hi = stop if stop - end <= 60 else max(text.rfind(" ", end, end + 60), end)
    return text[lo:hi]


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, order, snippet): the first few by hash of each kind, and of numbers that are none, of a batch."""
    for batch in batches:
        best: list[dict[str, int]] = [{} for _ in range(len(KINDS) + 1)]
        for texts in texts_of(batch.column(0)):
            for i in _signals(texts):
                text = batch.column(0)[texts.lo + i].as_py()
                found = base_spans(text)
                taken = [(a, e) for a, _, e in found]
                found += [(m.start(), len(KINDS), m.end()) for m in re.finditer(r"[0-9@][0-9.@-]*", text) if not any(a < m.end() and m.start() < e for a, e in taken)][:20]
                for start, kind, end in found:
                    if end - start <= 80:
                        snippet = _snippet(text, start, end)
                        best[kind][snippet] = int.from_bytes(hashlib.sha256(snippet.encode()).digest()[:7], "big")
        for kind, seen in enumerate(best):
            rows = sorted(seen.items(), key=lambda x: (x[1], x[0]))[:SAMPLE]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.string())], ["kind", "nth", "text"])


def _unsure(text: str, spans: list[tuple[int, int, int]]) -> bool:
    """Whether it holds what may be a form that the patterns miss: that is no example of anything."""
    rest = "".join(" " if any(a <= i < e for a, _, e in spans) else c for i, c in enumerate(text))
    return any(_likely(kind, m[0]) for m in re.finditer(r"[0-9][0-9\x20().-]*[0-9]", rest) for kind in (1, 2, 3)) or _likely(0, rest)


def _forms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """The snippet, and as it reads with each span in a form that the patterns miss."""
    yield text, spans
    for i in range(2):
        out, found, at = "", [], 0
        for start, kind, end in spans:
            said = text[start:end]
            if kind == 0:
                said = said.replace("@", " at ").replace(".", " dot ") if i == 0 else said.replace("@", " at ")
            elif kind == 2:
                digits = said.replace(" ", "").replace("-", "")
                said = (" ", ".")[i].join(digits[j : j + 4] for j in range(0, len(digits), 4))
            elif kind == 3:
                local = re.sub(r"^\+[0-9]{1,2}[ .-]?", "", said)
                said = local if i == 0 else "-".join(re.findall(r"[0-9]+", local))
                if not 9 <= len(re.sub(r"[^0-9]", "", said)) <= 15:
                    said = text[start:end]
            out += text[at:start]
            found.append((len(out), kind, len(out) + len(said)))
            out, at = out + said, end
        if (out + text[at:]) != text:
            yield out + text[at:], found


def examples() -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The written examples as texts with spans."""
    out = []
    for marked in EXAMPLES:
        text, spans = "", []
        for part in re.split(r"(\{[a-z]+:[^}]*\})", marked):
            held = re.fullmatch(r"\{([a-z]+):([^}]*)\}", part)
            if held:
                spans.append((len(text), KINDS.index(held[1]), len(text) + len(held[2])))
            text += held[2] if held else part
        out.append((text, spans))
    return out


def learn(labelled: list[tuple[str, list[tuple[int, int, int]]]]) -> Field:
    """The field of a table of texts and their (start, kind, end) spans in code points."""
    features, tags, first = [], [], [np.zeros(1, np.int64)]
    for texts in texts_of(pa.array([t for t, _ in labelled], pa.large_string()), 1 << 62):
        tokens = tokens_of(texts)
        tag = np.zeros(len(tokens.start), np.int64)
        place = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
        begin, end = place[tokens.start] - place[texts.offsets[tokens.text]], place[tokens.end] - place[texts.offsets[tokens.text]]
        lo = np.searchsorted(tokens.text, np.arange(len(labelled) + 1))
        for i, (_, spans) in enumerate(labelled):
            for start, kind, stop in spans:
                inside = np.flatnonzero((begin[lo[i] : lo[i + 1]] >= start) & (end[lo[i] : lo[i + 1]] <= stop)) + lo[i]
                tag[inside] = 2 + 2 * kind
                tag[inside[:1]] = 1 + 2 * kind
        opened = tokens.first[:-1]
        tag[opened] -= (tag[opened] > 0) & (tag[opened] % 2 == 0)  # a kind that began before its sequence begins with it
        features.append(tokens.features)
        tags.append(tag)
        first.append(tokens.first[1:] + first[-1][-1])
    return train(np.concatenate(features), np.concatenate(tags), np.concatenate(first))


def labelled_table(docs: DataFrame, text_col: str = "text") -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most SAMPLE snippets of every kind and of none, by hash, labelled by the patterns, with other forms of theirs; and EXAMPLES.

    Snippets that may hold what the patterns miss are left out, or the field would learn that it is nothing."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_snippets, "kind int, nth long, text string").distinct()
    first = Window.partitionBy("kind").orderBy("nth", "text")
    rows = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= SAMPLE).orderBy("kind", "place").select("text").collect()
    table = dict.fromkeys(r.text for r in rows)
    return examples() + [form for text in table if not _unsure(text, base_spans(text)) for form in _forms(text, base_spans(text))]


# --- the operator ----------------------------------------------------------------------------------


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                n = texts.hi - texts.lo
                counts = np.zeros((n, len(KINDS)), np.int64)
                hashes, written, added = [nothing] * n, [""] * n, np.zeros(n, np.int64)
                tokens = tokens_of(texts)
                more: dict[int, list[tuple[int, int, int]]] = {}
                for i, start, kind, end in tagged_spans(tokens, decode(field, tokens)):
                    more.setdefault(i, []).append((start, kind, end))
                for i in sorted({*_signals(texts).tolist(), *more}):
                    raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
                    text = raw.decode()
                    base = base_spans(text)
                    for _, kind, _ in base:
                        counts[i, kind] += 1
                    hashes[i] = hashlib.sha256(_written(base).encode()).hexdigest()
                    both = list(base)
                    if i in more:
                        place = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                        ends = np.array([0, *np.maximum.accumulate([e for _, _, e in base])]) if base else np.zeros(1, np.int64)
                        starts = np.array([s for s, _, _ in base], np.int64)
                        for start, kind, end in more[i]:
                            lo, hi = int(place[start - texts.offsets[i]]), int(place[end - texts.offsets[i]])
                            if ends[np.searchsorted(starts, hi)] <= lo and _likely(kind, text[lo:hi]):
                                both.append((lo, kind, hi))
                    added[i] = len(both) - len(base)
                    written[i] = _written(sorted(both))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.lo, n), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(hashes), pa.array(written), pa.array(added)],
                    ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    return run


def find_personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added` for every row.

    The counts and the hash are of what the patterns find (`base_spans`); `spans` also has the n_added ones that the field finds
    and that touch no pattern's span. Spans read `kind:start:end` in code points, end exclusive, by start and then kind. A field that is
    not given is learned from `labelled_table(docs)`. Null and empty texts hold nothing; repeated rows and rows without an id stay rows of
    their own; other columns are ignored. An empty table gives no rows.
    """
    field = field or learn(labelled_table(docs, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    columns = ", ".join(f"n_{k} long" for k in KINDS)
    found = rows.mapInArrow(_find(shared), f"id {docs.schema[id_col].dataType.simpleString()}, {columns}, base_sha256 string, spans string, n_added long")
    return found.withColumnRenamed("id", id_col)
