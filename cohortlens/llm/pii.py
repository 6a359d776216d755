"""Personal data by a semi-Markov conditional random field.

Fixed patterns give the base spans: emails, IPv4 addresses, card numbers that pass
Luhn's test, international phone numbers. The field finds further spans that are
written in other ways. Around digits, ``@`` signs and the word "at" a text is cut into windows and
those into tokens (letters, digits, single signs, spaces). A candidate segment of at
most ``LONGEST`` tokens is scored as a whole for each kind: by its shape, its number
of digits, checks on its digits, and what stands beside it. Dynamic programming over
the tokens chooses boundaries and kinds together; all other tokens stand alone as
"outside". Time is linear in the text, as segments are bounded.

Training maximises the likelihood of windows whose base spans are known. Windows are
drawn from all texts: for each kind of base span, and without any, the ``sample`` of
them with the smallest hashes, so that a rare kind is learned too. Each is also shown with
its spans rewritten in fixed other ways (an email with " at ", a phone number without
country code), both as they are and with other letters, digits and lengths, so that the
field learns the ways and not the names. Long windows are searched in stretches.

Result: all base spans, and those of the field that overlap none.

Defined cases: a missing or empty text has no spans; repeated rows have equal
results; with nothing to learn from, only base spans are found.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.text import parts

KINDS = ("email", "ip", "card", "phone")
LONGEST, WIDEST = 16, 64
#: windows with varied spans that training makes for a kind, and at most from one window
VARIED, MOST_VARIED = 120, 12
#: a window is searched in stretches of so many characters, each with ``MARGIN`` more on either side
STRETCH = 4000
#: characters on either side of a trigger: the widest candidate that can hold it, and context
MARGIN = WIDEST + 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: a match starts where its digits start, as more digits before would belong to it
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: what a candidate must hold: a digit, an at sign, or the word "at" as a token of its own
_TRIGGER = re.compile(r"[0-9@]+|(?<![^\W\d_])[Aa][Tt](?![^\W\d_])")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping within each kind."""
    out: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # leading zeros don't count
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 16:
                continue
            digits = _NO_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers; neighbours that touch are one. A candidate that holds a trigger lies inside."""
    lo = hi = -1
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if a <= hi:
            hi = b
            continue
        if hi >= 0:
            yield lo, hi
        lo, hi = a, b
    if hi >= 0:
        yield lo, hi


def pieces(text: str, longest: int) -> list[str]:
    """The windows, cut where they are over ``longest`` characters: at a space if there is one, never inside a base span."""
    spans = sorted(((a, b) for _, a, b in base_spans(text)), reverse=True)
    out = []
    for lo, hi in windows(text):
        while hi - lo > longest:
            at = lo + longest
            at = max(at - longest // 2, text.rfind(" ", lo, at)) if " " in text[at - longest // 2 : at] else at
            for a, b in spans:
                if a < at < b:
                    at = a
            if at <= lo:
                at = max(b for a, b in spans if a <= lo < b)
                while inside := [b for a, b in spans if a < at < b]:
                    at = max(inside)
            if at >= hi:
                break
            out.append(text[lo:at])
            lo = at
        out.append(text[lo:hi])
    return out


def _size(n: int) -> str:
    return str(n) if n <= 4 else "5" if n <= 8 else "9" if n <= 11 else "12" if n <= 15 else "16" if n <= 19 else "20"


def _beside(c: str) -> str:
    return "." if not c else "s" if c.isspace() else "d" if c.isdigit() else "a" if c.isalpha() else c if c.isascii() else "x"


@dataclass
class Segments:
    """Candidate segments of a window: token range and features of each; ``-1`` marks a single outside token."""

    tokens: list[tuple[int, int]]
    spans: list[tuple[int, int]]
    features: list[list[str]]
    outside: list[list[str]]


def segments(text: str) -> Segments:
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    words = [text[a:b] for a, b in tokens]
    kinds = ["D" if w[0].isdigit() and w.isascii() else "A" if w[0].isalpha() else "_" if w[0].isspace() else w if w.isascii() else "x" for w in words]
    fine = [k + _size(len(w)) if k == "D" else w.lower() if k == "A" and w.lower() in ("at", "dot") else k for k, w in zip(kinds, words, strict=True)]
    spans, features = [], []
    for i, first in enumerate(kinds):
        if first not in "DA+([":
            continue
        shape = exact = digits = ""
        marked = False
        for j in range(i, min(i + LONGEST, len(tokens))):
            if "\n" in words[j] or tokens[j][1] - tokens[i][0] > WIDEST:
                break
            shape += kinds[j] if kinds[j] != "D" else "D"
            exact += fine[j] + " "
            if kinds[j] == "D":
                digits += words[j]
            marked = marked or words[j] == "@" or fine[j] == "at"
            if kinds[j] not in "DA" or not (marked or len(digits) >= 4):
                continue
            n = len(digits)
            parts = [words[k] for k in range(i, j + 1) if kinds[k] == "D"]
            own = [f"shape {shape}", f"exact {exact}", f"digits {_size(n)}", f"marked {marked}",
                   f"left {_beside(text[tokens[i][0] - 1] if i else '')}", f"right {_beside(text[tokens[j][1]] if j + 1 < len(tokens) else '')}",
                   f"first {first}", f"letters {'A' in shape}"]
            if marked:
                sign = "@" if "@" in shape else "at"
                own += [f"{sign} ends {''.join(kinds[j - 1 : j + 1])}", f"{sign} letters first {first == 'A'} digits {n > 0}"]
            if 16 <= n <= 19:
                own.append(f"luhn {luhn(digits)} {'A' in shape}")
            if len(parts) == 4 and "A" not in shape:
                own.append(f"bytes {all(len(p) <= 3 and int(p) <= 255 for p in parts)} {shape}")
            if j + 2 < len(tokens) and kinds[j + 1] in "-._@" and kinds[j + 2] in "DA":
                own.append(f"goes on {kinds[j + 1]}{kinds[j + 2]}")
            if i >= 2 and kinds[i - 1] in "-.@_+" and kinds[i - 2] in "DA":
                own.append(f"went on {kinds[i - 2]}{kinds[i - 1]}")
            spans.append((i, j + 1))
            features.append(own)
    outside = [[f"out {f}", f"out {k}"] for f, k in zip(fine, kinds, strict=True)]
    return Segments(tokens, spans, features, outside)


@dataclass(frozen=True)
class Field:
    """Weights by feature name: a row for each kind, and one number for outside tokens."""

    segment: dict[str, np.ndarray]
    outside: dict[str, float]

    def find(self, text: str) -> list[tuple[int, int, int]]:
        s = segments(text)
        if not s.spans:
            return []
        nothing = np.zeros(len(KINDS))
        n = len(s.tokens)
        ending: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for (i, j), own in zip(s.spans, s.features, strict=True):
            score = sum((self.segment.get(f, nothing) for f in own), nothing)
            kind = int(score.argmax())
            ending[j].append((i, float(score[kind]), kind))
        best, back = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1] + sum(self.outside.get(f, 0.0) for f in s.outside[j - 1])
            back[j] = (j - 1, -1)
            for i, score, kind in ending[j]:
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, kind)
        found, j = [], n
        while j > 0:
            i, kind = back[j]
            if kind >= 0:
                found.append((kind, s.tokens[i][0], s.tokens[j - 1][1]))
            j = i
        return found[::-1]


def all_spans(text: str, field: Field | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans with those of the field that overlap none; by kind and start."""
    base = sorted(base_spans(text))
    spans = list(base)
    if field is not None:
        taken = sorted((a, b) for _, a, b in base)
        reach = list(accumulate((b for _, b in taken), max))
        for lo, hi in windows(text):
            for kind, a, b in found_in(text, lo, hi, field):
                # a span at a window's cut may be part of something longer
                cut = a == lo and lo > 0 or b == hi and hi < len(text)
                before = bisect_left(taken, (b, 0))
                # of the base spans that begin before this one ends, does any reach into it?
                if not cut and not (before and reach[before - 1] > a):
                    spans.append((kind, a, b))
    return base, sorted(set(spans))


def found_in(text: str, lo: int, hi: int, field: Field) -> Iterator[tuple[int, int, int]]:
    """The field's spans in a window, stretch by stretch; a span belongs to the stretch that it starts in."""
    done = lo
    for begin in range(lo, hi, STRETCH):
        first = max(lo, begin - MARGIN)
        for kind, a, b in field.find(text[first : min(hi, begin + STRETCH + MARGIN)]):
            a, b = a + first, b + first
            if begin <= a < begin + STRETCH and a >= done:
                yield kind, a, b
                done = b


def _other_ways(kind: int, span: str) -> list[str]:
    """A span in ways that the fixed patterns don't take."""
    digits = _NO_DIGIT.sub("", span)
    if kind == 0:
        local, _, domain = span.rpartition("@")
        return [f"{local} at {domain}", f"{local} [at] {domain}", f"{local}(at){domain}",
                f"{local} at {domain.replace('.', ' dot ')}", f"{local} @ {domain}"]
    if kind == 1:
        parts = span.split(".")
        return ["[.]".join(parts), " . ".join(parts)]
    if kind == 2:
        fours = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return [".".join(fours), "/".join(fours), "_".join(fours)]
    if len(digits) < 10:
        return []
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"001 {a} {b} {c}", f"1-{a}-{b}-{c}"]


def _draws(turn: int, span: str) -> Iterator[int]:
    """Numbers that follow from a span and a turn."""
    state = int.from_bytes(hashlib.sha256(f"{turn}:{span}".encode()).digest()[:8], "big")
    while True:
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        yield state >> 33


def _word(draw: Iterator[int], least: int, most: int) -> str:
    return "".join(chr(97 + next(draw) % 26) for _ in range(least + next(draw) % (most - least + 1)))


def _varied(kind: int, turn: int, span: str) -> str:
    """A span of the same kind with other letters, digits and lengths, so that shapes are learned and not names."""
    draw = _draws(turn, span)
    if kind == 0:
        local = [_word(draw, 2, 9) for _ in range(1 + next(draw) % 3)]
        if next(draw) % 3 == 0:
            local[-1] += str(next(draw) % 10 ** (1 + next(draw) % 4))
        domain = [_word(draw, 2, 10) for _ in range(1 + next(draw) % 3)] + [_word(draw, 2, 4)]
        if next(draw) % 4 == 0:
            domain[0] += str(next(draw) % 100)
        return "._-."[next(draw) % 4].join(local) + "@" + ".".join(domain)
    if kind == 1:
        return ".".join(str(next(draw) % 256) for _ in range(4))
    if kind == 2:
        digits = "".join(str(next(draw) % 10) for _ in range(15))
        return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))
    return "+" + str(1 + next(draw) % 99) + "".join(str(next(draw) % 10) for _ in range(10))


def _harmless(turn: int, span: str) -> str:
    """Digits of a span as something that isn't personal: a date, a time, a version, an amount, a range of years.

    A span without digits has those of its characters' codes instead.
    """
    d = ((_NO_DIGIT.sub("", span) or "".join(str(ord(c)) for c in span)) * 16)[:16]
    month, day = f"{int(d[2:4]) % 12 + 1:02d}", f"{int(d[4:6]) % 28 + 1:02d}"
    ways = [f"19{d[:2]}-{month}-{day}", f"{int(d[:2]) % 24:02d}:{int(d[2:4]) % 60:02d}", f"{d[0]}.{d[1]}.{d[2]}", f"{d[0]},{d[1:4]},{d[4:7]}",
            f"20{d[:2]}-20{d[2:4]}", f"{day}.{month}.20{d[:2]}", d[:7], f"{d[0]}.{d[1:3]} of {d[3]}:{d[4:6]}", f"{d[:4]} of {d[4:8]}", f"{d[:3]} at {d[3:6]}",
            d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10), f"{d[0]}.{d[1]}.{d[2]}.{d[3]}.{d[4]}", f"{day}/{month}/19{d[:2]} {d[2]}:{d[3:5]}"]
    return ways[turn % len(ways)]


def training_windows(rows: list[str]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Each window with its base spans, twice with them written in other ways, once with harmless numbers instead, and
    with other spans of the same kinds in other ways: twice, or more often for a kind that few windows have."""
    out = []
    bases = [sorted(base_spans(text), key=lambda s: s[1]) for text in rows]
    windows_with = [sum(any(kind == k for k, _, _ in base) for base in bases) for kind in range(len(KINDS))]
    for turn, (text, base) in enumerate(zip(rows, bases, strict=True)):
        if any(b[1] < a[2] for a, b in zip(base, base[1:], strict=False)):
            continue  # overlapping kinds can't be one segmentation
        out.append((text, base))
        if not base:
            continue
        rarest = min(windows_with[kind] for kind, _, _ in base)
        for more in range(3 + max(2, min(MOST_VARIED, VARIED // rarest))):
            new, gold, at = "", [], 0
            for kind, a, b in base:
                span = text[a:b] if more < 3 else _varied(kind, more, text[a:b])
                ways = _other_ways(kind, span) or [span]
                way = ways[(turn * 2 + more) % len(ways)]
                if more == 2:
                    new += text[at:a] + _harmless(turn, text[a:b])
                    at = b
                    continue
                new += text[at:a]
                gold.append((kind, len(new), len(new) + len(way)))
                new += way
                at = b
            out.append((new + text[at:], gold))
    return out


def fit_field(rows: list[str], *, epochs: int = 6, rate: float = 0.5, shrink: float = 1e-3, seed: int = 3) -> Field | None:
    """Maximum-likelihood weights by stochastic gradient ascent; the gradient comes from forward and backward sums."""
    names: dict[str, int] = {}
    out_names: dict[str, int] = {}
    cases = []
    for text, gold in training_windows(rows):
        s = segments(text)
        if not s.spans:
            continue
        at = {(s.tokens[i][0], s.tokens[j - 1][1]): k for k, (i, j) in enumerate(s.spans)}
        if any((a, b) not in at for _, a, b in gold):
            continue
        truth = {at[(a, b)]: kind for kind, a, b in gold}
        index = [np.array([names.setdefault(f, len(names)) for f in own]) for own in s.features]
        outside = np.array([[out_names.setdefault(f, len(out_names)) for f in own] for own in s.outside])
        covered = np.zeros(len(s.tokens), bool)
        for k in truth:
            covered[slice(*s.spans[k])] = True
        cases.append((np.array(s.spans), index, outside, truth, covered))
    if not any(c[3] for c in cases):
        return None
    w, v = np.zeros((len(names), len(KINDS))), np.zeros(len(out_names))
    w_sum, v_sum = np.full_like(w, 1e-6), np.full_like(v, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(cases)):
            spans, index, outside, truth, covered = cases[k]
            n = len(outside)
            flat = np.concatenate(index)
            owner = np.repeat(np.arange(len(index)), [len(x) for x in index])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            score = np.add.reduceat(w[flat], first, axis=0)
            top = score.max(1)
            both = top + np.log(np.exp(score - top[:, None]).sum(1))
            out = v[outside].sum(1)
            by_end: list[list[int]] = [[] for _ in range(n + 1)]
            by_start: list[list[int]] = [[] for _ in range(n + 1)]
            for m, (i, j) in enumerate(spans):
                by_end[j].append(m)
                by_start[i].append(m)
            ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
            for j in range(1, n + 1):
                terms = np.r_[ahead[j - 1] + out[j - 1], ahead[spans[by_end[j], 0]] + both[by_end[j]]] if by_end[j] else None
                ahead[j] = ahead[j - 1] + out[j - 1] if terms is None else terms.max() + np.log(np.exp(terms - terms.max()).sum())
            for i in range(n - 1, -1, -1):
                terms = np.r_[behind[i + 1] + out[i], behind[spans[by_start[i], 1]] + both[by_start[i]]] if by_start[i] else None
                behind[i] = behind[i + 1] + out[i] if terms is None else terms.max() + np.log(np.exp(terms - terms.max()).sum())
            chance = np.exp(ahead[spans[:, 0]] + both + behind[spans[:, 1]] - ahead[n])[:, None] * np.exp(score - both[:, None])
            step = -chance
            for m, kind in truth.items():
                step[m, kind] += 1
            step_out = (~covered).astype(float) - np.exp(ahead[:-1] + out + behind[1:] - ahead[n])
            g = np.zeros_like(w)
            np.add.at(g, flat, step[owner])
            used = np.unique(flat)
            g = g[used] - shrink * w[used]
            w_sum[used] += g * g
            w[used] += rate * g / np.sqrt(w_sum[used])
            h = np.zeros_like(v)
            np.add.at(h, outside.ravel(), np.repeat(step_out, outside.shape[1]))
            h -= shrink * v
            v_sum += h * h
            v += rate * h / np.sqrt(v_sum)
    return Field({f: w[k] for f, k in names.items()}, {f: float(v[k]) for f, k in out_names.items()})


def _windows_of(docs: DataFrame, text: str, longest: int) -> DataFrame:
    """``part`` and ``kind``: a window for each kind of base span that it has, or once with kind -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found: list[tuple[str, int]] = []
            for t in batch.column("text"):
                for part in pieces(t.as_py() or "", longest):
                    found.extend((part, kind) for kind in sorted({k for k, _, _ in base_spans(part)}) or (-1,))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32())],
                                             names=["part", "kind"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "part string, kind int")


def train_field(docs: DataFrame, text: str = "text", *, sample: int = 120, longest: int = 400) -> Field | None:
    """Fit on the ``sample`` different windows of smallest hash of each kind of base span, and as many without any.

    Windows are cut into pieces of about ``longest`` characters.
    """
    # most windows may be of one kind: the smallest hashes of every sixty-fourth part first, then of all
    drawn = _windows_of(docs, text, longest).distinct().withColumn("hash", F.xxhash64("part")).withColumn("salt", F.pmod("hash", F.lit(64)))
    for by in (["kind", "salt"], ["kind"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("hash", "part"))
        drawn = drawn.withColumn("place", place).where(F.col("place") <= sample)
    return fit_field(sorted({r["part"] for r in drawn.select("part").collect()}))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_private(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", **settings) -> DataFrame:
    """Per row: id, counts of base spans by kind, ``base_sha256`` and all ``spans``."""
    field = train_field(docs, text, **settings)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            counts = np.zeros((batch.num_rows, len(KINDS)), np.int64)
            digests, found = [], []
            for row, t in enumerate(batch.column("text")):
                base, spans = all_spans(t.as_py() or "", field)
                for k, _, _ in base:
                    counts[row, k] += 1
                digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                found.append(spans_text(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(found, pa.string())],
                names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or run of overlapping ones, becomes the name of its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_private(docs: DataFrame, *, text: str = "text", count: str = "n_chars", **settings) -> DataFrame:
    """The same rows and columns with personal data masked and ``count`` renewed; a missing text stays missing."""
    field = train_field(docs, text, **settings)
    fields = docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            new = [None if t is None else masked(t, all_spans(t, field)[1]) for t in (x.as_py() for x in batch.column(text))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, batch.column(text).type) if f.name == text else batch.column(f.name) for f in fields], names=[f.name for f in fields])

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(count, F.length(text).cast(docs.schema[count].dataType)) if count in docs.columns else out
