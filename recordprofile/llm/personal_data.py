"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field for other written forms.

Emails, IP addresses, card and phone numbers that the patterns describe are always
found (the base).  People also write them otherwise, "ann at mail dot example dot com",
"10[.]0[.]0[.]7", "(017) 555-7713", "4539.5787.6362.1486"; such spans are found by a
model over whole segments.  A segment's features are those of the span as a whole (its
digits, groups, separators, checksum, what stands around it), a segment that cannot be
of a kind has no place in that kind's part of the lattice, and everything else is
outside, at no cost.  The best way through the lattice, by dynamic programming over the
ends of segments of bounded length, chooses boundaries and kinds together.

The model trains here, without labels, on the base: the spans of a bounded sample of
documents as they stand, the same spans rewritten in other forms, and rewritten ones
that are none (a digit changed so that a checksum fails, parts beyond 255, too few or
too many digits).  Stretches of the sample's text that hold no base span count as
outside with little weight.

A text is read once: its base spans and the stretches ("islands") that may hold
candidates, with a little text around them, are written down, and both training and
search read these.  All steps are linear in the text, whatever it repeats.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

KINDS = ("email", "ip", "card", "phone")
#: Documents with base spans, and islands of them without, that the model trains on at most.
SAMPLE, MOST_ISLANDS = 1500, 3000
#: Weight of text without base spans in training.
OUTSIDE = 0.2
#: Groups of digits in a segment, and characters of context kept on each side of an island.
MOST_GROUPS, BEFORE, AFTER = 7, 24, 8
ROUNDS, RATE, DECAY = 60, 0.15, 0.002

_chain = re.compile(r"[0-9]+(?:\.[0-9]+)*").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_SEP = r"[ \t().\[\]/_-]"
_numbers = re.compile(rf"[0-9](?:{_SEP}{{0,3}}[0-9])*").finditer
_digits = re.compile("[0-9]+").finditer
_AT = r"(?:@|[ \t]?[\[({<][ \t]?(?:at|@)[ \t]?[\])}>][ \t]?|[ \t]at[ \t]|[ \t]@[ \t])"
_DOT = r"(?:\.|[ \t]?[\[({<][ \t]?(?:dot|\.)[ \t]?[\])}>][ \t]?|[ \t]dot[ \t])"
_mail = re.compile(rf"(?P<at>{_AT})(?P<domain>[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}})", re.IGNORECASE).finditer
_dots = re.compile(_DOT, re.IGNORECASE)
_name = re.compile(rf"[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}$", re.IGNORECASE).search
_last_name = re.compile(r"[A-Za-z0-9._%+-]{1,64}$").search
_cue = re.compile(r"(\w{1,16})\W{0,3}$").search

Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans that the fixed patterns find, by kind and start: leftmost, not overlapping within a kind; matches that fail a kind's condition are dropped."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain(text, at + 1)):
            found.append((0, start, m.end()))
            free = m.end()
        # What stands left of this @ can't belong to another one.
        free = max(free, at + 1)
        at = text.find("@", free)
    if not re.search("[0-9]", text):
        return found
    for m in _chain(text):
        if "." in m[0]:
            parts = list(_digits(text, m.start(), m.end()))
            for k in range(0, len(parts) - 3, 4):
                if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                    found.append((1, parts[k].start(), parts[k + 3].end()))
    for m in _card(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _phone(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches, apart from each other and in order, that may hold a span: runs of digits with separators and mail-like writing."""
    found = []
    for m in _numbers(text):
        if m.end() - m.start() >= 7:
            start = m.start()
            while start > 0 and m.start() - start < 2 and text[start - 1] in "+(":
                start -= 1
            found.append((start, m.end()))
    for m in _mail(text):
        if name := _name(text, max(0, m.start() - 200), m.start()):
            found.append((name.start(), m.end()))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _around(text: str, start: int, end: int) -> list[str]:
    """Features of what stands beside a span."""
    kind = lambda c: "edge" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c
    cue = _cue(text[max(0, start - BEFORE) : start])
    return [f"before {kind(text[start - 1 : start])}", f"after {kind(text[end : end + 1])}", f"cue {cue[1].lower() if cue else ''}"]


def candidates(text: str, start: int, end: int) -> Iterator[tuple[Span, list[str]]]:
    """The segments of an island that may be of a kind, with their features."""
    groups = [(m.start(), m.end()) for m in _digits(text, start, end)]
    for i in range(len(groups)):
        total, shape, seps = 0, [], []
        for j in range(i, min(len(groups), i + MOST_GROUPS)):
            a, b = groups[j]
            if j > i:
                sep = text[groups[j - 1][1] : a]
                if len(sep) > 3 or re.search(f"[^{_SEP[1:]}", sep):
                    break
                seps.append(sep)
            total += b - a
            shape.append(b - a)
            if total > 19:
                break
            first, last = groups[i][0], groups[j][1]
            kinds = [2] * (13 <= total <= 19) + [3] * (7 <= total <= 15)
            if len(shape) == 4 and max(shape) <= 3 and all(int(text[x:y]) <= 255 for x, y in groups[i : j + 1]):
                kinds.append(1)
            if not kinds:
                continue
            more = [f"left {i > 0 and first - groups[i - 1][1] <= 3}", f"right {j + 1 < len(groups) and groups[j + 1][0] - last <= 3}"]
            digits = "".join(text[x:y] for x, y in groups[i : j + 1])
            made = [f"shape {'-'.join(map(str, shape))}", f"digits {total}", f"groups {len(shape)}", f"seps {'|'.join(sorted(set(seps)))}", f"same {len(set(seps)) <= 1}", *more]
            for kind in kinds:
                own = made + ([f"luhn {luhn(digits)}"] if kind == 2 else [])
                froms = {first, *[first - k for k in (1, 2) if kind == 3 and start <= first - k and set(text[first - k : first]) <= set("+(")]}
                for begin in sorted(froms):
                    lead = text[begin:first]
                    if "(" in lead and ")" not in text[first:last]:
                        continue
                    yield (kind, begin, last), [*own, f"lead {lead}", f"open {text[begin - 1 : begin] in ('+', '(')}", *_around(text, begin, last)]
    for m in _mail(text, start, end):
        names = {n.start() for f in (_name, _last_name) if (n := f(text, max(start, m.start() - 200), m.start()))}
        ends = [d.start() for d in _dots.finditer(text, m.start("domain"), m.end())][1:] + [m.end()]
        mark = re.sub(r"\s", " ", m["at"].lower())
        for begin in sorted(names):
            for stop in ends:
                dots = {re.sub(r"\s", " ", d[0].lower()) for d in _dots.finditer(text, m.start("domain"), stop)}
                top = text[m.start("domain") : stop]
                top = _dots.split(top)[-1]
                made = [f"at {mark}", f"dots {'|'.join(sorted(dots))}", f"marks {mark != '@'} {dots != {'.'}}", f"top {top.isalpha()} {min(len(top), 8)}", f"whole {stop == m.end()}", f"spelled name {' ' in text[begin : m.start()]}"]
                yield (0, begin, stop), [*made, *_around(text, begin, stop)]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]

    def score(self, kind: int, features: Iterable[str]) -> float:
        name = KINDS[kind]
        return sum(self.weights.get(f"{name}: {f}", 0.0) for f in ("any", *features))

    def best(self, text: str, start: int, end: int, taken: Iterable[tuple[int, int]] = ()) -> list[Span]:
        """The spans of the best way through an island that keeps clear of what is taken."""
        taken = list(taken)
        by_end: dict[int, list[tuple[Span, float]]] = defaultdict(list)
        for span, features in candidates(text, start, end):
            if not any(a < span[2] and span[1] < b for a, b in taken) and (s := self.score(span[0], features)) > 0:
                by_end[span[2]].append((span, s))
        # At each end: the best sum up to there and its last span; in between the sum stands.
        ends, sums, lasts = [start], [0.0], [None]
        for stop in sorted(by_end):
            best, last = sums[-1], None
            for span, s in by_end[stop]:
                at = bisect_right(ends, span[1]) - 1
                if at >= 0 and sums[at] + s > best:
                    best, last = sums[at] + s, (span, at)
            if last:
                ends.append(stop)
                sums.append(best)
                lasts.append(last)
        found, at = [], len(ends) - 1
        while at > 0:
            span, at = lasts[at]
            found.append(span)
        return found[::-1]


def _rewritten(rng: random.Random, kind: int, span: str) -> Iterator[tuple[str, tuple[int, int] | None]]:
    """Other forms of a base span: (text, its span within), or None where it is no such thing any more."""
    whole = lambda t: (t, (0, len(t)))
    digits = "".join(c for c in span if c.isdigit())
    if kind == 0:
        name, domain = span.split("@")
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", "."), (" @ ", "."), ("[at]", "[.]"), ("@", "[.]"), (" AT ", " DOT ")])
        yield whole(name + at + domain.replace(".", dot))
        if dot != ".":
            yield whole(name.replace(".", dot) + at + domain.replace(".", dot))
        yield f"{name} at {domain}", None
    elif kind == 1:
        dot = rng.choice(["[.]", "(.)", " . ", "[.]"])
        yield whole(span.replace(".", dot))
        parts = span.split(".")
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        yield dot.join(parts), None
        yield dot.join(parts[:3]), None
    elif kind == 2:
        sep = rng.choice([".", "/", "_", "  ", " - "])
        cut = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        yield whole(sep.join(cut))
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        yield sep.join(wrong[k : k + 4] for k in range(0, len(wrong), 4)), None
        yield wrong, None
    else:
        local = digits[-10:]
        forms = ["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}) {} {}", "({}) {}.{}"]
        three = lambda d: (d[:-7], d[-7:-4], d[-4:])
        if len(local) >= 9:
            yield whole(rng.choice(forms).format(*three(local)))
            yield whole("00" + digits[:-10] + " " + rng.choice(forms[1:4]).format(*three(local)))
        yield whole("+" + "/".join((digits[:-10], *three(local))).lstrip("/"))
        yield f"{digits[0:4]}-{digits[4:6]}-{digits[6:8]}", None
        yield f"{digits[:-6]},{digits[-6:-3]},{digits[-3:]}", None
        yield f"{digits[:4]}.{digits[4:6]}", None
        yield f"{digits[:-9] or 1} {digits[-9:-6]} {digits[-6:-3]} {digits[-3:]}", None
        yield f"97{digits[-1]}-{digits[0]}-{digits[1:3]}-{digits[-6:]}-{digits[3]}", None
        yield digits, None


def _examples(rows: Iterable[tuple[list[Span], list[tuple[int, str]]]], most: int) -> list[tuple[list[tuple[Span, list[str]]], set[Span], float]]:
    """(candidates, those that are right, weight) of the islands of a sample and of what is made of its base spans."""
    found: list[tuple[list[tuple[Span, list[str]]], set[Span], float]] = []
    plain = 0
    for base, pieces in rows:
        for at, text in pieces:
            inside = [(k, a - at, b - at) for k, a, b in base if at <= a and b <= at + len(text)]
            for a, b in islands(text):
                own = [(k, x, y) for k, x, y in inside if a <= x and y <= b]
                made = list(candidates(text, a, b))
                # A span of two kinds at once teaches nothing about either.
                if own and len({x for _, x, _ in own}) == len(own) and set(own) <= {s for s, _ in made}:
                    found.append((made, set(own), 1.0))
                elif not own and made and not any(x < b and a < y for _, x, y in inside) and plain < most:
                    plain += 1
                    found.append((made, set(), OUTSIDE))
            for kind, x, y in inside:
                rng = random.Random(zlib.crc32(text[x:y].encode("utf-8", "replace")))
                for other, span in _rewritten(rng, kind, text[x:y]):
                    whole = text[:x] + other + text[y:]
                    right = {(kind, x, x + len(other))} if span else set()
                    for a, b in islands(whole):
                        if a < x + len(other) and x < b and (made := list(candidates(whole, a, b))):
                            if right <= {s for s, _ in made}:
                                found.append((made, right, 1.0))
    return found


def train(examples: list[tuple[list[tuple[Span, list[str]]], set[Span], float]], *, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Weights of the greatest penalised likelihood of the right ways through the examples' lattices; features of fewer than three examples don't count."""
    seen = Counter(f"{KINDS[s[0]]}: {f}" for made, _, _ in examples for f in {(s[0], f) for s, fs in made for f in ("any", *fs)} for s, f in [((f[0],), f[1])])
    number = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    if not number:
        return Model({})
    row, col, lattices, gold, weight = [], [], [], [], []
    for made, right, importance in examples:
        ends = sorted({p for s, _ in made for p in s[1:]})
        place = {p: k for k, p in enumerate(ends)}
        arcs = [[] for _ in ends]
        for span, features in made:
            n = len(gold)
            for f in ("any", *features):
                if (k := number.get(f"{KINDS[span[0]]}: {f}")) is not None:
                    row.append(n)
                    col.append(k)
            arcs[place[span[2]]].append((place[span[1]], n))
            gold.append(float(span in right))
            weight.append(importance)
        lattices.append(arcs)
    row, col, gold, weight = np.array(row), np.array(col), np.array(gold), np.array(weight)
    w = np.zeros(len(number))
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, rounds + 1):
        # Ways are few and their scores small: sums of products stay within range once scores are bounded.
        potential = np.exp(np.clip(np.bincount(row, w[col], minlength=len(gold)), -30, 30))
        chance = np.zeros(len(gold))
        for arcs in lattices:
            forward = [1.0]
            for into in arcs[1:]:
                forward.append(forward[-1] + sum(forward[a] * potential[n] for a, n in into))
                if forward[-1] > 1e200:
                    forward = [x / 1e200 for x in forward]
            backward = [0.0] * len(arcs)
            backward[-1] = 1.0 / forward[-1]
            for k in range(len(arcs) - 1, 0, -1):
                backward[k - 1] += backward[k]
                for a, n in arcs[k]:
                    backward[a] += potential[n] * backward[k]
                    chance[n] = forward[a] * potential[n] * backward[k]
        grad = np.bincount(col, (weight * (chance - gold))[row], minlength=len(w)) / len(lattices) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({f: float(w[k]) for f, k in number.items() if abs(w[k]) > 1e-6})


def _written(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_READ = "base array<int>, piece_at array<int>, piece array<string>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans (kind, start and end in a row) and islands with what stands around them."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            base, at, piece = [], [], []
            for text in part.column(1).to_pylist():
                text = text or ""
                found = base_spans(text)
                stretches: list[list[int]] = []
                for a, b in islands(text):
                    a, b = max(0, a - BEFORE), min(len(text), b + AFTER)
                    if stretches and a <= stretches[-1][1]:
                        stretches[-1][1] = b
                    else:
                        stretches.append([a, b])
                base.append([x for s in found for x in s])
                at.append([a for a, _ in stretches])
                piece.append([text[a:b] for a, b in stretches])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32())), pa.array(piece, pa.list_(pa.string()))], names=[part.schema.names[0], "base", "piece_at", "piece"])


def _triples(flat: list[int]) -> list[Span]:
    return list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))


def fit(read: DataFrame, *, sample: int = SAMPLE, most_islands: int = MOST_ISLANDS, **options) -> Model:
    """A model from what ``sample`` documents with base spans hold, and as many without that have islands; by hash order, so the same ones on each run."""
    # Bounded: of a long document's stretches the first ones, cut, so that the sample is as small as it says.
    slim = F.slice("piece_at", 1, 64).alias("piece_at"), F.transform(F.slice("piece", 1, 64), lambda p: F.substring(p, 1, 400)).alias("piece")
    rows: list = []
    for some in (F.size("base") > 0, (F.size("base") == 0) & (F.size("piece") > 0)):
        drawn = read.where(some).select("base", *slim).withColumn("h", F.xxhash64("base", "piece")).orderBy("h", "base", "piece").limit(sample)
        rows += [(_triples(r["base"]), list(zip(r["piece_at"], r["piece"], strict=True))) for r in drawn.collect()]
    return train(_examples(rows, most_islands), **options)


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, base, spans) of each document: arrays of (kind, start, end) in code points, ends exclusive, by kind (email, ip, card, phone) and start.

    ``base`` holds what the fixed patterns find, ``spans`` that and what the model adds;
    added spans overlap neither base spans nor each other.  Null texts count as empty
    ones and have no spans; repeated rows and ids have a row each; a null id stays null;
    an empty table has no rows; other columns are left out.  Without any base span in the
    table the model adds none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    read = durable(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_read, f"id {kind}, {_READ}"))
    model = fit(read, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the features of a bounded sample

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            added = []
            for flat, ats, pieces in zip(*[batch.column(c).to_pylist() for c in ("base", "piece_at", "piece")], strict=True):
                base = sorted((a, b) for _, a, b in _triples(flat))
                found = []
                for at, text in zip(ats, pieces, strict=True) if model.weights else ():
                    taken = [(a - at, b - at) for a, b in base if a < at + len(text) and at < b]
                    for a, b in islands(text):
                        found += [(k, x + at, y + at) for k, x, y in model.best(text, a, b, taken)]
                added.append([x for s in sorted([*_triples(flat), *found]) for x in s])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("base"), pa.array(added, pa.list_(pa.int32()))], names=["id", "base", "spans"])

    found = read.mapInArrow(search, f"id {kind}, base array<int>, spans array<int>")
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda c: F.transform(
        F.when(F.size(c) > 0, F.sequence(F.lit(0), (F.size(c) / 3 - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(names[F.col(c)[k * 3]].alias("kind"), F.col(c)[k * 3 + 1].alias("start"), F.col(c)[k * 3 + 2].alias("end")),
    )
    return found.select(F.col("id").alias(id_col), shown("base").alias("base"), shown("spans").alias("spans"))


def span_text(spans: str):
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
