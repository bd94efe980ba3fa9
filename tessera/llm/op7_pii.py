"""Personal data by patterns and a semi-Markov conditional random field.

The patterns give the base spans.  The field then reads every run of tokens with digits or @ (no span of these kinds is without),
scores whole candidate spans of at most MOST tokens by features of the span (digits, Luhn sum, groups, shape, parts),
and a dynamic programme over such bounded spans picks boundaries and kinds together; so a phone and a card side by side, which
a greedy pattern swallows as one and drops, come out as two.  Its spans are added where they touch no base span.

The field is trained here, by likelihood, on sequences made from a fixed seed.  Every text is read whole; the programme holds the
best scores of MOST tokens and two bytes a token and kind, so a line of millions of numbers needs no more than itself.  Null texts
are empty and have no spans; null ids are kept as they are; repeated rows get equal results; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
MOST = 6
_HOT = re.compile(r"[0-9@]")
_AT_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9._%+@()-]+")
_EMAIL_WHOLE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP_WHOLE = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")
_GROUP = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    """What the e-mail pattern finds, in time linear in the text: its local part is the whole run before an @."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL_END.match(text[start - 1]):
            start -= 1
        m = _AT_TAIL.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, those that fail their test dropped; by kind, then start."""
    out = []
    if not _HOT.search(text):
        return out
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = "".join(_GROUP.findall(m[0]))
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def runs(text: str):
    """Runs of tokens with a digit or @ that one or two spaces part."""
    own: list[tuple[int, int]] = []
    for m in _TOKEN.finditer(text):
        hot = _HOT.search(m[0])
        if own and not (hot and text[own[-1][1] : m.start()] in (" ", "  ")):
            yield own
            own = []
        if hot:
            own.append(m.span())
    if own:
        yield own


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without what encloses or follows it."""
    opened, closed = text.count("(", start, end), text.count(")", start, end)
    while start < end:
        first, last = text[start], text[end - 1]
        if last in ".-%_" or last == ")" and opened < closed:
            end -= 1
            closed -= last == ")"
        elif first in ".-%_)" or first == "(" and closed < opened:
            start += 1
            opened -= first == "("
            closed -= first == ")"
        else:
            return start, end
    return start, end


_DIGITS = (0, 6, 8, 9, 10, 11, 12, 15, 16, 19)
_SHAPES = {(3, 3, 4): 0, (1, 3, 3, 4): 1, (2, 3, 3, 4): 2, (4, 4, 4, 4): 3, (4, 6, 5): 4, (1, 10): 5, (16,): 6, (15,): 7, (10,): 8, (3, 4): 9, (4, 2, 2): 10, (4, 4): 11}
_N = 1 + MOST + len(_DIGITS) + 1 + 14 + len(_SHAPES) + 1


def span_features(s: str, tokens: int) -> np.ndarray:
    groups = _GROUP.findall(s)
    digits = "".join(groups)
    n = len(digits)
    f = np.zeros(_N)
    f[0] = f[tokens] = 1
    at = 1 + MOST
    f[at + next((k for k, most in enumerate(_DIGITS) if n <= most), len(_DIGITS))] = 1
    at += len(_DIGITS) + 1
    letters = any(c.isalpha() for c in s)
    cardlike = 13 <= n <= 19 and not letters
    f[at : at + 14] = [
        cardlike and luhn(digits),
        cardlike and not luhn(digits),
        s[:1] == "+",
        "+" in s[1:],
        s.count("@") == 1,
        s.count("@") > 1,
        bool(_EMAIL_WHOLE.fullmatch(s)),
        letters,
        letters and "@" not in s,
        bool(_IP_WHOLE.fullmatch(s)) and all(int(p) <= 255 for p in groups),
        s.count(".") == 3,
        s == digits,
        "(" in s and ")" in s,
        digits[:1] in ("3", "4", "5", "6") and cardlike,
    ]
    at += 14
    f[at + _SHAPES.get(tuple(map(len, groups)), len(_SHAPES))] = 1
    return f


def _may(s: str) -> bool:
    """Whether a span can be of any kind at all: an @, four dotted parts, or seven digits."""
    return "@" in s or s.count(".") >= 3 or sum("0" <= c <= "9" for c in s) >= 7


def lattice(text: str, run: list[tuple[int, int]]):
    """(first token, one after the last, features, may be of a kind, span) of every candidate; single tokens always are."""
    out = []
    for i in range(len(run)):
        for j in range(i + 1, min(len(run), i + MOST) + 1):
            a, b = trimmed(text, run[i][0], run[j - 1][1])
            may = a < b and _may(text[a:b])
            if may or j == i + 1:
                out.append((i, j, span_features(text[a:b], j - i), may, (a, b)))
    return out


class Field:
    """Weights of each kind (0 is none) for span features, and of each kind after each (the last row: at the start)."""

    def __init__(self):
        k = len(KINDS) + 1
        self.w, self.t = np.zeros((k, _N)), np.zeros((k + 1, k))

    def scores(self, cells) -> np.ndarray:
        s = np.array([self.w @ f for _, _, f, _, _ in cells])
        for r, (i, j, _, may, _) in enumerate(cells):
            if not may:
                s[r, 1:] = -np.inf
            if j > i + 1:
                s[r, 0] = -np.inf
        return s

    def read(self, text: str, run: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """The spans of the best segmentation of a run; scores are held for MOST tokens, for every token only where its best segments start."""
        n, k, turn = len(run), len(KINDS) + 1, MOST + 1
        top = np.full((turn, k + 1), -np.inf)
        top[0, k] = 0
        length, before = np.zeros((n + 1, k), dtype=np.int8), np.zeros((n + 1, k), dtype=np.int8)
        kinds = np.arange(k)
        for i in range(n):
            through = top[i % turn][:, None] + self.t
            p = through.argmax(axis=0)
            reached = through[p, kinds]
            top[i % turn] = -np.inf
            for j in range(i + 1, min(n, i + MOST) + 1):
                a, b = trimmed(text, run[i][0], run[j - 1][1])
                may = a < b and _may(text[a:b])
                if not may and j > i + 1:
                    continue
                v = reached + self.w @ span_features(text[a:b], j - i)
                row = top[j % turn]
                for y in range(1 if j > i + 1 else 0, k if may else 1):
                    if v[y] > row[y]:
                        row[y], length[j, y], before[j, y] = v[y], j - i, p[y]
        j, y, out = n, int(top[n % turn, :k].argmax()), []
        while j:
            i = j - int(length[j, y])
            if y:
                out.append((KINDS[y - 1], *trimmed(text, run[i][0], run[j - 1][1])))
            j, y = i, int(before[j, y])
        return out[::-1]

    def gradient(self, cells, n: int, gold: list[tuple[int, int]]):
        """Of the log-likelihood, by forward and backward sums over segmentations."""
        s, k = self.scores(cells), len(KINDS) + 1
        a, b = np.full((n + 1, k + 1), -np.inf), np.full((n + 1, k + 1), -np.inf)
        a[0, k], b[n, :] = 0, 0
        order = sorted(range(len(cells)), key=lambda r: cells[r][:2])
        for r in order:
            i, j = cells[r][:2]
            a[j, :k] = np.logaddexp(a[j, :k], np.logaddexp.reduce(a[i][:, None] + self.t, axis=0) + s[r])
        for r in sorted(order, key=lambda r: (-cells[r][0], -cells[r][1])):
            i, j = cells[r][:2]
            b[i] = np.logaddexp(b[i], np.logaddexp.reduce(self.t + (s[r] + b[j, :k])[None, :], axis=1))
        z = b[0, k]
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for r in order:
            i, j, f = cells[r][:3]
            p = np.exp(a[i][:, None] + self.t + (s[r] + b[j, :k])[None, :] - z)
            gt -= p
            gw -= p.sum(axis=0)[:, None] * f[None, :]
        before = k
        for r, y in gold:
            gw[y] += cells[r][2]
            gt[before, y] += 1
            before = y
        return gw, gt


def _made(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sequence of personal data and other numbers, and its spans."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8)))

    def card():
        n = rng.choice([16, 16, 16, 15, 13, 19])
        body = rng.choice("3456") + d(n - 2)
        body += next(c for c in "0123456789" if luhn(body + c))
        if n == 16 and rng.random() < 0.4:
            body = rng.choice(" -").join(body[k : k + 4] for k in range(0, 16, 4))
        return body

    def phone():
        a, b, c = rng.choice("23456789") + d(2), d(3), d(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1 {a}-{b}-{c}", f"+1{a}{b}{c}", f"{a}-{b}-{c}", f"+{rng.randint(30, 99)} {a} {b} {c}", f"+1.{a}.{b}.{c}"])

    def email():
        return f"{name()}{rng.choice(['', '.' + d(2), '_' + name(), '+x' + d(1)])}@{rng.choice(['mail' + d(1) + '.', ''])}{name()}.{rng.choice(['com', 'org', 'net', 'example.com'])}"

    def ip():
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def other():
        bad = rng.choice("123456789") + d(15)
        while luhn(bad):
            bad = rng.choice("123456789") + d(15)
        return rng.choice([d(rng.randint(1, 6)), str(rng.randint(1900, 2030)), f"20{d(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{d(2)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"v{d(1)}.{d(1)}.{d(2)}", bad, d(rng.choice([8, 9, 12])), f"{d(4)}-{d(4)}", f"{d(1)}.{d(1)}.{d(1)}.{d(3)}9", f"({d(4)})", f"{name()}{d(3)}", f"{name()}@", f"@{name()}{d(1)}", f"{d(3)}%", d(rng.randint(20, 26)), f"{d(3)}-{d(2)}"])

    make = {"card": card, "phone": phone, "email": email, "ip": ip, "": other}
    text, spans = "", []
    for _ in range(rng.choice([1, 1, 2, 2, 3, 4])):
        kind = rng.choice([*make, ""])
        s = make[kind]()
        text += " " if text else ""
        if kind:
            spans.append((kind, len(text), len(text) + len(s)))
        text += s + (rng.choice(".)-") if rng.random() < 0.12 else "")
    return text, spans


@functools.lru_cache(maxsize=1)
def trained(examples: int = 400, rounds: int = 6, seed: int = 11) -> Field:
    """The field after some rounds of AdaGrad over sequences made from a seed; the same in every run."""
    rng, data = random.Random(seed), []
    while len(data) < examples:
        text, spans = _made(rng)
        for run in runs(text):
            cells = lattice(text, run)
            place = {c[4]: r for r, c in enumerate(cells) if c[3]}
            gold, at, fine = [], 0, True
            own = [s for s in spans if run[0][0] <= s[1] < run[-1][1]]
            for kind, s, e in own:
                r = place.get((s, e))
                if r is None or cells[r][0] < at:
                    fine = False
                    break
                gold += [(next(q for q, c in enumerate(cells) if c[:2] == (t, t + 1)), 0) for t in range(at, cells[r][0])]
                gold.append((r, KINDS.index(kind) + 1))
                at = cells[r][1]
            if fine:
                gold += [(next(q for q, c in enumerate(cells) if c[:2] == (t, t + 1)), 0) for t in range(at, len(run))]
                data.append((cells, len(run), gold))
    field = Field()
    hw, ht = np.full_like(field.w, 1e-6), np.full_like(field.t, 1e-6)
    for _ in range(rounds):
        rng.shuffle(data)
        for cells, n, gold in data:
            gw, gt = field.gradient(cells, n, gold)
            gw -= 1e-4 * field.w
            hw += gw * gw
            ht += gt * gt
            field.w += 0.5 * gw / np.sqrt(hw)
            field.t += 0.5 * gt / np.sqrt(ht)
    return field


def spans_of(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by kind, then start."""
    base = base_spans(text)
    if not _HOT.search(text):
        return base, base
    added = []
    for run in runs(text):
        if not _may(text[run[0][0] : run[-1][1]]):
            continue
        added += field.read(text, run)
    if added and base:
        taken = sorted((s, e) for _, s, e in base)
        starts = np.array([s for s, _ in taken])
        ends = np.maximum.accumulate(np.array([e for _, e in taken]))

        def free(s: int, e: int) -> bool:
            k = int(np.searchsorted(starts, e, "left"))  # base spans that start before e
            return k == 0 or ends[k - 1] <= s

        added = [x for x in added if free(x[1], x[2])]
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the number of base spans of each kind, the digest of the base spans, all spans."""
    id_type = df.schema[id_col].dataType.simpleString()
    bounded_batches(df.sparkSession)
    field = trained()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = [[] for _ in range(len(KINDS) + 2)]
            for t in b.column(1):
                base, every = spans_of(t.as_py() or "", field)
                for c, kind in zip(cols, KINDS):
                    c.append(sum(x[0] == kind for x in base))
                cols[-2].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                cols[-1].append(_joined(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:-2]), *(pa.array(c, pa.string()) for c in cols[-2:])], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redacted(text: str, field: Field) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts and covers both."""
    out, at = [], 0
    for kind, s, e in sorted(spans_of(text, field)[1], key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its texts redacted; null texts stay null."""
    bounded_batches(df.sparkSession)
    field = trained()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            k = b.schema.get_field_index(text_col)
            texts = [None if (t := s.as_py()) is None else redacted(t, field) if _HOT.search(t) else t for s in b.column(k)]
            yield b.set_column(k, text_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, df.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
