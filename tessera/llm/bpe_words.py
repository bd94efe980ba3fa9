"""Exact token ids and prefix counts through caches of words.

Both vocabularies split a text by a pattern before any merge, so a text's ids are its words' ids one after
the other.  Texts of plain Latin characters are split here, others by the library's own splitter; special tokens inside a text
part it first, as in the library.
"""

from __future__ import annotations

import json
import re

#: Letters for which the split patterns below agree with the library's (fixed values: ASCII, Latin-1, Latin Extended-A).
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: A text with anything else is split by the library.
OTHER = re.compile(rf"[^\t\n\r -~{LETTERS}]")
#: Anything else in a text, or what may be a special token, sends it to the library for its ids.
UNUSUAL = re.compile(rf"{OTHER.pattern}|<\|")
#: The vocabularies' own split patterns over those letters (fixed values).
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_SPLIT = re.compile(rf"{CONTRACTIONS}| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
WORD_SPLIT = re.compile(rf"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
#: Bytes that a cache holds, about, before it starts anew, and what an entry takes beside its words.
KEPT_BYTES, ENTRY_BYTES = 96 << 20, 224
#: Longer words are not kept, and are searched with an automaton of the vocabulary.
LONG = 300
#: Contractions whose first two characters split apart (fixed values).
SPLIT_SHORT = ("'re", "'ve", "'ll")


def library(path: str):
    """The library's tokenizer, without truncation and padding, on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordIds:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit bytes, as the library gives them."""

    def __init__(self, path: str):
        self.lib, self.cache, self.held = library(path), {}, 0

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        import numpy as np

        for k in range(0, len(words), 5000):
            part = words[k : k + 5000]
            e = self.lib.encode(" ".join(part), add_special_tokens=False)
            of, ids = np.array(e.word_ids, dtype=np.int64), np.array(e.ids, dtype="<u4")
            cuts = np.flatnonzero(np.diff(of)) + 1
            if len(cuts) + 1 == len(part):
                raw, at = ids.tobytes(), [0, *(cuts * 4).tolist(), len(ids) * 4]
                self.cache.update(zip(part, [raw[a:b] for a, b in zip(at, at[1:])]))
            else:
                self.cache.update((w, self.whole(w)) for w in part)
            self.held += len(part) * ENTRY_BYTES + sum(map(len, part)) + 4 * len(ids)

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        for text in texts:
            if UNUSUAL.search(text):
                out.append(self.whole(text))
                continue
            words = WORD_SPLIT.findall(text.lower())
            get = self.cache.__getitem__
            try:
                out.append(b"".join(map(get, words)))
            except KeyError:
                cache = self.cache
                if self.held > KEPT_BYTES:
                    cache.clear()
                    self.held = 0
                new = list({w for w in words if w not in cache})
                self._learn(new)
                out.append(b"".join(map(get, words)))
                for w in new:
                    if len(w) > LONG:
                        del cache[w]
        return out


def _bytes_of(token: str, back: dict[str, int]) -> bytes:
    return bytes(back[c] for c in token)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _space(c: str) -> bool:
    """White space as the split patterns have it."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


class PrefixCounts:
    """Token counts at every byte prefix of a word by dynamic programming, and from those of every prefix of a text.

    For each prefix of a word exactly one vocabulary entry ends it such that the entry before it (the last one of
    the shorter prefix's encoding) stays apart from it when both are encoded together.  So the count at i is the
    count at i - len(entry) plus one, and each prefix costs a few look-ups instead of an encoding.  The library splits texts
    and encodes nothing here.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        if j.get("normalizer") or any(t[k] for t in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("a vocabulary that changes texts before it splits them")
        back = byte_alphabet()
        special = {t["content"] for t in j["added_tokens"]}
        self.special = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) or "(?!)")
        self.specials = special
        self.vocab = {_bytes_of(t, back): i for t, i in j["model"]["vocab"].items() if t not in special}
        self.longest = max(map(len, self.vocab))
        self.rank = {}
        for k, m in enumerate(j["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[_bytes_of(a, back), _bytes_of(b, back)] = k
        self.lib, self.cache, self.apart, self.last_long, self._automaton = library(path), {}, {}, (None, ()), None
        self.held = 0
        self.splitter = self.lib.pre_tokenizer

    def split(self, text: str) -> list[str]:
        """The words that are encoded each by itself, special tokens among them."""
        if not self.special.search(text):
            return self._words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if not OTHER.search(text):
            return BYTE_SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def merged(self, word: bytes) -> list[bytes]:
        """The encoding of a short word: the best-ranked pair merges first, the leftmost of equals."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _stays_apart(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) * ENTRY_BYTES > KEPT_BYTES:
                self.apart.clear()
            known = self.apart[key] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def word(self, word: str) -> tuple[int, ...]:
        """Counts at each byte prefix of a word, the whole word last."""
        known = self.cache.get(word)
        if known is not None:
            return known
        if word in self.specials:
            return (1,) * len(word.encode("utf-8"))
        if self.last_long[0] == word:
            return self.last_long[1]
        if self.held > KEPT_BYTES:
            self.cache.clear()
            self.held = 0
        b = word.encode("utf-8")
        vocab, apart = self.vocab, self.apart
        counts, last = [0], [b""]
        if len(b) > LONG:
            for end, n in self._entries(b):
                j = end + 1 - n
                if len(counts) == end + 1 and self._stays_apart(last[j], b[j : end + 1]):
                    counts.append(counts[j] + 1)
                    last.append(b[j : end + 1])
            if len(counts) != len(b) + 1:
                raise ValueError("a byte has no token")
            self.last_long = (word, tuple(counts[1:]))
            return self.last_long[1]
        for i in range(1, len(b) + 1):
            for j in range(max(0, i - self.longest), i):
                t = b[j:i]
                if t in vocab:
                    fits = apart.get((last[j], t))
                    if fits is None:
                        fits = self._stays_apart(last[j], t)
                    if fits:
                        counts.append(counts[j] + 1)
                        last.append(t)
                        break
            else:
                raise ValueError("a byte has no token")
        out = self.cache[word] = tuple(counts[1:])
        self.held += ENTRY_BYTES + 10 * len(b)
        return out

    def _entries(self, b: bytes):
        """(last place, length) of every vocabulary entry in a word, by place, the longest first."""
        import ahocorasick

        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for t in self.vocab:
                self._automaton.add_word(t.decode("latin-1"), len(t))
            self._automaton.make_automaton()
        return self._automaton.iter(b.decode("latin-1"))

    def total(self, word: str) -> int:
        return self.word(word)[-1]

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """Exact counts at every prefix of one text: ``ends`` are its words' ends, ``upto`` the counts there.

    Inside a word the word's own prefix counts answer, and inside white space those of the run of white space that a cut leaves
    at the end.  Only a cut through a special token, which then is ordinary text, or after two characters of a contraction
    splits the few characters since the word before anew.
    """

    def __init__(self, counts: PrefixCounts, text: str):
        import numpy as np

        self.counts, self.text = counts, text
        self.words = counts.split(text)
        totals = _Totals.of(counts)
        each = np.fromiter(map(totals.__getitem__, self.words), dtype=np.int64, count=len(self.words))
        self.upto = np.cumsum(each)
        self.total = int(self.upto[-1]) if len(each) else 0
        self.ends = None

    def _ends(self):
        import numpy as np

        if self.ends is None:
            self.ends = np.cumsum(np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words)))
        return self.ends

    def _before(self, k: int) -> tuple[int, int]:
        """Where word k starts, and the count there."""
        return (int(self._ends()[k - 1]), int(self.upto[k - 1])) if k else (0, 0)

    def _run(self, k: int) -> tuple[int, int, str]:
        """Where the white space that reaches into word k starts, the count there, and all of that white space."""
        while k and _space(self.words[k - 1][-1]) and self.words[k - 1] not in self.counts.specials:
            k -= 1
        start, base = self._before(k)
        end = start
        while end < len(self.text) and _space(self.text[end]):
            end += 1
        return start, base, self.text[start:end]

    def at(self, n: int) -> int:
        """Tokens of the first n characters."""
        import numpy as np

        if n >= len(self.text):
            return self.total
        if n <= 0:
            return 0
        k = int(np.searchsorted(self._ends(), n, "right"))  # words that end at or before n
        start, base = self._before(k)
        word, part = self.words[k], self.text[start:n]
        if part and word in self.counts.specials:
            while k and (_space(self.words[k - 1][-1]) and self.words[k - 1] not in self.counts.specials):
                k -= 1
            start, base = self._before(max(0, k - 1))
            return base + sum(map(self.counts.total, self.counts.split(self.text[start:n])))
        if _space(self.text[n - 1]) and not (not part and self.words[k - 1] in self.counts.specials):
            start, base, run = self._run(k)
            run = run if len(run) > LONG else run[: n - start]
            return base + self.counts.word(run)[len(run[: n - start].encode("utf-8")) - 1]
        if not part:
            return base
        if word in SPLIT_SHORT and len(part) == 2:
            return base + sum(map(self.counts.total, self.counts.split(part)))
        return base + self.counts.word(word)[len(part.encode("utf-8")) - 1]

    def longest(self, budget: int) -> int:
        """The most characters whose tokens are at most budget: every longer prefix has more."""
        import numpy as np

        if self.total <= budget:
            return len(self.text)
        k = int(np.searchsorted(self.upto, budget, "right"))
        for j in range(min(k + 2, len(self.words) - 1), -1, -1):
            start, base = self._before(j)
            end, word = start + len(self.words[j]), self.words[j]
            if len(word) > LONG:  # by its table, but for the ends
                if self.at(end) <= budget:
                    return end
                if _space(word[-1]):
                    run_start, base, word = self._run(j)
                else:
                    run_start = start
                raw = np.frombuffer(word.encode("utf-8") + b"a", dtype=np.uint8)
                ends = np.flatnonzero((raw[1:] & 0xC0) != 0x80)  # the last byte of each character
                fits = np.flatnonzero(np.array(self.counts.word(word))[ends] + base <= budget) + run_start + 1
                fits = fits[(fits > start + 1) & (fits < end)]
                if len(fits):
                    return int(fits[-1])
                end = start + 1
            for n in range(end, start, -1):
                if self.at(n) <= budget:
                    return n
        return 0


class _Totals(dict):
    """Word to its whole count, learned on demand."""

    def __init__(self, counts: PrefixCounts):
        self.counts = counts

    @staticmethod
    def of(counts: PrefixCounts) -> _Totals:
        if not hasattr(counts, "totals"):
            counts.totals = _Totals(counts)
        return counts.totals

    def __missing__(self, word: str) -> int:
        if len(self) * ENTRY_BYTES // 2 > KEPT_BYTES:
            self.clear()
        n = self.counts.word(word)[-1]
        if len(word) <= LONG:
            self[word] = n
        return n
