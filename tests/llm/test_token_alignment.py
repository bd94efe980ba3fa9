"""Alignment against the libraries' own tokens and every pair of byte ranges compared."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import op12_token_alignment as op

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, a int, id long, `groups` string, pair long, rest long"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def made(seed, n):
    rng = random.Random(seed)
    odd = ["<|endoftext|>", "<s>", "<0x0A>", "▁", "  ", "   ", "\n", "\t", "\r\n", "\x00", "\x1c", " ", "中文字", "日本", "ß", "é", "é", "👩‍👩‍👧", "'ll", "''s", "'re", "ſt", "ﬁ", "１２", "…", "—", "don't", "12345", "x" * 40, "​", "﻿"]
    words = "the quick brown fox jumps over lazy dogs Straße naïve über Señor internationalization token-ization 3.14 https://a.b/c?d=e".split()
    out = []
    for _ in range(n):
        parts = [rng.choice(words if rng.random() < 0.7 else odd) for _ in range(rng.randint(1, 25))]
        out.append(rng.choice(["", " ", "  ", "\n"]) + "".join(p + rng.choice([" ", " ", "", "  ", "\n", " \n "]) for p in parts))
    return out


def tokens(libraries, text):
    """((id, bytes), ...) of A and of B, none where they don't spell the text."""
    t, s = libraries
    if not text:
        return [], []
    back = op.byte_alphabet()
    a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()) for i in s.encode(text)]
    whole = b" " + text.encode()
    return (a, b) if all(b"".join(x for _, x in own) == whole for own in (a, b)) else ([], [])


def ranges(own):
    at, out = 0, []
    for i, x in own:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(libraries, rows):
    links, counts, out = [], defaultdict(set), []
    for k, (_, text) in enumerate(rows):
        a, b = map(ranges, tokens(libraries, text))
        own = Counter((i, j) for i, x, y in a for j, p, q in b if x < q and p < y)
        links.append(own)
        for pair in own:
            counts[pair].add(k)
        cuts = sorted({y for *_, y in a} & {q for *_, q in b})
        groups = [",".join(str(i) for i, _, y in a if lo < y <= hi) + "|" + ",".join(str(j) for j, _, q in b if lo < q <= hi) for lo, hi in zip([0, *cuts], cuts)]
        out.append((len(a), len(b), len(cuts), sum(own.values()), ";".join(groups)))
    highest = defaultdict(int)
    for (i, j), docs in counts.items():
        highest[i] = max(highest[i], len(docs))
    full = []
    for (doc_id, _), own, (n_a, n_b, n_groups, n_links, groups) in zip(rows, links, out):
        best = sum(n for p, n in own.items() if len(counts[p]) == highest[p[0]])
        full.append((doc_id, n_a, n_b, n_groups, n_links, best, sum(n * len(counts[p]) for p, n in own.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return full


def test_ids_are_the_libraries(libraries):
    t, s = libraries
    a, b = op.ByteTokens(A), op.PieceTokens(B)
    assert b.parts
    assert a.ranked is not None
    texts = ["", *made(1, 3000)]
    for text, own_a, own_b in zip(texts, a.all(texts), b.all(texts)):
        assert own_a == (op.np.array(t.encode(" " + text, add_special_tokens=False).ids, dtype="<u4").tobytes() if text else b"")
        if "▁" not in text:
            assert own_b == op.np.array(s.encode(text), dtype="<u4").tobytes(), repr(text)
    a.ranked = None  # without ranks the library encodes the words
    words = [w for text in texts[:300] for w in a.words(text) or ()]
    assert a.learn(words) == op.ByteTokens(A).learn(words)


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_counts_and_digests(spark, libraries, monkeypatch, hot):
    monkeypatch.setattr(op, "AXIS", 500)
    rows = list(enumerate(made(2, 120))) + [(7, None), (None, ""), (None, "The quick"), (5, "The quick"), (5, "The quick"), (-3, "▁x"), (2**62, " ")]
    df = spark.createDataFrame([(i, t, "", "", 0, 1, 2, "g", 3, 4) for i, t in rows], DOCS).repartition(3)
    aligned = op.stored(op.align(df, A, B), "aligned")
    counts = op.stored(op.pair_counts(aligned, A, B), "counts")
    got = op.linked_counts(aligned, counts, A, B, hot=hot).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(libraries, rows), key=str)
    texts = op.align(df, A, B, groups=True)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r.groups_sha256 if r["groups"] else not r.groups_sha256 for r in texts.collect())


def test_long_text_and_empty_table(spark, libraries):
    text = " ".join(made(5, 9000)).replace("▁", "_")  # several megabytes with what follows
    text = text * (1 + (3 << 20) // len(text))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    aligned = op.stored(op.align(df, A, B), "aligned")
    a, b = map(ranges, tokens(libraries, text))
    r = aligned.first()
    assert (r.n_a, r.n_b, r.n_groups) == (len(a), len(b), len({y for *_, y in a} & {q for *_, q in b})) and r.n_links == r.n_a + r.n_b - r.n_groups
    out = op.linked_counts(aligned, op.stored(op.pair_counts(aligned, A, B), "counts"), A, B).first()
    assert out.count_sum == out.n_links == out.n_best  # one document: every pair is in one
    none = op.align(df.limit(0), A, B)
    assert op.linked_counts(none, op.pair_counts(none, A, B), A, B).count() == 0
