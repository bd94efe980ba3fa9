"""Each operator against a plain version on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op1_warc, op2_fingerprints, op3_quality, op4_repeated_phrases, op5_mixing, op6_top_k, op7_pii, op8_packing, op9_token_counts, op10_jaccard_join
from tessera.llm.bpe_words import PrefixCounts, WordIds
from tessera.llm.common import IdShards, shared_dir
from tessera.llm.linking import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, `key` string, score double, shard_ int, taken string"


def made(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, texts = say(70), []
    for k in range(n):
        kind = k % 10
        if kind == 1:
            texts.append(texts[-1])
        elif kind == 2:
            w = texts[0].split()
            w[rng.randrange(len(w))] = "Edit"
            texts.append("\t".join(w) if k % 20 == 2 else " ".join(w))
        elif kind == 3:
            texts.append(f"{say(20)} {passage}\n{say(30)}")
        elif kind == 4:
            texts.append([None, "", " \n", "one", "Two words", "a b c"][k // 10 % 6])
        elif kind == 5:
            texts.append("shout " * rng.randint(60, 90))
        else:
            texts.append(say(rng.randint(60, 160)).capitalize() + ".")
    texts.append(say(9000))
    return texts


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(3 * k, t, "en", None if k % 7 == 0 else f"s{k % 5}", len(t or ""), 5, "x", "y", 0.5, 1, "z") for k, t in enumerate(made())]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()))


def test_warc_round_trip(spark):
    big = "é" * 900
    pages = [(k, f"http://a/{k}", big if k in (2, 5, 9) else "same" if k % 2 else None if k == 4 else f"page {k} " * 200) for k in range(12)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, payload string, id int")
    out = shared_dir(spark, "warc-test")
    manifest = op1_warc.write(df, out, roll_bytes=700)
    got = {r.id: r for r in op1_warc.read(manifest).collect()}
    assert len(got) == 12 and manifest.count() > 1
    for k, url, html in pages:
        raw = (html or "").encode()
        r = got[k]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(raw), hashlib.sha1(raw).hexdigest())
        revisit = k in (2, 5)
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
        assert r.payload == (None if revisit else html or "")
    again = op1_warc.write(df.repartition(5), shared_dir(spark, "warc-test"), roll_bytes=700)
    assert sorted(r.sha256 for r in again.collect()) == sorted(r.sha256 for r in manifest.collect())
    assert op1_warc.read(op1_warc.write(df.limit(0), shared_dir(spark, "warc-test"))).count() == 0


def test_fingerprints(spark, docs, none):
    got = {r.doc_id: r for r in op2_fingerprints.edited_fingerprints(docs).collect()}
    own = rows_of(docs)
    sets = [set(zip(*[t.encode().split()[i:] for i in range(5)])) or ({tuple(t.split())} if t.split() else set()) for _, t in own]
    for k, (i, t) in enumerate(own):
        nxt = own[(k + 1) % len(own)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        other = sets[(k + 1) % len(own)]
        if sets[k] or other:
            assert abs(got[i].near_next - len(sets[k] & other) / len(sets[k] | other)) < 0.2
    by = defaultdict(set)
    for i, t in own:
        by[t].add(got[i].fingerprint)
    assert all(len(f) == 1 for f in by.values())
    assert op2_fingerprints.edited_fingerprints(none).count() == 0
    one = op2_fingerprints.edited_fingerprints(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def brute_components(texts, k, num, den, lower):
    sets, parent = [], list(range(len(texts)))
    for _, t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {texts[a][0]: (len(sets[a]), texts[top(a)][0]) for a in range(len(sets))}


def test_jaccard_join(spark, docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_jaccard_join.join(docs).collect()}
    assert got == brute_components(rows_of(docs), 4, 85, 100, True)
    assert op10_jaccard_join.join(none).count() == 0


def test_minhash_near_duplicates(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_fingerprints.near_duplicates(docs).collect()}
    assert got == brute_components(rows_of(docs), 5, 80, 100, False)


def test_jaccard_join_of_a_family_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append((k, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(op10_jaccard_join, "BLOCK_NODES", 20)
    monkeypatch.setattr(op10_jaccard_join, "FAMILY", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_jaccard_join.join(df).collect()}
    assert got == brute_components(texts, 4, 85, 100, True)


def test_dual_traversal_keeps_every_link():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(20, 40), dtype=np.uint64)) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[1:], rng.integers(0, 2**63, 1, dtype=np.uint64)])) for s in sets]
    from tessera.llm.linking import bitmap

    sizes = np.array([len(s) for s in sets])
    tree = op10_jaccard_join.SignatureTree(op10_jaccard_join._folded([bitmap(s, 2) for s in sets]), sizes, np.arange(len(sets)))
    found = set(zip(*(x.tolist() for x in op10_jaccard_join.dual_traversal(tree, tree, 85, 100))))
    for a in range(len(sets)):
        for b in range(a):
            c = len(np.intersect1d(sets[a], sets[b]))
            if 100 * c >= 85 * (sizes[a] + sizes[b] - c):
                assert (b, a) in found


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.comp for r in components(e).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_quality(spark, docs, none):
    labels = docs.select("doc_id", F.when(F.col("text").startswith("shout"), 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic")).unionByName(spark.createDataFrame([(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int"))
    model = op3_quality.train(docs, labels)
    got = op3_quality.score(docs, model, name="s").select("doc_id", "text", "s").collect()
    assert len(got) == docs.count() and all(0 <= r.s <= 1 for r in got)
    assert all((r.s >= 0.7) != (r.text or "").startswith("shout") for r in got if r.text and len(r.text) > 100)
    flat = op3_quality.train(docs, labels.where("quality = 1"))
    assert abs(op3_quality.score(docs, flat, name="s").first()["s"] - 0.7) < 1e-9
    assert op3_quality.score(none, op3_quality.train(none, labels.limit(0)), keep=["doc_id"]).count() == 0


def test_repeated_phrases(spark, docs, none):
    got = {r.doc_id: r for r in op4_repeated_phrases.repeated_spans(docs).collect()}
    first, words = {}, {}
    for i, t in rows_of(docs):
        words[i] = WORD.findall(t)
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    gone_any = 0
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        gone_any += sum(gone)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert sum(e - s for s, e in got[i].spans) == sum(gone)
    assert gone_any and op4_repeated_phrases.repeated_spans(none).count() == 0


def test_mixing(spark, docs, none):
    got = op5_mixing.mix(docs).collect()
    own = {r.doc_id: r for r in docs.collect()}
    size = {i: len(WORD.findall(r.text or "")) for i, r in own.items()}
    names = sorted({r.source for r in own.values() if r.source is not None}) + [None]
    total = {s: sum(size[i] for i, r in own.items() if r.source == s) for s in names}
    weight, goal, left, rest = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names), sum(size.values())
    while left:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * total[s]]
        goal |= {s: 3 * total[s] for s in over} if over else share
        rest -= sum(3 * total[s] for s in over)
        left = left - set(over) if over else set()
    taken = defaultdict(int)
    for r in got:
        s = own[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and abs(r.target - goal[s]) < 1e-6 * (1 + goal[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == len(own) and all(abs(taken[s] - goal[s]) <= 8 for s in names)
    assert sorted(map(tuple, op5_mixing.mix(docs.repartition(5)).collect())) == sorted(map(tuple, got))
    assert op5_mixing.mix(none).count() == 0 and op5_mixing.mix(docs.where("text is null")).first().taken == 0


@pytest.mark.parametrize("scale", [256, 1e8])
def test_top_k(spark, scale):
    rng = np.random.default_rng(1)
    v = [(k, [float(np.float32(x)) for x in rng.normal(size=8 if k % 9 else 5)]) for k in range(300)]
    v += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (404, v[3][1]), (404, v[3][1]), (405, v[3][1])]
    df = spark.createDataFrame([(*x, 1) for x in v], "vec_id long, embedding array<float>, id int")
    own = op6_top_k.whole_vectors(df, "vec_id", "embedding", scale)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op6_top_k.top_k(own, own.where("id % 50 = 0")).collect())
    whole = {r.id: [int(x) for x in r.v] + [0] * (8 - len(r.v)) for r in own.collect()}
    assert set(whole) == set(range(300)) | {404, 405}
    want = []
    for q in (x for x in whole if x % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    empty = op6_top_k.whole_vectors(df.limit(0), "vec_id", "embedding", 256)
    assert op6_top_k.top_k(empty, empty).count() == 0


def test_pii(spark, none):
    field = op7_pii.trained()
    phone, card, mail, ip = "+1 (578) 555-6437", "4918187128635271", "a.b@mail1.example.com", "10.1.2.3"
    text = f"é {phone} {card} x {mail}, {ip} {card}. 1998 12,345 {phone}"
    base, every = op7_pii.spans_of(text, field)
    assert [text[s:e] for k, s, e in every if k == "phone"] == [phone, phone]
    assert [text[s:e] for k, s, e in every if k == "card"] == [card, card]
    assert [text[s:e] for k, s, e in every if k in ("email", "ip")] == [mail, ip] and set(base) <= set(every)
    assert "example" not in op7_pii.redacted(text, field) and "[CARD]" in op7_pii.redacted(text, field)
    plain = {
        "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }
    digits = lambda s: [c for c in s if "0" <= c <= "9"]
    test = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(digits(s)) <= 19 and op7_pii.luhn("".join(digits(s))),
        "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    rng, rows = random.Random(2), []
    for k in range(400):
        parts = [rng.choice([phone, card, mail, ip, "a@b", "1.2.3", "@", "+1", "55 66", "4111 1111 1111 1111", "299.1.1.1", "é", "word.", "(1)"]) for _ in range(rng.randint(0, 9))]
        rows.append((k, rng.choice(["", " ", "  ", ", "]).join(parts), "q"))
    rows += [(900, None, "q"), (901, "", "q"), (901, "", "q"), (902, "1" * 200_000 + "@" + "a" * 200_000, "q")]
    got = op7_pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    by = {i: t or "" for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        want = []
        for kind, pattern in plain.items() if r.doc_id != 902 else ():
            want += [f"{kind}:{m.start()}:{m.end()}" for m in pattern.finditer(by[r.doc_id]) if test[kind](m[0])]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",") if r.spans else [])
        assert sum((r.n_email, r.n_ip, r.n_card, r.n_phone)) == len(want)
    assert op7_pii.find_pii(none).count() == 0


def test_pii_field_on_unseen_sequences():
    field, rng, right = op7_pii.trained(), random.Random(77), 0
    for _ in range(300):
        text, spans = op7_pii._made(rng)
        got = []
        for run in op7_pii.runs(text):
            got += field.read(text, run)
        right += sorted(got) == sorted(spans)
    assert right >= 285


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


def test_packing(spark, docs, none):
    path = vocabulary("word_bpe_49k.json")
    pieces = op8_packing.cut_pieces(docs, path, capacity=512)
    got = op8_packing.pack(pieces, capacity=512, shard_pieces=20).collect()
    lib = WordIds(path).lib
    by, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, t in rows_of(docs):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 512)) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert op8_packing.pack(op8_packing.cut_pieces(none, path)).count() == 0


def test_best_two_fit():
    assert sorted(map(sorted, op8_packing.best_two_fit([6, 3, 2, 2, 2], 10))) == [[0, 2, 3], [1, 4]]
    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(2000)]
    bins = op8_packing.best_two_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(2000)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= sum(lengths) / 100 * 1.06
    assert op8_packing.best_two_fit([], 10) == []


ODD = ["", "  ", "we'll  don't\n\n x's ''' 're <|endoftext|> hi", "日本語 テキスト ​ ½", "İstanbul ΑΣ", "a" * 900, "1234 + 56'7 '' 's", "café", "\x1c\x85 a", "A'S \t'LL we'r e"]


def test_token_counts(spark, docs, none):
    path = vocabulary("byte_bpe_50k.json")
    counts = PrefixCounts(path)
    size = lambda t: len(counts.lib.encode(t, add_special_tokens=False).ids)
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    for df in (docs, odd):
        own = rows_of(df)
        got = {r.doc_id: r for r in op9_token_counts.token_counts(df, path, budget=20).collect()}
        for i, t in own:
            assert (got[i].n_bytes, got[i].n_tokens) == (len(t.encode()), size(t))
            k = got[i].fit_chars
            assert size(t[:k]) <= 20 and all(size(t[:j]) > 20 for j in range(k + 1, min(len(t), k + 12) + 1))
    for t in [*ODD, made()[0][:300]]:
        table = counts.table(t)
        assert all(table.at(k) == size(t[:k]) for k in range(min(len(t), 300) + 1))
    assert op9_token_counts.token_counts(none, path).count() == 0


def test_word_ids_are_the_librarys():
    words = WordIds(vocabulary("word_bpe_49k.json"))
    for t in [*ODD, *[t or "" for t in made()]]:
        assert np.frombuffer(words.ids([t])[0], "<u4").tolist() == words.lib.encode(t, add_special_tokens=False).ids


def test_id_shards_are_ranges(spark):
    df = spark.createDataFrame([(k * k,) for k in range(500)] + [(None,)], "id long")
    s = IdShards(df, "id", F.lit(1), 7)
    got = s.assign(df).collect()
    assert len(got) == 501 and 2 <= s.n <= 7
    by = defaultdict(list)
    for r in got:
        by[r.shard_].append(-1 if r.id is None else r.id)
    edges = [(min(v), max(v)) for _, v in sorted(by.items())]
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
    assert all(sum(r.opens_ for r in got if r.shard_ == k) == 1 for k in by)
