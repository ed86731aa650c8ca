"""Operators against brute force, SQL, round trips and held-out rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import DATA, plain
from hypothesis import given, settings
from hypothesis import strategies as st

from tallytree.llm.hashing import mixed as common_mixed
from tallytree.llm import common, components, decontaminate, language, pieces, quality, queries, repetition, rollups, simhash, suffixes, tokens, toxicity, training_order

SF = f"{DATA}/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, duck, name):
    out = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    cursor = duck.execute(queries.ORACLES[name])
    assert plain(out.collect(), out.columns) == plain(cursor.fetchall(), [d[0] for d in cursor.description])


# --- suffix-array dedup ---


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        at = np.concatenate([[0], np.cumsum([len(x.encode()) for x in t.decode()])]).astype(int)
        whole = "".join(x for x, a, b in zip(t.decode(), at, at[1:], strict=False) if not gone[a:b].any())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), whole))
    return out


@pytest.mark.parametrize("group,anchor", [(60_000, 16), (2, 16), (60_000, 40)])
def test_suffix_dedup(spark, group, anchor):
    rng = random.Random(group + anchor)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(200)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages, rows = [text(12) for _ in range(4)], []
    for k in range(80):
        t = text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice(passages)[rng.randint(0, 9) :] + t[at:]
        rows.append((k, t))
    rows += [(200, "x" * 300), (201, "ab" * 200), (5, rows[5][1]), (202, rows[9][1] + "é"), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.suffix_dedup(df, 40, anchor, group).collect()
    want = brute_repeats([t.encode() for _, t in rows], 40)
    assert Counter(tuple(r)[1:] for r in got) == Counter(want)


def brute_spans(texts, length, words):
    """Texts without the bytes in strings of ``length`` and runs of ``words`` words that start elsewhere too, and how many those are."""
    found = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    units = [[t[a:b] for a, b in own] for t, own in zip(texts, found, strict=True)]
    runs = Counter(tuple(u[i : i + words]) for u in units for i in range(len(u) - words + 1))
    strings = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t, own, u in zip(texts, found, units, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if strings[t[i : i + length]] > 1:
                gone[i : i + length] = True
        for i in range(len(u) - words + 1):
            if runs[tuple(u[i : i + words])] > 1:
                gone[own[i][0] : own[i + words - 1][1]] = True
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g).decode(errors="ignore"), int(gone.sum())))
    return out


@pytest.mark.parametrize("group", [60_000, 2])
def test_suffix_dedup_by_words(spark, group):
    """Passages of over 50 words and fewer than 400 bytes, whatever white space stands between the words."""
    rng = random.Random(group)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages, rows = [text(n).split() for n in (50, 51, 58, 64)], []
    for k in range(60):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice([" ", "\n", " \t "]).join(rng.choice(passages)[rng.randint(0, 6) :]), text(rng.randint(1, 30))]
        rows.append((k, " ".join(parts)))
    rows += [(100, "a " * 80), (101, text(50)), (102, rows[3][1].replace(" ", "  ")), (None, "\n" + rows[4][1]), (103, None), (104, "z" * 390 + " " + "z" * 390)]
    texts = [(t or "").encode() for _, t in rows]
    want = brute_spans(texts, 400, 51)
    assert want != brute_spans(texts, 400, 10**6) and any(0 < n < 400 for _, n in want)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.text, r.n_removed) for r in suffixes.suffix_dedup(df, group=group).collect()) == Counter(want)
    assert Counter((r.text, r.n_removed) for r in suffixes.suffix_dedup(df, group=group, words=0).collect()) == Counter(brute_spans(texts, 400, 10**6))
    assert Counter(r.text or "" for r in suffixes.drop_repeats(df, group=group).collect()) == Counter(t for t, _ in want)


def test_pipeline_cuts_passages_of_over_50_words(spark):
    import corpus_pipeline

    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))
    passage, alone, begins, ends = text(55), text(300), [text(60), text(70)], [text(80), text(20)]
    assert len(passage) < 350
    docs = spark.createDataFrame([*((k, f"{a} {passage} {b}") for k, (a, b) in enumerate(zip(begins, ends, strict=True))), (2, alone)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
    assert got == {0: f"{begins[0]}  {ends[0]}", 1: f"{begins[1]}  {ends[1]}", 2: alone}


def test_suffix_dedup_of_whole_documents(spark):
    docs = common.table(spark, f"{DATA}/sf0.001", "documents")
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op2_suffix_dedup"](spark, f"{DATA}/sf0.001").collect()}
    rows = docs.collect()
    assert got == {r.doc_id: w for r, w in zip(rows, brute_repeats([r.text.encode() for r in rows], 400), strict=True)}


@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), max_size=25), st.sampled_from([8, 16, 64]))
@settings(max_examples=200, deadline=None)
def test_deep_shallow_sorting(texts, shallow):
    assert [texts[k] for k in suffixes.deep_shallow(texts, list(range(len(texts))), shallow)] == sorted(texts)


@given(st.binary(max_size=60).map(lambda b: bytes(x % 2 for x in b)), st.binary(max_size=60).map(lambda b: bytes(x % 2 for x in b)))
@settings(max_examples=300, deadline=None)
def test_common_prefix(x, y):
    assert suffixes.lcp(x, y) == next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))


# --- simhash ---


def test_simhash_components(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op8_simhash_near_dedup"](spark, SF).collect()}
    prints = {}
    for r in common.table(spark, SF, "documents").collect():
        words = r.text.encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        votes = np.zeros(64, int)
        for g in grams:
            h = xxhash.xxh64_intdigest(g, 42)
            votes += [(h >> b) & 1 for b in range(64)]
        prints[r.doc_id] = sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))
    assert {k: f"{v:016x}" for k, v in prints.items()} == {k: r.fingerprint for k, r in got.items()}
    ids = sorted(prints)
    fps = np.array([prints[k] for k in ids], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    comp = np.array(ids)
    while not (now := np.array([comp[row].min() for row in near]) == comp).all():
        comp = np.array([comp[row].min() for row in near])
    assert {k: c for k, c in zip(ids, comp.tolist(), strict=True)} == {k: r.component_id for k, r in got.items()}


@pytest.mark.parametrize("bucket", [256, 3])
def test_covering_masks_find_every_pair(spark, bucket):
    """Chains of fingerprints two and three bits apart, and hot buckets that must be divided."""
    rng = random.Random(bucket)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for base in list(fps)[:12]:
        x = base
        for _ in range(30):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
    signed = sorted(simhash._signed(x) for x in fps)
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=bucket).collect()
    assert all((r.u ^ r.v & (2**64 - 1)).bit_count() <= 64 and ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 3 for r in found)
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[root(r.u)] = root(r.v)
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
            assert root(a) == root(b)


def test_masks_cover_every_triple():
    masks = simhash.masks(list(range(64)), 3, simhash.SEED)
    assert len(masks) == 15 and all(any(not m & (1 << a | 1 << b | 1 << c) for m in masks) for a, b, c in itertools.combinations(range(64), 3))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)] + [(500, 500), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {x: x for l in links if None not in l for x in l}
    for _ in parent:
        for u, v in links:
            if u is not None:
                parent[u] = parent[v] = min(parent[u], parent[v])
    assert got == {x: p for x, p in parent.items() if x != 500}


# --- rules, windows, pieces ---


@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("ab"), max_size=20))
@settings(max_examples=200, deadline=None)
def test_repeats_by_intervals(letters, others):
    texts = [[x.encode() for x in letters], [], [x.encode() for x in others], [x.encode() for x in letters]]
    for least in (1, 3):
        got, longest, offsets = repetition.longest_repeats(texts, least)
        for k, words in enumerate(texts):
            n = len(words)
            at = lambda i, j: next((k for k in range(n - max(i, j)) if words[i + k] != words[j + k]), n - max(i, j))  # noqa: B023, E731
            want = [max([at(i, j) for j in range(n) if j != i], default=0) for i in range(n)]
            spans, union = np.zeros(n, bool), np.zeros(n, bool)
            for i, size in enumerate(want):
                if size >= least:
                    union[i : i + size] = True
            repeats = repetition.maximal_repeats(words, least)
            for length, starts in repeats:
                assert len({tuple(words[s : s + length]) for s in starts}) == 1 and len(starts) > 1
                for s in starts:
                    spans[s : s + length] = True
            own = got[offsets[k] : offsets[k + 1]]
            assert union.tolist() == spans.tolist() == repetition.covered(own, least).tolist()
            assert longest[k] == max([x for x in want if x >= least], default=0) == max([x for x, _ in repeats], default=0)


def test_windows_in_blocks(spark):
    docs, bench = (common.table(spark, f"{DATA}/sf0.001", t) for t in ("documents", "benchmark"))
    whole = decontaminate.contamination(docs, bench).collect()
    assert sorted(whole) == sorted(decontaminate.contamination(docs, bench, block_words=100).collect())
    kept = {r.doc_id for r in whole if not r.contaminated}
    for words in (100, 10**6):
        assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, block_words=words).collect()} == kept
    # rows with one id, or none, are judged one by one
    passage = bench.first().text
    rows = spark.createDataFrame([(i, t) for i in (7, None) for t in (passage, "a clean text of its own", None)], "doc_id long, text string")
    for words in (100, 10**6):
        left = decontaminate.drop_contaminated(rows, bench, block_words=words).collect()
        assert sorted(left, key=repr) == sorted(((i, t) for i in (7, None) for t in ("a clean text of its own", None)), key=repr)
    assert decontaminate.remove_spans("One, two THREE four-five.", [(1, 2), (4, 1)]) == "One,  four-."


@given(st.text(alphabet="abeht \n☃é1", max_size=9))
@settings(max_examples=150, deadline=None)
def test_n_best(text):
    v = pieces.pieces()
    found = []

    def go(a, ids, score):
        if a == len(text) + 1:
            return found.append((score, tuple(ids)))
        whole, alone = " " + text, True
        for b in range(a + 1, len(whole) + 1):
            if whole[a:b] in v.table:
                alone = alone and b > a + 1
                go(b, ids + [v.table[whole[a:b]][0]], score + v.table[whole[a:b]][1])
        if alone:
            go(a + 1, ids + [v.byte[x] for x in whole[a].encode()], score + v.lowest)

    if text:
        go(0, [], 0.0)
        got = v.encode(text, 6)
        assert [s for _, s in got] == [s for s, _ in sorted(found, reverse=True)[:6]]
        assert {(s, tuple(i.tolist())) for i, s in got} <= set(found) and len({tuple(i.tolist()) for i, _ in got}) == len(got)
        assert [s for _, s in v.n_best(" " + text, 6)] == [s for _, s in got]
        assert all(v.decode(i.tolist()) == text for i, _ in got)


@pytest.mark.parametrize("piece", ["a▁", "a▁b", "\n\n", "▁\n", "a\n"])
def test_pieces_that_cross_chunks_are_refused(monkeypatch, piece):
    """The lattice falls apart into chunks only if no piece goes over their borders."""
    import sentencepiece

    class Model:
        names = ["a", "b", "▁▁a"]

        def __init__(self, model_file):
            self.is_byte = self.is_control = self.is_unknown = self.is_unused = lambda i: False

        vocab_size = lambda self: len(self.names)
        id_to_piece = lambda self, i: self.names[i]
        get_score = lambda self, i: -float(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    assert len(pieces.Pieces("some").table) == 3
    Model.names = [*Model.names, piece]
    with pytest.raises(ValueError, match="may not go on"):
        pieces.Pieces("some")


def test_pieces_round_trip(spark):
    assert all(r.round_trip for r in queries.QUERIES["op7_sentencepiece"](spark, f"{DATA}/sf0.001").collect())
    docs = common.table(spark, f"{DATA}/sf0.001", "documents")
    assert {tuple(r) for r in pieces.decode(pieces.encode(docs)).collect()} == {(r.doc_id, r.text) for r in docs.collect()}


# --- models ---


@pytest.mark.parametrize("name,label,least", [("op3_quality_classifier", "quality", 0.95), ("op5_toxicity", "toxic", 0.95)])
def test_held_out_labels(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF)
    again = {r.doc_id: r.score for r in queries.QUERIES[name](spark, SF).collect()}
    rows = got.join(common.table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least
    assert all(0 <= r.score <= 1 and again[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in rows)


def plain_features(text):
    """The classifier's inputs, character by character."""
    raw = text.encode()
    if not raw.split():
        return [np.log1p(len(raw))] + [0.0] * (len(quality.FEATURES) - 1)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else [raw]
    k, seen, n = len(words), Counter(words), len(raw)
    white = sum(c in b" \t\v\f\r\n" for c in raw)
    count = lambda chars: sum(c in chars for c in raw)
    upper, digit, symbol, bang = (count(x) for x in (bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>^~=@_{}[]\\/+", b"!"))
    lower, wide = count(bytes(range(97, 123))), sum(c >= 128 for c in raw)
    visible = n - white
    other = visible - upper - lower - digit - symbol - bang - wide
    grams = [tuple(words[i : i + 4]) for i in range(k - 3)]
    letter = lambda w: any(chr(c).isalpha() and c < 128 for c in w)
    return [
        np.log1p(n), np.log1p(k), visible / k, upper / visible, digit / visible, symbol / visible, bang / visible, other / visible, raw.count(b"\n") / n, wide / visible,
        -sum(c / n * np.log2(c / n) for c in Counter(raw).values()), len(seen) / k, max(seen.values()) / k, 1 - len(set(grams)) / max(1, k - 3), 1 - len(set(lines)) / len(lines),
        sum(w[-1] < 128 and not chr(w[-1]).isalnum() for w in words) / k, sum(all(c < 128 for c in w) and not letter(w) for w in words) / k, sum(len(w) <= 3 for w in words) / k,
        np.log1p(max(map(len, words))), np.log1p(k / len(lines)),
    ]


def test_quality_scores_by_brute_force(spark):
    """The registered query, row by row: features by characters, then intercept, tables and pairs looked up one by one."""
    sf = f"{DATA}/sf0.001"
    docs = common.table(spark, sf, "documents")
    model = quality.train(docs, common.table(spark, sf, "labels"))
    got = {r.doc_id: r for r in queries.QUERIES["op3_quality_classifier"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    bin_ = lambda cuts, v: sum(1 for c in cuts if c <= v)
    for doc, text in texts.items():
        x = plain_features(text)
        assert quality.features(text.encode()) == pytest.approx(x, abs=1e-9), doc
        x = quality.features(text.encode())
        total = model.intercept + sum(model.tables[j][bin_(model.cuts[j], v)] for j, v in enumerate(x)) + sum(t[bin_(ca, x[a]), bin_(cb, x[b])] for a, b, ca, cb, t in model.pairs)
        score = 1 / (1 + np.exp(-total))
        assert got[doc].score == pytest.approx(score, abs=1e-6) and got[doc].predicted == int(got[doc].score >= 0.3) and got[doc].held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)


def test_toxicity_scores_by_brute_force(spark):
    """The registered query, row by row: the product over sentences that none of them is toxic."""
    sf = f"{DATA}/sf0.001"
    docs = common.table(spark, sf, "documents")
    model = toxicity.train(docs, common.table(spark, sf, "labels"))
    assert model.weights and all(w > 0 for w in model.weights.values())
    got = {r.doc_id: r for r in queries.QUERIES["op5_toxicity"](spark, sf).collect()}
    for r in docs.collect():
        clean = np.exp(-model.leak)
        for sentence in re.split(r"[.!?\n]", r.text.lower()):
            words = re.findall(r"[a-z\u0080-\U0010ffff]+", sentence)
            z = sum(model.weights.get(x.encode(), 0) for w in words for x in [w, *("^" + w[:n] for n in (4, 5, 6, 7) if len(w) > n)])
            clean *= (1 + np.exp(model.bias)) / (1 + np.exp(model.bias + z))
        assert got[r.doc_id].score == pytest.approx(1 - clean, abs=1e-6) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_scores_by_brute_force(spark):
    """Every row's prediction from forward and backward sums over its whole chain, word by word, n-gram by n-gram."""
    docs = common.table(spark, f"{DATA}/sf0.001", "documents")
    model = language.train(docs, per_language=40)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.language_scores(docs, model).collect()}
    k = len(model.languages)
    for row in docs.orderBy("n_chars").limit(60).collect():
        words = language.words_of(row.text.encode())
        if not words:
            assert got[row.doc_id] == ("und", 0.0)
            continue
        e = np.array([model.emissions([w])[0] for w in words])
        alpha, beta = [e[0] + model.first], [np.zeros(k)]
        for x in e[1:]:
            alpha.append(x + np.logaddexp.reduce(alpha[-1][:, None] + model.steps, axis=0))
        for x in e[:0:-1]:
            beta.append(np.logaddexp.reduce(model.steps + x + beta[-1], axis=1))
        log = np.array(alpha) + np.array(beta[::-1])
        gamma = np.exp(log - np.logaddexp.reduce(log, axis=1)[:, None]).mean(axis=0)
        assert got[row.doc_id] == (model.languages[int(gamma.argmax())], pytest.approx(min(1.0, gamma.max()), abs=1e-6))


def test_samples_are_bounded_in_rows(spark):
    """An id a thousand times is one row of the sample."""
    rows = [(1, f"text {k:04d}", "en") for k in range(1000)] + [(k, f"text of {k}", "de") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 40)], "doc_id long, quality int, toxic int")
    got = common.bounded_labels(docs, labels, "quality", 100).collect()
    assert len(got) == len({r.doc_id for r in got}) and [bytes(r.text) for r in got if r.doc_id == 1] == [b"text 0000"] * (not common.is_held_out(1))
    assert language.train(docs).languages == (["de"] if common.is_held_out(1) else ["de", "en"])


def test_offending_sentences():
    model = toxicity.NoisyOr({b"idiot": 9.0}, -4.0, 0.001)
    score, found = model.score(b"A fine day. You idiot! Goodbye.")
    assert score > 0.9 and [k for k, _ in found] == [1]
    assert model.score(b"clean " * 50_000)[0] < 0.01


def test_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit(x, y, np.ones(len(y)), rounds=10)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_held_out_languages(spark):
    rows = queries.QUERIES["op6_language_id"](spark, SF).join(common.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95


def test_whole_texts_are_learned_from(spark):
    """Every document opens with one notice of 200 words; only what follows tells the languages apart."""
    rng = random.Random(8)
    notice = " ".join("".join(rng.choices("klmnop", k=6)) for _ in range(200))
    own = {lang: ["".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(60)] for lang, letters in (("aa", "abcde"), ("bb", "uvwxyz"))}
    rows = [(k, lang, " ".join([notice, *rng.choices(own[lang], k=60)])) for k in range(60) for lang in [("aa", "bb")[k % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.train(docs)
    texts = spark.createDataFrame([(k, " ".join(rng.choices(own[lang], k=20))) for k, lang in enumerate(("aa", "bb") * 10)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.language_scores(texts, model).collect()} == dict(enumerate(("aa", "bb") * 10))


def test_code_switching(spark):
    docs = common.table(spark, SF, "documents")
    model = language.train(docs, per_language=150)
    some = {lang: docs.where(f"lang = '{lang}' AND n_chars BETWEEN 500 AND 3000").orderBy("doc_id").first().text.split()[:30] for lang in ("en", "de")}
    labels = [y for _, y in language.label_words(model, " ".join(some["en"] + some["de"]))]
    assert Counter(labels[:25]).most_common(1)[0][0] == "en" and Counter(labels[-25:]).most_common(1)[0][0] == "de"


def test_forward_backward():
    rng = np.random.default_rng(1)
    e, A = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    gamma, moved, first, logz = language.posteriors(e, np.array([4, 3]), A, np.zeros(3))
    for a, n in ((0, 4), (4, 3)):
        paths = list(itertools.product(range(3), repeat=n))
        w = np.array([np.exp(sum(e[a + t, p[t]] for t in range(n)) + sum(A[p[t], p[t + 1]] for t in range(n - 1))) for p in paths])
        for t in range(n):
            for k in range(3):
                assert gamma[a + t, k] == pytest.approx(sum(x for x, p in zip(w, paths, strict=True) if p[t] == k) / w.sum())
        logz -= np.log(w.sum())
    assert logz == pytest.approx(0) and moved.sum() == pytest.approx(5)


def test_a_text_is_one_chain():
    """Pieces of a text give the posteriors of its whole chain, with first-label scores at its first word only."""
    rng = np.random.default_rng(2)
    sizes = np.array([1, 0, 5, 64, 65, 131, 0, 700])
    e, A, first = 3 * rng.normal(size=(sizes.sum(), 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    want = language.posteriors(e, sizes[sizes > 0], A, first)[0]
    for piece in (1, 2, 7, 64):
        assert language.text_posteriors(e, sizes, A, first, piece) == pytest.approx(want, abs=1e-9)
    model = language.Chain(["a", "b"], np.zeros((1 << language.BITS, 2), np.float32), np.array([[3.0, -3], [-3, 3]]), np.array([0.0, 2.0]))
    assert language._predict(model, [b"word " * 200])[1][0] > 0.5  # no emission tells: all comes from the first label
    gamma = language.posteriors(np.zeros((200, 2)), np.array([200]), model.steps, model.first)[0]
    assert language._predict(model, [b"word " * 200])[1][0] == pytest.approx(gamma[:, 1].mean())


# --- training order, token counts, pipeline ---


@given(st.integers(1, 5000), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_permutation(n, key):
    p = training_order.Permutation(n, key)
    slots = p.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (p.numbers(slots) == np.arange(n)).all()


def test_training_order_gives_back_the_texts(spark, tmp_path):
    docs = common.table(spark, f"{DATA}/sf0.001", "documents")
    out = f"file://{tmp_path}/t"
    rows = training_order.materialise(docs, out, 64, 1 << 16).orderBy("slot").collect()
    by = {}
    for r, ids in zip(rows, training_order.read(spark, out, 0, len(rows), 64), strict=True):
        by.setdefault(r.doc_id, {})[r.seq_no] = ids[: r.n_tokens].tolist()
    for r in docs.collect():
        ids = [x for k in sorted(by[r.doc_id]) for x in by[r.doc_id][k]]
        assert ids[-1] == tokens.END and tokens.encoding().decode(ids[:-1]) == r.text


def brute_order(rows, length, shards, key=training_order.KEY):
    """Slots, shards, offsets and padded sequences by the definition: numbers, a scalar Feistel network, and a sort."""
    n = len(rows) << training_order.PLACE
    half = -(-(n - 1).bit_length() // 2)
    mask = (1 << half) - 1
    mix = lambda x: int(common_mixed(np.array([x & (2**64 - 1)], np.uint64))[0])
    keys = [mix(r * 0x9E3779B97F4A7C15 + key) for r in range(1, training_order.ROUNDS + 1)]

    def permuted(x):
        while True:
            a, b = x >> half, x & mask
            for k in keys:
                a, b = b, a ^ (mix(b + k) & mask)
            x = (b << half) | a
            if x < n:
                return x

    found = []
    for row, (doc, text) in enumerate(rows):
        ids = [*tokens.encoding().encode_ordinary(text or ""), tokens.END]
        for seq, at in enumerate(range(0, len(ids), length)):
            own = ids[at : at + length]
            found.append((permuted((row << training_order.PLACE) + seq), doc, seq, len(own), own + [tokens.END] * (length - len(own))))
    found.sort()
    width, place, out = -(-n // shards), Counter(), []
    for slot, (number, doc, seq, size, ids) in enumerate(found):
        shard = number // width
        out.append((slot, shard, place[shard] * 2 * length, doc, seq, size, ids))
        place[shard] += 1
    return out


def test_training_order_by_brute_force(spark, tmp_path):
    """Slots, shards, offsets and what stands in the files; and that splits of the scan change nothing."""
    rows = common.table(spark, f"{DATA}/sf0.001", "documents").select("doc_id", "text").limit(60).collect()
    parts = [rows[:25], rows[25:], []]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/in/part={k}")
    most, want = spark.conf.get("spark.sql.files.maxPartitionBytes"), brute_order([tuple(r) for r in rows], 32, 7)
    try:
        for n, size in enumerate(("128m", "3k")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            docs = spark.read.parquet(f"file://{tmp_path}/in")
            got = sorted(tuple(r)[:6] for r in training_order.materialise(docs, f"file://{tmp_path}/out{n}", 32, shards=7).collect())
            assert got == [x[:6] for x in want]
            for r in want[:: len(want) // 40 + 1]:
                with open(f"{tmp_path}/out{n}/shard-{r[1]:08d}.bin", "rb") as f:
                    f.seek(r[2])
                    assert np.frombuffer(f.read(64), "<u2").tolist() == r[6]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


def test_token_counts(spark):
    want = Counter()
    for r in common.table(spark, f"{DATA}/sf0.001", "documents").collect():
        want[(r.source, r.lang)] += tokens.count(r.text)
    got = rollups.op10_token_counts(spark, f"{DATA}/sf0.001").collect()
    assert {(r.source, r.lang): r.n_tokens for r in got} == want and {r.version for r in got} == {"byte_bpe_50k"}


def test_token_counts_have_all_documents(spark, tmp_path):
    rows = [(k, t, source, lang) for k, (t, source, lang) in enumerate([("some words", "a", "en"), (None, "a", "en"), ("", "a", "en"), ("", "b", "de"), (None, "b", "de"), (None, None, None), ("x y z", None, "en")] * 5)]
    rows += [(None, "no id", "a", "en"), (None, None, "c", "en"), (3, "an id again", "b", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for _, text, source, lang in rows:
        docs, count = want.get((source, lang), (0, 0))
        want[source, lang] = docs + 1, count + tokens.count(text or "")
    got = rollups.op10_token_counts(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got} == want and len(got) == len(want)


def test_pipeline(spark):
    """Each stage against what its operator says of its input."""
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left.collect(), stage(spark, left, SF).cache()
        after = left.collect()
        frame = spark.createDataFrame(before, docs.schema)
        if name == "quality_classifier":
            model = quality.train(frame, common.table(spark, SF, "labels"))
            want = {r.doc_id for r in quality.quality_scores(frame, model).collect() if r.predicted}
        elif name == "simhash_near_dedup":
            want = {r.component_id for r in simhash.near_duplicates(frame).collect()}
        elif name == "suffix_array_dedup":
            want = {r.doc_id for r in before}
            size = {r.doc_id: (r.n_bytes - r.n_removed, r.n_removed) for r in suffixes.suffix_dedup(frame).collect()}
            assert all(len(r.text.encode()) <= size[r.doc_id][0] and (size[r.doc_id][1] > 0 or len(r.text.encode()) == size[r.doc_id][0]) for r in after)
            assert all(len(r.text) == r.n_chars for r in after if size[r.doc_id][1])
        else:
            want = {r.doc_id for r in decontaminate.contamination(frame, common.table(spark, SF, "benchmark")).collect() if not r.contaminated}
        assert sorted(r.doc_id for r in after) == sorted(want) and left.columns == columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == want
