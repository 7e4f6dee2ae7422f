"""Parts of the text operators that need no Spark."""

import collections
import io
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tidemark.llm")
P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm import binrec, bpe, common, langid, quality, secret_scan, ssjoin, toxicity  # noqa: E402

ODD = ["", " ", "  x\n\n y \t z ", "don't I'LL we've 123abc!!", "a<|endoftext|>b <|startoftext|>", "\x1c x\x1f", "日本語 テキスト", "é x y z", " \n", "a\u0085b", "İstanbul ΑΣ ﬁ", "it's 12a4 ##x##", "👍🏽 é ́", "x" * 5000, "  ​ a"]
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\tabcdeÉéß'.!<|>0123")), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def byte_codec(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lex") / "x.lexicon")
    v = P.path("byte_bpe_50k.json")
    words = [" the", "the", " of", "ther", " there", "\n", " é"]
    bpe.write_lexicon(path, words, [np.frombuffer(x, "<u4").tolist() for x in bpe.Merger(v).ids(words)])
    return bpe.Codec(v, path), Tokenizer.from_file(v)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_byte_codec_is_the_library(byte_codec, text):
    codec, library = byte_codec
    want = library.encode(text, add_special_tokens=False).ids
    (got,) = codec.encode([text])
    assert np.frombuffer(got, "<u4").tolist() == want
    assert codec.decode(got) == library.decode(want, skip_special_tokens=False) == text


def test_byte_codec_odd_texts(byte_codec):
    codec, library = byte_codec
    got = codec.encode(ODD + ["there the of the\nthere"])
    for x, g in zip(ODD, got, strict=False):
        assert np.frombuffer(g, "<u4").tolist() == library.encode(x, add_special_tokens=False).ids
    small = bpe.Codec(P.path("byte_bpe_50k.json"), None, remember=300)
    assert small.encode(ODD) == codec.encode(ODD)


def test_transducer_is_a_minimal_numbering():
    r = random.Random(4)
    words = sorted({bytes(r.choice(b"abc") for _ in range(r.randint(1, 7))) for _ in range(300)})
    a = bpe.Transducer.build(words)
    t = bpe.Transducer(a)
    assert t.numbers(words, int(a["root"][0])).tolist() == list(range(len(words)))
    others = [w + b"z" for w in words[:20]] + [b"", b"zzz"]
    assert (t.numbers(others, int(a["root"][0])) == -1).all()
    shared = bpe.Transducer.build([x + b"tion" for x in (b"a", b"b", b"c")])
    assert len(shared["final"]) - 1 == 6  # root, one shared state, and the four of "tion" after it


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_word_codec_is_the_library(text):
    codec = binrec.word_codec(P.path("word_bpe_49k.json"))
    (got,) = codec.encode([text])
    assert np.frombuffer(got, "<u2").tolist() == codec.library.encode(text, add_special_tokens=False).ids


def test_records_round_trip_and_damage():
    frames = [binrec.frame(x) for x in (b"", b"abc", b"x" * 1000)]
    stream = io.BytesIO(b"".join(frames))
    assert [binrec.read_frame(stream) for _ in range(4)] == [b"", b"abc", b"x" * 1000, None]
    for k in range(len(frames[1])):
        broken = bytearray(frames[1])
        broken[k] ^= 1
        with pytest.raises(ValueError):
            binrec.read_frame(io.BytesIO(bytes(broken)))


def test_base_spans_against_the_definition():
    import re

    def slow(x):
        out = []
        for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x, re.ASCII):
            if len(m.group(2)) >= 8:
                out.append((m.start(), m.end(), "assign"))
        out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if m.end() - m.start() >= 16]
        out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if m.end() - m.start() >= 32]
        return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))

    r = random.Random(7)
    bits = ["password", "PassWD", "api_key", "APIKEY", "ſecret", "secret", "token", ":", "=", " ", '"', "'", "é", "AKIA", "AKIAAKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef" * 4, "short", "x=y", "longenough1", "\n", "_", "."]
    for _ in range(3000):
        x = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert secret_scan.base_spans(x) == slow(x)


def test_inferred_formats():
    s = secret_scan.Scanner()
    fresh, plain = secret_scan.labelled_strings(seed=99, each=20)
    fresh, plain = [x for x in fresh if len(x) >= 16], [x for x in plain if len(x) >= 16]
    assert sum(map(s.likely, fresh)) >= 0.9 * len(fresh)
    assert sum(map(s.likely, plain)) <= 0.05 * len(plain)
    text = "see ghp_a8Kd93jfLs02Kdj48fjsLA0239dkfjsl3xYz and section-4-of-the-report"
    base, whole = s.spans(text)
    assert base == [] and [text[a:b] for a, b, _ in whole] == ["ghp_a8Kd93jfLs02Kdj48fjsLA0239dkfjsl3xYz"]
    assert s.spans("") == ([], [])


def test_formats_not_trained_on(monkeypatch):
    """Each format left out in turn: most of its strings are still found, and hardly any other string."""
    made, found, false = secret_scan.labelled_strings, 0, 0
    for left in secret_scan.FORMATS:
        rest = {k: v for k, v in secret_scan.FORMATS.items() if k != left}
        monkeypatch.setattr(secret_scan, "labelled_strings", lambda rest=rest: made(formats=rest))
        s = secret_scan.Scanner()
        found += sum(map(s.likely, made(seed=5, each=20, formats={left: secret_scan.FORMATS[left]})[0])) / 20
        others = made(seed=77, each=20)[1]
        false += sum(map(s.likely, others)) / len(others)
    assert found >= 0.65 * len(secret_scan.FORMATS) and false <= 0.01 * len(secret_scan.FORMATS)


def test_score_is_the_likelihood_of_the_path():
    a = secret_scan.infer(["ab1-", "ab2-", "ax1-", "zz9"] * 30)
    for x in ("ab1-", "zz9", "q=="):
        word, at, total = secret_scan.symbols(x), 0, 0.0
        share = {c: (sum(y.count(c) for y in map(secret_scan.symbols, ["ab1-", "ab2-", "ax1-", "zz9"] * 30)) + 1 / 12) / (15 * 30 + 121) for c in word}
        for c in word:
            n = sum(a.used[at].values()) + a.ending[at]
            total += np.log((a.used[at].get(c, 0) + 4 * share[c]) / (n + 4))
            at = a.arcs[at].get(c, at)
        total += np.log((a.ending[at] + 4 * 121 / (15 * 30 + 121)) / (a.passing[at] + 4))
        assert abs(a.score(word) - total / (len(word) + 1)) < 1e-9
    assert sum(a.ending) == 120 and len(a.arcs) > 0


def test_language_model():
    r = random.Random(1)
    word = {"aa": "abcde", "bb": "vwxyz"}
    docs = [(" ".join("".join(r.choice(word[y]) for _ in range(4)) for _ in range(30)), y) for y in ("aa", "bb") for _ in range(40)]
    m = langid.train(docs, bits=12)
    tags, scores, rejected = m.predict([docs[0][0], docs[-1][0], None, "", "123 !!", "abcd " * 20000])
    assert tags == ["aa", "bb", "und", "und", "und", "aa"]
    assert rejected[2:5] == [True] * 3 and all(0 <= s <= 1 for s in scores)
    assert langid.train([]).predict(["text"])[0] == ["und"]


def test_block_max_search_is_exact():
    r = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        t = np.sort(r.choice(40, size=r.integers(1, 6), replace=False))
        w = r.random(len(t)) + 0.1
        vectors.append((t, w / np.linalg.norm(w)))
    vectors[7] = vectors[3]
    flat = sorted((int(t), i, float(w)) for i, v in enumerate(vectors) for t, w in zip(*v, strict=True))
    terms, docs, weights = (np.array(x) for x in zip(*flat, strict=True))
    index = toxicity.Index(terms, docs, weights, 500, 40, block=16)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for n, (t, w) in enumerate(vectors[:100]):
        score = dense[:, t] @ w
        score[n] = 0
        want = sorted((i for i in range(500) if score[i] > 0), key=lambda i: (-round(score[i], 12), i))[:10]
        got = index.search(t, w, 10, skip=n)
        assert [i for i, _ in got] == want and np.allclose([s for _, s in got], score[want])
    assert index.search(terms[:0], weights[:0], 10) == []


def test_toxicity_votes_and_empty_model():
    ok = [(k, f"plain words number {k} here", 0) for k in range(40)]
    bad = [(100 + k, f"you awful fool number {k}", 1) for k in range(40)]
    m = toxicity.Model(ok + bad)
    assert m.score("an awful text")[0] > 0.5 > m.score("plain words")[0]
    assert set(m.score("an awful text")[1]) <= set(range(100, 140))
    assert toxicity.Model([]).score("x") == (0.0, [], [])
    k, v = toxicity.isotonic(np.array([1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0]), np.ones(3))
    assert v.tolist() == sorted(v.tolist())


@pytest.mark.parametrize("percent", [80, 90])
def test_signatures_meet_for_every_link(percent):
    r = np.random.default_rng(8)
    bands = ssjoin.Bands(percent)
    linked = 0
    for _ in range(1500):
        n = int(r.integers(1, 120)) if r.random() < 0.8 else int(r.integers(120, 3000))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        keep = int(r.integers(max(1, int(len(a) * percent / 100) - 1), len(a) + 1))
        more = int(r.integers(0, max(2, len(a) // 6)))
        b = np.unique(np.concatenate((r.permutation(a)[:keep], r.integers(0, 1 << 63, more).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common) and common < max(len(a), len(b)):
            linked += 1
            at, sigs = ssjoin.signatures([a, a[:0], b], bands)
            assert np.intersect1d(sigs[at == 0], sigs[at == 2]).size and not (at == 1).any()
            (table,) = list(ssjoin.sketch_pairs([ssjoin.sketch(a), ssjoin.sketch(b)], np.array([1, 2]), percent))
            assert table[0] == 0 and table[1].tolist() == [1]
    assert linked > 400


@pytest.mark.parametrize("percent", [80, 90])
def test_signatures_of_all_small_sets(percent):
    """Every pair of sets over a small domain that links shares a signature, whatever parts the elements fall into."""
    r = np.random.default_rng(percent)
    bands = ssjoin.Bands(percent)
    for _ in range(5):
        domain = np.unique(r.integers(0, 1 << 63, 12).astype(np.uint64))
        sets = [domain[[bool(bits >> k & 1) for k in range(len(domain))]] for bits in range(1, 1 << len(domain)) if bits.bit_count() >= 8]
        at, sigs = ssjoin.signatures(sets, bands)
        own = [set(sigs[at == k].tolist()) for k in range(len(sets))]
        for i, x in enumerate(sets):
            for j in range(i):
                common = len(np.intersect1d(x, sets[j], assume_unique=True))
                if 100 * common >= percent * (len(x) + len(sets[j]) - common):
                    assert own[i] & own[j]


def test_label_model_finds_the_bad_rule():
    patterns = [((1, 1, 1), 900), ((-1, -1, 1), 80), ((-1, 0, 1), 20), ((0, 1, -1), 30)]
    m = quality.fit_label_model(patterns)
    assert quality.posterior(m, (1, 1, 1)) > 0.9 and quality.posterior(m, (-1, -1, 1)) < 0.5
    assert quality.fit_label_model([])["share"] > 0


def test_label_model_recovers_accuracies():
    """Votes drawn from known accuracies: EM finds them and gives a rule without information no weight."""
    r = np.random.default_rng(2)
    good = r.random(20_000) < 0.85
    right = [0.95, 0.9, 0.8]
    drawn = [np.where(r.random(len(good)) < 0.3, 0, np.where(r.random(len(good)) < q, 1, -1) * np.where(good, 1, -1)) for q in right]
    drawn.append(np.where(r.random(len(good)) < 0.97, 1, -1))  # says the same of both
    patterns = sorted(collections.Counter(map(tuple, np.array(drawn).T.tolist())).items())
    m = quality.fit_label_model(patterns)
    assert abs(m["share"] - 0.85) < 0.03
    for k, q in enumerate(right):
        assert abs(m["say"][k][1][1] - 0.7 * q) < 0.03 and abs(m["say"][k][-1][-1] - 0.7 * q) < 0.08
    assert abs(quality._weight(m, 3, 1)) < 0.1
    kept = sum(c for v, c in patterns if quality.posterior(m, v) >= 0.5)
    assert 0.8 * len(good) < kept < 0.92 * len(good)


def test_masked_checksum_rotates():
    c = zlib.crc32(b"abc")
    assert binrec.masked(b"abc") == (((c >> 15) | (c << 17)) + 0xA282EAD8) % (1 << 32)


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="needs Linux")
def test_workers_give_back_memory():
    """Arrow keeps about 150 MB of the arrays below when they are gone; workers pass it on to the system."""

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Anonymous:\s+(\d+)", f.read())[1]) >> 10

    def run(batches):
        for b in batches:
            x = [pa.array([bytes(30_000)] * 10, pa.binary()) for _ in range(500)]
            assert len(x) == 500
            del x
            yield b

    common.give_back()
    before = held()
    one = pa.RecordBatch.from_arrays([pa.array([1])], ["a"])
    assert list(common.lean(run)(iter([one] * 3))) == [one] * 3
    assert held() - before < 50
