"""The in-worker algorithms against plain versions of themselves."""

import collections
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cuespark.llm import ann, boosted, bpe, langid, routing, similar, simhash, substring_fm, suffix_dedup, text_stats, token_blocks
from cuespark.llm.fm_index import FmIndex, Wavelet, matching
from cuespark.llm.queries import vocabulary
from cuespark.llm.suffix_array import SuffixArray


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(vocabulary())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


HARD = ["", "\x85x", "a\x1cb", "  \n x", "<|endoftext|>", " <|endoftext|>a", "日本語 テキスト", "　x  y", "'s'sst", "é" * 300, "ab" * 500, "\x00\x01", "٣٤ x²", "a" * 5000, " " * 3000]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abtheing '\n\t12.,!éß日<|>²\xa0\x85", max_size=120))
def test_bpe_equals_the_library(codec, tokenizer, text):
    ids = np.frombuffer(codec.encode(text), "<u4")
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids).decode() == tokenizer.decode(ids.tolist(), skip_special_tokens=False) == text


@pytest.mark.parametrize("text", HARD)
def test_bpe_on_hard_texts(codec, tokenizer, text):
    expected = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == expected
    assert np.frombuffer(token_blocks.library_encoder(vocabulary())([text])[0], "<u4").tolist() == expected


def test_blocks_round_trip():
    rng = random.Random(2)
    for trial in range(60):
        n, top = rng.choice([0, 1, 1023, 1024, 1025, 5000]), rng.choice([1, 2, 50_000, 2**31, 2**32])
        ids = np.array([rng.randrange(top) if rng.random() < 0.9 else rng.randrange(2**32) for _ in range(n)], np.uint32)
        sink = io.BytesIO()
        writer = token_blocks.ShardWriter(sink)
        for part in np.array_split(ids, rng.randint(1, 5)):
            writer.add(None if trial % 2 else 7, part)
        writer.close()
        shard = token_blocks.Shard(sink.getvalue())
        assert (shard.ids(0, shard.total) == ids).all()
        a, b = sorted((rng.randint(0, n), rng.randint(0, n)))
        assert (shard.ids(a, b) == ids[a:b]).all()
        assert set(shard.docs) == {None if trial % 2 else 7}


def brute_statistics(text):
    words = text.encode().split()
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            repeated |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(line.encode().split()) and line in seen
        seen.add(line)
    return [len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#|é", max_size=80), min_size=1, max_size=6))
def test_statistics(texts):
    got = text_stats.statistics([t.encode() for t in texts])
    assert got[:, :5].tolist() == [brute_statistics(t) for t in texts]


def test_statistics_survive_hash_collisions(monkeypatch):
    monkeypatch.setattr(text_stats, "_ODD", np.zeros(5, np.uint64))
    texts = ["a b c d e a b c d e", "a b c d e f g", "a b c d e x"]
    assert text_stats.statistics([t.encode() for t in texts])[:, :5].tolist() == [brute_statistics(t) for t in texts]


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] + rng.normal(0, 0.2, 4000) < 0.6) & (x[:, 1] > 0.2)).astype(float)
    model = boosted.fit(x, y, np.array([-1, 0, 0]))
    assert ((model.probability(x) > 0.5) == y).mean() > 0.85
    grid = np.repeat(rng.random((50, 3)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(model.margin(grid).reshape(50, 40), axis=1) <= 1e-12).all()
    assert boosted.fit(x, np.ones(4000), np.zeros(3)).probability(x[:2]).min() > 0.99
    assert boosted.fit(x[:0], y[:0], np.zeros(3)).probability(x[:2]).min() > 0.99


def marks_by_routing(docs, cut, values, reduce, solve, window, parts=3, pieces=1, hot=()):
    """What ``routing.marked`` does, without Spark: flags of each document of chunks of four documents."""
    hot = routing.Hot(np.array(hot, np.uint64))
    chunks = [docs[i : i + 4] for i in range(0, len(docs), 4)]
    found = [routing.Fragments([t for _, t in c], cut, hot) for c in chunks]
    numbers = [values(np.array([routing.LAST if d is None else d for d, _ in c], np.int64)) for c in chunks]
    blobs, tables = collections.defaultdict(list), collections.defaultdict(list)
    for k, f in enumerate(found):
        if f.payloads:
            for part, blob in zip(*routing.sent_to(f, k, *reduce(f.number, numbers[k][f.doc], len(f.payloads)), parts), strict=True):
                for piece, b in routing.Part([blob]).pieces(pieces) if pieces > 1 else [(0, blob)]:
                    blobs[part, piece].append(b)
    for group in blobs.values():
        part = routing.Part(group)
        for verdict in solve(part):
            if len(verdict.entry):
                for row in verdict.rows(part).to_pylist():
                    tables[row["chunk"]].append(np.frombuffer(row["verdict"], "<i8").reshape(-1, 4))
    out = [np.zeros(len(t), bool) for _, t in docs]
    for k, f in enumerate(found):
        for doc, flags in routing.spans_of(routing.Places.unpacked(routing.Places.of(f).packed()), numbers[k], np.concatenate(tables[k]), window) if tables[k] else ():
            out[4 * k + doc][: len(flags)] = flags
    return out


def hot_of(docs, cut):
    """Every other minimizer of the documents."""
    found = routing.Fragments([t for _, t in docs], cut, routing.Hot(np.zeros(0, np.uint64)))
    return np.unique(found.low)[::2]


def test_repeated_words_equal_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        letters, window = rng.choice([2, 5, 50]), rng.choice([3, 13])
        docs = []
        for d in range(20):
            words = [str(rng.randrange(letters)).encode() for _ in range(rng.randint(0, 80))]
            if docs and rng.random() < 0.5 and (old := docs[rng.randrange(len(docs))][1].split()):
                at = rng.randrange(len(old))
                words = words[: rng.randint(0, 9)] + old[at : at + rng.randint(1, 60)]
            docs.append((rng.choice([None, d, rng.randrange(20)]), b" ".join(words)))
        cut = substring_fm.cutter(window)
        found = marks_by_routing(docs, cut, lambda x: x, substring_fm.bounds, substring_fm.solver(window, rng.choice([30, 10**6])), window, pieces=rng.choice([1, 3]), hot=hot_of(docs, cut) if rng.random() < 0.5 else ())
        order = lambda d: substring_fm.LAST if d is None else d
        first = {}
        for d, text in docs:
            w = text.split()
            for i in range(len(w) - window + 1):
                first[tuple(w[i : i + window])] = min(order(d), first.get(tuple(w[i : i + window]), order(d)))
        for (d, text), flags in zip(docs, found, strict=True):
            w, mask = text.split(), np.zeros(len(text.split()), bool)
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < order(d):
                    mask[i : i + window] = True
            assert (mask == flags[: len(w)]).all() and not flags[len(w) :].any()


def test_repeated_bytes_equal_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        length, letters = rng.choice([5, 20, 40, 70]), rng.choice([b"ab", b"abcdefgh", bytes(range(256))])
        docs = []
        for d in range(15):
            text = bytes(rng.choice(letters) for _ in range(rng.randint(0, 150)))
            if docs and rng.random() < 0.6 and (old := docs[rng.randrange(len(docs))][1]):
                at = rng.randrange(len(old))
                text = text[: rng.randint(0, 30)] + old[at : at + rng.randint(1, 90)] * rng.choice([1, 1, 3]) + text[:3]
            docs.append((d, text))
        cut = suffix_dedup.cutter(length, rng.choice([50, 10**6]))
        found = marks_by_routing(docs, cut, np.zeros_like, suffix_dedup.counts, suffix_dedup.solver(length, rng.choice([200, 10**6])), length, pieces=rng.choice([1, 3]), hot=hot_of(docs, cut) if rng.random() < 0.5 else ())
        places = collections.Counter(t[i : i + length] for _, t in docs for i in range(len(t) - length + 1))
        for (_, text), flags in zip(docs, found, strict=True):
            mask = np.zeros(len(text), bool)
            for i in range(len(text) - length + 1):
                if places[text[i : i + length]] > 1:
                    mask[i : i + length] = True
            assert (mask == flags).all()


def test_suffix_array_is_sorted_and_prefixes_are_right():
    rng = random.Random(6)
    fragments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(30)] + [b"a" * 90] * 2
    shard, depth = SuffixArray(fragments, 12), 12
    owner = np.repeat(np.arange(len(fragments)), shard.sizes + 1)
    suffix = lambda p: (fragments[owner[p]][p - shard.starts[owner[p]] :], owner[p])
    ordered = [suffix(p) for p in shard.order]
    assert all(a[0] < b[0] or (a[0] == b[0] and a[1] < b[1]) or b[0].startswith(a[0]) for a, b in zip(ordered, ordered[1:], strict=False))
    for k in range(1, len(ordered)):
        if len(ordered[k][0]) >= depth:
            a, b = ordered[k - 1][0], ordered[k][0]
            same = next((i for i in range(min(len(a), len(b), depth)) if a[i] != b[i]), min(len(a), len(b), depth))
            assert shard.common[k] == same


def test_wavelet_rank_and_backward_search():
    rng = np.random.default_rng(8)
    symbols = rng.integers(0, 37, 500)
    wavelet = Wavelet(symbols, 37)
    ask, at = rng.integers(0, 37, 300), rng.integers(0, 501, 300)
    assert wavelet.rank(ask, at).tolist() == [int((symbols[:a] == c).sum()) for c, a in zip(ask, at, strict=True)]
    text = np.append(rng.integers(1, 4, 400), 0)
    index = FmIndex(text, 5, np.arange(401)[::-1])
    for length in range(1, 6):
        for start in range(0, 390, 13):
            pattern, low, high = text[start : start + length], np.array([0]), np.array([len(text)])
            for word in pattern[::-1]:
                low, high = index.step(np.array([word]), low, high)
            expected = sum((text[i : i + length] == pattern).all() for i in range(len(text) - length))
            assert int(high[0] - low[0]) == expected


def test_streamed_matches_come_from_the_search():
    """Sequences that are not in the index: positions, interval sizes and least values as by brute force."""
    rng = np.random.default_rng(9)
    text = np.append(rng.integers(1, 4, 500), 0)
    values = rng.integers(0, 1000, 501)
    index, asked = FmIndex(text, 4, values, 7), [rng.integers(1, 7, n) for n in (1, 3, 4, 60, 200)]
    flat = np.concatenate([np.append(a, 0) for a in asked])
    sizes = np.array([len(a) for a in asked])
    where, low, high = matching(index, flat, np.cumsum(sizes + 1) - sizes - 1, sizes)
    got = dict(zip(where.tolist(), zip((high - low).tolist(), index.least(low, high).tolist(), strict=True), strict=True))
    expected = {}
    for at in range(len(flat) - 3):
        met = [i for i in range(498) if (text[i : i + 4] == flat[at : at + 4]).all()]
        if met and flat[at : at + 4].all():
            expected[at] = (len(met), min(values[met].tolist()))
    assert got == expected and len(got) > 5
    share = np.bincount(text)[1:] / len(text)
    assert sum(len(b.words) * 64 for b in index.wavelet.bits) <= len(text) * (1 + -(share * np.log2(share)).sum()) + 200 * index.wavelet.deepest


def test_fingerprints_follow_the_definition():
    for text in ["", "a", "a b", "A b C d", "x y z x y z x", " é  ß\t日 k"]:
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        expected = sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int(simhash.fingerprints([text.encode()])[0]) == expected


def test_variants_and_forests_lose_no_link():
    rng = random.Random(9)
    for distance in (2, 3, 5):
        base = [rng.getrandbits(64) for _ in range(6)]
        prints = set()
        for b in base:
            for _ in range(40):
                prints.add(b)
                for _ in range(rng.randint(0, distance)):
                    b ^= 1 << rng.randrange(64)
        prints = np.array(sorted(prints), np.uint64)
        pairs = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= distance]
        keys = [set(r) for r in np.concatenate([simhash.variants(prints, a, n, t) for t, (a, n) in enumerate(simhash.segments(distance))], axis=1).tolist()]
        assert all(keys[i] & keys[j] for i, j in pairs)

        def roots(links, n=len(prints)):
            forest = simhash.Forest(n)
            for i, j in links:
                forest.link(i, j)
            return [forest.root(i) for i in range(n)]

        assert roots(pairs) == roots(simhash._forest(prints, distance, 10)) == roots(simhash._forest(prints, distance, 10_000))


def greedy_phrases(text, train):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in train:
            j += 1
        n, i = n + 1, j
    return n


def test_sets_that_span_batches():
    rng = random.Random(21)
    base = rng.getrandbits(64)
    prints = np.unique(np.array([base ^ sum(1 << b for b in rng.sample(range(64), 5)) for _ in range(4000)], np.uint64))
    assert len(prints) > 2080  # more than there are ways to flip two bits
    keys = np.concatenate([np.full(len(prints), 5), np.full(3, 9)]).astype(np.int64)
    rows = np.concatenate([prints, prints[:3]]).view(np.int64)
    whole = simhash._links(2, 10_000)
    expected = {tuple(r.values()) for b in whole([pa.RecordBatch.from_pydict({"key": keys, "print": rows})]) for r in b.to_pylist()}
    cut = [pa.RecordBatch.from_pydict({"key": keys[i : i + 700], "print": rows[i : i + 700]}) for i in range(0, len(keys), 700)]
    for large in (10_000, 2):
        found = {tuple(r.values()) for b in simhash._links(2, large)(cut) for r in b.to_pylist()}
        nodes = {int(x): i for i, x in enumerate(prints.view(np.int64))}
        forests = []
        for links in (expected, found):
            forest = simhash.Forest(len(nodes))
            for a, b in links:
                forest.link(nodes[a], nodes[b])
            forests.append([forest.root(i) for i in range(len(nodes))])
        assert forests[0] == forests[1] and 1 < len(set(forests[0])) < len(nodes)


def test_suffix_automaton_parses_greedily():
    rng = random.Random(11)
    train = bytes(rng.choice(b"\0\1\2") for _ in range(200))
    automaton = langid.laid_out(langid.suffix_automaton(train))
    for _ in range(50):
        text, n = bytes(rng.choice(b"\0\1\2\3") for _ in range(60)), 1
        state = automaton.first[text[0]]
        for c in text[1:]:
            state, new = langid.parsed(automaton, np.array(state), np.array(c))
            n += int(new)
        assert n == greedy_phrases(text, train)


def test_blocks_do_not_change_the_parse(monkeypatch):
    """Many scripts, texts of many blocks, texts made of the sample (phrases longer than blocks): as by brute force."""
    rng = random.Random(12)
    scripts = ["abcdefgh ", "абвгдежз ", "αβγδεζηθ ", "\u4e00\u4e01\u4e8c\u4e94\u516d\u4e03 "]
    samples = {f"l{i}": ["".join(rng.choice(x) for _ in range(900))] for i, x in enumerate(scripts)} | {"": ["zzz yyy xxx " * 30]}
    texts = [b"", b"a", *[langid.normal("".join(rng.choice(rng.choice(scripts)) for _ in range(rng.randrange(1, 700)))) for _ in range(20)]]
    texts += [langid.normal(samples["l0"][0])[5:800], langid.normal(samples["l3"][0] * 3), b"zzz yyy xxx " * 60]
    joined = {name: b" ".join(map(langid.normal, t)) for name, t in sorted(samples.items())}
    model = langid.build(samples)
    assert model.names == ["", "l0", "l1", "l2", "l3"] and len({*b"".join(texts)}) > 30
    expected = [[greedy_phrases(t, joined[name]) for name in model.names] for t in texts]
    for size in (7, 64, 512):
        monkeypatch.setattr(langid, "BLOCK", size)
        assert langid.phrases(model, texts).tolist() == expected
    cost = np.array(expected) * model.price
    best = [model.names[i] for i in cost.argmin(axis=1)]
    lettered = [any(map(str.isalpha, t.decode())) for t in texts]
    assert langid.predict(model, texts)[0] == [b if ok else "und" for b, ok in zip(best, lettered, strict=True)]


def test_quantiser_and_scan():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 15))
    quantiser = ann.Quantiser(15).fit(x[:2000])
    codes = quantiser.pack(quantiser.encode(x))
    queries = x[:40]
    rough, exact = ann.scan(quantiser.tables(queries), codes), queries @ x.T
    assert np.corrcoef(rough.ravel(), exact.ravel())[0, 1] > 0.9
    best = [set(np.argsort(-exact[i])[:10]) & set(np.argsort(-rough[i])[:100]) for i in range(40)]
    assert sum(map(len, best)) / 400 > 0.9
    plain = ann.Quantiser(15, eta=1.0).fit(x[:2000])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(q):
        c = q.encode(x)
        rebuilt = q.words[np.arange(q.pairs), c].reshape(len(x), -1)[:, :15]
        return np.abs(((x - rebuilt) * unit).sum(axis=1)).mean()

    assert parallel(ann.Quantiser(15, eta=6.0).fit(x[:2000])) < parallel(plain)


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1, 0], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\0\0\0\0")
