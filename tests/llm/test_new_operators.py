"""Ball trees, the cuckoo index and token pairs against plain versions, with nulls, ties, repeats, hot groups and long texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespark.llm import ball_tree, bpe, cuckoo, line_dedup, mixing, simhash, token_blocks, token_pairs, words
from cuespark.llm.queries import ORACLES, QUERIES, vocabulary
from tests.oracle import assert_same, duck

A, B = vocabulary(), vocabulary("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_exact_dedup"])
def test_oracles(spark, data, name):
    assert_same(QUERIES[name](spark, data), duck(data), ORACLES[name])


# ball trees


def brute_negatives(rows, every=100, k=5, m=10):
    """Rows (id, label, vector) of numbers that take part."""
    usable = []
    for i, label, v in rows:
        if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v):
            usable.append((i, int(np.fmod(label + 1, 10)) if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for i, label, v in usable:
        if i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), j, other == label) for j, other, w in usable))
        for p, j, same in [x for x in scored if x[2] and x[1] != i][:k]:
            fits = [(n, q) for n, q, s in scored if not s and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(i, j, rank + 1, q, -p, -n) for rank, (n, q) in enumerate(fits[:m])]
        assert same in (True, False)
    return sorted(out)


VECTORS = "embedding array<float>, label int, vec_id long, number int, v string"


def vector_rows(n=1500, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 10)) if i % 3 else 4, (rng.normal(size=6) * rng.lognormal()).astype(np.float32).tolist()) for i in range(n)]
    hot = rows[17][2]
    rows = [(i, label, hot if i % 4 == 1 else v) for i, label, v in rows]  # a quarter have one vector, a third one label
    return rows + [(None, 1, [1.0] * 6), (2100, None, [1.0] * 6), (2200, 3, None), (2201, 3, [1.0, None]), (2300, 3, [float("inf")] * 6), (2400, 3, [float("nan")] * 6), (2500, 3, []), (2501, 4, [3.0]), (2502, 3, [1.0] * 9), (300, 2, [5.0] * 6), (301, 2, [5.0] * 6), (301, 2, [5.0] * 6), (-700, 2, [0.5] * 6), (2600, 2, [0.0] * 6)]


def test_hard_negatives(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(v, label, i, 7, "x") for i, label, v in rows], VECTORS).repartition(5)
    found = sorted(tuple(r) for r in ball_tree.hard_negatives(frame, block=6).collect())
    expected = brute_negatives(rows)
    assert found == expected and len(expected) > 300
    assert ball_tree.hard_negatives(frame.limit(0)).collect() == []
    assert ball_tree.hard_negatives(frame.where("vec_id % 100 <> 0")).collect() == []


def test_ball_tree_search():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 300
    rows = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 8)) * 10).astype(np.int64)
    ids, labels = rng.permutation(6000), rng.integers(0, 5, 6000)
    q = rows[:50]
    low, high = np.full(50, 1000, np.int64), rng.integers(1000, 900_000, 50)
    for same in (True, False):
        s = ball_tree.Search(ids[:50], labels[:50], q, low, high, same, 7)
        for at in range(0, 6000, 2500):
            s.visit(ball_tree.BallTree(ids[at : at + 2500], labels[at : at + 2500], rows[at : at + 2500], 32))
        scores = q @ rows.T
        for i in range(50):
            ok = (labels == labels[i]) & (ids != ids[i]) if same else labels != labels[i]
            ok &= (scores[i] >= low[i]) & (scores[i] <= high[i])
            expected = sorted(zip((-scores[i][ok]).tolist(), ids[ok].tolist(), strict=True))[:7]
            got = [(-x, y) for x, y in zip(s.scores[i].tolist(), s.found[i].tolist(), strict=True) if y != ball_tree.NO_ID]
            assert got == expected
        assert s.scored < 0.4 * 50 * 6000, s.scored  # bounds do much of the work where rows have neighbourhoods


def test_large_products():
    big = np.array([[2**62, 3]], np.int64)
    assert ball_tree.products(big, np.array([[4, 1], [-4, 0], [0, 2]], np.int64)).tolist() == [[ball_tree.MOST, ball_tree.NONE + 1, 6]]
    assert ball_tree.products(np.array([[2**28]]), np.array([[2**28 + 1]])).tolist() == [[2**56 + 2**28]]


# exact dedup


def keys_of(numbers):
    return cuckoo.words_of(cuckoo.pa.array([hashlib.sha256(str(n).encode()).digest() for n in numbers]))


def test_cuckoo_index():
    rng, index, held = random.Random(4), cuckoo.CuckooIndex(), Counter()
    for _ in range(60):
        added = [rng.randrange(3000) for _ in range(rng.randrange(400))]
        index.insert(keys_of(added), np.array(added, np.int64), np.arange(len(added)), np.ones(len(added), np.int64))
        held.update(added)
        gone = [rng.randrange(3500) for _ in range(rng.randrange(300))]
        index.delete(keys_of(gone), np.ones(len(gone), np.int64))
        held.subtract({n: min(held[n], c) for n, c in Counter(gone).items()})
        held += Counter()
    at = index.find(keys_of(range(4000)))
    assert {n: int(index.count[i]) for n, i in enumerate(at) if i >= 0} == held
    assert len(index) == len(held) and index.resized >= 3
    assert (index.prints > 0).sum() == len(held) and index.used <= 3000  # places are used again


def test_cuckoo_hits_are_verified():
    """Digests with one fingerprint and one pair of buckets are told apart; more than the buckets hold make it grow."""
    index, keys = cuckoo.CuckooIndex(), keys_of(range(8))
    keys[:, 1:3] = keys[0, 1:3]
    index.insert(keys[:7], np.arange(7), np.arange(7), np.ones(7, np.int64))
    assert index.find(keys).tolist()[-1] == -1
    assert sorted(index.find(keys[:7]).tolist()) == list(range(7))


TEXT_ROWS = [(5, "a b"), (3, "a \t\n b"), (None, "a b"), (9, " a b"), (4, None), (2, ""), (1, " "), (1, "\x0b\x0c"), (3, "a b"), (3, "a b"), (7, "A b"), (8, "a b"), (-6, "x " * 100_000), (6, "x  " * 100_000), (None, "null"), (None, "null")]


def dedup_rows(texts):
    keyed = [(i, " ".join(_split(t or ""))) for i, t in texts]
    groups = {}
    for i, t in keyed:
        groups.setdefault(t, []).append(i)
    out = Counter()
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        for n, i in enumerate(ids):
            out[i, ids[0], len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def _split(text):
    import re

    return re.split("[\\x20\\x09-\\x0d]+", text)


def test_exact_dedup(spark):
    rows = TEXT_ROWS + [(1000 + i, "hot  text") for i in range(3000)] + [(5000 + i, f"own {i % 2500}") for i in range(4000)]
    frame = spark.createDataFrame([(7, t, i, "x", 1) for i, t in rows], "row int, text string, doc_id long, digest string, n int").repartition(6)
    assert Counter(tuple(r) for r in cuckoo.first_of_equal(frame, shard_rows=500).collect()) == dedup_rows(rows)
    assert cuckoo.first_of_equal(frame.limit(0)).collect() == []


def test_index_changes(spark):
    frame = lambda rows: cuckoo.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    first, later, gone = [(i, f"t{i % 50}") for i in range(100)], [(200 + i, f"t{i}") for i in range(40, 60)], [(i, f"t{i}") for i in range(30)] + [(50 + i, f"t{i}") for i in range(20)] + [(7, "never")]
    index = cuckoo.changed(cuckoo.index_of(frame(first), shard_rows=20, least=3), 5, frame(later), frame(gone))
    held = Counter(t for _, t in first + later)
    held.subtract(t for _, t in gone)
    asked = [(i, f"t{i}") for i in range(70)]
    assert {r.doc_id: r.n for r in cuckoo.live(index, frame(asked)).collect()} == {i: max(0, held[t]) for i, t in asked}
    assert index.count() == sum(n > 0 for n in held.values())


# token pairs


def brute_pairs(texts):
    """Rows by the tokenizers' answers for whole texts and a walk over bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    p = token_pairs.Pair(A, B, 1 << 28)
    cut = lambda ids, table: [bytes(table[0][table[1][i] : table[1][i + 1]]) for i in ids]
    aligned, counts = [], Counter()
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        whole = b" " + (t or "").encode()
        if not t or b"".join(cut(ids_a, p.bytes_a)) != whole or b"".join(cut(ids_b, p.bytes_b)) != whole:
            aligned.append(None)
            continue
        at_a, at_b = ([n for n, x in enumerate(cut(ids, table)) for _ in x] for ids, table in ((ids_a, p.bytes_a), (ids_b, p.bytes_b)))
        links = sorted(set(zip(at_a, at_b, strict=True)))
        groups, begin = [], 0
        for i in range(1, len(whole) + 1):
            if i == len(whole) or (at_a[i] != at_a[i - 1] and at_b[i] != at_b[i - 1]):
                groups.append([",".join(str(ids[n]) for n in sorted(set(at[begin:i]))) for ids, at in ((ids_a, at_a), (ids_b, at_b))])
                begin = i
        pairs = [(ids_b[y], ids_a[x]) for x, y in links]
        counts.update(pairs)
        aligned.append((len(ids_a), len(ids_b), groups, pairs))
    best = {}
    for (y, _), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for x in aligned:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            text = ";".join("|".join(g) for g in x[2])
            out.append((x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_token_pairs_of_a_table(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_token_pairs"](spark, data).collect()}
    assert found == dict(zip([r.doc_id for r in rows], brute_pairs([r.text for r in rows]), strict=True))


ODD = ["", None, " ", "  a", "a  ", "a\n", "\n", "<|endoftext|> <s> </s> <unk> <0x41>", "x▁y", "café 日本語　一", "it ࢏'s", "  \u0085 b", "á b", "ﬁ Å", "\x00 \x01", "don't  stop \t now", "᠎ a", "\U0001f600" * 3]


def test_token_pairs_of_odd_texts(spark, monkeypatch):
    rng = random.Random(3)
    letters = list("ab  .,'s\n\t1") + ["é", "日", "　", "▁", "the ", "ing", "࢏", " "]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)] + ["hot words here"] * 400 + ["日本" * 30_000, "a" * 20_000, "one two " * 20_000]
    rows = [(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([("k", i, t, 5) for i, t in rows], "key string, doc_id long, text string, n int").repartition(4)
    expected = Counter((i, *x) for (i, _), x in zip(rows, brute_pairs(texts), strict=True))
    assert Counter(tuple(r) for r in token_pairs.align(frame, A, B, shard_rows=200).collect()) == expected
    assert token_pairs.align(frame.limit(0), A, B).collect() == []
    only_null = frame.where("text IS NULL")
    assert [tuple(r)[1:] for r in token_pairs.align(only_null, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_tables_that_begin_anew(spark, data):
    """Counts are whole if a worker's tables are emptied again and again within a task."""
    from cuespark.llm.common import docs_of

    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("doc_id % 3 = 0")
    found = token_pairs.aligned(docs_of(texts).repartition(1), A, B, 200_000, 20_000).where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))
    plain, small = Counter(), token_pairs.Pair(A, B, 1 << 28)
    for (text,) in texts.select("text").collect():
        numbers = small.numbers([text or ""])[0]
        table, starts = small.table(), np.cumsum([0, *small.table()[3]])
        if all(table[4][numbers]):
            for n in numbers:
                plain.update(small.links[0][starts[n] : starts[n + 1]].tolist())
    assert {r.key: r.n for r in found.collect()} == plain
    repeated = token_pairs.aligned(docs_of(texts).repartition(1), A, B, 200_000, 20_000).where("key IS NOT NULL").groupBy("key").count()
    assert repeated.agg(F.max("count")).first()[0] > 1


def test_parts_are_those_of_the_whole_text():
    """The library's ids of parts in a row are those of the text, whatever character stands before, after and beside a cut."""
    p = token_pairs.Pair(A, B, 1 << 28)
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and c != 0x2581]
    texts = [f"x{c} y{c}'s {c} 1{c}" for c in chars]
    for at in range(0, len(texts), 50_000):
        group = texts[at : at + 50_000]
        cut = [words.parts(t) for t in group]
        (a, n_a), (b, n_b) = p.encoded([x for c in cut for x in c])
        stops = np.cumsum([0, *map(len, cut)])
        of_a, of_b = (np.concatenate([[0], np.cumsum(n)])[stops] for n in (n_a, n_b))
        whole = p.a.encode_batch_fast([" " + t for t in group], add_special_tokens=False)
        for i, (e, ids) in enumerate(zip(whole, p.b.encode(group, num_threads=1), strict=True)):
            assert a[of_a[i] : of_a[i + 1]].tolist() == e.ids, group[i]
            assert b[of_b[i] : of_b[i + 1]].tolist() == ids, group[i]


def test_every_code_point_is_encoded_as_by_the_library():
    from tokenizers import Tokenizer

    library, by_library, own = Tokenizer.from_file(A), token_blocks.library_encoder(A), bpe.codec(A)
    chars = [chr(c) for c in range(0x323B0) if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(chars), 20_000):
        texts = [" ".join(f"x{c}'s {c}a 1{c}" for c in chars[at : at + 40]) for at in range(begin, min(begin + 20_000, len(chars)), 40)]
        expected = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert by_library(texts) == expected
        assert own.encode_all(texts) == expected


def test_known_parts_are_bounded():
    asked = []

    def solve(found):
        asked.extend(found)
        return [p.encode() for p in found]

    known = words.Known(solve, 40_000)
    rng = random.Random(1)
    texts = [[rng.choice(["often", "a" * 100, f"w{rng.randrange(2000)}"]) for _ in range(20)] for _ in range(500)]
    for t in texts:
        assert known.results([t]) == ["".join(t).encode()]
        assert known.held <= 40_000 + 20 * 400 and len(known.old) + len(known.table) < 600
    assert asked.count("often") == 1 and asked.count("a" * 100) > 100 and not any(len(p) > words.LONGEST for p in [*known.table, *known.old])


# earlier operators: hot groups and clashing names


def test_simhash_of_a_crowded_variant(spark):
    """Thousands of prints with one half in common are cut by further bits; the components are those of all pairs."""
    rng = np.random.default_rng(3)
    crowd = (rng.integers(0, 1 << 32, 20_000, dtype=np.uint64) << np.uint64(32)) | np.uint64(0xABCDEF)
    near = crowd[:4000] ^ (np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64))
    nearer = near[:2000] ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64))
    prints = np.unique(np.concatenate([crowd, near, nearer, rng.integers(0, 1 << 63, 5000, dtype=np.uint64)]))
    forest = simhash.Forest(len(prints))
    for bits in [(b,) for b in range(64)] + [(a, b) for a in range(64) for b in range(a)]:
        flipped = prints ^ np.uint64(sum(1 << b for b in bits))
        at = np.minimum(np.searchsorted(prints, flipped), len(prints) - 1)
        met = np.flatnonzero(prints[at] == flipped)
        for i, j in zip(met.tolist(), at[met].tolist(), strict=True):
            forest.link(i, j)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long").repartition(4)
    keys = simhash.crowded_keys(frame, 2, 2000)
    assert 30 <= len(keys) <= 64
    keyed = frame.mapInArrow(simhash._keys(2, spark.sparkContext.broadcast(keys)), "key long, print long")
    assert keyed.groupBy("key").count().agg(F.max("count")).first()[0] <= 512
    found = simhash.Forest(len(prints))
    place = {p: i for i, p in enumerate(prints.view(np.int64).tolist())}
    for r in simhash.links(frame, 2, most=2000).collect():
        assert (r.a ^ r.b).bit_count() <= 2 or ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2
        found.link(place[r.a], place[r.b])
    assert [found.root(i) for i in range(len(prints))] == [forest.root(i) for i in range(len(prints))]


def test_mixing_with_equal_ids_and_rows(spark, tmp_path):
    """A third of the ids are null, a third of the rows are equal: the mix is the same, and no task numbers them all."""
    rows = [(None, f"w {i} " * (1 + i % 7), "a") for i in range(3000)] + [(7, "same text here", "a")] * 3000 + [(i, f"own {i}", "b" if i % 2 else None) for i in range(3000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, part string").repartition(5)
    count = lambda df: Counter(tuple(r) for r in df.collect())
    whole = count(mixing.mix_report(frame))
    assert count(mixing.mix_report(frame, cell_rows=100)) == whole and count(mixing.mix_report(frame.repartition(3), cell_rows=40)) == whole
    taken = Counter()
    for (doc, size, *_, n), times in whole.items():
        taken[doc] += n * times
    emitted = mixing.emit(frame, cell_rows=100)
    assert emitted.columns == frame.columns
    assert count(emitted) == count(mixing.emit(frame.repartition(2)))
    words_ = Counter()
    for r in emitted.collect():
        words_[r.doc_id] += len(r.text.split())
    assert words_ == Counter({k: v for k, v in taken.items() if v})
    cells = mixing._spread(
        frame.select(F.struct("doc_id").alias("row"), F.lit(3).alias("size"), F.col("source"), mixing.place(frame).alias("md5"), F.lit("=a").alias("src"), F.lit(9).alias("class"), F.lit("0").alias("cell"), F.lit(0).alias("part")),
        spark.createDataFrame([("=a", 9, "0")], "src string, class int, cell string"), 100,
    )
    assert cells.groupBy("part").count().where("part > 0").agg(F.max("count")).first()[0] < 7000 and cells.select("part").distinct().count() > 500


def test_line_dedup_with_clashing_names(spark):
    rows = [(i, f"common\nown {i}", i, "d", "k", "r", 5) for i in range(12)] + [(None, None, 1, "d", "k", "r", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __cuespark_drops long, drops string, at string, `row` string, n_chars int")
    ways = [Counter(tuple(r) for r in line_dedup.drop_frequent_lines(frame, whole=True, broadcast_keys=n).collect()) for n in (1 << 20, 0)]
    assert ways[0] == ways[1] and sum(ways[0].values()) == 13
    assert ways[0][3, "own 3", 3, "d", "k", "r", 5] == 1
