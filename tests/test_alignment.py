"""The alignment kernel against difflib and against plain scans, on texts whose words repeat."""

import random
import time
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuespark.operators import align, matching
from cuespark.plans.queries import QUERIES

NAMES = {True: "equal", False: "edit"}


def of_pairs(rows, n):
    out = [[] for _ in range(n)]
    for pair, *row in zip(*(x.tolist() for x in rows), strict=True):
        out[pair].append(tuple(row))
    return out


def check(before, after):
    batch = matching.batch(before, after)
    blocks, edits, ratios = of_pairs(batch.blocks(), len(before)), of_pairs(batch.edits(), len(before)), batch.ratios()
    for a, b, found, rows, ratio in zip(before, after, blocks, edits, ratios, strict=True):
        matcher = SequenceMatcher(None, a, b)
        assert found == [tuple(x) for x in matcher.get_matching_blocks()[:-1]]
        assert rows == [(i1, i2, j1, j2, int(tag == "equal")) for tag, i1, i2, j1, j2 in matcher.get_opcodes()]
        assert ratio == pytest.approx(matcher.ratio(), abs=1e-12)


def changed(rng, tokens, word, keep):
    return [x if rng.random() < keep else word() for x in tokens if rng.random() < 0.95]


@pytest.mark.parametrize("words", [1, 2, 5, 40])
def test_short_lists(words):
    rng = random.Random(words)
    word = lambda: str(rng.randrange(words))
    before = [[word() for _ in range(rng.randrange(30))] for _ in range(300)]
    after = [changed(rng, a, word, 0.8) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(30))] for a in before]
    check(before, after)
    check([], [])
    check([[], ["a"], []], [["a"], [], []])


@pytest.mark.parametrize("words", [1, 3, 60, 150])
def test_lists_with_popular_words(words):
    rng = random.Random(words)
    word = lambda: str(min(rng.randrange(words), rng.randrange(words)))
    before = [[word() for _ in range(rng.randrange(150, 420))] for _ in range(12)]
    check(before, [changed(rng, a, word, 0.9) for a in before])


def test_batches_are_cut(monkeypatch):
    monkeypatch.setattr(matching, "AT_ONCE", 50)
    rng = random.Random(9)
    word = lambda: str(rng.randrange(4))
    before = [[word() for _ in range(rng.randrange(25))] for _ in range(80)]
    check(before, [changed(rng, a, word, 0.7) for a in before])


def plain_parts(texts, parts):
    """Every range compared."""
    if not texts or not parts:
        return None
    if len(parts) == 1:
        return [(0, len(texts) - 1)]
    words, at, out = [align.bases(t.split()) for t in texts], 0, []
    for k, part in enumerate(parts):
        left, wanted, best = len(parts) - 1 - k, align.bases(part.split()), (-1.0, None)
        for end in range(at, len(texts) - left) if left else [len(texts) - 1] if at < len(texts) else []:
            found = [x for w in words[at : end + 1] for x in w]
            score = 1.0 if found == wanted else SequenceMatcher(None, wanted, found).ratio()
            if score > best[0]:
                best = (score, end)
        if best[0] < align.MATCH:
            return None
        out.append((at, best[1]))
        at = best[1] + 1
    return out


def test_parts_as_by_a_plain_scan():
    rng = random.Random(4)
    sentences, parts = [], []
    for n in range(400):
        words = rng.choice([2, 4, 30])
        word = lambda: rng.choice(["W%d", "w%d", "w%d,", "w%d x"]) % rng.randrange(words)  # noqa: B023, E731
        texts = [word() if rng.random() < 0.97 else " " for _ in range(rng.randrange(1, 40 if n % 20 else 260))]
        cuts = sorted(rng.sample(range(1, len(texts)), min(len(texts) - 1, rng.randrange(4))))
        own = [" ".join(changed(rng, texts[a:b], word, 0.93)) for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True)]
        sentences.append(texts)
        parts.append(own)
    found = align.match_all(sentences, parts)
    assert found == [plain_parts(t, p) for t, p in zip(sentences, parts, strict=True)]
    assert sum(x is not None and len(x) > 1 for x in found) > 80


def test_a_very_long_sentence():
    rng = random.Random(6)
    word = lambda: f"w{min(rng.randrange(4000), rng.randrange(4000))}"
    texts = [word() for _ in range(20_000)]
    many = [" ".join(changed(rng, texts[at : at + 10], word, 0.98)) for at in range(0, 20_000, 10)]
    few = [" ".join(changed(rng, texts[at : at + 10_000], word, 0.99)) for at in (0, 10_000)]
    began = time.time()
    whole = align.match_parts(texts, [" ".join(texts[at : at + 10]) for at in range(0, 20_000, 10)])
    assert whole == [(at, at + 9) for at in range(0, 20_000, 10)]
    align.match_parts(texts, many)
    found = align.match_parts(texts, few)
    assert found is not None and abs(found[0][1] - 9_999) < 20
    assert time.time() - began < 60


def test_literal_diffs_with_repeated_words():
    cases = [
        ("the cat the dog", "the dog the cat", "【∅/the dog】 the cat 【the dog/∅】"),
        ("a b a b a", "a b a", "a b a 【b a/∅】"),
        ("no no no yes", "no yes yes", "【no no/∅】 no yes 【∅/yes】"),
        ("go go", "go go go", "go go 【∅/go】"),
        ("x y x", "y x y", "【∅/y】 x y 【x/∅】"),
    ]
    assert align.inline_diffs([c[0] for c in cases], [c[1] for c in cases]) == [c[2] for c in cases]


def test_times_over_batches(spark):
    """The column function gives what single calls give; null rows stay null."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = [(rng.choice(["a", "b", "C.", "d e"]), 100 * k, 100 * k + rng.randrange(1, 140)) for k in range(rng.randrange(12))]
        rows.append((i, None if i % 17 == 0 else words, None if i % 23 == 0 else " ".join(rng.choice("abcdx") for _ in range(rng.randrange(12)))))
    table = spark.createDataFrame(rows, "id int, words array<struct<text:string,start_ms:bigint,end_ms:bigint>>, text string").repartition(3)
    for r in table.withColumn("moved", align.carry_times_udf("words", "text")).collect():
        expected = None if r.words is None or r.text is None else [(w["text"], w["start_ms"], w["end_ms"]) for w in align.carry_times([w.asDict() for w in r.words], r.text)]
        assert (r.moved and [tuple(x) for x in r.moved]) == (expected or (None if expected is None else []))


def test_null_rows():
    column = lambda x: pa.array(x, pa.string())
    assert align._of_texts(align.inline_diffs, pa.string())(column(["a", None, "b"]), column(["b", "x", None])).to_pylist() == ["【a/b】", None, None]
    assert align._operations(column([None]), column(["a"])).to_pylist() == [None]


def test_the_query_with_repeated_words(spark, data):
    rows = QUERIES["repeated_words_diff"](spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/conversations.parquet").count() > 50
    edits = 0
    for r in rows:
        a, b = (r.before or "").split(), (r.after or "").split()
        shown, matcher = [], SequenceMatcher(None, a, b)
        for tag, i1, i2, j1, j2 in matcher.get_opcodes():
            sides = "/".join(" ".join(x) or "∅" for x in (a[i1:i2], b[j1:j2]))
            shown.append(" ".join(b[j1:j2]) if tag == "equal" else f"【{sides}】")
        assert r.diff == " ".join(shown)
        left, right = align.bases(a), align.bases(b)
        assert r.similarity == pytest.approx(1.0 if left == right else SequenceMatcher(None, left, right).ratio())
        edits += shown != [" ".join(b)]
    assert edits > 30 and max(len(set((r.before or "").split())) < len((r.before or "").split()) for r in rows)


def test_parts_that_follow_each_other_skip_the_matcher(monkeypatch):
    """parts that are the words themselves need no numbers; the ranges are those of the matcher."""
    rng = random.Random(13)
    cases = []
    for _ in range(400):
        texts = [rng.choice(["a", "b", "A,", "…", "c d", "", " "][: rng.randrange(2, 8)]) for _ in range(rng.randrange(1, 30))]
        cuts = sorted(rng.sample(range(len(texts) + 1), min(len(texts) + 1, rng.randrange(1, 4))))
        cases.append((texts, [" ".join(texts[a:b]) for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True)]))
    fast = [align.match_parts(*c) for c in cases]
    followed = [align._followed(*c) is not None for c in cases]
    monkeypatch.setattr(align, "_followed", lambda *_: None)
    assert fast == [align.match_parts(*c) for c in cases] and any(followed) and not all(followed)
    monkeypatch.undo()
    monkeypatch.setattr(align, "_Places", lambda *_: 1 / 0)
    assert align.match_parts(["a", "b,", "c", "d."], ["a b,", "c d."]) == [(0, 1), (2, 3)]


def test_texts_are_aligned_in_slices(monkeypatch):
    """a batch's pairs are aligned a bounded number of bytes at a time, nulls and long pairs among them, with the same results."""
    rng = random.Random(18)
    old = [None if rng.random() < 0.1 else " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    new = [None if rng.random() < 0.1 else " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    expected = [None if x is None or y is None else align.inline_diff(x, y) for x, y in zip(old, new, strict=True)]
    monkeypatch.setattr(align, "TEXTS_AT_ONCE", 100)
    seen, inner = [], align.inline_diffs
    over = align._of_texts(lambda x, y: seen.append(sum(map(len, [*x, *y]))) or inner(x, y), pa.string())
    assert over(pa.array(old), pa.array(new)).to_pylist() == expected and max(seen) <= 240 and len(seen) > 50
    assert over(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []
