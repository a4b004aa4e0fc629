"""Queries without an oracle, over the whole of the smallest tables, against plain versions of what they compute."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from cuespark.llm import langid, mixing, quality, simhash, similar
from cuespark.llm.queries import QUERIES, vocabulary
from tests.llm.test_kernels import brute_statistics, greedy_phrases


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_token_blocks(spark, data, texts, tokenizer):
    expected, start = {}, 0
    for doc in sorted(texts):
        ids = [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 0]
        expected[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op1_token_blocks"](spark, data).collect()} == expected


def test_bpe_codec(spark, data, texts, tokenizer):
    expected = {}
    for doc, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        expected[doc] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op7_bpe_codec"](spark, data).collect()} == expected


def walk(model, row):
    """Log odds of one row, tree by tree and node by node."""
    out = model.base
    for node in model.roots.tolist():
        for _ in range(model.depth):
            node = int(model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node])
        out += float(model.value[node])
    return out


def test_quality_rules(spark, data, texts):
    documents, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(documents, labels)
    assert len(model.roots) > 10
    rows = {r.doc_id: r for r in QUERIES["op2_quality_rules"](spark, data).collect()}
    assert rows.keys() == texts.keys()
    for doc, text in texts.items():
        r, stats = rows[doc], brute_statistics(text)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == stats
        words, lines = text.encode().split(), [x for x in text.encode().split(b"\n") if x.strip()]
        failed = stats[0] < 10 or 100 * stats[4] > 20 * stats[0]
        n_chars = max(1, len(text))
        row = [np.log1p(stats[0]), stats[1] / max(1, stats[0]), stats[2] / max(1, stats[0]), stats[3] / max(1, len(lines)), stats[4] / max(1, stats[0])]
        row += [sum("A" <= c <= "Z" for c in text) / n_chars, sum("0" <= c <= "9" for c in text) / n_chars, sum(c in ".,;:!?'\"()-" for c in text) / n_chars, (len(text.encode()) - len(text)) / n_chars]
        row += [sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in lines) / max(1, len(lines)), len(set(words)) / max(1, len(words))]
        assert r.base_failed == failed
        verdict = 1 / (1 + np.exp(-walk(model, row)))
        assert abs(r.score - verdict) < 1e-9 and r.kept == (not failed and verdict >= 0.5)
    assert 0 < sum(r.kept for r in rows.values()) < len(rows)


def test_simhash(spark, data, texts):
    prints = {}
    for doc, text in texts.items():
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[doc] = sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
    docs, forest = sorted(prints), simhash.Forest(len(prints))
    for i, a in enumerate(docs):
        for j in range(i):
            if (prints[a] ^ prints[docs[j]]).bit_count() <= 2:
                forest.link(i, j)
    expected = {d: (f"{prints[d]:016x}", docs[forest.root(i)]) for i, d in enumerate(docs)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, data).collect()} == expected


def test_language_id(spark, data, texts, monkeypatch):
    """The language whose labelled text parses a whole document in the fewest priced phrases, by substring tests."""
    samples, build = {}, langid.build
    monkeypatch.setattr(langid, "build", lambda found, symbols: samples.update({n: b" ".join(map(langid.normal, t))[:symbols] for n, t in found.items()}) or build(found, symbols))
    rows = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, data).collect()}
    names = sorted(samples)
    assert len(names) == 4 and rows.keys() == texts.keys()
    for doc, text in sorted(texts.items())[:60]:
        plain = langid.normal(text)
        cost = [greedy_phrases(plain, samples[n]) * np.log2(len(samples[n])) for n in names]
        assert rows[doc].lang_pred == (names[int(np.argmin(cost))] if any(map(str.isalpha, text)) else "und")
        assert rows[doc].held_out == (zlib.crc32(str(doc).encode()) % 4 == 2)


def test_pipeline(spark, data, texts, tokenizer):
    """``run`` against plain versions of line dedup, near dedup and encoding; quality and mixing by their tested queries."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    table = spark.read.parquet(f"{data}/documents.parquet")
    source = {r.doc_id: r.source for r in table.select("doc_id", "source").collect()}
    good = [r.doc_id for r in quality.judge(table, quality.train(table, labels)).where("kept").collect()]
    key = lambda line: line.encode().strip().lower()
    counts = Counter(k for d in good for k in {key(x) for x in texts[d].split("\n")} - {b""})
    lined = {d: "\n".join(x for x in texts[d].split("\n") if counts[key(x)] < 10) for d in good}
    docs, forest = sorted(lined), simhash.Forest(len(lined))
    sets = [set(similar.shingle_set(lined[d].encode(), 5).tolist()) for d in docs]
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                forest.link(i, j)
    single = [d for i, d in enumerate(docs) if forest.root(i) == i]
    assert 0 < len(single) < len(docs)
    frame = spark.createDataFrame([(d, lined[d], source[d]) for d in single], "doc_id long, text string, source string")
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix_report(frame).where("taken > 0").collect()}
    expected = Counter()
    for d, n in copies.items():
        ids = tokenizer.encode(lined[d], add_special_tokens=False).ids
        expected[d, len(ids), sha(np.array(ids, "<u4").tobytes())] = n
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, data).collect()) == expected
