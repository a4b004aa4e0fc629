import contextlib
import json
import os
import random
import subprocess
import sys
import tempfile
import time
import uuid

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from cuespark.functions import languages
from cuespark.operators import align, cache, calls, completion, joins, prefix, repeats, status
from cuespark.operators import sentences as S
from cuespark.plans import captions, workspace
from cuespark.plans.queries import Rehearsed
from cuespark.sources import readers, sink, writers
from cuespark.streaming import facade

SEGMENTS = "doc_id long, ord int, text string, start_ms long, end_ms long"


def segments(spark, rows, doc=1):
    return spark.createDataFrame([(doc, i, t, a, b) for i, (t, a, b) in enumerate(rows)], SEGMENTS)


def test_ordering_is_stable_and_drops_blanks(spark):
    got = S.order_segments(segments(spark, [("c", 100, 300), ("b", 100, 200), (" ", 0, 1), ("a", 0, 50), ("d", 100, 200)])).orderBy("ord").collect()
    assert [r.text for r in got] == ["a", "b", "d", "c"]


def test_parts_of_long_recordings(spark):
    """Chunked plans give the rows of whole windows, and no task holds a whole recording."""
    rng = random.Random(8)
    rows, at = [], 0
    for doc, n in ((1, 20_000), (2, 3), (None, 700), (None, 5), (-4, 0)):
        for i in range(n):
            at += rng.choice([0, 0, 1, 400])
            rows.append((doc, rng.randrange(n * 4), rng.choice(["a", "b", "c.", " "]), at, at + rng.randrange(3), "p"))
    table = spark.createDataFrame(rows, "doc_id long, ord long, text string, start_ms long, end_ms long, part string")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        words = S.order_segments(table.where("doc_id IS NOT NULL"))
        spread = S.order_segments(table.where("doc_id IS NOT NULL"), chunk_ms=50_000)
        same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert same(words, spread)
        words = words.drop("part")
        whole, chunked = S.sentences(words), S.sentences(spread.drop("part"), chunk=300)
        assert same(whole, chunked)
        assert same(S.flatten(whole), S.flatten(chunked, chunk=64, chunk_ms=50_000))
        assert same(S.batches(S.over_length(whole, 3), 20), S.batches(S.over_length(chunked, 3), 20, chunk=64))
        lines = S.chunk_lines(whole, 2)
        assert same(lines, S.chunk_lines(chunked, 2, chunk=64))
        assert same(S.line_batches(lines, 7), S.line_batches(lines, 7, chunk=64))
        held = S.sentence_ids(spread, chunk=300).groupBy(F.spark_partition_id()).count().collect()
        assert len(held) == 4 and max(r["count"] for r in held) < 8_000  # of 15,000 words
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_parts_keep_null_documents(spark):
    rows = [(None if i % 3 else 1, i, "p", i % 5) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, ord long, part string, value int")
    whole, spread = (prefix.sum_before(table, "n", F.col("value"), ["ord"], p) for p in (None, F.floor(F.col("ord") / 70)))
    assert sorted(map(str, whole.collect())) == sorted(map(str, spread.collect())) and spread.count() == 1000


def test_sentences_and_flatten(spark):
    words = segments(spark, [("Hi.", 0, 1), ("How", 2, 3), ("are", 4, 5), ("you？", 6, 7), ("fine", 8, 9)])
    table = S.sentences(words)
    assert [r.text for r in table.orderBy("sentence_index").collect()] == ["Hi.", "How are you？", "fine"]
    assert [r.text for r in S.flatten(table).orderBy("ord").collect()] == ["Hi.", "How", "are", "you？", "fine"]


def scan(tokens, limits):
    """The scan spelled out: leftmost runs for each period."""
    hits = []
    for p in range(1, limits[2] + 1):
        least, i = limits[0] if p == 1 else limits[1], 0
        while i + p <= len(tokens):
            k = 1
            while tokens[i + k * p : i + (k + 1) * p] == tokens[i : i + p]:
                k += 1
            if k >= least:
                hits.append((p, i, i + k * p, k))
                i += k * p
            else:
                i += 1
    return hits


def test_runs_equal_a_plain_scan(spark):
    rng = random.Random(5)
    docs = [[rng.choice("ab" if d % 2 else "abc") for _ in range(rng.randint(0, 40))] for d in range(120)]
    rows = [(d, 0, i, t, float(i), float(i + 1)) for d, doc in enumerate(docs) for i, t in enumerate(doc)]
    words = spark.createDataFrame(rows, "doc_id long, segment_index int, ord int, raw string, start double, end double")
    for limits in ((5, 4, 4), (2, 2, 3)):
        found = repeats.runs(repeats.number_tokens(words), *limits)
        ours = sorted((r.doc_id, r.phrase_len, r.start_token, r.end_token, r.repeat_count) for r in found.collect())
        assert ours == sorted((d, *h) for d, doc in enumerate(docs) for h in scan(doc, limits))
        chosen = sorted((r.doc_id, r.phrase_len, r.start_token, r.end_token, r.repeat_count) for r in repeats.select_hits(found).collect())
        expected = []
        for d, doc in enumerate(docs):
            kept = []
            for h in sorted(scan(doc, limits), key=lambda h: (h[1] - h[2], -h[0], -h[3], h[1])):
                if all(h[2] <= k[1] or k[2] <= h[1] for k in kept):
                    kept.append(h)
            expected += [(d, *h) for h in kept]
        assert chosen == sorted(expected)


def test_scan_prefers_phrases_and_reports(spark):
    content = json.dumps({"segments": [{"words": [{"word": w, "start": i * 0.1, "end": i * 0.1 + 0.1} for i, w in enumerate(["you", "know"] * 4)]}, "junk", {"words": [{"word": 3}, {"word": "x", "start": "late"}]}]})
    segs, words = readers.parse_scan_json(spark.createDataFrame([(1, content)], "doc_id long, content string"))
    result = captions.scan(segs, words)
    hit = result["hits"].collect()
    assert [(h.phrase, h.repeat_count, h.start) for h in hit] == [("you know", 4, 0.0)]
    summary = result["summary"].first().asDict()
    assert (summary["total_segments"], summary["total_tokens"], summary["flagged_tokens"]) == (3, 9, 8)
    report = writers.repeat_report(summary, [r.asDict() for r in result["phrases"].collect()], [h.asDict() for h in hit])
    assert report.splitlines() == ["1 repeats in 1 of 3 segments, 8 tokens (88.89 %)", "1x\tyou know", "segment\tfrom\tto\ttimes\ttokens\tphrase\ttext", f"0\t0.000\t0.800\t4\t8\tyou know\t{hit[0].text_excerpt}"]
    assert writers.repeat_report(summary, [], []) == "3 segments, none with a phrase that repeats"
    with pytest.raises(Exception, match="segments"):
        readers.parse_scan_json(spark.createDataFrame([(1, "[]")], "doc_id long, content string"))[0].collect()
    with pytest.raises(ValueError):
        repeats.runs(result["tokens"], min_word_run=1)


def test_reference_window(spark):
    batches = spark.createDataFrame([(1, 0, 8000, 8200), (1, 1, 90_000, 90_001)], "doc_id long, batch_id int, start_ms long, end_ms long")
    cues = spark.createDataFrame([(1, i, t, a, b) for i, (t, a, b) in enumerate([("a", 0, 50), (" b ", 3000, 4000), ("c", 5000, 7000), ("d", 12500, 13000), ("e", 14000, 15000), (" ", 8000, 8100)])], "doc_id long, cue_ord int, text string, start_ms long, end_ms long")
    for bucket in (500, 60_000):
        got = {r.batch_id: r.reference_text for r in joins.reference_text(batches, cues, bucket_ms=bucket).collect()}
        assert got == {0: "b c d", 1: ""}


def test_lookups_and_gates(spark):
    df = spark.createDataFrame([("a b", None), ("a b", " "), ("a b", " a b "), ("a b", "c")], "x string, y string")
    assert [r[0] for r in df.select(joins.unless_changed(F.col("x"), F.col("y"))).collect()] == ["a b", "a b", "a b", "c"]
    keys = spark.createDataFrame([(["0", "1", "10"], ["0", "2"])], "e array<string>, a array<string>")
    assert keys.select(joins.key_message(F.col("e"), F.col("a"))).first()[0] == "Missing keys ['1', '10']; Extra keys ['2']"
    chunks = spark.createDataFrame([(1, 5, True), (1, 5, False), (2, 1, True), (2, 9, False), (3, 4, False)], "doc_id long, n_lines int, failed boolean")
    gate = joins.failure_gate(chunks)
    assert {r.doc_id: r.verdict for r in gate.collect()} == {1: "fail", 2: "warn", 3: "ok"}
    with pytest.raises(Exception, match="Translation failed"):
        joins.enforce(gate).collect()


def test_cache_round(spark, tmp_path):
    path = str(tmp_path / "cache")
    requests = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    cache.append(spark.createDataFrame([("a", "1"), ("c", "3")], "cache_key string, value string"), path, 60)
    cache.append(spark.createDataFrame([("b", "2")], "cache_key string, value string"), path, -60)
    stored, now = spark.read.parquet(path), F.current_timestamp()
    assert [tuple(r) for r in cache.hits(requests, stored, now).collect()] == [("a", "1")]
    assert [tuple(r) for r in cache.misses(requests, stored, now).collect()] == [("b",)]


def test_diffs():
    assert align.inline_diff("a b c", "a x c d") == "a 【b/x】 c 【∅/d】"
    assert align.inline_diff("a b", "b") == "【a/∅】 b"
    assert align.change_log("a  b", "a b") == ""
    assert align.similarity("Hi, there!", "hi there") == 1.0
    assert align.coalesced([("delete", 0, 1, 0, 0), ("insert", 1, 1, 0, 1), ("equal", 1, 2, 1, 2)]) == [("replace", 0, 1, 0, 1), ("equal", 1, 2, 1, 2)]


def words(*spans):
    return [{"text": t, "start_ms": a, "end_ms": b} for t, a, b in spans]


def times(rows):
    return [(r["start_ms"], r["end_ms"]) for r in rows]


def test_times_are_carried():
    base = words(("red", 10, 40), ("blue", 100, 190))
    assert times(align.carry_times(base, "red or dark blue")) == [(10, 40), (40, 70), (70, 100), (100, 190)]  # the gap is shared
    assert times(align.carry_times(base, "so red blue")) == [(10, 10), (10, 40), (100, 190)]
    assert times(align.carry_times(base, "red blue sky")) == [(10, 40), (100, 190), (190, 190)]
    assert times(align.carry_times(words(("one", 0, 91)), "a b c")) == [(0, 30), (30, 60), (60, 91)]
    assert times(align.carry_times(base, "Red, green")) == [(10, 40), (100, 190)] and align.carry_times(base, "Red, green")[0]["text"] == "Red,"
    assert times(align.carry_times([], "n")) == [(0, 0)] and align.carry_times(base, "") == []


def test_parts_are_matched():
    texts = "so this is it now".split()
    assert align.match_parts(texts, ["so this", "is it now"]) == [(0, 1), (2, 4)]
    assert align.match_parts(texts, ["nothing alike", "is it now"]) is None
    lines = align.lines_of(words(*[(t, i, i + 1) for i, t in enumerate(texts)]), ["x", "y"], "so this is it now")
    assert [(x["text"], x["start_ms"], x["end_ms"]) for x in lines] == [("so this is it now", 0, 5)]


def test_responses():
    said = [completion.response_text(x)[1] for x in (None, {"choices": []}, {"choices": [None]}, {"choices": [{}]}, {"choices": [{"message": {}}]}, completion.response("  "))]
    assert [x.split()[-1] for x in said] == ["choices", "choices", "choice", "message", "content", "blank"]
    assert completion.response_text(completion.response(" a ")) == (" a ", "") and completion.response_id({}) == "-"
    assert completion.json_object('```json\n{"a": "b",}\n```')[0] == {"a": "b"}
    assert completion.json_object("{'a': 'b'}")[0] == {"a": "b"}
    assert completion.json_object('{"a": {"b": "c"')[0] == {"a": {"b": "c"}}
    assert "list" in completion.json_object("[1]")[1] and completion.json_object("none")[0] is None


def test_correction_loop():
    ask = {"0": "the cat sat on the mat today", "1": "ok"}
    good = json.dumps({"0": "The cat sat on the mat today.", "1": "ok"})
    scripted, calls = completion.Scripted(["", "[1]", good]), []
    assert completion.correct(scripted, ask, calls=calls) == (json.loads(good), "ok", 3)
    assert "an object is needed, not a list" in scripted.calls[2][-1]["content"]
    assert [(c["status"], c["responses"]) for c in calls] == [("error", [""]), ("success", ["[1]"]), ("success", [good])]
    bad = json.dumps({"0": "entirely other words than before here"})
    assert completion.correct(completion.Scripted([bad]), ask)[:2] == (json.loads(bad), "exhausted")
    assert completion.correct(completion.Scripted([json.dumps({"0": 1, "1": "ok"})]), ask)[0] == ask
    assert completion.correct(completion.Scripted([ValueError("down")]), ask, calls=calls)[0] == ask
    assert calls[-1]["error"] == "ValueError: down" and calls[-1]["status"] == "error"
    assert completion.check_correction({"2": "one two three"}, {"2": "four five six"}).startswith("text 2 is only 0.00 alike")
    assert completion.check_correction({"0": "one two three"}, {"0": "one x y"}) == ""
    assert completion.check_correction({"1": "a", "10": "b"}, {"2": "a"}) == "keys not answered: 1, 10; keys never asked for: 2"


def test_split_loop():
    ask = {"3": "one two three four"}
    assert completion.split(completion.Scripted(['{"3": "one two<br>three four"}']), ask, 2)[0] == {"3": ["one two", "three four"]}
    assert completion.split(completion.Scripted(['{"3": "one two three four"}']), ask, 2)[:2] == ({"3": ["one two three four"]}, "exhausted")
    assert completion.split(completion.Scripted(['{"4": "x"}']), ask, 2)[0] == {"3": ["one two three four"]}
    assert completion.check_split(ask, {"3": ["one two three", "four", "a b c"]}, 2).startswith("text 3 was rewritten (0.73 alike)")
    assert completion.check_split(ask, {"3": ["one two three", "four"]}, 2) == "text 3: more than 2 words in part 1 (3)"
    assert [completion.check_structure(ask, x) for x in ({"3": 1}, {"3": " <br> "}, {"3": "x"})] == ["text 3 is no string", "text 3 is empty", ""]


def test_translation_loop():
    ask = {"0": "a", "1": "b"}
    reflected = json.dumps({k: {"native_translation": v.upper()} for k, v in ask.items()})
    assert completion.translate(completion.Scripted([reflected]), ask, reflect=True)[0] == {"0": "A", "1": "B"}
    assert completion.translate(completion.Scripted(["{}"]), ask)[0] == ask
    assert completion.translate(completion.Scripted([ValueError("x")]), ask)[0] == {}
    assert completion.translate(completion.Scripted([ValueError("x")]), ask, keep_source=True)[0] == ask
    assert completion.check_translation(ask, {"0": "x"}) == "keys not answered: 1"
    assert completion.check_translation(ask, {"0": {}, "1": "x"}, reflect=True) == "no native_translation under 0, 1"
    with pytest.raises(ValueError, match="index 0"):
        completion.check_summary({"summary": "s", "terms": [{"src": "a"}]})


def test_summary():
    content = 'Here: {"summary": "s", "terms": [{"src": "a", "tgt": "b", "more": 1}], "x": 2}'
    calls = []
    assert completion.summarise(completion.Scripted([content]), "text", calls=calls) == {"summary": "s", "terms": [{"src": "a", "tgt": "b"}]}
    assert calls[0]["status"] == "success" and calls[0]["request"] == "text"
    for answer in (completion.response(""), completion.response("prose"), completion.response('{"summary": 1, "terms": []}')):
        with pytest.raises(ValueError):
            completion.summarise(completion.Scripted([answer]), "text")


def test_patience():
    inner = completion.Scripted([completion.RateLimited(), completion.response("x")])
    assert completion.Patient(inner, least=0, most=0)([])["id"] == "local"


def test_caption_pipeline(spark):
    text = "this is a rather long sentence that goes on for more than eighteen words so that it must be cut . Short one ."
    stream = captions.word_stream(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    identity = completion.Identity()
    out = captions.captions(stream, identity, completion.Chunker(6), identity)
    lines = out["lines"].orderBy("line_index").collect()
    assert [x.line_index for x in lines] == list(range(len(lines))) and len(lines) == 5
    assert all(x.translate_text == x.text for x in lines)
    assert out["translated_srt"].first().srt == out["srt"].first().srt
    assert out["gate"].first().verdict == "ok"
    assert out["line_report"].first().report.startswith("0. \n【6】this is a rather long sentence")


class Tally:
    """Counts its calls in a file, as workers are other processes."""

    model = "tally"

    def __init__(self, inner, path):
        self.inner, self.path = inner, str(path)

    def __call__(self, messages):
        with open(self.path, "a") as f:
            f.write("x")
        return self.inner(messages)

    @property
    def calls(self):
        return os.path.getsize(self.path) if os.path.exists(self.path) else 0


def test_a_second_run_asks_nothing(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60)) + " . Short one . And more ."
    stream = captions.word_stream(spark.createDataFrame([(1, text), (2, text), (3, "Other .")], "doc_id long, text string"))
    completers = [Tally(x, tmp_path / str(i)) for i, x in enumerate((completion.Identity(), completion.Chunker(12), completion.Identity()))]

    def run(session):
        before = [c.calls for c in completers]
        out = captions.captions(stream, *completers, session=session)
        rows = {name: sorted(map(str, out[name].collect())) for name in ("lines", "gate", "line_report")}
        return [c.calls - b for c, b in zip(completers, before, strict=True)], rows

    session = workspace.Session().open(str(tmp_path / "memo"))
    first, rows = run(session)
    assert first == [2, 1, 2]  # documents 1 and 2 ask the same: once
    assert run(session) == ([0, 0, 0], rows)
    log = spark.read.parquet(session.cache("calls"))
    assert log.count() == 5 and {r.status for r in log.collect()} == {"success"}
    session.enabled = False
    assert run(session) == ([3, 2, 3], rows) and run(None) == ([3, 2, 3], rows)  # without a memory every batch is asked
    assert cache.compact(spark, session.cache("correct"), F.lit("2100-01-01").cast("timestamp")) > 0  # as if all had expired
    session.enabled = True
    assert run(session) == ([2, 0, 0], rows)


def test_failed_batches_are_asked_again(spark, tmp_path):
    table = spark.createDataFrame([(1, 0, {"0": "a b c"}), (2, 0, {"0": "a b c", "1": "d"})], "doc_id long, batch_id int, payload map<string,string>")
    tally = Tally(Rehearsed([["lost"], ["down"]]), tmp_path / "n")  # two keys: never right; one: fails
    task = completion.translation(tally, language="X")
    asked = []
    for _ in range(2):
        before = tally.calls
        got = {r.doc_id: (r.status.split(":")[0], r.result) for r in completion.remembered(table, task, str(tmp_path / "m"), str(tmp_path / "log")).collect()}
        asked.append(tally.calls - before)
        assert got == {1: ("error", {}), 2: ("exhausted", {"0": "a b c", "1": "d"})}
    assert asked == [4, 1]
    assert sorted((r.status, r.error or "") for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [("error", "ConnectionError: no service")] * 2 + [("success", "")] * 3
    other = completion.translation(tally, language="Y")
    assert task.keys(table).select("cache_key").collect() != other.keys(table).select("cache_key").collect()


class Slow:
    """Answers after a while and leaves when each call began and ended."""

    def __init__(self, folder, seconds=0.2, limited_every=0):
        self.folder, self.seconds, self.limited_every = str(folder), seconds, limited_every

    def __call__(self, messages):
        begun = time.time()
        limited = self.limited_every and int(begun * 1000) % self.limited_every == 0
        if not limited:
            time.sleep(self.seconds)
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{begun} {time.time()} {os.getpid()}")
        if limited:
            raise completion.RateLimited
        return completion.Identity()(messages)

    def calls(self):
        return sorted(tuple(map(float, open(f"{self.folder}/{x}").read().split())) for x in os.listdir(self.folder))


def payload_rows(spark, n, parts=1):
    rows = [(i, 0, {str(k): f"text {i}" for k in range(i % 3 + 1)}) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, batch_id int, payload map<string,string>").repartition(parts)


def test_calls_in_flight(spark, tmp_path):
    rows, table = payload_rows(spark, 60)
    slow = Slow(tmp_path)
    found = completion.translation(slow).over(table, completion.Budget(in_flight=10)).collect()
    assert {(r.doc_id, tuple(sorted(r.result.items())), r.status) for r in found} == {(i, tuple(sorted(p.items())), "ok") for i, _, p in rows}
    calls = slow.calls()
    most = max(sum(a <= begun < b for a, b, _ in calls) for begun, _, _ in calls)
    assert len(calls) == 60 and 8 <= most <= 10 and len({p for _, _, p in calls}) == 1
    one = sorted((r.doc_id, r.result) for r in completion.translation(completion.Identity()).over(table, completion.Budget(in_flight=1)).collect())
    assert one == sorted((r.doc_id, r.result) for r in found)


def test_the_budget_is_kept_across_tasks(spark, tmp_path):
    _, table = payload_rows(spark, 40, 4)
    slow = Slow(tmp_path, 0.01)
    assert completion.translation(slow).over(table, completion.Budget(in_flight=8, per_second=10, tasks=4)).count() == 40
    begun = [a for a, _, _ in slow.calls()]
    assert len({p for _, _, p in slow.calls()}) > 1
    # any second holds the share of each task, rounded up, and what fell on its edges
    assert max(sum(a <= b < a + 1 for b in begun) for a in begun) <= 10 + 4


def test_rate_limits_hold_up_the_task(spark, tmp_path):
    _, table = payload_rows(spark, 40)
    slow = Slow(tmp_path, 0.02, limited_every=3)
    found = completion.translation(slow).over(table, completion.Budget(in_flight=4, attempts=50, least=0.05, most=0.05)).collect()
    assert len(found) == 40 and {r.status for r in found} == {"ok"} and len(slow.calls()) > 40


def test_a_stopped_pace_begins_no_call():
    pace, done = calls.Pace(apart=0.05), []
    patient = calls.Patient(lambda m: done.append(1) or {}, pace=pace)
    answers = calls.in_flight(lambda i: patient([]), range(1000), 4, pace)
    next(answers)
    answers.close()
    n = len(done)
    time.sleep(0.3)
    assert len(done) == n < 10
    with pytest.raises(completion.Stopped):
        patient([])


def test_a_cancelled_job_stops_calling(spark, tmp_path):
    table = spark.createDataFrame([(i, 0, {"0": "long text " * 200}) for i in range(400)], "doc_id long, batch_id int, payload map<string,string>").repartition(1)
    slow = Slow(tmp_path, 0.05)

    def job():
        with contextlib.suppress(Exception):
            completion.translation(slow).over(table, completion.Budget(in_flight=2)).collect()

    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    thread = InheritableThread(target=lambda: (spark.sparkContext.setJobGroup("calls", "calls", interruptOnCancel=True), job()))
    thread.start()
    while not slow.calls():
        time.sleep(0.1)
    spark.sparkContext.cancelJobGroup("calls")
    thread.join(60)
    time.sleep(2)
    n = len(slow.calls())
    time.sleep(1)
    assert len(slow.calls()) == n < 400


def test_srt_parse_and_write(spark):
    raw = "1\n00:00:00,000 --> 00:00:01,000\nraw\\h\\h\nline\n\n2\nbad\nx\n\n3\n00:00:02,5 --> x\ny\n\n4\n00:00:02.500 --> 00:00:03.000 junk\n二\n"
    got = readers.parse_srt(spark.createDataFrame([(1, raw), (2, "")], "doc_id long, content string")).collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in got] == [("raw line", 0, 1000), ("二", 2500, 3000)]
    entries = spark.createDataFrame([(1, 1, 0, 1000, "a"), (1, 2, 1000, 2000, " "), (1, 3, 2000, 3000, "c"), (2, 1, 0, 1, "")], "doc_id long, number int, start_ms long, end_ms long, text string")
    # blocks end at empty lines of \n alone; any other line end only divides the lines of a block
    odd = "1\u202800:00:00,000 --> 00:00:01,000\x0ba\u2028\u2028b\x85\n\x0c\n2\u202800:00:01,000 --> 00:00:02,000\x1cc\n\n\n3\n00:00:03,000 --> 00:00:04,000\n\u2028"
    assert [r.text for r in readers.parse_srt(spark.createDataFrame([(1, odd)], "doc_id long, content string")).collect()] == ["a  b", "c"]
    srt = {r.doc_id: r.srt for r in writers.srt(entries).collect()}
    assert srt == {1: "1\n00:00:00,000 --> 00:00:01,000\na\n\n3\n00:00:02,000 --> 00:00:03,000\nc\n", 2: ""}


def test_texts_are_written_by_document(spark, tmp_path):
    entries = spark.createDataFrame([(1, 1, 0, 1000, "a"), (2, 1, 5, 6, "b"), (2, 2, 6, 7, "c\nd")], "doc_id long, number int, start_ms long, end_ms long, text string")
    folder = tmp_path / "srt"
    expected = {f"{r.doc_id}.srt": r.srt for r in writers.srt(entries).collect()}
    files = lambda: {p.name: p.read_text() for p in folder.iterdir()}
    for _ in range(2):  # running it again leaves the same files
        writers.write_texts(writers.srt(entries), "srt", str(folder), ".srt")
        assert files() == expected
    writers.write_texts(writers.srt(entries.where("doc_id = 2")), "srt", f"file://{folder}", ".srt")
    assert files().keys() == {"2.srt"}
    odd = ["a/b", "a%2Fb", ".hidden", "名 前", "x", "X?", "_"]
    named = spark.createDataFrame([(n, f"text of {n}") for n in odd], "doc_id string, t string")
    writers.write_texts(named, "t", str(folder))
    assert sorted(files().values()) == sorted([*(f"text of {n}" for n in odd), expected["2.srt"]]) and "名 前.txt" in files()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    good = spark.createDataFrame([(str(i), "x") for i in range(20)], "name string, content string").repartition(4)
    sink.register(spark)
    good.write.format("text_files").mode("append").save(str(folder))
    before = sorted(p.name for p in folder.iterdir())
    assert len(before) == 20
    later = good.select(F.concat(F.lit("n"), "name").alias("name"), "content")
    bad = later.union(spark.createDataFrame([(None, "y")], "name string, content string"))
    twice = later.union(later).repartition(1)
    broken = later.withColumn("content", F.when(F.col("name") == "n7", F.raise_error(F.lit("stop")).cast("string")).otherwise("x"))
    for rows, what in ((bad, "needs a name"), (twice, "two rows"), (broken, "stop")):
        with pytest.raises(Exception, match=what):
            rows.write.format("text_files").mode("append").save(str(folder))
        assert sorted(p.name for p in folder.iterdir()) == before


def test_a_probe_reads_few_files_and_compaction_drops_expired_rows(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda n, value: spark.createDataFrame([(f"k{i}", f"{value}{i}") for i in range(n)], "cache_key string, value string")
    cache.append(rows(400, "old"), path, 3600)
    cache.append(rows(200, "new"), path, 3600)
    cache.append(spark.createDataFrame([(f"gone{i}", "x") for i in range(100)], "cache_key string, value string"), path, -60)
    requests = spark.createDataFrame([("k7",), ("k350",), ("gone3",), ("never",)], "cache_key string")
    every, few = cache.entries_of(spark, path), cache.entries_for(requests, path)
    read = lambda df: df.select(F.input_file_name()).distinct().count()
    assert len(every.inputFiles()) > 250 and read(few) <= 12
    assert "PartitionFilters: [bucket" in few._jdf.queryExecution().toString()
    now = F.current_timestamp()
    found = lambda: sorted(tuple(r) for r in cache.hits(requests, cache.entries_for(requests, path), now).collect())
    assert found() == [("k350", "old350"), ("k7", "new7")]
    assert cache.misses(requests, few, now).count() == 2
    gone = cache.compact(spark, path)
    after = cache.entries_of(spark, path)
    assert gone > 250 and after.count() == 400 and len(after.inputFiles()) <= 256 and found() == [("k350", "old350"), ("k7", "new7")]
    assert cache.compact(spark, str(tmp_path / "none")) == 0 and cache.entries_for(requests, str(tmp_path / "none")) is None


def test_tables_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from cuespark.sources import tables

    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(cluster)
    cluster.conf["spark.checkpoint.dir"] = "hdfs://store/shared/"
    assert tables.shared_dir(cluster).startswith("hdfs://store/shared/cuespark-")
    kept = tables.stage(spark.range(5))
    assert kept.count() == 5 and tables.exists(spark, kept.staged_at)
    tables.discard(kept)
    assert not tables.exists(spark, kept.staged_at)


def test_vtt_parsers(spark):
    vtt = "WEBVTT\n\nNOTE x\n\nid\n00:01.000 --> 00:02.000\n<b>Hi</b> <00:00:01.500>there\nyou\n\nNOTE kept out"
    got = readers.parse_vtt(spark.createDataFrame([(1, vtt)], "doc_id long, content string")).collect()
    assert [(r.text, r.start_ms) for r in got] == [("Hi there you", 1000)]
    words_vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000\nplain\nHello<00:00:01.500><c> big</c><00:00:02.000><c> world</c>"
    got = readers.parse_word_vtt(spark.createDataFrame([(1, words_vtt)], "doc_id long, content string")).orderBy("ord").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in got] == [("Hello", 1000, 1500), ("big", 1500, 2000), ("world", 2000, 3000)]


def test_line_ends_and_encodings(spark, tmp_path):
    """Files with CRLF or CR, or in GBK, give what the same file with LF in UTF-8 gives."""
    texts = {
        "srt": "1\n00:00:00,000 --> 00:00:01,000\n你好\nb\n\n2\n00:00:01,000 --> 00:00:02,000\nc\n",
        "vtt": "WEBVTT\n\n00:01.000 --> 00:02.000\n你好\n\n\n\n00:03.000 --> 00:04.000\nb\nc\n",
        "word_vtt": "WEBVTT\n\n00:00:01.000 --> 00:00:03.000\nplain\n你<00:00:01.500><c> 好</c>\n\n00:00:03.000 --> 00:00:04.000\nx<c> y</c>\n",
    }
    for name, text in texts.items():
        folder = tmp_path / name
        folder.mkdir()
        for end, mark in (("lf", "\n"), ("crlf", "\r\n"), ("cr", "\r")):
            for code in ("utf-8", "gbk"):
                (folder / f"{end}-{code}.txt").write_bytes(text.replace("\n", mark).encode(code))
        (folder / "bad.txt").write_bytes(b"\xff\xff\x81")
        (folder / "other.bin").write_bytes(b"x")
        files = readers.read_texts(spark, str(folder), "*.txt")
        assert files.count() == 7 and [r.fault for r in files.where("fault IS NOT NULL").collect()] == ["neither UTF-8 nor GBK: illegal multibyte sequence"]
        rows = {}
        for r in readers._parsed(files, readers.cues.FORMATS[name]("content")).collect():
            rows.setdefault(r.doc_id, []).append((r.ord, r.text, r.start_ms, r.end_ms))
        assert len(rows) == 6 and len({str(sorted(x)) for x in rows.values()}) == 1 and len(next(iter(rows.values()))) >= 2
        with pytest.raises(Exception, match="Undecodable file"):
            readers.read_files(spark, str(folder / "bad.txt")).collect()


def test_word_json_files(spark, tmp_path):
    doc = {"word_segments": [{"word": " b ", "start": 1.001, "end": 2.0}, {"word": "a", "start": 0.5, "end": 0.75}, {"word": "c"}, {"word": " "}]}
    (tmp_path / "x.json").write_bytes(json.dumps(doc | {"note": "你好"}, ensure_ascii=False).encode("gbk"))
    got = readers.read_words(spark, str(tmp_path / "x.json")).orderBy("ord").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in got] == [("a", 500, 750), ("b", 1000, 2000)]
    bad = spark.createDataFrame([(1, '{"word_segments": [{"word": "a b", "start": 0, "end": 1}]}'), ], "doc_id long, content string")
    with pytest.raises(Exception, match="white space inside"):
        readers.parse_word_json(bad).collect()
    assert readers.parse_word_json(spark.createDataFrame([(1, "{}")], "doc_id long, content string")).count() == 0
    (tmp_path / "x.vtt").write_text("WEBVTT")
    with pytest.raises(Exception, match="Unsupported file format"):
        readers.read_subtitles(spark, str(tmp_path / "x.vtt")).collect()
    assert readers.optional_cues(spark, None).count() == 0


def test_streaming_takes_new_files_only(spark, tmp_path):
    landing, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    doc = {"word_segments": [{"word": "Hi.", "start": 0, "end": 1}, {"word": "you", "start": 1, "end": 2}]}
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(doc))
        facade.run(facade.landing(spark, landing), facade.sentences_of, out, check).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 4 and got.select("batch").distinct().count() == 2


def test_configuration(tmp_path):
    (tmp_path / "c.toml").write_text('[a]\nb = " x "\nn = 3\n')
    config = readers.load_config(tmp_path / "c.toml")
    assert readers.config_text(config, "a.b") == "x" and readers.config_value(config, "a.z", 7) == 7
    with pytest.raises(TypeError):
        readers.config_text(config, "a.n")
    assert readers.load_config(None) == {}
    assert "18 words" in readers.prompt("split/structured", max_word_count=18)
    assert "$custom_prompt" in readers.prompt("translate/standard", target_language="x")
    assert readers.prompt_names() == sorted(readers.prompt_names()) and len(readers.prompt_names()) == 5
    with pytest.raises(FileNotFoundError):
        readers.prompt("no/such")
    assert readers.json_source('{"a": 1}') == {"a": 1} and readers.read_json(tmp_path / "none") is None
    (tmp_path / "video.webm").touch()
    assert readers.find_output(tmp_path, "video", [".mp4"]).name == "video.webm"


def test_status_and_cards(tmp_path):
    path = tmp_path / "s" / "status.json"
    writers.update_status(path, {"origin": {"a": 1, "b": 2}, "stage": "x"})
    merged = writers.update_status(path, {"origin": {"b": None}})
    assert merged["origin"] == {"a": 1, "b": None} and merged["stage"] == "x" and "last_time" in merged
    assert "stage" not in writers.update_status(path, {"n": 1}, replace=True)
    with pytest.raises(RuntimeError, match="uploader"):
        writers.video_card({"webpage_url": 1, "title": 1, "upload_date": 1})
    assert writers.log_entry("error", "a\\nb", [], error="E: x").splitlines()[1:] == ["req:", "a", "b", "res:", "", "error:", "E: x", ""]


def test_workspaces(tmp_path):
    folder = workspace.create(tmp_path, "a/b .")
    assert folder.name == "a_b"
    with pytest.raises(FileExistsError):
        workspace.create(tmp_path, "a/b .")
    with pytest.raises(ValueError):
        workspace.resolve(tmp_path, " . ")
    target = workspace.paths(folder)["info"]
    calls = []
    work = workspace.skip_if_done(lambda n: target)(lambda n: calls.append(n) or n)
    assert work(1) == 1
    target.touch()
    assert work(2) is None and calls == [1]

    @workspace.retrying(times=2, delay=0, default="no")
    def fails():
        calls.append("f")
        raise ValueError

    assert fails() == "no" and calls.count("f") == 3
    assert workspace.base_url(" http://h ") == "http://h/v1" and workspace.base_url("http://h/x/") == "http://h/x"
    session = workspace.Session()
    with pytest.raises(RuntimeError):
        session.cache("llm")
    with session.open("f"), pytest.raises(RuntimeError):
        session.open("g")


def test_sql_functions(spark):
    from cuespark.functions import registry

    assert "cue_similarity" in registry.register(spark)
    row = spark.sql("SELECT cue_tokens(' a b') AS t, cue_count_words('hi你好 there') AS n, cue_srt_timestamp(61001) AS s, cue_similarity('Hi!', 'hi') AS r, cue_inline_diff('a b', 'a c') AS d").first()
    assert tuple(row) == (["a", "b"], 4, "00:01:01,001", 1.0, "a 【b/c】")


def test_parsers_in_sql(spark):
    from cuespark.functions import registry

    registry.register(spark)
    srt = "1\n00:00:02,000 --> 00:00:03,000\nb\\h\nc \n\n2\r\n00:00:00.500 --> 00:00:01.000 x\r\na\n\n3\n00:00:09,000 --> 00:00:10,000\n \n\nno cue"
    vtt = "WEBVTT\n\nNOTE x\n\nid\n01:01.000 --> 00:01:02.000\n<b>Hi</b> <00:00:01.500>there\nyou\n\n00:01.000 --> 00:02.000\nfirst"
    word = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000\nplain\nHello<00:00:01.500><c> big</c><00:00:02.000><c> world</c>\n\n00:00:00.000 --> 00:00:00.500\nx<00:00:00.250><c> y</c>"
    for name, parse, text in (("srt", readers.parse_srt, srt), ("vtt", readers.parse_vtt, vtt), ("word_vtt", readers.parse_word_vtt, word)):
        docs = spark.createDataFrame([(1, text), (2, ""), (3, "junk")], "doc_id long, content string")
        docs.createOrReplaceTempView("texts")
        got = spark.sql(f"SELECT t.doc_id, c.* FROM texts t, LATERAL cue_parse_{name}(t.content) c")
        expected = parse(docs).select("doc_id", "ord", "text", "start_ms", "end_ms")
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(map(tuple, expected.collect())) and len(rows) >= 2


def test_a_running_job_is_cancelled(spark):
    """An error inside cancels a job that another thread of the same group is still running."""
    import threading
    import time

    from pyspark import InheritableThread

    failed, started = [], threading.Event()

    def wait(batches):
        time.sleep(120)
        yield from batches

    def work():
        started.set()
        try:
            spark.range(2).mapInPandas(wait, "id long").collect()
        except Exception as fault:  # noqa: BLE001
            failed.append(str(fault))

    began = time.time()
    with pytest.raises(KeyError), workspace.cancellable(spark, "slow"):
        thread = InheritableThread(target=work, session=spark)
        thread.start()
        started.wait()
        while not spark.sparkContext.statusTracker().getJobIdsForGroup("slow"):
            time.sleep(0.1)
        raise KeyError
    thread.join(60)
    assert not thread.is_alive() and failed and time.time() - began < 100


def test_cancellable_jobs(spark):
    with workspace.cancellable(spark, "one"):
        assert spark.range(3).count() == 3
    with pytest.raises(KeyError), workspace.cancellable(spark, "two"):
        raise KeyError


def test_many_hits_in_one_segment(spark):
    """100,000 hits: selected in seconds, as a plain greedy scan over sorted ends selects them."""
    import bisect

    rng = random.Random(12)
    rows = {}
    while len(rows) < 100_000:
        p, k, st = rng.randrange(1, 5), rng.randrange(4, 30), rng.randrange(600_000)
        rows[st, p] = (1, 0, p, st, st + p * k, k)
    hits = spark.createDataFrame(list(rows.values()), "doc_id long, segment_index int, phrase_len int, start_token int, end_token int, repeat_count int")
    began = time.time()
    got = sorted(tuple(r) for r in repeats.select_hits(hits).select("start_token", "end_token", "phrase_len").collect())
    assert time.time() - began < 60
    starts, kept = [], {}
    for _, _, p, st, en, k in sorted(rows.values(), key=lambda r: (r[3] - r[4], -r[2], -r[5], r[3])):
        at = bisect.bisect_left(starts, en)
        if at == 0 or kept[starts[at - 1]][1] <= st:
            bisect.insort(starts, st)
            kept[st] = (st, en, p)
    assert got == sorted(kept.values()) and len(got) > 5_000


def test_many_islands_in_one_segment(spark):
    """Runs against a scan of tokens one by one, where repeats follow upon repeats."""
    rng = random.Random(5)
    norm = []
    while len(norm) < 20_000:
        phrase = [rng.choice("abc") for _ in range(rng.randrange(1, 5))]
        norm += phrase * rng.randrange(1, 9)
    words = spark.createDataFrame([(1, 0, i, w, 0.0, 0.0) for i, w in enumerate(norm)], "doc_id long, segment_index int, ord int, raw string, start double, end double")
    expected = []
    for p in range(1, 5):
        at = 0
        while at + 2 * p <= len(norm):
            k = 1
            while norm[at + k * p : at + (k + 1) * p] == norm[at : at + p] and at + (k + 1) * p <= len(norm):
                k += 1
            if k >= (5 if p == 1 else 4):
                expected.append((p, at, at + p * k, k))
                at += p * k
            else:
                at += 1
    found = repeats.runs(repeats.number_tokens(words)).select("phrase_len", "start_token", "end_token", "repeat_count").collect()
    assert sorted(map(tuple, found)) == sorted(expected) and len(expected) > 500


def test_status_table(spark, tmp_path):
    path = str(tmp_path / "status")
    rows = lambda *x: spark.createDataFrame([(k, u if isinstance(u, str) else json.dumps(u), r, i) for i, (k, u, r) in enumerate(x)], "key string, update string, replace boolean, seq long")
    state = lambda: {r.key: json.loads(r.status) for r in status.current(status.log_of(spark, path)).collect()}
    assert state() == {} and status.compact(spark, path) == 0
    status.append(rows(("a", {"x": {"p": 1, "q": 2}, "s": "one"}, False), ("b", {"n": 1}, False), ("a", {"x": {"q": None}}, False), (None, {"z": 1}, False)), path)
    assert state() == {"a": {"x": {"p": 1, "q": None}, "s": "one"}, "b": {"n": 1}, None: {"z": 1}}
    writers_ = [InheritableThread(target=lambda i=i: status.append(rows(("a", {"w": {str(i): i}}, False)), path)) for i in range(4)]
    for w in writers_:
        w.start()
    for w in writers_:
        w.join()
    assert state()["a"]["w"] == {str(i): i for i in range(4)}  # none is lost
    status.append(rows(("b", {"m": 2}, True), ("b", {"o": [1, {"k": None}]}, False)), path)
    before = state()
    assert before["b"] == {"m": 2, "o": [1, {"k": None}]}
    assert status.compact(spark, path) >= 6 and state() == before and status.log_of(spark, path).count() == 3
    status.append(rows(("b", {"m": {"deep": 1}}, False)), path)
    assert state()["b"]["m"] == {"deep": 1}
    with pytest.raises(Exception, match="JSON object"):
        status.current(spark.createDataFrame([("a", "[1]", False, None, "w", 1)], status.LOG)).collect()


def test_lookups_with_clashing_names_and_repeated_keys(spark):
    rows = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (3, "z", 7)], "k int, found string, at int")
    table = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, None, 3)], "k int, t string, version int")
    assert sorted(map(tuple, joins.lookup(rows, table, ["k"], "t", F.lit("-")).collect())) == [(1, "x", 5, "b"), (2, "y", 6, "-"), (3, "z", 7, "-")]
    assert sorted(map(tuple, joins.lookup(rows, table, ["k"], "t", F.lit("-"), "version").collect())) == [(1, "x", 5, "a"), (2, "y", 6, "-"), (3, "z", 7, "-")]
    asked = spark.createDataFrame([("ENGLISH_UK", "deeplx", "own", 1), ("?", "bing", "own", 2)], "language string, service string, known string, row int")
    assert sorted(map(tuple, languages.with_code(asked, spark).collect())) == [("?", "bing", "own", 2, "zh-Hans"), ("ENGLISH_UK", "deeplx", "own", 1, "en-GB")]


def test_a_shared_folder_without_the_setting():
    """A stock session lets nobody set spark.checkpoint.dir while it runs; staged tables work without it."""
    code = """
import os
from pyspark.sql import SparkSession
from cuespark.sources import tables
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
a, b = tables.stage(spark.range(3)), tables.stage(spark.range(4))
assert (a.count(), b.count()) == (3, 4) and os.path.dirname(a.staged_at) == os.path.dirname(b.staged_at)
print("staged")
"""
    with tempfile.TemporaryDirectory() as empty:
        env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"SPARK_CONF_DIR": empty, "PYTHONPATH": os.pathsep.join(sys.path)}
        done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=300)
    assert "staged" in done.stdout, done.stderr[-2000:]


def test_overlaps_of_mixed_lengths(spark):
    """Windows of a second to days among cues of a moment to hours: every pair once, in rows that follow the pairs."""
    rng = random.Random(2)
    length = lambda: rng.choice([0, 900, 4_000, 70_000, 3_600_000, 40_000_000, 300_000_000])
    windows = [(d, i, lo, lo + length()) for d in (1, 2) for i, lo in enumerate(rng.randrange(-10**6, 10**8) for _ in range(60))] + [(1, 99, 10, 5)]
    cues = [(d, i, f"c{i}", a, a + rng.choice([0, 500, 2_000, 100_000, 9_000_000])) for d in (1, 2) for i, a in enumerate(rng.randrange(-10**6, 10**8) for _ in range(150))]
    w = spark.createDataFrame(windows, "doc_id long, window_id int, lo long, hi long")
    c = spark.createDataFrame(cues, "doc_id long, cue_ord int, text string, start_ms long, end_ms long")
    expected = sorted((d, i, n) for d, i, lo, hi in windows for e, n, _, a, b in cues if d == e and lo <= hi and a <= hi and b >= lo)
    for levels in (1, 3, 5):
        got = joins.overlap_pairs(w, c, levels=levels)
        assert sorted((r.doc_id, r.window_id, r.cue_ord) for r in got.collect()) == expected
    assert len(expected) > 500
    # an hour among seconds is ten rows at most on its own level
    hour = spark.createDataFrame([(1, 0, 0, 3_600_000)], "doc_id long, window_id int, lo long, hi long")
    second = spark.createDataFrame([(1, i, "x", 1000 * i, 1000 * i + 500) for i in range(5000)], "doc_id long, cue_ord int, text string, start_ms long, end_ms long")
    pairs = joins.overlap_pairs(hour, second)
    assert pairs.count() == 3601
