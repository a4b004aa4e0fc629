"""Recordings as rows: the same sentences and lines as from word streams, without moving a row."""

import json
import random
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from cuespark.functions import text as T
from cuespark.functions import timing
from cuespark.operators import align, completion, matching, repeats
from cuespark.operators import sentences as S
from cuespark.plans import captions
from cuespark.plans.queries import QUERIES
from cuespark.sources import cues, readers, tables, word_vtt, writers


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["One two three. Four five", "a b c d e f g h i j k l m n o p q. r", "", None, "  ", "x", "? ! .", "字 句。 次", "w " * 500 + "."]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df):
    return sorted(map(repr, df.collect()))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_same_sentences_and_lines_without_a_shuffle(docs):
    stream, packed = captions.word_stream(docs), captions.recordings(docs)
    sentences, lines = S.recording_sentences(packed), S.recording_lines(packed, 4)
    assert rows(sentences) == rows(S.sentences(stream))
    assert rows(lines.select(*sorted(lines.columns))) == rows(S.chunk_lines(S.sentences(stream), 4).select(*sorted(lines.columns)))
    assert shuffles(sentences) == shuffles(lines) == 0


def test_words_keep_white_space_of_their_own(spark):
    words = [(1, [(" a ", 0, 1), ("b . ", 1, 2), ("c", 2, 3)])]
    packed = spark.createDataFrame(words, f"doc_id long, words array<{S.SEGMENT}>")
    stream = packed.select("doc_id", F.posexplode("words").alias("ord", "w")).select("doc_id", "ord", "w.*")
    assert rows(S.recording_sentences(packed)) == rows(S.sentences(stream))


def test_sentences_back_to_recordings(spark):
    """Blank words go, the others are put in the order of their times."""
    table = spark.createDataFrame([(1, 0, [("b", 5, 6), (" ", 0, 1)]), (1, 1, [("a.", 2, 3), ("c", 5, 6)]), (2, 0, None)], f"doc_id long, sentence_index int, segments array<{S.SEGMENT}>")
    words = S.recordings(table).select("doc_id", F.posexplode("words").alias("ord", "w")).select("doc_id", "ord", "w.*")
    assert rows(words) == rows(S.flatten(table).select("doc_id", "ord", "text", "start_ms", "end_ms"))


def test_pieces(spark):
    table = spark.createDataFrame([([("a", 0, 1), ("b", 1, 2), ("c", 2, 3)],), ([],)], f"segments array<{S.SEGMENT}>")
    assert [r[0] for r in table.select(F.transform(S.pieces("segments", 2), S.joined)).collect()] == [["a b", "c"], None]


def test_times_of_any_size(spark):
    at = [-5, 0, 59_999, 3_600_000, 99 * 3_600_000, 360_000_000, 3_600_000_001]
    shown = [r[0] for r in spark.createDataFrame([(x,) for x in at], "ms long").select(timing.srt_timestamp(F.col("ms"))).collect()]
    ms = [max(0, x) for x in at]
    assert shown == [f"{x // 3_600_000:02d}:{x // 60_000 % 60:02d}:{x // 1000 % 60:02d},{x % 1000:03d}" for x in ms]


def test_agreeing_texts_skip_the_matcher(monkeypatch):
    seen = []
    inner = matching.batch
    monkeypatch.setattr(matching, "batch", lambda a, b: seen.append(len(a)) or inner(a, b))
    assert align.similarities(["a b.", "c d", "E, f"], ["a b.", "c x", "e f"]) == [1.0, 0.5, 1.0] and seen == [1]
    asked = {str(i): f"w{i} x y" for i in range(50)}
    assert completion.check_split(asked, {k: [t] for k, t in asked.items()}, 7) == "" and seen == [1]
    many = " ".join(["the"] * matching.POPULAR_FROM)
    assert align.edit_ratios([many, "a"], [many, "a"]) == [1.0, 1.0] and seen == [1, 1]  # so long a list is the matcher's


def test_gate_of_lines_moves_no_row(spark, data):
    assert shuffles(QUERIES["length_violations"](spark, data)) == 0


def test_odd_words_are_cut_as_in_word_streams(spark):
    """Wide and blank marks, white space of all kinds, words without text, null and empty recordings, long stretches."""
    texts = ["a", "b？", "c。　", "\x85d! ", "é.", "", " . ", "​x", "字", "!?", "z"] * 3
    some = [(t, i, i + 1) for i, t in enumerate(texts)]
    packed = spark.createDataFrame([(1, some), (2, []), (3, None), (4, some[::-1]), (5, [("x", 0, 1)] * 700), (6, [("a", 0, 1), (None, 1, 2), ("b.", 2, 3)])], f"doc_id long, words array<{S.SEGMENT}>")
    stream = packed.select("doc_id", F.posexplode("words").alias("ord", "w")).select("doc_id", "ord", "w.*")
    assert rows(S.recording_sentences(packed)) == rows(S.sentences(stream))
    lines = S.recording_lines(packed, 3)
    assert rows(lines) == rows(S.chunk_lines(S.sentences(stream), 3).select(*lines.columns))
    assert "lambdafunction" not in lines._jdf.queryExecution().executedPlan().toString()  # no expression visits word after word


def test_an_answer_that_can_be_read_is_not_repaired(monkeypatch):
    monkeypatch.setattr(completion, "_balanced", lambda body: 1 / 0)
    assert completion.lenient_json('so: {"a": "b"}') == {"a": "b"}


def test_answers_without_a_log_hold_no_calls(spark, monkeypatch):
    written = []
    inner = completion.stage
    monkeypatch.setattr(completion, "stage", lambda df: written.append(df.columns) or inner(df))
    requests = spark.createDataFrame([(1, 0, {"0": "a b"})], "doc_id long, batch_id int, payload map<string,string>")
    assert completion.remembered(requests, completion.correction(completion.Identity())).first()["result"] == {"0": "a b"}
    assert written == [["doc_id", "batch_id", "result", "status", "attempts"]]


def test_text_of_recordings_moves_no_row(spark, docs, data):
    assert rows(writers.recordings_text(captions.recordings(docs))) == rows(writers.segments_text(captions.word_stream(docs)))
    assert shuffles(QUERIES["segments_text"](spark, data)) == 0


def test_words_of_a_file_are_gathered_once(spark, data):
    """Packed in their rows; only the words that were read back are gathered."""
    assert QUERIES["word_json_scan"](spark, data)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def odd_segments(spark):
    """Segments with and without repeats, odd words, unknown times, null and empty ones."""
    rng = random.Random(7)
    texts = [[rng.choice(["a", "b", "A,", "don't", "İx", "Kb", "ß", "…", None][: 3 + d % 7]) for _ in range(rng.randrange(90))] for d in range(60)]
    runs = [(["you", "know"] * 9 + ["x"]) * 3, ["no"] * 40, ["a", "b", "a", "b", "a", "b", "a", "b", "c", "c", "c", "c", "c", "c"]]
    rows = [(d // 2, d % 2, [(t, None if i % 5 == 4 else i * 0.3, i * 0.3 + 0.1) for i, t in enumerate(x)]) for d, x in enumerate(texts + runs)]
    return spark.createDataFrame([*rows, (90, 0, []), (91, 0, None)], f"doc_id long, segment_index int, words {repeats.RAW}")


def test_scans_of_rows_are_those_of_word_streams(spark):
    packed = odd_segments(spark)
    words = packed.select("doc_id", "segment_index", F.posexplode("words").alias("ord", "w")).select("doc_id", "segment_index", "ord", "w.*")
    tokens = repeats.number_tokens(words)
    assert rows(repeats.recording_scan(packed)) == rows(repeats.scan(words)) != []
    for limits in ({}, {"min_word_run": 2, "min_phrase_run": 2, "max_phrase_len": 3}):
        found = repeats.runs(tokens, **limits)
        assert rows(repeats.recording_runs(packed, **limits)) == rows(found) and rows(repeats.recording_runs(packed, select=True, **limits)) == rows(repeats.select_hits(found))
    summary = repeats.summary(packed, tokens, repeats.select_hits(repeats.runs(tokens)))
    assert rows(repeats.recording_summary(packed).select(*summary.columns)) == rows(summary)
    with pytest.raises(ValueError):
        repeats.recording_scan(packed, min_word_run=1)


def test_scans_move_no_token(spark, data):
    """hits leave their rows described; only the report of thirty sorts them."""
    assert shuffles(QUERIES["described_hits"](spark, data)) == shuffles(QUERIES["hit_records"](spark, data)) == shuffles(QUERIES["repeat_hits"](spark, data)) == 0
    assert "TakeOrderedAndProject" in QUERIES["top_hits"](spark, data)._jdf.queryExecution().executedPlan().toString() and shuffles(QUERIES["top_hits"](spark, data)) == 0


def test_scan_json_is_read_in_its_row(spark, data):
    """F8: packing, parsing and counting move no word; odd documents are read entry by entry, with the same rows."""
    odd = ['{"segments": [{"words": [{"word": 3, "start": 1}, {"word": "x", "start": "late", "end": 2}, null, "y"]}, "junk", null, {"words": 1}, {}]}']
    plain = ['{"segments": [{"words": [{"word": "x", "start": 1, "end": 2.5}, {"word": null}]}]}', '{"segments": [{"end": 9, "start": 1, "text": "x y", "words": [{"word": "x", "start": 1e2, "end": 7}, {"word": "y"}]}]}', '{"segments": []}']
    docs = spark.createDataFrame(list(enumerate(odd + plain)), "doc_id long, content string")
    assert [r.k for r in docs.select(F.schema_of_variant(F.try_parse_json("content")).rlike(readers.PLAIN_SCAN).alias("k")).collect()] == [False, True, True, False]
    found = sorted((r.doc_id, r.segment_index, [tuple(w) for w in r.words or []]) for r in readers.scan_recordings(docs).collect())
    none = (None, None, None)
    assert found == [
        (0, 0, [(None, 1.0, None), ("x", None, 2.0), none, none]), (0, 1, []), (0, 2, []), (0, 3, []), (0, 4, []),
        (1, 0, [("x", 1.0, 2.5), none]), (2, 0, [("x", 100.0, 7.0), ("y", None, None)]),
    ]
    tokens = repeats.recording_tokens(odd_segments(spark)).select("doc_id", "segment_index", F.posexplode("tokens").alias("i", "t")).select("doc_id", "segment_index", "i", "t.*")
    words = odd_segments(spark).select("doc_id", "segment_index", F.posexplode("words").alias("ord", "w")).select("doc_id", "segment_index", "ord", "w.*")
    assert rows(tokens) == rows(repeats.number_tokens(words))
    for twice in ('{"segments": [], "segments": []}', '{"segments": 1}', "[1]", "x"):
        with pytest.raises(Exception, match="a scan needs"):
            readers.scan_recordings(spark.createDataFrame([(1, twice)], "doc_id long, content string")).collect()
    assert shuffles(QUERIES["scan_json_tokens"](spark, data)) == 0


def test_vtt_files_are_made_and_read_in_their_rows(spark, data):
    """neither lines nor cues are gathered."""
    assert shuffles(QUERIES["vtt_cues"](spark, data)) == 0


def test_cue_times_are_matched_once_and_ends_are_trimmed(spark):
    """one match gives the digits of both times; every kind of white space goes at the ends, none inside."""
    assert cues.vtt("content").count(cues.VTT_TIME) == 2 and cues.srt("content").count(cues.SRT_TIME) == 2  # a test and a match
    spaces = S.SPACES
    inside = spaces.replace("\n", "").replace("\r", "")
    one = f"{spaces}WEBVTT\n\n00:01.500 --> 01:02:03.004 x y\n{inside}a{inside}b{inside}\n\n1:00 --> 2\nno\n\n99:00:00.000{inside}-->{inside}00:00.000\nc"
    got = [tuple(r)[1:] for r in readers.parse_vtt(spark.createDataFrame([(1, one)], "doc_id long, content string")).orderBy("ord").collect()]
    assert got == [(0, f"a{inside}b", 1500, 3_723_004), (1, "c", 356_400_000, 0)]
    assert spark.range(1).select(*[T.strip(F.lit(f"{c}x{c}")) for c in spaces]).first() == tuple("x" for _ in spaces)


@dataclass
class Odd:
    """A corrector, splitter or translator whose answers depend on the text: rewritten, longer, blank, cut, unusable, none."""

    kind: str

    def __call__(self, messages):
        payload = completion.request_payload(messages)
        if self.kind == "translate" and any("down" in t for t in payload.values()):
            raise ConnectionError("no service")

        def one(key, text):
            words = text.split()
            if self.kind == "translate":
                return f"* {text}" if int(key) % 2 else text
            if self.kind == "split":
                return "<br>".join(words[:5] + [" ".join(words[5:])]) if int(key) % 2 else "<br>".join([" ".join(words[:12]), " ".join(words[12:])])
            return [text, text.upper(), text + " end. More", " ", f" {text} ", text.replace("b", "b. b"), text.replace(" ", "　")][int(key) % 7]

        return completion.response("no" if "broken" in messages[1]["content"] else json.dumps({k: one(k, t) for k, t in payload.items()}, ensure_ascii=False))


def many_words(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "cd", "e.", "f!", "字。", "x-y", "<br>", "12", "句"]) for _ in range(rng.randrange(400))) for _ in range(12)]
    return spark.createDataFrame(list(enumerate([*texts, "", None, " ", "x", "w " * 90, "b " * 30 + "字" * 60, "it is down here.", "broken b c. " * 30, "字 句 。" * 40])), "doc_id long, text string")


def test_captions_in_rows_are_those_of_word_streams(spark):
    """every table of the run, with answers that move sentence ends, fail or cannot be used."""
    docs = many_words(spark)
    completers = [Odd("correct"), Odd("split"), Odd("translate")]
    packed, stream = (captions.captions(f(docs), *completers) for f in (captions.recordings, captions.word_stream))
    for name in ("audit", "sentences", "lines", "gate", "srt", "translated_srt", "sentence_report", "line_report"):
        assert sorted(packed[name].columns) == sorted(stream[name].columns)
        columns = sorted(packed[name].columns)
        assert rows(packed[name].select(columns)) == rows(stream[name].select(columns)) != []
    assert {r.verdict for r in packed["gate"].collect()} >= {"ok", "fail"}


def test_captions_of_odd_words_in_rows(spark):
    """Blank words, times out of order, equal and unknown ones."""
    some = [("b", 5, 6), (" ", 0, 1), ("a.", 2, 3), ("c", 5, 6), ("d", 5, 5), (None, 1, 2), ("e. ", None, 7)]
    packed = spark.createDataFrame([(1, some), (2, []), (3, None), (4, some * 9), (5, [(" ", 0, 1)])], f"doc_id long, words array<{S.SEGMENT}>")
    stream = packed.select("doc_id", F.posexplode("words").alias("ord", "w")).select("doc_id", "ord", "w.*")
    completers = [completion.Identity(), completion.Chunker(12), completion.Identity()]
    ours, theirs = (captions.captions(x, *completers) for x in (packed, stream))
    for name in ("audit", "sentences", "lines", "gate"):
        columns = sorted(ours[name].columns)
        assert rows(ours[name].select(columns)) == rows(theirs[name].select(columns)) != []


@pytest.mark.parametrize("name", ["caption_lines", "caption_gate", "corrected_captions"])
def test_captions_move_no_row_and_keep_two_tables(spark, data, name, monkeypatch):
    """no shuffle on the way; of the three tables written, the lines without translations are gone."""
    written, gone = [], []
    inner, drop = captions.stage, captions.discard
    monkeypatch.setattr(captions, "stage", lambda df, **o: written.append(shuffles(df)) or inner(df, **o))
    monkeypatch.setattr(captions, "discard", lambda *t: gone.extend(t) or drop(*t))
    monkeypatch.setattr(captions, "recordings", lambda docs, inner=captions.recordings: inner(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")))
    assert shuffles(QUERIES[name](spark, data)) == 0 and written == [0, 0, 0] and len(gone) == 1


def test_word_vtt_batches_are_those_of_sql(spark):
    """the kernel reads what the SQL of the format reads; words out of order, blank, without times, odd digits."""
    rng = random.Random(5)
    bits = ["\n", "\n\n", "\r\n", "\r", "<c>", "</c>", " ", "x", "字", "<b>", "<", ">", "\u2028", "\xa0", "00:00:01.500", "<00:00:02.001>", "<c> big</c>", "<\u06600:00:02.001>", "00:00:01.000 --> 99:59:59.999", "00:00:09.001-->00:00:03.000\nw<c>", "\nHello<00:00:01.500><c> big</c><00:00:00.999><c>\u3000</c>"]
    texts = ["00:00:01.000 --> 00:00:03.000\n" + "".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate([*texts, "", None, "junk"])), "doc_id long, content string").repartition(4)
    found = rows(readers.parse_word_vtt(docs))
    assert found == rows(docs.select("doc_id", F.inline(F.expr(cues.word_vtt("content"))))) and len(found) > 900
    stamps = [f"{h:02d}:{m:02d}:{s:02d}.{ms:03d}" for h, m, s in ((0, 0, 0), (99, 59, 59), (7, 31, 8)) for ms in range(1000)]
    sql = spark.createDataFrame([(i, x) for i, x in enumerate(stamps)], "i int, t string").select("i", timing.vtt_ms(F.col("t")).alias("ms")).orderBy("i")
    assert word_vtt.milliseconds(stamps).tolist() == [r.ms for r in sql.collect()] and word_vtt.milliseconds([]).tolist() == []


def test_word_vtt_files_are_made_and_read_in_their_rows(spark, data, monkeypatch):
    """only the counts of documents move."""
    monkeypatch.setattr(tables, "spread", lambda files, key: files)
    plan = QUERIES["word_vtt_words"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("ArrowEvalPython") == 2 and "rlike" not in plan.lower()


def test_files_in_folders(spark, docs, data, tmp_path, monkeypatch):
    """the driver moves and lists folders only, and reads the same files; running it again replaces them."""
    srt = writers.recordings_srt(captions.recordings(docs), 4)
    assert rows(srt) == rows(writers.srt(writers.line_entries(S.recording_lines(captions.recordings(docs), 4))))
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text\r\n"), F.col("id").cast("string")).alias("t"))
    flat, path = tmp_path / "flat", tmp_path / "folders"
    writers.write_texts(many, "t", str(flat), ".srt")
    for n in (500, 400):
        writers.write_texts(many.where(F.col("doc_id") < n), "t", f"file://{path}", ".srt", digits=1)
        assert len([*path.iterdir()]) == 16 and len([*path.rglob("*.srt")]) == n
        name = F.regexp_extract("doc_id", r"([^/]+)\.srt$", 1).cast("long")
        ours, theirs = readers.read_folders(spark, str(path), ".srt"), readers.read_texts(spark, str(flat), "*.srt").where(name < n)
        assert rows(ours.select(name, "content", "fault")) == rows(theirs.select(name, "content", "fault")) != []
    monkeypatch.setattr(readers, "read_texts", None)  # would list all files on the driver
    assert "binaryFile" not in QUERIES["subtitle_files"](spark, data)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="overwrite only"):
        many.select(F.col("doc_id").cast("string").alias("name"), F.col("t").alias("content")).write.format("text_files").option("digits", "1").mode("append").save(str(path))
