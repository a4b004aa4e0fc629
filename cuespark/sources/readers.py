"""Readers: speech-recognition JSON, SRT, WebVTT, word-level VTT, configuration.

Each parser has two layers: a DataFrame function over text rows (``doc_id, content``), and a reader that
loads files.  File content is decoded as UTF-8, or GBK where that is not valid; CRLF and CR become LF.
"""

from __future__ import annotations

import json
import tomllib
from functools import lru_cache
from pathlib import Path
from string import Template

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.functions import text as T
from cuespark.functions import timing
from cuespark.operators.repeats import RAW
from cuespark.operators.sentences import order_segments
from cuespark.sources import cues, sink, word_vtt

WORDS_JSON = "word_segments array<struct<word:string,start:double,end:double,score:double>>"
SCAN_JSON = "segments array<string>"
SEGMENTS_JSON = "array<struct<words:array<struct<word:string,start:double,end:double>>>>"
#: Types of numbers in JSON, and the schema of a scan whose words and times all are what they should be.
NUMBER = r"(?:BIGINT|DOUBLE|DECIMAL[^<>:]*|FLOAT|INT|TINYINT|SMALLINT)"
PLAIN_SCAN = rf"^OBJECT<(?:language: STRING, )?segments: ARRAY<OBJECT<(?:end: {NUMBER}, )?(?:start: {NUMBER}, )?(?:text: STRING, )?words: ARRAY<OBJECT<(?:end: {NUMBER}, )?(?:score: {NUMBER}, )?(?:start: {NUMBER}, )?word: STRING>>>>>$"
def _gbk(content: pd.Series) -> pd.DataFrame:
    def one(raw: bytes | None) -> tuple[str | None, str | None]:
        try:
            return (None if raw is None else bytes(raw).decode("gbk")), None
        except UnicodeDecodeError as fault:
            return None, f"neither UTF-8 nor GBK: {fault.reason}"

    return pd.DataFrame([one(raw) for raw in content], columns=["text", "fault"], dtype=object)


def texts_of(files: DataFrame) -> DataFrame:
    """``files(path, content)`` of bytes -> ``doc_id, content, fault``: UTF-8 or else GBK, line ends as reading a text file
    gives them; what is neither has a fault and no content.  Valid UTF-8 does not leave the JVM."""
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    other = F.pandas_udf(_gbk, "text string, fault string")(F.when(~valid, F.col("content")))
    read = files.select(F.col("path").alias("doc_id"), F.when(valid, text).alias("text"), other.alias("other"))
    return read.select("doc_id", F.expr(cues.unified("coalesce(text, other.text)")).alias("content"), F.col("other.fault").alias("fault"))


def read_texts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``doc_id`` (the path), ``content`` and ``fault`` of whole files, from any store that Spark reads; ``pattern`` (a glob of
    names) is applied while files are listed."""
    reader = spark.read.format("binaryFile")
    return texts_of((reader.option("pathGlobFilter", pattern) if pattern else reader).load(path))


def read_folders(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """As ``read_texts``, of what ``writers.write_texts`` wrote to folders: tasks list them, the driver never knows all files."""
    sink.register(spark)
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return texts_of(spark.read.format("text_files").schema(sink.READ).option("suffix", suffix).option("tasks", str(tasks)).load(path))


def read_files(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """``doc_id`` (the path) and ``content`` of whole files; a file that cannot be decoded or has another suffix than the
    one asked for is an error when its row is read."""
    name, fault = F.col("doc_id"), F.concat(F.lit("Undecodable file: "), F.col("doc_id"), F.lit(", "), F.col("fault"))
    files = read_texts(spark, path).select(name, F.when(F.col("fault").isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("content")).alias("content"))
    if suffix:
        bad = F.raise_error(F.concat(F.lit("Unsupported file format: "), name))
        files = files.withColumn("doc_id", F.when(F.lower(name).endswith(suffix), name).otherwise(bad.cast("string")))
    return files


def parse_word_json(docs: DataFrame) -> DataFrame:
    """``doc_id, ord, text, start_ms, end_ms`` of the words with text and both times; a word with white
    space inside raises; a missing list gives no words."""
    parsed = docs.select("doc_id", F.from_json("content", WORDS_JSON, {"mode": "FAILFAST"}).alias("j"))
    words = parsed.select("doc_id", F.posexplode("j.word_segments").alias("ord", "w"))
    text = T.strip(F.col("w.word"))
    spaced = F.raise_error(F.concat(F.lit("Invalid word segment (white space inside): "), text)).cast("string")
    known = words.where(T.not_blank(F.col("w.word")) & F.col("w.start").isNotNull() & F.col("w.end").isNotNull())
    checked = F.when(text.rlike(T.SPACE), spaced).otherwise(text)
    return order_segments(known.select("doc_id", "ord", checked.alias("text"), timing.truncated_ms(F.col("w.start")).alias("start_ms"), timing.truncated_ms(F.col("w.end")).alias("end_ms")))


def scan_recordings(docs: DataFrame) -> DataFrame:
    """``doc_id, segment_index, words`` of the repeated-run scan: a row for every element of the list, malformed ones too; words
    (``raw, start, end``) in order, ``raw`` null for unusable entries, times null unless numbers.

    A document whose schema is that of well-formed segments is read whole by ``from_json``; entries of others are looked at one by one."""
    root = F.try_parse_json("content")
    typed = docs.select("doc_id", "content", F.schema_of_variant(root).alias("kind"))
    listed = F.try_variant_get(root, "$.segments", "array<variant>")
    bad = F.raise_error(F.concat(F.lit("a scan needs a JSON object with a 'segments' list: "), F.col("doc_id").cast("string")))
    checked = F.when(F.col("kind").startswith("OBJECT") & listed.isNotNull(), listed).otherwise(bad.cast("array<variant>"))

    def entry(w):
        def number(path: str):
            is_number = F.schema_of_variant(F.try_variant_get(w, path, "variant")).rlike(f"^{NUMBER}$")
            return F.when(is_number, F.try_variant_get(w, path, "double"))

        is_text = F.schema_of_variant(F.try_variant_get(w, "$.word", "variant")) == "STRING"
        return F.struct(F.when(is_text, F.try_variant_get(w, "$.word", "string")).alias("word"), number("$.start").alias("start"), number("$.end").alias("end"))

    one_by_one = F.transform(checked, lambda s: F.struct(F.transform(F.try_variant_get(s, "$.words", "array<variant>"), entry).alias("words")))
    plain = F.from_json("content", f"segments {SEGMENTS_JSON}")["segments"]
    segments = F.when(F.col("kind").rlike(PLAIN_SCAN), plain).otherwise(one_by_one.cast(SEGMENTS_JSON))
    return typed.select("doc_id", F.posexplode(segments).alias("segment_index", "s")).select("doc_id", "segment_index", F.col("s.words").cast(RAW).alias("words"))


def parse_scan_json(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(segments, words)`` of the repeated-run scan (``scan_recordings``).

    ``segments(doc_id, segment_index)`` has every element of the list, malformed ones too; ``words`` has
    the usable entries (``doc_id, segment_index, ord, raw, start, end``), times null unless numbers.
    """
    found = scan_recordings(docs)
    words = found.select("doc_id", "segment_index", F.posexplode("words").alias("ord", "w")).where("w.raw IS NOT NULL")
    return found.select("doc_id", "segment_index"), words.select("doc_id", "segment_index", "ord", "w.raw", "w.start", "w.end")


def _parsed(docs: DataFrame, expression: str) -> DataFrame:
    return docs.select("doc_id", F.inline(F.expr(expression)))


def parse_srt(docs: DataFrame) -> DataFrame:
    """Cues of SRT texts (``cues.srt``)."""
    return _parsed(docs, cues.srt("content"))


def parse_vtt(docs: DataFrame) -> DataFrame:
    """Cues of WebVTT texts (``cues.vtt``)."""
    return _parsed(docs, cues.vtt("content"))


def parse_word_vtt(docs: DataFrame) -> DataFrame:
    """Words of VTT texts with a timestamp before each word (``cues.word_vtt``, as whole batches)."""
    return docs.select("doc_id", F.inline(word_vtt.words_udf("content")))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return parse_word_json(read_files(spark, path))


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Cues of ``.srt`` files; any other suffix is an error."""
    return parse_srt(read_files(spark, path, ".srt"))


def optional_cues(spark: SparkSession, path: str | None) -> DataFrame:
    """Reference cues, or an empty table where there are none."""
    if path is None:
        return spark.createDataFrame([], "doc_id string, ord int, text string, start_ms bigint, end_ms bigint")
    return read_subtitles(spark, path)


# --- driver-side configuration -------------------------------------------------------------------------


def read_json(path: str | Path) -> dict | None:
    """A JSON file's object; None where there is no file."""
    file = Path(path)
    return json.loads(file.read_text(encoding="utf-8")) if file.is_file() else None


def json_source(source: str | Path | dict) -> dict:
    """An object given as itself, as a path, or as JSON text."""
    if isinstance(source, dict):
        return source
    text = str(source)
    literal = isinstance(source, str) and text.lstrip()[:1] in ("{", "[")
    if isinstance(source, Path) or (not literal and Path(text).is_file()):
        text = Path(source).read_text(encoding="utf-8")
    return json.loads(text)


def load_config(path: str | Path | None) -> dict:
    """A TOML file's tables; empty without a file."""
    file = Path(path).expanduser() if path else None
    return tomllib.loads(file.read_text(encoding="utf-8")) if file and file.is_file() else {}


def config_value(config: dict, dotted: str, default=None):
    node = config
    for key in dotted.split("."):
        if not isinstance(node, dict) or key not in node:
            return default
        node = node[key]
    return node


def config_text(config: dict, dotted: str, default: str = "") -> str:
    """A string value, stripped; TypeError for another type."""
    value = config_value(config, dotted, default)
    if not isinstance(value, str):
        raise TypeError(f"{dotted} must be a string")
    return value.strip()


PROMPTS = Path(__file__).with_name("prompts")


@lru_cache(maxsize=32)
def _template(name: str) -> str:
    file = PROMPTS / f"{name}.md"
    if not file.exists():
        raise FileNotFoundError(f"no prompt {name}")
    return file.read_text(encoding="utf-8")


def prompt(name: str, **values) -> str:
    """A prompt template with ``$name`` and ``${name}`` filled in; unknown names stay."""
    return Template(_template(name)).safe_substitute(**values) if values else _template(name)


def prompt_names() -> list[str]:
    return sorted(str(f.relative_to(PROMPTS).with_suffix("")) for f in PROMPTS.rglob("*.md") if f.name != "README.md")


def find_output(folder: str | Path, stem: str, suffixes: list[str]) -> Path | None:
    """The file of a fixed stem with the first suffix of the list that exists, else the first by name."""
    named = [Path(folder) / f"{stem}{s}" for s in suffixes]
    others = sorted(Path(folder).glob(f"{stem}.*"))
    return next((p for p in named if p.is_file()), others[0] if others else None)
