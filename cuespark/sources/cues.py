"""Subtitle formats as SQL expressions: a text gives the ordered array of its cues.

One expression a format serves the DataFrame readers and, as the body of a SQL table function, queries.  A text is
already one row, so its cues are split, sorted and numbered inside it without a shuffle.  Line ends are those of text
files: CRLF and CR count as LF.  Blank cues are left out; the rest are numbered by (start, end, place).
"""

from __future__ import annotations

from cuespark.functions import text as T
from cuespark.operators import sentences as S

#: What ``T.SPACE`` matches, as escapes of SQL.
SPACES = "".join(f"\\u{ord(c):04x}" for c in S.SPACES)
CUES = "ord int, text string, start_ms bigint, end_ms bigint"

# The cue formats.
SRT_TIME = r"^(\d{2}):(\d{2}):(\d{1,2})[.,](\d{3})" + f"{T.SPACE}-->{T.SPACE}" + r"(\d{2}):(\d{2}):(\d{1,2})[.,](\d{3})"
SRT_TAIL = r"(?:\\h)+$"
VTT_TIME = rf"^(?:(\d{{2}}):)?(\d{{2}}):(\d{{2}})\.(\d{{3}}){T.SPACE}*-->{T.SPACE}*(?:(\d{{2}}):)?(\d{{2}}):(\d{{2}})\.(\d{{3}})"
VTT_HEAD = "^(?:WEBVTT|NOTE|STYLE)"
VTT_TAG = r"<\d{2}:\d{2}:\d{2}\.\d{3}>|</?[a-zA-Z][^>]*>"
WORD_VTT_TIME = rf"^(\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}){T.SPACE}*-->{T.SPACE}*(\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}})"
WORD_VTT_LINE = r"\n([^\n]*?<c>[^\n]*?</c>[^\n]*)"
STAMPED_WORD = r"<(\d{2}:\d{2}:\d{2}\.\d{3})>([^<]*)"
#: A word's time, and a line end that is not LF, as Python has them (``word_vtt``).
STAMP = r"[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}"
LONE_CR = r"\r\n?"
#: What ends a line inside a block, as Python's ``splitlines`` has it.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def _re(pattern: str) -> str:
    return f"r'{pattern}'"


def _replace(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {_re(pattern)}, '{by}')"


def _strip(text: str) -> str:
    """Only the ends are looked at; a pattern would try every character."""
    return f"trim(BOTH '{SPACES}' FROM {text})"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def unified(content: str) -> str:
    """Line ends as reading a text file gives them."""
    return f"regexp_replace({content}, {_re(chr(92) + 'r' + chr(92) + 'n?')}, char(10))"


def _clocks(line: str, pattern: str, body: str) -> str:
    """``body`` with ``g`` for the eight digit groups of both times, which one match gives."""
    groups = ":".join(f"${i}" for i in range(1, 9))
    return _let("g", f"split({_replace(line, f'{pattern}(?s:.*)', groups)}, ':')", body)


def _clock(first: int) -> str:
    """Milliseconds of four digit groups from the ``first`` on; an absent one counts as zero."""
    part = [f"coalesce(try_cast(g[{first + i}] AS BIGINT), 0L)" for i in range(4)]
    return f"({part[0]} * 3600000 + {part[1]} * 60000 + {part[2]} * 1000 + {part[3]})"


def _stamp(text: str) -> str:
    """``HH:MM:SS.mmm`` to milliseconds by floating point, truncated."""
    part = [f"CAST(substring({text}, {at}, {n}) AS DOUBLE)" for at, n in ((1, 2), (4, 2), (7, 6))]
    return f"CAST({part[0]} * 3600000 + {part[1]} * 60000 + {part[2]} * 1000 AS BIGINT)"


def _ordered(cues: str) -> str:
    placed = f"transform({cues}, (c, i) -> named_struct('start_ms', c.start_ms, 'end_ms', c.end_ms, 'place', i, 'text', c.text))"
    kept = f"array_sort(filter({placed}, c -> c.text rlike {_re(T.NOT_SPACE)}))"
    return f"transform({kept}, (c, i) -> named_struct('ord', i, 'text', c.text, 'start_ms', c.start_ms, 'end_ms', c.end_ms))"


def _cue(text: str, start: str, end: str) -> str:
    return f"named_struct('text', {text}, 'start_ms', {start}, 'end_ms', {end})"


def srt(content: str) -> str:
    """A block needs three lines, the second beginning with the times; blocks are split at empty lines first, what else
    ends a line (U+2028 ...) only divides the lines of a block."""
    blocks = f"split({_strip(unified(content))}, {_re(rf'\n{T.SPACE}*\n'.replace(chr(10), chr(92) + 'n'))})"
    lines = f"transform({blocks}, b -> split({_replace('b', f'(?:{LINE_END})' + chr(92) + 'z')}, {_re(LINE_END)}))"
    timed = f"filter({lines}, l -> size(l) >= 3 AND l[1] rlike {_re(SRT_TIME)})"
    body = f"array_join(transform(slice(l, 3, size(l)), x -> {_strip(_replace('x', SRT_TAIL))}), ' ')"
    return _ordered(f"transform({timed}, l -> {_clocks('l[1]', SRT_TIME, _cue(body, _clock(0), _clock(4)))})")


def vtt(content: str) -> str:
    """Header, note and style blocks before the first other block are skipped, a block's first line with an arrow holds the
    times, inline tags are dropped."""
    blocks = f"transform(split({_strip(unified(content))}, r'\\n\\n'), b -> {_strip('b')})"
    heads = f"transform(blocks, b -> b rlike {_re(VTT_HEAD)})"
    body = _let("blocks", blocks, f"slice(blocks, coalesce(nullif(CAST(array_position({heads}, false) AS INT), 0), size(blocks) + 1), greatest(size(blocks), 1))")
    lines = f"transform({body}, b -> split(b, r'\\n'))"
    at = "CAST(array_position(transform(l, x -> contains(x, '-->')), true) AS INT)"
    rows = f"transform({lines}, l -> named_struct('time', {_strip(f'get(l, {at} - 1)')}, 'text', array_join(slice(l, {at} + 1, size(l)), ' ')))"
    timed = f"filter({rows}, x -> x.time rlike {_re(VTT_TIME)})"
    return _ordered(f"transform({timed}, x -> {_clocks('x.time', VTT_TIME, _cue(_strip(_replace('x.text', VTT_TAG)), _clock(0), _clock(4)))})")


def word_vtt(content: str) -> str:
    """Words with a timestamp before each: a word ends where the next begins, the last one with its block."""
    blocks = f"transform(split({_strip(unified(content))}, r'\\n\\n+'), b -> {_strip('b')})"
    timed = f"filter({blocks}, b -> b rlike {_re(WORD_VTT_TIME)} AND b rlike {_re(WORD_VTT_LINE)})"
    edge = [f"regexp_extract(b, {_re(WORD_VTT_TIME)}, {i})" for i in (1, 2)]
    tagged = _replace(f"regexp_extract(b, {_re(WORD_VTT_LINE)}, 1)", "</?c>")
    line = f"concat('<', {edge[0]}, '>', {tagged}, '<', {edge[1]}, '>')"
    found = _let("l", line, f"named_struct('at', regexp_extract_all(l, {_re(STAMPED_WORD)}, 1), 'word', regexp_extract_all(l, {_re(STAMPED_WORD)}, 2))")
    pair = _cue(_strip("w.word[i]"), _stamp("w.at[i]"), _stamp("w.at[i + 1]"))
    return _ordered(f"flatten(transform(transform({timed}, b -> {found}), w -> transform(sequence(0, size(w.at) - 2), i -> {pair})))")


FORMATS = {"srt": srt, "vtt": vtt, "word_vtt": word_vtt}
