"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises exactly the substrings of that text.
A document (its letters, lower-cased, words apart by one space) is parsed greedily against it: a phrase
is the longest match, the next phrase begins at the symbol that broke it.  The language that needs the
fewest phrases, each priced at log2 of its sample's length and divided by the document's length, is the
prediction.

Symbols are bytes of UTF-8, all 256.  Transitions are sparse: a state's steps lie at its base plus the symbol
in one shared array, where each slot names the state that owns it, so a step of many texts at once is a few
gathers.  Every text is parsed whole.  Long texts are cut into blocks that are parsed side by side as if a
phrase began at each; then each block is begun again in the state in which the one before it really ended,
until it meets the first parse (from there on both agree), so that blocks do not change the result.

Samples are bounded: ``sample_symbols`` for each language and ``total_symbols`` for all together, from at
most ``sample_docs`` training documents a language with the smallest id hashes.  A model takes about 20
bytes a symbol, whatever the number of languages.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing was learned;
the empty language name is a name like any other; ties go to the smaller language name; a null id counts
as held out (its CRC is null), so it is never learned from; repeated rows each get a row; columns other
than the ones named, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuespark.llm.common import discard, raw_texts, stage, text_slices, tidy

BLOCK = 512
#: ASCII bytes that are no letters become spaces: marks and digits tell no language.
_SPACED = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
FOLDS, HELD_OUT = 4, 2
OUT = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class Automaton:
    """``base[state] + symbol`` is the slot of a step; it is there if ``owner`` of the slot is the state."""

    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    first: np.ndarray  # the state after a phrase's first symbol; for symbols that the text lacks, one without steps


@dataclass
class Model:
    names: list[str]
    automata: list[Automaton]
    price: np.ndarray  # log2 of each sample's length


def normal(text: str) -> bytes:
    """Lower-cased UTF-8 of the letters, runs of ASCII marks, digits and spaces as one space."""
    return b" ".join(text.lower().encode().translate(_SPACED).split())


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The steps of each state of the automaton of all substrings; state 0 is the root."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = cur
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return steps


def laid_out(steps: list[dict[int, int]]) -> Automaton:
    """States with many steps are placed first, each at the first base from ``low`` on where all its slots are
    free; ``low`` moves on where that takes many tries.  States with one step then fill the slots that are left."""
    n_steps = sum(map(len, steps))
    used, slots, owners, targets = bytearray(2 * n_steps + 1024), [], [], []
    base = np.zeros(len(steps) + 1, np.int32)  # the last state has no steps: it owns no slot
    low, single = 256, []

    def free(at: int) -> int:
        """The first free slot from ``at`` on, with room for all symbols beyond it."""
        at = used.find(0, at)
        if at < 0 or at + 256 > len(used):
            used.extend(bytes(n_steps + 1024))
        return at if at >= 0 else free(len(used) - n_steps - 1024)

    for state in sorted(range(len(steps)), key=lambda s: -len(steps[s])):
        out = steps[state]
        if len(out) < 2:
            single += [state] * len(out)
            continue
        symbols = sorted(out)
        at, tries = free(low), 0
        while any(used[at - symbols[0] + c] for c in symbols[1:]):
            at, tries = free(at + 1), tries + 1
            low = at if tries % 64 == 0 else low
        base[state] = at - symbols[0]
        for c in symbols:
            used[at - symbols[0] + c] = 1
            slots.append(at - symbols[0] + c)
            owners.append(state)
            targets.append(out[c])
    at = 255
    for state in single:
        (symbol, to), at = *steps[state].items(), free(at + 1)
        base[state] = at - symbol
        slots.append(at)
        owners.append(state)
        targets.append(to)
    owner, target = np.full(len(used) + 256, -1, np.int32), np.zeros(len(used) + 256, np.int32)
    owner[slots], target[slots] = owners, targets
    first = np.array([steps[0].get(c, len(steps)) for c in range(256)], np.int32)
    top = int(base.max()) + 256
    return Automaton(base, owner[: top + 1], target[: top + 1], first)


def build(samples: dict[str, list[str]], sample_symbols: int = 32_768) -> Model:
    """A model from labelled texts, of which each language's first ``sample_symbols`` are used."""
    joined = {name: b" ".join(map(normal, texts))[:sample_symbols] for name, texts in sorted(samples.items())}
    joined = {name: text for name, text in joined.items() if text}
    return Model(list(joined), [laid_out(suffix_automaton(text)) for text in joined.values()], np.log2([max(2, len(t)) for t in joined.values()]))


def parsed(automaton: Automaton, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state after one more symbol, and whether a phrase began with it."""
    slot = automaton.base[state] + symbol
    new = automaton.owner[slot] != state
    return np.where(new, automaton.first[symbol], automaton.target[slot]), new


def phrase_counts(automaton: Automaton, lanes: np.ndarray, sizes: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Phrases that begin in each block.

    ``lanes`` (symbols x blocks) has the blocks by descending size; ``follows[k]`` is the block that ``k``
    continues, or -1 where it begins a text."""
    longest, n = lanes.shape
    states, begun = np.empty((longest, n), np.int32), np.zeros((longest, n), np.int32)
    state, count = automaton.first[lanes[0]], np.ones(n, np.int32)
    states[0], begun[0] = state, count
    for t in range(1, longest):
        live = int(np.searchsorted(-sizes, -t, side="left"))  # blocks longer than t
        state, new = parsed(automaton, state[:live], lanes[t, :live])
        count = count[:live] + new
        states[t, :live], begun[t, :live] = state, count
    last = np.arange(n)
    final, total = states[sizes - 1, last], begun[sizes - 1, last]
    out = total.astype(np.int64)
    redo = np.flatnonzero(follows >= 0)
    while len(redo):  # those whose predecessor ended otherwise than was thought
        lane, state, count = redo, final[follows[redo]], np.zeros(len(redo), np.int32)
        ended = []
        for t in range(longest):
            over = sizes[lane] <= t
            if over.any():  # it went through the whole block without meeting the first parse
                done = lane[over]
                out[done] = count[over]
                ended.append(done[final[done] != state[over]])
                final[done] = state[over]
                lane, state, count = lane[~over], state[~over], count[~over]
            if not len(lane):
                break
            state, new = parsed(automaton, state, lanes[t, lane])
            count = count + new
            met = states[t, lane] == state
            if met.any():
                done = lane[met]
                out[done] = count[met] + total[done] - begun[t, done]
                before = final[done]
                final[done] = states[sizes[done] - 1, done]
                ended.append(done[before != final[done]])
                lane, state, count = lane[~met], state[~met], count[~met]
        else:
            out[lane] = count
            ended.append(lane[final[lane] != state])
            final[lane] = state
        changed = np.zeros(n, bool)
        changed[np.concatenate(ended)] = True
        redo = np.flatnonzero((follows >= 0) & changed[follows])
    return out


def phrases(model: Model, texts: list[bytes]) -> np.ndarray:
    """Phrases (texts x languages) of normal texts; an empty text has none."""
    blocks = [-(-len(t) // BLOCK) for t in texts]
    owner = np.repeat(np.arange(len(texts)), blocks)
    out = np.zeros((len(texts), len(model.names)))
    if not len(owner):
        return out
    begin = np.concatenate([[True], owner[1:] != owner[:-1]])
    at = np.arange(len(owner)) - np.repeat(np.flatnonzero(begin), np.array(blocks)[np.array(blocks) > 0])
    sizes = np.minimum(np.array([len(t) for t in texts])[owner] - at * BLOCK, BLOCK)
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    follows = np.where(begin, -1, place[np.arange(len(owner)) - 1])[order]
    laid = b"".join([t.ljust(n * BLOCK, b"\0") for t, n in zip(texts, blocks, strict=True)])
    longest = int(sizes.max())
    lanes = np.ascontiguousarray(np.frombuffer(laid, np.uint8).reshape(-1, BLOCK)[order, :longest].T).astype(np.int32)
    for k, automaton in enumerate(model.automata):
        out[:, k] = np.bincount(owner[order], phrase_counts(automaton, lanes, sizes[order], follows), len(texts))
    return out


def predict(model: Model, texts: list[bytes]) -> tuple[list[str], list[float]]:
    lowered = [normal(t.decode()) for t in texts]
    lettered = [any(map(str.isalpha, t.decode())) for t in texts]
    if not model.names:
        return ["und"] * len(texts), [0.0] * len(texts)
    cost = phrases(model, lowered) * model.price / np.maximum([[len(t)] for t in lowered], 1)
    best = cost.argmin(axis=1)
    ordered = np.sort(cost, axis=1)
    second = ordered[:, 1] if cost.shape[1] > 1 else np.full(len(texts), np.inf)
    margin = np.clip(1 - ordered[:, 0] / np.maximum(second, 1e-12), 0, 1)
    return [model.names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], [float(m) if ok else 0.0 for m, ok in zip(margin, lettered, strict=True)]


def learn(docs: DataFrame, sample_docs: int = 128, sample_symbols: int = 32_768, total_symbols: int = 1 << 21) -> Model:
    """Learn from the documents of the other folds; two scans, a bounded number of symbols to the driver."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    known = docs.where((fold != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h"))
    sizes = stage(known.groupBy("lang").count())
    languages = sizes.count()
    symbols = max(1, min(sample_symbols, total_symbols // max(1, languages)))
    # about 4 x sample_docs rows of each language have a hash below this share of the hash range
    share = F.least(F.lit(1.0), F.lit(4.0 * sample_docs) / F.col("count"))
    # a few names, counted: sent to all tasks, so that the texts are filtered where they are read; else joined
    table = F.broadcast(sizes) if languages <= 10_000 else sizes
    few = known.join(table, "lang").where((F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share) | (F.col("count") <= 64 * sample_docs))
    few = few.select("lang", "h", "doc_id", F.octet_length("text").alias("size"), F.substring("text", 1, symbols).alias("text"))
    usual = F.col("size").between(200, sample_symbols // 8)
    first = W.partitionBy("lang").orderBy(F.when(usual, 0).otherwise(1), "h", "doc_id")
    ranked = few.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample_docs)
    before = W.partitionBy("lang").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    rows = ranked.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") <= 4 * symbols).select("lang", "k", "text").toArrow()
    discard(sizes)
    samples: dict[str, list[str]] = {}
    for row in sorted(rows.to_pylist(), key=lambda r: (r["lang"], r["k"])):
        samples.setdefault(row["lang"], []).append(row["text"])
    return build(samples, symbols)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; only ``doc_id`` and ``text`` are read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            names, scores = predict(sent.value, raw_texts(batch.column("text")))
            held = [i is None or zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(tidy(run), OUT)
