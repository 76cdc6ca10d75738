"""Shared steps of the two operators that remove repeated passages.

A passage is looked for by its windows of ``length`` words.  Each window chooses the smallest
of its grams (a minimiser), so equal windows choose equal grams, and every repeat of
``length`` words or more holds a chosen gram in common.  The operators differ in how they
find the chosen grams that occur in several documents (*seeds*): a winnowed join or a sorted
sparse suffix array.

From there both extend the seeds to the left and right.  The windows that chose a seed are a
block, and blocks are compared whole: a block that a document with a smaller id has as well
repeats with all its windows.  Where one seed has different blocks (a passage begins or ends
there), the first document of each block compares the single windows.  A word goes if a
window that covers it also starts in a document with a smaller id; runs of such windows are
the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import OUT_ROWS, gram_hashes, minimisers, slices, utf8, written

#: a block's place: its first window, and in this many lower bits how many windows it has
PLACE = 16


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words (runs of bytes other than ASCII white space)."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def batches_of(names: list[str], types: list[pa.DataType], columns: list[list[np.ndarray]], least: int = 0) -> Iterator[pa.RecordBatch]:
    """One batch of the gathered arrays if they hold more than ``least`` rows; empties them."""
    if columns[0] and sum(map(len, columns[0])) > least:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(columns, types)], names=names)
        for c in columns:
            c.clear()


def document_grams(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram long): the different minimisers of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[]]
        for part in slices(batches):
            for text in utf8(part.column(0)):
                hashes = gram_hashes(word_hashes(text), gram)
                out[0].append(np.unique(hashes[minimisers(hashes, length - gram + 1)[0]]).view(np.int64))
            yield from batches_of(["gram"], [pa.int64()], out, OUT_ROWS)
        yield from batches_of(["gram"], [pa.int64()], out)

    return docs.select("text").mapInArrow(run, "gram long")


def document_blocks(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each minimiser: its position, hash, the hash of its block (all words of the windows
    that chose it) and its place; and the hashes of all grams."""
    words = word_hashes(text)
    hashes = gram_hashes(words, gram)
    at, first, runs = minimisers(hashes, length - gram + 1)
    return at, hashes[at], gram_hashes(words, runs + (length - 1), first), (first << PLACE) + runs, hashes


def chosen_grams(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram long, block long, id long, place long): the minimisers of each document."""
    names, types = ["gram", "block", "id", "place"], [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for part in slices(batches):
            for key, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                at, grams, block, place, _ = document_blocks(text, length, gram)
                for column, values in zip(out, (grams.view(np.int64), block.view(np.int64), np.full(len(at), key, np.int64), place)):
                    column.append(values)
            yield from batches_of(names, types, out, OUT_ROWS)
        yield from batches_of(names, types, out)

    return docs.select("id", "text").mapInArrow(run, "gram long, block long, id long, place long")


def lists(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's list begins and ends, and the values of the lists' fields (or of the lists)."""
    marks = part.column(column)
    fields = [marks.values.field(i) for i in range(marks.values.type.num_fields)] or [marks.values]
    return marks.offsets.to_numpy(), [f.to_numpy(zero_copy_only=False).astype(np.int64) if len(f) else np.empty(0, np.int64) for f in fields]


def windows(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """(window long, id long, first int) of the single windows of ``marks`` (id, place)."""
    names, types = ["window", "id", "first"], [pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], []]
        for part in slices(batches):
            offsets, (place,) = lists(part, 2)
            for i, (key, text) in enumerate(zip(part.column(0).to_pylist(), utf8(part.column(1)))):
                first, runs = unpacked(place[offsets[i]:offsets[i + 1]])
                starts = np.repeat(first, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
                out[0].append(gram_hashes(word_hashes(text), length, starts).view(np.int64))
                out[1].append(np.full(len(starts), key, np.int64))
                out[2].append(starts)
                if i % 64 == 0:
                    yield from batches_of(names, types, out, OUT_ROWS)
        yield from batches_of(names, types, out)

    marked = docs.join(listed(marks), "id").select("id", "text", "marks")
    return marked.mapInArrow(run, "window long, id long, first int")


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows."""
    return place >> PLACE, place & ((1 << PLACE) - 1)


def listed(marks: DataFrame) -> DataFrame:
    """(id, marks array<long>): a document's marks are no more than its words."""
    return marks.groupBy("id").agg(F.collect_list("place").alias("marks"))


def repeated(docs: DataFrame, seeds: DataFrame, length: int) -> DataFrame:
    """(id, marks): the places of windows that also start in a document with a smaller id;
    ``seeds`` as ``chosen_grams`` has them.  First documents are pre-aggregated minima, so a
    passage that very many documents share costs each task one row."""
    seeds = written(seeds, "seeds")
    firsts = seeds.groupBy("gram", "block").agg(F.min("id").alias("lo"))
    compared = written(seeds.join(firsts, ["gram", "block"]), "compared")
    whole = compared.filter("id > lo").select("id", "place")
    first = compared.filter("id = lo")
    differ = first.groupBy("gram").agg(F.min("block").alias("b0"), F.max("block").alias("b1")).filter("b0 < b1").select("gram")
    single = windows(docs, first.join(differ, "gram", "left_semi").select("id", "place"), length)
    earlier = single.groupBy("window").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("window", "lo")
    parts = single.join(earlier, "window").filter("id > lo").select("id", (F.shiftleft(F.col("first").cast("long"), PLACE) + 1).alias("place"))
    return listed(whole.unionByName(parts))


def covered(first: np.ndarray, runs: np.ndarray, length: int, n: int) -> np.ndarray:
    """By word: is it in one of the windows?"""
    step = np.bincount(first, minlength=n + 1) - np.bincount(np.minimum(first + runs + (length - 1), n), minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where the words begin and end."""
    codes = np.frombuffer(text, np.uint8)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    return edge[::2], edge[1::2]


def cut(text: bytes, gone: np.ndarray) -> tuple[bytes, int, list[tuple[int, int]]]:
    """The text without the words that go (and the white space after them), the removed
    words' number and their spans [first, end) in words."""
    change = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    spans = list(zip(change[::2].tolist(), change[1::2].tolist()))
    if not spans:
        return text, 0, []
    begin, _ = word_spans(text)
    begin = np.append(begin, len(text))
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:begin[a]])
        at = int(begin[b])
    out.append(text[at:])
    return b"".join(out), int(gone.sum()), spans


def without_repeats(docs: DataFrame, removals: DataFrame, length: int) -> DataFrame:
    """(id, text, n_words long, n_removed long, kept string, spans array of (first, end)) for
    every document: ``kept`` is the text without the words that repeat."""
    joined = docs.join(removals, "id", "left").select("id", "text", F.coalesce("marks", F.array().cast("array<bigint>")).alias("marks"))
    span = pa.struct([("first", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, (place,) = lists(part, 2)
            rows: list[tuple] = []
            for i, text in enumerate(utf8(part.column(1))):
                n, a, b = len(text.split()), offsets[i], offsets[i + 1]
                rows.append((n, *cut(text, covered(*unpacked(place[a:b]), length, n))) if b > a else (n, text, 0, []))
            n, kept, removed, spans = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(span))],
                names=["id", "text", "n_words", "n_removed", "kept", "spans"])

    return joined.mapInArrow(run, "id long, text string, n_words long, n_removed long, kept string, spans array<struct<first: int, end: int>>")
