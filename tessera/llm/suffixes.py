"""Dedup of long passages by sampled suffixes, sorted by the hash of their heads.

Only suffixes at content-selected positions are retained: of all grams in a window of
``min_words`` words the smallest (its minimiser), so a passage that two documents share has
a retained suffix in both.  A suffix is represented by the hashes of its first two grams.
The suffixes are range-partitioned and sorted, neighbours are compared, and a suffix whose
head another document shares is extended to the left and right over whole windows.  A word
goes if a window of ``min_words`` words that covers it also starts in a document with a
smaller id.

Neighbours of the first and last heads of a partition may be in another partition; these few
suffixes are extended as well, so the cut changes no result.

Null texts have no words; ids that are null are left out, repeated ids count once with the
smallest text; texts shorter than ``min_words`` words stay as they are; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import repeats
from tessera.llm.common import OUT_ROWS, slices, texts, utf8, written

MIN_WORDS = 50
HEAD = 8


def suffixes(docs: DataFrame, length: int, head: int) -> DataFrame:
    """(gram long, tail long, block long, id long, place long) of the retained suffixes: gram is
    the hash of the suffix's head, tail that of the gram after it (0 where the text ends
    before), block and place those of the windows that chose it."""
    names, types = ["gram", "tail", "block", "id", "place"], [pa.int64()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for part in slices(batches):
            for key, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                at, heads, block, place, hashes = repeats.document_blocks(text, length, head)
                if len(at):
                    after = at + head
                    tail = np.where(after < len(hashes), hashes[np.minimum(after, len(hashes) - 1)], np.uint64(0))
                    for column, values in zip(out, (heads.view(np.int64), tail.view(np.int64), block.view(np.int64), np.full(len(at), key, np.int64), place)):
                        column.append(values)
            yield from repeats.batches_of(names, types, out, OUT_ROWS)
        yield from repeats.batches_of(names, types, out)

    return docs.select("id", "text").mapInArrow(run, "gram long, tail long, block long, id long, place long")


def compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by head: those whose head occurs in several documents, and the first
    and last heads of the partition.  Holds back one document's suffixes of one head at most."""
    keep = ["gram", "block", "id", "place"]
    held: pa.Table | None = None  # the last head's suffixes so far, all of one document
    known: int | None = None  # a head that is known to pass
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        first_of_partition = held is None and known is None
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        heads, ids = table.column("gram").to_numpy(), table.column("id").to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
        several = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
        if first_of_partition or (known is not None and heads[0] == known):
            several[0] = True
        marked = np.repeat(several, np.diff(np.append(begin, len(heads))))
        if several[-1]:
            held, known = None, heads[-1]
        else:
            held, known = table.slice(begin[-1]), None
        yield from table.filter(pa.array(marked)).select(keep).combine_chunks().to_batches()
    if held is not None:
        yield from held.select(keep).combine_chunks().to_batches()


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, head: int = HEAD) -> DataFrame:
    """(id, text, n_words, n_removed, kept, spans) for every document."""
    docs = texts(df, id_col, text_col)
    order = ["gram", "tail", "id", "place"]
    head = min(head, min_words)
    table = written(suffixes(docs, min_words, head), "suffixes")
    seeds = table.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare_neighbours, "gram long, block long, id long, place long")
    return repeats.without_repeats(docs, repeats.repeated(docs, seeds, min_words), min_words)
