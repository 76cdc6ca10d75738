"""Substring dedup by seed and extend.

Anchors are winnowed word grams: of each run of consecutive grams that fits into a passage
of ``min_words`` words the smallest, so that documents with a common passage have a common
anchor in it.  Documents are joined on their anchors (an anchor of one document only drops
out after a pre-aggregated count), the anchors that match are extended both
ways to whole passages, and what is covered by passages of ``min_words`` words or more that
also start in a document with a smaller id goes.  Passages are judged on the input.

Null texts have no words; ids that are null are left out, repeated ids count once with the
smallest text; texts shorter than ``min_words`` words stay as they are; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.llm import repeats
from tessera.llm.common import texts

MIN_WORDS = 13
ANCHOR = 5


def anchors_in_several(docs: DataFrame, min_words: int, anchor: int) -> DataFrame:
    """The occurrences of anchors that more than one document holds."""
    shared = repeats.document_grams(docs, min_words, anchor).groupBy("gram").count().filter("count > 1").select("gram")
    return repeats.chosen_grams(docs, min_words, anchor).join(shared, "gram", "left_semi")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(id, text, n_words, n_removed, kept, spans) for every document."""
    docs = texts(df, id_col, text_col)
    anchor = min(anchor, min_words)
    seeds = anchors_in_several(docs, min_words, anchor)
    return repeats.without_repeats(docs, repeats.repeated(docs, seeds, min_words), min_words)
