"""Phrase collocations: phrases whose parts occur together far more often than by chance.

Phrases of two to ``longest`` words are counted by a multikey quicksort of suffix pointers.  A
suffix is a place in a text and the up to ``longest`` words from there to the end of its piece.

1. A first pass counts words per language, and suffixes per slot, a slot being a hash of the
   language and the leading words: of two, of three and so on.
2. A second pass sorts each slice's suffixes, sends equal ones as one with a count, and routes
   them globally by their slots of two leading words to buckets.
3. A bucket holds all suffixes of its leading words.  Its pointers are partitioned three ways
   around the middle pointer's word, all open partitions of a round side by side: the smaller
   and the greater part stay at their word, the equal part goes on to the next word, and its
   size is the count of the words passed.  A part with fewer than ``least`` suffixes holds no
   frequent phrase and is abandoned at once.
4. Where a slot holds more than a bucket's share of all suffixes, they are routed by one leading
   word more, and so on up to all words.  Buckets pass on their counts of the phrases that
   are shorter than what they are routed by, and these are added up by phrase.

Scores join the counts of a phrase's parts; products are decimals of 38 digits, the floor is
exact.  A part of a frequent phrase is frequent, so no count is missing.

Results by case: null text is the empty text, a null language ``und``; rows with a null id are
left out; an id that occurs on several rows counts once, with the smallest text; a text without
words adds nothing; equal scores go to the cut with fewer words first, ranks to the greater
count, then to the smaller phrase in byte order; an empty table gives an empty result; columns
of other names are not read.  Texts longer than a slice are cut between words, and each cut is
followed by the words that its last suffixes need.

The driver gets one number (characters in all) and the list of the slots above, of which there
are at most one for each bucket and number of words, and MOST_SLOTS of each, whatever the data.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import OUT_ROWS, mix, one_row_per_id, q, written
from tessera.operators.topk import top_k_per_group

#: characters of text whose suffixes make one bucket, and slots in a bucket
BUCKET_CHARS, SLOTS = 4 << 20, 16
#: the share of all suffixes above which a slot is routed by a word more is at least 1 in this
MOST_SLOTS = 4_000_000
#: bytes of text handled at a time
SLICE = 2 << 20

# Bytes that separate words, bytes that end a piece, and A-Z in lower case.
BLANK, BREAK = b"\x20\x09", b".,;:!?\x0A\x0B\x0C\x0D"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANK)] = 1
KIND[list(BREAK)] = 2
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEPARATOR = re.compile(b"[" + re.escape(BLANK + BREAK) + b"]")


@lru_cache
def following(words: int) -> re.Pattern[bytes]:
    """So many words and what stands before them."""
    own = re.escape(BLANK + BREAK)
    return re.compile(b"(?:[%b]+[^%b]+){0,%d}" % (own, own, words))


class Words:
    """The words of a run of text: numbers into ``names``, and the piece that each is in."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.translate(LOWER), np.uint8)
        kind = KIND[raw]
        inside = np.concatenate(([False], kind == 0, [False]))
        change = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = change[::2], change[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        lengths = self.ends - self.starts
        offsets = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(lengths, out=offsets[1:])
        self.letters = raw[kind == 0]
        names = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(self.letters)]).dictionary_encode()
        self.ids = names.indices.to_numpy().astype(np.int64)
        self.names: pa.Array = names.dictionary

    def __len__(self) -> int:
        return len(self.ids)

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.names.to_pylist()), np.uint64, len(self.names))

    def suffixes(self, own: int, longest: int) -> np.ndarray:
        """Row j: for each of the first ``own`` words the number plus 1 of the j-th word from it, 0 beyond the piece."""
        ids = np.concatenate([self.ids + 1, np.zeros(longest, np.int64)])
        piece = np.concatenate([self.piece, np.full(longest, -1, np.int32)])
        out = np.zeros((longest, own), np.int64)
        for j in range(longest):
            out[j] = np.where(piece[j:j + own] == piece[:own], ids[j:j + own], 0)
        return out


def distinct(columns: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each different suffix in sorted order, how many are equal to it)."""
    bits = max(1, int(top).bit_length())
    per = max(1, 63 // bits)
    keys = []
    for start in range(0, len(columns), per):
        key = np.zeros(columns.shape[1], np.int64)
        for column in columns[start:start + per]:
            key = (key << bits) | column
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def windows(data: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, up to where words count here): whole data, or cuts of about SLICE bytes between words."""
    start = 0
    while len(data) - start > 2 * SLICE and (cut := SEPARATOR.search(data, start + SLICE)):
        end = following(longest).match(data, cut.start()).end()
        yield data[start:end], cut.start() - start
        start = cut.start()
    yield data[start:], len(data) - start


def runs(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[str, Words, int]]:
    """(language, words, how many of them are counted here) of (lang, text) rows."""
    def of(lang: str, data: bytes) -> Iterator[tuple[str, Words, int]]:
        for part, end in windows(data, longest):
            words = Words(part)
            if own := int(np.searchsorted(words.starts, end)):
                yield lang, words, own

    for batch in batches:
        pending: dict[str, list[bytes]] = {}
        sizes: Counter[str] = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string()).cast(pa.large_binary())):
            data = text.as_py()
            if sizes[lang] + len(data) > SLICE and pending.get(lang):
                yield from of(lang, b"\n".join(pending.pop(lang)))
                sizes[lang] = 0
            pending.setdefault(lang, []).append(data)
            sizes[lang] += len(data)
        for lang, parts in pending.items():
            yield from of(lang, b"\n".join(parts))


def slots_of(lang: str, leading: np.ndarray, hashes: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """The slots of suffixes by their first two words, by three, and so on; row j of ``leading`` has the
    numbers plus 1 of their j-th words, 0 for none."""
    hashes = np.concatenate([np.zeros(1, np.uint64), hashes])
    passed = mix(hashes[leading[0]] + np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
    for words, column in enumerate(leading[1:]):
        passed = mix(passed + hashes[column])
        yield (passed % np.uint64(slots)).astype(np.int64) + words * slots


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some, at = np.unique(keys, return_inverse=True)
    return some, np.bincount(at, counts, len(some)).astype(np.int64)


def first_pass(docs: DataFrame, longest: int, slots: int) -> DataFrame:
    """(lang, word binary, slot, n): occurrences of words (slot null) and suffixes of slots (word null)."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("slot", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], []

        def words_held() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])

        def given() -> Iterator[pa.RecordBatch]:
            table = words_held() if held else pa.table({"lang": [], "word": [], "n": []})
            n = table.num_rows
            yield from pa.table([table["lang"].cast(pa.string()), table["word"].cast(pa.binary()), pa.nulls(n, pa.int64()), table["n"].cast(pa.int64())], schema=schema).to_batches()
            if cells:
                slot, n = summed(np.concatenate([c[0] for c in cells]), np.concatenate([c[1] for c in cells]))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(slot), pa.string()), pa.nulls(len(slot), pa.binary()), pa.array(slot), pa.array(n)], schema=schema)
            held.clear()
            cells.clear()

        for lang, words, own in runs(batches, longest):
            count = np.bincount(words.ids[:own], minlength=len(words.names))
            held.append(pa.table({"lang": pa.repeat(lang, len(count)), "word": words.names, "n": count}).filter(pa.array(count > 0)))
            leading = words.suffixes(own, longest - 1)
            leading = leading[:, leading[1] > 0] if longest > 2 else leading[:, :0]
            for slot in slots_of(lang, leading, words.hashes(), slots):
                cells.append(np.unique(slot, return_counts=True))
            if sum(t.num_rows for t in held) + sum(len(c[0]) for c in cells) > 4 * OUT_ROWS:
                held[:] = [words_held()] if held else []
                cells[:] = [summed(np.concatenate([c[0] for c in cells]), np.concatenate([c[1] for c in cells]))]
                if held[0].num_rows + len(cells[0][0]) > 2 * OUT_ROWS:
                    yield from given()
        yield from given()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word binary, slot bigint, n bigint").groupBy("lang", "word", "slot").agg(F.sum("n").alias("n"))


def routed(docs: DataFrame, longest: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """(bucket, lang, size, suffixes, counts): a slice's different suffixes of a bucket, one a line,
    and how often each occurs.  The first ``buckets`` buckets are of slots of two words, and so on."""
    names = ["bucket", "lang", "size", "suffixes", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, own in runs(batches, longest):
            columns = words.suffixes(own, longest)
            some = np.flatnonzero(columns[1])
            if not len(some):
                continue
            place, count = distinct(columns[:, some], len(words.names))
            at = some[place]
            leading = columns[:, at]
            level, bucket = np.full(len(at), 2), np.empty(len(at), np.int64)
            for by, slot in enumerate(slots_of(lang, leading, words.hashes(), buckets * SLOTS), 2):
                here = level == by
                bucket[here] = slot[here] // SLOTS
                level[here & np.isin(slot, hot)] += 1
            order = np.argsort(bucket, kind="stable")
            at, count, bucket = at[order], count[order], bucket[order]
            # the words one after the other with a space behind each; a suffix is a stretch of that
            lengths = words.ends - words.starts
            behind = np.cumsum(lengths + 1)
            line = np.full(behind[-1], 32, np.uint8)
            line[np.arange(lengths.sum()) + np.repeat(np.arange(len(lengths)), lengths)] = words.letters
            begin = behind[at] - lengths[at] - 1
            end = behind[at + (columns[:, at] > 0).sum(axis=0) - 1]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            last = np.append(first[1:], len(bucket))
            sizes, blobs, counts = [], [], []
            for low, high in zip(first.tolist(), last.tolist()):
                long = end[low:high] - begin[low:high]
                ends = np.cumsum(long)
                text = line[np.arange(ends[-1]) + np.repeat(begin[low:high] - ends + long, long)]
                text[ends - 1] = 10
                sizes.append(len(text))
                blobs.append(pa.compress(text.tobytes(), codec="zstd", asbytes=True))
                counts.append(pa.compress(count[low:high].astype("<u4").tobytes(), codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.repeat(lang, len(first)), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], names=names)

    return docs.select("lang", "text").mapInArrow(run, "bucket bigint, lang string, size bigint, suffixes binary, counts binary")


def frequent_prefixes(words: np.ndarray, weights: np.ndarray, group: np.ndarray, least: int, level: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, number of words, count) for every prefix of two or more words with ``least`` suffixes
    within its group, one of them named; words[j] holds the j-th word of every suffix, 0 for none.
    Of prefixes with fewer than ``level`` words every one is given, as others count them as well.

    Multikey three-way quicksort of the pointers to the suffixes, all partitions side by side.
    """
    longest = len(words)
    pointers = np.argsort(group, kind="stable")
    sizes = np.unique(group, return_counts=True)[1]
    depth = np.zeros(len(sizes), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(pointers):
        starts = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(sizes)), sizes)
        key = words[depth[part], pointers]
        against = key - key[starts + sizes // 2][part]
        # places after a stable partition into smaller, equal and greater
        kinds = part * 3 + np.sign(against) + 1
        parts = np.bincount(kinds, minlength=3 * len(sizes))
        offsets = np.cumsum(parts) - parts
        to = np.empty(len(pointers), np.int64)
        for kind in range(3):
            own = np.flatnonzero(np.sign(against) + 1 == kind)
            own_parts = parts[kind::3]
            before = np.cumsum(own_parts) - own_parts
            to[own] = np.arange(len(own)) - before[part[own]] + offsets[kinds[own]]
        moved = np.empty_like(pointers)
        moved[to] = pointers
        pointers = moved
        total = np.concatenate(([0], np.cumsum(weights[pointers])))
        some = np.flatnonzero(parts)
        begin, sizes = offsets[some], parts[some]
        weight = total[begin + sizes] - total[begin]
        equal = some % 3 == 1
        depth = depth[some // 3] + equal
        word = words[depth - 1, pointers[begin]]
        ends = equal & (word == 0)
        frequent = weight >= least
        report = equal & ~ends & (depth >= 2) & (frequent | (depth < level))
        found.append((pointers[begin[report]], depth[report], weight[report]))
        stays = ~ends & (depth < longest) & (frequent | (np.maximum(depth, 1) < level - 1))
        if level > 2:  # single suffixes: all their prefixes at once
            alone = stays & (sizes == 1)
            at, d, w = pointers[begin[alone]], depth[alone], weight[alone]
            for more in range(2, longest + 1):
                good = (d < more) & (words[more - 1, at] > 0) & ((w >= least) | (more < level))
                found.append((at[good], np.full(good.sum(), more), w[good]))
            stays &= ~alone
        pointers = pointers[np.repeat(stays, sizes)]
        sizes, depth = sizes[stays], depth[stays]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


PHRASES = "lang string, phrase string, n_words int, n bigint, whole boolean"


def count_bucket(longest: int, buckets: int, least: int):
    """Counts the phrases of a bucket from its rows of ``routed``."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        level = key[0].as_py() // buckets + 2
        langs = sorted(set(table["lang"].to_pylist()))
        number = {x: i for i, x in enumerate(langs)}
        blobs, weights, of = [], [], []
        for lang, size, blob, counts in zip(table["lang"].to_pylist(), table["size"].to_pylist(), table["suffixes"], table["counts"]):
            blobs.append(pa.decompress(blob.as_buffer(), size, "zstd", asbytes=True))
            n = blobs[-1].count(b"\n")
            weights.append(np.frombuffer(pa.decompress(counts.as_buffer(), 4 * n, "zstd", asbytes=True), "<u4"))
            of.append(np.full(n, number[lang], np.int32))
        text = np.frombuffer(b"".join(blobs), np.uint8)
        weights, of = np.concatenate(weights).astype(np.int64), np.concatenate(of)
        separator = (text == 32) | (text == 10)
        ends = np.flatnonzero(separator)
        lengths = np.diff(ends, prepend=-1) - 1
        last = np.flatnonzero(text[ends] == 10)  # of each suffix its last word
        first = np.concatenate(([0], last[:-1] + 1))
        offsets = np.zeros(len(ends) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        names = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(text[~separator])]).dictionary_encode()
        ids = names.indices.to_numpy()
        words = np.zeros((longest, len(first)), np.int32)
        for j in range(longest):
            has = first + j <= last
            words[j, has] = ids[(first + j)[has]] + 1
        at, many, count = frequent_prefixes(words, weights, of, least, level)
        begin, end = ends[first[at]] - lengths[first[at]], ends[first[at] + many - 1]
        phrases = [text[a:b].tobytes().decode() for a, b in zip(begin.tolist(), end.tolist())]
        return pa.table({"lang": pa.array([langs[i] for i in of[at].tolist()], pa.string()), "phrase": pa.array(phrases, pa.string()), "n_words": pa.array(many, pa.int32()),
                         "n": pa.array(count, pa.int64()), "whole": pa.array(many >= level)})
    return run


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words, and (lang, phrase, n_words, n) of the phrases of 1 to ``longest`` words
    that occur ``least`` times; ``docs``: (lang, text)."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(chars // BUCKET_CHARS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = written(first_pass(docs, longest, buckets * SLOTS), "words")
    words = first.filter("slot is null").select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("n_words"), "n")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    slots = first.filter("slot is not null")
    total = (slots.agg(F.sum("n")).first()[0] or 0) / max(1, longest - 2)
    over = max(total / buckets, total / MOST_SLOTS, least)  # suffixes of each number of words
    hot = np.array([r.slot for r in slots.filter(F.col("n") > over).select("slot").collect()], np.int64)  # at most total / over for each
    counted = written(routed(docs, longest, buckets, hot).groupBy("bucket").applyInArrow(count_bucket(longest, buckets, least), PHRASES), "phrases")
    parts = counted.filter("not whole").groupBy("lang", "phrase", "n_words").agg(F.sum("n").alias("n"))
    phrases = counted.filter("whole").drop("whole").unionByName(parts).unionByName(words)
    return totals, written(phrases.filter(F.col("n") >= least), "frequent")


def scored(totals: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of two or more words, at its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = (phrases.filter("n_words > 1").select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
                    F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest")))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = both.withColumn("up", (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(19,0)") * wide("n")).withColumn("down", wide("l") * wide("r"))
    score = score.withColumn("score", F.expr("up div down"))
    best = F.min_by(F.struct("l", "r", "n", "score"), F.struct("score", "k")).alias("b")
    return score.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "b.l", "b.r", "b.n", "b.score")


def not_inside(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """Without the phrases that occur only inside a longer one.

    If a longer phrase occurs as often, so does the one with one word more that lies between them.
    """
    longer = phrases.filter("n_words > 2").withColumn("words", F.split("phrase", " "))
    parts = F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))
    inside = (longer.select("lang", F.explode(F.transform(parts, lambda x: F.array_join(x, " "))).alias("phrase"), F.col("n").alias("m"))
              .groupBy("lang", "phrase").agg(F.max("m").alias("m")))
    return found.join(inside, ["lang", "phrase"], "left").filter("m is null or m < a").drop("m")


def collocations(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score."""
    docs = one_row_per_id(df.select(*[F.col(q(c)) for c in dict.fromkeys([id_col, text_col, lang_col])]), id_col, text_col)
    docs = docs.select(F.coalesce(F.col(q(lang_col)).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(q(text_col)).cast("string"), F.lit("")).alias("text"))
    totals, phrases = frequent_phrases(docs, least, longest)
    found = written(not_inside(scored(totals, phrases), phrases), "scored")
    ranked = top_k_per_group(found, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], top, rows_per_group="auto", salt_cols=["lang", "phrase"])
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
