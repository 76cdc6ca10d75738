"""Best-fit packing of token sequences by bin completion with branch and bound.

``token_pieces`` counts tokens and cuts documents longer than the capacity; ``pack`` places
pieces into sequences.  There are at most ``capacity`` different lengths, so the packing
problem is a table of counts by length, whatever the number of pieces: that table (and
nothing else) is gathered, fillings are searched on it, and each filling is laid out as often
as the counts allow.  A piece finds its place from its length and its rank among the pieces
of this length; ranks are counted in salted groups, so that one very frequent length is
spread over many tasks.

The search takes the largest length left, starts from its best-fit filling as incumbent and
enumerates fillings of the remaining room in descending order.  Fillings that another one
dominates (its parts replaced by one larger part that fits as well) come later and are
passed over; branches whose waste can't fall below the incumbent's are pruned; a filling
without waste ends it.  ``nodes`` bounds the search for one filling.

Null texts count as empty: one piece that holds the closing id only.  Rows with a null id
are left out, repeated ids count once (smallest text); an empty table gives no pieces.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.bpe import SPACE, byte_letters
from tessera.llm.common import slices, texts, written

CAPACITY = 2048
#: pieces of one length that one task ranks
RANKED = 100_000
WORDS_KEPT = 400_000
CHUNK = 1 << 20
#: The published pre-tokenisation pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """Ids of texts.  A line is cut at its blanks: a blank between two other characters always
    begins a token, so the ids of each part (with its blank) can be kept and joined.  Texts
    with other white space, doubled or at an edge, are cut by the pattern instead."""

    def __init__(self, source: str):
        self.library = Tokenizer.from_str(source)
        spec = json.loads(source)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = PATTERN.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]")
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        order = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        found = list(map(spec["model"]["vocab"].__getitem__, order))
        if found != sorted(found):
            raise ValueError("ids must follow the order of the merges")
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.odd = regex.compile(f"[{SPACE}]").search
        self.edge = regex.compile(f"(?<=[^{SPACE}])[{SPACE}]")
        self.newline = self.packed("\n")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.characters: set[str] = set()

    def packed(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def plain(self, text: str) -> bool:
        """Are all characters in this Python's Unicode tables?  (The library may know later ones.)"""
        if text.isascii():
            return True
        fresh = set(text) - self.characters
        new = {c for c in fresh if unicodedata.category(c) == "Cn"}
        self.characters |= fresh - new
        return not new

    def learn(self, lines: list[list[str]]) -> bool:
        """Adds the parts of lines; False if one isn't free of white space."""
        if len(self.first) + len(self.later) > WORDS_KEPT:
            self.first, self.later = {}, {}
        for line in lines:
            for known, blank, parts in ((self.first, "", line[:1]), (self.later, " ", line[1:])):
                for part in set(parts).difference(known):
                    if not part or self.odd(part):
                        return False
                    known[part] = self.packed(blank + part)
        return True

    def chunk(self, text: str) -> bytes:
        lines = [line.split(" ") for line in text.split("\n")]
        for _ in range(2):
            try:
                first, later = self.first, self.later.__getitem__
                return self.newline.join([b"".join([first[line[0]], *map(later, line[1:])]) for line in lines])
            except KeyError:
                if not self.learn(lines):
                    break
        return self.packed(text)

    def ids(self, text: str) -> bytes:
        out = []
        for segment in self.specials.split(text) if self.specials and "<|" in text else [text]:
            if segment in self.special:
                out.append(self.special[segment].to_bytes(4, "little"))
            elif not self.plain(segment):
                out.append(array("I", self.library.encode(segment, add_special_tokens=False).ids).tobytes())
            else:
                at = 0
                while at < len(segment):
                    end = len(segment)
                    if end - at > CHUNK and (cut := self.edge.search(segment, at + CHUNK)):
                        end = cut.start()
                    out.append(self.chunk(segment[at:end]))
                    at = end
        return b"".join(out)


_LOADED: dict[int, ByteTokens] = {}


def loaded(source: str) -> ByteTokens:
    key = hash(source)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteTokens(source)
    return _LOADED[key]


def token_pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, closing_id: int = 0) -> DataFrame:
    """(id, piece int, start long, length int, ids_crc32 long): each document's ids and the
    closing id; longer ones cut into full pieces, of which the first may be shorter."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    closing = closing_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(source.value)
        for part in slices(batches):
            rows: list[tuple] = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = memoryview(tokens.ids(text) + closing)
                n = len(ids) // 4
                first = n % capacity or capacity
                bounds = [0, n] if n <= capacity else [0, *range(first, n + 1, capacity)]
                rows += [(key, i, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
                zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["id", "piece", "start", "length", "ids_crc32"])

    return texts(df, id_col, text_col).mapInArrow(run, "id long, piece int, start long, length int, ids_crc32 long")


def best_filling(room: int, sizes: list[int], counts: dict[int, int], nodes: int = 20_000) -> list[tuple[int, int]]:
    """[(size, copies)] out of ascending ``sizes`` that fills ``room`` best; larger parts first."""
    def greedy(room: int, top: int) -> list[tuple[int, int]]:
        found = []
        while room and top > 0 and (top := bisect_right(sizes, room, 0, top)):
            size = sizes[top - 1]
            copies = min(counts[size], room // size)
            if copies:
                found.append((size, copies))
                room -= copies * size
            top -= 1
        return found

    best = greedy(room, len(sizes))
    least = room - sum(s * c for s, c in best)
    budget = nodes

    def search(room: int, top: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal best, least, budget
        if room < least:
            best, least = list(chosen), room
        top = bisect_right(sizes, room, 0, top)
        while top and least and budget > 0:
            size = sizes[top - 1]
            limit = min(counts[size], room // size)
            if room - limit * size >= least and top == 1:
                return  # even all of the smallest leaves more waste
            for copies in range(limit, 0, -1):
                budget -= 1
                chosen.append((size, copies))
                search(room - copies * size, top - 1, chosen)
                chosen.pop()
                if not least or budget <= 0:
                    return
            top -= 1

    if least:
        search(room, len(sizes), [])
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, copies)])]: fillings and how often each is laid out."""
    left = {k: v for k, v in counts.items() if v > 0}
    sizes = sorted(left)
    out = []
    while sizes:
        largest = sizes[-1]
        left[largest] -= 1
        inner = [s for s in sizes if left[s] > 0] if not left[largest] else sizes
        rest = best_filling(capacity - largest, inner, left)
        left[largest] += 1
        filling = dict(rest)
        filling[largest] = filling.get(largest, 0) + 1
        times = min(left[s] // c for s, c in filling.items())
        for s, c in filling.items():
            left[s] -= c * times
        out.append((times, sorted(filling.items(), reverse=True)))
        if any(not left[s] for s in filling):
            sizes = [s for s in sizes if left[s]]
    return out


def slots(fillings: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length, ascending first ranks with the place of their pieces."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, parts in fillings:
        at = 0
        for length, copies in parts:
            rank = used.get(length, 0)
            rows.append((length, rank, copies, base, at))
            used[length] = rank + times * copies
            at += length * copies
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "copies": table[:, 2], "base": table[:, 3], "at": table[:, 4]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (id, piece, length, ...; a written table, as it is read twice) with
    sequence_id long and offset long."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if counts and max(counts) > capacity:
        raise ValueError("a piece is longer than a sequence")
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    salts = max(1, -(-max(counts.values(), default=1) // RANKED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    before = (salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")))
    ranked = (salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")))
              .join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
              .select(*pieces.columns, "rank"))
    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy().astype(np.int64)
            i = np.searchsorted(t["key"], (length << 44) + rank, side="right") - 1
            within = rank - t["rank"][i]
            sequence = t["base"][i] + within // t["copies"][i]
            offset = t["at"][i] + within % t["copies"][i] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(sequence), pa.array(offset)],
                                             names=[*[f.name for f in fields], "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, closing_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    return pack(written(token_pieces(df, tokenizer_path, id_col, text_col, capacity, closing_id), "pieces"), capacity)
