"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a slice of documents are visited in sorted order, which is the
depth-first order of their trie: a word starts from the states of the prefix that it shares
with the word before it.  A state is the last token of the prefix's encoding.  A token can
end a prefix only if it is compatible with the last token of what stands before it, that is,
if merging the two tokens' symbols gives these two tokens again; exactly one token is, so
the encoding of a prefix is its last token after the encoding of the rest, and each prefix
is worked out once.

Words without an end mark and the same words with one differ in their last symbol only, so a
word's encoding is the state of the prefixes plus one last token that carries the end mark.

Null texts count as empty (0 tokens, empty decoding); rows stay one to one, null and
repeated ids included; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import q, slices

#: words kept with their encodings from one slice to the next, and token pairs with their verdict
WORDS_KEPT = 400_000
PAIRS_KEPT = 1_000_000
#: characters of a long text handled at a time (cut at white space)
CHUNK = 1 << 20

# White space as the Unicode property has it.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for code points from 256 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and ids of a tokenizer file whose words carry an end mark."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.mark: str = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: r for r, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        steps = [x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        # "removed, inverted": the matches are the words
        pattern = steps[0]["pattern"]["Regex"].replace("[^\\s", f"[^{SPACE}")
        self.words = regex.compile(pattern).findall
        self.space = regex.compile(f"[{SPACE}]")
        self.library = Tokenizer.from_str(source)
        self.known: set[str] = set()
        letters = byte_letters()
        self.letter = {b: letters[b] for b in range(256)}
        self.longest = max(len(t) for t in self.ids)
        missing = [c for c in letters if c not in self.ids or c + self.mark not in self.ids]
        if missing:
            raise ValueError(f"vocabulary lacks bytes: {missing[:5]}")
        self.own: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.encoded: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    # -- merging, for single tokens and pairs of tokens only

    def symbols(self, token: str) -> list[str]:
        if self.mark and token.endswith(self.mark) and len(token) > len(self.mark):
            body = token[: -len(self.mark)]
            return [*body[:-1], body[-1] + self.mark]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        rank = self.rank
        while len(parts) > 1:
            ranks = [rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            lowest = min(ranks)
            if lowest == 1 << 30:
                break
            at = ranks.index(lowest)
            best = parts[at], parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == best[0] and parts[i + 1] == best[1]:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stands(self, token: str) -> bool:
        """Is the token its own encoding?"""
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = token in self.ids and self.merged(self.symbols(token)) == [token]
        return known

    def compatible(self, left: str, right: str) -> bool:
        if (left, right) in self.rank:
            return False
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
        return known

    # -- the traversal

    def last_token(self, word: str, end: int, last: list[str], mark: str = "") -> str:
        ids, first = self.ids, max(0, end - self.longest)
        for start in range(first, end):
            token = word[start:end] + mark if mark else word[start:end]
            if token in ids and self.stands(token) and (not start or self.compatible(last[start], token)):
                return token
        raise ValueError(f"no last token for {word[:end]!r}")

    def encode_words(self, words: Iterable[str]) -> None:
        """Adds the words' encodings to ``encoded`` and ``decoded``."""
        letters = self.letter
        spelled = sorted(("".join(map(letters.__getitem__, w.encode())), w) for w in words)
        last: list[str] = [""]  # last[i]: the last token of the first i symbols of the current path
        path = ""
        for word, text in spelled:
            shared, most = 0, min(len(path), len(word) - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1:]
            for end in range(shared + 1, len(word)):
                last.append(self.last_token(word, end, last))
            path = word[:-1]
            token = self.last_token(word, len(word), last, self.mark)
            found, at = [token], len(word) - (len(token) - len(self.mark))
            while at:
                found.append(last[at])
                at -= len(last[at])
            found.reverse()
            self.encoded[text] = b"".join(self.ids[t].to_bytes(4, "little") for t in found)
            self.decoded[text] = " ".join(found).encode()

    # -- texts

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # letter by letter: no final form
        return text.lower()

    def unknown(self, text: str) -> bool:
        """Has it characters that this Python's Unicode tables lack, and the library's may know?"""
        fresh = set(text) - self.known
        new = {c for c in fresh if unicodedata.category(c) == "Cn"}
        self.known |= fresh - new
        return bool(new)

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.unknown(text):
            return self.words(self.normal(text))
        normal = self.library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def segments(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(special id or none, words) in the text's order, a chunk at a time."""
        parts = self.special_split.split(text) if self.special_split and "<|" in text else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part], []
                continue
            at = 0
            while at < len(part):
                end = len(part)
                if end - at > CHUNK and (cut := self.space.search(part, at + CHUNK)):
                    end = cut.start()
                yield None, self.split(part[at:end])
                at = end + (end == at)

    def encode_texts(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        split = [list(self.segments(t)) for t in texts]
        fresh = {w for doc in split for _, words in doc for w in words}
        fresh.difference_update(self.encoded)
        if len(self.encoded) + len(fresh) > WORDS_KEPT:
            self.encoded, self.decoded = {}, {}
            fresh = {w for doc in split for _, words in doc for w in words}
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs = {}
        self.encode_words(fresh)
        ids, names = self.encoded.__getitem__, self.decoded.__getitem__
        out_ids, out_text = [], []
        for doc in split:
            out_ids.append(b"".join(b"".join(map(ids, words)) if code is None else code.to_bytes(4, "little") for code, words in doc))
            out_text.append(b" ".join(b" ".join(map(names, words)) if code is None else self.names[code].encode() for code, words in doc if words or code is not None))
        return out_ids, out_text


_LOADED: dict[int, Vocabulary] = {}


def loaded(source: str) -> Vocabulary:
    """One vocabulary per worker process."""
    key = hash(source)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(source)
    return _LOADED[key]


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens long, ids binary, decoded string) per row.

    ``ids`` holds the token ids as little-endian unsigned 32-bit integers, ``decoded`` the
    tokens' names joined by blanks, as the library writes them where a file names no decoder.
    ``tokenizer_path`` is read on the driver; its text (under 2 MB) goes to the tasks once.
    """
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(source.value)
        for part in slices(batches):
            ids, decoded = vocabulary.encode_texts(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())],
                names=["id", "n_tokens", "ids", "decoded"])

    rows = df.select(F.col(q(id_col)).alias("id"), F.coalesce(F.col(q(text_col)).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
