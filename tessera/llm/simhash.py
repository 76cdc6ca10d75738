"""Document fingerprints: SimHash over weighted word shingles, DataFrame functions only.

Each shingle of five words (a text with fewer words is one shingle) has a 64-bit hash.  Its
occurrences are its weight; each votes +1 or -1 on the 64 bits by the bits of the hash, and
the fingerprint's bits are the signs of the sums (0 on a tie).  Votes are counted where the
text is read: a text's shingles are exploded and summed in the same task, so only 64 sums a
document are shuffled.

``near_pairs`` finds all pairs of different fingerprints within a Hamming radius: 64 bits are
cut into ``blocks``, pairs within the radius agree on ``blocks - radius`` of them at least,
so there is a table for each choice of that many blocks, keyed by their bits (the permuted
block tables).  Equal fingerprints are one entry there.

Null texts are empty; an empty text has no shingle and the fingerprint 0.  Words are runs of
characters other than ASCII white space, A-Z in lower case.  Rows with a null id are left out,
repeated ids count once with the smallest text; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import texts, written

BITS = 64
SHINGLE = 5
RADIUS = 3
BLOCKS = 6


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """array<bigint>: the hash of each run of ``size`` words, in the text's order."""
    words = F.filter(F.split(lower_ascii(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        return (F.when(n == 0, F.array().cast("array<bigint>"))
                .when(n <= size, F.array(F.xxhash64(h)))
                .otherwise(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(h, i, size)))))
    # the word hashes are bound once; every run reads them
    return F.element_at(F.transform(F.array(hashes), runs), 1)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` (that name a row) and fingerprint bigint."""
    votes = [F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"v{i}") for i in range(BITS)]
    exploded = texts.select(*keys, F.explode_outer(shingle_hashes(F.col(text))).alias("h"))
    summed = exploded.groupBy(*keys).agg(*votes)
    bits = F.lit(0).cast("bigint")
    for i in range(BITS):
        bits = bits.bitwiseOR(F.when(F.col(f"v{i}") > 0, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return summed.select(*keys, bits.alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """1: equal fingerprints, 0: all bits differ."""
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def block_masks(blocks: int) -> list[int]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b, distance): pairs a < b of different fingerprints of column ``fingerprint``
    within the radius, each once."""
    if not 0 <= radius < blocks:
        raise ValueError("radius must be less than the number of blocks")
    each = prints.select("fingerprint").distinct()
    masks = block_masks(blocks)
    tables = [signed(sum(c)) for c in combinations(masks, blocks - radius)]
    keyed = each.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m).cast("bigint")) for m in tables])).alias("t", "key"))
    left = keyed.select("t", "key", F.col("fingerprint").alias("a"))
    right = keyed.select("t", "key", F.col("fingerprint").alias("b"))
    found = left.join(right, ["t", "key"]).filter(F.col("a") < F.col("b")).withColumn("distance", distance(F.col("a"), F.col("b")))
    return found.filter(F.col("distance") <= radius).select("a", "b", "distance").distinct()


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fingerprint, n_near): how many rows have a fingerprint within the radius, its own
    included.  Rows with equal fingerprints are counted once before the tables are joined."""
    rows = prints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    pairs = near_pairs(rows, radius, blocks)
    both = pairs.select(F.col("a").alias("fingerprint"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("fingerprint"), F.col("a").alias("other")))
    others = (both.join(rows.select(F.col("fingerprint").alias("other"), F.col("n").alias("m")), "other")
              .groupBy("fingerprint").agg(F.sum("m").alias("m")))
    return rows.join(others, "fingerprint", "left").select("fingerprint", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n_near"))


def successors(docs: DataFrame) -> DataFrame:
    """(id, n, next): each id's length in code points and the next larger id (the last one's is
    the first).  Ids are range-partitioned; only each part's smallest id meets in one task."""
    ranged = written(docs.select("id", F.length("text").alias("n")).repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    within = ranged.withColumn("next", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    parts = ranged.groupBy("part").agg(F.min("id").alias("least"))
    following = parts.select("part", F.lead("least").over(Window.orderBy("part")).alias("following"))
    first = ranged.agg(F.min("id")).first()[0]
    return within.join(following, "part").select("id", "n", F.coalesce("next", "following", F.lit(first)).alias("next"))


def edited_texts(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(id, text, edited, n, next): the last quarter of each text is replaced by as much of the
    beginning of the next document."""
    quarter = F.floor(F.col("n") / 4).cast("int")
    heads = (docs.select(F.col("id").alias("next"), "text").join(links, "next")
             .select("id", "n", "next", F.expr("substring(text, 1, cast(n div 4 as int))").alias("head")))
    return docs.join(heads, "id").select("id", "text", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - quarter), F.col("head")).alias("edited"), "n", "next")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint bigint, near_edited,
    near_next double, n_near long) for every document."""
    docs = texts(df, id_col, text_col)
    both = edited_texts(docs, successors(docs))
    rows = both.select("id", "n", "next", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
                       F.explode(F.array(F.struct(F.lit(False).alias("edit"), F.col("text").alias("text")),
                                         F.struct(F.lit(True).alias("edit"), F.col("edited").alias("text")))).alias("t"))
    votes = fingerprints(rows.select("id", "n", "next", "edited_sha256", "t.edit", "t.text"), ["id", "n", "next", "edited_sha256", "edit"])
    prints = written(votes.groupBy("id", "n", "next", "edited_sha256").agg(
        F.max(F.when(~F.col("edit"), F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("edit"), F.col("fingerprint"))).alias("edited_fingerprint")), "fingerprints")
    of_next = prints.select(F.col("id").alias("next"), F.col("fingerprint").alias("next_fingerprint"))
    return (prints.join(of_next, "next").join(near_counts(prints, radius), "fingerprint")
            .select("id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "n_near"))
