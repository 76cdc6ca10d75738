import random

import numpy as np
import pytest

from tessera.llm import repeats, substring, suffixes
from tessera.llm.common import gram_hashes, minimisers


def brute(texts, length):
    """Word masks of what goes, straight from the definition."""
    words = {k: t.encode().split() for k, t in texts.items()}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - length + 1):
            first.setdefault(tuple(words[k][i:i + length]), k)
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < k:
                gone[i:i + length] = [True] * length
        out[k] = gone
    return out


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "the", "É", "x y"] + [f"w{r.randrange(400)}" for _ in range(6)])
    passages = [[word() for _ in range(r.randrange(length - 2, 3 * length))] for _ in range(8)]
    out = {}
    for i in range(70):
        parts = []
        for _ in range(r.randrange(4)):
            parts += [word() for _ in range(r.randrange(length))]
            parts += r.choice(passages) if r.random() < .6 else []
        out[i * 3 - 20] = r.choice([" ", "\n", "  ", "\t "]).join(parts)
    out[500] = out[-20]
    out[501] = " ".join(["same"] * 4 * length)
    out[502] = " ".join(["same"] * 3 * length)
    out[503] = ""
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("method,length", [(substring.substring_dedup, 13), (suffixes.suffix_dedup, 50), (suffixes.suffix_dedup, 6), (substring.substring_dedup, 3)])
def test_against_brute_force(spark, method, length, seed):
    texts = corpus(seed, length)
    rows = [(k, t, i % 3) for i, (k, t) in enumerate(texts.items())] + [(900, None, 1), (None, texts[500], 1), (500, texts[500], 7), (500, texts[500] + "~", 7)]
    texts[900] = ""
    got = {r.id: r for r in method(spark.createDataFrame(rows, "doc_id long, text string, gram int"), min_words=length).collect()}
    assert got.keys() == texts.keys()
    for k, gone in brute(texts, length).items():
        words = texts[k].encode().split()
        assert (got[k].n_words, got[k].n_removed) == (len(words), sum(gone)), k
        assert got[k].kept.encode().split() == [w for w, g in zip(words, gone) if not g]
        mask = [False] * len(words)
        for s in got[k].spans:
            mask[s.first:s.end] = [True] * (s.end - s.first)
        assert mask == gone
        if not any(gone):
            assert got[k].kept == texts[k]


def test_neighbours_over_batches_and_partitions(spark):
    import pyarrow as pa
    r = random.Random(3)
    rows = sorted((r.randrange(30), 0, 0, r.randrange(4), i) for i in range(300))
    cuts = sorted(r.sample(range(300), 40))
    batches = [pa.RecordBatch.from_pylist([dict(zip(("gram", "tail", "block", "id", "place"), x)) for x in rows[a:b]],
               schema=pa.schema([(c, pa.int64()) for c in ("gram", "tail", "block", "id", "place")]))
               for a, b in zip([0, *cuts], [*cuts, 300])]
    got = sorted(x for b in suffixes.compare_neighbours(iter(batches)) for x in b.column("place").to_pylist())
    by = {}
    for head, _, _, key, _ in rows:
        by.setdefault(head, set()).add(key)
    edge = {rows[0][0], rows[-1][0]}
    assert got == sorted(x[4] for x in rows if len(by[x[0]]) > 1 or x[0] in edge)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring.substring_dedup(none).count() == 0
    assert suffixes.suffix_dedup(none).count() == 0


def test_hashes_and_minimisers():
    words = np.arange(40, dtype=np.uint64) % np.uint64(7)
    grams = gram_hashes(words, 3)
    assert len(grams) == 38 and grams[0] == grams[7] and len(set(grams.tolist())) == 7
    assert (gram_hashes(words, 3, np.array([5, 9])) == grams[[5, 9]]).all()
    assert (gram_hashes(words, np.array([3, 4]), np.array([5, 9])) == [grams[5], gram_hashes(words, 4)[9]]).all()
    at, first, runs = minimisers(grams, 5)
    assert runs.sum() == 34 and first[0] == 0
    for a, f, n in zip(at, first, runs):
        for s in range(f, f + n):
            assert grams[a] == grams[s:s + 5].min() and s <= a < s + 5
    assert not len(minimisers(grams[:4], 5)[0])


def test_one_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(1, text), (2, "x " + text[:4000])]
    got = {r.id: r for r in suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_words - got[2].n_removed <= 2
    assert repeats.cut(b"a b  c", np.array([False, True, False]))[:2] == (b"a c", 1)
