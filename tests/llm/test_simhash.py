import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm import simhash


def test_fingerprint_against_brute_force(spark):
    r = random.Random(1)
    texts = ["", " ", "one", "One TWO three", "a b c d e", "a b c d e f a b c d e", "é\t\nx  y z w v"] + [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (9, 50, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    hashes = dict(df.select("id", simhash.shingle_hashes(F.col("text")).alias("h")).collect())
    prints = dict(simhash.fingerprints(df, ["id"]).collect())
    for i, t in enumerate(texts):
        words = t.split()
        assert len(hashes[i]) == (0 if not words else max(1, len(words) - 4))
        grams = [tuple(w.lower() for w in words[j:j + 5]) for j in range(len(hashes[i]))]
        assert len(set(hashes[i])) == len(set(grams))
        bits = 0
        for b in range(64):
            if sum(1 if h >> b & 1 else -1 for h in hashes[i]) > 0:
                bits |= 1 << b
        assert prints[i] == simhash.signed(bits)


def test_near_pairs_against_brute_force(spark):
    r = random.Random(2)
    values = []
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(5):
            y = x
            for b in r.sample(range(64), r.randrange(7)):
                y ^= 1 << b
            values.append(simhash.signed(y))
    values += [0, -1, 1, values[0], values[0]]
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    for radius, blocks in ((3, 6), (2, 4), (0, 3)):
        got = {(x.a, x.b, x.distance) for x in simhash.near_pairs(df, radius, blocks).collect()}
        far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
        assert got == {(a, b, far(a, b)) for a in set(values) for b in set(values) if a < b and far(a, b) <= radius}
    counts = dict(simhash.near_counts(df).collect())
    assert counts == {a: sum(far(a, b) <= 3 for b in values) for a in values}


def brute_edited(texts):
    ids = sorted(texts)
    out = {}
    for i, k in enumerate(ids):
        q = len(texts[k]) // 4
        out[k] = texts[k][:len(texts[k]) - q] + texts[ids[(i + 1) % len(ids)]][:q]
    return out


def test_documents(spark):
    r = random.Random(3)
    texts = {i * 7 - 30: "".join(r.choice("ab é🙂\n") for _ in range(r.choice([0, 1, 3, 4, 50, 400]))) for i in range(80)}
    texts[1000] = texts[-30]
    rows = [(k, t, "x") for k, t in texts.items()] + [(2000, None, "y"), (None, "zz", "z"), (1000, texts[1000], "again")]
    texts[2000] = ""
    got = {x.id: x for x in simhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()}
    assert got.keys() == texts.keys()
    for k, edited in brute_edited(texts).items():
        assert got[k].n_chars == len(texts[k])
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k].near_next <= 1
    ids = sorted(texts)
    for i, k in enumerate(ids):
        nxt = got[ids[(i + 1) % len(ids)]].fingerprint
        assert got[k].near_next == 1 - ((got[k].fingerprint ^ nxt) & (1 << 64) - 1).bit_count() / 64
    assert got[1000].fingerprint == got[-30].fingerprint
    one = spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")
    assert simhash.fingerprint_documents(one).first().near_next == 1.0
    assert simhash.fingerprint_documents(one.limit(0)).count() == 0
