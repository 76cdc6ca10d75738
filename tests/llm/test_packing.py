import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm.packing import ByteTokens, best_filling, pack, pack_documents, plan, token_pieces
from tessera.llm.common import written

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_match_library():
    library, own = Tokenizer.from_file(PATH), ByteTokens(open(PATH, encoding="utf-8").read())
    r = random.Random(3)
    texts = ["", " ", "a  b \n\n c\t", "x<|endoftext|>y", "<|", "it's we'll 12 3½", "ab " * 800_000 + " é", "\x1c\x85 a", "'s's  's"]
    texts += ["".join(r.choice("abcde  \n.,'sé12☃") for _ in range(80)) for _ in range(800)]
    texts += [r.choice(["", " ", "\n"]) + "".join(r.choice(["ab", "c.", " ", " ", "\n", "\t", "\u00a0", "x1"]) for _ in range(30)) for _ in range(800)]
    texts += ["one two.\nThree four\nfive  six", "tail \n", "\n\nhead", "a \u2028b"]
    texts += ["".join(chr(r.randrange(32, 0x3100)) for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert own.ids(t) == b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids), t[:80]


def brute_fill(room, counts):
    reach = {0}
    for size, n in counts.items():
        for _ in range(n):
            reach |= {x + size for x in reach if x + size <= room}
    return max(reach)


def test_best_filling_is_best():
    r = random.Random(1)
    for _ in range(300):
        counts = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(6)}
        room = r.randrange(0, 100)
        found = best_filling(room, sorted(counts), counts, nodes=10**6)
        assert all(c <= counts[s] for s, c in found)
        assert sum(s * c for s, c in found) == brute_fill(room, counts)


def brute_bins(items, capacity):
    """Fewest bins, by search over all assignments."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + items[i] <= capacity:
                go(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1:])
        go(i + 1, bins + [items[i]])
    go(0, [])
    return best


def test_plan_against_fewest_bins():
    r = random.Random(2)
    extra = 0
    for _ in range(60):
        items = sorted((r.randrange(1, 60) for _ in range(9)), reverse=True)
        counts = {x: items.count(x) for x in items}
        laid = plan(counts, 64)
        assert all(sum(s * c for s, c in f) <= 64 for _, f in laid)
        assert {x: sum(t * dict(f).get(x, 0) for t, f in laid) for x in counts} == counts
        extra += sum(t for t, _ in laid) - brute_bins(items, 64)
    assert extra <= 3


def check_places(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def first_fit(items, capacity=2048):
    bins = []
    for x in sorted(items, reverse=True):
        for j, b in enumerate(bins):
            if b + x <= capacity:
                bins[j] += x
                break
        else:
            bins.append(x)
    return len(bins)


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    r = random.Random(4)
    texts = {i: " ".join(r.choice(["alpha", "beta", "gamma", "zz"]) for _ in range(r.choice([0, 5, 300, 900, 5000]))) for i in range(60)}
    rows = [(i, t, "x") for i, t in texts.items()] + [(3, texts[3], "again"), (None, "abc", "y"), (100, None, "z")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string"), PATH).collect()
    texts[100] = ""
    whole = {}
    for p in sorted(got, key=lambda p: (p.id, p.piece)):
        ids = library.encode(texts[p.id], add_special_tokens=False).ids + [0]
        assert p.start == whole.get(p.id, 0)
        whole[p.id] = p.start + p.length
        assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[p.start:p.start + p.length]))
        assert p.length == 2048 or p.piece == 0
        if whole[p.id] == len(ids):
            texts.pop(p.id)
    assert not texts
    assert check_places(got) <= first_fit([p.length for p in got])
    assert token_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    assert pack(written(token_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH), "none")).count() == 0


def test_one_length_on_many_rows(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.packing.RANKED", 50)
    pieces = spark.range(2000).selectExpr("id", "0 AS piece", "cast(if(id % 3 = 0, 700, id % 90 + 1) AS int) AS length")
    rows = pack(written(pieces, "pieces")).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 2000
    assert check_places(rows) <= first_fit([r.length for r in rows])
