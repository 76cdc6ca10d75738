import random
import re
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import collocations as c


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", low)]


def brute(rows, least, longest, top):
    """{(lang, rank): row} from the definition, in Python integers."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for words in pieces(text):
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    out = defaultdict(list)
    candidates = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    for (lang, words), a in candidates.items():
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min(cuts)
        inside = any(x[0] == lang and len(x[1]) > len(words) and 100 * b >= 100 * a and any(x[1][i:i + len(words)] == words for i in range(len(x[1]))) for x, b in candidates.items())
        if not inside:
            phrase = " ".join(words)
            out[lang].append((-score, -a, phrase.encode(), phrase, a, l, r, n[lang], score))
    return {(lang, i): x[3:] for lang, rows in out.items() for i, x in enumerate(sorted(rows)[:top], 1)}


def made(r, n):
    vocabulary = ["a", "B", "the", "é", "日本", "x\x00y", "co-op", "\x1f"] + [f"w{i}" for i in range(12)]
    seps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b"]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(vocabulary) + r.choice(seps) for _ in range(r.randrange(30)))
        if r.random() < .3:
            text += "Once upon a time " * r.randrange(6)
        rows.append((r.choice(["en", "en", "en", "fr", None, "und"]), r.choice([text, text, text, "", None])))
    return rows


def test_against_brute_force(spark):
    r = random.Random(3)
    for least, longest, top in ((3, 5, 2000), (2, 3, 10)):
        rows = made(r, 150)
        data = [(i, t, lang, "p", 1) for i, (lang, t) in enumerate(rows)]
        data += [(None, "once upon a time " * 50, "en", "p", 1), (0, "￿ larger text", "en", "p", 1)]  # a null id; an id twice
        rows[0] = min((("en", "￿ larger text"), rows[0]), key=lambda x: x[1] or "")
        frame = spark.createDataFrame(data, "doc_id long, text string, lang string, phrase string, n long").repartition(5)
        got = {(x.lang, x["rank"]): (x.phrase, x.a, x.l, x.r, x.n, x.score) for x in c.collocations(frame, least=least, longest=longest, top=top).collect()}
        assert got == brute(rows, least, longest, top)
        assert c.collocations(frame.limit(0)).count() == 0 and len(got) > 20


def test_hot_word_pair(spark):
    """One pair leads most suffixes, with ever other words behind it."""
    r = random.Random(5)
    rows = [("en", " ".join(f"new york {r.choice('abcdefgh')} {r.choice('xyz')}" for _ in range(20))) for _ in range(40)]
    frame = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {(x.lang, x["rank"]): (x.phrase, x.a, x.l, x.r, x.n, x.score) for x in c.collocations(frame, least=4).collect()}
    assert got == brute(rows, 4, 5, 2000)


def test_quicksort_counts():
    r = np.random.default_rng(1)
    for _ in range(60):
        n, longest = int(r.integers(1, 200)), int(r.integers(2, 6))
        lengths = r.integers(2, longest + 1, n)
        words = r.integers(1, r.integers(2, 9), (longest, n))
        words[np.arange(longest)[:, None] >= lengths] = 0
        weights, group, least = r.integers(1, 5, n), r.integers(0, 3, n), int(r.integers(1, 12))
        want = Counter()
        for i in range(n):
            for k in range(2, lengths[i] + 1):
                want[group[i], tuple(words[:k, i])] += int(weights[i])
        for level in range(2, longest + 1):
            at, many, count = c.frequent_prefixes(words, weights, group, least, level)
            got = [((group[i], tuple(words[:k, i])), int(x)) for i, k, x in zip(at, many, count)]
            assert len(got) == len(dict(got)) and dict(got) == {p: x for p, x in want.items() if x >= least or len(p[1]) < level}


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(c, "SLICE", 40)
    r = random.Random(9)
    for _ in range(50):
        text = "".join(r.choice(["a", "bb", "é" * 30, "w" * 100, "x1"]) + r.choice([" ", "  ", ".", ",\n", "\t"]) for _ in range(r.randrange(60)))
        got, want = Counter(), Counter()
        for part, end in c.windows(text.encode(), 4):
            words = c.Words(part)
            own = int(np.searchsorted(words.starts, end))
            names = words.names.to_pylist()
            for column in words.suffixes(own, 4).T:
                got[tuple(names[w - 1].decode() for w in column if w)] += 1
        for words in pieces(text):
            for i in range(len(words)):
                want[tuple(words[i:i + 4])] += 1
        assert got == want


def test_very_long_text(spark):
    text = "one two three four five six " * 400_000 + "y" * 3_000_000
    got = {x.phrase: x.a for x in c.collocations(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).collect()}
    assert got["one two three four five"] == 400_000 and got["six one two three four"] == 399_999
