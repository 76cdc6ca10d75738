import random
import zlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import language
from tests.conftest import SF001
from tests.llm import test_jaccard, test_lines, test_repeats


def rows_of():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randrange(2, 9)))
    passage = " ".join(word() for _ in range(70))
    boiler = " ".join(word() for _ in range(9))
    out, k = [], 0
    for _ in range(20):
        parts = [" ".join(word() for _ in range(30)) for _ in range(r.randrange(1, 5))]
        for _ in range(r.choice([1, 1, 3])):
            own = [p if r.random() < .8 else p + " " + word() for p in parts]
            if r.random() < .4:
                own[0] += " " + passage
            if r.random() < .4:
                own.append(boiler)
            out.append((k, "\n".join(own), r.choice(["en", "fr", None]), "s", 7))
            k += 1
    out += [(100, "12 % 3", "en", "s", 1), (101, "", None, "s", 0), (102, None, None, None, None), (103, "x" * 3000 + " y", "en", "s", 1), (None, "abc def", "en", "s", 1)]
    return out


def test_against_brute_force(spark, tmp_path):
    rows = rows_of()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ranker = language.Ranker(language.fit(docs))
    texts = {k: t for k, t, *_ in rows if k is not None and (p := ranker.predict(t))[0] != "und" and p[1] >= corpus_pipeline.LIKENESS}
    assert len(rows) - 5 <= len(texts) <= len(rows) - 4
    kept = test_lines.brute(texts)
    kept = {k: t for k, t in kept.items() if t == texts[k] or t.strip()}
    components = test_jaccard.brute(kept)
    kept = {k: t for k, t in kept.items() if components[k][1] == k}
    assert len(kept) < len(texts)
    after = {}
    for k, gone in test_repeats.brute(kept, 50).items():
        words = kept[k].encode().split()
        after[k] = [w for w, g in zip(words, gone) if not g]
    stages = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, str(tmp_path))
        assert stages.columns == docs.columns, name
        stages.write.parquet(f"{tmp_path}/{name}")
        stages = spark.read.parquet(f"{tmp_path}/{name}")
    got = {r.doc_id: r for r in stages.collect()}
    assert {k: r.text.encode().split() for k, r in got.items()} == after
    assert all(r.n_chars == len(r.text) for r in got.values())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        packed.setdefault(p.doc_id, []).append(p)
    assert packed.keys() == got.keys()
    for k, pieces in packed.items():
        ids = [*library.encode(got[k].text, add_special_tokens=False).ids, 0]
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[p.start:p.start + p.length]))
        assert sum(p.length for p in pieces) == len(ids)


def test_extra_columns_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "hello world of words", "en", "s", 3, 1.0, 2, "z"), (1, "hello world", "en", "s", 3, 1.0, 2, "z"), (2, "some other text", None, None, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double, id long, kept string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} == {1, 2}
        assert out.count() == (3 if stage is corpus_pipeline.keep_known_languages else 2)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_whole_table(spark):
    got = corpus_pipeline.run(spark, SF001)
    assert got.select("doc_id").distinct().count() > 100
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()
