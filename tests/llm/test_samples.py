"""Samples that models are made of are drawn from whole texts."""

import random

from discloom.llm import classify, lang_id
from pyspark.sql import functions as F


def _words(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choices("abcdefghij" if seed % 2 else "klmnopqrst", k=6)) for _ in range(n)]


def test_dictionaries_hold_more_than_openings(spark):
    menu = " ".join(_words(5, 60) + _words(6, 800))  # over SAMPLE_CHARS, alike in both languages
    rnd, own = random.Random(1), {"aa": _words(1, 300), "bb": _words(2, 300)}
    body = lambda lang, n: " ".join(rnd.choices(own[lang], k=n))
    rows = [(k, lang, f"{menu} {body(lang, 1500)}") for k, lang in enumerate(["aa", "bb"] * 40)]
    made = lang_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert all(sum(w.encode() in made[lang] for w in own[lang]) > 250 for lang in own)
    judges = lang_id._compressors(made)
    assert all(lang_id.classify(body(lang, 60), judges)[0] == lang for lang in own for _ in range(10))


def test_short_texts_fill_a_dictionary(spark):
    rnd, own = random.Random(2), {"aa": _words(1, 300), "bb": _words(2, 300)}
    rows = [(k, lang, " ".join(rnd.choices(own[lang], k=6))) for k, lang in enumerate(["aa", "bb"] * 6000)]
    made = lang_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert all(100 << 10 < len(d) <= lang_id.DICT_BYTES for d in made.values())


def test_a_share_is_spread_over_its_text():
    t = bytes(range(256)) * 20
    assert lang_id._spread(t, 6000) == t and len(lang_id._spread(t, 700)) <= 702
    assert lang_id._dictionary([b"x" * 50, b"y" * (200 << 10)]).count(b"y") > 120 << 10


def test_sample_is_full_and_long_texts_give_all_their_parts(spark):
    rows = [(k, " ".join(f"w{k}p{n // 400}" for n in range(4000))) for k in range(200)] + [(k, "short text") for k in range(200, 212)] + [(212, " \n"), (213, None)]
    labels = [(k, k % 2) for k in range(600)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = classify.labelled_sample(docs, known, "toxic", 1, F.lit(True), (30, 50))
    assert [sum(y == v for _, y in got) for v in (1, 0)] == [30, 50]
    long = [t for t, _ in got if len(t) > 100]
    assert len(long) > 40 and all(len(t) <= classify.SAMPLE_CHARS + classify.WINDOWS for t in long)
    assert all(len({w.split(b"p")[1] for w in t.split()}) >= 8 for t in long)
    assert len(classify.labelled_sample(docs, known, "toxic", 1, F.lit(True))) == 212
