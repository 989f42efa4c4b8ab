"""Held-out accuracy and edge cases of the trained operators."""

import functools
import random
import re
import unicodedata

import numpy as np
import zstandard

from discloom.llm import lang_id, subword
from discloom.llm.lang_id import identify, identify_languages
from discloom.llm.quality import score_quality
from discloom.llm.toxicity import drop_toxic, score_toxicity

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string, score string"


def corpus(n=700):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdehilmnorst", k=rnd.randrange(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = rnd.choices(words, k=rnd.choice([20, 60, 150, 400]))
        toxic, good = i % 6 == 0, i % 4 > 0
        for _ in range(len(w) // 25 + 1 if toxic else 0):
            w[rnd.randrange(len(w))] = rnd.choice(["zwuq", "ZwuQer", "zwuqing", "zwuqs"])
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "en", "s"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_toxicity_and_quality_generalise(spark):
    rows, labels = corpus()
    rows += [(9000, None, None, None), (9001, "", None, None), (9002, "never seen before zwuqqqer " * 3, None, None), (9003, " calm " * 100_000 + "zwuq zwuqs", None, None), (None, "x", None, None)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    want = {d: (q, t) for d, q, t in labels}
    for k, query in enumerate((score_quality, score_toxicity)):
        got = query(docs, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
        held = [r for r in got if r.held_out and r.doc_id in want]
        assert np.mean([r.predicted == want[r.doc_id][k] for r in held]) > (0.97, 0.9)[k]
    by = {r.doc_id: r.predicted for r in got}
    assert (by[9000], by[9001], by[9002], by[9003]) == (0, 0, 1, 1)
    assert {r.doc_id for r in drop_toxic(docs, known).collect()} == {d for d, p in by.items() if not p}
    assert drop_toxic(docs, known).columns == docs.columns


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "en", None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [(r.doc_id, r.predicted) for r in score_toxicity(docs, none).collect()] == [(1, 0)]
    assert score_quality(docs.limit(0), none).collect() == []
    assert [tuple(r)[2:4] for r in identify_languages(docs.limit(0)).collect()] == []


def test_rows_of_a_batch_do_not_mix():
    model = subword.train([b"good fine well"] * 20 + [b"bad worse ill"] * 20, [1] * 20 + [0] * 20, True, "mean")
    texts = [b"good fine", b"", b"bad ill", b" \n", b"well " * 300_000]
    alone = [subword.logits(model, [t])[0] for t in texts]
    assert np.allclose(subword.logits(model, texts), alone)
    assert alone[0] > alone[2] and alone[1] == alone[3] == model.blank


def test_languages(spark):
    rnd = random.Random(1)
    syllables = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "der"], "cc": ["eau", "ou", "é", "que"]}
    text = lambda lang, n: " ".join("".join(rnd.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(i, text(lang := rnd.choice(list(syllables)), rnd.choice([8, 50, 3000])), lang, None) for i in range(300)]
    truth = {r[0]: r[2] for r in rows}
    rows += [(900, None, "aa", None), (901, "1234 !!", "aa", None), (902, "", None, None), (903, text("bb", 30).upper(), None, None)]
    got = {r.doc_id: r for r in identify_languages(spark.createDataFrame(rows, DOCS)).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert [got[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values())
    even = {"aa": b"same same", "bb": b"same same"}
    assert [(r.lang_pred, r.rejected) for r in identify(spark.createDataFrame([(1, "same", "", "")], DOCS), even).collect()] == [("aa", True)]


def test_learnless_rows(spark):
    blank = [(k, " " * k, "en", None) for k in range(12)]
    known = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(12)], LABELS)
    for query in (score_quality, score_toxicity):
        got = query(spark.createDataFrame(blank, DOCS), known).collect()
        assert len(got) == 12 and len({r.score for r in got}) == 1
    docs = spark.createDataFrame([*blank, (3, "word", "en", None), (3, "other", "en", None), (4, "b", None, None)], DOCS).selectExpr("*", "1 as label", "true as held_out")
    runs = [sorted(map(str, score_toxicity(docs.repartition(n), known).collect())) for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 15
    assert [(r.lang_pred, r.score) for r in identify_languages(docs).where("doc_id = 2").collect()] == [("und", 0.0)]


def plain_logit(model, text):
    """The logit by a loop over words and n-grams."""
    whole, base = (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1
    text = bytes(b + 32 if 65 <= b <= 90 else b for b in text) if model.fold else text
    words = [w[k : k + subword.LONGEST] for w in re.findall(rb"[^ \t-\r]+", text) for k in range(0, len(w), subword.LONGEST)]
    shift, top = 64 - (subword.BUCKETS.bit_length() - 1), model.pooling == "max"

    @functools.cache
    def hashed(x, salt):
        value = 0
        for b in reversed(x):
            value = (value * base + b + 1) & whole
        return value * (0xD6E8FEB86659FD93 * (2 * salt + 1) & whole) & whole

    def pieces(k):
        again = k > 0 and words[k - 1] == words[k]
        if top and again:
            return []
        out, edged = [hashed(words[k], 0) >> shift], b" " + words[k] + b" "
        if k:
            out.append(0 if again else ((hashed(words[k], 0) * 0x9FB21C651E98DF25 + hashed(words[k - 1], 0) & whole) * 0xD6E8FEB86659FD93 & whole) >> shift)
        return out + [hashed(edged[a : a + g], g) >> shift for g in subword.GRAMS for a in range(len(edged) - g + 1)]

    if not words:
        return model.blank
    bags = [sum((pieces(k) for k in range(a, min(len(words), a + subword.WINDOW))), []) for a in range(0, len(words), subword.WINDOW)]
    if top:
        value = max(model.shares[x].sum() / (len(x) + subword.SHRINK) for x in bags)
    else:
        value = model.shares[sum(bags, [])].mean()
    return model.gain * value + model.bias


def test_scores_equal_a_plain_loop_whatever_the_length(monkeypatch):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randrange(1, 9))) for _ in range(300)] + ["x" * 9000, "y" * 4096, "z" * 4097]
    texts = [" ".join(rnd.choices(words, k=n)).encode() for n in (0, 1, 3, 24, 25, 100, 2000)]
    texts += [b"a  a a\n\na A b", ("q" * 5000 + " " * 300_000 + " ".join(rnd.choices(words[:250], k=60))).encode()]
    for pooling, fold in (("max", True), ("mean", False)):
        model = subword.Model(np.random.default_rng(1).normal(size=subword.BUCKETS), 1.3, 0.2, -3, fold, pooling)
        want = [plain_logit(model, t) for t in texts]
        for piece in (1 << 17, 1 << 18):
            monkeypatch.setattr(subword, "PIECE", piece)
            assert np.allclose(subword.logits(model, texts), want, atol=1e-9)


def test_language_by_brute_compression(spark):
    dictionaries = {"aa": b"balo mitu lomi tuba " * 60, "bb": b"schein derung ungder " * 60}
    texts = ["balo tuba", "Derung schein", None, "½ ² ① 12", "lomi derung " * 3000, "é"]

    def brute(text):
        if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
            return "und"
        data, sizes = text.lower().encode(), {}
        for lang, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(lang_id.LEVEL, source_size=lang_id.BLOCK, dict_size=len(content), min_match=lang_id.MIN_MATCH, write_content_size=False)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress(data[k : k + lang_id.BLOCK])) for k in range(0, len(data), lang_id.BLOCK))
        return min(sizes, key=lambda x: (sizes[x], x))

    rows = [(k, t, "aa", None) for k, t in enumerate(texts * 2)]
    got = sorted(identify(spark.createDataFrame(rows, DOCS), dictionaries).collect())
    assert [r.lang_pred for r in got] == [brute(t) for t in texts * 2]
