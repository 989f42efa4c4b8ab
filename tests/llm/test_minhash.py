"""Near-duplicate groups against brute force."""

import random
import re

import numpy as np

from discloom.llm.minhash import components, drop_near_duplicates, near_duplicates, superminhash
from discloom.llm.words import mix, shingle_sets, word_hashes

SCHEMA = "doc_id long, text string, component_id string, n_shingles int"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in up}


def corpus(seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([3, 4, 5, 9, 40, 120, 300]))) for _ in range(60)]
    for _ in range(140):
        words = rnd.choice(texts[:60]).split(" ")
        for _ in range(rnd.choice([0, 1, 2, 4, 8])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(rnd.choice([" ", "\n", "\t \x0b"]).join(words))
    texts += [None, "", " \t\n", "one", "ONE", "two three", "a b c d e f"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


def test_groups_equal_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(got[r[0]].n_shingles == len(shingles(r[1])) for r in rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_chain_of_near_copies_and_hot_group(spark):
    base = [f"t{i}" for i in range(200)]
    rows = [(1000 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :]), None, None) for k in range(0, 200, 2)]
    rows += [(k, " ".join(base), None, None) for k in range(50)]
    rows += [(5000 + k, " ".join(base[k * 3 :] + [f"y{j}" for j in range(k * 3)]), None, None) for k in range(30)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f", None, None), (3, "a b c d e f", None, None), (3, "a b c d e f", None, None), (4, None, None, None)]
    got = sorted(near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [(3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True), (None, 2, None, False)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_words_and_texts():
    data = (b"x" * 3_000_000 + b" " + b"ab " * 500_000).ljust(5_000_000, b" ")
    view = np.frombuffer(data, np.uint8)
    hashes, bounds = word_hashes(view, np.array([0, len(view)]))
    assert len(hashes) == 500_001 and bounds.tolist() == [0, 500_001] and len(set(hashes.tolist())) == 2
    assert len(shingle_sets(view, np.array([0, len(view)]))[0]) == 2


def test_signature_is_superminhash_and_estimates_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for n in (20, 200, 2000):
        pool = mix(rng.integers(0, 2**63, 3 * n).astype(np.uint64))
        a, b = np.sort(pool[: 2 * n]), np.sort(pool[n:])
        s = superminhash(np.concatenate([a, b]), np.array([0, 2 * n, 4 * n]))
        assert (s != np.uint64(2**64 - 1)).all()
        errors.append(abs((s[0] == s[1]).mean() - 1 / 3))
    assert max(errors) < 0.15


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long").repartition(7)
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_of_rows_that_share_an_id_the_smallest_text_stays(spark):
    rows = [(3, "b", "x", 1), (3, "a", "y", 2), (3, None, "z", 3), (None, "a", "n", 4), (None, "a", "n", 4), (4, "long " * 300_000, "l", 5)]
    for n in (1, 3):
        got = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()
        assert sorted((str(r.doc_id), str(r.text)[:5]) for r in got) == [("3", "a"), ("4", "long "), ("None", "a"), ("None", "a")]


def test_scratch_tables_go_with_their_scope(spark, tmp_path):
    from discloom.llm import common

    rows = [(k, f"a b c d e {k // 2}", None, None) for k in range(40)]
    with common.scratch_scope(spark):
        near_duplicates(spark.createDataFrame(rows, SCHEMA)).write.parquet(f"{tmp_path}/out")
        made = list(common._scopes[-1])
    assert made and not any(spark.sparkContext._jvm.java.io.File(p.removeprefix("file://")).exists() for p in made)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40
