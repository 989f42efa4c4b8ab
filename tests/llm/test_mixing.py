"""Targets against a plain water-filling, and the schedule's sums."""

import random
import re
from collections import defaultdict

import pytest

from discloom.llm.mixing import GOLDEN, mix, mix_documents, schedule

SCHEMA = "doc_id long, text string, source string, size string, target string"


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: 3 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return share | capped
        capped |= over


def rows(seed=4, hot=400):
    rnd = random.Random(seed)
    text = lambda: rnd.choice(["", " ", " w\tx y\n"]) + " ".join(["w"] * rnd.choice([0, 1, 7, 90, 400]))
    out = [(i, text(), rnd.choice(["a", "é", "B", "tiny", None] + ["hot"] * 3), "s", "t") for i in range(hot)]
    return [*out, (None, "n n", "a", None, None), (5, None, "a", None, None), (6, "r r r", "a", None, None), (6, "r r r", "a", None, None), (7, "one", "lone", None, None), (8, None, "void", None, None)]


def test_targets_and_taken(spark):
    data = rows()
    got = mix(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, *_ in data)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert {r.source: r.source_size for r in got} == dict(sizes)
    want = plain_targets(dict(sizes))
    assert target == pytest.approx(want)
    for s, t in want.items():
        assert abs(taken[s] - t) < 1
    again = mix(spark.createDataFrame(data, SCHEMA).repartition(1)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_slots_interleave_the_sources(spark):
    taken, placed = schedule(spark.createDataFrame(rows(), SCHEMA), block_words=50)
    target = {r.source_no: r.target for r in placed.select("source_no", "target").distinct().collect()}
    slots = sorted((r.slot, r.source_no, r.to_word - r.from_word) for r in taken.collect())
    whole = sum(target.values())
    half = slots[: len(slots) // 2]
    done = sum(w for *_, w in half)
    for s, t in target.items():
        part = sum(w for _, x, w in half if x == s)
        assert abs(part / done - t / whole) < 0.1
    assert all(w > 0 for *_, w in slots)


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents_are_mixed_with_their_texts(spark):
    data = [*rows(hot=60), (900, "w " * 100_000, "hot", "s", "t")]
    frame = spark.createDataFrame(data, SCHEMA)
    got = mix_documents(frame.withColumn("taken", frame["doc_id"]))
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "size", "source_size", "target", "taken"])
    assert sorted(str((r.doc_id, r.text, r.source)) for r in got.collect()) == sorted(str(d[:3]) for d in data)
    assert sorted((str(r.doc_id), r.taken) for r in got.collect()) == sorted((str(r.doc_id), r.taken) for r in mix(frame).collect())
    assert mix_documents(frame.limit(0)).collect() == []


def plain_mix(data, block_words):
    """Who takes how much, by a plain walk over slots and streams."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for d in data:
        sizes[d[2]] += words(d[1])
    target = plain_targets(dict(sizes))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    floors = {s: int(target[s]) for s in order}
    slots, whole = max(1, 16 * len(order), -(-sum(sizes.values()) // block_words)), sum(floors.values())
    blocks = dict.fromkeys(order, 0)
    for k in range(slots):
        x, before = ((k + 0.5) * GOLDEN) % 1.0, 0
        last = None
        for s in order:
            if floors[s] and before / whole <= x:
                last = s
            before += floors[s]
        blocks[last] += 1
    return floors, {s: max(n, 1) if floors[s] else 0 for s, n in blocks.items()}


def test_blocks_and_streams_against_a_plain_walk(spark):
    data = [r for r in rows(hot=80) if r[0] is not None]
    taken, placed = schedule(spark.createDataFrame(data, SCHEMA), block_words=50)
    floors, blocks = plain_mix(data, 50)
    name = {r.source_no: r.source for r in placed.collect()}
    got, streams = defaultdict(dict), defaultdict(list)
    for r in taken.collect():
        got[name[r.source_no]][r.slot] = got[name[r.source_no]].get(r.slot, 0) + r.to_word - r.from_word
    for r in placed.where("size > 0").collect():
        streams[r.source].append((r.start, r.size))
    for s, floor in floors.items():
        block = -(-floor // blocks[s]) if floor else 0
        want = [min(block, floor - at) for at in range(0, floor, block)] if floor else []
        assert [w for _, w in sorted(got[s].items())] == want
        at = 0
        for start, size in sorted(streams[s]):  # streams have neither gaps nor overlaps
            assert start == at
            at += size
    # a document takes its words once for each pass that its target reaches
    for r in mix(spark.createDataFrame(data, SCHEMA), block_words=50).collect():
        assert 0 <= r.taken <= 3 * r.size and (r.taken == 0 or r.taken >= min(r.size, 1))
