"""Language ID by compression: each text is encoded with a zstandard raw-content dictionary of every language, and the
language of the smallest encoding wins; a narrow margin is rejected. Texts are lower-cased first.

Dictionaries are raw text of a bounded, documented sample: SAMPLE_DOCS training rows of each language, or as many more as
fill DICT_BYTES where texts are short, chosen by a hash of doc_id. A long text gives WINDOWS windows from all its parts,
SAMPLE_CHARS in all, and its share of the dictionary is slices from all of these. Rows whose own encoding prefers another
language are left out of a second round, so mislabelled rows do not spoil a dictionary. Long texts are encoded in
blocks of BLOCK bytes and sizes summed, so that a long text keeps meeting the dictionary instead of its own past.

Edge cases: `und` with score 0 for a null text or one without a letter (Unicode categories L: digits, fractions and numerals
are none), or when nothing was learned; a tie goes to the smaller language code; with one language alone its score is 1. Null
langs are not learned; rows that repeat an id are learned as one, by its smallest text. Repeated rows are judged alike. Empty
tables give empty results. Columns besides doc_id, text and lang are not looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from discloom.llm.classify import remainder
from discloom.llm.common import bounded_batches, windows

SAMPLE_DOCS = 240
SAMPLE_CHARS = 4000
WINDOWS = 8
DICT_BYTES = 128 << 10
SLICE = 200
BLOCK = 8 << 10
#: Level 6 with matches of three bytes and more: short matches tell languages apart, faster levels miss them.
LEVEL, MIN_MATCH = 6, 3
#: Share of the second-best size by which the best must be smaller, or the text is rejected.
MARGIN = 0.02
#: Languages learned at most: a dictionary of each stands in every worker.
LANGUAGES = 500
HELD_OUT = (5, 0)

_made: dict[int, list[tuple[str, zstandard.ZstdCompressor]]] = {}


def _compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    key = hash(tuple(sorted(dictionaries.items())))
    if key not in _made:
        _made.clear()
        made = []
        for lang, content in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(content), min_match=MIN_MATCH, write_content_size=False)
            d.precompute_compress(compression_params=how)
            made.append((lang, zstandard.ZstdCompressor(compression_params=how, dict_data=d)))
        _made[key] = made
    return _made[key]


def classify(text: str | None, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """(language, score, rejected)."""
    if not text or not compressors or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    data = text.lower().encode("utf-8", "replace")
    blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    margin = 1 - sizes[0][0] / sizes[1][0]
    return sizes[0][1], round(min(1.0, 0.5 + margin / (8 * MARGIN)), 9), margin < MARGIN


def _spread(t: bytes, share: int) -> bytes:
    """share bytes of t: slices of about SLICE bytes, one from each equal part, at a place chosen by a hash."""
    if len(t) <= share:
        return t
    k = max(1, share // SLICE)
    part, size = len(t) // k, share // k
    at = zlib.crc32(t) % (part - size + 1)
    return b" ".join(t[n * part + at : n * part + at + size] for n in range(k))


def _dictionary(texts: list[bytes]) -> bytes:
    """Equal shares of all texts; what short ones leave goes to the longer."""
    left, share = DICT_BYTES, DICT_BYTES
    for done, n in enumerate(sorted(map(len, texts))):
        share = left // (len(texts) - done)
        if n > share:
            break
        left, share = left - n, DICT_BYTES
    return b" ".join(_spread(t, max(SLICE, share)) for t in texts)[:DICT_BYTES]


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of the rows that are not held out."""
    n, held = HELD_OUT
    rows = docs.where((remainder(F.col("doc_id"), n) != held) & F.col("lang").isNotNull() & (F.length("text") > 0))
    # as many rows as fill a dictionary with equal shares, SAMPLE_DOCS where no text is shorter than its share
    each = F.avg(F.least(F.length("text"), F.lit(DICT_BYTES // SAMPLE_DOCS)))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.greatest(F.lit(SAMPLE_DOCS), F.ceil(F.lit(DICT_BYTES) / each)).cast("int").alias("most"))
    asked = counts.limit(LANGUAGES + 1).collect()
    if len(asked) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: each has a dictionary in every worker")
    if not asked:
        return {}
    # a row's hash keeps it or not: about four times as many candidates of each language, of which the first are taken; no join, so texts
    # of others stay where they are
    share = F.create_map(*[F.lit(x) for r in asked for x in (r.lang, int(min(1.0, 4.0 * r.most / r.n) * (1 << 20)) + 1)])
    thin = rows.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h")).where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")])
    # rows that repeat an id are one candidate, so one id can't fill the list
    picked = thin.groupBy("lang", "h", "doc_id").agg(F.min(windows(F.col("text"), F.col("doc_id"), SAMPLE_CHARS, WINDOWS)).alias("text"))
    found = picked.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("h", "doc_id", "text"))).alias("rows"))
    cut = F.create_map(*[F.lit(x) for r in asked for x in (r.lang, r.most)])
    found = found.select("lang", F.slice("rows", F.lit(1), cut[F.col("lang")]).alias("rows")).collect()
    texts = {r.lang: [x.text.lower().encode("utf-8", "replace") for x in r.rows] for r in found}
    made = {lang: _dictionary(own) for lang, own in texts.items()}
    if len(made) > 1:
        judges = _compressors(made)
        good = defaultdict(list)
        for lang, own in texts.items():
            for t in own:
                if classify(t.decode("utf-8", "replace"), judges)[0] == lang:
                    good[lang].append(t)
        made = {lang: _dictionary(good[lang] or own) for lang, own in texts.items()}
    return made


def _judge(dictionaries: dict[str, bytes]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(dictionaries)
        for batch in batches:
            rows = [classify(t.as_py(), compressors) for t in batch.column(1)]
            lang, score, rejected = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return judge


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred (the best guess), score, rejected (its margin is narrow) of every whole text."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_judge(dictionaries), "doc_id long, lang_pred string, score double, rejected boolean")


def identify_languages(docs: DataFrame) -> DataFrame:
    n, held = HELD_OUT
    found = identify(docs, learn(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), n) == held).alias("held_out"), "lang_pred", "score", "rejected")
