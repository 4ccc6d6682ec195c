import binascii
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quernel.llm import packing

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def fewest(lengths, capacity):
    """The least number of bins, over all ways: bins are closed one after another, each holding the longest piece left."""

    @cache
    def bins(left):
        if not left:
            return 0
        first, rest = left[-1], left[:-1]
        best = len(left)

        def fill(i, room, chosen):
            nonlocal best
            if i < 0:
                remaining = list(rest)
                for x in chosen:
                    remaining.remove(x)
                best = min(best, 1 + bins(tuple(remaining)))
                return
            fill(i - 1, room, chosen)
            if rest[i] <= room:
                fill(i - 1, room - rest[i], [*chosen, rest[i]])

        fill(len(rest) - 1, capacity - first, [])
        return best

    return bins(tuple(sorted(lengths)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.sampled_from([20, 23, 31]))
def test_reduction_keeps_the_optimum(lengths, capacity):
    fixed, rest = packing.reduce_by_dominance(Counter(lengths), capacity)
    kept = Counter()
    for pattern, n in fixed.items():
        assert sum(x * k for x, k in pattern) <= capacity
        for x, k in pattern:
            kept[x] += k * n
    assert kept + Counter(rest) == Counter(lengths)
    assert fixed.total() + fewest(Counter(rest).elements(), capacity) == fewest(lengths, capacity)


def one_by_one(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= x]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - x)
        else:
            rooms.append(capacity - x)
    return Counter(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=15))
def test_best_fit_in_steps_equals_one_by_one(histogram):
    got = Counter()
    for pattern, n in packing.best_fit(histogram, 40).items():
        got[40 - sum(x * k for x, k in pattern)] += n
    assert got == one_by_one(list(Counter(histogram).elements()), 40)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 100), max_size=20))
def test_plan_holds_everything_and_respects_the_bound(histogram):
    bins = packing.plan_bins(histogram, 50)
    held = Counter()
    for pattern, n in bins.items():
        for x, k in pattern:
            held[x] += k * n
    assert held == Counter(histogram) and bins.total() >= packing.lower_bound(histogram, 50)
    places = Counter()
    for length, runs in packing.runs_of(bins).items():
        for rank in range(histogram[length]):
            first, each, sequence, offset = runs[np.searchsorted(runs[:, 0], rank, "right") - 1]
            places[int(sequence + (rank - first) // each), int(offset + (rank - first) % each * length)] = length
    assert len(places) == sum(histogram.values()) and len({s for s, _ in places}) == bins.total()
    ends = defaultdict(int)
    for (sequence, offset), length in sorted(places.items()):
        assert ends[sequence] == offset
        ends[sequence] += length
    assert max(ends.values(), default=0) <= 50


def test_reduction_fixes_what_it_must():
    assert packing.reduce_by_dominance({10: 3, 6: 2, 4: 1}, 10) == (Counter({((10, 1),): 3, ((6, 1), (4, 1)): 1, ((6, 1),): 1}), {})
    assert packing.reduce_by_dominance({5: 4}, 10) == (Counter({((5, 2),): 2}), {})
    # Three ones fit beside each six, so nothing is fixed there.
    assert packing.reduce_by_dominance({6: 2, 1: 20}, 10)[1] == {6: 2, 1: 20}


def test_many_lengths_are_planned_fast_and_near_the_bound():
    r = np.random.default_rng(3)
    histogram = Counter(np.minimum(2048, np.maximum(1, r.lognormal(6, 1.2, 200_000).astype(int))).tolist())
    bins = packing.plan_bins(histogram)
    assert bins.total() <= packing.lower_bound(histogram) * 1.01


def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


ODD = ["Don't we'll I'M THEY'RE 'tis rock'n'roll", "x²³¼ 12345 a1b2", "ÀÉÎ straße ﬁ ñ café", "İstanbul ΑΣ Σ", "日本語 ✓ 🙂", "a b\u0085c d", "<|endoftext|> in text", "<| not special", "tab\tvt\x0bff\x0c\x1cfs", "''s --'re ... !?!'", "ſ ŉ µ ª º", "x" * 5000]


def test_codec_equals_the_library(words):
    codec, lib = packing.WordCodec(open(VOCABULARY).read(), cached=8), library()
    r = random.Random(5)
    letters = "aB'sétTre llvemd09²,.- \n\tßÄ"
    texts = [*ODD, words(1, 500), *("".join(r.choice(letters) for _ in range(60)) for _ in range(400))]
    for text in texts:
        assert np.frombuffer(codec.encode_packed(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def check(rows, docs, lib):
    """Every piece is there, its ids are the library's, and sequences are full from 0 without gaps."""
    want = Counter()
    for key, text in docs:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start : start + 2048]
            want[key, piece, start, len(own), binascii.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter(r[:5] for r in rows) == want
    ends = defaultdict(int)
    for _, _, _, length, _, sequence, offset in sorted(rows, key=lambda r: r[5:]):
        assert ends[sequence] == offset
        ends[sequence] += length
    assert max(ends.values(), default=0) <= 2048
    return len(ends)


def test_pack_documents(spark, odd_docs, odd_rows, no_docs, words):
    lib = library()
    pick = lambda df: [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in df.collect()]
    docs = [(r[0], r[1]) for r in odd_rows]
    n = check(pick(packing.pack_documents(odd_docs, VOCABULARY)), docs, lib)
    assert n == check(pick(packing.pack_documents(odd_docs.coalesce(1), VOCABULARY, keep_ids=False)), docs, lib)
    assert packing.pack_documents(no_docs, VOCABULARY).collect() == []
    many = [(i, words(i, 1 + i * 37 % 900)) for i in range(300)] + [(1000 + i, "") for i in range(500)]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(5)
    n = check(pick(packing.pack_documents(df, VOCABULARY)), many, lib)
    histogram = Counter()
    for _, text in many:
        total = len(lib.encode(text, add_special_tokens=False).ids) + 1
        histogram.update({2048: total // 2048, total % 2048: 1})
    histogram = {x: k for x, k in histogram.items() if x and k}
    assert n <= packing.lower_bound(histogram) + 1


def test_ids_are_kept(spark):
    row = packing.pack_documents(spark.createDataFrame([(1, "Two words")], "doc_id long, text string"), VOCABULARY).first()
    assert np.frombuffer(row["ids"], "<u4").tolist() == [*library().encode("Two words", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("length", [1, 2048])
def test_one_hot_length(length):
    bins = packing.plan_bins({length: 10**9})
    assert bins.total() == -(-(10**9) * length // 2048)
