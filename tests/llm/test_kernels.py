"""Array kernels against plain Python."""

import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import exact_dedup, packing, secret_scan, token_files, tokens
from plumbline.llm.fm_index import FMIndex
from plumbline.llm.mixing import one_cycle, phases, shares_of
from plumbline.llm.substring_dedup import least_of, smallest_holders
from plumbline.llm.tokens import encoder
from plumbline.llm.words import Words, grams, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from(list("abAB \t\n\x0b\x1cé \U0001f600")), max_size=40)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    words = Words(pa.array(texts, pa.string()))
    data, want = words.data.tobytes(), [WORD.findall(t or "") for t in texts]
    got = [data[a:b].decode() for a, b in zip(words.starts, words.ends)]
    assert got == [w for x in want for w in x]
    assert words.counts.tolist() == [len(x) for x in want]
    codes = dict(zip(got, words.hashes.tolist()))
    assert [codes[w] for w in got] == words.hashes.tolist()
    assert len(set(codes.values())) == len(codes)


def test_words_of_a_slice_and_lower_case():
    texts = pa.array(["x y", "Ab ÄB cD", None, "z"]).slice(1, 3)
    words = Words(texts, lower=True)
    data = words.data.tobytes()
    got = [data[a:b].decode() for a, b in zip(words.starts, words.ends)]
    assert got == ["ab", "Äb", "cd", "z"]
    assert len(grams(words.hashes, 3)) == 2


def test_shingle_sets_of_short_texts():
    sets = shingle_sets(Words(pa.array(["a b", "a b", "b a", "", "a b c", "a b c a b c", "a"])), 3)
    assert [len(s) for s in sets] == [1, 1, 1, 0, 1, 3, 1]
    assert sets[0] == sets[1] and sets[0] != sets[2] and sets[6] != sets[0]
    assert sets[4][0] in sets[5]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60, unique=True))
@settings(max_examples=100, deadline=None)
def test_golomb_round_trip(values):
    values = np.sort(np.array(values, dtype=np.uint64))
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values)) == values).all()


@pytest.mark.parametrize("counts", [[5], [0, 3, 1], [1] * 300, [2**k for k in range(40)]])
def test_huffman_codes_are_complete_and_limited(counts):
    lengths = token_files.code_lengths(np.array(counts), 12)
    assert (lengths > 0).sum() == np.count_nonzero(counts) and lengths.max() <= 12
    kraft = sum(2.0 ** -int(n) for n in lengths if n)
    assert kraft <= 1
    code = token_files.Code(lengths)
    ids = np.array(random.Random(1).choices(np.flatnonzero(counts).tolist(), k=1000))
    bits, offsets = code.encode(ids)
    assert (code.decode(bits, offsets, len(ids)) == ids).all()
    assert len(offsets) == -(-len(ids) // token_files.STRIDE)


def test_huffman_is_near_the_entropy():
    counts = np.array([1000 // (k + 1) for k in range(200)])
    p = counts / counts.sum()
    mean = (p * token_files.code_lengths(counts)).sum()
    assert -(p * np.log2(p)).sum() <= mean < -(p * np.log2(p)).sum() + 0.1


def test_best_fit_keeps_every_capacity_and_packs_tightly():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 101, 600)
    for options in ({}, {"documents": 3}, {"attention": 5000, "weights": (1, 0, 1)},
                    {"documents": 4, "attention": 6000, "weights": (1, 0.5, 1), "rule": "dot"}):
        bins = packing.best_fit(sizes, tokens=100, **options)
        for b in range(bins.max() + 1):
            own = sizes[bins == b]
            assert 0 < own.sum() <= 100
            assert len(own) <= options.get("documents", 100)
            assert (own**2).sum() <= options.get("attention", 10**9) or len(own) == 1
        if not options:
            assert bins.max() + 1 <= np.ceil(sizes.sum() / 100) * 1.03


def test_pfair_deviation_is_below_one_block():
    shares = shares_of({"a": 5.0, "b": 1.0, "c": 0.3, "d": 0.01}, 1024)
    assert sum(shares.values()) == 1024 and min(shares.values()) >= 1
    slots = one_cycle(shares)
    for s, p in shares.items():
        ran = np.searchsorted(slots[s], np.arange(1025))
        assert (np.abs(ran - np.arange(1025) * p / 1024) < 1).all()


def test_phases_give_each_slot_to_one_block():
    blocks = {"a": 700, "b": 3, "c": 0, "d": 2000}
    seen = set()
    for _, first, end, slot0, cycle, share, slots in phases(blocks, {"a": 1, "b": 1, "c": 1, "d": 1}):
        for j in range(first, end):
            seen.add(slot0 + (j - first) // share * cycle + slots[(j - first) % share])
    assert seen == set(range(2703))


@pytest.mark.parametrize("n", [20, 256, 1000])
def test_phases_keep_the_given_weights_over_many_cycles(n):
    rest = Fraction(2, 3) / (n - 1)
    weights = {f"s{k}": rest if k else Fraction(1, 3) for k in range(n)}
    slots = {s: [] for s in weights}
    blocks = {s: int(40_000 * w) + 2 for s, w in weights.items()}
    for s, first, end, slot0, cycle, share, places in phases(blocks, weights):
        slots[s] += [slot0 + j // share * cycle + places[j % share] for j in range(end - first)]
    last = min(x[-1] for x in slots.values())  # until a source runs out
    assert last > 20_000
    for s, w in weights.items():
        own = [x for x in slots[s] if x <= last]
        for j, slot in enumerate(own):
            assert abs(j - w * slot) < 1 and abs(j + 1 - w * (slot + 1)) < 1
        assert abs(len(own) - w * (last + 1)) < 1


def test_fm_index_counts_patterns_and_finds_longest_matches():
    rng = random.Random(7)
    text = np.array([rng.randint(1, 4) for _ in range(400)] + [0])
    index = FMIndex(text, 6)
    for _ in range(200):
        p = [rng.randint(1, 4) for _ in range(rng.randint(1, 6))]
        low, high = np.array([0]), np.array([index.size])
        for c in reversed(p):
            low, high = index.step(np.array([c]), low, high)
            if high[0] <= low[0]:
                break
        n = sum(text[i : i + len(p)].tolist() == p for i in range(400))
        assert max(0, int(high[0] - low[0])) == n
    matched, _ = index.statistics(text, np.array([0, 100]), np.array([100, 400]))
    assert matched[:94].tolist() == [6] * 94 and matched[97:100].tolist() == [3, 2, 1]


def test_least_of_is_the_sliding_minimum():
    x = np.random.default_rng(2).integers(0, 50, 90).astype(np.uint64)
    for width in (1, 2, 5, 43, 90, 91):
        want = [x[i : i + width].min() for i in range(90 - width + 1)]
        assert least_of(x, width).tolist() == want


def test_smallest_holders():
    texts = ["a b c d e", "x b c d y", "b c d", "q r s"]
    got = smallest_holders(pa.array(texts, pa.large_string()), np.array([9, 4, 7, 1]), 3)
    assert [x.tolist() for x in got] == [[9, 4, 9], [4, 4, 4], [4], [1]]


def test_battery_tells_random_strings_from_ordered_ones_and_prose():
    corpus = np.zeros(256)
    prose = "the quick brown fox jumps over the lazy dog and then it was all over again " * 50
    for c in prose:
        corpus[ord(c)] += 1
    rng = random.Random(11)
    chars = secret_scan.ENCODINGS["base62"]
    for _ in range(20):
        string = "".join(rng.choice(chars) for _ in range(44))
        kind = secret_scan.encoding_of(string)
        even, against = secret_scan.battery(string, kind, corpus)
        assert even > 1e-4 and against < 1e-3
    even, _ = secret_scan.battery("abcdefghijklmnopqrstuvwxyz0123456789", "lower", corpus)
    assert even < 1e-3
    even, _ = secret_scan.battery("a" * 40, "lower", corpus)
    assert even < 1e-6
    words = "thequickbrownfoxjumpsoverthelazydogandthenitwas"
    _, against = secret_scan.battery(words, "lower", corpus)
    assert against > 1e-3


def test_base_spans_take_their_place_even_when_dropped():
    text = "password: token:abcdefghijklmnop Secret='0123456789ab' AKIAAKIA AKIA" + "Z" * 14 + " " + "f" * 16
    spans = secret_scan.base_spans(text)
    assert [k for _, k, _ in spans] == [0, 1, 2]
    assert text[spans[0][0] : spans[0][2]] == "Secret='0123456789ab"


PIECES = ["a", "B", "the", "é", "É", "İ", "ß", "ﬁ", "é", "́", "'s", "'", "12", ".", ",", "!!", "#*",
          " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "\0",
          "\U0001f600", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "漢字", "Σ", "ς", "|", "½", "_"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14), max_size=6))
@settings(max_examples=1000, deadline=None)
def test_encoder_equals_the_library(name, lists):
    enc = encoder(public_tokenizers.path(name))
    texts = ["".join(x) for x in lists] + [None]
    ids, starts = enc.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        want = enc.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert ids[starts[i] : starts[i + 1]].tolist() == want, repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_known_and_new_words_equal_the_library(name):
    rng = random.Random(6)
    enc = encoder(public_tokenizers.path(name))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEÉÀßÿïªµº"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(3000)]
    for _ in range(3):  # new ones, known ones, and both
        texts = [" ".join(w + rng.choice(["", "", ".", ",\n", "\n", " \n", "-x", "\n\n"]) for w in rng.choices(words, k=40)) for _ in range(60)]
        ids, starts = enc.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[starts[i] : starts[i + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
        words += ["".join(rng.choices(letters, k=6)) for _ in range(1000)]


def test_names_of_one_hash_keep_their_ids(monkeypatch):
    monkeypatch.setattr(tokens, "_hashes", lambda data, at: (np.diff(at) % 3).astype(np.uint64))
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two three four five six", "six five four one", "two  seven\neight nine"] * 2
    for _ in range(2):
        ids, starts = enc.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[starts[i] : starts[i + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
