"""Chat formatting, whitening and resampling over odd tables, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import chat_format, resampling, whitening

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MARKS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|\\im_end|>", "<|\\\\im_sep|>", "<|", "|>", "\\",
         "<|im_end|", "im_end|>", "<", "|", "\n", "\n\n", " ", "\0", "é", "\U0001f600", "ok", "assistant", "漢"]
SAID = st.lists(st.sampled_from(MARKS), max_size=10).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), SAID), SAID), max_size=6))
@settings(max_examples=300, deadline=None)
def test_template_round_trip_and_mask(turns):
    form = chat_format.template(VOCABULARY)
    rendered, spans = form.render(turns)
    ids, loss = form.encode(rendered, spans)
    assert form.decode(ids) == rendered and form.turns(rendered) == turns
    marks = [form.tokenizer.token_to_id(m) for m in (chat_format.START, chat_format.SEP, chat_format.END)]
    assert [int((ids == m).sum()) for m in marks] == [len(turns)] * 3
    learned = [form.unescape(form.decode(ids[a:b])) for a, b in zip(loss[::2], loss[1::2])]
    assert learned == [t for r, t in turns if r == "assistant"]


def test_turns_are_encoded_as_the_library_does():
    form, plain = chat_format.template(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in (" a  b\n\nc ", "it's 12,5", "漢字 \U0001f600"):
        ids, (a, b) = form.encode(*form.render([("assistant", text)]))
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids


CONVERSATIONS = "conv_id long, turn long, role string, text string, ids string, segment string"


@pytest.mark.parametrize("segment", [1 << 16, 40])
def test_formatted_conversations(spark, segment):
    rng = random.Random(3)
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"),
            (1, None, "system", "first"), (2, 5, "assistant", "x" * 30_000), (3, 0, None, "who"), (None, 1, "user", "u"),
            (None, 0, "assistant", "<|im_end|>"), (4, 0, "user", "same"), (4, 0, "user", "same"),
            (6, 0, "assistant", "a\0b")]
    rows += [(5, i, ("user", "assistant")[i % 2], f"turn {i} " + "w" * rng.randint(0, 9)) for i in range(400)]
    shuffled = list(rows)
    rng.shuffle(shuffled)
    df = spark.createDataFrame([(*r, "x", "y") for r in shuffled], CONVERSATIONS).repartition(3)
    out = chat_format.formatted(df, VOCABULARY, segment_chars=segment).cache()
    assert (out.where("conv_id = 5").count() > 20) == (segment == 40)
    got = {r.conv_id: r for r in chat_format.digests(out, VOCABULARY).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        learned = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    read = chat_format.read_turns(out, VOCABULARY).orderBy("segment", "place").collect()
    for c, turns in want.items():
        own = [(r.role, r.text) for r in read if r.conv_id == c]
        assert own == turns and all(r.loss == (r.role == "assistant") for r in read)
    assert chat_format.digests(chat_format.formatted(df.limit(0), VOCABULARY), VOCABULARY).count() == 0


@pytest.mark.parametrize("values", ["spread", "equal", "pairs", "close", "low rank", "decades"])
def test_eigenvectors_of_clustered_values(values):
    rng, d = np.random.default_rng(1), 40
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = {"spread": np.sort(rng.uniform(1, 5, d))[::-1], "equal": np.ones(d), "pairs": np.repeat(np.arange(d // 2) + 1.0, 2)[::-1],
         "close": (3 + 1e-7 * np.arange(d))[::-1], "low rank": np.maximum(0, 10.0 - np.arange(d)), "decades": np.logspace(0, -12, d)}[values]
    a = (q * e) @ q.T
    w, x = whitening.eigenvectors((a + a.T) / 2)
    assert np.abs(w - e).max() < 1e-14 * d * e.max()
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-14 * d
    assert np.abs(a @ x - x * w).max() < 1e-14 * d * e.max()
    if values == "spread":
        assert np.abs(np.abs((q * x).sum(axis=0)) - 1).max() < 1e-12


def test_refinement_starts_from_single_precision_and_squares_the_error():
    rng, d = np.random.default_rng(2), 30
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    a = (q * np.arange(1.0, d + 1)) @ q.T / d
    w, x = (v.astype(float) for v in np.linalg.eigh(a.astype(np.float32)))
    steps = []
    for _ in range(3):
        w, x, step = whitening.refine(a, w, x)
        steps.append(step)
    assert 1e-9 < steps[0] < 1e-4 and steps[1] < 1e-8 and steps[2] < 1e-13


def test_whitened_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12)) * np.linspace(1, 3, 12) / 10
    rows = [(i, [float(np.float32(c)) for c in v], "x", 1) for i, v in enumerate(base)]
    rows += [rows[0], (500, None, "x", 1), (501, [None] * 12, "x", 1), (502, [float("nan")] * 12, "x", 1), (503, [], "x", 1),
             (504, [float("inf")] + [0.0] * 11, "x", 1), (505, [0.1, 0.2], None, 1), (None, [0.0] * 12, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, component int").repartition(5)
    fit = [(i, np.floor(1024 * np.array(v)).astype(int) + 100_000) for i, v, *_ in rows if i not in range(500, 506)]
    x = np.array([v for _, v in fit])
    n, s = len(x), x.sum(axis=0)
    d = (n * x - s) / n
    e, v = np.linalg.eigh(d.T @ d / n)
    e, v = e[::-1], v[:, ::-1]
    got = defaultdict(list)
    for r in whitening.whitened(df, whitening.fit(df)).collect():
        got[r.vec_id, r.component].append(r)
    assert len(got) == 8 * 301
    for k in range(8):
        y = d @ v[:, k] / math.sqrt(e[k])
        sign = np.sign(y[5] * got[5, k + 1][0].whitened)
        for (i, vec), want in zip(fit, y):
            r = got[i, k + 1][0]
            assert r.whitened == pytest.approx(sign * want, rel=1e-9, abs=1e-10)
            assert r.n == n and r.deviation == Decimal(int(((n * vec - s) ** 2).sum()))
            assert r.explained == pytest.approx(e[k] / e.sum(), rel=1e-9) and r.identity_error < 1e-9
    assert len(got[0, 1]) == 2
    for empty in (df.limit(0), df.where("vec_id > 499 AND vec_id < 505"), df.where("vec_id = 3")):
        assert whitening.whitened(empty, whitening.fit(empty)).count() == 0
    # One dimension that varies gives one component.
    flat = spark.createDataFrame([(i, [float(i), 2.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whitened(flat, whitening.fit(flat)).count() == 9


def test_large_components_are_summed_exactly(spark):
    rows = [(i, [(-1.0) ** i * 1e13 + i, float(i % 7)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[int(c * 1024) + 100_000 for c in v] for _, v in rows]
    s = [sum(v[k] for v in x) for k in range(2)]
    assert whitening.totals(df, "embedding", 1024, 100_000) == (40, s)
    got = {r.vec_id: r.deviation for r in whitening.whitened(df, whitening.fit(df)).collect()}
    assert got == {i: sum((40 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    wide = spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="range of a long"):
        whitening.fit(wide)


def test_words_and_windows():
    text = "héllo  wörld\0 it's a_b\x7f\U0001f600x 12-3\n\x80q"
    windows = resampling.Windows(3, 1000)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    n, got = windows.of(text)
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    assert n == len(words) and got.tolist() == [zlib.crc32(r.encode()) % 1000 for r in runs]
    assert [windows.of(t)[0] for t in ("", " .", "one", "one two")] == [0, 0, 1, 2]


WORDS = "alpha Beta gamma DELTA Épsilon zeta eta theta iota 123 kappa".split()


@pytest.mark.parametrize(("most", "percent", "hot"), [(1, 10, 100_000), (2, 30, 20)])
def test_resampled(spark, documents, monkeypatch, most, percent, hot):
    monkeypatch.setattr(resampling, "TASK_ROWS", hot)
    rng = random.Random(most)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(7, docs[7][1]), (200, None), (201, ""), (202, "x " * 40_000), (None, "alpha " * 25), (None, None)]
    aims = ["alpha beta kappa, alpha 123", None, "gamma"]
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(aims)], "item_id long, text string, rank string")
    frame = documents(docs)
    named = {"percent": percent, "seed": 2024, "most_words": most, "buckets": 50}
    got = resampling.resampled(frame, target, **named).collect()

    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % 50 for r in runs]

    own, aim = ([features(t) for t in texts] for texts in ([t for _, t in docs], aims))
    s, t = (Counter(b for _, x in part for b in x) for part in (own, aim))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)}
    want = []
    for (d, _), (n, x) in zip(docs, own):
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        w = sum(gain[b] for b in x)
        want.append([d, n, len(x), w, w + noise, None])
    fit = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(map(tuple, want), key=key)
    assert max(r[5] or 0 for r in want) > 5
    assert resampling.resampled(frame.limit(0), target, **named).count() == 0
    assert resampling.resampled(frame, target.limit(0), **named).count() == len(docs)
