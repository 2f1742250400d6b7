"""Token ids of whole texts by the ``tokenizers`` library, with repeated words looked up.

A tokenizer cuts a text into pieces before it merges inside them, and it never
merges over white space. So a text is cut at blanks where a cut cannot change
the pieces, and the ids of a chunk that came before are taken from a bounded
table instead of being computed again. New chunks go to the library together.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.words import SLICE_BYTES, slices, span_hashes

MOST_WORDS = 1_000_000  # entries of a worker's table, some 60 bytes each
FIRST = b"\xff"  # before a name that no blank precedes; no byte of UTF-8
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of a vocabulary file, made once per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Grown:
    """A flat array that is appended to; its room doubles."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1 << 12, dtype=kind), 0

    @property
    def used(self) -> np.ndarray:
        return self.data[: self.size]

    def append(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            more = np.zeros(max(end, 2 * len(self.data)), dtype=self.data.dtype)
            more[: self.size] = self.used
            self.data = more
        self.data[self.size : end] = values
        self.size = end


class _Index:
    """Places of 64-bit keys: a sorted run, and a short one that is merged into it."""

    def __init__(self):
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        for known, place in self.runs:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = place[at[hit]]
        return out

    def add(self, keys: np.ndarray, place: np.ndarray) -> None:
        def merged(*runs):
            k, p = (np.concatenate(x) for x in zip(*runs))
            order = np.argsort(k, kind="stable")
            return k[order], p[order].astype(np.int32)

        large, small = self.runs
        small = merged(small, (keys, place))
        if 4 * len(small[0]) > len(large[0]):
            large, small = merged(large, small), (small[0][:0], small[1][:0])
        self.runs = [large, small]


class _Table:
    """Known byte strings and their ids in flat arrays; looked up many at a time.

    A hash finds an entry and the bytes decide. Of strings with one hash the first has
    the entry; another is never found and gets its ids from the library each time.
    """

    def __init__(self):
        self.index = _Index()
        self.bytes, self.ends = _Grown(np.uint8), _Grown(np.int64)
        self.begin, self.count, self.flat = _Grown(np.int64), _Grown(np.int64), _Grown(np.uint32)

    def __len__(self) -> int:
        return self.begin.size

    def find(self, names: pa.Array) -> np.ndarray:
        """Entry of each name, -1 where it is new."""
        data, at = _raw(names)
        return self._verified(self.index.find(_hashes(data, at)), data, at)

    def _verified(self, got: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(got >= 0)
        sizes = np.diff(at)[hit]
        ends = self.ends.used[got[hit]]
        starts = np.where(got[hit] > 0, self.ends.used[got[hit] - 1], 0)
        same = ends - starts == sizes
        hit, sizes, starts = hit[same], sizes[same], starts[same]
        mine, upto = _runs(self.bytes.used, starts, sizes)
        theirs, _ = _runs(data, at[hit], sizes)
        wrong = np.concatenate([[0], np.cumsum(mine != theirs)])
        hit = hit[wrong[upto[1:]] == wrong[upto[:-1]]]
        out = np.full(len(got), -1, dtype=np.int64)
        out[hit] = got[hit]
        return out

    def add(self, names: pa.Array, ids: list[list[int]]) -> np.ndarray:
        """Entries of new names; a name whose hash is taken has an entry that is not found again."""
        data, at = _raw(names)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        place = len(self) + np.arange(len(names))
        keys = _hashes(data, at)
        free = np.flatnonzero(self.index.find(keys) < 0)
        free = free[np.unique(keys[free], return_index=True)[1]]
        self.index.add(keys[free], place[free])
        self.ends.append(self.bytes.size + at[1:])
        self.bytes.append(data)
        self.begin.append(self.flat.size + np.cumsum(count) - count)
        self.count.append(count)
        self.flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum())))
        return place


def _raw(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a large binary array."""
    at = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    if len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = names.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return span_hashes(data, at[:-1], at[1:])


class Encoder:
    """Gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        # The last added token ends a chunk when many chunks are encoded as one text.
        self.mark, self.mark_id = (
            (added[max(added)].content, max(added)) if added else (None, None)
        )
        a = self._plain("a b")
        spaced = self._plain("a") + self._plain(" b") == a
        dropped = self._plain("a") + self._plain("b") == a
        # How the blank before a word counts: with the word, or not at all.
        self.lead = "" if dropped else (" " if spaced else None)
        self.lowers = dropped and self._plain("Aé") == self._plain("aé") == self._plain("aÉ")
        self.table = _Table()
        # A word of Latin letters is one piece, so the model alone gives its ids.
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        some = ["a", "Zebra", "naïveté", "ÀÉÿªµß"]
        lowered = [w.lower() for w in some] if self.lowers else some
        words = [x + w for w in lowered for x in {"", self.lead or ""}]
        self.direct = self.lead is not None and all(self._word(w.encode()) == self._batch([w])[0] for w in words)

    def _word(self, word: bytes) -> list[int]:
        """Ids of one piece, given as bytes."""
        if word.isascii():  # the blank is the only byte of such a word with another character
            name = word.decode().replace(" ", self.letters[0x20])
        else:
            name = word.decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(name)]

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, several in one call, cut at the mark."""
        if not texts:
            return []
        odd = self.mark is None or any(s in t for t in texts for s in self.special)
        if odd:
            return [self._plain(t) for t in texts]
        joined = self.mark.join(texts)
        ids = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
        cuts = np.flatnonzero(np.array(ids) == self.mark_id)
        assert len(cuts) == len(texts) - 1
        return [ids[a:b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids start and the last end).

        A null text counts as an empty one.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.lead is None:
            return _joined([self._plain(t) for t in texts.to_pylist()])
        if len(self.table) > MOST_WORDS:
            self.table = _Table()
        dropped = self.lead == ""
        lists = pc.split_pattern(self._spaced(texts) if dropped else texts, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts -= starts[0] if len(starts) else 0
        pieces = lists.flatten().cast(pa.large_binary())
        heads = starts[:-1] if not dropped else starts[:0]
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        names = coded.dictionary
        # The text's first chunk has no blank before it, which is a name of its own.
        first = pieces.take(pa.array(heads)).dictionary_encode()
        mark, none = (pa.scalar(x, pa.large_binary()) for x in (FIRST, b""))
        marked = pc.binary_join_element_wise(mark, first.dictionary, none)
        codes[heads] = len(names) + first.indices.to_numpy().astype(np.int64)
        names = pa.concat_arrays([names, marked.cast(pa.large_binary())])
        used = np.zeros(len(names), dtype=bool)
        used[codes] = True
        made, begin, count, simple = self._split(names)
        rest = np.flatnonzero(~simple & used)
        more, sizes = self._learn(names.take(pa.array(rest)).to_pylist())
        table = self.table
        # Each chunk is a run of table entries: one, or those of its parts.
        entries = [made, more]
        begin[rest] = len(made) + np.cumsum(sizes) - sizes
        count[rest] = sizes
        odd = np.zeros(len(names), dtype=bool)
        odd[rest] = sizes == 0
        begin, count, at = begin[codes], count[codes], len(made) + len(more)
        extra = []
        if odd.any():
            wrong = np.unique(np.searchsorted(starts, np.flatnonzero(odd[codes]), side="right") - 1)
            for i in wrong.tolist():
                count[starts[i] : starts[i + 1]] = 0
                begin[starts[i]], count[starts[i]] = at + len(extra), 1
                extra.append(np.array(self._plain(texts[i].as_py()), dtype=np.uint32))
            entries.append(len(table) + np.arange(len(extra)))
        run, ends = _runs(np.concatenate(entries), begin, count)
        starts = ends[starts]
        begin, count, flat = table.begin.used, table.count.used, table.flat.used
        if extra:
            more = np.fromiter(map(len, extra), np.int64, len(extra))
            begin = np.concatenate([begin, len(flat) + np.cumsum(more) - more])
            count = np.concatenate([count, more])
            flat = np.concatenate([flat, *extra])
        ids, ends = _runs(flat, begin[run], count[run])
        return ids, ends[starts]

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(place, count, ids, starts) of consecutive parts of ``texts``, a few megabytes each."""
        for at, part in slices(texts, 4 * SLICE_BYTES):
            yield at, len(part), *self.encode(part)

    def _spaced(self, texts: pa.Array) -> pa.Array:
        """The texts with more single blanks, where white space is dropped: for line
        breaks, and before the marks that close a word. Plain letters in lower case,
        unless that would make a special token."""
        texts = pc.replace_substring(texts, "\n", " ")
        if not self.lowers:
            return texts
        texts = pc.replace_substring_regex(texts, r"([A-Za-z\xe0-\xf6\xf8-\xff])([.,]) ", r"\1 \2 ")
        lower = pc.ascii_lower(texts)
        kept = [pc.match_substring(lower, s, ignore_case=False) for s in self.special]
        return texts if any(pc.any(k).as_py() for k in kept) else lower

    def _split(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entries, first entry and number of entries of each chunk, whether it was split).

        Splits whole arrays of chunks as ``_parts`` does one: at line breaks into lines,
        a line of Latin letters and closing marks into the two. A line that is neither
        that nor begins and ends with visible ASCII is left to ``_learn``.
        """
        data, at = _raw(names)
        spaced = self.lead != ""
        breaks = (data == 10) if spaced else np.zeros(len(data), dtype=bool)
        lines = 1 + np.diff(np.concatenate([[0], np.cumsum(breaks)])[at])
        places = np.flatnonzero(breaks)
        starts = np.sort(np.concatenate([at[:-1], places + 1]))
        ends = np.sort(np.concatenate([at[1:], places]))
        owner = np.repeat(np.arange(len(names)), lines)
        later = np.concatenate([[False], owner[1:] == owner[:-1]]) if len(owner) else np.zeros(0, bool)
        padded = np.concatenate([data, [0, 0]]).astype(np.uint8)
        headed = (padded[starts] == FIRST[0]) & (ends > starts)
        starts = starts + headed
        first = (headed | later) & spaced
        two = _TWO[padded[:-2].astype(np.int64) * 256 + padded[1:-1]] if len(data) else breaks
        letter = _LETTER[data] | two
        letter[1:] |= two[:-1]
        letters = np.concatenate([[0], np.cumsum(letter)])
        marks = np.concatenate([[0], np.cumsum(_MARK[data])])
        n = letters[ends] - letters[starts]
        size = ends - starts
        plain = (n > 0) & (n + marks[ends] - marks[starts] == size) & (letters[starts + n] - letters[starts] == n)
        edge = (size > 0) & _VISIBLE[padded[starts]] & _VISIBLE[padded[np.maximum(ends - 1, 0)]]
        good = plain | edge | ((size == 0) & (not spaced))
        simple = np.bincount(owner, weights=~good, minlength=len(names)) == 0
        # Lines of chunks that are left to ``_learn`` aren't entered.
        kept = np.flatnonzero(simple[owner])
        starts, size, n, plain, first, later, owner = (
            x[kept] for x in (starts, size, n, plain, first, later, owner)
        )
        stem = np.where(plain, n, size)
        closed = np.flatnonzero(size > stem)
        words = _gathered(data, starts, stem, first, plain if self.lowers else None)
        tails = _gathered(data, (starts + stem)[closed], (size - stem)[closed], np.full(len(closed), spaced))
        newline = pa.array([FIRST + b"\n"] if later.any() else [], pa.large_binary())
        found = self._entries(pa.concat_arrays([words, tails, newline]))
        slots = 1 + later + (size > stem)
        end = np.cumsum(slots)
        entries = np.empty(int(end[-1]) if len(end) else 0, dtype=np.int64)
        if later.any():
            entries[(end - slots)[later]] = found[-1]
        entries[end - slots + later] = found[: len(words)]
        entries[end[closed] - 1] = found[len(words) : len(words) + len(closed)]
        count = np.bincount(owner, weights=slots, minlength=len(names)).astype(np.int64)
        return entries, np.cumsum(count) - count, count, simple

    def _entries(self, names: pa.Array) -> np.ndarray:
        """Table entries of names; new ones are encoded by the library and entered."""
        found = self.table.find(names)
        missing = np.flatnonzero(found < 0)
        coded = names.take(pa.array(missing)).dictionary_encode()
        some = coded.dictionary
        lead = self.lead.encode()
        fresh = [x[1:] if x[:1] == FIRST else lead + x for x in some.to_pylist()]
        words = [self.direct and _STEM(x) is not None for x in fresh]
        ids = [self._word(x) if w else [] for x, w in zip(fresh, words)]
        other = [i for i, w in enumerate(words) if not w]
        for k in range(0, len(other), 4096):
            part = other[k : k + 4096]
            for i, got in zip(part, self._batch([fresh[i].decode() for i in part])):
                ids[i] = got
        found[missing] = self.table.add(some, ids)[coded.indices.to_numpy()]
        return found

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Enter the words of new chunks; a chunk at a text's start begins with ``FIRST``.

        Gives the entries of all chunks one after another, and how many each has; a
        chunk that doesn't stand alone has none.
        """
        flat: list[bytes] = []
        sizes = np.zeros(len(chunks), dtype=np.int64)
        spaced = self.lead != ""
        for i, chunk in enumerate(chunks):
            at = FIRST if chunk[:1] == FIRST else b""
            body = chunk[len(at) :].decode()
            plain = _PLAIN(body)
            if plain:
                word, marks = plain.groups()
                flat.append(at + (word.lower() if self.lowers else word).encode())
                sizes[i] = 1
                if marks:
                    flat.append(self._bare(marks))
                    sizes[i] = 2
            elif not body and not spaced:
                flat.append(b"")
                sizes[i] = 1
            elif _stands_alone(body):
                parts = self._parts(body, at)
                flat += parts
                sizes[i] = len(parts)
        return self._entries(pa.array(flat, pa.large_binary())), sizes

    def _bare(self, part: str) -> bytes:
        """Name of a part that no blank precedes."""
        return part.encode() if self.lead == "" else FIRST + part.encode()

    def _parts(self, chunk: str, at: bytes) -> list[bytes]:
        """The chunk cut where it is safe: a Latin word, its closing marks, one line break.

        Tokenizers that drop white space also lower-case, which is done here for
        plain letters.
        """
        left, broken, right = chunk.partition("\n")
        if broken:
            if not (_stands_alone(left) and _stands_alone(right)):
                return [at + chunk.encode()]
            return [*self._parts(left, at), self._bare("\n"), *self._parts(right, self._bare(""))]
        plain = _PLAIN(chunk)
        if not plain:
            return [at + chunk.encode()]
        word, marks = plain.groups()
        word = at + (word.lower() if self.lowers else word).encode()
        return [word, self._bare(marks)] if marks else [word]


def _runs(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat[begin:begin + count]`` of every run in turn, and the ends of the runs after 0."""
    ends = np.concatenate([[0], np.cumsum(count)])
    index = np.repeat(begin - ends[:-1], count)
    index += np.arange(len(index))
    return flat[index], ends


def _gathered(
    data: np.ndarray, starts: np.ndarray, size: np.ndarray, first: np.ndarray, lower: np.ndarray | None = None
) -> pa.Array:
    """Runs of bytes as an array, with ``FIRST`` before those of ``first``; Latin letters
    of the runs of ``lower`` in lower case."""
    flat, ends = _runs(data, starts, size)
    if lower is not None and len(flat):
        low = np.where((flat >= 0x41) & (flat <= 0x5A), flat + 32, flat)
        after = np.concatenate([[False], flat[:-1] == 0xC3])
        low = np.where(after & (flat >= 0x80) & (flat <= 0x9E) & (flat != 0x97), flat + 32, low)
        flat = np.where(np.repeat(lower, size), low, flat)
    offsets = ends + np.concatenate([[0], np.cumsum(first)])
    out = np.full(int(offsets[-1]), FIRST[0], dtype=np.uint8)
    out[np.arange(len(flat)) + np.repeat(np.cumsum(first), size)] = flat
    buffers = [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers)


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *map(len, lists)])
    return np.array([i for x in lists for i in x], dtype="<u4"), ends


# A word of Latin-1 letters and closing marks that never join its piece; an apostrophe may.
_PLAIN = re.compile(
    "([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?*#$%&|]*)"
).fullmatch


# Such a word alone as bytes, with the blank before it.
_STEM = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc2[\xaa\xb5\xba])+").fullmatch

# The same for bytes: letters, two-byte letters by both bytes, marks, visible ASCII.
_LETTER, _MARK, _VISIBLE, _TWO = (np.zeros(k, dtype=bool) for k in (256, 256, 256, 1 << 16))
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[list(b".,;:!?*#$%&|")] = True
_VISIBLE[0x21:0x7F] = True
_TWO[[c for c in range(0xC380, 0xC3C0) if c not in (0xC397, 0xC3B7)] + [0xC2AA, 0xC2B5, 0xC2BA]] = True


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes
    for themselves, the others in order from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


def _stands_alone(chunk: str) -> bool:
    """Whether blanks around the chunk are cuts: it neither starts nor ends in white space.

    Line breaks inside it do no harm. ``isprintable`` is false for all white
    space but the blank, which a chunk doesn't hold; no special token may span it.
    """
    return chunk != "" and (chunk[0] + chunk[-1]).isprintable()
