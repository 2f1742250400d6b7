"""Chat formatting with loss masks that are aligned to tokens by offsets.

A turn is rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>``. The three marks are
special tokens, so no token spans a mark; the same strings inside a role or a text, and
the tokenizer's own special tokens, get a backslash after ``<|`` (one more where there
are some already), which reading takes away again. A conversation is rendered whole and
encoded once with offsets, and the places of the assistant's texts are found among the
sorted token spans by binary search.

Turns are dealt by ranges of (conversation, turn), so a conversation that holds a large
part of all rows is cut between turns into several rows of the output; as marks are cuts
for the tokenizer too, its ids are those of the conversation encoded in one piece.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ROLE = "assistant"  # whose texts are learned
SEGMENT_CHARS = 1 << 16  # a rendering is cut after the turn that reaches this
BATCH_CHARS = 1 << 22
SCHEMA = "conv_id long, segment long, whole boolean, n_turns long, formatted_chars long, ids binary, loss array<int>"


class Template:
    """Rendering, encoding and reading back for one vocabulary file.

    The vocabulary must be byte-level, as only such ids give the text back.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

        tok = Tokenizer.from_file(path)
        own = [t.content for t in tok.get_added_tokens_decoder().values()]
        tok.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (START, SEP, END)])
        tok.post_processor = processors.ByteLevel(trim_offsets=False)  # a token owns its blanks
        self.tokenizer = tok
        self.controls = sorted({START, SEP, END, *own})
        named = [c[2:-2] for c in self.controls if c.startswith("<|") and c.endswith("|>")]
        if len(named) < len(self.controls):
            raise ValueError("special tokens must have the form <|name|>")
        names = "|".join(map(re.escape, named))
        self._plain = re.compile(rf"<\|(\\*)({names})\|>")
        self._escaped = re.compile(rf"<\|\\(\\*)({names})\|>")
        alphabet = _byte_alphabet()
        if not set(pre_tokenizers.ByteLevel.alphabet()) == set(alphabet):
            raise ValueError("a byte-level alphabet is needed")
        size = tok.get_vocab_size(with_added_tokens=True)
        added = tok.get_added_tokens_decoder()
        self.bytes = [
            added[i].content.encode() if i in added
            else bytes(alphabet[c] for c in tok.id_to_token(i)) for i in range(size)
        ]
        self.kind = "<u2" if size <= 1 << 16 else "<u4"

    def escape(self, text: str) -> str:
        return self._plain.sub(r"<|\\\1\2|>", text) if "<|" in text else text

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"<|\1\2|>", text) if "<|" in text else text

    def render(self, turns: list[tuple[str, str]], role: str = ROLE) -> tuple[str, list[tuple[int, int]]]:
        """(rendering, places of the texts of ``role`` in it, in order)."""
        parts, spans, at = [], [], 0
        for who, text in turns:
            head = f"{START}{self.escape(who)}{SEP}"
            body = self.escape(text)
            if who == role:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, END]
            at += len(head) + len(body) + len(END)
        return "".join(parts), spans

    def encode(self, rendered: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[int]]:
        """(ids, first and end token of every span, one after another)."""
        got = self.tokenizer.encode(rendered, add_special_tokens=False)
        offsets, loss = got.offsets, []
        for begin, end in spans:
            # Tokens that share a character have equal starts or follow at once: the
            # first with a start at or after a place is the first one beyond it.
            first = bisect_left(offsets, (begin,))
            last = bisect_left(offsets, (end,), first)
            assert (first == 0 or offsets[first - 1][1] <= begin) and (last == first or offsets[last - 1][1] <= end)
            loss += [first, last]
        return np.array(got.ids, dtype=self.kind), loss

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()

    def turns(self, rendered: str) -> list[tuple[str, str]]:
        """The (role, text) of every turn of a rendering."""
        out = []
        for turn in rendered.split(END)[:-1]:
            who, text = turn[len(START) :].split(SEP)
            out.append((self.unescape(who), self.unescape(text)))
        return out


def _byte_alphabet() -> dict[str, int]:
    """Byte of each character that stands for one in byte-level vocabularies: printable
    ones for themselves, the others in order from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@lru_cache(maxsize=4)
def template(path: str) -> Template:
    return Template(path)


def formatted(
    rows: DataFrame, path: str, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", learned: str = ROLE, segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """Rows (conv_id, segment, whole, n_turns, formatted_chars, ids, loss), most
    conversations in one row; the segments of one, in order, are its whole rendering.

    ``ids`` are little-endian unsigned integers, of two bytes where the vocabulary fits.
    ``loss`` holds first and end token of every text of role ``learned``, which alone are
    learned. Rows go by turn (null first), equal turns by role and text; rows that repeat
    are turns each. A null text or role counts as empty, rows without conv_id are one
    conversation; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, part = template(path), TaskContext.get().partitionId()
        held: list[dict] = []
        turns: list[tuple[str, str]] = []
        last, count, chars, first_of_task, done = None, 0, 0, True, 0

        def close(whole: bool) -> int:
            nonlocal turns, chars
            rendered, spans = form.render(turns, learned)
            ids, loss = form.encode(rendered, spans)
            held.append(
                {
                    "conv_id": last, "segment": (part << 32) | count, "whole": whole, "n_turns": len(turns),
                    "formatted_chars": len(rendered), "ids": ids.tobytes(), "loss": loss,
                }
            )
            turns, chars = [], 0
            return len(rendered)

        def given():
            nonlocal held
            out, held = pa.RecordBatch.from_pylist(held, _ARROW), []
            return out

        for batch in batches:
            for conv, who, said in zip(*(c.to_pylist() for c in batch.columns)):
                if (turns or count) and conv != last:
                    if turns:
                        # Complete here, unless it is the task's first one or has earlier segments.
                        done += close(not first_of_task and count == 0)
                    first_of_task, count = False, 0
                last = conv
                turns.append((who, said))
                chars += len(said)
                if chars >= segment_chars:
                    done += close(False)
                    count += 1
                if done >= BATCH_CHARS:
                    done = 0
                    yield given()
        if turns:
            close(False)
        yield given()

    by = [F.col(c).asc_nulls_first() for c in ("_conv", "_turn", "_role")]
    named = rows.select(
        F.col(conv_id).cast("long").alias("_conv"), F.col(turn).cast("long").alias("_turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "_role"), (text, "_text"))],
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The bounds of the ranges hold the beginning of a text only; its order is the text's.
    dealt = named.repartitionByRange(n, *by, F.substring("_text", 1, 32))
    dealt = dealt.sortWithinPartitions(*by, "_text")
    return dealt.select("_conv", "_role", "_text").mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("segment", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()),
        ("formatted_chars", pa.int64()), ("ids", pa.binary()), ("loss", pa.list_(pa.int32())),
    ]
)


def read_turns(out: DataFrame, path: str) -> DataFrame:
    """(conv_id, segment, place, role, text, loss) of every turn, read from ``ids``;
    ``loss`` tells whether the text is under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = template(path)
        for batch in batches:
            rows = []
            for conv, segment, data, loss in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(data, form.kind)
                ends = np.cumsum([0, *(len(form.bytes[i]) for i in ids.tolist())])
                masked = {int(ends[a]) for a in loss[::2]}
                at = 0
                for k, (who, said) in enumerate(form.turns(form.decode(ids))):
                    at += len((START + form.escape(who) + SEP).encode())
                    rows.append((conv, segment, k, who, said, at in masked))
                    at += len((form.escape(said) + END).encode())
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()))],
                names=["conv_id", "segment", "place", "role", "text", "loss"],
            )

    return out.select("conv_id", "segment", "ids", "loss").mapInArrow(
        run, "conv_id long, segment long, place int, role string, text string, loss boolean"
    )


def digests(out: DataFrame, path: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per
    conversation, read back from ``ids`` and ``loss`` of ``formatted``'s rows.

    Conversations in one row are read where they lie. The segments of the others meet in
    order and are hashed one after another: a digest needs its text in turn, but a task
    holds one segment at a time.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = template(path)
        open_, some = None, []  # [conv_id, turns, hash of turns, loss characters, hash, characters]

        def told(rows):
            data = [[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in data], t) for i, t in enumerate(kinds)], names=names
            )

        for batch in batches:
            for conv, whole, data, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or whole or open_[0] != conv:
                    if open_ is not None:
                        some.append(open_)
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(data, form.kind)
                rendered = form.decode(ids)
                for who, said in form.turns(rendered):
                    open_[1] += 1
                    open_[2].update(f"{who}\n{said}\n".encode())
                for a, b in zip(loss[::2], loss[1::2]):
                    said = form.unescape(form.decode(ids[a:b]))
                    open_[3] += len(said)
                    open_[4].update(said.encode())
                open_[5] += len(rendered)
            if some:
                yield told(some)
                some = []
        yield told([open_] if open_ is not None else [])

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ["conv_id", "whole", "ids", "loss"]
    here = out.where("whole").select(*columns).mapInArrow(run, kinds)
    cut = out.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return here.unionByName(cut.select(*columns).mapInArrow(run, kinds))
