"""Secret scan: known forms, and strings that a battery of randomness tests calls random.

The known forms are assignments, access keys and hexadecimal runs. Other long
strings are tested in the alphabet of their inferred encoding; a run that no encoding
holds, such as a path with both / and -, is tested by its parts. Against "drawn
evenly from the alphabet" stand a chi-squared test of even use, a runs test and a
test of serial correlation, combined by Fisher's method: ordered or repetitive
strings fail it. Against "written like the corpus" stands the chi-squared value
itself, whose distribution follows from the symbol counts of all documents and
the length: prose is far from even use. A string counts as a secret if it passes
the first and if the second is rejected under control of the false discovery rate
over all strings of the corpus, with p-values weighted by length, as short strings
can show less. P-values are rounded up to a fixed grid, so that the threshold comes
from a histogram.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import Words, slices
from plumbline.session import materialize

LEAST = 20  # characters of a tested string
EVEN_LEVEL = 1e-3  # below it a string is not random
FALSE_RATE = 0.01
GRID = 20  # grid points of a p-value per power of ten
GRID_END = 1200

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
STRING = re.compile(r"[A-Za-z0-9+/_-]{%d,}=*" % LEAST)
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
# Inferred encodings, the narrowest first; a string has the first that holds it.
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _LOWER.upper() + "234567",
    "lower": _LOWER + _DIGITS,
    "upper": _LOWER.upper() + _DIGITS,
    "base62": _DIGITS + _LOWER.upper() + _LOWER,
    "base64": _LOWER.upper() + _LOWER + _DIGITS + "+/",
    "base64url": _LOWER.upper() + _LOWER + _DIGITS + "-_",
}
_SYMBOLS = {name: {c: i for i, c in enumerate(chars)} for name, chars in ENCODINGS.items()}


def encoding_of(string: str) -> str | None:
    used = set(string)
    return next((n for n, s in _SYMBOLS.items() if used <= s.keys()), None)


def tested_parts(string: str) -> list[tuple[int, int]]:
    """(start, end) of what is tested of a run: all of it if an encoding holds it, or else
    its parts between separators of at least LEAST characters.

    Parts between / and -, and if no encoding holds them between _ as well, are the finest.
    Parts between - and _ (base64) and between + and / (base64url) may overlap these, so
    that a key that holds a separator itself is tested whole too.
    """
    if encoding_of(string):
        return [(0, len(string))]
    out = set()
    for separators in ("/-", "-_", "+/"):
        for m in re.finditer(f"[^{separators}]+", string):
            parts = [m.span()]
            if not encoding_of(m.group()):
                parts = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer("[^_]+", m.group())]
            out.update((a, b) for a, b in parts if b - a >= LEAST)
    return sorted(out)


def _upper(z: float) -> float:
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def battery(string: str, encoding: str, corpus: np.ndarray) -> tuple[float, float]:
    """(p against even and independent symbols, p against prose) of a string.

    ``corpus`` holds the counts of the bytes in all documents.
    """
    symbols = _SYMBOLS[encoding]
    values = np.array([symbols[c] for c in string])
    n, size = len(values), len(symbols)
    counts = np.bincount(values, minlength=size)
    chi = float((counts.astype(float) ** 2).sum() * size / n - n)
    even = _upper((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    high = values >= size / 2
    a, b = int(high.sum()), int((~high).sum())
    runs = 1.0
    if a and b:
        mean = 2 * a * b / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        seen = 1 + int((high[1:] != high[:-1]).sum())
        runs = min(1.0, 2 * _upper(abs(seen - mean) / math.sqrt(spread))) if spread > 0 else 1.0
    else:
        runs = 0.5 ** (n - 1)
    centred = values - values.mean()
    power = float((centred**2).sum())
    serial = 1e-300
    if power > 0:
        r = float((centred[1:] * centred[:-1]).sum()) / power
        serial = min(1.0, 2 * _upper(abs(r + 1 / n) * math.sqrt(n)))
    half = -sum(math.log(max(p, 1e-300)) for p in (even, runs, serial))
    random = math.exp(-half) * (1 + half + half * half / 2)
    share = np.array([corpus[ord(c)] + 1.0 for c in ENCODINGS[encoding]])
    share /= share.sum()
    square = float((share**2).sum())
    mean = size * (1 + (n - 1) * square) - n
    spread = 4 * n * size**2 * (float((share**3).sum()) - square**2) + 2 * size**2 * square**2
    prose = _upper((mean - chi) / math.sqrt(spread / 1.0)) if spread > 0 else 1.0
    return random, prose


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the known forms, leftmost and non-overlapping per
    kind; a match that is too short is dropped after it took its place."""
    out = [
        (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN
    ]
    for kind, pattern, least in ((1, ACCESS, LEAST_ACCESS), (2, HEX, LEAST_HEX)):
        out += [
            (m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= least
        ]
    return sorted(out)


def byte_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How often each byte occurs in all texts; 256 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            for _, part in slices(batch.column(0)):
                total += np.bincount(Words(part).data, minlength=256)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"]
        )

    found = docs.select(F.col(text).cast("string")).mapInArrow(run, "byte long, n long")
    out = np.zeros(256, dtype=np.int64)
    for r in found.groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def found_strings(docs: DataFrame, corpus: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """(doc_id, base, tested): spans of known forms, and tested strings with both p-values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, tested = [], []
            for _, part in slices(batch.column(1)):
                words = Words(part)
                size = words.ends - words.starts
                longest = np.zeros(len(part), dtype=np.int64)
                np.maximum.at(longest, words.owner, size)
                low = pc.utf8_lower(pc.fill_null(part, ""))
                named = np.zeros(len(part), dtype=bool)
                for k in KEYWORDS:
                    named |= pc.match_substring(low, k).to_numpy(zero_copy_only=False)
                # Every form but the assignment is inside one long word.
                look = named | (longest >= LEAST_HEX)
                for i in range(len(part)):
                    spans, strings = [], []
                    if look[i]:
                        body = part[i].as_py()
                        spans = base_spans(body)
                        taken = [(a, b) for a, _, b in spans]
                        for m in STRING.finditer(body) if longest[i] >= LEAST else ():
                            string = m.group().rstrip("=")
                            for x, y in tested_parts(string):
                                inner = string[x:y]
                                a, b = m.start() + x, m.end() if y == len(string) else m.start() + y
                                if not any(a < v and u < b for u, v in taken):
                                    even, prose = battery(inner, encoding_of(inner), corpus)
                                    strings.append((a, b, even, prose))
                    base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                    tested.append(
                        [{"start": a, "end": b, "even": e, "prose": p} for a, b, e, p in strings]
                    )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, _BASE), pa.array(tested, _TESTED)],
                names=["doc_id", "base", "tested"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string")).mapInArrow(
        run,
        "doc_id long, base array<struct<start: long, kind: int, end: long>>,"
        " tested array<struct<start: long, end: long, even: double, prose: double>>",
    )


_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_TESTED = pa.list_(
    pa.struct(
        [("start", pa.int64()), ("end", pa.int64()), ("even", pa.float64()), ("prose", pa.float64())]
    )
)


def threshold(found: DataFrame, rate: float = FALSE_RATE) -> tuple[float, int]:
    """(mean weight, first grid point that counts): Benjamini and Hochberg's step-up rule
    over all tested strings; at most GRID_END + 1 counts come to the driver."""
    strings = found.select(F.explode("tested").alias("t")).select(
        F.sqrt((F.col("t.end") - F.col("t.start")) / LEAST).alias("w"), "t.prose", "t.even"
    )
    mean, total = strings.agg(F.avg("w"), F.count(F.lit(1))).first()
    if not total:
        return 1.0, GRID_END + 1
    q = F.least(F.lit(1.0), F.col("prose") * mean / F.col("w"))
    point = F.floor(-GRID * F.log10(F.greatest(q, F.lit(1e-300))))
    point = F.greatest(F.lit(0), F.least(F.lit(GRID_END), point)).cast("int")
    # Strings that fail the other tests are no discoveries, but they count as tested.
    point = F.when(F.col("even") >= EVEN_LEVEL, point).otherwise(0)
    rows = {r["point"]: r["n"] for r in
            strings.groupBy(point.alias("point")).agg(F.count(F.lit(1)).alias("n")).collect()}
    upto, first = 0, GRID_END + 1
    for k in range(GRID_END, -1, -1):
        upto += rows.get(k, 0)
        if rows.get(k) and 10 ** (-k / GRID) * total <= rate * upto:
            first = k
    return mean, first


def find_secrets(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rate: float = FALSE_RATE
) -> DataFrame:
    """(doc_id, spans) of every row: spans (kind, start, end) by start, then kind.

    Places are code points, ends exclusive. A null text is an empty one and has no
    spans; rows that repeat stay; an empty table gives no rows. A random string that
    touches a known form is not told again; of parts that hold one another the smallest
    that counts is told.
    """
    # Written once: the threshold and the result read the same strings.
    found = materialize(found_strings(docs, byte_counts(docs, text), doc_id, text), "strings")
    mean, first = threshold(found, rate)
    length = lambda t: (t["end"] - t["start"]) / LEAST
    point = lambda t: F.floor(
        -GRID
        * F.log10(F.greatest(F.least(F.lit(1.0), t["prose"] * mean / F.sqrt(length(t))), F.lit(1e-300)))
    )
    random = F.filter("tested", lambda t: (t["even"] >= EVEN_LEVEL) & (F.least(F.lit(GRID_END), point(t)) >= first))
    random = F.filter(
        random,
        lambda t: ~F.exists(
            random,
            lambda o: (o["start"] >= t["start"]) & (o["end"] <= t["end"])
            & (o["end"] - o["start"] < t["end"] - t["start"]),
        ),
    )
    random = F.transform(
        random,
        lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(
        F.array_sort(F.concat("base", random)),
        lambda s: F.struct(
            F.element_at(names, s["kind"] + 1).alias("kind"),
            s["start"].alias("start"), s["end"].alias("end"),
        ),
    )
    return found.select("doc_id", spans.alias("spans"))
