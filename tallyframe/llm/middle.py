"""Fill-in-the-middle documents, cut by rank queries on a wavelet matrix.

A text is cut at units: runs of ASCII letters, and every other character alone.  The bytes of a batch of
texts (UTF-8, one after another) fall into four classes: the later bytes of a character, letters
inside a run, other characters, and letters that start a run.  A wavelet matrix over the classes answers
how often a class occurs before a position.  The ranks of the last two classes together count the units that start
there; the rank of the first turns bytes into characters.  A cut after m units is the largest position
with at most m starts before it, found by bisection on the ranks for all texts of the batch at once.

The cuts are drawn from the hash of the document's id, so reruns and repeated rows agree and no state is shared.
Texts go to Python once and only three numbers a row return; outputs are put together in the JVM.
A task holds one matrix of at most ``BYTES`` bytes of text, or of one text if that is longer (about twice its bytes).

Defined cases: null text is empty; an empty text and one that contains a sentinel stay plain; a null id is
hashed as an empty string; ties between the two cuts leave an empty middle; repeated rows and rows that share an id
pass through row by row; an empty table gives an empty table; the columns of the input are not returned, so extra
columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

SENTINELS = ("<P>", "<S>", "<M>")
TAIL, INSIDE, OTHER, START = range(4)
#: Bytes of text in one matrix.
BYTES = 1 << 24
CUT_TYPE = "n long, prefix_chars long, middle_chars long"


class Bits:
    """A bit vector with constant-time ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype="<u8")
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Ranks of small symbols, one bit vector for each bit of a symbol, the highest first."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.size, self.rows = len(symbols), []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            ones = bits.astype(bool)
            self.rows.append((level, len(bits) - int(ones.sum()), Bits(bits)))
            if level:
                symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before each position."""
        low, high = np.zeros(1, dtype=np.int64), np.asarray(at, dtype=np.int64)
        for level, zeros, bits in self.rows:
            a, b = bits.rank(low), bits.rank(high)
            low, high = (zeros + a, zeros + b) if symbol >> level & 1 else (low - a, high - b)
        return high - low


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte; ``starts`` are the positions at which texts start."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    first = starts[starts < len(data)]
    opens[first] = letter[first]
    out = np.full(len(data), OTHER, dtype=np.uint8)
    out[(data & 0xC0) == 0x80] = TAIL
    out[letter] = INSIDE
    out[opens] = START
    return out


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units, characters of the prefix and characters of the middle of each text."""
    start, end = offsets[:-1], offsets[1:]
    matrix = WaveletMatrix(classes(data, start), 2)

    def units(at: np.ndarray) -> np.ndarray:
        return matrix.rank(OTHER, at) + matrix.rank(START, at)

    def chars(at: np.ndarray) -> np.ndarray:
        return at - matrix.rank(TAIL, at)

    def after(m: np.ndarray) -> np.ndarray:
        """Position after the first ``m`` units of each text."""
        low, high, want = start.copy(), end.copy(), before + m
        for _ in range(int((end - start).max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            fits = units(mid) <= want
            low, high = np.where(fits, mid, low), np.where(fits, high, np.maximum(mid - 1, low))
        return low

    before = units(start)
    n = units(end) - before
    c1, c2 = h1 % (n + 1), h2 % (n + 1)
    first, second = after(np.minimum(c1, c2)), after(np.maximum(c1, c2))
    return n, chars(first) - chars(start), chars(second) - chars(first)


def _slices(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows with at most ``BYTES`` bytes, or of one row."""
    out, at = [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES, side="right")) - 1)
        out.append((at, to))
        at = to
    return out


def drawn(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """The cuts of a batch of texts (none null) as structs."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if len(text) and text.buffers()[2] else np.zeros(0, np.uint8)
    a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (h1, h2))
    parts = [cuts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], a[i:j], b[i:j]) for i, j in _slices(offsets)]
    columns = [np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in range(3)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "prefix_chars", "middle_chars"])


def hashes(id_value: Column, seed: int = 1) -> list[Column]:
    """The first four 32-bit groups of the hash of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_value.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of every row."""
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    h1, h2, h3, h4 = hashes(F.col("doc_id"), seed)
    cut = F.arrow_udf(drawn, CUT_TYPE)(F.col("text"), h1, h2)
    held = F.lit(False)
    for s in SENTINELS:
        held = held | F.contains("text", F.lit(s))
    plain = (F.col("text") == "") | held | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("cut", cut).select("doc_id", "text", "cut.*", form.alias("form"))
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.col("text").substr(F.lit(1), p), F.col("text").substr(p + 1, m)
    suffix = F.col("text").substr(p + m + 1, F.char_length("text"))
    pre, suf, mid = map(F.lit, SENTINELS)
    output = (F.when(F.col("form") == "plain", F.col("text"))
              .when(F.col("form") == "psm", F.concat(pre, prefix, suf, suffix, mid, middle))
              .otherwise(F.concat(suf, suffix, pre, prefix, mid, middle)))
    shown = [F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars")]
    return rows.select("doc_id", "n", "form", *shown, output.alias("output"))


def restore(form: Column, output: Column) -> Column:
    """The text from which ``output`` was made.  A cut text holds no sentinel, so each occurs once in its output."""
    def part(opens: str, closes: str | None) -> Column:
        rest = F.substring_index(output, opens, -1)
        return F.substring_index(rest, closes, 1) if closes else rest

    pre, suf, mid = SENTINELS
    return (F.when(form == "psm", F.concat(part(pre, suf), part(mid, None), part(suf, mid)))
            .when(form == "spm", F.concat(part(pre, mid), part(mid, None), part(suf, pre))).otherwise(output))
