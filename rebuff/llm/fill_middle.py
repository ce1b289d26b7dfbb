"""Fill-in-the-middle transformation: texts cut at drawn unit boundaries and put in another order.

A unit is a word with the ASCII white space before it, or the white space that ends a text. Cuts are found
word-parallel: the texts of an Arrow batch are viewed as 64-bit words of eight bytes, the last byte of every
unit is marked by arithmetic on whole words, marks are counted per word with ``bitwise_count``, a cumulative
count is searched for the word that holds the wanted mark, and a multiplication selects it inside the word.
Only the offsets come back from Python; Spark cuts, orders, and puts texts together again by columns.

Defined cases: null text counts as empty, has no units and stays plain; a text that holds a marker stays plain;
white space alone is one unit; a null id draws like an empty one; rows that repeat an id draw the same numbers, so
equal rows get equal results; an empty table gives no rows. Only ``keep`` and the result struct are returned, so
no other column of the input can clash with either.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
CUTS = "n long, prefix_bytes long, middle_bytes long, prefix_chars long, middle_chars long"

_ONES = np.uint64(0x0101010101010101)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)
_U = np.uint64


def space_marks(x: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is one of the six ASCII white-space characters. No sum below leaves its byte."""
    low = x & _LOW
    blank = x ^ (_U(0x20) * _ONES)
    blank = ~(((blank & _LOW) + _LOW) | blank)
    control = (low + _U(0x80 - 0x09) * _ONES) & ~(low + _U(0x80 - 0x0E) * _ONES) & ~x
    return (blank | control) & _HIGH


class Marks:
    """Marked bytes of a word array: how many lie before a byte, and where the k-th one is."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, below = at >> 3, (_U(1) << ((at & 7) << 3).astype(np.uint64)) - _U(1)
        return self.before[word] + np.bitwise_count(self.bits[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th mark, counted from 1 over the whole array."""
        word = np.searchsorted(self.before, k, side="left") - 1
        inside = (k - self.before[word]).astype(np.uint64)
        counts = (self.bits[word] >> _U(7)) * _ONES             # byte i: marks in bytes 0 to i
        reached = ((counts | _HIGH) - inside * _ONES) & _HIGH   # bytes with enough of them
        return (word << 3) + 8 - np.bitwise_count(reached)


def cut_points(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """The columns of ``CUTS`` for the texts ``data[bounds[i]:bounds[i + 1]]``."""
    starts, ends = bounds[:-1], bounds[1:]
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[:len(data)] = data
    x = padded.view("<u8")
    space = space_marks(x)
    following = space >> _U(8)
    following[:-1] |= space[1:] << _U(56)
    unit_end = ~space & _HIGH & following
    last = ends[ends > starts] - 1              # a text's last byte always ends a unit
    np.bitwise_or.at(unit_end, last >> 3, _U(0x80) << ((last & 7) << 3).astype(np.uint64))
    units, tails = Marks(unit_end), Marks(x & ~(x << _U(1)) & _HIGH)      # tails: UTF-8 continuation bytes
    zero = units.rank(starts)
    n = units.rank(ends) - zero
    a, b = first % (n + 1), second % (n + 1)

    def cut(k: np.ndarray) -> np.ndarray:
        at = starts.copy()
        some = k > 0
        at[some] = units.select(zero[some] + k[some]) + 1
        return at
    p, m = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    at_start, at_p, at_m = tails.rank(starts), tails.rank(p), tails.rank(m)
    return [n, p - starts, m - p, (p - starts) - (at_p - at_start), (m - p) - (at_m - at_p)]


def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    text = text.fill_null("") if text.null_count else text
    wide = pa.types.is_large_string(text.type)
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.empty(0, np.uint8)
    columns = cut_points(raw, bounds - bounds[0], first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in CUTS.split(", ")])


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from a key: 32-bit groups of a SHA-256."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, column: str = "text", key: str = "doc_id", seed: int = SEED, fim_percent: int = FIM_PERCENT,
                   spm_percent: int = SPM_PERCENT, keep: tuple[str, ...] = ("doc_id",), output: str = "fim") -> DataFrame:
    """``keep`` plus a struct ``output``: n (units), form (plain, psm or spm), text, prefix_chars and middle_chars (null if plain)."""
    if output in keep:
        raise ValueError(f"{output} is both kept and the result")
    cuts = F.arrow_udf(_cuts, CUTS)
    h1, h2, h3, h4 = draws(F.col(key), seed)
    text = F.coalesce(F.col(column), F.lit(""))
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= fim_percent)
    d = docs.select(F.struct(*keep).alias("k"), text.alias("t"), F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm").alias("form"), h1.alias("h1"), h2.alias("h2"))
    d = d.withColumn("c", cuts("t", "h1", "h2"))
    raw = F.col("t").cast("binary")
    part = lambda start, size: F.substr(raw, (start + 1).cast("int"), size.cast("int")).cast("string")
    p, m = F.col("c.prefix_bytes"), F.col("c.middle_bytes")
    prefix, middle, suffix = part(F.lit(0), p), part(p, m), part(p + m, F.octet_length("t") - p - m)
    joined = F.when(F.col("form") == "plain", F.col("t")) \
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)) \
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    moved = F.col("form") != "plain"
    return d.select(*[F.col("k")[c].alias(c) for c in keep], F.struct(
        F.col("c.n").alias("n"), "form", joined.alias("text"), F.when(moved, F.col("c.prefix_chars")).alias("prefix_chars"),
        F.when(moved, F.col("c.middle_chars")).alias("middle_chars")).alias(output))


def restore(text: Column, form: Column) -> Column:
    """The text before the transformation. A moved text holds each marker once, since texts with markers stay plain."""
    parts = F.split(text, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", text).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
