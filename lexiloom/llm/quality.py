"""Quality rules by repetition coverage.

For several lengths n, a rolling hash over word numbers marks the n-grams that
occur again in the same text; the measure is the share of the text's word
characters that lie inside repeats after the first. Repeated lines and symbols
are measured the same way. Words get numbers per text, so 3-word windows are
packed exactly, whatever their number; longer windows use 64-bit polynomial hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .narrow import keep_rows

BASE = np.uint64(0x9E3779B97F4A7C15)
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Largest share that passes. Shares of characters for n-grams and lines, of words for symbols and shouting."""

    min_words: int = 50
    repeat_percent: int = 50
    gram_chars: dict[int, float] = field(default_factory=lambda: {5: 0.45, 7: 0.45, 10: 0.45})
    line_chars: float = 0.45
    symbols_per_word: float = 0.30
    shouted: float = 0.60


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "gram_share", "line_share", "shout_share"]


def repeated_words(numbers: np.ndarray, n: int, later_only: bool) -> np.ndarray:
    """A mask of the words in n-word windows found at least twice; later_only leaves out the first find."""
    windows = len(numbers) - n + 1
    mask = np.zeros(len(numbers), dtype=bool)
    if windows < 2:
        return mask
    x = numbers.astype(np.uint64)
    if n <= 3 and int(x.max(initial=0)) < 1 << 21:
        h = x[:windows].copy()
        for i in range(1, n):
            h = (h << np.uint64(21)) | x[i : windows + i]
    elif n <= 3:  # exact too: the first words' windows get numbers, then those with the last word
        h = x[:windows]
        for i in range(1, n):
            h = (np.unique(h, return_inverse=True)[1].astype(np.uint64) << np.uint64(32)) | x[i : windows + i]
    else:
        with np.errstate(over="ignore"):
            h = np.zeros(windows, dtype=np.uint64)
            for i in range(n):
                h = h * BASE + (x[i : windows + i] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    again = np.zeros(windows, dtype=bool)
    again[order[1:][same]] = True
    if not later_only:
        again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    if at.size:
        edge = np.zeros(len(numbers) + 1, dtype=np.int32)
        edge[at] += 1  # no position comes twice
        edge[at + n] -= 1
        mask = np.cumsum(edge[:-1]) > 0
    return mask


def measure(text: str | None, lengths: tuple[int, ...]) -> tuple:
    """The figures of COLUMNS of one text; gram_share per length."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, [0.0] * len(lengths), 0.0, 0.0
    seen: dict[bytes, int] = {}
    numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if raw.isascii():
        chars = np.fromiter(map(len, words), dtype=np.int64, count=n)
    else:
        own = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in seen), dtype=np.int64, count=len(seen))
        chars = own[numbers]
    total = int(chars.sum())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeat = 0 if len(seen) == n else int(repeated_words(numbers, 3, later_only=False).sum())
    shares = [0.0 if not repeat else float(chars[repeated_words(numbers, k, later_only=True)].sum()) / total for k in lengths]
    lines, dup, dup_chars, line_chars = set(), 0, 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            line_chars += len(line)
            if line in lines:
                dup += 1
                dup_chars += len(line)
            else:
                lines.add(line)
    return n, total, symbols, dup, repeat, shares, dup_chars / line_chars if line_chars else 0.0, shouted(text)


def shouted(text: str) -> float:
    """The share of capitals among the cased letters of a text."""
    low = text.lower()
    up = text.upper()
    if len(low) != len(text) or len(up) != len(text):
        return sum(c.isupper() for c in text) / max(1, sum(c.isupper() or c.islower() for c in text))
    a, x, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (text, low, up))
    return float((a != x).sum()) / max(1, int((x != b).sum()))


def judge(texts: Iterable[str | None], limits: Limits) -> list[np.ndarray]:
    """Columns of figures of one text or more; the last two are base_failed and kept."""
    lengths = tuple(sorted(limits.gram_chars))
    n, chars, symbols, dup, repeat, shares, line, shout = (np.array(x) for x in zip(*[measure(t, lengths) for t in texts], strict=True))
    base = (n < limits.min_words) | (100 * repeat > limits.repeat_percent * n)
    fine = (line <= limits.line_chars) & (symbols <= limits.symbols_per_word * n) & (shout <= limits.shouted)
    for i, k in enumerate(lengths):
        fine &= shares[:, i] <= limits.gram_chars[k]
    return [n, chars, symbols, dup, repeat, *[np.ascontiguousarray(shares[:, i]) for i in range(len(lengths))], line, shout, base, ~base & fine]


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """(id, measures, base_failed, kept) per row of ``docs``.

    Words are runs without ASCII white space; n_repeat_words counts the words in
    3-word windows found twice or more. base_failed: under ``min_words`` words, or
    over ``repeat_percent`` % of the words repeat. kept: not base_failed and every
    share within its limit. Null, empty and blank texts have no words and fail.
    A text's lines and n-grams are only compared within it, so repeated rows get
    the same verdict each. Extra columns are ignored; an empty table gives an
    empty result.
    """
    limits = limits or Limits()
    lengths = tuple(sorted(limits.gram_chars))
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"gram{n}_share" for n in lengths], "line_share", "shout_share", "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                figures = judge((t.as_py() for t in batch.column(1)), limits)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, figures)], names=names)

    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + "".join(f"gram{n}_share double, " for n in lengths) + "line_share double, shout_share double, base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the rules keep. Nothing is shuffled."""
    limits = limits or Limits()
    return keep_rows(docs, text_col, lambda texts: judge(texts, limits)[-1].tolist())
