"""Statistics of whole texts, vectorised over a slice of rows."""

from __future__ import annotations

import numpy as np

from . import text as T

#: Symbols that count as such in quality rules.
SYMBOLS = b"#*$%&|<>"


def _flags(chars: bytes) -> np.ndarray:
    f = np.zeros(256, bool)
    f[list(chars)] = True
    return f


_SYMBOL, _UPPER, _DIGIT, _LEAD = _flags(SYMBOLS), _flags(bytes(range(65, 91))), _flags(b"0123456789"), np.array([b & 0xC0 != 0x80 for b in range(256)])
_PUNCT = _flags(bytes(b for b in range(33, 127) if not chr(b).isalnum()))


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def _first_seen(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of (row, key) pairs in order, which are equal to an earlier one."""
    tagged = T.mix(keys + T.mix(rows.astype(T.U) + T.U(1)))
    seen = np.ones(len(tagged), bool)
    seen[np.unique(tagged, return_index=True)[1]] = False
    return seen


def text_stats(buf: np.ndarray, offs: np.ndarray, n_gram: int = 3) -> dict[str, np.ndarray]:
    """Counts for each row.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with
    a word, equal to an earlier line of the row), n_repeat_words (words in n-word
    windows found twice or more in the row), n_upper, n_digits, n_punct,
    n_distinct (distinct words), n_long (words of over 12 bytes), n_lines, n_chars.
    """
    w = T.Words(buf, offs, T.PLAIN)
    n, row = np.diff(w.rows), w.row_of()
    sep = T.PLAIN[0]
    out = {"n_words": n, "word_chars": per_row(_LEAD[buf] & ~sep[buf], offs), "n_chars": per_row(_LEAD[buf], offs)}
    for name, flags in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_punct", _PUNCT)):
        out[name] = per_row(flags[buf], offs)

    # lines: they begin at a row's start and after each \n
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    line_row = np.searchsorted(offs[1:], starts, side="right")
    ok = (line_row < len(n)) & (starts < len(buf)) if len(buf) else np.zeros(len(starts), bool)
    starts, line_row = np.unique(starts[ok]), None
    line_row = np.searchsorted(offs, starts, side="right") - 1
    next_break = np.concatenate([breaks, [len(buf)]])[np.searchsorted(breaks, starts)]
    ends = np.minimum(next_break, offs[1:][line_row]) if len(starts) else starts
    worded = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_row = starts[worded], ends[worded], line_row[worded]
    dup = _first_seen(line_row, T.spans_hash(T.prefix(buf), starts, ends))
    out["n_dup_lines"] = np.bincount(line_row[dup], minlength=len(n))
    out["n_lines"] = np.bincount(line_row, minlength=len(n))

    windows = T.rolling(w.hash, n_gram)
    at = np.flatnonzero(T.starts_inside(w.rows, n_gram, len(windows)))
    tagged = T.mix(windows[at] + T.mix(row[at].astype(T.U) + T.U(1)))
    _, back, times = np.unique(tagged, return_inverse=True, return_counts=True)
    again = at[times[back] > 1]
    out["n_repeat_words"] = per_row(T.covered(again, n_gram, len(row)), w.rows)
    out["n_distinct"] = n - np.bincount(row[_first_seen(row, w.hash)], minlength=len(n))
    out["n_long"] = per_row((w.end - w.start) > 12, w.rows)
    return out
