"""Statistics of one text that the quality operators learn from."""

from __future__ import annotations

import numpy as np

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"

#: The columns of ``features`` in order; ratios are per word, per letter or per character as named.
FEATURES = (
    "log_words", "mean_word_chars", "symbols_per_word", "duplicate_line_share", "repeated_word_share", "distinct_word_share", "top_word_share",
    "upper_share", "digit_share", "letter_share", "exclamations_per_word", "stops_per_word", "commas_per_word", "words_per_line", "pipes_per_word",
    "symbol_word_share", "long_word_share", "quotes_per_word",
)


def repeat_words(ids: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more, the first occurrence included."""
    n = len(ids)
    if n <= width:
        return 0
    # pack ids into one exact code per window: ranks of ever longer windows, each rank below n
    code = ids.astype(np.int64)
    have, base = 1, int(ids.max()) + 1
    while have < width:
        step = min(have, width - have)
        left, right = code[: len(code) - step], code[step:]  # two windows of `have` words that cover have + step
        both = left * base + right
        have += step
        if have < width:
            _, code = np.unique(both, return_inverse=True)
            base = int(code.max()) + 1
        else:
            code = both
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = counts[inverse] >= 2
    if not starts.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.nonzero(starts)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def base_statistics(text: str | None) -> tuple[dict[str, int], list[bytes], np.ndarray, bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, with the words, their ids and the bytes. Null is the empty text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    base = {
        "n_words": len(words),
        "word_chars": len(text) - (len(data) - len(data.translate(None, SPACES))),
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(ids),
    }
    return base, words, ids, data


def describe(text: str | None) -> tuple[dict[str, int], np.ndarray]:
    """(base statistics, feature vector); the empty text has zeros throughout."""
    base, words, ids, data = base_statistics(text)
    n = base["n_words"]
    if not n:
        return base, np.zeros(len(FEATURES))
    bytes_of = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    upper, lower, digits = int(bytes_of[65:91].sum()), int(bytes_of[97:123].sum()), int(bytes_of[48:58].sum())
    other = int(bytes_of[192:].sum())  # first bytes of characters outside ASCII
    letters = upper + lower + other
    per = lambda c: bytes_of[ord(c)] / n
    lines = data.count(b"\n") + 1
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    marked = sum(map(bytes_of.__getitem__, SYMBOLS)) and sum(1 for w in words if w[-1] in SYMBOLS or w[0] in SYMBOLS)
    x = (
        np.log1p(n), base["word_chars"] / n, base["n_symbols"] / n, base["n_dup_lines"] / lines, base["n_repeat_words"] / n, (int(ids.max()) + 1) / n,
        np.bincount(ids).max() / n, upper / max(letters, 1), digits / max(base["word_chars"], 1), letters / max(base["word_chars"], 1), per("!"), per("."), per(","), n / lines, per("|"),
        marked / n, float((lengths > 20).mean()), (bytes_of[34] + bytes_of[39]) / n,
    )
    return base, np.array(x, dtype=np.float64)
