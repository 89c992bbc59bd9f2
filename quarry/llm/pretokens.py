"""Cuts a text where the byte-level pattern of the public tokenizers cuts it
(contractions, letters, numbers, other marks, white space; a blank goes with what
follows it), with array operations on code points in place of a regular expression."""

from __future__ import annotations

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
SINGLE = {ord(x) for x in "stmd"}
DOUBLE = {(ord(x), ord(y)) for x, y in ("re", "ve", "ll")}
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point, by Unicode category."""
    if not _CLASSES:
        import regex

        at = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)  # without surrogates
        every = at.tobytes().decode("utf-32-le")
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                out[at[m.start():m.end()]] = kind
        _CLASSES.append(out)
    return _CLASSES[0]


def starts(codes: np.ndarray) -> np.ndarray:
    """Where the matches start; they follow each other without gaps."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    run = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    end = np.append(run[1:], n)
    what = kind[run]
    blank = codes == 32
    body = run[what != SPACE]
    white, w_end = run[what == SPACE], end[what == SPACE]
    lead = blank[body - 1] & (body > 0)
    mark = np.zeros(n + 1, bool)
    mark[body - lead] = True
    last = w_end == n
    mark[white[last | (w_end - white > 1)]] = True  # all but the last character before a word
    mark[w_end[~last & ~blank[w_end - 1]] - 1] = True
    # 's 't 'm 'd 're 've 'll right behind a match, without a blank before them
    quotes = body[(codes[body] == 39) & ~lead]
    for q in quotes[quotes + 1 < n].tolist():
        a, b = codes[q + 1], codes[q + 2] if q + 2 < n else 0
        size = 1 if a in SINGLE else 2 if (int(a), int(b)) in DOUBLE else 0
        if size:
            mark[q + 1] = False
            mark[q + 1 + size] |= q + 1 + size < n and kind[q + 1 + size] == LETTER
    return np.flatnonzero(mark[:n])


def pretokens(text: str) -> list[str]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = starts(codes).tolist()
    return [text[a:b] for a, b in zip(at, at[1:] + [len(text)])]
