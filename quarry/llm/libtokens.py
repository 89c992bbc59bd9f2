"""Token ids of the tokenizers library, one distinct word at a time.

Both vocabularies treat a text as a sequence of matches that do not influence each
other, so a text's ids are the ids of its parts one after the other. Texts are cut into
parts, the library encodes the parts not met lately, and the outputs are kept in two
generations of bounded size. Parts that are plain words are encoded many to a text, which
halves the library's work for each; where a word's ids end is told by the bytes that ids
stand for, or by the marks of word ends. For a vocabulary without case a plain word is
encoded in lower case, once for all its cases, and without the normalizer, which would
leave it as it is.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from .pretokens import pretokens

MAX_WORDS = 400_000
#: ASCII marks that follow a word as one match; an apostrophe may begin a match of its own.
MARKS = r"[!-&(-/:-@\[-`{-~]+"
#: Words that stay one match each, whatever plain words stand beside them.
PLAIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
TOGETHER = 128  # plain words encoded as one text


def words_between_blanks(text: str) -> list[str]:
    """For a vocabulary that drops white space; two blanks have an empty word between them."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def is_latin(text: str) -> bool:
    """Whether NFC leaves the text as it is and its characters have one lower case each."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds:
    """``encode``: a text's ids as unsigned 32-bit integers of the machine (little-endian on all of Spark's)."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        tokens = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        if self._keeps_blanks():  # byte-level: a sign of a token is a byte
            self.cut, self.between, self.plain = pretokens, "", re.compile(f" {PLAIN}")
            self.sizes, self.closes, self.marked = np.array([len(t) for t in tokens]), None, None
        else:
            self.cut, self.between, self.plain = words_between_blanks, " ", re.compile(PLAIN)
            self.sizes, self.closes, self.marked = None, np.array([t.endswith("</w>") for t in tokens]), re.compile(f"({PLAIN})({MARKS})?")
        self.caseless = self._without_normalizer()
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _keeps_blanks(self) -> bool:
        ids = lambda t: self.library.encode(t, add_special_tokens=False).ids
        return ids("a  b") != ids("a b")

    def _without_normalizer(self):
        """The library for plain words in lower case, if all its normalizer does to a word is to compose and lower it."""
        told = json.loads(self.library.to_str())
        if [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            return None
        from tokenizers import Tokenizer

        bare = Tokenizer.from_str(json.dumps(told | {"normalizer": None}))
        bare.encode_special_tokens = True
        return bare

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self.cut(t.lower() if self.caseless and is_latin(t) else t) for t in texts]
        kept, older = self.kept, self.older
        missing = []
        for w in set().union(*words).difference(kept):  # not kept.keys(): that walks all words kept
            if w in older:
                kept[w] = older[w]
            else:
                missing.append(w)
        if self.marked:
            self._meet_marked(missing)
        else:
            alone, rest = [], []
            for w in missing:
                (rest if self.plain.fullmatch(w) else alone).append(w)
            kept.update(self._met(rest, alone))
        out = [b"".join(map(kept.__getitem__, ws)) for ws in words]
        if len(kept) > MAX_WORDS:
            self.kept, self.older = {}, kept
        return out

    def _meet_marked(self, missing: list[str]) -> None:
        """Keeps the ids of new words; those of a plain word with marks behind it are its ids and theirs."""
        kept, older = self.kept, self.older
        made, first, then, plain, alone = [], [], [], set(), set()
        for w in missing:
            if m := self.marked.fullmatch(w):
                word, marks = m[1].lower() if self.caseless else m[1], m[2] or ""
                if word not in kept:
                    if word in older:
                        kept[word] = older[word]
                    else:
                        plain.add(word)
                if marks not in kept:
                    alone.add(marks)
                if word != w:
                    made.append(w), first.append(word), then.append(marks)
            else:
                alone.add(w)
        kept.update(self._met(list(plain), list(alone)))
        kept.update(zip(made, map(bytes.__add__, map(kept.__getitem__, first), map(kept.__getitem__, then))))

    def _met(self, rest: list[str], alone: list[str]):
        """(word, ids) of words seen for the first time: plain words and others."""
        groups = [rest[i:i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
        for group, e in zip(groups, (self.caseless or self.library).encode_batch_fast([self.between.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            if self.closes is not None:
                ends = np.flatnonzero(self.closes[ids]) + 1
            else:
                ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) for w in group])) + 1
            raw, ends = ids.tobytes(), ends.tolist()
            yield from zip(group, [raw[4 * a:4 * b] for a, b in zip([0, *ends], ends)])
        for i in range(0, len(alone), 4096):
            part = alone[i:i + 4096]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                yield w, array("I", e.ids).tobytes()


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
