"""Token ids of whole texts, looked up word by word.

A vocabulary whose tokenizer drops white space and never joins words gives each blank-separated word the same ids
wherever it stands. Ids of words seen before are taken from a table, which is many times faster than running the
normaliser and the merges over every text; new words go through the tokenizers library.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable
from functools import lru_cache

from tokenizers import Tokenizer, pre_tokenizers

# What one Python worker remembers: at most twice so many words and so many bytes (an estimate with the cost of the
# table), none of them longer than ``LONGEST`` bytes. Ids do not depend on it.
REMEMBERED = 250_000
REMEMBERED_BYTES = 128 << 20
LONGEST = 64
ENTRY_BYTES = 200
_MARKS = ".,;:!?*$%&#"
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PROBE = "A b's  don't\tÉtÉ... x1 Ünï!?\x0b<|endoftext|>y <|END, 'll z ** 12,3"


def _packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers; for a few ids an array is faster than numpy."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class WordIds:
    """Ids of texts by a tokenizer file, as little-endian unsigned 32-bit numbers.

    Words are remembered in two tables: when the younger one is full it takes the place of the older one, and words found
    in the older one move to the younger. So frequent words stay and memory is bounded.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._model = self.tokenizer.model
        self._bytes_as_text = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._words: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        self._runs: dict[str, bytes] = {}
        self._bytes = 0
        whole = self._library(_PROBE)
        if whole != b"".join(self._library(w) for w in _PROBE.split()) or whole != self.encode(_PROBE.encode()):
            raise ValueError(f"{path}: the ids of a text are not those of its words")

    def _library(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _run(self, run: str, letters: bool) -> bytes:
        """Ids of one run of letters or of marks, which the pre-tokenizer keeps whole."""
        found = self._runs.get(run)
        if found is None:
            if letters:
                mapped = run if run.isascii() else self._bytes_as_text.pre_tokenize_str(run)[0][0]
                found = _packed([t.id for t in self._model.tokenize(mapped)])
            else:
                found = self._library(run)
            self._runs[run] = found
            self._bytes += ENTRY_BYTES + len(run) + len(found)
        return found

    def _learn(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Remembers new words; returns the ids of those that are too long for that."""
        fresh = {}
        for word in words:
            text = word.decode("utf-8", "replace")
            if len(word) > LONGEST:
                fresh[word] = self._library(text)
                continue
            letters = text.rstrip(_MARKS)
            if letters.isascii() and letters.isalpha() or _LETTERS.fullmatch(letters):
                ids = self._run(letters.lower(), True)
                if len(letters) < len(text):
                    ids += self._run(text[len(letters) :], False)
            else:
                ids = self._library(text)
            self._words[word] = ids
            self._bytes += ENTRY_BYTES + len(word) + len(ids)
        return fresh

    def encode(self, raw: bytes | None) -> bytes:
        """Ids of a UTF-8 text; none for null."""
        if not raw:
            return b""
        # Special tokens are matched before letter case is dropped.
        words = (raw if b"<|" in raw else raw.lower()).split()
        known = self._words
        new = set(words).difference(known)
        if not new:
            return b"".join([known[w] for w in words])
        older = self._older
        kept = {w: older[w] for w in new if w in older}
        known.update(kept)
        self._bytes += sum([ENTRY_BYTES + len(w) + len(ids) for w, ids in kept.items()])
        fresh = self._learn(new.difference(kept))
        if len(known) > REMEMBERED or self._bytes > REMEMBERED_BYTES:
            self._older, self._words, self._runs, self._bytes = known, {}, {}, 0
        if fresh:
            return b"".join([fresh[w] if w in fresh else known[w] for w in words])
        return b"".join([known[w] for w in words])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table per file and Python worker."""
    return WordIds(path)
