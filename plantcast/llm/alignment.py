"""Alignment of two tokenizers on the bytes they share.

Both tokenizers cut the same bytes. The ends of their tokens, counted in bytes, are the keys of one dictionary each
(end to index); the keys that both hold, sorted, slice the two id lists into groups. Within a slice every pair of
tokens with overlapping bytes is a link. Links are counted over the corpus and compared with the best partner of each
id. Texts are dealt to blocks: a block knows its distinct pairs, so that the count of a frequent pair travels once per
block and not once per document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from plantcast.llm.shared import salted_lookup, stored, text_batches

BLOCK_BYTES = 16 << 20
# Bytes of text whose ends are in the dictionaries at a time, so that long texts need no large ones.
SPAN_BYTES = 1 << 20
# The pre-tokenizer of byte-level vocabularies, by the same regular expression.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Texts of characters whose classes no version of Unicode moves, in words of ordinary length, go through the faster encoder.
_UNUSUAL = re.compile("[^\x00-\u024f]")
LONG_WORD = 2000
# Blanks between two characters that no tokenizer takes for white space.
_SINGLE_BLANK = re.compile("(?<=[^\\s\u180e\u2581]) (?=[^\\s\u180e\u2581])")
_PLAIN_ENDS = re.compile("(?s)(?=[^\\s\u180e]).*[^\\s\u180e]\\Z")
_PROBE = "A b's  don't\tÉtÉ... x1 Ünï!?\x0b<|endoftext|>y \n\nZ <unk> 'll z ** 12,3 日本 </s> end\n of\u00a0it 'tis  "
# What one worker remembers: at most twice so many words, none of more characters than ``LONGEST``.
REMEMBERED = 100_000
LONGEST = 64
# Texts whose words are looked up together.
TEXTS_TOGETHER = 200
_FIELD = 40
_LONG_BLANK = re.compile(rf"\s{{{LONG_WORD}}}")


class ByteTokens:
    """Byte-level tokenizer file: ids of ``space + text``, and the bytes of each id."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        # Printable bytes of Latin-1 stand for themselves, all others for the characters from 256 on, in order.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, self.bytes_of = model["vocab"], {}
        for token, i in vocabulary.items():
            if all(c in letter for c in token):
                self.bytes_of[i] = bytes(letter[c] for c in token)
        # With a token for every byte and no normaliser nothing is lost.
        self.lossless = self.library.normalizer is None and len({b for b in self.bytes_of.values() if len(b) == 1}) == 256
        self.fast = self._fast(vocabulary, model["merges"])

    def _fast(self, vocabulary: dict[str, int], merges: list) -> tiktoken.Encoding | None:
        """The same vocabulary as ranks, where ids rise with the order of the merges."""
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        order = [vocabulary[t] for t in made]
        single = [i for i, b in self.bytes_of.items() if len(b) == 1]
        if order != sorted(order) or len(single) != 256 or len(made) + 256 != len(self.bytes_of) or max(single) > min(order):
            return None
        return tiktoken.Encoding("pieces", pat_str=_WORDS, mergeable_ranks={b: i for i, b in self.bytes_of.items()}, special_tokens={})

    @staticmethod
    def _ordinary(text: str) -> bool:
        if not text.isascii() and _UNUSUAL.search(text):
            return False
        return len(text) < LONG_WORD or max(map(len, text.split()), default=0) < LONG_WORD and not _LONG_BLANK.search(text)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and self._ordinary(text):
            return self.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        return np.array(self.library.encode(" " + text, add_special_tokens=False).ids, np.int64)


class PieceTokens:
    """Sentence-piece model: ids of a text, before which the model puts a space, and the bytes of each id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes_of[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
        # No piece but those of blanks alone goes on after a blank, so none lies in two words.
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.apart = not any("▁" in p[1:] and p.strip("▁") for p in pieces)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


@lru_cache(maxsize=2)
def _tokenizers(path_a: str, path_b: str):
    return ByteTokens(path_a), PieceTokens(path_b)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of both sides at each byte where tokens of both end, in ascending order."""
    cut_a, cut_b = [], []
    last, at = int(ends_a[-1]), 0
    for until in range(SPAN_BYTES, last + SPAN_BYTES, SPAN_BYTES):
        a, b = np.searchsorted(ends_a, (at, until), "right"), np.searchsorted(ends_b, (at, until), "right")
        index_a = dict(zip(ends_a[a[0] : a[1]].tolist(), range(a[0] + 1, a[1] + 1)))
        index_b = dict(zip(ends_b[b[0] : b[1]].tolist(), range(b[0] + 1, b[1] + 1)))
        # Keys stand in ascending order, and so do those that the other dictionary holds too.
        shared = [e for e in index_a if e in index_b]
        cut_a.append(np.fromiter(map(index_a.__getitem__, shared), np.int64, len(shared)))
        cut_b.append(np.fromiter(map(index_b.__getitem__, shared), np.int64, len(shared)))
        at = until
    return np.concatenate(cut_a), np.concatenate(cut_b)


def slice_links(cut_a: np.ndarray, cut_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token indexes of both sides of every overlapping pair, slice by slice."""
    from_a, from_b = np.concatenate(([0], cut_a[:-1])), np.concatenate(([0], cut_b[:-1]))
    size_a, size_b = cut_a - from_a, cut_b - from_b
    # A slice with one token on a side: this token overlaps every token of the other side.
    plain = (size_a == 1) | (size_b == 1)
    n = np.maximum(size_a, size_b)[plain]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    links_a = np.repeat(from_a[plain], n) + np.where(np.repeat(size_a[plain] > 1, n), step, 0)
    links_b = np.repeat(from_b[plain], n) + np.where(np.repeat(size_b[plain] > 1, n), step, 0)
    # Other slices: each stretch between two neighbouring ends, of either side, lies in one token of each.
    in_a, in_b = np.repeat(~plain, size_a), np.repeat(~plain, size_b)
    stops = np.unique(np.concatenate((ends_a[in_a], ends_b[in_b])))
    more_a, more_b = np.searchsorted(ends_a, stops), np.searchsorted(ends_b, stops)
    return np.concatenate((links_a, more_a)), np.concatenate((links_b, more_b))


class TokenBytes:
    """Lengths and contents of all tokens in flat arrays."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.length = np.full(max(bytes_of) + 1, -1, np.int64)
        self.length[list(bytes_of)] = [len(b) for b in bytes_of.values()]
        self.start = np.zeros_like(self.length)
        self.start[list(bytes_of)] = np.cumsum(self.length[list(bytes_of)]) - self.length[list(bytes_of)]
        self.flat = np.frombuffer(b"".join(bytes_of.values()), np.uint8)

    def ends(self, ids: np.ndarray, whole: np.ndarray, lossless: bool = False) -> np.ndarray | None:
        """Ends of the tokens in bytes, or None where the tokens joined are not ``whole``. The tokens of a lossless tokenizer
        are so if they have the same length."""
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ids) or ends[-1] != len(whole) or length.min() < 0:
            return None
        if lossless:
            return ends
        place = np.repeat(self.start[ids] - ends + length, length) + np.arange(len(whole))
        return ends if np.array_equal(self.flat[place], whole) else None


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _tokenizers(path_a, path_b)
        self.bytes_a, self.bytes_b = TokenBytes(self.a.bytes_of), TokenBytes(self.b.bytes_of)
        words = _SINGLE_BLANK.split(_PROBE)
        self.by_word = self.a.lossless and self.b.apart and all(
            np.array_equal(t.ids(_PROBE), np.concatenate([t.ids(w) for w in words])) for t in (self.a, self.b)
        )
        self._known: dict[str, tuple | None] = {}
        self._older: dict[str, tuple | None] = {}

    def align(self, text: str | None):
        """Ids and cuts of both sides, the pair codes of the links and their tokens of the first side, or None where the tokens do
        not make up the text."""
        if not text:
            return None
        a, b, whole = self.a.ids(text), self.b.ids(text), np.frombuffer((" " + text).encode(), np.uint8)
        ends_a, ends_b = self.bytes_a.ends(a, whole, self.a.lossless), self.bytes_b.ends(b, whole)
        if ends_a is None or ends_b is None:
            return None
        cut_a, cut_b = common_ends(ends_a, ends_b)
        links_a, links_b = slice_links(cut_a, cut_b, ends_a, ends_b)
        return a, b, cut_a, cut_b, a[links_a] << 32 | b[links_b], links_a


    def parts(self, texts: list[str | None]) -> Iterator[tuple | None]:
        """For each text its number of tokens of both sides and of groups, its groups as text, and the pair codes of its links;
        None where the tokens do not make it up."""
        for at in range(0, len(texts), TEXTS_TOGETHER):
            yield from self._parts(texts[at : at + TEXTS_TOGETHER])

    def _parts(self, texts: list[str | None]) -> Iterator[tuple | None]:
        # Words of a text, or the whole text.
        split = [_SINGLE_BLANK.split(t) if t and self.by_word else [t] if t else [] for t in texts]
        fresh = self._recall({w for words in split for w in words})
        known = self._known
        for words in split:
            found = [known[w] if w in known else fresh[w] for w in words]
            if not found or None in found:
                yield None
                continue
            sizes, groups, codes = zip(*found)
            n, mask = sum(sizes), (1 << _FIELD) - 1
            yield n & mask, n >> _FIELD & mask, n >> 2 * _FIELD, ";".join(groups), np.frombuffer(b"".join(codes), np.int64)

    def _recall(self, words: set[str]) -> dict[str, tuple | None]:
        """Makes sure that the words are known; returns what was found of those that are too long for that."""
        if len(self._known) > REMEMBERED:
            self._known, self._older = {}, self._known
        known, older, fresh = self._known, self._older, {}
        new = words.difference(known)
        kept = {w: older[w] for w in new if w in older}
        known.update(kept)
        # Words are joined with others of their kind, so that each text goes through the encoder that its characters allow.
        kinds: dict[bool, list[str]] = {True: [], False: []}
        for word in new.difference(kept):
            if self.by_word and len(word) < LONG_WORD and "▁" not in word and _PLAIN_ENDS.match(word):
                kinds[word.isascii() or not _UNUSUAL.search(word)].append(word)
            else:
                fresh |= self._learn([word])
        for side_by_side in kinds.values():
            held, size = [], 0
            for word in side_by_side:
                held.append(word)
                size += len(word)
                if size >= SPAN_BYTES:
                    fresh |= self._learn(held)
                    held, size = [], 0
            if held:
                fresh |= self._learn(held)
        short = {w: f for w, f in fresh.items() if len(w) <= LONGEST}
        known.update(short)
        return {w: f for w, f in fresh.items() if w not in short}

    def _learn(self, words: list[str]) -> dict[str, tuple | None]:
        """Numbers of tokens and groups (as one number), groups as text and pair codes of each word, aligned side by side."""
        text = " ".join(words)
        aligned = self.align(text)
        if aligned is None:
            if len(words) == 1:
                return {words[0]: None}
            half = len(words) // 2
            return self._learn(words[:half]) | self._learn(words[half:])
        a, b, cut_a, cut_b, codes, links_a = aligned
        stops = np.cumsum(np.array([len(w.encode()) + 1 for w in words], np.int64))
        ends = np.cumsum(self.bytes_a.length[a])[cut_a - 1]
        last = np.searchsorted(ends, stops)
        if not np.array_equal(ends[last], stops):
            raise ValueError("a token goes on from one word to the next")
        groups, to = groups_list(a, b, cut_a, cut_b), last + 1
        n_a, n_b, n_groups = (np.diff(n, prepend=0).tolist() for n in (cut_a[last], cut_b[last], to))
        # Links by the token of the first side; those of a word stand together then.
        order = np.argsort(links_a, kind="stable")
        raw, links_to = codes[order].tobytes(), np.searchsorted(links_a[order], cut_a[last]).tolist()
        out, g, k = {}, 0, 0
        for word, x, y, z, group, link in zip(words, n_a, n_b, n_groups, to.tolist(), links_to):
            out[word] = x | y << _FIELD | z << 2 * _FIELD, ";".join(groups[g:group]), raw[8 * k : 8 * link]
            g, k = group, link
        return out


class _PairNames(dict):
    """Text of a group of one token each side, by pair code; emptied when large."""

    def __missing__(self, code: int) -> str:
        if len(self) > 200_000:
            self.clear()
        name = self[code] = f"{code >> 32}|{code & 0xFFFFFFFF}"
        return name


_PAIR_NAMES = _PairNames()


def groups_list(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
    """The groups, each as ``a1,a2|b1``."""
    from_a, from_b = np.concatenate(([0], cut_a[:-1])), np.concatenate(([0], cut_b[:-1]))
    size_a, size_b = cut_a - from_a, cut_b - from_b
    # Named by their first tokens; groups of more tokens are written over that.
    out = list(map(_PAIR_NAMES.__getitem__, (a[from_a] << 32 | b[from_b]).tolist()))
    wide = (size_a > 1) | (size_b > 1)
    if wide.any():
        ids_a, ids_b = list(map(str, a[np.repeat(wide, size_a)].tolist())), list(map(str, b[np.repeat(wide, size_b)].tolist()))
        i = j = 0
        for g, n, m in zip(np.flatnonzero(wide).tolist(), size_a[wide].tolist(), size_b[wide].tolist()):
            out[g] = ",".join(ids_a[i : i + n]) + "|" + ",".join(ids_b[j : j + m])
            i, j = i + n, j + m
    return out


_ALIGNED = "block long, key {key}, n_a long, n_b long, n_groups long, n_links long, groups string, slots binary, counts binary, pairs binary"
_COLUMNS = ["block", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "slots", "counts", "pairs"]


def _align(path_a: str, path_b: str):
    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, first, number = Aligner(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        slot_of, size = {}, 0
        for pdf in batches:
            rows = []
            texts = [(raw or b"").decode("utf-8", "replace") for raw in pdf["text"]]
            for key, raw, found in zip(pdf["key"], pdf["text"], aligner.parts(texts)):
                if found is None:
                    rows.append((first + number, key, 0, 0, 0, 0, "", b"", b"", None))
                    continue
                n_a, n_b, n_groups, groups, links = found
                pairs, counts = np.unique(links, return_counts=True)
                slots = np.array([slot_of.setdefault(p, len(slot_of)) for p in pairs.tolist()], np.uint32)
                order = np.argsort(slots)
                packed = slots[order].tobytes(), counts[order].astype(np.uint32).tobytes()
                rows.append((first + number, key, n_a, n_b, n_groups, len(links), groups, *packed, None))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    rows.append(_dictionary(first + number, slot_of))
                    slot_of, size, number = {}, 0, number + 1
            yield pd.DataFrame(rows, columns=_COLUMNS)
        yield pd.DataFrame([_dictionary(first + number, slot_of)], columns=_COLUMNS)

    return align


def _dictionary(block: int, slot_of: dict[int, int]) -> tuple:
    return (block, None, 0, 0, 0, 0, None, None, None, np.fromiter(slot_of, np.int64, len(slot_of)).tobytes())


def align_texts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token groups and links of each text by a byte-level tokenizer file and a sentence-piece model, for
    :func:`link_counts`: ``key`` (numbers as text), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (ids as
    ``a1,a2|b1;...``) and the packed links; one more row per block, with ``pairs``, holds the block's distinct pairs.

    Texts that are null, empty, or that the tokens do not give back have zeros and empty ``groups``. Nothing is stored, so
    columns that are dropped next cost no disk.
    """
    text_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType
    # pandas holds numbers beside nulls as floating point, so they pass as text.
    carried = "string" if isinstance(kind, (NumericType, BooleanType)) else kind.simpleString()
    rows = docs.select(F.col(key).cast(carried).alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInPandas(_align(path_a, path_b), _ALIGNED.format(key=carried))


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct pairs of each block."""
    for pdf in batches:
        for block, raw in zip(pdf["block"], pdf["pairs"]):
            pairs = np.frombuffer(raw, np.int64)
            yield pd.DataFrame({"block": np.full(len(pairs), block), "slot": np.arange(len(pairs)), "pair": pairs})


def _uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each slot of a block, summed over the documents of a batch."""
    for pdf in batches:
        for block, part in pdf.groupby("block"):
            slots = np.frombuffer(b"".join(part["slots"]), np.uint32).astype(np.int64)
            if len(slots):
                n = np.bincount(slots, np.frombuffer(b"".join(part["counts"]), np.uint32)).astype(np.int64)
                used = np.flatnonzero(n)
                yield pd.DataFrame({"block": np.full(len(used), block), "slot": used, "n": n[used]})


def _score(columns: list[str]):
    def score(_: tuple, docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        size = int(known["slot"].max()) + 1 if len(known) else 0
        total, best = np.zeros(size, np.int64), np.zeros(size, bool)
        total[known["slot"]], best[known["slot"]] = known["total"], known["best"]
        n_best, count_sum = [], []
        for raw_slots, raw_counts in zip(docs["slots"], docs["counts"]):
            slots, counts = np.frombuffer(raw_slots, np.uint32), np.frombuffer(raw_counts, np.uint32).astype(np.int64)
            n_best.append(int(counts[best[slots]].sum()))
            count_sum.append(int((counts * total[slots]).sum()))
        return docs[columns].assign(n_best=n_best, count_sum=count_sum)

    return score


def pair_counts(stored_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of each block (``block``, ``slot``, ``pair``) and the corpus-wide ``total`` of each pair with ``best``:
    whether no other pair of its B id has more links."""
    dictionary = stored_rows.where("pairs is not null").select("block", "pairs").mapInPandas(_unpack, "block long, slot long, pair long")
    used = stored_rows.where("pairs is null").select("block", "slots", "counts").mapInPandas(_uses, "block long, slot long, n long")
    per_block = stored(dictionary.join(used.groupBy("block", "slot").agg(F.sum("n").alias("n")), ["block", "slot"]), "block-pairs")
    totals = per_block.groupBy("pair").agg(F.sum("n").alias("total"))
    # At most as many rows per B id as A has ids.
    most = F.max("total").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return per_block, totals.withColumn("best", F.col("total") == most)


def link_counts(aligned: DataFrame) -> DataFrame:
    """Per text of :func:`align_texts` (other columns are kept, ``groups`` may be gone): ``n_best``, links whose count over
    the corpus is the highest of their B id (ties included), and ``count_sum``, the sum of these counts over its links.

    Repeated rows count as often as they stand there. An empty table gives no rows.
    """
    rows = stored(aligned, "aligned", compression="zstd")
    per_block, totals = pair_counts(rows)
    # A frequent pair stands in every block, so its rows are dealt to many partitions.
    known = salted_lookup(per_block.drop("n"), totals, "pair", F.col("block")).select("block", "slot", "total", "best")
    docs = rows.where("pairs is null").drop("pairs")
    columns = [c for c in docs.columns if c not in ("block", "slots", "counts")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(columns).schema) + ", n_best long, count_sum long"
    return docs.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_score(columns), schema)
