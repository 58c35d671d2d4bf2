"""Encoding whole texts through a bounded memo of words.

The tokenizers here split a text into pieces that they encode one by one, and a
piece has white space at most in front.  A text is therefore cut before each
space that a word follows.  A batch's words are numbered by Arrow, so each
distinct word is looked up once, and the ids are put together in numpy; only words
that are not remembered go through the tokenizer."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import hold, windows, words_at_spaces

#: A part between spaces that is empty or starts with white space (as Python has
#: it): the space in front of it is not one at which a text may be cut.
_ODD_PART = r"^(?:[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
LONG, KEPT = 1 << 24, 64


class Memo(dict):
    """At most about ``limit`` entries: those met first stay, as words that are
    common come early.  Should they stop to fit what is read (most lookups of a
    stretch fail), the memo starts anew."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.asked, self.failed = limit, 0, 0

    def note(self, asked: int, failed: int) -> None:
        self.asked, self.failed = self.asked + asked, self.failed + failed
        if self.asked > 2 * self.limit:
            if len(self) >= self.limit and self.failed > 0.4 * self.asked:
                self.clear()
            self.asked = self.failed = 0


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (uint32) of all parts, and each part's place and number of ids."""
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size, size


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` from each start, one after another."""
    before = np.cumsum(size) - size
    return pool[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class Words:
    """The same for words, in Arrow: the words, and their ids in one pool."""

    def __init__(self, limit: int):
        self.limit, self.asked, self.failed = limit, 0, 0
        self.clear()

    def clear(self) -> None:
        self.known, self.pool = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.start = self.size = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.known)

    note = Memo.note

    def look(self, words: pa.StringArray, fill: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool, and the place and number of the ids of each of some distinct
        words; ``fill`` gives the same of those that aren't known."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        pool, start, size = fill(new)
        all_start, all_size = np.concatenate([self.start, start + len(self.pool)]), np.concatenate([self.size, size])
        all_pool = np.concatenate([self.pool, pool])
        at[at < 0] = np.arange(len(self), len(all_start))
        if len(new) and len(self) < self.limit:
            short = pc.less_equal(pc.binary_length(new), KEPT)
            keep = np.flatnonzero(short.to_numpy(zero_copy_only=False))
            self.known = pa.concat_arrays([self.known, new.filter(short)])
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size[keep]) - size[keep]])
            self.size = np.concatenate([self.size, size[keep]])
            self.pool = np.concatenate([self.pool, gathered(pool, start[keep], size[keep])])
        self.note(len(words), len(new))
        return all_pool, all_start[at], all_size[at]


class WordEncoder:
    """split: a text's pieces in order; encode: ids of pieces, as bytes each.

    plain: a pattern of texts whose pieces ``cut`` gives for a whole array, one
    after another with null characters between or around them; other texts are
    split one by one."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]], plain: str = r"^\z", cut: Callable[[pa.StringArray], pa.StringArray] = lambda x: x, words: int = 400_000, pieces: int = 400_000):
        self.split, self.encode, self.plain, self.cut = split, encode, plain, cut
        self.words, self.pieces = Words(words), Words(pieces)

    def _new(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return joined(self.encode(pieces.to_pylist()))

    def _of(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of short texts by their pieces; those unknown go to the tokenizer."""
        if not len(texts):
            return joined([])
        plain = pc.and_not(pc.match_substring_regex(texts, self.plain), pc.match_substring(texts, "<|"))
        odd = [self.split(t) for t in texts.filter(pc.invert(plain)).to_pylist()]
        cut = pc.split_pattern(self.cut(texts.filter(plain)), "\0")
        pieces = pa.concat_arrays([cut.flatten(), pa.array([x for part in odd for x in part], pa.string())])
        n = np.empty(len(texts), np.int64)
        mask = plain.to_numpy(zero_copy_only=False)
        n[mask], n[~mask] = np.diff(cut.offsets.to_numpy()), [len(x) for x in odd]
        place = np.empty(len(texts), np.int64)  # of each text's first piece
        order = np.r_[np.flatnonzero(mask), np.flatnonzero(~mask)]
        place[order] = np.cumsum(n[order]) - n[order]
        d = pieces.dictionary_encode()
        pool, start, size = self.pieces.look(d.dictionary, self._new)
        code = gathered(d.indices.to_numpy(), place, n)
        size = size[code]
        ends = np.r_[0, np.cumsum(size)]
        at = ends[np.cumsum(n) - n]
        return gathered(pool, start[code], size), at, ends[np.cumsum(n)] - at

    def flat(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts one after another, and the places where
        each text's begin, with the end of the last.  A null text has none."""
        texts = texts.cast(pa.string()).fill_null("")
        if len(texts) and pc.max(pc.binary_length(texts)).as_py() > LONG:
            out, ends = [], [0]
            for t in texts:
                for i, w in enumerate(windows(t.as_py(), LONG // 4)):
                    out.append(self._flat(pa.array([w[1:] if i else w]), bool(i))[0])
                ends.append(sum(map(len, out)))
            return np.concatenate(out), np.array(ends)
        return self._flat(texts, False)

    def _flat(self, texts: pa.StringArray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """spaced: a space was cut off in front of each text, too."""
        lists = pc.split_pattern(texts, " ")
        for once in (True, False):
            words, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            head = np.zeros(len(words), bool)
            if not spaced:
                head[at[:-1]] = True
            rest = words.filter(pa.array(~head)).dictionary_encode()
            if not once:
                break
            bad = pc.match_substring_regex(rest.dictionary, _ODD_PART).to_numpy(zero_copy_only=False)
            if not bad.any():
                break
            place = np.flatnonzero(~head)[bad[rest.indices.to_numpy()]]
            odd = np.zeros(len(texts), bool)
            odd[np.searchsorted(at, place, "right") - 1] = True
            other = pa.array([words_at_spaces(t) for t in texts.filter(pa.array(odd)).to_pylist()], lists.type)
            order = np.argsort(np.r_[np.flatnonzero(~odd), np.flatnonzero(odd)])
            lists = pa.concat_arrays([lists.filter(pa.array(~odd)), other]).take(pa.array(order))
        pool, start, size = self.words.look(rest.dictionary, lambda new: self._of(pc.binary_join_element_wise("", new, " ")))
        of_word, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        code = rest.indices.to_numpy()
        of_word[~head], n[~head] = start[code], size[code]
        firsts, start, size = self._of(words.filter(pa.array(head)))
        of_word[head], n[head] = start + len(pool), size
        return gathered(np.concatenate([pool, firsts]), of_word, n), np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])[at]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian uint32 bytes."""
        flat, at = self.flat(pa.array(texts, pa.string()))
        data = flat.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(at.tolist(), at[1:].tolist())]


def with_end(flat: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` behind each text's ids."""
    return np.insert(flat, at[1:], end_id), at + np.arange(len(at))


def as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


#: Texts of these characters split alike in any version of Unicode's tables, and
#: lower-casing and normal form leave each of them one character.
_SIGNS = r"!-~\xa1-\xa7\xab\xb0\xb1\xb6\xb7\xbb\xbfÀ-\xff"
_PLAIN = re.compile(rf" ?[\n{_SIGNS}]*")
#: Of these, those that Arrow can cut: every line end stands alone.
PLAIN_WORD = rf"^ ?(?:\n?[{_SIGNS}]+)*\n?$"
_L = r"A-Za-zÀ-ÖØ-öø-ÿ"
#: The same patterns as below for Arrow, where white space is no longer than one.
_CUT_GPT = rf"('s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s)"
_CUT_LOWER = rf"('s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+)"
_PLAIN_GPT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
_PLAIN_LOWER = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+")
_GPT = regex.compile(public_tokenizers.PATTERN)


def byte_level_pieces(text: str) -> list[str]:
    return (_PLAIN_GPT if _PLAIN.fullmatch(text) else _GPT).findall(text)


def _library_byte_pieces(text: str) -> list[str]:
    return _PLAIN_GPT.findall(text) if _PLAIN.fullmatch(text) else [text]


def _library_lower_pieces(text: str) -> list[str]:
    return _PLAIN_LOWER.findall(text.lower()) if _PLAIN.fullmatch(text) and "<|" not in text else [text]


def cut_byte_level(texts: pa.StringArray) -> pa.StringArray:
    return pc.replace_substring_regex(texts, _CUT_GPT, "\\1\0")


def _cut_lower(texts: pa.StringArray) -> pa.StringArray:
    return pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(texts), _CUT_LOWER, "\\1\0"), r"\s", "\0")


def _byte_characters() -> dict[int, str]:
    """The printable characters by which byte-level vocabularies spell bytes."""
    as_is = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in as_is]
    return {b: chr(b) for b in as_is} | {b: chr(256 + i) for i, b in enumerate(rest)}


def library_encoder(path: str, pieces: str) -> WordEncoder:
    return hold((path, pieces), lambda: _library_encoder(path, pieces))


def _library_encoder(path: str, pieces: str) -> WordEncoder:
    """An encoder that gives what the tokenizers library gives for whole texts
    with the file at ``path``; ``pieces``: "bytes" or "lower", its way to split.

    Plain pieces, already as the file's normalizer and pre-tokenizer would leave
    them, go to the library's BPE model; all other text through its pipeline."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    merge, spell, plain = t.model.tokenize, _byte_characters(), _PLAIN.fullmatch

    def encode(parts: list[str]) -> list[bytes]:
        out, other = [], []
        for i, p in enumerate(parts):
            if p and plain(p) and "<|" not in p:
                p = "Ġ" + p[1:] if p[0] == " " else p
                if "\n" in p or not p[1:].isascii() or p[0] != "Ġ" and not p[0].isascii():
                    p = (p if p[0] != "Ġ" else " " + p[1:]).encode().decode("latin-1").translate(spell)
                out.append(as_bytes([x.id for x in merge(p)]))
            else:
                other.append(i)
                out.append(b"")
        for i, e in zip(other, t.encode_batch_fast([parts[i] for i in other], add_special_tokens=False)):
            out[i] = as_bytes(e.ids)
        return out

    if pieces == "bytes":
        return WordEncoder(_library_byte_pieces, encode, PLAIN_WORD, cut_byte_level)
    return WordEncoder(_library_lower_pieces, encode, PLAIN_WORD, _cut_lower)
