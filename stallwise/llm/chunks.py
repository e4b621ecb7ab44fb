"""Distinct-chunk tables: segment each distinct piece of text once, put the ids back by position.

Words repeat, so the slow library call is made once for each distinct chunk of
a worker and the rest are look-ups.  A worker keeps its table from task to
task.  When it is full it becomes the old one, from which only fields that are
met again are carried over: that bounds memory and changes no result.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain
from string import ascii_letters

import numpy as np
import pyarrow as pa

#: Fields of a table, and their characters, before it becomes the old one.
TABLE, TABLE_CHARS = 450_000, 16_000_000
#: Marks that are cut from the word before them.
MARKS = ".,;:!?*#$%&"
#: New pieces that are handed to the library at a time.
CALL = 10_000


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _packed_each(lists: list[list[int]]) -> list[bytes]:
    """The same for many short lists."""
    ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))) * 4
    data = np.fromiter(chain.from_iterable(lists), "<u4", int(ends[-1]) // 4 if len(lists) else 0).tobytes()
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if lists else []


class _Known:
    """Ids by field, None for a field that can't be told apart from its neighbours."""

    def __init__(self) -> None:
        self.ids: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.chars = 0

    def turn(self) -> None:
        """Makes room when the table is full."""
        if len(self.ids) > TABLE or self.chars > TABLE_CHARS:
            self.old, self.ids, self.chars = self.ids, {}, 0

    def add(self, found: dict[str, bytes | None]) -> None:
        self.chars += sum(map(len, found))
        self.ids.update(found)

    def missing(self, fields: set[str]) -> set[str]:
        """The fields that neither table has; those of the old one are carried over."""
        new = fields.difference(self.ids)
        again = new & self.old.keys()
        self.add({f: self.old[f] for f in again})
        return new - again


class ChunkTable:
    """Ids of texts as little-endian unsigned 32-bit integers.

    A text is cut at single spaces.  A field that is empty or begins or ends
    with white space could share a token with its neighbours: it stays None in
    the table, and a text that has it is given to the library whole.
    """

    #: A field that ends so is not cut off either.
    joins: str | None = None

    def __init__(self) -> None:
        self.heads, self.rest = _Known(), _Known()

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def segment(self, fields: list[str], head: bool) -> dict[str, bytes]:
        raise NotImplementedError

    def _learn(self, fields: set[str], head: bool) -> None:
        """Segments the fields that are new, in one call."""
        table = self.heads if head else self.rest
        new = table.missing(fields)
        safe = [f for f in new if f and f.strip() == f]
        if self.joins is not None:
            safe = [f for f in safe if not f.endswith(self.joins)]
        made: dict[str, bytes | None] = dict.fromkeys(new)
        made.update(self.segment(safe, head))
        table.add(made)

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the texts' new fields are segmented together."""
        self.heads.turn()
        self.rest.turn()
        split = [t.split(" ") for t in texts]
        first = [fields.pop(0) for fields in split]
        self._learn(set(first), True)
        self._learn(set().union(*split), False)
        heads, get, out = self.heads.ids, self.rest.ids.__getitem__, []
        for text, head, fields in zip(texts, first, split, strict=True):
            try:
                out.append(heads[head] + b"".join(map(get, fields)))
            except TypeError:
                out.append(self.whole(text))
        return out

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]


class ByteBpe:
    """A byte-level BPE file of the tokenizers library, without special tokens added.

    Texts are cut in their bytes, all of a column at once, where the file's
    pattern starts a token whatever comes before: at a run of blanks behind a
    character that is no white space, behind a single line break, and at a mark
    behind a letter.  A piece keeps its blanks in front, so the library gives
    the same ids for it alone.  Each distinct piece of a column is looked up
    once and its ids are taken by number.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.rest = _Known()

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin, with the end of the last; null texts count as empty."""
        self.rest.turn()
        data, bounds = _bytes_of(texts)
        at = _starts(data, bounds)
        if not len(at):
            return np.zeros(0, "<u4"), bounds
        cut = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        pieces = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.rest.ids
        self._learn(self.rest.missing({p for p in pieces if p not in known}))
        taken = pa.array([known[p] for p in pieces], pa.large_binary()).take(cut.indices)
        _, ends, ids = taken.buffers()
        ends = np.frombuffer(ends, np.int64, len(at) + 1)
        return np.frombuffer(ids, "<u4", int(ends[-1]) // 4), ends[np.searchsorted(at, bounds)] // 4

    def _learn(self, pieces: set[str]) -> None:
        """Segments new pieces: a word of Latin letters is one token of the pattern, so the library's model alone tells its ids."""
        words = list(filter(_WORD, pieces))
        for k in range(0, len(words), CALL):
            some = words[k: k + CALL]
            letters = _ALPHABET[np.frombuffer("\0".join(some).encode(), np.uint8)].tobytes().decode("utf-32-le").split(chr(_ALPHABET[0]))
            self.rest.add(dict(zip(some, _packed_each([[t.id for t in self.model.tokenize(w)] for w in letters]), strict=True)))
        others = list(pieces.difference(words))
        for k in range(0, len(others), CALL):
            some = others[k: k + CALL]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.rest.add(dict(zip(some, _packed_each([e.ids for e in found]), strict=True)))

    def ids(self, text: str) -> bytes:
        return self.rows(pa.array([text], pa.string()))[0].tobytes()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, with the end of the last; nothing is copied."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, bounds, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[bounds[0]: bounds[-1]], bounds - bounds[0]


def _starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin: at the first byte of each text that has one, and at the cuts of ``ByteBpe``."""
    kind = _KIND[data]
    before, here = kind[:-1], kind[1:]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (here == _BLANK) & (before != _BLANK) & (before != _WHITE) | (here == _MARK) & ((before == _LETTER) | (before == _HIGH))
    # Behind a character of several bytes, what it is decides.
    doubtful = np.flatnonzero(cut[1:-1] & (before == _HIGH)) + 1
    first, second, third = (data[np.maximum(doubtful - k, 0)].astype(np.int32) for k in (3, 2, 1))
    pair = second << 8 | third
    letter = ((second >= 0xC3) & (second <= 0xC9) | (second == 0xD0) | (second == 0xD1)) & (pair != 0xC397) & (pair != 0xC3B7)
    white = np.isin(pair, _WHITE_PAIRS) | np.isin(first << 16 | pair, _WHITE_TRIPLES)
    cut[doubtful] = np.where(kind[doubtful] == _MARK, letter, ~white)
    cut[bounds] = True
    breaks = np.flatnonzero((data == _BREAK) & cut[:-1])
    breaks = breaks[breaks + 1 < len(data)] + 1
    cut[breaks[_CLEAR[data[breaks]]]] = True
    return np.flatnonzero(cut[:-1])


#: What a byte is: a blank at which pieces are cut, a mark, an ASCII letter, part of another character, other ASCII white space.
_BLANK, _MARK, _LETTER, _HIGH, _WHITE = range(1, 6)
_BREAK = ord("\n")
_KIND = np.zeros(256, np.uint8)
_KIND[0x80:] = _HIGH
for _chars, _kind in ((" \n", _BLANK), (MARKS, _MARK), (ascii_letters, _LETTER), ("\t\v\f\r\x1c\x1d\x1e\x1f", _WHITE)):
    _KIND[[ord(c) for c in _chars]] = _kind
#: White space of two and three bytes.
_WHITE_PAIRS, _WHITE_TRIPLES = ([int.from_bytes(c.encode()) for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if (c.isspace() or c == "\u180e") and len(c.encode()) == n]
                                for n in (2, 3))
#: Bytes that never begin white space.
_CLEAR = ~np.isin(_KIND, (_BLANK, _WHITE)) & ~np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: The characters that stand for bytes in the file, and words that are one token of its pattern.
_ALPHABET = np.arange(256, dtype="<u4")
_NAMED = np.isin(_ALPHABET, [*range(33, 127), *range(161, 173), *range(174, 256)])
_ALPHABET[~_NAMED] = np.arange(256, 256 + np.sum(~_NAMED))
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """What ``ByteBpe.rows`` gives, with one more id behind each text."""
    if end_id is None:
        return ids, bounds
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


class Pieces(ChunkTable):
    """A sentencepiece model none of whose pieces has a marker after another character; no begin or end ids.

    The library puts a marker before the text and turns each space into one; so
    every field begins with its own marker, the one that the library adds when
    it segments the field alone.
    """

    MARK = "▁"

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.cuttable = not any(self.MARK in p.lstrip(self.MARK) for p in pieces)
        self.joins = self.MARK if self.cuttable else ""

    def whole(self, text: str) -> bytes:
        return _packed(self.model.encode(text, num_threads=1))

    def segment(self, fields: list[str], head: bool) -> dict[str, bytes]:
        return dict(zip(fields, _packed_each(self.model.encode(fields, num_threads=1)), strict=True)) if fields else {}


@cache
def byte_bpe(path: str) -> ByteBpe:
    """This worker's table for a file."""
    return ByteBpe(path)


@cache
def sentence_pieces(path: str) -> Pieces:
    return Pieces(path)
