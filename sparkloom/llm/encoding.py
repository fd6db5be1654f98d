"""Whole-text encoding with remembered pieces, in arrays.

A batch of texts is cut where a pre-token surely starts and ends; each piece then encodes to the same ids by itself as
inside its text. Pieces of at most SHORT bytes are looked up by those bytes in a direct-mapped table of fixed size, and only
pieces that are not there are encoded. The table, the ids and what a batch needs are numpy arrays, so that a worker's memory
is bounded in bytes, whatever the vocabulary of the corpus.

Cuts go by classes of bytes: ASCII letters, digits and marks, Latin-1 letters, spaces, other ASCII white space, and bytes
of characters about which nothing is assumed, beside which no cut is made but the one before a space that such a character
surely follows. What is certain for the byte-level pattern (words with their leading space, marks, digits, white space):

- letters, digits and marks do not mix; an apostrophe may begin a contraction, so nothing is cut behind it, but before it
  behind letters and digits;
- white space behind something else begins a pre-token; of a run of white space that goes on with something else the last
  character begins one, and ends it unless it is a space.

The word vocabulary drops white space, so that it only separates. A text with the name of a special token is encoded
whole by the library, which finds it there; so is a text with a NUL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import kept
from .shingles import mix

#: Slots of a worker's table, and the ids it may hold before it starts afresh: 31 and 32 MB (if ids have 16 bits).
SLOTS, MOST_IDS = 1 << 20, 16_000_000
#: Bytes of the longest piece that is remembered; longer ones are encoded each time.
SHORT = 24
#: Characters of a longer text that are encoded at a time.
STRETCH = 2_000_000

_OTHER, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _SPACE, _BREAK, _END, _SOLID = range(9)
_CLASS = np.zeros(256, np.uint8)
for _first, _last, _kind in ((33, 126, _MARK), (48, 57, _DIGIT), (65, 90, _LETTER), (97, 122, _LETTER), (39, 39, _APOSTROPHE), (32, 32, _SPACE), (9, 13, _BREAK), (0, 0, _END), (0xC4, 0xE0, _SOLID), (0xE4, 0xF4, _SOLID)):
    _CLASS[_first : _last + 1] = _kind
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_FACTOR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _rules(drop: bool) -> tuple[np.ndarray, np.ndarray]:
    """By a class times 9 plus the next byte's: whether a cut is between the two, and whether one is before the first."""
    between, before = np.zeros((9, 9), bool), np.zeros((9, 9), bool)
    sorts = (_LETTER, _DIGIT, _MARK)
    for a in sorts:
        between[a, [b for b in sorts if b != a]] = True
    between[[_LETTER, _DIGIT], _APOSTROPHE] = True
    for white in (_SPACE, _BREAK):
        between[[*sorts, _APOSTROPHE], white] = True
        before[white, [*sorts, _APOSTROPHE, _SOLID]] = True
    between[_BREAK, [*sorts, _APOSTROPHE, _SOLID]] = True
    if drop:
        before[:] = False
        for white in (_SPACE, _BREAK):
            between[white, :] = between[:, white] = True
    between[_END, :] = between[:, _END] = True
    return between.ravel(), before.ravel()


class Cutter:
    """Texts -> pieces. drop: white space is no part of a piece."""

    def __init__(self, drop: bool):
        self.drop = drop
        self.between, self.before = _rules(drop)

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """raw: NUL, a text, NUL, ..., NUL. (starts, ends, number of the first piece behind each NUL)."""
        data = np.frombuffer(raw, np.uint8)
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # not the signs of multiplication and division
        kind[lead] = kind[lead + 1] = _LETTER
        pair = kind[:-1] * np.uint8(9) + kind[1:]
        cut = np.zeros(len(data), bool)
        cut[0] = True
        cut[1:] = self.between[pair]
        cut[:-1] |= self.before[pair]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        first = kind[starts]
        real = first != _END
        if self.drop:
            real &= (first != _SPACE) & (first != _BREAK)
        starts, ends = starts[real], ends[real]
        return starts, ends, np.searchsorted(starts, np.flatnonzero(kind == _END))


#: How texts are cut for a byte-level pattern, in which words carry their leading space, and for a vocabulary of words.
spaced, separated = Cutter(drop=False), Cutter(drop=True)
Ids = tuple[np.ndarray, np.ndarray]


class Encoder:
    """Lists of texts -> little-endian unsigned 32-bit ids of each; null counts as empty.

    many encodes a list of pieces, each by itself: (all ids, number of ids of each). whole encodes a text that is not cut;
    specials are the strings that make it so. id_type holds every id.
    """

    def __init__(self, cut: Cutter, many: Callable[[list[str]], Ids], whole: Callable[[str], np.ndarray], specials: tuple[str, ...] = (), id_type: type = np.uint32, slots: int = SLOTS, most_ids: int = MOST_IDS):
        self.cut, self.many, self.whole, self.specials = cut, many, whole, specials
        self.shift, self.most = np.uint64(64 - (slots.bit_length() - 1)), most_ids
        self.keys = np.zeros((3, slots), np.uint64)
        self.place, self.count = np.zeros(slots, np.int32), np.zeros(slots, np.uint16)
        self.ids, self.used = np.zeros(1 << 16, id_type), 0

    def _room(self, n: int) -> None:
        if n > len(self.ids):
            self.ids = np.resize(self.ids, max(n, min(2 * len(self.ids), self.most)))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        apart = {k: self._whole if "\0" in t or any(s in t for s in self.specials) else self._long for k, t in enumerate(texts) if t and (len(t) > STRETCH or "\0" in t or any(s in t for s in self.specials))}
        out = self._cut([None if k in apart else t for k, t in enumerate(texts)])
        for k, encoded in apart.items():
            out[k] = encoded(texts[k])
        return out

    def _whole(self, text: str) -> bytes:
        return self.whole(text).astype("<u4").tobytes()

    def _long(self, text: str) -> bytes:
        """A long text in stretches, each up to the last cut in it that has no white space before it (a run of white space is
        read by what follows)."""
        out, at, width = [], 0, STRETCH
        while at < len(text):
            part = text[at : at + width]
            if at + width < len(text):
                raw = f"\0{part}\0".encode()
                starts = self.cut(raw)[0]
                starts = starts[~np.isin(_CLASS[np.frombuffer(raw, np.uint8)[starts - 1]], (_SPACE, _BREAK))]
                if not len(starts) or starts[-1] <= 1:
                    width *= 2
                    continue
                part = raw[1 : starts[-1]].decode()
            out.append(self._cut([part])[0])
            at, width = at + len(part), STRETCH
        return b"".join(out)

    def _cut(self, texts: list[str | None]) -> list[bytes]:
        if self.used > self.most:
            self.keys[:] = 0
            self.used = 0
            self.ids = self.ids[: self.most]
        raw = "\0".join(["", *(t or "" for t in texts), ""]).encode() or b"\0"
        starts, ends, first = self.cut(raw)
        size = ends - starts
        words = np.ndarray((len(raw),), "<u8", buffer=raw + bytes(SHORT + 8), strides=(1,))
        at = [words[np.minimum(starts + 8 * j, len(raw) - 1)] & _MASK[np.clip(size - 8 * j, 0, 8)] for j in range(3)]
        slot = (mix(at[0] * _FACTOR[0] + at[1] * _FACTOR[1] + at[2] * _FACTOR[2]) >> self.shift).astype(np.int64)
        short = size <= SHORT
        hit = short & (self.keys[0][slot] == at[0]) & (self.keys[1][slot] == at[1]) & (self.keys[2][slot] == at[2])
        place, count = self.place[slot].astype(np.int64), self.count[slot].astype(np.int64)

        fresh = np.flatnonzero(~hit & short)
        order = fresh[np.lexsort([x[fresh] for x in at])]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = (at[0][order[1:]] != at[0][order[:-1]]) | (at[1][order[1:]] != at[1][order[:-1]]) | (at[2][order[1:]] != at[2][order[:-1]])
        once, group = order[new], np.cumsum(new) - 1
        text = [raw[a:b].decode() for a, b in zip(starts[once].tolist(), ends[once].tolist())]
        long, number, which = np.flatnonzero(~short), {}, []
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            which.append(number.setdefault(raw[a:b], len(number)))
        ids, counts = self.many(text + [x.decode() for x in number])
        self._room(self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        places = self.used + np.cumsum(counts) - counts
        place[order], count[order] = places[group], counts[group]
        place[long], count[long] = places[len(once) :][which], counts[len(once) :][which]
        self.used += int(counts[: len(once)].sum())
        stay = np.flatnonzero(counts[: len(once)] < 1 << 16)
        stay = stay[np.unique(slot[once[stay]], return_index=True)[1]]  # one of those that share a slot
        for j in range(3):
            self.keys[j][slot[once[stay]]] = at[j][once[stay]]
        self.place[slot[once[stay]]], self.count[slot[once[stay]]] = places[stay], counts[stay]

        begin = np.concatenate([[0], np.cumsum(count)])
        everything = self.ids[np.repeat(place - begin[:-1], count) + np.arange(begin[-1])].astype("<u4").tobytes()
        edges = (4 * begin[first]).tolist()
        return [everything[a:b] for a, b in zip(edges, edges[1:])]


def library_encoder(path: str, cut: Cutter) -> Encoder:
    """An encoder by the tokenizers library, as it is without added special tokens, kept by a worker process."""

    def make() -> Encoder:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def many(pieces: list[str]) -> Ids:
            ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for lo in range(0, len(pieces), 2000):
                part = pieces[lo : lo + 2000]
                found = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(found.ids, np.uint32))
                counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
            return np.concatenate(ids), np.concatenate(counts)

        def whole(text: str) -> np.ndarray:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

        return Encoder(cut, many, whole, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values()), np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    return kept(("encoder", path, cut.drop), make)
