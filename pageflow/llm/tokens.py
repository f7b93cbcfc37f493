"""Token ids by a public tokenizer file, with a cache of the pieces between spaces.

Both vocabularies cut a text at white space before they merge anything, so the ids
of a text are those of its pieces in a row.  Pieces repeat; each is encoded once per
cache life by the tokenizers library itself.  Texts that hold an added token (such as
<|endoftext|>, which gives its own id, as the library has it), or one of the four control
characters that Python and the library class differently, go to the library whole.
"""

from __future__ import annotations

import os
import re
from codecs import charmap_decode
from itertools import accumulate, chain, pairwise

import numpy as np

_ODD = "\x1c\x1d\x1e\x1f"
#: A Latin word that white space or one of a few marks ends is a piece of its own in both vocabularies.
#: U+0130 is none of its letters: its lower case is two characters, of which the second goes with a mark.
_WORD = "[A-Za-zÀ-ÖØ-öø-\u012f\u0131-ɏ]+(?=[\\s.,;:!?]|$)"
#: Else one optional space with what follows it, or white space: cuts that the byte-level pattern makes too.
_BYTE_PIECES = re.compile(rf" ?{_WORD}| ?\S+|\s+(?!\S)|\s+")
_WORD_PIECES = re.compile(rf"{_WORD}|\S+")
#: Letters alone, which the byte-level pattern does not cut.
_LETTERS = re.compile(" ?" + _WORD.partition("(")[0])


def _byte_names() -> str:
    """The letters that stand for the bytes in a byte-level vocabulary: each itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    names = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return "".join(names[b] for b in range(256))


def _bytes_of(ids: list[list[int]]) -> list[bytes]:
    flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
    ends = list(accumulate(map(len, ids), initial=0))
    return [flat[4 * a : 4 * b] for a, b in pairwise(ends)]


class Encoder:
    """Little-endian unsigned 32-bit ids of whole texts.

    `most` bounds the cached pieces.  They live in two generations: when the young one is
    full it becomes the old one, and what is used again returns to the young one.
    """

    def __init__(self, path: str, most: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        #: What sends a text to the library whole.
        self.odd = [*_ODD, *(t.content for t in self.tok.get_added_tokens_decoder().values())]
        self.byte_level = self.tok.normalizer is None
        self.names = _byte_names()
        if self.byte_level:
            #: The same model, which takes pieces that the letter of the line feed parts, as they are.
            self.plain = Tokenizer(self.tok.model)
            self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(self.names[10])
            vocabulary = self.tok.get_vocab()
            #: How many bytes each id stands for.
            self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most
        #: Stands between pieces that are encoded together; its id occurs nowhere else.
        self.mark = "\n" if self.byte_level else "\0"
        self.between = self.mark if self.byte_level else f" {self.mark} "
        (self.mark_id,) = self.tok.encode(self.mark, add_special_tokens=False).ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        ids = [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return _bytes_of(ids)

    def _words(self, words: list[str]) -> list[bytes]:
        """The same of pieces of letters alone: no pattern has to look where they are cut, so they go to the library's model in their bytes' letters.

        Ids stand for all the bytes, so where a word's end is told by the bytes before it.
        """
        out = []
        for i in range(0, len(words), 512):
            text = "\n".join(words[i : i + 512]).encode()
            ids = np.array(self.plain.encode_batch_fast([charmap_decode(text, "strict", self.names)[0]], add_special_tokens=False)[0].ids, "<u4")
            feeds = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
            ends = np.append(feeds, len(text)) - np.arange(len(feeds) + 1)
            last = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 4).tolist()
            flat = ids.tobytes()
            out += [flat[a:b] for a, b in zip([0, *last[:-1]], last, strict=True)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces: words of a byte-level vocabulary at once, others many in one text, whose ids are cut at the mark between them."""
        if self.byte_level:
            words, rest = [], []
            for p in pieces:
                (words if _LETTERS.fullmatch(p) else rest).append(p)
            pieces = rest
            self.cache.update(zip(words, self._words(words), strict=True))
        plain = [p for p in pieces if self.mark not in p and not p.isspace()]
        texts = [self.between.join(plain[i : i + 512]) for i in range(0, len(plain), 512)]
        for at, x in enumerate(self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            own = plain[512 * at : 512 * at + 512]
            ids = np.array(x.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(own) - 1:
                self.cache.update(zip(own, self._whole(own), strict=True))
                continue
            flat = ids.tobytes()
            first, end = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(flat)]
            self.cache.update((p, flat[a:b]) for p, a, b in zip(own, first, end, strict=True))
        rest = [p for p in pieces if p not in self.cache]
        self.cache.update(zip(rest, self._whole(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if any(c in t for c in self.odd)]
        find = (_BYTE_PIECES if self.byte_level else _WORD_PIECES).findall
        pieces = list(map(find, texts))
        for i in odd:
            pieces[i] = []
        if 2 * len(self.cache) > self.most:
            self.old, self.cache = self.cache, {}
        get = self.cache.get
        parts = [list(map(get, p)) for p in pieces]
        holes = [[i for i, x in enumerate(q) if x is None] if None in q else () for q in parts]
        unknown = {p[i] for p, h in zip(pieces, holes, strict=True) for i in h}
        again = unknown & self.old.keys()
        self.cache.update((x, self.old[x]) for x in again)
        new = list(unknown - again)
        for at in range(0, len(new), 8192):
            self._learn(new[at : at + 8192])
        for p, q, h in zip(pieces, parts, holes, strict=True):
            for i in h:
                q[i] = get(p[i])
        out = list(map(b"".join, parts))
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python process for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
