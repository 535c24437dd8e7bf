"""Token ids of whole texts by the tokenizers library, with a bounded cache of space-separated chunks.

A tokenizer whose pre-tokenizer drops white space never merges across it, so a text's ids are those of
its chunks one after another. Chunks recur, so most come from the cache; the library encodes the rest.
Texts outside the plain Latin range (or holding an added token) go to the library whole, as do all texts
of tokenizers that keep white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

#: Ranges of Latin letters, digits and punctuation: composed already, lower-cased letter by letter, white space as
#: str.split has it.
_RANGES = ((0x09, 0x0D), (0x20, 0x7E), (0x85, 0x85), (0xA0, 0x12F), (0x131, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC))


def _in_ranges(c: str) -> bool:
    return any(a <= ord(c) <= z for a, z in _RANGES)


#: Characters of these ranges whose lower case lies in them too; others (U+0181 and the like) go to the library.
_PLAIN = re.compile("[" + "".join(re.escape(c) for a, z in _RANGES for c in map(chr, range(a, z + 1)) if len(c.lower()) == 1 and _in_ranges(c.lower())) + "]*")
#: The splits of that tokenizer within the plain range (the general rule is in its file).
_SPLITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^\\s0-9a-zªµºß-öø-ɏ²³¹¼-¾]+")
#: Bytes that the cached chunks of one worker may take, by an upper estimate of each entry.
_CACHE_BYTES = 120 << 20
#: What an entry takes beside its chunk's letters and its ids: two objects' heads and a slot of the dictionary.
_ENTRY_BYTES = 210


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is visible Latin-1, else the next code point from 256 on."""
    letters, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


_LETTERS = dict(enumerate(byte_letters()))


class ChunkEncoder:
    """``encode(texts)``: for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.drops_space = self._drops_space()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self._model = self.library.model.tokenize

    def _drops_space(self) -> bool:
        """Whether this is the lower-casing tokenizer whose splits are cut at white space."""
        normal = self.library.normalizer
        pre = self.library.pre_tokenizer
        probe = "Ab, c'd\n e1"
        return bool(normal and pre) and normal.normalize_str(probe) == "ab, c'd e1" and all(" " not in w and "Ġ" not in w for w, _ in pre.pre_tokenize_str("ab, c'd e1"))

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_model(self, chunk: str) -> bytes:
        """Ids of one chunk of the plain range, from the library's model, without its slow splitting."""
        tokenize = self._model
        ids = [t.id for w in _SPLITS.findall(chunk) for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS))]
        return np.array(ids, dtype="<u4").tobytes()

    def _filled(self, chunks: list[str]) -> bytes:
        """Ids of chunks of which some aren't cached. A cache that is full is emptied before the next one goes in."""
        cache, out = self.cache, []
        for c in chunks:
            ids = cache.get(c)
            if ids is None:
                ids = self._by_model(c)
                if len(c) <= 64:  # long ones hardly come again
                    if self.held > _CACHE_BYTES:
                        cache.clear()
                        self.held = 0
                    cache[c] = ids
                    self.held += _ENTRY_BYTES + 2 * len(c) + len(ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = ["" if t is None else t for t in texts]
        out: list[bytes] = [b""] * len(texts)
        whole: list[int] = []
        for i, text in enumerate(texts):
            if not self.drops_space or not _PLAIN.fullmatch(text) or ("<|" in text and any(a in text for a in self.added)):
                whole.append(i)
                continue
            chunks = text.lower().split()
            cache = self.cache
            try:
                out[i] = b"".join([cache[c] for c in chunks])
            except KeyError:
                out[i] = self._filled(chunks)
        for k in range(0, len(whole), 64):
            part = whole[k : k + 64]
            for i, ids in zip(part, self._by_library([texts[i] for i in part]), strict=True):
                out[i] = ids
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
