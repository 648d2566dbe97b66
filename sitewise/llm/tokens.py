"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import codecs
import gc
import os
import sys
import types
from itertools import chain
from unicodedata import is_normalized

import numpy as np

END = 2  # id that closes a document


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# character that stands for each byte in byte-level vocabularies: printable
# ones for themselves, the others from 256 on; the blank stays a blank
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)} | {32: 32}
_CHARACTERS = "".join(chr(_BYTES.get(b, b)) for b in range(256))


class ChunkIds:
    """Ids of the chunks between ASCII white space, as bytes of one integer
    type.  The tokenizer lower-cases, and splits at white space before it
    merges, so the ids of a text are those of its chunks in order.  Chunks
    are remembered in two generations of ``limit`` each; that only saves
    time."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        # the same merges for words that normalising would not change, as the
        # characters that stand for their bytes
        self.simple = Tokenizer(self.tok.model)
        self.simple.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.limit, self.new, self.old = limit, {}, {}
        vocabulary = self.tok.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.end = np.array([END], self.dtype).tobytes()

    def _put(self, tok, words: list[bytes]) -> list[bytes]:
        """Encode words of letters in a few texts, cut at the ids that end a
        word; returns words for which that does not work out."""
        failed = []
        groups = [words[i:i + 512] for i in range(0, len(words), 512)]
        for at in range(0, len(groups), 8):
            part = groups[at:at + 8]
            texts = [b" ".join(g) for g in part]
            texts = [codecs.charmap_decode(x, "strict", _CHARACTERS)[0] if tok is self.simple else x.decode() for x in texts]
            for group, e in zip(part, tok.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                cut = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
                if len(cut) != len(group):
                    failed += group
                    continue
                raw, start = ids.tobytes(), 0
                for c, stop in zip(group, cut.tolist()):
                    self.new[c] = raw[start:stop]
                    start = stop
        return failed

    def _encode(self, chunks: list[bytes]) -> None:
        """Fill the memory.  A full stop or comma after letters is a word of
        its own to the tokenizer, so such a chunk is put together."""
        plain, letters, other, ended = [], [], [], []
        for c in chunks:
            if c.isalpha() and c.islower():  # ASCII letters only
                plain.append(c)
                continue
            if c[-1] in b".," and c[:-1].isalpha() and c.islower():
                ended.append(c)
                if c[:-1] not in self.new:
                    plain.append(c[:-1])
                continue
            # lower-casing may leave marks, which are no letters
            given = text = c.decode("utf-8", "replace")
            text = text if text.isascii() else text.lower()
            if text[-1] in ".," and text[:-1].isalpha():
                ended.append(c)
                c, text, given = c[:-1], text[:-1], given[:-1]
                if c in self.new:
                    continue
            if text.isalpha():
                same = not c.isascii() and given == text and is_normalized("NFC", text)
                (plain if same else letters).append(c)
            else:
                other.append(c)
        other += self._put(self.simple, list(set(plain))) + self._put(self.tok, list(set(letters)))
        other += [c for c in (b".", b",") if ended and c not in self.new]
        for at in range(0, len(other), 4096):
            part = other[at:at + 4096]
            got = self.tok.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False)
            for c, e in zip(part, got):
                self.new[c] = np.array(e.ids, self.dtype).tobytes()
        for c in ended:
            self.new[c] = self.new[c[:-1]] + self.new[c[-1:]]

    def forget(self) -> None:
        """Free the memory, as a worker lives on after its task."""
        self.new, self.old = {}, {}

    def documents(self, bodies: list[bytes | None]) -> list[bytes]:
        """Ids of each text, with the closing id.  Nothing here makes cycles,
        and collecting them among so many small objects takes a tenth of the
        time, so it waits."""
        waits = gc.isenabled()
        gc.disable()
        try:
            return self._documents(bodies)
        finally:
            if waits:
                gc.enable()

    def _documents(self, bodies: list[bytes | None]) -> list[bytes]:
        split = []
        for b in bodies:
            b = b or b""
            # special tokens are told by their exact spelling
            split.append(b.split() if b"<|" in b else b.lower().split())
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        missing = []
        for c in set(chain.from_iterable(split)).difference(self.new):
            if c in self.old:
                self.new[c] = self.old[c]
            else:
                missing.append(c)
        self._encode(missing)
        look = self.new.__getitem__
        return [b"".join([*map(look, chunks), self.end]) for chunks in split]


def chunk_ids(path: str) -> ChunkIds:
    """The tokenizer of this Python worker, kept outside this module, which
    may travel by value with each task."""
    kept = sys.modules.setdefault("_sitewise_tokens", types.ModuleType("_sitewise_tokens")).__dict__
    if path not in kept:
        kept[path] = ChunkIds(path)
    return kept[path]
