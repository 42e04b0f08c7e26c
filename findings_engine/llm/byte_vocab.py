"""Byte-level BPE ids of whole texts, fast enough for a corpus.

The vocabulary's pattern always starts a new piece at a space between two other characters that aren't white
space, and looks at nothing left of it. So a text is cut there, each part (" word,") is encoded once and its
ids are remembered; only new parts reach the encoder. A text that holds a special token's string goes to the
library whole. A run of LONG_RUN white spaces and more never reaches the encoder's pattern, whose stack it would
overflow: all of the run but a last character before other text is one piece, which is merged as such.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

from .common import REMEMBERED_CHARS

#: Parts that one generation of the memory holds; there are two.
MEMORY = 300_000
#: Signs that are neither letters, digits, white space nor the apostrophe of a contraction.
SIGNS = ".,;:!?%&*$#"
#: White space as the vocabulary's pattern knows it, so many in a row.
LONG_RUN = 1000
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class ByteVocab:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.code = np.dtype(self.kind).char
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.lengths = np.zeros(self.size, np.int64)  # bytes of each token
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        for token, i in self.library.get_vocab().items():
            self.lengths[i] = len(token.encode()) if token in special else len(token)  # one character stands for each byte
        self.encoder = self._fast(path)
        self.plain = self.encoder._core_bpe.encode_ordinary
        self.signs: dict[str, bytes] = {}
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _fast(self, path: str):
        """The same merges in the faster of the two libraries; the vocabulary's ranks are its ids' order."""
        import tiktoken

        code = {}  # the character that stands for each byte in the vocabulary's file
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        for b in plain:
            code[chr(b)] = b
        for n, b in enumerate(b for b in range(256) if b not in plain):
            code[chr(256 + n)] = b
        ranks = {bytes(code[c] for c in token): i for token, i in self.library.get_vocab().items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> list[str]:
        """The text's first part, and the others without the space that each begins with."""
        parts = text.split(" ")
        if list(map(str.strip, parts)) == parts and "" not in parts:
            return parts
        return _LONE_SPACE.split(text)  # some space stands at an end or beside other white space

    def _encode(self, text: str) -> bytes:
        if len(text) < LONG_RUN:
            return array(self.code, self.plain(text)).tobytes()
        ids, at = array(self.code), 0
        for run in _LONG_RUN.finditer(text):
            ids.extend(self.encoder.encode_ordinary(text[at : run.start()]))
            at = run.end() - (run.end() < len(text))
            ids.extend(self.encoder._encode_single_piece(text[run.start() : at]))
        ids.extend(self.encoder.encode_ordinary(text[at:]))
        return ids.tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids as the library gives them without special tokens around it."""
        return [np.frombuffer(raw, self.kind) for raw in self.encoded(texts)]

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The same as bytes, of ``kind`` each."""
        out, special = [], self.special
        for text in texts:
            for s in special:
                if s in text:
                    out.append(array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes())
                    break
            else:
                first, *rest = self.parts(text)
                found = list(map(self.now.get, rest))
                if None in found:
                    self._complete(rest, found)
                out.append(self._encode(first) + b"".join(found))
        return out

    def _complete(self, rest: list[str], found: list[bytes | None]) -> None:
        """Encode the parts that the newer generation lacks, or take them over from the older."""
        if len(self.now) > MEMORY:
            self.before, self.now = self.now, {}
        now, before, k = self.now, self.before, -1
        for _ in range(found.count(None)):
            k = found.index(None, k + 1)
            part = rest[k]
            if len(part) > REMEMBERED_CHARS:
                found[k] = self._encode(f" {part}")
                continue
            ids = now.get(part)
            if ids is None:
                ids = now[part] = before.get(part) or self._learn(part)
            found[k] = ids

    def _learn(self, part: str) -> bytes:
        """Ids of a new part. Signs after its last letter are a piece of their own, so a known word stays known before a comma."""
        word = part.rstrip(SIGNS)
        if len(word) == len(part) or not word[-1:].isalpha():
            return self._encode(f" {part}")
        ids = self.now.get(word) or self.before.get(word)
        if ids is None:
            ids = self._encode(f" {word}")
        self.now[word] = ids
        signs = part[len(word) :]
        if signs not in self.signs:
            if len(self.signs) > 10_000:
                self.signs.clear()
            self.signs[signs] = self._encode(signs)
        return ids + self.signs[signs]


@lru_cache(maxsize=2)
def load(path: str) -> ByteVocab:
    """One vocabulary for each worker process, whose memory outlives a task."""
    return ByteVocab(path)
