"""SentencePiece merge-type (BPE) vocabularies: encoding by an agenda of adjacent symbol pairs.

The text's spaces become U+2581 with one in front; the symbols are then its characters. An agenda holds every
adjacent pair whose concatenation is a piece; the pair of the highest score (leftmost among equals) merges
until none is left. No piece of such a vocabulary has U+2581 after another character, so no merge crosses
the start of a run of U+2581 and each such segment is encoded once and remembered. New segments of an
Arrow batch are encoded together: those of one length keep their agendas as rows of a matrix, which advance by one merge a step;
a long segment has a heap of its own. The library encodes the same new segments, and a difference is an error.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np

from .common import REMEMBERED_CHARS

SPACE = "▁"
#: Segments up to this many symbols advance together as rows of a matrix.
WIDE = 24
#: Segments that one generation of the memory holds; there are two.
MEMORY = 450_000
#: Texts whose new segments are encoded together.
BLOCK = 128
_NO_RANK = np.iinfo(np.int32).max
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_IRREGULAR = re.compile(f"^ | $|  |{SPACE}")


class MergeVocab:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        if any(lib.is_unused(i) for i in range(size)):
            raise ValueError("unused pieces need resegmentation, which this encoder lacks")
        pieces = {lib.id_to_piece(i): i for i in range(size) if not special[i]}
        self.split = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        symbols = dict(pieces)
        for p in pieces:  # characters that are no pieces themselves may still merge into one
            for c in p:
                symbols.setdefault(c, size + len(symbols))
        ranks = {s: r for r, s in enumerate(sorted({lib.get_score(i) for i in pieces.values()}, reverse=True))}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (ranks[lib.get_score(i)], i)
        self.pairs, self.span = pairs, size + len(symbols) + 1
        keys = np.array([a * self.span + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)[order]
        self.keys, self.pair_rank, self.pair_piece = np.append(keys[order], np.iinfo(np.int64).max), np.append(values[:, 0], _NO_RANK), np.append(values[:, 1], 0)
        self.of_char = -(np.arange(0x110000, dtype=np.int32) + 2)  # a character of no piece: minus its code point, minus 2
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.size = size
        self.char_of = {i: s for s, i in symbols.items() if i >= size}
        self.byte_id = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(lib.is_byte(i) for i in self.byte_id)
        self.bytes_of = [bytes([self.byte_id.index(i)]) if lib.is_byte(i) else b"" if lib.is_control(i) else lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        self.unknown = lib.unk_id()
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        self.text_of = [str(i) for i in range(size)]
        #: A segment's ids as text, or with the text that they decode to where that isn't the segment itself.
        self.now: dict[str, str | tuple[str, str]] = {}
        self.before: dict[str, str | tuple[str, str]] = {}

    # -- the agenda ---------------------------------------------------------------------------------
    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (none: the largest int) and merged piece of each pair of symbols."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.span + right, -1)
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.pair_rank[at], _NO_RANK), self.pair_piece[at]

    def _merge_rows(self, segments: list[str]) -> list[list[int]]:
        """The symbols left of each segment, all of one length; all agendas advance by one merge a step."""
        out: list = [None] * len(segments)
        symbols = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)].reshape(len(segments), -1)
        rows = np.arange(len(segments))
        rank, piece = self._look_up(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if symbols.shape[1] > 1:
                at = rank.argmin(axis=1)  # the first of equals is the leftmost
                going = rank[np.arange(len(rows)), at] < _NO_RANK
            else:
                going = np.zeros(len(rows), bool)
            for r, s in zip(rows[~going].tolist(), symbols[~going].tolist(), strict=True):
                out[r] = s
            if not going.any():
                break
            rows, symbols, rank, piece, at = rows[going], symbols[going], rank[going], piece[going], at[going]
            each, width = np.arange(len(rows)), symbols.shape[1]
            symbols[each, at] = piece[each, at]
            rest = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])  # all columns but the one right of the merge
            symbols = np.take_along_axis(symbols, rest, axis=1)
            if width > 2:
                rest = rest[:, :-1] - (rest[:, :-1] == width - 1)
                rank, piece = np.take_along_axis(rank, rest, axis=1), np.take_along_axis(piece, rest, axis=1)
                for near in (np.minimum(at, width - 3), np.maximum(at - 1, 0)):
                    rank[each, near], piece[each, near] = self._look_up(symbols[each, near], symbols[each, near + 1])
        return out

    def merge_heap(self, segment: str) -> list[int]:
        """The same for one segment of any length: a heap of (rank, position, left, right)."""
        symbols: list[int | None] = self.of_char[np.frombuffer(segment.encode("utf-32-le"), np.uint32)].tolist()
        n = len(symbols)
        after, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def add(i: int, j: int) -> None:
            if found := self.pairs.get((symbols[i], symbols[j])):
                heapq.heappush(agenda, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            _, i, left, right, merged = heapq.heappop(agenda)
            if symbols[i] != left or (j := after[i]) >= n or symbols[j] != right:
                continue  # one of its symbols has merged since
            symbols[i], symbols[j], after[i] = merged, None, after[j]
            if after[i] < n:
                previous[after[i]] = i
                add(i, after[i])
            if previous[i] >= 0:
                add(previous[i], i)
        return [s for s in symbols if s is not None]

    def _to_ids(self, symbols: list[int]) -> list[int]:
        ids = []
        for s in symbols:
            if 0 <= s < self.size:
                ids.append(s)
            elif self.fallback:
                ids += [self.byte_id[b] for b in (chr(-s - 2) if s < 0 else self.char_of[s]).encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def merge(self, segments: list[str]) -> list[list[int]]:
        out: list = [None] * len(segments)
        by_length: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            by_length.setdefault(len(s), []).append(k)
        for length, members in by_length.items():
            merged = self._merge_rows([segments[k] for k in members]) if length <= WIDE else [self.merge_heap(segments[k]) for k in members]
            for k, symbols in zip(members, merged, strict=True):
                out[k] = symbols if max(symbols) < self.size and min(symbols) >= 0 else self._to_ids(symbols)
        return out

    # -- whole texts --------------------------------------------------------------------------------
    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if self.split and not _IRREGULAR.search(text):
            return text.split(" ")  # each stands for itself with one U+2581 in front
        marked = SPACE + text.replace(" ", SPACE)
        return [s[1:] for s in _SEGMENT.findall(marked)] if self.split else [marked[1:]]

    def pieces_text(self, ids: list[int]) -> str:
        """The ids' pieces joined, with the space that stands in front."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")

    def learn(self, segments: set[str]) -> dict[str, str | tuple[str, str]]:
        """Encode and decode new segments; the library has to encode them alike."""
        new = list(segments)
        ids = self.merge([SPACE + s for s in new])
        theirs = self.library.encode([s.replace(SPACE, " ") for s in new], num_threads=1)
        for s, x, y in zip(new, ids, theirs, strict=True):
            if x != y and s:
                raise ValueError(f"the agenda and the library differ on {s!r}: {x} {y}")
        text_of, out = self.text_of.__getitem__, {}
        for s, x in zip(new, ids, strict=True):
            written, decoded = ",".join(map(text_of, x)), self.pieces_text(x)
            out[s] = written if decoded == " " + s.replace(SPACE, " ") else (written, decoded)
        return out

    def encode_decode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Each text's ids, joined by commas, and the text that they decode to."""
        out = []
        for at in range(0, len(texts), BLOCK):
            known_texts = texts[at : at + BLOCK]
            block = [self.segments(t) for t in known_texts]
            found = [list(map(self.now.get, segments)) for segments in block]
            missing = {s for segments, known in zip(block, found, strict=True) if None in known for s, k in zip(segments, known, strict=True) if k is None}
            added = self._recall(missing) if missing else {}
            for text, segments, known in zip(known_texts, block, found, strict=True):
                all_known = [added[s] if k is None else k for s, k in zip(segments, known, strict=True)] if None in known else known
                try:  # every segment decodes to itself, and so does the text
                    out.append((",".join(all_known), text.replace(SPACE, " ")))
                except TypeError:
                    both = [(k, " " + s.replace(SPACE, " ")) if isinstance(k, str) else k for s, k in zip(segments, all_known, strict=True)]
                    out.append((",".join([b[0] for b in both]), "".join([b[1] for b in both]).removeprefix(" ")))
        return out

    def _recall(self, missing: set[str]) -> dict[str, str | tuple[str, str]]:
        """What the newer generation of the memory lacks: taken over from the older, or learned."""
        old = missing & self.before.keys()
        added = {s: self.before[s] for s in old} | self.learn(missing - old)
        if len(self.now) + len(added) > MEMORY:
            self.before, self.now = self.now, {}
        self.now.update((s, x) for s, x in added.items() if len(s) <= REMEMBERED_CHARS)
        return added


@lru_cache(maxsize=2)
def load(path: str) -> MergeVocab:
    """One vocabulary for each worker process, whose memory outlives a task."""
    return MergeVocab(path)
