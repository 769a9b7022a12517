"""Token ids of whole texts with a public tokenizer.

The library's pre-tokeniser never joins a space, or an ASCII sign, to the word
before it, so a text's ids are those of its pieces between such places in
order.  The string of an added token inside a text is that token, as the library
has it by default, and a piece of its own.  Pieces repeat: each worker encodes a
piece once and looks it up later, also in the next tasks it runs.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np

from squadlake.llm.textblocks import SpanHasher, byte_class

MAX_PIECES = 1_500_000  # pieces remembered by a worker (about 70 MB); the memory is then started anew
TOKEN_CHUNK_BYTES = 2 << 20

_SPACE = byte_class((0x20, 0x20))
_SPACES = byte_class((0x09, 0x0D), (0x1C, 0x20))
_LETTER = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_SIGN = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
# Lead bytes of two-byte code points of which none is a space (those start with 0xC2).
_TWO_BYTE_LEAD = byte_class((0xC3, 0xDF))


def worker_encoder(tokenizer_path: str, end_id: int) -> PieceEncoder:
    """The encoder of this Python worker, which Spark reuses from task to task."""
    kept = sys.modules.setdefault("_llm_worker_encoders", ModuleType("_llm_worker_encoders")).__dict__
    key = f"{tokenizer_path}|{end_id}"
    if key not in kept:
        kept[key] = PieceEncoder(tokenizer_path, end_id)
    return kept[key]


class PieceEncoder:
    """Encodes chunks of texts; ``end_id`` is appended to each text."""

    def __init__(self, tokenizer_path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError(f"{tokenizer_path}: added tokens that take in their surroundings cannot be cut out")
        self.added = sorted((t.content.encode() for t in added if t.content), key=len, reverse=True)
        self.end_id = end_id
        self.hasher = SpanHasher()
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # hashes in order, and the row of each
        self.rows = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def added_tokens(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Spans of added tokens' strings inside texts: leftmost first, then longest."""
        raw = data.tobytes()
        ends = offsets[1:]
        found = {token: raw.find(token) for token in self.added}
        while any(at >= 0 for at in found.values()):
            at, token = min(((at, token) for token, at in found.items() if at >= 0), key=lambda f: (f[0], -len(f[1])))
            after = at + len(token)
            whole = after <= ends[np.searchsorted(ends, at, "right")]
            if whole:
                yield at, after
            found = {t: raw.find(t, after if whole else at + (t == token)) if 0 <= place < after else place for t, place in found.items()}

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start: at every text, at a space after ink, at a sign after an ASCII
        letter or digit, around an added token and never inside it."""
        cut = np.zeros(len(data), dtype=bool)
        before = data[:-1]
        ink = ~_SPACES[before] & (before < 0x80)
        ink[1:] |= (before[1:] >= 0x80) & _TWO_BYTE_LEAD[data[:-2]]
        cut[1:] = (_SPACE[data[1:]] & ink) | (_SIGN[data[1:]] & _LETTER[before])
        starts = offsets[:-1]
        cut[starts[starts < len(data)]] = True
        for a, b in self.added_tokens(data, offsets):
            cut[a:b] = False
            cut[a] = True
            cut[b:b + 1] = True
        return np.flatnonzero(cut)

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        flat = np.fromiter((i for ids in coded for i in ids), dtype=np.int32, count=int(counts.sum()))
        first = len(self.counts)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, flat])
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.rows = np.insert(self.rows, at, np.arange(first, first + len(coded)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk with the end ids, and the texts' offsets in them."""
        n_texts = len(offsets) - 1
        if not len(data):
            return np.full(n_texts, self.end_id, dtype=np.int32), np.arange(n_texts + 1)
        starts = self.cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        distinct, at, which = np.unique(self.hasher.spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > MAX_PIECES:
            self.forget()
        place = np.searchsorted(self.known, distinct)
        fresh = np.ones(len(distinct), dtype=bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != distinct[inside]
        if fresh.any():
            self._learn(data, distinct[fresh], starts[at[fresh]], ends[at[fresh]])
        rows = self.rows[np.searchsorted(self.known, distinct)][which]
        counts = self.counts[rows]
        # The end ids go in behind each text: shift every piece by the texts that ended before it.
        text = np.searchsorted(offsets, starts, "right") - 1
        per_text = np.bincount(text, weights=counts, minlength=n_texts).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(per_text + 1)])
        out = np.full(bounds[-1], self.end_id, dtype=np.int32)
        place = np.cumsum(counts) - counts
        spread = np.arange(int(counts.sum()))
        source = self.ids[np.repeat(self.starts[rows] - place, counts) + spread]
        out[np.repeat(text, counts) + spread] = source
        return out, bounds
