"""Exact, column-at-a-time encoding with the tokenizers library.

A column is cut at white space into chunks, which are dictionary-encoded: each distinct chunk is encoded
once and its ids are gathered back. Chunks of plain characters (ASCII and Latin-1) are pre-tokenised here
and only their distinct pieces meet the BPE model; all other chunks, and whole texts with runs of white space
that a cut would disturb or with an added token, go through the library's full encode call. Ids equal those
of that call.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text encoded at a time.
SLICE_BYTES = 10 << 20
#: Chunks, and pieces, that one worker remembers across batches.
CACHE_CHUNKS, CACHE_PIECES = 200_000, 100_000

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SAFE = re.compile("[!-~\nÀ-ÿ]*")
# How the vocabulary files split text, for characters of _SAFE.
_PIECES = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+"),
}


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write a byte as itself if it is printable, else as the next letter from 256 on."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Encoder:
    """Encodes Arrow string columns; path names a file of the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        added = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        #: Finds every text in which the library may match an added token, whatever its normalizer does to case.
        self.added = f"(?i){'|'.join(map(re.escape, added))}" if added else None
        #: Signs that every such text holds as they are, as no case, accent or composition makes them; found faster.
        signs = {max(re.findall(r"[<>|\[\]{}]+", t), key=len, default="") for t in added}
        self.signs = sorted(signs) if all(signs) else None
        self.model = self.tk.model
        self.dtype = np.dtype("<u2") if self.tk.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path) as f:
            spec = json.load(f)
        pre, norm = json.dumps(spec.get("pre_tokenizer")), json.dumps(spec.get("normalizer"))
        self.kind = None
        if spec["model"].get("type") == "BPE":
            if norm == "null" and '"use_regex": true' in pre and "Split" not in pre and '"add_prefix_space": false' in pre:
                self.kind = "byte"
            elif "Lowercase" in norm and "NFC" in norm and "Removed" in pre and "ByteLevel" in pre:
                self.kind = "word"
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _full(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        ids = array(self.code, [t.id for t in self.model.tokenize(piece.translate(self.letters))]).tobytes()
        if len(self.pieces) < CACHE_PIECES:
            self.pieces[piece] = ids
        return ids

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, none of which has white space at an end except a leading space of kind byte."""
        find, get, safe, seen = _PIECES[self.kind].findall, self.pieces.get, _SAFE.fullmatch, self.chunks
        space = self.kind == "byte"
        out = list(map(seen.get, chunks))
        odd: list[int] = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            c = chunks[k]
            if safe(c, 1 if space and c[:1] == " " else 0):
                out[k] = ids = b"".join([get(p) or self._piece(p) for p in find(c if space else c.lower())])
                if len(seen) < CACHE_CHUNKS:
                    seen[c] = ids
            else:
                odd.append(k)
        for i in range(0, len(odd), 5000):
            for k, ids in zip(odd[i : i + 5000], self._full([chunks[k] for k in odd[i : i + 5000]])):
                out[k] = ids
        return out

    def _slice(self, texts: pa.Array) -> list[bytes]:
        if self.kind is None:
            return self._full(texts.to_pylist())
        raw = texts
        if self.kind == "word":
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        distinct = coded.dictionary.to_pylist()
        whole = np.zeros(len(texts), bool)
        if self.added:
            maybe = np.ones(len(raw), bool) if self.signs is None else np.logical_or.reduce([pc.match_substring(raw, x).to_numpy(zero_copy_only=False) for x in self.signs])
            at = np.flatnonzero(maybe)
            whole[at] = pc.match_substring_regex(raw.take(pa.array(at)), self.added).to_numpy(zero_copy_only=False)
        if self.kind == "byte":
            # A chunk but the first of a text carries the space before it.
            bad = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in distinct), bool, len(distinct))
            firsts = np.unique(codes[offsets[:-1]])
            lookup = np.zeros(len(distinct), np.int64)
            lookup[firsts] = np.arange(len(firsts)) + len(distinct)
            hit = bad[codes]
            if hit.any():
                whole |= np.add.reduceat(hit.astype(np.int64), offsets[:-1]) > 0
            ids = self._chunks([" " + w if not b else "" for w, b in zip(distinct, bad)] + [distinct[k] if not bad[k] else "" for k in firsts])
            codes = codes.copy()
            codes64 = codes.astype(np.int64)
            codes64[offsets[:-1]] = lookup[codes[offsets[:-1]]]
            codes = codes64
        else:
            ids = self._chunks(distinct)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = pa.array(ids, pa.large_binary()).take(pa.array(codes))
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(size[codes], out=ends[1:])
        buf = memoryview(flat.buffers()[2] or b"")
        cut = ends[offsets].tolist()
        out = [bytes(buf[a:b]) for a, b in zip(cut, cut[1:])]
        again = np.flatnonzero(whole)
        if len(again):
            for k, one in zip(again.tolist(), self._full(raw.take(pa.array(again)).to_pylist())):
                out[k] = one
        return out

    def encode(self, texts: pa.Array):
        """Yield the packed ids of each text (null: none), in order."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, side="right")))
            gc.disable()  # many small objects are made, none in cycles
            try:
                out = self._slice(texts.slice(at, to - at))
            finally:
                gc.enable()
            yield from out
            at = to


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder of a file per Python worker."""
    return Encoder(path)
