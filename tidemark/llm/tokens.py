"""Cached encoding with a word-bounded BPE vocabulary.

The vocabulary's pre-tokenizer never joins characters across white space, so a
text's ids are the ids of its white-space-bounded chunks in order. Chunks are
looked up in a bounded dictionary that lives as long as the Python worker;
only chunks not seen before are merged anew.
"""

from __future__ import annotations

import sys

#: The vocabulary's split pattern, and the characters for which
#: its normaliser (NFC, lower case) is plain lower case.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = r"[!-~\u00a1-\u012f\u0131-\u024f]+"
LAST_PLAIN, NOT_PLAIN = "\u024f", "\u0130"
CACHE_BYTES = 64 << 20  # of remembered chunks in each worker
ENTRY = 200  # bytes that a dictionary entry takes besides its two strings
WORD_END = b"\xff"  # a byte that UTF-8 never has


def _byte_characters() -> list[str]:
    """Byte-level vocabularies write printable bytes as themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class WordEncoder:
    """Ids equal to the tokenizer library's own.

    Plain chunks are merged by byte ranks: each token's bytes, a final token's
    with WORD_END behind them, rank by its merge. That gives the ids of pairwise
    merging because every token of the vocabulary merges to itself when it
    stands alone (tests check this for all of them). Any other chunk goes to
    the library.
    """

    def __init__(self, path: str):
        import json
        import os

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_characters()
        byte_of = {c: b for b, c in enumerate(letters)}

        def raw(token: str) -> bytes:
            body = token.removesuffix(end)
            return bytes(map(byte_of.__getitem__, body)) + (WORD_END if body != token else b"")

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + WORD_END: 256 + b for b in range(256)}
        ids = [vocab.get(c, 0) for c in letters] + [vocab.get(c + end, 0) for c in letters]
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ranks[raw(left) + raw(right)] = len(ids)
            ids.append(vocab[left + right])
        self.packed = [i.to_bytes(4, "little") for i in ids]
        self.merge = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.find = regex.compile(SPLIT).findall
        self.plain = regex.compile(PLAIN).fullmatch
        self.chunks: dict[bytes, bytes] = {}
        self.room = CACHE_BYTES

    def _split(self, text: str) -> list[str] | None:
        """The pieces of a plain chunk; None sends it to the library."""
        if text.isalpha() and max(text) <= LAST_PLAIN and NOT_PLAIN not in text:
            return [text.lower()]
        head, last = text[:-1], text[-1]
        if "!" <= last <= "~" and head.isalpha() and max(head) <= LAST_PLAIN and NOT_PLAIN not in head:
            return [head.lower(), last]
        if self.plain(text) and "<|" not in text:
            return self.find(text.lower())
        return None

    def _encode(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        pieces = self._split(text)
        if pieces is None:
            return b"".join([i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids])
        packed, merge = self.packed, self.merge
        return b"".join([packed[r] for p in pieces for r in merge(p.encode() + WORD_END)])

    def encode_all(self, words) -> tuple:
        """(ids of all texts end to end, their bounds by document) of a words.Words."""
        import numpy as np

        from .words import distinct

        which, inverse = distinct(words.hashes())
        chunks = words.some(which)
        ids = list(map(self.chunks.get, chunks))
        new = [w for w, x in zip(chunks, ids) if x is None]
        if new:
            found = dict(zip(new, map(self._encode, new)))
            ids = [found[w] if x is None else x for w, x in zip(chunks, ids)]
            if self.room > 0:
                self.chunks.update(found)
                self.room -= sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = np.cumsum(size) - size
        n = size[inverse]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(place[inverse] - ends[:-1], n) + np.arange(ends[-1])]
        return out, ends[words.first]


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    held = sys.__dict__.setdefault("_tidemark_encoders", {})
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
