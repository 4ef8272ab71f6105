"""Byte-level BPE ids by the tokenizers library, with a memory of words.

BPE works within the pieces that the byte-level pre-tokenizer cuts, so a piece's ids are the same
in every text. Each Python worker remembers the ids of the pieces that it has met (up to MEMORY
pieces) and gives only new ones to the library.
"""

from __future__ import annotations

import os
import re

import numpy as np

MEMORY = 600_000

#: Texts with other characters than these go to the library whole: there, classes of letters and digits of
#: Unicode versions and of the two pattern languages may differ.
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e¡-©«-±´¶-¸»¿-ɏ‐-‧]")
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: The byte-level pre-tokenizer's pattern, written for those characters, frequent kinds first where the order is free.
PIECES = re.compile(rf" ?[{LETTER}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+")
SPACED_WORD = re.compile(rf" [{LETTER}]+").fullmatch
BARE_WORD = re.compile(rf"[{LETTER}]+").fullmatch
#: New words that are encoded as one text; the library's time for each grows with longer texts.
TOGETHER = 64


class Encoder:
    """Ids as bytes (little-endian, unsigned, 32 bits) for texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(k) or "").startswith("Ġ") for k in range(size)])
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Remembers the ids of new pieces.

        Words are encoded together, as the pre-tokenizer parts them again: of a word after a space only the first token
        holds a space, and words without one are put on lines, whose ends are tokens by themselves.
        """
        spaced, bare, others = [], [], []
        for piece in pieces:
            (spaced if SPACED_WORD(piece) else bare if BARE_WORD(piece) else others).append(piece)
        for words, mark in ((spaced, ""), (bare, "\n")):
            groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
            texts = ["".join([mark + w for w in g]) for g in groups]
            for group, encoded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(encoded.ids, "<u4")
                first = np.flatnonzero(ids == self.line_end if mark else self.spaced[ids])
                ends = np.append(first[1:], len(ids)) * 4
                data = ids.tobytes()
                for word, a, b in zip(group, ((first + bool(mark)) * 4).tolist(), ends.tolist()):
                    self.memory[word] = data[a:b]
        for piece, encoded in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self.memory[piece] = np.array(encoded.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        usual = [not UNUSUAL.search(t) and not any(s in t for s in self.special) for t in texts]
        pieces = [PIECES.findall(t) if ok else None for t, ok in zip(texts, usual)]
        met = set().union(*[p for p in pieces if p is not None])
        new = met.difference(self.memory)
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
            new = met
        if new:
            self.learn(new)
        memory = self.memory
        return [self.whole(t) if p is None else b"".join([memory[x] for x in p]) for t, p in zip(texts, pieces)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file that every executor has at this path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
