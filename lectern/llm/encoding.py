"""Whole-text token ids by a public tokenizer, with a cache of chunks.

A text is cut where the tokenizer's own pre-tokenizer always cuts, so each chunk's ids do not depend on its
neighbours and can be remembered. A batch of texts is cut and its distinct chunks are found by Arrow. Plain chunks (common
letters, digits and signs) are cut further by the tokenizer's pattern, all in one go, and their pieces go to the
tokenizer's model or are remembered; any other chunk goes to the whole tokenizer. The texts' ids are put together from the chunks' by array steps. A text whose cuts are not certain (white space beside white space), or that has
the literal of an added token, is encoded whole.

A worker process keeps one encoder for each tokenizer, whatever tasks it runs; caches are bounded in bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of one generation of a cache (it holds two), bytes of an entry beside its letters and ids, and the longest key kept.
CACHE_BYTES, ENTRY_BYTES, LONGEST = 64 << 20, 160, 256
#: Letters whose normal forms and classes need no tables, beyond ASCII.
LETTERS = "À-ÖØ-öø-įĲ-ɏ"
SIGNS = "!-/:-@\\[-`{-~"
PLAIN = f"^[!-~{LETTERS}]+$"
SAFE = re.compile(f"[!-~{LETTERS}]+").fullmatch
#: The patterns of the two public pre-tokenizers over the safe letters, digits and signs; of the second, with the space between chunks.
PIECES = {
    "byte": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+|\\s+(?!\\S)|\\s+"),
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[{SIGNS}]+| "),
}


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Remembered(dict):
    """key -> make(key), kept for two generations of so many bytes each; None is not kept, nor is a long key."""

    def __init__(self, make: Callable[[str], Any], limit: int, size_of: Callable[[Any], int] = len):
        super().__init__()
        self.make, self.limit, self.size_of, self.size, self.old = make, limit, size_of, 0, {}

    def __missing__(self, key: str) -> Any:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
            if out is None or len(key) > LONGEST:
                return out
        n = ENTRY_BYTES + len(key) + self.size_of(out)
        if self.size + n > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += n
        self[key] = out
        return out


class ChunkEncoder:
    """ids_bytes(texts): the ids of each text as little-endian unsigned 32-bit integers.

    kind "byte": byte-level BPE, where a single space between two non-spaces always begins a piece and a
    single newline between two non-spaces always is one. kind "word": lower case, white space is dropped and
    always cuts.
    """

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind, self.tokenize, self.letters = kind, self.tok.model.tokenize, byte_letters()
        #: The whole tokenizer takes these out of the text before any cut is made.
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.id_bytes = [k.to_bytes(4, "little") for k in range(1 + max(self.tok.get_vocab().values()))]
        self.odd, self.pieces = Remembered(self.odd_chunk, CACHE_BYTES // 4), Remembered(self.piece, CACHE_BYTES)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a piece by the tokenizer's model, which wants its bytes as the vocabulary's letters; a lone space marks a chunk's beginning."""
        if piece == " ":
            return b""
        mapped = piece if piece.isascii() and piece.isalnum() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
        of = self.id_bytes
        return b"".join([of[t.id] for t in self.tokenize(mapped)])

    def odd_chunk(self, chunk: str) -> bytes | None:
        """A chunk that is not plain, or (kind byte) one behind a newline or at the text's beginning, which are marked; None if the cut beside it is not certain."""
        if self.kind == "word":
            return self.whole(chunk) if chunk else b""
        head, body = ("", chunk[1:]) if chunk[:1] == "\0" else ("\n", chunk[2:]) if chunk[:2] == "\n\0" else (" ", chunk)
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        return b"".join(map(self.pieces.__getitem__, PIECES["byte"].findall(head + body))) if SAFE(body) else self.whole(head + body)

    def cut(self, texts: pa.Array) -> pa.Array:
        """The chunks of each text."""
        if self.kind == "word":
            for space in "\t\n\v\f\r":
                texts = pc.replace_substring(texts, space, " ")
        else:
            texts = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), pc.replace_substring(texts, "\n", " \n\0"), pa.scalar("", pa.large_string()))
        return pc.split_pattern(texts, " ")

    def encoded(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct chunks: all their ids, where each one's begin, how many they are, and whether they are certain."""
        plain = pc.match_substring_regex(chunks, PLAIN).to_numpy(zero_copy_only=False)
        start, size, sure, found = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), np.ones(len(chunks), bool), []
        if plain.any():
            words = chunks.filter(pa.array(plain))
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", pa.large_string()))[0].as_py()
            pieces = PIECES[self.kind].findall(" " + (joined.lower() if self.kind == "word" else joined))
            found = list(map(self.pieces.__getitem__, pieces))
            begin = np.flatnonzero(np.fromiter([p[0] == " " for p in pieces], bool, len(pieces)))
            size[plain] = np.add.reduceat(np.fromiter(map(len, found), np.int64, len(found)), begin) // 4
        odd = list(map(self.odd.__getitem__, chunks.filter(pa.array(~plain)).to_pylist()))
        sure[~plain] = [x is not None for x in odd]
        odd = [x or b"" for x in odd]
        size[~plain] = np.fromiter(map(len, odd), np.int64, len(odd)) // 4
        start[plain] = np.cumsum(size[plain]) - size[plain]
        start[~plain] = size[plain].sum() + np.cumsum(size[~plain]) - size[~plain]
        return np.frombuffer(b"".join(found + odd), "<u4"), start, size, sure

    def ids_bytes(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        certain = np.array([bool(t) and not any(a in t for a in self.added) and (self.kind == "word" or "\0" not in t) for t in texts], bool)
        lists = self.cut(pa.array([t if ok else "" for t, ok in zip(texts, certain)], pa.large_string()))
        chunks = lists.flatten().dictionary_encode()
        number, first = chunks.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat, start, size, sure = self.encoded(chunks.dictionary)
        if not sure.all():
            seen = np.append(0, np.cumsum(~sure[number]))[first]
            certain &= seen[:-1] == seen[1:]
        start, size = start[number], size[number]
        end = np.append(0, np.cumsum(size))
        out = flat[np.arange(end[-1]) + np.repeat(start - end[:-1], size)].tobytes()
        edge = (4 * end[first]).tolist()
        return [out[a:b] if ok else self.whole(t) if t else b"" for t, ok, a, b in zip(texts, certain.tolist(), edge, edge[1:])]


@cache
def encoder(path: str, kind: str) -> ChunkEncoder:
    """The encoder of this worker process, with what it has seen in earlier tasks."""
    return ChunkEncoder(path, kind)
