"""Encoding texts to token ids with a public tokenizer, in workers.

A byte-level BPE encodes each pre-token alone, and a pre-token never reaches past the space before a
word. So texts are cut before every single space that stands between two visible characters; the distinct
chunks of some megabytes of text are found at once, each is encoded once by the tokenizers library, and the
texts' ids are gathered from a table. Texts that hold a special token's string, or other white space, are
encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from . import workers

#: White space other than single spaces and line ends.
_ODD = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_DOUBLE = ("  ", " \n", "\n ", "\n\n")
#: Entries in a worker's table of chunks; a full table is set aside and begun anew, results do not change.
MEMO_ENTRIES = 400_000
#: Longer chunks are rare words or unspaced text and are not remembered.
MEMO_BYTES = 40
#: Text that is cut and gathered at once.
CUT_BYTES = 8 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or else the next free code point from 256."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Chunk (its bytes) -> its ids; what is missing is put together from its parts, or encoded.

    A chunk is a word with the space before it, or a text's first word. After a line end it starts with " \\n", which
    stands for the line end alone: the space is put there to cut at.
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.older = encoder, {}

    def aged(self) -> None:
        """Keep what is here aside and begin anew; what is asked for again comes back, the rest goes at the next time."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is not None:
            self[chunk] = ids
            return ids
        lead = chunk[:1] if chunk[:1] == b" " else b""
        word = chunk[len(lead) :].decode()
        if word.isalpha():  # one pre-token: its merges alone
            letters = self.encoder.letters
            shown = word if word.isascii() else "".join(map(letters.__getitem__, chunk[len(lead) :]))
            ids = array("I", [t.id for t in self.encoder.merged(letters[32] + shown if lead else shown)]).tobytes()
        elif word[:1] == "\n" and len(word) > 1:
            ids = self[b" \n"] + self[chunk[2:]]
        elif word[-1:] in (",", ".") and word[-2:-1].isalpha():
            ids = self[chunk[:-1]] + self[chunk[-1:]]
        else:
            ids = self.encoder.whole(chunk.decode() if word != "\n" else word)
        if len(chunk) <= MEMO_BYTES:
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian uint32; one per worker process and file."""

    _made: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, entries: int | None = None):
        self.entries = MEMO_ENTRIES if entries is None else entries
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        kind = self.tok.pre_tokenizer.__class__.__name__
        self.chunked = kind == "ByteLevel" and self.tok.normalizer is None
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.merged = self.tok.model.tokenize
        self.memo = _Memo(self)

    @classmethod
    def of(cls, path: str, entries: int | None = None) -> Encoder:
        """The process's encoder of a file, with a table of so many entries; it stays until a task of other work begins."""
        key = (path, MEMO_ENTRIES if entries is None else entries)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _plain(self, text: str) -> bool:
        return self.chunked and not (_ODD.search(text) or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _DOUBLE) or any(s in text for s in self.special))

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty. Works through some megabytes of text at a time."""
        held: list[bytes | np.ndarray] = []  # a text to cut, or ids
        size = 0
        for text in texts:
            if text and self._plain(text):
                held.append(text.replace("\n", " \n").encode())
                size += len(held[-1])
            else:
                held.append(np.frombuffer(self.whole(text or ""), "<u4"))
                size += 4 * len(held[-1])
            if size >= CUT_BYTES:
                yield from self._gathered(held)
                held, size = [], 0
        yield from self._gathered(held)

    def _gathered(self, held: list[bytes | np.ndarray]) -> Iterator[np.ndarray]:
        cut = [x for x in held if isinstance(x, bytes)]
        if not cut:
            yield from held
            return
        data = b"".join(cut)
        begins = np.cumsum([0, *map(len, cut)])
        at = np.frombuffer(data, np.uint8) == 32
        at[begins[:-1]] = True
        edges = np.append(np.flatnonzero(at), len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        if len(self.memo) > self.entries:
            self.memo.aged()
        ids_of = list(map(self.memo.__getitem__, chunks.dictionary.to_pylist()))
        flat, length = np.frombuffer(b"".join(ids_of), "<u4"), np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // 4
        which = chunks.indices.to_numpy()
        many = length[which]
        upto = np.cumsum(many)
        place = np.repeat(((np.cumsum(length) - length)[which] - upto + many).astype(np.int32), many)  # some megabytes of ids
        place += np.arange(upto[-1], dtype=np.int32)
        ids = flat[place]
        ends = upto[np.searchsorted(edges, begins[1:]) - 1].tolist()
        start, k = 0, 0
        for x in held:
            if isinstance(x, bytes):
                yield ids[start : ends[k]]
                start, k = ends[k], k + 1
            else:
                yield x


workers.keeps("tokens", Encoder._made.clear)
