"""Public tokenizers on executors: model files shipped as bytes, texts cut where no token can cross, each distinct piece encoded once.

A text with a space in front is tiled into pieces that begin at its first byte and at each space after a byte or character that is no white space.
A byte-level BPE splits its input there before any merge, and a piece BPE none of whose pieces holds a space after another
character can't merge across; so tokens of a text are those of its pieces, in order. The vocabulary is looked at when the model is loaded, and
other models get whole texts.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pyarrow as pa

#: Distinct pieces that a Python worker keeps with their tokens; then it begins anew.
KEPT_PIECES = 1 << 18


def tiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of some texts that each begin with a space (empty texts have none)."""
    plain = (data > 0x20) & (data < 0x7F)
    letter = np.zeros(len(data), dtype=bool)  # last byte of a two-byte character from U+00C0 on: none of them is white space
    letter[1:] = (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = (data[1:] == 0x20) & (plain | letter)[:-1]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each piece, distinct pieces)."""
    bounds = np.append(starts, len(data)).astype(np.int64)
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = every.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


class PieceModel:
    """A SentencePiece model, from its bytes. It puts a space before a text itself."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        one = self.model.encode("x")
        self._space = self.model.encode("x ")[len(one) :]
        # nothing is normalised away and no piece holds a space after another character
        self.tiled = b"identity" in blob and self.model.encode(" x") != one and not any(" " in x.lstrip(" ") for x in (y.replace("▁", " ") for y in names))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def of_pieces(self, found: list[bytes]) -> list[list[int]]:
        """Tokens of pieces that begin with the space which the model adds."""
        own = self.encode([x[1:].decode("utf-8", "replace") for x in found])
        return [ids if x != b" " else self._space for x, ids in zip(found, own, strict=True)]


class ByteModel:
    """A tokenizer of the ``tokenizers`` library, from its JSON. ``plain``: strings of special tokens are ordinary text."""

    def __init__(self, blob: bytes, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(blob.decode())
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = plain

    @functools.cached_property
    def bytes(self) -> list[bytes]:
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 and on, in order
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
        names = [self.model.id_to_token(k) or "" for k in range(self.model.get_vocab_size())]
        return [bytes(of[c] for c in x) if all(c in of for c in x) else x.encode() for x in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def of_pieces(self, found: list[bytes]) -> list[list[int]]:
        return self.encode([x.decode("utf-8", "replace") for x in found])


#: The models of this Python worker, by digest.
_loaded: dict[tuple[str, bool], PieceModel | ByteModel] = {}


class Source:
    """A tokenizer file, read where the job is written and shipped with it; loaded once by each Python worker."""

    def __init__(self, path: str, plain: bool = False):
        self.kind = path.rsplit(".", 1)[-1]
        if self.kind not in ("json", "model"):
            raise ValueError("a tokenizer is a .json or a .model file")
        with open(path, "rb") as f:
            self.blob = f.read()
        self.plain = plain
        self.digest = hashlib.sha256(self.blob).hexdigest()

    def version(self) -> str:
        """Digest of the file, the library's version and the way in which special strings are read."""
        import importlib.metadata

        library = {"json": "tokenizers", "model": "sentencepiece"}[self.kind]
        return hashlib.sha256(f"{self.digest} {library} {importlib.metadata.version(library)} {self.plain}".encode()).hexdigest()

    def load(self) -> PieceModel | ByteModel:
        key = self.digest, self.plain
        if key not in _loaded:
            _loaded[key] = PieceModel(self.blob) if self.kind == "model" else ByteModel(self.blob, self.plain)
        return _loaded[key]


class Memory:
    """What a worker knows of pieces: a value for each, made for those it has not met; forgotten when it holds ``most``."""

    def __init__(self, make, most: int = KEPT_PIECES):
        self.make, self.most, self.known = make, most, {}

    def __call__(self, found: list[bytes]) -> list:
        new = [x for x in found if x not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = found
        self.known.update(zip(new, self.make(new), strict=True))
        return [self.known[x] for x in found]
