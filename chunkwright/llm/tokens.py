"""Exact, fast token ids from the public tokenizer files.

Both public tokenizers split a text at white space before any merge is applied, so the ids of a text are the
ids of its chunks in order. A batch of texts is split and its chunks numbered in Arrow, so Python sees each
distinct chunk of a batch once; a bounded per-process cache from chunk to packed ids then spares most calls of
the library. The cache changes no id. The word BPE drops white space, so its chunks are what lies between spaces
and line ends; the byte-level BPE's are ``\\s*\\S+`` and a final ``\\s+``, split at spaces alone where no two
meet. Texts that may hold the string of a special token go to the library whole, which gives them that token's id.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import workers

#: Unicode white space, as the tokenizers see it.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_CHUNK_BYTES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Chunks kept per process in each of two generations; about 170 bytes each.
CACHE_CHUNKS = 500_000
#: Characters of texts that are split and looked up together.
BATCH_CHARS = 1_000_000
#: Longer chunks go to the library each time.
CACHE_CHUNK_CHARS = 32
#: Behind a letter, a run of these is a piece of its own to both tokenizers.
MARKS = ".,;:!?%*$#&|"

_ENCODERS: dict[str, "ChunkEncoder"] = {}


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine; a path is returned as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes whole texts to packed little-endian uint32 ids, chunk by chunk."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        contents = [t.content for t in added]
        self.folded = any(t.normalized for t in added)
        #: What every special token's string begins with; the empty string if that says nothing.
        self.special = os.path.commonprefix(contents) if contents else None
        self.kind = self._kind()
        #: The model's own call for one piece, and what stands for the space before it.
        self.piece, self.space = self.tokenizer.model.tokenize, "Ġ" if self.kind == "bytes" else ""
        self.split = self._split if self.kind else None
        # By id: whether a piece ends (begins) with this token.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if self.kind == "bytes" else t.endswith("</w>"))]] = True
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _kind(self) -> str | None:
        """Which chunking leaves the ids unchanged; None: whole texts go to the library."""
        probe = self.tokenizer.encode("a  b", add_special_tokens=False).tokens
        if probe == ["a</w>", "b</w>"]:
            return "loose"
        if "".join(probe) == "aĠĠb":
            return "bytes"
        return None

    def _split(self, texts: list[str]) -> pa.ListArray:
        """Chunks without the space before them; of the byte-level BPE, those without one begin with a null character instead."""
        if self.kind == "loose":
            array = pa.array(texts, pa.string())
            for white in "\n\r\t":
                array = pc.replace_substring(array, white, " ")
            return pc.split_pattern(array, " ")
        if all("  " not in t and t[:1] != " " and t[-1:] != " " for t in texts):
            return pc.split_pattern(pa.array(["\0" + t for t in texts], pa.string()), " ")
        return pa.array([[c[1:] if c[0] == " " else "\0" + c for c in _CHUNK_BYTES.findall(t)] for t in texts], pa.list_(pa.string()))

    def _texts(self, chunks: list[str]) -> list[str]:
        """The pieces of text that chunks stand for."""
        return [c[1:] if c[:1] == "\0" else " " + c for c in chunks] if self.kind == "bytes" else chunks

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str]) -> list[bytes] | None:
        """Ids of chunks of one piece each, encoded as one text, which costs less; None if the pieces cannot be told apart."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(["", *chunks] if self.kind == "bytes" else chunks)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(chunks):
            return None
        starts = at if self.kind == "bytes" else np.concatenate([[0], at[:-1] + 1])
        raw, starts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        return [raw[x:y] for x, y in zip(starts, starts[1:])]

    def _word(self, word: str) -> bytes:
        """Ids of a word of ASCII letters: one piece, which no normalization but the case changes."""
        ids = [t.id for t in self.piece(word.lower() if self.kind == "loose" else word[1:] if word[0] == "\0" else self.space + word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unknown(self, chunks: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        accented, rest = [], []
        for c in chunks:
            if len(c) > CACHE_CHUNK_CHARS:
                rest.append(c)
            elif c.isascii() and (c.isalpha() or c[:1] == "\0" and c[1:].isalpha()):
                out[c] = self._word(c)
            else:
                (accented if c.isalpha() else rest).append(c)
        for at in range(0, len(accented), 1000):
            part = accented[at : at + 1000]
            out.update(zip(part, self._joined(part) or self._library(self._texts(part))))
        out.update(zip(rest, self._library(self._texts(rest))))
        return out

    def _parts(self, chunk: str) -> list[str]:
        """Chunks whose ids in a row are those of ``chunk``: a word and the marks behind it are looked up apart, lines too."""
        bare = "\0" if self.kind == "bytes" else ""
        if "\n" in chunk:
            lines = chunk.split("\n")
            # Only single line ends between words; then each is a piece of its own.
            if chunk.split() != lines or lines[0] == bare:
                return [chunk]
            parts = self._parts(lines[0])
            for line in lines[1:]:
                parts += [bare + "\n", *self._parts(bare + line)]
            return parts
        stem = chunk.rstrip(MARKS)
        return [stem, bare + chunk[len(stem) :]] if len(stem) < len(chunk) and stem[-1:].lower().isalpha() else [chunk]

    def _missing(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks that the younger cache lacks."""
        cache, older = self.cache, self.older
        new = {c: older[c] for c in chunks if c in older} if older else {}
        left = [c for c in chunks if c not in new] if new else chunks
        split = {c: parts for c, parts in zip(left, map(self._parts, left)) if len(parts) > 1}
        pieces = {part for parts in split.values() for part in parts}
        known = {c: ids for c in pieces if (ids := cache.get(c) or older.get(c)) is not None}
        known |= self._unknown([*(pieces - known.keys()), *[c for c in left if c not in split and c not in pieces]])
        new |= known
        for c, parts in split.items():
            new[c] = b"".join([known[part] for part in parts])
        if len(cache) > CACHE_CHUNKS:
            self.older, self.cache = cache, {}
        self.cache.update([(c, ids) for c, ids in new.items() if len(c) <= CACHE_CHUNK_CHARS])
        return [new[c] for c in chunks]

    def _encode(self, texts: list[str]) -> list[bytes]:
        lists = self.split(texts)
        numbered = lists.values.dictionary_encode()
        which, ends = numbered.indices.to_numpy(), lists.offsets.to_numpy().tolist()
        chunks = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, chunks))
        unknown = [at for at, ids in enumerate(found) if ids is None]
        if unknown:
            for at, ids in zip(unknown, self._missing([chunks[at] for at in unknown])):
                found[at] = ids
        return [b"".join(map(found.__getitem__, which[x:y].tolist())) for x, y in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.split is None:
            return self._library(texts)
        out: list[bytes] = [b""] * len(texts)
        waiting: list[int] = []
        held = 0

        def settle() -> None:
            for at, ids in zip(waiting, self._encode([texts[at] for at in waiting])):
                out[at] = ids
            waiting.clear()

        for at, text in enumerate(texts):
            # A null character has a meaning of its own in chunks.
            if "\0" in text or self.special is not None and self.special in (text.lower() if self.folded else text):
                out[at] = self._library([text])[0]
                continue
            waiting.append(at)
            held += len(text)
            if held > BATCH_CHARS:
                settle()
                held = 0
        if waiting:
            settle()
        return out


def encoder(name: str) -> ChunkEncoder:
    """One encoder per process and file: worker reuse keeps its cache warm across tasks."""
    workers.enter("tokens", _ENCODERS.clear)
    if name not in _ENCODERS:
        _ENCODERS[name] = ChunkEncoder(name)
    return _ENCODERS[name]
