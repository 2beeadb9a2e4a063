"""Encoding with a tokenizers file, with a memo of white-space pieces.

A byte-level BPE without normaliser treats each ` ?\\S+` run alone, so the ids of
a text are those of its pieces in turn. Each distinct piece goes through the
tokenizers library once while it stays in the memo; other tokenizers take whole
texts. Special strings in a text become their special ids, as in the library.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import chunks

#: Unicode's White_Space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Fixed value: how byte-level BPE splits text into words.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Before a piece that stands for itself. Where single blanks and single line ends are all white space of a text, a split
#: at blanks gives its other pieces: ``w`` stands for a blank and w, ``\\nw`` for a line end and w.
PLAIN = chr(0)
#: Marks that end a piece and are a word of their own after letters.
MARKS = frozenset(",.;:!?")
#: Keys that are new and learned together, words that go through the model together, and the longest key that the memo keeps.
KEYS_AT_ONCE, WORDS_AT_ONCE, LONGEST = 1 << 14, 512, 48


def byte_letters() -> dict[int, str]:
    """The printable letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def single_blanks(text: str) -> bool:
    """Whether all white space is blanks and line ends, single, between other printable characters."""
    one = text.replace("\n", " ")
    return bool(one) and one[0] != " " and one[-1] != " " and "  " not in one and one.isprintable()


_loaded: dict[tuple[str, type], object] = {}


def file_digest(path: str) -> str:
    """Names the tokenizer's version."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def release() -> None:
    """Hand free memory back to the system: a worker that waits for its next task would keep it from the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


class PieceEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    #: Characters of texts that are split together; keys beyond which the memo is cut to the most frequent, and how many
    #: these are.
    CHUNK, MEMO, KEPT = 1 << 22, 500_000, 400_000

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        pre = told.get("pre_tokenizer") or {}
        self.by_piece = told["model"].get("type") == "BPE" and not told.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told["model"].get("dropout")
        plain = lambda a: not (a.get("normalized") or a.get("lstrip") or a.get("rstrip") or a.get("single_word"))
        self.special = {a["content"]: a["id"] for a in told.get("added_tokens", [])}
        self.by_piece = self.by_piece and all(map(plain, told.get("added_tokens", [])))
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # The memo: keys, how many ids each has, all these ids in turn, and how often each key was met.
        self.known = pa.array([], pa.large_string())
        self.sizes, self.flat, self.hits = np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.by_piece:
            model = self.tokenizer.model
            if hasattr(model, "_resize_cache"):
                model._resize_cache(0)  # the memo is the cache
            self.model = Tokenizer(model)
            self.model.pre_tokenizer = WhitespaceSplit()
            vocab = told["model"]["vocab"]
            self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)  # letters of each entry
            self.lengths[list(vocab.values())] = [len(w) for w in vocab]
            self.letters = np.array([ord(c) for _, c in sorted(byte_letters().items())], "<u4")

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; a special string is one."""
        if self.split is not None and any(s in text for s in self.special):
            return [p for i, part in enumerate(self.split.split(text)) if part for p in ([part] if i % 2 else PIECE.findall(part))]
        return PIECE.findall(text)

    def words_of(self, key: str) -> list[str]:
        """The words of what a key stands for, told apart as the file's own pre-tokenizer does; a special string is one."""
        if key[-1:] in MARKS and key[:-1].isalpha():
            return [" " + key[:-1], key[-1]]
        piece = key[1:] if key[:1] in (PLAIN, "\n") else " " + key
        words = [piece] if piece.isalpha() or piece in self.special else SPLIT.findall(piece)
        return ["\n", *words] if key[:1] == "\n" else words

    def learn(self, keys: list[str]) -> list[bytes]:
        """The ids of distinct keys, whose distinct words go through the model together."""
        split = {k: self.words_of(k) for k in keys if not k.isalpha()}
        words = {" " + k for k in keys if k not in split}
        words.update(chain.from_iterable(split.values()))
        ids = {w: np.array([self.special[w]], "<u4").tobytes() for w in words.intersection(self.special)}
        plain = [w for w in words if w not in ids] if ids else list(words)
        ids.update(zip(plain, self.encode_words(plain), strict=True))
        of = {k: b"".join([ids[w] for w in ws]) for k, ws in split.items()}
        return [of[k] if k in of else ids[" " + k] for k in keys]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words by the library: many words, in the vocabulary's letters and parted by blanks, go
        through its model as one text that is split at the blanks."""
        out = []
        for a in range(0, len(words), WORDS_AT_ONCE):
            some = pa.array(words[a : a + WORDS_AT_ONCE], pa.large_binary())
            upto = np.frombuffer(some.buffers()[1], np.int64, len(some) + 1)
            mapped = np.full(upto[-1] + len(some), 0x20, "<u4")
            mapped[np.arange(upto[-1]) + np.repeat(np.arange(len(some)), np.diff(upto))] = self.letters[np.frombuffer(some.buffers()[2], np.uint8, upto[-1])]
            ids = np.array(self.model.encode_batch_fast([mapped.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4")
            done, ends = np.cumsum(self.lengths[ids]), upto[1:]
            if not len(ids) or done[-1] != ends[-1]:
                raise ValueError("the vocabulary lacks a byte")
            raw, cuts = ids.tobytes(), [0, *(4 * np.searchsorted(done, ends) + 4).tolist()]
            out += [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        return out

    def split_keys(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each key of texts in turn its place in the memo, which learns the new ones, and where each text's keys end."""
        odd = [i for i, t in enumerate(texts) if not single_blanks(t) or (self.split is not None and any(s in t for s in self.special))]
        at_odd = set(odd)
        plain = pa.array([PLAIN + t.replace("\n", " \n") for i, t in enumerate(texts) if i not in at_odd], pa.large_string())
        parts = pc.split_pattern(plain, " ")
        ends = np.asarray(parts.offsets)[1:].astype(np.int64) - int(parts.offsets[0].as_py())
        own = [[PLAIN + p for p in self.pieces(texts[i])] for i in odd]
        codes = self.places([parts.flatten(), pa.array(chain.from_iterable(own), pa.large_string())])
        if not odd:
            return codes, ends
        sizes, from_odd = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        from_odd[odd] = True
        sizes[~from_odd], sizes[odd] = np.diff(ends, prepend=0), [len(x) for x in own]
        kept, of = np.empty_like(codes), np.repeat(from_odd, sizes)
        n = int(ends[-1]) if len(ends) else 0
        kept[~of], kept[of] = codes[:n], codes[n:]
        return kept, np.cumsum(sizes)

    def places(self, keys: list[pa.Array]) -> np.ndarray:
        """The place of each key in the memo; the memo's keys come first in one dictionary with them, so that only those
        behind them are new."""
        n = len(self.known)
        found = pa.concat_arrays([self.known, *keys]).dictionary_encode()
        codes, self.known = found.indices.to_numpy(zero_copy_only=False)[n:], found.dictionary
        sizes, flat = [self.sizes], [self.flat]
        for a in range(n, len(self.known), KEYS_AT_ONCE):
            ids = self.learn(self.known.slice(a, KEYS_AT_ONCE).to_numpy(zero_copy_only=False).tolist())
            sizes.append(np.fromiter(map(len, ids), np.int32, len(ids)) >> 2)
            flat.append(np.frombuffer(b"".join(ids), "<u4"))
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)
        met = np.bincount(codes, minlength=len(self.known))
        met[:n] += self.hits
        self.hits = met
        return codes

    def forget(self, before: int) -> None:
        """Drop the long keys among those that are new since the memo had ``before``, and of a full memo the rarer and older."""
        keep = np.ones(len(self.known), bool)
        keep[before:] = pc.utf8_length(self.known.slice(before)).to_numpy(zero_copy_only=False) <= LONGEST
        if np.count_nonzero(keep) > self.MEMO:
            worth = np.where(keep, self.hits << 32 | np.arange(len(keep)), -1)
            keep = worth >= np.partition(worth, -self.KEPT)[-self.KEPT]
            self.hits = self.hits >> 1
        if not keep.all():
            self.known, self.flat = self.known.filter(pa.array(keep)), self.flat[np.repeat(keep, self.sizes)]
            self.sizes, self.hits = self.sizes[keep], self.hits[keep]

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text in turn; memory holds the pieces of a chunk of texts and the memo.

        Arrow splits a chunk and finds its pieces among the memo's, new ones are encoded, and numpy puts the ids in the
        places of the pieces."""
        gc.disable()  # dictionaries of strings hold no cycles, and each pass over them would cost as much as the encoding
        for _, some in chunks(texts, self.CHUNK):
            if not self.by_piece:
                for e in self.tokenizer.encode_batch(some, add_special_tokens=False):
                    yield np.array(e.ids, "<u4").tobytes()
                continue
            before = len(self.known)
            codes, ends = self.split_keys(some)
            of = self.sizes[codes]
            upto = np.concatenate(([0], np.cumsum(of, dtype=np.int64)))
            kind = np.int32 if max(len(self.flat), upto[-1]) < 1 << 31 else np.int64
            at = np.repeat(((np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[codes] - upto[:-1]).astype(kind), of)
            at += np.arange(len(at), dtype=kind)
            whole, cuts = self.flat[at], upto[np.concatenate(([0], ends))].tolist()
            self.forget(before)
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield whole[a:b].tobytes()
            del codes, ends, of, upto, at, whole
        release()


def encoder(path: str, kind: type = PieceEncoder):
    """One for each worker process and file."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = kind(path)
    return _loaded[path, kind]


def encode_texts(path: str, texts: Iterable[str]) -> Iterator[bytes]:
    return encoder(path).encode_many(list(texts))
