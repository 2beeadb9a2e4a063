"""BPE encoding by prefix-sharing trie traversal, and decoding.

The ids of a string end with one token, and what is before it is the encoding
of a shorter prefix. So the state of a trie node is the last token of the
prefix that it stands for: the longest vocabulary entry that ends there and may
follow the last token of the prefix before it. Two tokens may stand side by
side if no merge of the table joins them across their border before it would
have formed them; that is found by walking the right edge of the one and the
left edge of the other in the order of merges.

Distinct words of a chunk are sorted, which is the depth-first order of their
trie: the stack of states of the common prefix with the word before is kept, so
each shared prefix is computed once. Words are those of the byte-level split.

Defined cases: null text encodes as empty; special strings become their ids;
texts of any length are taken whole; repeated rows give repeated rows; an empty
table gives none; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH, batches_of, small_batches, strings
from .pieces import PieceEncoder, byte_letters, encoder

class TrieBPE(PieceEncoder):
    """Encodes by the trie, decodes by the vocabulary."""

    #: Less than where the library encodes: the trie's tables take memory too.
    CHUNK, MEMO, KEPT = 1 << 20, 200_000, 150_000

    def __init__(self, path: str):
        super().__init__(path)
        if not self.by_piece:
            raise ValueError("the trie needs a byte-level BPE without normaliser")
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        self.tokenizer = None
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(back[c] for c in s)
        vocab = told["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        self.bytes_of = {i: raw(s) for s, i in vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> rank, left, right
        for r, (a, b) in enumerate(merges):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), r)
            self.parts.setdefault(both, (r, left, right))
        self.ok: dict[tuple[int, int], bool] = {}
        atoms = {b for b in self.bytes_of.values() if len(b) == 1}
        # an entry that its own merges never form is no state
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in self.special.values() and (b in atoms or self.forms(i))}
        self.ends = ahocorasick.Automaton()  # all entries that end at a place, longest first
        for b, i in self.id_of.items():
            self.ends.add_word(b.decode("latin-1"), (len(b), i))
        self.ends.make_automaton()

    def forms(self, token: int) -> bool:
        if token not in self.parts:
            return False
        r, a, b = self.parts[token]
        return self.apart(a, b, r)

    def apart(self, u: int, v: int, before: int | None = None) -> bool:
        """Whether u and v, side by side, stay as they are up to merge number ``before`` (None: all)."""
        end = len(self.rank) if before is None else before
        while True:
            r = self.rank.get((u, v))
            if r is not None and r < end:
                return False
            ru, rv = self.parts.get(u, (-1,))[0], self.parts.get(v, (-1,))[0]
            if ru < 0 and rv < 0:
                return True
            if ru > rv:  # before the merge that formed u, its right part stood at the border; ties of time go left first
                end, u = ru, self.parts[u][2]
            else:
                end, v = rv + 1, self.parts[v][1]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """ids of distinct words, depth first through their trie."""
        raw = [w.encode("utf-8", "surrogatepass").decode("latin-1") for w in words]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        out: list[bytes] = [b""] * len(raw)
        last, size, before = [0], [0], ""  # of each depth: the last token's id and its length
        ok, find = self.ok, self.ends.iter
        if len(ok) > 600_000:
            ok.clear()
        for k in order:
            w = raw[k]
            depth, most = 0, min(len(w), len(before))
            while depth < most and w[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], size[depth + 1 :]
            d = depth  # states known so far
            for end, (n, t) in find(w):
                if end < d:
                    continue
                if end > d:
                    raise ValueError(f"the vocabulary lacks a byte of {w!r}")
                a = end + 1 - n
                if a:
                    pair = (last[a], t)
                    may = ok.get(pair)
                    if may is None:
                        may = ok[pair] = self.apart(*pair)
                    if not may:
                        continue
                last.append(t)
                size.append(n)
                d += 1
            if d < len(w):
                raise ValueError(f"the vocabulary lacks a byte of {w!r}")
            before = w
            ids, at = [], len(w)
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[k] = array("I", ids).tobytes()
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs(doc_id, text), and on demand ids and decoded."""
    small_batches(docs.sparkSession)
    extra = ["ids"] * with_ids + ["decoded"] * with_text
    rows = docs.select(F.col("doc_id"), F.col("text").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer, TrieBPE)
        for b in batches_of(it, BATCH):
            n, a, z, ids, decoded = [], [], [], [], []
            for got in bpe.encode_many(strings(b.column("_text"))):
                text = bpe.decode(got)
                n.append(len(got) // 4)
                a.append(hashlib.sha256(got).hexdigest())
                z.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    ids.append(got)
                if with_text:
                    decoded.append(text)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())]
            more = ([pa.array(ids, pa.binary())] if with_ids else []) + ([pa.array(decoded, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays([*cols, *more], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *extra])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded string" * with_text)
