"""Exact token counts under a byte-level BPE vocabulary, with a whole-token shortcut.

``prove`` finds, once and offline, the vocabulary strings that the library's own
model encodes alone as one token. A text is cut into pre-tokens; a pre-token in
that set counts one, and only the rest is merged (by the library's model, with
a bounded memo). A text with a code point on which the regular-expression
engines disagree, or a special string, goes to the library as a whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; a very long text
is counted whole, its pre-tokens listed at once (some 60 bytes each); repeated
rows and null keys count like any others; an empty table gives no rows; other
input columns, whatever their names, are not carried along.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: The published pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 512
#: Merged pre-tokens that a worker remembers.
MEMO = 200_000
#: A pre-token of more characters is merged but never remembered.
MEMO_CHARS = 64


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def prove(spec: str) -> set[str]:
    """The texts among the vocabulary strings that the model encodes alone as one token."""
    tok = Tokenizer.from_str(spec)
    back = {c: b for b, c in enumerate(byte_letters())}
    split, out = regex.compile(PATTERN), set()
    for piece in json.loads(spec)["model"]["vocab"]:
        try:
            s = bytes(back[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if split.findall(s) == [s] and len(tok.model.tokenize(piece)) == 1:
            out.add(s)
    return out


#: Code points from here on are not compared; they count as unsafe.
COMPARED = 0x32000
UNSAFE_GRAIN = 16


def unsafe_characters(spec: str, grain: int = UNSAFE_GRAIN) -> list[int]:
    """Starts of the runs of ``grain`` code points below COMPARED in which the library's
    pre-tokenizer and ``regex`` class any code point differently.
    """
    tok, split = Tokenizer.from_str(spec), regex.compile(PATTERN)

    def agree(a: int, b: int) -> bool:
        s = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}\n" for c in range(a, b) if not 0xD800 <= c < 0xE000)
        return [o for _, o in tok.pre_tokenizer.pre_tokenize_str(s)] == [m.span() for m in split.finditer(s)]

    def search(a: int, b: int) -> list[int]:
        if agree(a, b):
            return []
        if b - a <= grain:
            return [a]
        step = (b - a) // 8
        return [x for at in range(a, b, step) for x in search(at, at + step)]

    return [x for at in range(0, COMPARED, 1024) for x in search(at, at + 1024)]


class Counter(dict):
    """Pre-token -> number of tokens; proven strings are filled in, others are merged on demand."""

    def __init__(self, spec: str, proven: set[str], unsafe: list[int]):
        super().__init__(dict.fromkeys(proven, 1))
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.room = len(self) + MEMO
        self.letters = byte_letters()
        self.split = regex.compile(PATTERN).findall
        special = "|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())
        self.special = re.compile(special).search if special else lambda _: None
        self.unsafe = {chr(c) for a in unsafe for c in range(a, a + UNSAFE_GRAIN)}
        self.high = re.compile(f"[{chr(min([COMPARED, *unsafe]))}-{chr(0x10FFFF)}]").search

    def __missing__(self, piece: str) -> int:
        n = len(self.tok.model.tokenize("".join(map(self.letters.__getitem__, piece.encode("utf-8", "replace")))))
        if len(piece) <= MEMO_CHARS and len(self) < self.room:
            self[piece] = n
        return n

    def count(self, s: str) -> int:
        if self.special(s) or self.high(s) and not (self.unsafe.isdisjoint(s) and max(s) < chr(COMPARED)):
            return len(self.tok.encode(s, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.split(s)))


_counters: dict[str, Counter] = {}


def _run(shared, key: str, limit: int):
    def run(batches):
        spec, proven, unsafe = shared.value
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(spec, proven, unsafe)
        counter = _counters[key]
        for batch in batches:
            texts = batch.column("text")
            n = np.fromiter((counter.count(t.as_py() or "") for t in texts), np.int64, len(texts))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": n, "over_limit": n > limit})

    return run


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; a map without a shuffle.

    The vocabulary file is read once by the driver; its text and the proven
    strings (both of a fixed size) are broadcast.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, prove(spec), unsafe_characters(spec)))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    # a worker that is used again knows its counter by what the vocabulary holds
    digest = hashlib.sha256(spec.encode()).hexdigest()
    return rows.mapInArrow(_run(shared, digest, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
