"""Exact tokenisation at corpus speed.

The library encodes each distinct chunk once per task; texts are then sums or concatenations of chunk
results. A chunk starts at white space that follows a non-space, and no pre-token of these tokenizers
reaches over such a place, so the ids are those of the whole text.
"""

from __future__ import annotations

import gc
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, table

#: White space that the tokenizers' patterns and Python agree on.
_A = r" \t\n\r\x0b\x0c"
_CHUNK = re.compile(f"[{_A}]*[^{_A}]+|[{_A}]+")
_SAFE = re.compile(r"(?<=\S) ")
#: Python counts these as white space, the tokenizers don't.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Parameters: slices of long texts, bytes of texts handled together, chunks remembered, longest remembered chunk.
SLICE_CHARS, BATCH_BYTES, CACHE_CHUNKS, CHUNK_CHARS = 1 << 16, 1 << 20, 500_000, 64
_MARKS = ".,;:!?"
#: A mark between a letter and white space is a pre-token of its own.
_MARK = re.compile(r"(?<=[A-Za-z])[.,](?=[ \n])")
#: Precomposed letters that every normaliser here leaves alone but for their case.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies' letters: printable bytes stand for themselves, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


_BYTES = _byte_letters()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(text: str, size: int = SLICE_CHARS) -> list[str]:
    """text cut before single spaces that follow a non-space, about every size characters. Text without
    such a space stays whole."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def n_bytes(text: str) -> int:
    """Length in UTF-8."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def balanced(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of consecutive items that hold about limit (bytes, or what sizes are in) each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class ChunkEncoder:
    """Per chunk, measure(ids) of the library; add up with zero as the start. One per Python worker and file."""

    def __init__(self, path: str, keep_space: bool, measure: Callable, join: Callable):
        from tokenizers import Tokenizer

        self.tok, self.keep_space, self.measure, self.join = Tokenizer.from_file(path), keep_space, measure, join
        self.seen: dict[str, object] = {}

    def whole(self, text: str):
        return self.join(self.measure(e.ids) for e in (self.tok.encode(s, add_special_tokens=False) for s in slices(text)))

    def chunks(self, text: str) -> list[str] | None:
        """None: only the library itself can tell where this text may be cut."""
        if self.keep_space:
            return _CHUNK.findall(text)
        if any(c in text for c in _ODD):
            return None
        if text.isascii() and "<|" not in text:
            text = text.lower()
        return _MARK.sub(r" \g<0>", text).split()

    def _core(self, chunk: str) -> str:
        """chunk without the marks at its end, where these start a pre-token of their own."""
        core = chunk.rstrip(_MARKS)
        end = core[-1:]
        if not end.isascii():  # normalised or folded, a letter can end in a combining mark
            end = unicodedata.normalize("NFC", end.lower())[-1:]
        if len(core) == len(chunk) or not end.isalnum():
            core = chunk
        # The tokenizer that drops white space also folds case.
        return core.lower() if not self.keep_space and _LATIN.fullmatch(core) else core

    def learn(self, chunks: set[str]) -> None:
        """Results for chunks. A full memory keeps what these chunks use, so frequent words stay."""
        seen = self.seen
        if len(seen) + len(chunks) > CACHE_CHUNKS:
            self.seen = seen = {c: seen[c] for c in chunks if c in seen}
        tokenize, measure, new = self.tok.model.tokenize, self.measure, []
        for c in chunks:
            if c in seen:
                continue
            # A run of letters is one pre-token, so the library's model takes it as it is.
            if self.keep_space:
                word = c[1:] if c[0] == " " else c
                if word.isalpha() and word.isascii():
                    seen[c] = measure([t.id for t in tokenize(c if len(word) == len(c) else "\u0120" + word)])
                    continue
            elif c.isalpha() and c.isascii() and c.islower():
                seen[c] = measure([t.id for t in tokenize(c)])
                continue
            new.append(c)
        cores = {c: x for c in new if (x := self._core(c)) != c}
        need = [c for c in new if c not in cores]
        need += {x for x in cores.values() if x not in seen} - set(need)
        tails = {c[len(x) :] for c, x in cores.items()}
        need += [t for t in tails if t and t not in seen and t not in chunks]
        rest = []
        for c in need:
            word = c[1:] if self.keep_space and c[0] == " " else c
            if _LATIN.fullmatch(word):
                seen[c] = self.measure([t.id for t in tokenize(c.encode().decode("latin-1").translate(_BYTES))])
            else:
                rest.append(c)
        for a, b in balanced([n_bytes(c) for c in rest]):
            part = rest[a:b]
            for c, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                # A chunk that ends in unusual white space can merge with the next one.
                seen[c] = None if self._odd(c) else self.measure(e.ids)
        for c, x in cores.items():
            seen[c] = seen[x] + seen[c[len(x) :]] if len(x) < len(c) else seen[x]

    def batch(self, texts: list[str]) -> list:
        """Results of texts, in order. The many small results hold no cycles, so collection rests meanwhile."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._batch(texts)
        finally:
            if on:
                gc.enable()

    def _batch(self, texts: list[str]) -> list:
        out: list = [None] * len(texts)
        for a, b in balanced([n_bytes(t) for t in texts]):
            parts = [self.chunks(t) for t in texts[a:b]]
            known: set[str] = set()
            for p in parts:
                known.update(p or ())
            long = {c for c in known if len(c) > CHUNK_CHARS}
            self.learn(known - long if long else known)
            get = self.seen.__getitem__
            for i, p in enumerate(parts):
                try:
                    if p is None:
                        raise TypeError
                    if long and not long.isdisjoint(p):
                        out[a + i] = self.join(self.whole(c) if c in long and not self._odd(c) else get(c) for c in p)
                    else:
                        out[a + i] = self.join(map(get, p))
                except (TypeError, KeyError):
                    out[a + i] = self.whole(texts[a + i])
        return out

    def _odd(self, c: str) -> bool:
        return self.keep_space and len(c.rstrip()) < len(c.rstrip(" \t\n\r\x0b\x0c"))


_encoders: dict[tuple, ChunkEncoder] = {}


def _ids_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str, keep_space: bool, ids: bool) -> ChunkEncoder:
    """The worker's own encoder; loaded once however many batches come."""
    claim("tokens", _encoders.clear)
    key = (path, keep_space, ids)
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = ChunkEncoder(path, keep_space, _ids_bytes if ids else len, b"".join if ids else sum)
    return _encoders[key]


def count_tokens(text: Column, path: str) -> Column:
    """Tokens of a whole text (null: 0) as the library counts them without added tokens; special strings in
    a text count as the library's default has it. Only lengths leave the Arrow function. Empty: 0."""

    @F.pandas_udf("bigint")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, True, False)
        for s in batches:
            yield pd.Series(enc.batch(s.fillna("").tolist()), dtype="int64", index=s.index)

    return lengths(text)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per document (repeated rows and null ids each keep a row): doc_id, n_bytes, n_tokens, over_limit
    (n_tokens > limit). Null text counts as empty; texts of any length are counted whole; an empty table gives no rows;
    other columns aren't read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), count_tokens(text, path).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. Edge cases are those of token_counts()."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def encoded(docs: DataFrame, path: str, end_id: int) -> Callable:
    """Arrow function: batches of (doc_id, text) to batches of (doc_id, ids) with end_id after each document."""
    end = _ids_bytes([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
        enc = encoder(path, False, True)
        for b in batches:
            yield b.column("doc_id"), [x + end for x in enc.batch([t or "" for t in b.column("text").to_pylist()])]

    return run
