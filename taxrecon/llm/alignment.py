"""Alignment of two tokenizers over a corpus.

Documents are shuffled by their full text, so each distinct text is tokenised and aligned once. A task works through
blocks of texts: words between single spaces are aligned once while they are remembered, as neither tokenizer has a
token over such a place. What leaves it are a text's links as numbers of the block's id pairs, and the block's pairs
with the documents that hold them. Pairs are summed over all blocks; a block's pairs meet their sums, and the block's
texts these. Measures then join the documents by the text's digest.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import claim, importable, table, written
from .tokens import _BYTES, balanced, tokenizer_path

#: Parameters: characters of texts aligned together, characters of words from which on they are forgotten before the
#: next texts, and the share of all documents from which on a text is sent to every task (fewer than 1 / share texts).
BLOCK_CHARS, CACHE_CHARS, HOT = 1 << 21, 10_000_000, 0.001
#: A space after a non-space, before something: every token of either side ends there.
_CUT = re.compile(r"(?<=\S) (?=.)", re.DOTALL)
_ODD = re.compile(r"\s |\s\Z")
#: Letters that both vocabularies take as they are, and marks; a word of these is taken apart into runs of letters, runs
#: of marks and line ends.
_LETTERS, _MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]", "[.,;:!?*$%&#|]"
_PLAIN = re.compile(f"{_LETTERS}+{_MARKS}*(?:\n{_LETTERS}+{_MARKS}*)*")
_RUNS = re.compile(f"{_LETTERS}+|{_MARKS}+|\n")
_ACROSS = re.compile(f"{_LETTERS}{_MARKS}|{_MARKS}{_LETTERS}|\n.|.\n")
_MEASURES = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNED = pa.schema([("block", pa.int64()), ("digest", pa.binary()), ("docs", pa.int64()), *((c, pa.int64()) for c in _MEASURES), ("groups_sha256", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pair", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))])
_ALIGNED_DDL = "block bigint, digest binary, docs bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, at array<int>, times array<int>, pair array<bigint>, held array<bigint>"
_JOINED_DDL = "digest binary, docs bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"


def a_bytes(tokenizer) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    back = {c: b for b, c in _BYTES.items()}
    return [bytes(back[c] for c in t) if (t := tokenizer.id_to_token(i)) and all(c in back for c in t) else (t or "").encode() for i in range(tokenizer.get_vocab_size())]


def b_bytes(processor) -> list[bytes]:
    """Bytes of each piece: U+2581 is a space, <0xHH> the byte HH."""
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(processor.id_to_piece, range(processor.get_piece_size()))]


class Aligner:
    """Aligned words, by number: measures, links as id pairs (a * size of B's vocabulary + b), and groups as text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.base = self.b.get_piece_size()
        self.bytes = a_bytes(self.a), b_bytes(self.b)
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in self.bytes]
        self.names = [[np.array([f"{i}{end}" for i in range(len(t))], object) for end in ends] for t, ends in zip(self.bytes, (",|", ",;"), strict=True)]
        pieces = [x.decode("utf-8", "replace") for x in self.bytes[1]]
        #: Where a piece has a space after something else, words can't be told apart by spaces; nor runs in a word where a
        #: piece reaches from one into the next.
        self.apart = not any(" " in x.lstrip(" ") for x in pieces)
        self.line = self.b.encode("\n")
        self.runs = not any(_ACROSS.search(x) for x in pieces) and self.b.encode("\n\n") == [*self.line, self.line[-1]]
        self.clear()

    def clear(self) -> None:
        #: Words by number, and as tuples the runs that don't start a word.
        self.number: dict[str | tuple[str], int] = {}
        self.groups, self.chars = [], 0
        #: Per word n_a, n_b, n_groups, n_links, and whether the bytes are the text's.
        self.facts, self.codes, self.start = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        if not self.apart:
            return [text]
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Aligns words, a few at a time. Those of several runs are put together from these."""
        simple, several, firsts, inner = [], {}, set(), set()
        for w in new:
            if self.runs and not w.isalpha() and _PLAIN.fullmatch(w):
                first, *rest = _RUNS.findall(w)
                rest = [(r,) for r in rest]
                several[w] = [first, *rest]
                firsts.add(first), inner.update(rest)
            else:
                simple.append(w)
        simple += firsts.difference(self.number, simple)
        for keys in (simple, list(inner.difference(self.number))):
            for i, j in balanced([len(w) + 1 for w in keys], 1 << 20):
                self._add(keys[i:j], *self._aligned(keys[i:j]))
        if several:
            flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(several.values())), np.int64)
            edge = np.cumsum([0, *map(len, several.values())])
            facts = np.add.reduceat(self.facts[flat], edge[:-1])
            facts[:, 4] = np.minimum.reduceat(self.facts[flat, 4], edge[:-1])
            listed, at = list(map(self.groups.__getitem__, flat.tolist())), edge.tolist()
            self._add(list(several), facts, self._links(flat), ["".join(listed[s:e]) for s, e in zip(at, at[1:], strict=False)])

    def _add(self, words: list[str], facts: np.ndarray, codes: np.ndarray, groups: list[str]) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.chars += sum(map(len, words)) + 8 * len(words)
        self.groups += groups
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(facts[:, 3])))
        self.facts, self.codes = np.concatenate((self.facts, facts)), np.concatenate((self.codes, codes))

    def _links(self, words: np.ndarray) -> np.ndarray:
        """The links of numbered words, one after the other."""
        n = self.facts[words, 3]
        return self.codes[np.repeat(self.start[words] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def _a_ids(self, words: list[str], lead: str) -> list[list[int]]:
        """A's ids; a run of letters or marks is a pre-token, so the library's model takes it as it is."""
        alone, tokenize = re.compile(f"{_LETTERS}+" if lead else f"{_LETTERS}+|{_MARKS}+|\n").fullmatch, self.a.model.tokenize
        out, rest, mark = [], [], "\u0120" if lead else ""
        for w in words:
            if not alone(w):
                rest.append(len(out))
                out.append([])
            elif w.isascii() and w != "\n":
                out.append([t.id for t in tokenize(mark + w)])
            else:
                out.append([t.id for t in tokenize(mark + w.encode().decode("latin-1").translate(_BYTES))])
        for i, e in zip(rest, self.a.encode_batch_fast([lead + words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _aligned(self, words: list) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Facts, links and groups of words, or of runs (tuples): B reads these after a line end, which it takes as a token
        of its own."""
        inner = isinstance(words[0], tuple)
        if inner:
            words = [w for (w,) in words]
            ids = self._a_ids(words, ""), [x[len(self.line) :] for x in self.b.encode(["\n" + w for w in words], num_threads=1)]
            own = [w.encode() for w in words]
        else:
            ids = self._a_ids(words, " "), self.b.encode(words, num_threads=1)
            own = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
        whole = b"".join(own)
        good = np.ones(len(words), bool)
        for of, known in zip(ids, self.bytes, strict=True):
            if b"".join(map(known.__getitem__, chain.from_iterable(of))) != whole:
                good &= np.fromiter((b"".join(map(known.__getitem__, x)) == w for x, w in zip(of, own, strict=True)), bool, len(words))
        if not good.all():
            ids = tuple([x if g else [] for x, g in zip(of, good.tolist(), strict=True)] for of in ids)
        counts = [np.fromiter(map(len, of), np.int64, len(words)) for of in ids]
        flat = [np.fromiter(chain.from_iterable(of), np.int64, int(n.sum())) for of, n in zip(ids, counts, strict=True)]
        a, b = flat
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, flat, strict=True)]
        shut = [y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool) for x, y in (ends, ends[::-1])]
        group = [np.cumsum(s) - s for s in shut]
        first = np.searchsorted(ends[1], ends[0] - self.sizes[0][a], "right")
        links = np.searchsorted(ends[1], ends[0], "left") - first + 1
        step = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
        codes = np.repeat(a, links) * self.base + b[np.repeat(first, links) + step]
        # The groups' text: a group's A ids, then its B ids, each with the mark that follows it.
        n_groups = int(shut[0].sum())
        per = [np.concatenate(([0], np.cumsum(np.bincount(g, minlength=n_groups)))) for g in group]
        marks = np.empty(len(a) + len(b), object)
        marks[np.arange(len(a)) + per[1][group[0]]] = np.where(shut[0], self.names[0][1][a], self.names[0][0][a])
        marks[np.arange(len(b)) + per[0][group[1] + 1]] = np.where(shut[1], self.names[1][1][b], self.names[1][0][b])
        marks, to = marks.tolist(), np.cumsum(counts[0] + counts[1]).tolist()
        groups = ["".join(marks[s:e]) for s, e in zip([0, *to], to, strict=False)]

        def per_word(values: np.ndarray, of: int) -> np.ndarray:
            total, at = np.concatenate(([0], np.cumsum(values))), np.concatenate(([0], np.cumsum(counts[of])))
            return total[at[1:]] - total[at[:-1]]

        return np.stack([counts[0], counts[1], per_word(shut[0], 0), per_word(links, 0), good], 1), codes, groups

    def block(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts the measures, the groups' text without the last mark (empty without tokens), and the links: the
        pairs of the block, and by (text, pair) the text, the pair's place and how often."""
        if self.chars > CACHE_CHARS:
            self.clear()
        words = [self.words(t) for t in texts]
        known = set(chain.from_iterable(words))
        self.learn([w for w in known if w not in self.number])
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
        of = np.repeat(np.arange(len(words)), size)
        # Words that lose bytes may make up for each other: such a text is aligned as a whole.
        odd = np.unique(of[self.facts[ids, 4] == 0]).tolist()
        if odd:
            whole = [t for i in odd if (t := texts[i]) not in self.number]
            self.learn(list(dict.fromkeys(whole)))
            for i in odd:
                words[i] = [texts[i]]
            size = np.fromiter(map(len, words), np.int64, len(words))
            ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
            of = np.repeat(np.arange(len(words)), size)
        edge = np.concatenate(([0], np.cumsum(size)))
        total = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(self.facts[ids, :4], axis=0)))
        measures = total[edge[1:]] - total[edge[:-1]]
        listed, at = ids.tolist(), edge.tolist()
        text = ["".join(map(self.groups.__getitem__, listed[s:e]))[:-1] for s, e in zip(at, at[1:], strict=False)]
        # Pairs of the block's words, then by word their places, then by text.
        seen = np.zeros(len(self.facts), bool)
        seen[ids] = True
        met = np.flatnonzero(seen)
        ids = (np.cumsum(seen) - 1)[ids]
        n = self.facts[met, 3]
        from_ = np.concatenate(([0], np.cumsum(n)))
        pairs, place = np.unique(self._links(met), return_inverse=True)
        n_of = n[ids]
        step = np.arange(int(n_of.sum())) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        key = np.sort(np.repeat(of, n_of) * max(1, len(pairs)) + place[np.repeat(from_[:-1][ids], n_of) + step])
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate((new, [len(key)]))) if len(key) else new
        return measures, text, pairs, key[new] // max(1, len(pairs)), key[new] % max(1, len(pairs)), times


_aligners: dict[tuple, Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's own aligner."""
    claim("alignment", _aligners.clear)
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _lists(at: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _blocks(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Rows (text, docs) to rows of _ALIGNED: one per text, and one per block with its pairs and how many documents hold
    each, which has no digest."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        known = aligner(*paths)
        for i, j in balanced(pc.binary_length(batch.column(0)).to_pylist(), BLOCK_CHARS):
            texts, docs = batch.column(0).slice(i, j - i).to_pylist(), np.array(batch.column(1).slice(i, j - i).to_pylist(), np.int64)
            measures, groups, pairs, text, place, times = known.block(texts)
            block, number = task << 32 | number, number + 1
            at = np.searchsorted(text, np.arange(len(texts) + 1))
            # Places as differences within a text, which are small.
            steps = np.diff(place, prepend=0)
            starts = at[:-1][at[:-1] < at[1:]]
            steps[starts] = place[starts]
            held = np.zeros(len(pairs), np.int64)
            np.add.at(held, place, docs[text])
            n = len(texts)
            none = [pa.nulls(n, f.type) for f in _ALIGNED]
            digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            sums = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(digests, pa.binary()), pa.array(docs), *(pa.array(measures[:, k]) for k in range(4)), pa.array(sums, pa.string()), _lists(at, steps, pa.int32()), _lists(at, times, pa.int32()), *none[-2:]], schema=_ALIGNED)
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.nulls(1, f.type) for f in list(_ALIGNED)[1:-2]), _lists(np.array([0, len(pairs)]), pairs, pa.int64()), _lists(np.array([0, len(pairs)]), held, pa.int64())], schema=_ALIGNED)


def _measured(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Texts of a block with n_best and count_sum, from the corpus-wide counts of the block's pairs (place, n, best)."""
    order = np.argsort(pairs.column("place").to_numpy())
    n, best = pairs.column("n").to_numpy()[order], pairs.column("best").to_numpy(zero_copy_only=False)[order]
    out = {"n_best": [], "count_sum": []}
    for batch in texts.select(["at", "times"]).to_batches():
        size = pc.list_value_length(batch.column("at")).to_numpy(zero_copy_only=False).astype(np.int64)
        edge = np.concatenate(([0], np.cumsum(size)))
        steps, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("at", "times"))
        run = np.concatenate(([0], np.cumsum(steps)))
        place = run[1:] - np.repeat(run[edge[:-1]], size)
        for name, value in (("n_best", best[place] * times), ("count_sum", n[place] * times)):
            total = np.concatenate(([0], np.cumsum(value)))
            out[name].append(total[edge[1:]] - total[edge[:-1]])
    kept = texts.select(["digest", "docs", *_MEASURES, "groups_sha256"])
    for name, parts in out.items():
        kept = kept.append_column(name, pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)))
    return kept


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of docs: (texts, pairs). texts: digest (SHA-256 of the text), docs (rows that have it), n_a, n_b,
    n_groups, n_links, groups_sha256, n_best, count_sum. pairs: a, b, n (rows whose text holds the pair linked), best (n
    is a's highest)."""
    importable(docs.sparkSession)
    texts = docs.filter(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("docs"))
    kept = written(texts.mapInArrow(lambda batches: _blocks(batches, (a_path, b_path)), _ALIGNED_DDL))
    import sentencepiece

    base = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    of_block = kept.filter("digest is null").select("block", F.posexplode(F.arrays_zip("pair", "held")).alias("place", "x")).select("block", "place", "x.pair", "x.held")
    counted = of_block.groupBy("pair").agg(F.sum("held").alias("n")).withColumn("a", F.expr(f"pair div {base}"))
    # Ids of A have at most B's vocabulary of partners each.
    known = written(counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a"))))
    met = of_block.select("block", "place", "pair").join(known.select("pair", "n", "best"), "pair").select(F.col("block").alias("of"), "place", "n", "best")
    measured = kept.filter("digest is not null").drop("pair", "held").groupBy("block").cogroup(met.groupBy("of")).applyInArrow(_measured, _JOINED_DDL)
    return measured, known.select("a", (F.col("pair") % base).alias("b"), "n", "best")


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document (repeated rows and null ids each keep a row): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256. Null and empty texts, and texts whose tokens' bytes aren't a space and the text, have zeros and an
    empty digest, and count for no pair. Texts of any length are aligned whole; an empty table gives no rows; other
    columns aren't read."""
    texts = written(aligned_texts(docs, a_path, b_path)[0])
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    # Texts with more than a thousandth of the rows, fewer than a thousand, are known to every task; their documents
    # stay where they are.
    hot = F.col("docs") > F.lit(HOT) * F.lit(docs.count())
    sent = texts.filter(hot).select(F.col("digest").alias("d"), F.struct(*numbers, "groups_sha256").alias("m"))
    met = rows.join(F.broadcast(sent), F.col("digest") == F.col("d"), "left")
    # Rows without a text have nobody to meet.
    at_home = met.filter("d is not null or digest is null").select("doc_id", "m")
    others = met.filter("d is null and digest is not null").select("doc_id", "digest").join(texts.filter(~hot).select("digest", F.struct(*numbers, "groups_sha256").alias("m")), "digest", "left").select("doc_id", "m")
    return at_home.unionByName(others).select("doc_id", *(F.coalesce(F.col(f"m.{c}"), F.lit(0)).cast("bigint").alias(c) for c in numbers), F.coalesce("m.groups_sha256", F.lit("")).alias("groups_sha256"))


def op13_align_tokenizers(spark, sf_dir: str) -> DataFrame:
    """Every document's alignment of the two vocabularies. Edge cases are those of aligned()."""
    return aligned(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
