"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A whole text is parsed into phrases that occur in
it, over word boundaries as well: each phrase is the longest match from where the last one ended. The language
that needs the fewest bits wins: a phrase costs the log of the longest training length, whatever the language,
and a character that a language's text lacks the log of the alphabet besides. So a label with little text gains
nothing from it. Many texts are parsed in step, under all languages at once; nothing is remembered of one text
for another.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, fresh, table
from .tokens import balanced

#: Parameters of the bounded training sample: about so many documents and at most so many characters per
#: language, and so many languages, those with the most documents.
TRAIN_DOCS, TRAIN_CHARS, MAX_LABELS = 300, 40_000, 256
#: Parameters of the parse: characters of text handled together, places of a text parsed as one lane (longer texts
#: take several, which are put together exactly), frequent letters with a column in the tables, moves from which
#: on a state has a row there, and languages whose parses are put together at once.
BATCH_CHARS, LANE, FREQUENT, BRANCHES, TOGETHER = 1 << 20, 1024, 63, 3, 8


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of text's suffix automaton, by state; 0 is the start."""
    nexts: list[dict[str, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        cur = len(nexts)
        nexts.append({}), length.append(length[last] + 1), link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q])), length.append(length[p] + 1), link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def phrases(text: str, moves: list[dict[str, int]]) -> int:
    """Phrases of the greedy parse of text, each the longest match from where the last one ended; a
    character that the automaton lacks ends a phrase and leads the next one."""
    n = state = 0
    for c in text:
        if c in moves[state]:
            state = moves[state][c]
        else:
            n += 1
            state = moves[0].get(c, 0)
    return n + 1 if text else n


def interleaved(state: np.ndarray, letter: np.ndarray, to: np.ndarray, n_states: int, base: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Moves (state, letter, to), sorted by state, as an array of cells, which will begin at base: a state becomes the place
    of its row, no two states have the same, and the move by a letter is in the cell so many behind it; rows lie in each
    other's gaps. A cell has the place of its own row above that of the next state's, 32 bits each; it is -1 where there is
    no move. Also the places by state. letters are below width."""
    degree = np.bincount(state, minlength=n_states)
    first = np.cumsum(degree) - degree
    place, own, taken, r = np.zeros(n_states, np.int64), np.full(width, -1, np.int64), np.zeros(0, bool), np.random.default_rng(0)
    room = laid = 0
    # Long rows first, while most cells are free. Rows go to random places, and again where one meets another.
    for low, high, spare in ((16, width, 8), (8, 15, 6), (4, 7, 4), (2, 3, 3), (1, 1, 2), (0, 0, 2)):
        left = np.flatnonzero((degree >= low) & (degree <= high))
        laid += int(degree[left].sum()) or len(left)
        room, tries = max(room, spare * laid + 64), 0
        while len(left):
            room, tries = room + (room // 2 if tries and tries % 32 == 0 else 0), tries + 1
            if room > len(taken):
                own = np.append(own, np.full(room - len(taken), -1))
                taken = np.append(taken, np.zeros(room - len(taken), bool))
            at, size = r.integers(0, room, len(left)), degree[left]
            row = np.repeat(np.arange(len(left)), size)
            moves = first[left][row] + np.arange(len(row)) - (np.cumsum(size) - size)[row]
            cells = at[row] + letter[moves]
            lost = taken[at]
            # Of the rows that meet in this try, the one that is written last stays.
            by = np.empty(room + width, np.int64)
            by[at] = np.arange(len(left))
            lost |= by[at] != np.arange(len(left))
            by[cells] = row
            lost[row[(own[cells] >= 0) | (by[cells] != row)]] = True
            won = ~lost[row]
            own[cells[won]] = moves[won]
            place[left[~lost]], taken[at[~lost]] = at[~lost], True
            left = left[lost]
    place += base
    filled = np.flatnonzero(own >= 0)
    own[filled] = place[state[own[filled]]] << 32 | place[to[own[filled]]]
    return own, place


def training_text(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS, max_labels: int = MAX_LABELS) -> dict[str, str]:
    """Lower-case text of a bounded sample per non-null lang. The sample goes by a hash of the row, with a
    rate from the language's count, and each document gives a piece whose place goes by another; it reaches
    the driver, as its size is bounded by the parameters."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    # No document gives more than a hundredth of the sample, so that none sets the tone, unless the sample would
    # stay short: the piece is the smallest of these with which the documents picked fill it twice.
    sizes = [max(200, max_chars // 100) << i for i in range(8)]
    held = [F.sum(F.least(F.length("text"), F.lit(x))).alias(f"held{i}") for i, x in enumerate(sizes)]
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), *held).orderBy(F.desc("n"), "lang").limit(max_labels)
    share = F.least(F.lit(1.0), F.lit(float(max_docs)) / F.col("n"))
    size = F.coalesce(*(F.when(F.col(f"held{i}") * share >= 2 * max_chars, x) for i, x in enumerate(sizes)), F.lit(sizes[-1]))
    counts = counts.select("lang", "n", size.alias("size"))
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    picked = labelled.join(F.broadcast(counts), "lang").filter(unit < F.ceil(F.lit(float(max_docs * (1 << 30))) / F.col("n")))
    picked = picked.select("lang", "size", unit.alias("u"), F.xxhash64(F.lit(1), "doc_id", "text").alias("at"), F.regexp_replace(F.lower("text"), r"\s+", " ").alias("t"))
    start = F.pmod(F.col("at"), F.greatest(F.lit(1), F.length("t") - F.col("size") + 1)).cast("int") + 1
    # A piece begins with a whole word where words are short enough to tell.
    piece = F.when(F.length("t") <= F.col("size"), F.col("t")).otherwise(F.regexp_replace(F.substring("t", start, F.col("size")), r"^\S{0,40} ", ""))
    # Equal rows share a hash, so a row that is everywhere is held once.
    pieces = picked.select("lang", "u", piece.alias("t")).distinct()
    texts = pieces.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("u", "t"))), lambda s: s["t"]), " ").alias("t"))
    return {r["lang"]: (" " + " ".join(r["t"].split()) + " ")[:max_chars] for r in texts.orderBy("lang").collect()}


@lru_cache
def _kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks that go with letters, 0 for all else."""
    kind = {"L": 2, "M": 1}
    return np.fromiter((kind.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def plain(text: str) -> str:
    """text in lower case with one space for each run of what is neither letter nor mark, before the first word and
    after the last."""
    points = _points(text.lower())
    words = np.where(_kinds()[points] > 0, points, ord(" ")).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return " " + "".join(f"{w} " for w in words.split(" ") if w)


class Parser:
    """Phrase counts of texts under all languages. The automata share arrays with moves by state: rows of frequent
    letters for states that branch, one move beside each state, and the other moves sorted by state and letter; a
    parse that goes on from one place alone follows these. Lanes, which are parsed in step, follow the same moves as
    interleaved rows, where a move is one look."""

    def __init__(self, training: dict[str, str]):
        self.langs = sorted(training)
        texts = [plain(training[x]) for x in self.langs]
        letters = [c for c, _ in sorted(Counter("".join(texts)).items(), key=lambda x: (-x[1], x[0]))]
        if " " not in letters:
            letters.append(" ")
        #: Bits of a phrase and, besides, of a character that a language lacks.
        self.cost, self.alphabet = math.log2(max([2, *map(len, texts)])), math.log2(len(letters) + 2)
        at = {c: i for i, c in enumerate(letters)}
        #: By code point the column: one for each letter of the training texts, one for other letters, and a space
        #: for what is no letter.
        self.space, self.width = at[" "], len(letters) + 1
        self.column = np.where(_kinds() > 0, len(letters), self.space).astype(np.int32)
        self.column[[ord(c) for c in letters]] = np.arange(len(letters))
        self.frequent = min(FREQUENT, len(letters))
        # State 0 is none; each automaton's states follow those of the one before.
        self.roots, row, c1, t1, more = [], [0], [-1], [0], [False]
        rows, keys, values = [np.zeros(self.frequent + 1, np.int32)], [], []
        self.starts = np.zeros((len(texts), self.width), np.int32)
        cells, firsts = [np.zeros(0, np.int64)], []
        for k, text in enumerate(texts):
            base = len(row)
            self.roots.append(base)
            states = automaton(text)
            state = np.repeat(np.arange(len(states)), [len(x) for x in states])
            letter = np.fromiter((at[c] for x in states for c in x), np.int64, len(state))
            to = np.fromiter((t for x in states for t in x.values()), np.int64, len(state))
            laid, place = interleaved(state, letter, to, len(states), sum(map(len, cells)), self.width)
            cells.append(laid), firsts.append(np.full(self.width, place[0]))
            for c, to in states[0].items():
                firsts[k][at[c]] = place[to]
            for state, moves in enumerate(states):
                here = [(at[c], base + to) for c, to in moves.items()]
                if state == 0:
                    for c, to in here:
                        self.starts[k, c] = to
                if len(here) >= BRANCHES:
                    own = np.zeros(self.frequent + 1, np.int32)
                    for c, to in here:
                        if c < self.frequent:
                            own[c] = to
                    row.append(len(rows)), c1.append(-1), t1.append(0)
                    rows.append(own)
                    here = [(c, to) for c, to in here if c >= self.frequent]
                else:
                    row.append(0), c1.append(here[0][0] if here else -1), t1.append(here[0][1] if here else 0)
                    here = here[1:]
                more.append(bool(here))
                for c, to in here:
                    keys.append((base + state) * self.width + c), values.append(to)
        self.row, self.c1, self.t1, self.more = np.array(row, np.int32), np.array(c1, np.int32), np.array(t1, np.int32), np.array(more)
        self.rows, self.keys, self.values = np.stack(rows), np.array(keys, np.int64), np.array(values, np.int32)
        order = np.argsort(self.keys)
        self.keys, self.values = np.append(self.keys[order], np.iinfo(np.int64).max), np.append(self.values[order], 0).astype(np.int32)
        self.roots = np.array(self.roots, np.int32)
        #: All moves as interleaved rows, and by language and column the row where a phrase starts.
        self.cells, self.firsts = np.concatenate(cells), np.reshape(firsts, (-1, self.width))
        self.lacking = self.starts == 0
        self.lacked = self.lacking.any(0)

    def columns(self, text: str) -> tuple[np.ndarray, bool]:
        """The text as columns, in lower case, with one space for each run of what is no letter, before the first
        and after the last; and whether there is a letter."""
        points = _points(text.lower())
        cols = np.empty(len(points) + 2, np.int32)
        cols[0] = cols[-1] = self.space
        cols[1:-1] = self.column[points]
        blank = cols == self.space
        keep = ~blank
        keep[0] = True
        keep[1:] |= ~blank[:-1]
        return cols[keep], bool((_kinds()[points] == 2).any())

    def _lanes(self, some: range, cols: np.ndarray, alive: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of lanes parsed apart under some languages: where phrases start (language x place), and, for the first of the lanes,
        which have one after them: the phrases that start in the lane after when the parse goes on there, until it starts one
        where that lane's own parse does, less its own until there; and whether it does, or the text ends. A phrase depends on
        where it starts alone, so from there on both parses are the same. cols: columns by step and then lane, the longest lanes
        first; alive: lanes by step; after: the lane after each."""
        cells, low, joints, begin = self.cells, (1 << 32) - 1, len(after), np.cumsum(alive) - alive
        starts, ends = np.zeros((len(some), len(cols)), bool), []
        starts[:, : alive[0]] = True
        at, first = np.empty((2, alive[0]), np.int64)
        for j, k in enumerate(some):
            firsts, state = self.firsts[k], self.firsts[k].take(cols[: alive[0]])
            for x, m in zip(begin[1:].tolist(), alive[1:].tolist(), strict=True):
                c, s, i, new = cols[x : x + m], state[:m], at[:m], starts[j, x : x + m]
                np.add(s, c, out=i)
                cell = cells.take(i)
                np.right_shift(cell, 32, out=i)
                np.not_equal(i, s, out=new)
                np.bitwise_and(cell, low, out=s)
                np.putmask(s, new, firsts.take(c, out=first[:m], mode="clip"))
            ends.append(state[:joints])
        more, met = np.zeros(len(some) * joints, np.int64), np.tile(after >= joints, len(some))
        left, s, there = np.arange(len(more)), np.concatenate(ends), np.tile(after, len(some))
        for x, m in zip(begin.tolist(), alive.tolist(), strict=True):
            here = there < m
            if not here.all():
                left, s, there = left[here], s[here], there[here]
            if not len(left):
                break
            j, c = left // joints, cols[x + there]
            own, cell = starts[j, x + there], cells[s + c]
            new = cell >> 32 != s
            more[left] += new.astype(np.int64) - own
            s = np.where(new, self.firsts[some[0] + j, c], cell & low)
            on = ~(new & own)
            if not on.all():
                met[left[~on]] = True
                left, s, there = left[on], s[on], there[on]
        return starts, more.reshape(len(some), joints), met.reshape(len(some), joints)

    def _phrase_end(self, cols: np.ndarray, at: int, k: int) -> int:
        """Where the phrase that starts at a place of a text ends."""
        state = self.starts.item(k, cols.item(at)) or self.roots.item(k)
        for i in range(at + 1, len(cols)):
            c = cols.item(i)
            to = self.rows.item(self.row.item(state), min(c, self.frequent))
            if not to and self.c1.item(state) == c:
                to = self.t1.item(state)
            if not to and self.more.item(state):
                key = state * self.width + c
                j = int(np.searchsorted(self.keys, key))
                to = self.values.item(j) if self.keys.item(j) == key else 0
            if not to:
                return i
            state = to
        return len(cols)

    def _joined(self, cols: np.ndarray, own: list[np.ndarray], k: int) -> int:
        """Ends of phrases inside a text whose lanes of LANE places were parsed apart, each from its first place. own:
        places of these ends by lane. A phrase depends on where it starts alone, so the parses of a lane agree from
        the first start that they share."""
        n, at = 0, 0
        for j, ends in enumerate(own):
            begin, stop = j * LANE, min((j + 1) * LANE, len(cols))
            while at < stop:
                i = int(np.searchsorted(ends, at, side="right"))
                if i < len(ends) and (at == begin or i and ends[i - 1] == at):
                    n, at = n + len(ends) - i, int(ends[-1])
                at = self._phrase_end(cols, at, k)
                n += at < len(cols)
        return n

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases and lacking characters (texts x languages) of whole texts, and which have a letter."""
        total, lacks = (np.zeros((len(texts), len(self.langs)), np.int64) for _ in range(2))
        spoken = np.zeros(len(texts), bool)
        for a, b in balanced([len(t) for t in texts], BATCH_CHARS):
            read = [self.columns(t) for t in texts[a:b]]
            spoken[a:b] = [x for _, x in read]
            size = np.array([len(cols) for cols, _ in read])
            cols, begin = np.concatenate([cols for cols, _ in read]), np.cumsum(size) - size
            rare = np.flatnonzero(self.lacked[cols])
            text = np.searchsorted(begin, rare, side="right") - 1
            for k in range(len(self.langs)):
                lacks[a:b, k] = np.bincount(text[self.lacking[k, cols[rare]]], minlength=b - a)
            # Lanes by length, so that those still to be parsed come first; of the full ones those with a lane after them.
            n = -(-size // LANE)
            owner = np.repeat(np.arange(b - a), n)
            rest = size[owner] - (np.arange(len(owner)) - (np.cumsum(n) - n)[owner]) * LANE
            order = np.lexsort((rest <= LANE, -np.minimum(rest, LANE)))
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            alive = np.searchsorted(-np.minimum(rest, LANE)[order], -np.arange(1, min(int(rest.max()), LANE) + 1), side="right")
            step = np.arange(len(cols)) - np.repeat(begin, size)
            place = (np.cumsum(alive) - alive)[step % LANE] + rank[np.repeat(np.cumsum(n) - n, size) + step // LANE]
            turned = np.empty(len(cols), np.int64)
            turned[place] = cols
            joined = order[: int((rest > LANE).sum())]
            after, whose = rank[joined + 1], owner[joined]
            for some in (range(k, min(k + TOGETHER, len(self.langs))) for k in range(0, len(self.langs), TOGETHER)):
                starts, more, met = self._lanes(some, turned, alive, after)
                for j, k in enumerate(some):
                    own = starts[j].take(place)
                    total[a:b, k] = np.add.reduceat(own, begin, dtype=np.int64) + np.bincount(whose, more[j], b - a).astype(np.int64)
                    # Where a lane's parse doesn't meet the next one's, one phrase follows another.
                    for i in np.unique(whose[~met[j]]).tolist():
                        text = np.flatnonzero(own[begin[i] : begin[i] + size[i]])
                        text = text[text % LANE > 0]
                        total[a + i, k] = self._joined(read[i][0], np.split(text, np.searchsorted(text, np.arange(1, n[i]) * LANE)), k) + 1
        return total, lacks, spoken

    def totals(self, texts: list[str]) -> np.ndarray:
        """Phrases (texts x languages) of whole texts."""
        return self.counts(texts)[0]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and its lead over the second (0 none, towards 1 all); ties go to the
        first label. und and 0 for null, for no letter, and where nothing was learned."""
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        total, lacks, spoken = self.counts([t or "" for t in texts])
        bits = total * self.cost + lacks * self.alphabet
        best = bits.argmin(1)
        lead = 1 - bits[np.arange(len(texts)), best] / np.partition(bits, 1, 1)[:, 1] if len(self.langs) > 1 else np.full(len(texts), 0.5)
        return [(self.langs[k], x) if fit else ("und", 0.0) for fit, k, x in zip(spoken.tolist(), best.tolist(), lead.tolist(), strict=True)]


_parsers: dict[int, Parser] = {}


def _parser(training: dict[str, str]) -> Parser:
    """The worker's parser; tasks of one model share it."""
    claim("language", _parsers.clear)
    key = hash(tuple(sorted(training.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(training)
    return _parsers[key]


def predicted(text: Column, training) -> Column:
    """struct(lang_pred, score) of a text. training: a broadcast of what training_text() returned."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = _parser(training.value)
        for column in batches:
            # Texts become Python's a few at a time: a batch of long ones is large.
            out, sizes = [], [n or 0 for n in pc.binary_length(column).to_pylist()]
            for a, b in balanced(sizes, BATCH_CHARS):
                out += parser.predict(column.slice(a, b - a).to_pylist())
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=["lang_pred", "score"])

    # Else a filter on the result is pushed below it and every text is parsed twice.
    return run.asNondeterministic()(text)


def identify(docs: DataFrame, train: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> DataFrame:
    """docs, every row and column kept, with lang_pred and score (lang_pred_ and so on where docs has such a column
    already), learned from text and lang of train. und, with score 0: null text, text without a letter, or nothing to
    learn from. Only text is read; repeated rows and null ids keep a row each, and a text of any length is parsed
    whole."""
    out = fresh(docs, "__lid")
    names = [fresh(docs, c) for c in ("lang_pred", "score")]
    training = docs.sparkSession.sparkContext.broadcast(training_text(train, max_docs, max_chars))
    found = docs.withColumn(out, predicted(F.col("text"), training))
    return found.select(*docs.columns, F.col(f"{out}.lang_pred").alias(names[0]), F.col(f"{out}.score").alias(names[1]))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 5, is 0; null ids aren't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score, learned from rows that aren't held out.
    Null texts and texts without a letter are und; repeated rows keep a row each; an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    train = docs.filter(~held_out(F.col("doc_id")))
    return identify(docs.select("doc_id", "text"), train).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
