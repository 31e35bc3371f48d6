"""Spelling variants: words one edit apart, found by search schemes over suffix-rank intervals.

Two words one edit apart agree on either half: on the first half of the shorter one, or on the rest
of it. So every word goes to the words of its length class that share its first half, and to those
that share its second half. A crowd that shares a half is split again the same way, by the halves of
what is not yet known to be alike, until that is a single letter; so crowds end by themselves.

Crowds are dealt to cells, and every cell is indexed on its own: an FM-index of its words, each closed
by a delimiter, and one of the words written backwards for the other direction. A search matches the
half that is alike exactly, letter by letter, as an interval of suffix ranks, then extends it across
the other half and allows one letter to be exchanged or put in. Searches begin and end at a delimiter,
so each goes in one direction: from the first half to the right, or from the second half to the left.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, column, slices, written

#: Words have at least this many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs this many times as often as its variant.
FACTOR = 10
#: One in this many runs of a document loses a code point.
DAMAGED = 31
#: Crowds of more words are split again; words of a cell, on average.
CROWD, CELL = 20_000, 24_000
#: Distinct words a task holds before it passes them on.
HELD = 200_000

_RUNS = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def words(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of all texts and how often each occurs.

    Words are maximal runs of ASCII letters, lower-cased, and of U+00C0 to U+00FF. A run whose crc32
    (of the document id as text, a colon and the run) is divisible by ``DAMAGED`` loses the code
    point that the crc32 points at. A null id is written as nothing, a null text has no words. Rows
    that repeat count again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(column(part, "doc_id").to_pylist(), as_bytes(part), strict=True):
                    seed = zlib.crc32(f"{doc_id or ''}:".encode())
                    for word, n in Counter(_RUNS.findall(text.lower().decode())).items():
                        digest = zlib.crc32(word.encode(), seed)
                        if digest % DAMAGED == 0:
                            at = digest % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LENGTH:
                                continue
                        held[word] = held.get(word, 0) + n
                    if len(held) > HELD:
                        yield passed()
        if held:
            yield passed()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# Crowds -----------------------------------------------------------------------------------------

#: What is known of the words of a crowd: the length of the shorter word of a pair (``size``), how many
#: first and last letters they share, and below which place the first difference of a pair must lie.
_KNOWN = ["size", "front", "back", "below"]


def _halves(rows: DataFrame) -> DataFrame:
    """Every row of a crowd twice: with the first half of what is open known to be alike, and with the second."""
    half = F.floor((F.col("size") - F.col("front") - F.col("back")) / 2).cast("int")
    cut = F.col("front") + half
    left = F.struct(cut.alias("front"), F.col("back").alias("back"), F.col("below").alias("below"))
    right = F.struct(F.col("front").alias("front"), (F.col("size") - cut).alias("back"), cut.alias("below"))
    return rows.select("word", "n", "size", F.explode(F.array(left, right)).alias("part")).select("word", "n", "size", "part.*")


def _crowd() -> Column:
    """The key of a crowd. Words of two crowds that share a key meet in vain, and nothing else happens."""
    begin, end = F.left("word", F.col("front")), F.right("word", F.col("back"))
    return F.xxhash64("size", "front", "back", begin, end)


def crowds(vocabulary: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``word, n``, what is known and ``key``: every word in each crowd in which it may have a near word.

    A pair of near words shares exactly one crowd whose ``front`` and ``below`` admit its first
    difference. A crowd keeps more than ``crowd`` words only if its words differ in one place alone.
    """
    size = F.length("word")
    # As the shorter word of a pair, or as the longer one.
    rows = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("size")).filter(F.col("size") >= LEAST_LENGTH)
    rows = rows.select("word", "n", "size", F.lit(0).alias("front"), F.lit(0).alias("back"), (F.col("size") + 1).alias("below"))
    done = None
    while True:
        rows = written(_halves(rows).withColumn("key", _crowd()))
        large = written(rows.filter("size - front - back > 1").groupBy("key").count().filter(F.col("count") > crowd).select("key"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti").select(rows.columns)
        done = small if done is None else done.unionByName(small)
        rows = rows.join(large, "key", "left_semi").select("word", "n", *_KNOWN)


# The index of a cell ----------------------------------------------------------------------------


class Index:
    """An FM-index of words that are given as letter codes from 1 on, code 0 being the delimiter.

    Every word is closed by a delimiter. Suffixes that are alike up to their delimiter rank in the
    order of their words, so rows of the transform still map to each other in order.
    """

    #: Rows from one line of the occurrence table to the next.
    STEP = 32

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, codes: int):
        n = len(lengths)
        ends = np.cumsum(lengths + 1)
        total = int(ends[-1]) if n else 0
        text = np.zeros(total, np.uint8)
        inside = np.ones(total, bool)
        inside[ends - 1] = False
        text[inside] = letters
        self.words, self.codes = n, codes
        owner = np.repeat(np.arange(n, dtype=np.int32), lengths + 1)
        rest = (ends[owner] - 1 - np.arange(total)).astype(np.int32)
        order = self._ranked(text, rest)
        before = np.where(order > 0, text[order - 1], 0)  # before a word stands a delimiter
        self.bwt = before.astype(np.uint8)
        self.owner = owner[order[self.bwt == 0]] if total else owner
        counts = np.bincount(text, minlength=codes)
        self.first = np.cumsum(counts) - counts
        lines = -(-total // self.STEP) + 1
        padded = np.full(lines * self.STEP, 255, np.uint8)
        padded[:total] = self.bwt
        self.lines = padded.reshape(lines, self.STEP)
        table = np.zeros((lines + 1, codes), np.int32)
        at = np.arange(total) // self.STEP + 1
        np.add.at(table, (at, self.bwt), 1)
        self.table = np.cumsum(table, axis=0, dtype=np.int32)

    @staticmethod
    def _ranked(text: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The suffixes in order, by doubling the length that is compared."""
        total, longest = len(text), int(rest.max(initial=0)) + 1
        key = np.zeros(total, np.int64)
        for step in range(8):
            shifted = np.zeros(total, np.int64)
            shifted[: total - step] = text[step:] if step else text
            key = key << 7 | np.where(rest >= step, shifted, 0)
        rank, compared = np.unique(key, return_inverse=True)[1], 8
        while compared < longest:
            ahead = np.zeros(total, np.int64)
            ahead[: total - compared] = rank[compared:] + 1
            names, later = np.unique(rank * (total + 1) + np.where(rest >= compared, ahead, 0), return_inverse=True)
            if len(names) == rank.max(initial=-1) + 1:
                break
            rank, compared = later, compared * 2
        return np.argsort(rank, kind="stable")

    def rank(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each code occurs in the transform before a row."""
        line, within = np.divmod(row, self.STEP)
        inside = (self.lines[line] == code[:, None]) & (np.arange(self.STEP) < within[:, None])
        return self.table[line, code] + inside.sum(axis=1)

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each string with one more letter before it."""
        return self.first[code] + self.rank(code, low), self.first[code] + self.rank(code, high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Interval number, code, low and high of every letter that stands before the strings of some intervals."""
        sizes = high - low
        number = np.repeat(np.arange(len(low)), sizes)
        rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        found, counts = np.unique(number * self.codes + self.bwt[rows], return_counts=True)
        number, code = np.divmod(found, self.codes)
        letter = code > 0
        number, code, counts = number[letter], code[letter], counts[letter]
        begin = self.first[code] + self.rank(code, low[number])
        return number, code, begin, begin + counts

    def whole(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which intervals hold a whole word, and the words. An interval holds a word once."""
        none = np.zeros(len(low), np.int64)
        before = self.rank(none, low)
        holds = np.flatnonzero(self.rank(none, high) > before)
        return holds, self.owner[before[holds]]


def search(index: Index, letters: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query and word of all pairs in which the word is the query with one letter exchanged or put in.

    The last ``exact`` letters of a query must stand as they are. Each pair comes out once.
    """
    ends = np.cumsum(lengths)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    query = np.arange(len(lengths))
    low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), index.words, np.int64)
    # Strings with an error: their query, how many of its letters are used up, and their interval.
    bent = [np.zeros(0, np.int64) for _ in range(4)]
    used = 0

    def following(query: np.ndarray, used: np.ndarray | int) -> np.ndarray:
        """The next letter of a query to the left; none where it is used up."""
        open_ = lengths[query] > used
        return np.where(open_, letters[np.maximum(ends[query] - 1 - used, 0)], 0).astype(np.int64)

    while len(query) or len(bent[0]):
        # Strings with an error go on without another one, or are whole.
        of, spent, begin, end = bent
        code = following(of, spent)
        ready = code == 0
        holds, word = index.whole(begin[ready], end[ready])
        found.append((of[ready][holds], word))
        of, spent, code = of[~ready], spent[~ready] + 1, code[~ready]
        begin, end = index.extend(code, begin[~ready], end[~ready])
        some = end > begin
        bent = [of[some], spent[some], begin[some], end[some]]
        # Strings without an error take one, then their own next letter.
        code = following(query, used)
        free = np.flatnonzero(exact[query] <= used)
        if len(free):
            starts, node = np.unique(low[free], return_inverse=True)  # strings of one length: the begin names the interval
            ends_of = np.zeros(len(starts), np.int64)
            ends_of[node] = high[free]
            number, letter, begin, end = index.children(starts, ends_of)
            many = np.bincount(number, minlength=len(starts))
            first = np.cumsum(many) - many
            each = np.repeat(free, many[node])
            child = np.arange(len(each)) - np.repeat(np.cumsum(many[node]) - many[node], many[node]) + np.repeat(first[node], many[node])
            other = letter[child] != code[each]
            each, child = each[other], child[other]
            swapped = code[each] > 0
            of = np.concatenate([query[each], query[each[swapped]]])
            spent = np.concatenate([np.full(len(each), used), np.full(int(swapped.sum()), used + 1)])
            child = np.concatenate([child, child[swapped]])
            bent = [np.concatenate(pair) for pair in zip(bent, (of, spent, begin[child], end[child]))]
        going = code > 0
        query, code = query[going], code[going]
        low, high = index.extend(code, low[going], high[going])
        some = high > low
        query, low, high = query[some], low[some], high[some]
        used += 1
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _first_difference(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first letters the words ``a`` and ``b`` share."""
    shared = np.zeros(len(a), np.int64)
    going = np.arange(len(a))
    while len(going):
        at = shared[going]
        short = np.minimum(lengths[a[going]], lengths[b[going]])
        alike = (at < short) & (letters[starts[a[going]] + np.minimum(at, short - 1)] == letters[starts[b[going]] + np.minimum(at, short - 1)])
        going = going[alike]
        shared[going] += 1
    return shared


def near_pairs(found: list[str], entry: np.ndarray, size: np.ndarray, front: np.ndarray, back: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``found`` (distinct words) of all pairs of near words that the crowds of a cell admit.

    ``entry`` names the word of each row of the crowds. Of two words the shorter one comes first;
    words of one length come in both orders.
    """
    points = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
    alphabet, letters = np.unique(points, return_inverse=True)
    letters = (letters + 1).astype(np.uint8)
    lengths = np.array([len(word) for word in found], np.int64)
    starts = np.cumsum(lengths) - lengths
    ask = lengths[entry] == size  # the shorter word of a pair looks for the longer one
    pairs = []
    for right in (True, False):
        # The longer known part is matched exactly; from the first half the search goes to the right.
        one_way = (front >= back) == right
        members = np.unique(entry[one_way])
        asked = np.flatnonzero(one_way & ask)
        if not len(asked):
            continue
        step = -1 if right else 1

        def written_out(of: np.ndarray) -> np.ndarray:
            many = lengths[of]
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            begin = starts[of] if step > 0 else starts[of] + many - 1  # noqa: B023
            return letters[np.repeat(begin, many) + step * within]  # noqa: B023

        index = Index(written_out(members), lengths[members], len(alphabet) + 1)
        of = entry[asked]
        row, word = search(index, written_out(of), lengths[of], np.maximum(front, back)[asked])
        asked, word = asked[row], members[word]
        shared = _first_difference(letters, starts, lengths, entry[asked], word)
        fits = (shared >= front[asked]) & (shared < below[asked])
        pairs.append((entry[asked][fits], word[fits]))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def _cell(table: pa.Table) -> pa.Table:
    """Per word of a cell: how many near words it has here and the most frequent one of them."""
    known = [table.column(name).to_numpy().astype(np.int64) for name in _KNOWN]
    encoded = table.column("word").combine_chunks().dictionary_encode()
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    found, entry = encoded.dictionary.to_pylist(), encoded.indices.to_numpy().astype(np.int64)
    n = np.zeros(len(found), np.int64)
    n[entry] = table.column("n").to_numpy()
    a, b = near_pairs(found, entry, *known)
    lengths = np.array([len(word) for word in found])
    longer = lengths[a] < lengths[b]
    of, near = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
    # The most frequent first; of words that occur as often, the first in code-point order.
    by_word = np.empty(len(found), np.int64)
    by_word[sorted(range(len(found)), key=found.__getitem__)] = np.arange(len(found))
    ranked = np.lexsort((by_word, -n))
    place = np.empty(len(found), np.int64)
    place[ranked] = np.arange(len(found))
    order = np.lexsort((place[near], of))
    of, near = of[order], near[order]
    owners, first, many = np.unique(of, return_index=True, return_counts=True)
    best = near[first]
    words_ = encoded.dictionary
    return pa.table({"word": words_.take(pa.array(owners)), "n_near": pa.array(many.astype(np.int64)), "near": words_.take(pa.array(best)), "near_n": pa.array(n[best])}).cast(
        pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    )


def near_words(vocabulary: DataFrame, crowd: int = CROWD, cell: int = CELL) -> DataFrame:
    """``word, n_near, near, near_n`` of every word that has near words: their number and the most frequent one.

    ``vocabulary (word, n)`` holds each word once. Ties go to the smallest word in code-point order.
    """
    rows = crowds(vocabulary, crowd)
    cells = max(1, -(-rows.count() // cell))
    dealt = rows.select("word", "n", *_KNOWN, F.pmod("key", F.lit(cells)).alias("cell"))
    found = dealt.groupBy("cell").applyInArrow(_cell, "word string, n_near bigint, near string, near_n bigint")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every row of ``forms (word, form)``: where following forms ends.

    A form occurs ``FACTOR`` times as often as its variant, so paths are short; every round halves them.
    """
    reached = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = written(reached.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if reached.filter("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.select("word", "root")


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, factor: int = FACTOR, crowd: int = CROWD, cell: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts.

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form`` is the most
    frequent of them (ties: the smallest in code-point order) if it occurs at least ``factor`` times as
    often as the word, else null; ``root`` is where following forms ends, the word itself without a
    form. Null texts and texts without long words have none; an empty table gives no rows.
    """
    vocabulary = written(words(docs, least_count))
    near = near_words(vocabulary, crowd, cell)
    holds = F.col("near_n") >= factor * F.col("n")
    judged = written(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("near")).alias("form"), F.when(holds, F.col("near_n")).alias("form_n")))
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
