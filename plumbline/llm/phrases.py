"""Phrase collocations from depth-truncated suffix subtrees, built by vertical partitioning.

Every place of the texts begins a suffix, of which the first ``DEPTH`` words count. The suffixes are
dealt out by a prefix. Where more suffixes begin with a prefix than a share of the memory budget, they
are dealt out by one word more, and so on; a prefix that is small enough takes all of its suffixes to
one group, and groups hold as many prefixes as the budget admits. Each group builds its subtrees on its
own: leaves in lexicographic order, equal ones merged. A node is a run of leaves, and the count of its
phrase is the sum of their totals.

The subtrees grow in ranges of their depth (``RANGES``): a range reads on only where the nodes above it
occur often enough. Texts are read once, into blocks of word numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, beside, column, slices, written
from plumbline.llm.tallies import expand, squeeze

#: Phrases have at most this many words, and occur at least so often.
DEPTH, LEAST = 5, 100
#: Phrases that are returned of a language.
TOP = 2000
#: Text in a block, and suffixes in a group: the memory budget.
BLOCK_BYTES, BUDGET = 16 << 20, 2_000_000
#: A prefix with more suffixes than this part of the budget is dealt out by one more word.
SHARE = 8
#: First and last depth of the ranges in which subtrees grow.
RANGES = ((1, 1), (2, 2), (3, DEPTH))
#: Bits of the filters that say which words and pairs of words may be frequent. A filter never denies a
#: frequent one; where very many are frequent it admits rare ones, whose phrases then fall below the least
#: frequency.
FILTER_BITS = 1 << 25

_MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


class _Numbers(dict):
    """Numbers of words in the order they come; the mark that ends a piece has number 0."""

    def __init__(self, numbers: Iterator[int]):
        super().__init__({b".": 0})
        self.numbers = numbers

    def __missing__(self, word: bytes) -> int:
        self[word] = number = next(self.numbers)
        return number


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _written_block(langs: list[str], words: list[bytes], of: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    """A row of a table of blocks. Words have numbers from 1 on; ``of`` is the place of their language."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array([langs], pa.list_(pa.string())),
            pa.array([len(words)], pa.int64()),
            *(pa.array([each], pa.binary()) for each in (_packed(b"\n".join(words)), squeeze(of.astype(np.int32)), squeeze(tokens.astype(np.int32)))),
        ],
        ["langs", "n_words", "words", "of", "tokens"],
    )


_BLOCK = "langs array<string>, n_words bigint, words binary, of binary, tokens binary"


class _Block:
    def __init__(self, row: dict):
        self.langs = row["langs"]
        self.words = _unpacked(row["words"]).split(b"\n") if row["n_words"] else []
        self.of, self.tokens = expand(row["of"], np.int32), expand(row["tokens"], np.int32)

    @cached_property
    def keys(self) -> np.ndarray:
        """The keys of the words, after a zero for none."""
        seeds, digest = [_lang_key(lang) for lang in self.langs], xxhash.xxh64_intdigest
        return np.array([0, *(digest(word, seeds[of]) for word, of in zip(self.words, self.of.tolist(), strict=True))], np.uint64)


def _each_block(blocks: DataFrame, run, schema: str) -> DataFrame:
    """``run`` of every block; it yields record batches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield from run(_Block(batch.slice(at, 1).to_pylist()[0]))

    return blocks.mapInArrow(rows, schema)


def _read(docs: DataFrame) -> DataFrame:
    """The texts as a table of blocks: words by number, with a 0 after every piece."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        numbers, places, tokens = count(1), {}, []
        for part in held:
            for lang, text in zip(column(part, "lang").to_pylist(), as_bytes(part), strict=True):
                own = places.get(lang)
                if own is None:
                    own = places[lang] = _Numbers(numbers)
                words = text.lower().translate(_MARKS).replace(b".", b" . ").split()
                tokens.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
                tokens.append(np.zeros(1, np.int32))
        langs = list(places)
        total = next(numbers) - 1
        words, of = [b""] * total, np.zeros(total, np.int32)
        for at, lang in enumerate(langs):
            for word, number in places[lang].items():
                if number:
                    words[number - 1], of[number - 1] = word, at
        return _written_block(langs, words, of, np.concatenate(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, limit=BLOCK_BYTES):
                if not part.num_rows:
                    continue
                more = pa.compute.sum(pa.compute.binary_length(column(part, "text"))).as_py()
                if held and size + more > BLOCK_BYTES:
                    yield block(held)
                    held, size = [], 0
                held.append(part)
                size += more
        if held:
            yield block(held)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, _BLOCK))


# Keys and filters -------------------------------------------------------------------------------


def _lang_key(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 42)


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of phrases with one more word. Phrases that share a key are only dealt out together."""
    mixed = (key ^ (word >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    return mixed ^ (mixed >> np.uint64(29))


def _phrase_keys(langs: list[str], phrases: list[str]) -> np.ndarray:
    """Keys of phrases that all have as many words."""
    words = [phrase.encode().split(b" ") for phrase in phrases]
    columns = [np.array([xxhash.xxh64_intdigest(word, _lang_key(lang)) for lang, word in zip(langs, each)], np.uint64) for each in zip(*words)]
    return reduce(_longer, columns) if columns else np.zeros(0, np.uint64)


def _keyed(phrases: DataFrame) -> DataFrame:
    """``key, n`` of phrases that all have as many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _phrase_keys(column(batch, "lang").to_pylist(), column(batch, "phrase").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), column(batch, "f")], ["key", "n"])

    return phrases.select("lang", "phrase", "f").mapInArrow(run, "key bigint, n bigint")


def _filter(keyed: DataFrame) -> np.ndarray:
    """Bits at the keys, lowest first, 64 to a number: at most ``FILTER_BITS / 64`` rows come to the driver."""
    bit = keyed.select(F.pmod("key", F.lit(FILTER_BITS)).alias("bit"))
    rows = bit.groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return bits.view(np.uint64)


def _admitted(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & np.uint64(FILTER_BITS - 1)
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def _lean(blocks: DataFrame, bits: np.ndarray) -> DataFrame:
    """The blocks with words that may be frequent only; any other ends a piece."""

    def run(block: _Block) -> Iterator[pa.RecordBatch]:
        kept = np.flatnonzero(_admitted(bits, block.keys[1:]))
        number = np.zeros(len(block.words) + 1, np.int32)
        number[kept + 1] = np.arange(1, len(kept) + 1)
        tokens = number[block.tokens]
        ended = tokens == 0
        tokens = tokens[~(ended & np.concatenate([[False], ended[:-1]]))]
        yield _written_block(block.langs, [block.words[i] for i in kept.tolist()], block.of[kept], tokens)

    return written(_each_block(blocks, run, _BLOCK))


# Vertical partitioning --------------------------------------------------------------------------


def _suffixes(block: _Block, low: int, high: int, pairs: np.ndarray | None) -> list[np.ndarray]:
    """The first ``high`` words of every suffix of ``low`` words or more, a column for each place; 0 where it has ended.

    ``pairs`` is the filter of the pairs of words that a suffix may go on with.
    """
    tokens = block.tokens
    following = np.append(tokens[1:], np.int32(0))
    if pairs is not None:
        both = np.flatnonzero((tokens > 0) & (following > 0))
        good = _admitted(pairs, _longer(block.keys[tokens[both]], block.keys[following[both]]))
        following = np.zeros(len(tokens), np.int32)
        following[both[good]] = tokens[both[good] + 1]
    columns, going = [tokens], tokens > 0
    for place in range(1, high):
        shifted = np.zeros(len(tokens), np.int32)
        shifted[: len(tokens) - place + 1] = following[place - 1 :]
        shifted[~going] = 0
        columns.append(shifted)
        going = shifted > 0
    begins = np.flatnonzero(columns[low - 1] > 0)
    return [each[begins] for each in columns]


def _routes(block: _Block, columns: list[np.ndarray], first: int, heavy: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every suffix: the key of the prefix that it is dealt by, how many words of it are a heavy prefix, and which of them all known levels call heavy.

    ``heavy`` lists the keys of heavy prefixes of ``first`` words and more.
    """
    keys = block.keys
    route, depth = keys[columns[0]], np.zeros(len(columns[0]), np.uint8)
    for level in range(1, first):
        route = _longer(route, keys[columns[level]])
    going = np.arange(len(route))
    for level, names in enumerate(heavy, first):
        at = np.searchsorted(names, route[going])
        going = going[names[np.minimum(at, len(names) - 1)] == route[going]] if len(names) else going[:0]
        depth[going] = level
        if level == len(columns):
            break
        going = going[columns[level][going] > 0]
        route[going] = _longer(route[going], keys[columns[level][going]])
    return route, depth, going


def _vertical(lean: DataFrame, known: DataFrame, first: int, high: int, pairs: np.ndarray | None, budget: int) -> tuple[list[np.ndarray], int]:
    """The keys of heavy prefixes by their number of words, from ``first`` on, and the number of groups.

    ``known (key, n)`` has the prefixes of ``first`` words. Of one length there are at most ``SHARE``
    heavy prefixes for every ``budget`` suffixes. Groups are made more until the heaviest of them, by
    exact counts of its prefixes, keeps to the budget. A prefix of ``high`` words is a whole leaf, which
    is merged in every block and so weighs no more than there are blocks.
    """
    share = max(1, budget // SHARE)
    weights, heavy, light = written(known), [], []
    total = weights.agg(F.sum("n")).first()[0] or 0

    def keys(rows: DataFrame) -> np.ndarray:
        return np.sort(rows.filter(F.col("n") > share).select("key").toArrow().column("key").to_numpy().view(np.uint64))

    while True:
        heavy.append(keys(weights))
        light.append(weights.filter(F.col("n") <= share))
        if not len(heavy[-1]) or first + len(heavy) == high:
            break

        def run(block: _Block) -> Iterator[pa.RecordBatch]:
            route, _, going = _routes(block, _suffixes(block, first + 1, high, pairs), first, heavy)
            found, n = np.unique(route[going], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

        weights = written(_each_block(lean, run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    loads = reduce(DataFrame.unionByName, light)
    groups = max(1, -(-2 * total // budget))
    while (loads.groupBy(F.pmod("key", F.lit(groups))).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > budget:
        groups *= 2
    return heavy, groups


# Subtrees ---------------------------------------------------------------------------------------


def _leaves(columns: list[np.ndarray], totals: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct suffixes in lexicographic order, their totals, and a row that each of them comes from.

    The columns hold numbers up to ``size``.
    """
    bits = max(1, int(size).bit_length())
    each = 63 // bits
    packed = []
    for first in range(0, len(columns), each):
        key = np.zeros(len(columns[0]), np.int64)
        for one in columns[first : first + each]:
            key = key << bits | one
        packed.append(key)
    order = np.argsort(packed[0]) if len(packed) == 1 else np.lexsort(packed[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in packed:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return [one[order[first]] for one in columns], np.add.reduceat(totals[order], first) if len(first) else totals, order[first]


_PIECE = "grp bigint, lang string, n_words bigint, words binary, columns binary, totals binary, depths binary"


def _piece(block: _Block, lang: str, group: int, parts: list[np.ndarray], totals: np.ndarray, depth: np.ndarray) -> tuple:
    """The leaves of one block for a group and a language, with the words they are made of."""
    used = np.unique(np.concatenate(parts))
    used = used[used > 0]
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    parts = [np.where(each > 0, np.searchsorted(used, each) + 1, 0).astype(kind) for each in parts]
    words = _packed(b"\n".join([block.words[i - 1] for i in used.tolist()]))
    return group, lang, len(used), words, squeeze(np.concatenate(parts)), squeeze(totals.astype(np.uint32)), squeeze(depth)


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(each, kind) for each, kind in zip(zip(*rows), kinds)], [part.split()[0] for part in _PIECE.split(", ")])


def _pieces(blocks: DataFrame, low: int, high: int, pairs: np.ndarray | None, heavy: list[np.ndarray], groups: int) -> DataFrame:
    """The suffixes of every block, group by group and language by language, equal ones merged."""
    first = max(1, low - 1)

    def run(block: _Block) -> Iterator[pa.RecordBatch]:
        columns = _suffixes(block, low, high, pairs)
        if not len(columns[0]):
            return
        columns, totals, rows = _leaves(columns, np.ones(len(columns[0]), np.int64), len(block.words))
        route, depth, _ = _routes(block, columns, first, heavy)
        lot = block.of[columns[0] - 1].astype(np.int64) * groups + route.view(np.int64) % np.int64(groups)
        lot = lot.astype(np.uint16) if len(block.langs) * groups <= 1 << 16 else lot
        order = np.argsort(lot, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(lot[order].astype(np.int64)) > 0]))
        out = []
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(order)]):
            some = order[begin:end]
            lang, group = divmod(int(lot[some[0]]), groups)
            out.append(_piece(block, block.langs[lang], group, [each[some] for each in columns], totals[some], depth[some]))
            if sum(len(each[4]) for each in out) > 4 << 20:
                yield _piece_rows(out)
                out = []
        if out:
            yield _piece_rows(out)

    return _each_block(blocks, run, _PIECE)


def _subtrees(table: pa.Table, low: int, high: int, least: int) -> pa.Table:
    """``lang, phrase, f`` of the nodes of a group's subtrees, from depth ``low`` on.

    A node below a heavy prefix is whole here. One that is a heavy prefix itself has its leaves in
    several groups, so its part of the count comes out whatever it is. At depth one, a row without
    phrase has the sum of all leaves.
    """
    out: list[tuple[str, str | None, int]] = []
    langs = table.column("lang").to_pylist()
    for lang in sorted(set(langs)):
        numbers: dict[bytes, int] = {}
        columns, totals, depths = [[] for _ in range(high)], [], []
        for at in (i for i, each in enumerate(langs) if each == lang):
            row = table.slice(at, 1).to_pylist()[0]
            words = _unpacked(row["words"]).split(b"\n")
            place = np.fromiter((numbers.setdefault(word, len(numbers) + 1) for word in words), np.int32, len(words))
            place = np.concatenate([np.zeros(1, np.int32), place])
            for into, each in zip(columns, np.split(expand(row["columns"], np.uint16 if row["n_words"] < 1 << 16 else np.uint32), high)):
                into.append(place[each])
            totals.append(expand(row["totals"], np.uint32).astype(np.int64))
            depths.append(expand(row["depths"], np.uint8))
        leaves, total, of = _leaves([np.concatenate(each) for each in columns], np.concatenate(totals), len(numbers))
        depth = np.concatenate(depths)[of]
        words = list(numbers)
        if low == 1:
            out.append((lang, None, int(total.sum())))
        new = np.zeros(len(total), bool)
        new[:1] = True
        for level, each in enumerate(leaves, 1):
            new[1:] |= each[1:] != each[:-1]
            if level < low:
                continue
            first = np.flatnonzero(new)
            node = np.add.reduceat(total, first)
            wanted = (each[first] > 0) & ((node >= least) | (depth[first] >= level))
            for row, f in zip(first[wanted].tolist(), node[wanted].tolist()):
                out.append((lang, b" ".join([words[leaves[i][row] - 1] for i in range(level)]).decode(), f))
    names = ["lang", "phrase", "f"]
    kinds = [pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)], names)


def _grown(blocks: DataFrame, low: int, high: int, pairs: np.ndarray | None, heavy: list[np.ndarray], groups: int, least: int) -> DataFrame:
    """``lang, phrase, f`` of all phrases of ``low`` to ``high`` words that occur often enough."""
    pieces = _pieces(blocks, low, high, pairs, heavy, groups)
    nodes = pieces.groupBy("grp").applyInArrow(lambda table: _subtrees(table, low, high, least), "lang string, phrase string, f bigint")
    return written(nodes.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | F.col("phrase").isNull()))


def frequent_phrases(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of all phrases of one to ``DEPTH`` words with ``least`` occurrences or more, and ``lang, n``, the number of all words.

    Phrases lie within pieces of text between marks and line ends; overlapping occurrences count. A
    null text has no words, a null language is ``und``. Rows that repeat count again.
    """
    blocks = _read(docs)
    entries = blocks.agg(F.sum("n_words")).first()[0] or 0
    found = [_grown(blocks, 1, 1, None, [], max(1, -(-2 * entries // budget)), least)]
    totals = found[0].filter("phrase is null").select("lang", F.col("f").alias("n"))
    pairs = None
    for low, high in RANGES[1:]:
        # What is known of the range above: its longest phrases, by key.
        known = written(_keyed(found[-1].filter("phrase is not null")))
        if low == 2:
            blocks = _lean(blocks, _filter(known))
        else:
            pairs = _filter(known)
        heavy, groups = _vertical(blocks, known, low - 1, high, pairs, budget)
        found.append(_grown(blocks, low, high, pairs, heavy, groups, least))
    return reduce(DataFrame.unionByName, found).filter("phrase is not null"), totals


# Collocations -----------------------------------------------------------------------------------


def _part(first: str, n: str) -> Column:
    return F.array_join(F.slice("words", F.expr(first), F.expr(n)), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the strongest phrases of each language.

    ``a`` counts a phrase of two words or more, ``l`` and ``r`` its first words and the rest of them,
    where it is cut so that ``score = floor(1000 a n / (l r))`` is lowest (ties: after fewest words),
    ``n`` all words of the language. Phrases that stand in a longer one as often as anywhere are left
    out. Ranks go by score, then ``a``, both falling, then by the phrase in byte order, so there are no
    ties. Languages without phrases have no rows.
    """
    phrases, totals = frequent_phrases(docs, least, budget)
    found = phrases.withColumn("words", F.split("phrase", " "))
    found = found.withColumn("size", F.size("words")).filter("size > 1")
    # A longer phrase that covers one covers those in between as well, so one word more is enough.
    within = found.filter("size > 2").select("lang", F.explode(F.array(_part("1", "size - 1"), _part("2", "size - 1"))).alias("phrase"), "f")
    covered = within.groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    kept = found.join(covered, ["lang", "phrase"], "left").filter("cover is null or cover < f")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("1", "k").alias("begin"), _part("k + 1", "size - k").alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("begin"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "begin"]).join(right, ["lang", "rest"]).join(beside(written(totals)), "lang")
    exact = "cast({} as decimal(20, 0))".format
    score = F.expr(f"({exact('a')} * 1000 * {exact('n')}) div ({exact('l')} * {exact('r')})")
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    rows = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    strongest = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of every lot first, so that no task ranks all phrases of a large language.
    lots = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*strongest)
    best = rows.withColumn("place", F.row_number().over(lots)).filter(F.col("place") <= top).drop("place")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*strongest)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
