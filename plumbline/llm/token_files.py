"""Token ids of documents in files coded by a range asymmetric numeral system.

The file format is a folder with three Parquet tables:

``blocks``
    One row a block: its documents (``ids``, ``missing`` for null ids, ``lengths``), and their token
    ids as ``words``, a stream of 32-bit words that ``LANES`` coders share in turn. Every ``EVERY``
    steps a checkpoint holds all coder states (``states``), the place in the stream (``places``) and
    the checksum of the ids up to the next checkpoint (``checks``). A block depends on no other block
    and a checkpoint on no earlier one, so any number of them can be decoded side by side.
``table``
    The frequency of every token id, out of ``2 ** BITS``: one static table, shared by all blocks.
``parts``
    Where each part begins: ``part``, ``start`` (ids in all parts before it) and ``n_ids``. It is
    written last, so a folder that has it is whole.

Parts are ranges of the document order, blocks are numbered within their part.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ROW_KEY, as_bytes, column, slices, with_row_key, written
from plumbline.llm.tallies import expand, squeeze

#: The frequencies of the shared table add up to two to this power.
BITS = 20
#: Coders that take turns within a block, and the steps from one checkpoint to the next.
LANES, EVERY = 2048, 128
#: A block ends with the document that fills it.
BLOCK_IDS = 1 << 20
#: Coder states stay at or above this; below it the decoder takes another word.
_LOW = np.uint64(1 << 31)
#: Distinct pieces of text whose ids a Python worker remembers, from one task to the next.
REMEMBERED = 1_600_000
#: Words that go to the tokenizer in one call.
_TOGETHER = 1000

#: A piece that begins with letters (ASCII, and the accented ones of Latin-1 in UTF-8), cut where the first
#: other ASCII character stands, since no token spans that place; or any other piece. One a line.
_PARTS = re.compile(rb"^((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)((?:[\x00-\x09\x0b-\x40\x5b-\x60\x7b-\x7f].*)?)$|^(.+)$", re.MULTILINE)
#: Fixed value: how a token ends that closes a run.
_CLOSED = "</w>"


class Encoder:
    """Ids of whole texts (UTF-8), asking the tokenizer for each distinct piece between white space once.

    It serves tokenizers that read lower case, drop white space and end a token where letters end;
    :func:`cuts_at_white_space` says which these are.
    """

    def __init__(self, file: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = id_kind(max(vocabulary.values(), default=0) + 1)
        self.closing = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closing[[number for token, number in vocabulary.items() if token.endswith(_CLOSED)]] = True
        # Words in lower case, apart by blanks, need no normalising and no pattern.
        self.of_words = Tokenizer.from_file(file)
        self.of_words.normalizer = None
        self.of_words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [token.content.lower().encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.opening = os.path.commonprefix(self.special) or b""
        self.remembered = remembered
        self.ids: dict[bytes, bytes] = {}

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        known = self.ids
        if len(known) > self.remembered:
            known.clear()
        # Every piece is looked up once; most texts have some that are new.
        out, later = [b""] * len(texts), []
        for place, text in enumerate(texts):
            pieces = self._lowered(text).split()
            ids = list(map(known.get, pieces))
            try:
                out[place] = b"".join(ids)
            except TypeError:
                later.append((place, pieces, ids))
        self._learn(list({piece for _, pieces, ids in later for piece, found in zip(pieces, ids) if found is None}))
        for place, pieces, ids in later:
            out[place] = b"".join([known[piece] if found is None else found for piece, found in zip(pieces, ids)])
        return out

    def _lowered(self, text: bytes) -> bytes:
        """The text with ASCII letters in lower case, unless that makes a special token of anything."""
        low = text.lower()
        return text if self.opening in low and any(each in low for each in self.special) else low

    def _learn(self, pieces: list[bytes]) -> None:
        known = self.ids
        known[b""] = b""
        plain = {piece for piece in pieces if piece.isalpha() and piece.islower()}
        pieces = [piece for piece in pieces if piece not in plain]
        parts = _PARTS.findall(b"\n".join(pieces))
        words = b"\n".join([word for word, _, _ in parts]).decode().lower().encode().split(b"\n")
        self._learn_words([*plain, *(word for word in set(words).difference(plain) if word not in known)])
        others = {b"": b""}
        asked = list({part for _, rest, other in parts for part in (rest, other) if part})
        others.update(zip(asked, map(self._held, self._asked([piece.decode() for piece in asked]))))
        known.update(zip(pieces, [known[word] + others[rest or other] for word, (_, rest, other) in zip(words, parts)]))

    def _held(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _learn_words(self, asked: list[bytes]) -> None:
        """Words in lower case, many in a text: each of them ends with a token that closes a run."""
        lots = [asked[at : at + _TOGETHER] for at in range(0, len(asked), _TOGETHER)]
        for some, found in zip(lots, self.of_words.encode_batch_fast([b" ".join(some).decode() for some in lots], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.kind)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(some):
                data, size = ids.tobytes(), ids.itemsize
                ends = [0, *(ends * size).tolist()]
                self.ids.update(zip(some, map(data.__getitem__, map(slice, ends, ends[1:]))))
            else:
                self.ids.update(zip(some, map(self._held, self._asked([word.decode() for word in some]))))

    def _asked(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PlainEncoder(Encoder):
    """Ids of whole texts from any tokenizer."""

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        return list(map(self._held, self._asked([text.decode() for text in texts])))


def encoder(file: str) -> Encoder:
    """The encoder of this Python worker, which keeps what it has learned for its next tasks."""
    kept = sys.modules.setdefault("plumbline_kept_by_worker", types.ModuleType("plumbline_kept_by_worker")).__dict__
    if kept.get("file") != file:
        kept["encoder"] = (Encoder if cuts_at_white_space(file) else PlainEncoder)(file)
        kept["file"] = file
    return kept["encoder"]


def id_kind(size: int) -> str:
    """How ids below ``size`` are held: two bytes where they fit."""
    return "<u2" if size <= 1 << 16 else "<u4"


#: The normaliser and the split pattern of tokenizers that :class:`Encoder` serves.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_white_space(file: str) -> bool:
    """Whether the tokenizer in ``file`` treats the pieces of a text as it treats the whole text."""
    import json

    with open(file, encoding="utf-8") as stream:
        spec = json.load(stream)
    normal = [each["type"] for each in (spec.get("normalizer") or {}).get("normalizers", [])]
    first, *later = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    apart = first.get("behavior") == "Removed" and first.get("invert") is True and (first.get("pattern") or {}).get("Regex") == _SPLIT
    apart &= [(each["type"], each.get("use_regex"), each.get("add_prefix_space")) for each in later] == [("ByteLevel", False, False)]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s|^[^\W_]", t["content"])) for t in spec.get("added_tokens", []))
    return normal == _NORMALIZERS and apart and plain


def token_ids(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """``doc_id``, the row key and ``ids`` of every row (as :func:`id_kind` holds them), with ``end_id`` at the end.

    ``seen`` and ``counts`` stand in one row of each batch: its distinct ids and how often they occur.
    ``tokenizer_file`` must exist on every executor, as an installed package does.
    """
    rows = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        end = np.array([end_id], encode.kind).tobytes()
        for batch in batches:
            for part in slices(batch):
                ids = [each + end for each in encode(as_bytes(part))]
                n = np.bincount(np.frombuffer(b"".join(ids), encode.kind))
                seen = np.flatnonzero(n)
                rest = [None] * (len(ids) - 1)
                told = [pa.array([squeeze(each), *rest], pa.binary()) for each in (seen.astype(np.uint32), n[seen])]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *(column(part, name) for name in ROW_KEY), pa.array(ids, pa.binary()), *told], ["doc_id", *ROW_KEY, "ids", "seen", "counts"])

    return rows.mapInArrow(run, f"doc_id bigint, {ROW_KEY[0]} bigint, {ROW_KEY[1]} bigint, ids binary, seen binary, counts binary")


def _counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs; as many numbers as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for seen, counts in zip(*(column(batch, name).to_pylist() for name in ("seen", "counts"))):
                total.update(dict(zip(expand(seen, np.uint32).tolist(), expand(counts, np.int64).tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "n"])

    told = encoded.select("seen", "counts").filter("seen is not null")
    rows = told.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((row["id"] for row in rows), default=-1) + 1, np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to add up to ``2 ** bits``, at least one for every id that occurs.

    What rounding leaves over goes to the most frequent ids, and what is short is taken from them.
    """
    whole, total = 1 << bits, int(counts.sum())
    if not total:
        return np.zeros(0, np.uint32)
    if np.count_nonzero(counts) > whole // 2:
        raise ValueError(f"a table of {bits} bits has too few places for these ids")
    scaled = np.array([int(n) * whole // total for n in counts], np.int64)
    scaled[(counts > 0) & (scaled == 0)] = 1
    order = np.argsort(-scaled, kind="stable")
    over = whole - int(scaled.sum())
    if over > 0:
        scaled[order[0]] += over
    for at in order:
        if over >= 0:
            break
        taken = min(-over, int(scaled[at]) // 2)
        scaled[at] -= taken
        over += taken
    return scaled.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks by a table of frequencies."""

    def __init__(self, table: np.ndarray, bits: int = BITS):
        self.bits = np.uint64(bits)
        self.frequency = table.astype(np.uint64)
        self.begin = np.cumsum(self.frequency) - self.frequency
        self.filler = int(np.argmax(table)) if len(table) else 0
        self._frequency, self._begin = self.frequency.astype(np.int64), self.begin.astype(np.int64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        """The id that each number below ``2 ** bits`` stands for."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.frequency)), self._frequency)
        return self._symbol

    def encode(self, ids: np.ndarray) -> dict[str, bytes]:
        """``words``, ``states``, ``places`` and ``checks`` of the ids."""
        steps = -(-len(ids) // LANES)
        grid = np.full(steps * LANES, self.filler, np.uint32)
        grid[: len(ids)] = ids
        grid = grid.reshape(steps, LANES)
        frequency, begin = self.frequency[grid], self.begin[grid]
        limit = frequency << (np.uint64(63) - self.bits)
        words, out = np.empty((steps, LANES), np.uint32), np.empty((steps, LANES), bool)
        state = np.full(LANES, _LOW)
        states = np.empty((-(-steps // EVERY), LANES), np.uint64)
        shift = np.uint64(32)
        for step in range(steps - 1, -1, -1):
            full = np.greater_equal(state, limit[step], out=out[step])
            words[step] = state
            state = np.where(full, state >> shift, state)
            quotient, rest = np.divmod(state, frequency[step])
            state = (quotient << self.bits) + rest + begin[step]
            if step % EVERY == 0:
                states[step // EVERY] = state
        places = (np.cumsum(out.sum(axis=1)) - out.sum(axis=1))[::EVERY]
        parts = [ids[at : at + EVERY * LANES] for at in range(0, len(ids), EVERY * LANES)]
        return {
            "words": words[out].astype("<u4").tobytes(),
            "states": states.astype("<u8").tobytes(),
            "places": places.astype("<u4").tobytes(),
            "checks": np.array([checksum(part) for part in parts], "<u4").tobytes(),
        }

    def decode(self, block: dict, n_ids: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from checkpoint ``first`` up to checkpoint ``last`` (default: the end), checked."""
        # States stay below 2 ** 63, so signed numbers hold them and serve as places without a copy.
        words = np.frombuffer(block["words"], "<u4").astype(np.int64)
        states = np.frombuffer(block["states"], "<u8").astype(np.int64).reshape(-1, LANES)[first:last].copy()
        place = np.frombuffer(block["places"], "<u4")[first:last].astype(np.int64) - 1
        checks = np.frombuffer(block["checks"], "<u4")[first:last]
        steps = -(-n_ids // LANES) - first * EVERY
        out = np.empty((len(states), EVERY, LANES), np.uint32)
        bits = int(self.bits)
        mask = (1 << bits) - 1
        for step in range(EVERY):
            # Only the last checkpoint of the block may have fewer steps than the others.
            live = len(states) if steps - (len(states) - 1) * EVERY > step else len(states) - 1
            if not live:
                break
            state = states[:live]
            slot = state & mask
            symbol = self.symbol.take(slot)
            out[:live, step] = symbol
            state >>= bits
            state *= self._frequency.take(symbol)
            state += slot
            state -= self._begin.take(symbol)
            short = state < int(_LOW)
            counted = np.cumsum(short, axis=1)
            at = (counted + place[:live, None])[short]
            state[short] = state[short] << 32 | words.take(at)
            place[:live] += counted[:, -1]
        ids = out.reshape(-1)[: max(0, min(n_ids - first * EVERY * LANES, out.size))]
        for number, check in enumerate(checks.tolist()):
            if checksum(ids[number * EVERY * LANES : (number + 1) * EVERY * LANES]) != check:
                raise ValueError(f"the ids after checkpoint {first + number} of a block are damaged")
        return ids


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


#: How the ids are compressed until they are coded.
_FAST = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}

_BLOCK = "part bigint, block bigint, start bigint, n_docs bigint, n_ids bigint, ids binary, missing binary, lengths binary, words binary, states binary, places binary, checks binary"


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> None:
    """Encode every row of ``docs`` and write the files to the folder ``path``.

    Documents stand in ascending order of ``doc_id``, null ids first; rows with the same id stand in
    the order of the files they come from. Null and empty texts have only the end id. Other columns
    than ``doc_id`` and ``text`` are not read. Of an empty table there are no blocks.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer_file).get_vocab().values()
    if not 0 <= end_id <= max(vocabulary):
        raise ValueError(f"{end_id} is not an id of the tokenizer")
    kind = id_kind(max(vocabulary) + 1)
    encoded = written(token_ids(docs, tokenizer_file, end_id), **_FAST)
    table = frequencies(_counts(encoded))
    names = [part.split()[0] for part in _BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(table), TaskContext.get().partitionId()
        number = start = held = 0
        docs_ids, parts = [], []

        def packed() -> pa.RecordBatch:
            nonlocal number, start, held, docs_ids, parts
            ids = np.frombuffer(b"".join(parts), kind)
            block = {
                "part": part, "block": number, "start": start, "n_docs": len(parts), "n_ids": len(ids),
                "ids": squeeze(np.array([i or 0 for i in docs_ids], np.int64)),
                "missing": squeeze(np.array([i is None for i in docs_ids], np.uint8)),
                "lengths": squeeze(np.array([len(each) for each in parts], np.int64) // np.dtype(kind).itemsize),
                **coder.encode(ids.astype(np.uint32)),
            }
            number, start, held, docs_ids, parts = number + 1, start + len(ids), 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([block[n]], pa.int64() if isinstance(block[n], int) else pa.binary()) for n in names], names)

        for batch in batches:
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                docs_ids.append(doc_id)
                parts.append(ids)
                held += len(ids) // np.dtype(kind).itemsize
                if held >= BLOCK_IDS:
                    yield packed()
        if parts:
            yield packed()

    # Ids are dealt in ranges; a range of equal ids is cut by the row key.
    order = ["doc_id", *ROW_KEY]
    ordered = encoded.select(*order, "ids").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, _BLOCK).write.parquet(f"{path}/blocks", compression="uncompressed")
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(table) if n], "id bigint, frequency bigint").write.parquet(f"{path}/table")
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).sort("part").collect()
    starts = np.cumsum([0, *(row["n"] for row in sums)])
    spark.createDataFrame([(row["part"], int(start), row["n"]) for row, start in zip(sums, starts)], "part bigint, start bigint, n_ids bigint").write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned 32-bit
    integers. A block whose checksums do not fit raises an error.
    """
    rows = spark.read.parquet(f"{path}/table").collect()  # no more rows than the vocabulary has ids
    table = np.zeros(max((row["id"] for row in rows), default=-1) + 1, np.uint32)
    for row in rows:
        table[row["id"]] = row["frequency"]
    # One row a part, that is a task that wrote: few enough to broadcast.
    parts = F.broadcast(spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("part_start")))
    blocks = spark.read.parquet(f"{path}/blocks").join(parts, "part").withColumn("start", F.col("part_start") + F.col("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = coder.decode(row, row["n_ids"]).astype("<u4")
                lengths = expand(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                # Documents follow each other in the block: one buffer holds the ids of all of them.
                places = np.concatenate([[0], ends * 4]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(expand(row["ids"], np.int64), mask=expand(row["missing"], np.uint8).astype(bool)),
                        pa.array(row["start"] + ends - lengths),
                        pa.array(lengths),
                        pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(places), pa.py_buffer(ids)]),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    fields = ["start", "n_ids", "ids", "missing", "lengths", "words", "states", "places", "checks"]
    return blocks.select(*fields).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
