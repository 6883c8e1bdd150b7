"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

1. Every text is tokenised once. A document of more than one window gives whole windows and a rest.
2. Whole windows are sequences of their own. Rests go by a hash of their row's number into blocks of
   about ``BLOCK`` items or ``BLOCK_WINDOWS`` windows, whichever is more, so short texts waste no more.
3. In a block of T tokens, differencing starts with k = ceil(T / window) windows (more if more items exceed half a window): each item is a
   partial partition; the two of the largest spread are merged, largest bins onto smallest, until
   one is left. While its fullest window exceeds the capacity, k rises and the block is redone.

Only lengths and checksums leave the tokenising pass, so the shuffle carries some 40 bytes an item.

Edge cases. Null or empty text: one piece that holds just the end id. Null doc_id: kept as null.
Repeated rows, a mass of them too: packed each for itself, spread like others. Equal lengths: by
checksum and id; equal spreads: the partial partition made first. Very long text: cut at whole
windows. Empty table: no rows. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import os
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, map_arrow, remembered

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Items and windows differenced together at least; items a task takes, if that makes a block's windows.
BLOCK, BLOCK_WINDOWS, TASK_ITEMS = 1024, 64, 16_384
#: Chunks whose ids a worker remembers, and the longest of them.
REMEMBER, LONGEST = 800_000, 40


#: Ends of words before whose last mark the tokenizer cuts.
_STOPS = frozenset(bytes((c, mark)) for c in b"abcdefghijklmnopqrstuvwxyz0123456789" for mark in b".,")


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Known(dict):
    """Ids by chunk; what isn't remembered is looked up among the step's own chunks."""

    fresh: dict[bytes, bytes]

    def __missing__(self, chunk: bytes) -> bytes:
        return self.fresh[chunk]


class ChunkEncoder:
    """Ids of whole texts as little-endian bytes, through the ids of their chunks.

    The tokenizer drops white space before it splits words and starts a new piece where letters or
    digits meet punctuation; so no token spans ASCII white space, nor the place before a full stop
    or comma that ends a word, and the ids of the chunks cut there, joined, are the text's ids.
    As it lower-cases, chunks are lower-cased (A-Z only) unless the text may hold a special token.
    Arrow splits the texts, numbers their different words and joins the ids; Python sees each
    different word of a step once. Frequent chunks are met early and remembered; the memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known()
        self.marks = {mark: _packed(self.tokenizer.encode(chr(mark), add_special_tokens=False).ids) for mark in b".,"}

    @staticmethod
    def words(texts: pa.Array) -> pa.ListArray:
        """What white space parts in each text, lower-cased; empty strings may stand at the ends."""
        texts = pc.fill_null(texts, "")
        lower = pc.ascii_lower(texts)
        special = pc.match_substring(texts, "<|")
        return pc.ascii_split_whitespace(pc.if_else(special, texts, lower) if pc.any(special).as_py() else lower)

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        known, marks = self.known, self.marks
        chunks = [w[:-1] if w[-2:] in _STOPS else w for w in words]
        unseen = list(set(chunks).difference(known))
        fresh: dict[bytes, bytes] = {}
        for i in range(0, len(unseen), 20_000):
            some = unseen[i : i + 20_000]
            found = self.tokenizer.encode_batch_fast([c.decode("utf-8") for c in some], add_special_tokens=False)
            fresh.update(zip(some, [_packed(f.ids) for f in found], strict=True))
        known.fresh = fresh
        if (room := REMEMBER - len(known)) > 0:
            known.update(islice(((c, ids) for c, ids in fresh.items() if len(c) <= LONGEST), room))
        out = [ids if c is w else ids + marks[w[-1]] for w, c, ids in zip(words, chunks, map(known.__getitem__, chunks), strict=True)]
        known.fresh = {}
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        words = self.words(texts)
        coded = words.flatten().dictionary_encode()
        ids = self.ids_of(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        # Longer than the texts: 64-bit places.
        joined = pa.array(ids, pa.large_binary()).take(coded.indices)
        if not len(joined):
            return [b""] * len(texts)
        _, places, data = joined.buffers()
        ends = np.frombuffer(places, np.int64)[joined.offset :][words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        view = memoryview(data) if data else memoryview(b"")
        return [bytes(view[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _parts(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes, at least a row each, so that a step's memory is bounded."""
    rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def pieces(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: whole windows of long documents, and each document's rest."""
    tail = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(f"packing {vocabulary}", lambda: ChunkEncoder(vocabulary))
        for batch in batches:
            for part in _parts(batch, 8_000_000):
                rows = []
                encoded = encoder.encode(part.column(1))
                for doc_id, buf in zip(part.column(0).to_pylist(), encoded, strict=True):
                    buf += tail
                    total = len(buf) // 4
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        rows.append((doc_id, start, length, zlib.crc32(buf[4 * start : 4 * (start + length)]), total))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PIECES)


def difference(lengths: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: the window of each item, and the k windows' sums."""
    if k == 1 or len(lengths) == 1:
        window = np.zeros(len(lengths), int)
        return window, np.bincount(window, lengths, k).astype(int)
    heap = []
    for i, n in enumerate(lengths):
        sums = np.zeros(k, np.int64)
        sums[0] = n
        heap.append((-n, i, sums, i))
    heapq.heapify(heap)
    made = len(lengths)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        both = a + b[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        heapq.heappush(heap, (int(both[-1] - both[0]), made, both, (left, right, order)))
        made += 1
    _, _, sums, root = heap[0]
    window = np.empty(len(lengths), int)
    stack = [(root, np.arange(k))]
    while stack:
        node, names = stack.pop()
        if isinstance(node, tuple):
            left, right, order = node
            before = np.empty(k, int)
            before[order] = names
            stack += [(left, before), (right, before[::-1])]
        else:
            window[node] = names[0]
    return window, sums


def pack_block(lengths: list[int], window: int) -> np.ndarray:
    """The window of each item; no window exceeds the capacity."""
    # No fewer than the tokens fill, nor than there are items of more than half a window: no two of these fit together.
    k = max(1, math.ceil(sum(lengths) / window), sum(2 * n > window for n in lengths))
    while True:
        found, sums = difference(lengths, k)
        if sums.max() <= window:
            return found
        k += max(1, math.ceil((sums.max() - window) * k / (2 * window)))


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces with their sequence and their place in it; see the module's head."""
    made = cut(pieces(docs, vocabulary, window, end_id).withColumn("row", F.monotonically_increasing_id()))
    whole, rest = made.filter(F.col("length") == window), made.filter(F.col("length") < window)
    size = rest.agg(F.count("*").alias("items"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    tasks = max(1, min(math.ceil(size.items / TASK_ITEMS), size.tokens // (BLOCK_WINDOWS * window)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        items = pa.Table.from_batches(held).select(names)
        items = items.sort_by([("ids_crc32", "ascending"), *((n, "ascending") for n in ("doc_id", "start", "length", "doc_tokens"))])
        base = TaskContext.get().partitionId() << 32
        tokens = pc.sum(items.column("length")).as_py()
        blocks = max(1, min(round(items.num_rows / BLOCK), tokens // (BLOCK_WINDOWS * window)))
        edges = [items.num_rows * i // blocks for i in range(blocks + 1)]
        for a, b in zip(edges, edges[1:], strict=False):
            block = items.slice(a, b - a)
            lengths = block.column("length").to_numpy()
            found = pack_block(lengths.tolist(), window)
            order = np.argsort(found, kind="stable")
            inside = lengths[order]
            ends = np.cumsum(inside)
            first = np.r_[True, np.diff(found[order]) != 0]
            offset = ends - inside
            offset -= np.repeat(offset[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
            block = block.take(pa.array(order)).append_column("sequence_id", pa.array(2 * (base + found[order]), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            base += int(found.max()) + 1
            yield from block.combine_chunks().to_batches()

    packed = map_arrow(rest.repartition(tasks, F.xxhash64("row")), run, PACKED)
    alone = whole.select(*names, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
