"""Token ids and binary output: texts are tokenised, split into pieces of a row's length at most, and packed.

Packing is best-fit decreasing: pieces from long to short, each into the fullest row that still has room.  A segment tree over
free capacities finds that room in logarithmic time: leaf c counts open rows with c free places, a node the rows below it,
and the search descends to the leftmost non-empty leaf from c on.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.common import arrow_map, id_text

ROW_LENGTH = 2048
#: Texts are packed in blocks: a block closes at so many tokens or pieces, which bounds a task's memory.
BLOCK_TOKENS = 1 << 21
BLOCK_PIECES = 1 << 14
#: Texts are encoded in slices of so many bytes (or one text), and there so many pieces at a time, which bounds memory too.
SLICE_BYTES = 1 << 22
GROUP_PIECES = 1 << 19


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Bytes that begin a character that is surely not white: no white one begins so (beyond ASCII they begin with C2, E1, E2 or E3).
_PLAIN = np.ones(256, bool)
_PLAIN[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False


def _binary(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    """Bytes of ``data`` between neighbouring offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data])


def _parts(array: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """The reverse of ``_binary``."""
    _, offsets, data = array.buffers()
    return np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64), data or pa.py_buffer(b"")


class Tokenizer:
    """Byte-level BPE from a file of ranks.

    The pattern takes a space together with what follows, if that is not white, and never joins it with what stands before.
    So texts are cut at such spaces, all at once by their bytes, and of equal pieces one is encoded.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = len(ranks)
        self.dtype = np.dtype("<u2") if self.size < 1 << 16 else np.dtype("<u4")
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(x) for x in ranks]

    def _plain(self, text: bytes) -> np.ndarray:
        return np.asarray(self.encoding.encode_ordinary(text.decode("utf-8")), self.dtype)

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of each piece in binary.  Those that begin at a cut are encoded as one text, as a call costs more than a piece."""
        at, data = _parts(pieces)
        raw = np.append(np.frombuffer(data, np.uint8), np.zeros(2, np.uint8))
        joined = (raw[at[:-1]] == 0x20) & _PLAIN[raw[at[:-1] + 1]] & (np.diff(at) > 1)
        ends, text = _parts(pieces.filter(pa.array(joined)))
        ids = self._plain(text.slice(0, ends[-1]).to_pybytes())
        ends = np.append(0, np.searchsorted(np.cumsum(self.lengths[ids]), ends[1:]) + 1)
        values = [_binary(ends * self.dtype.itemsize, pa.py_buffer(ids)), pa.array([self._plain(x).tobytes() for x in pieces.filter(pa.array(~joined)).to_pylist()], pa.large_binary())]
        place = np.empty(len(pieces), np.int64)
        place[np.argsort(~joined, kind="stable")] = np.arange(len(pieces))
        return pa.concat_arrays(values).take(pa.array(place))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text's ids and their end); a null counts as empty."""
        bounds, data = _parts(texts.fill_null("").cast(pa.large_binary()))
        base, end = int(bounds[0]), int(bounds[-1])
        if base == end:
            return np.zeros(0, self.dtype), np.zeros(len(bounds), np.int64)
        raw, bounds = np.frombuffer(data, np.uint8)[base:end], bounds - base
        cut = raw == 0x20
        spaces = np.flatnonzero(cut[:-1])
        cut[spaces[~_PLAIN[raw[spaces + 1]]]] = False
        cut[bounds[bounds > 0] - 1] = False
        cut[bounds[bounds < len(raw)]] = True
        edges = np.append(np.flatnonzero(cut), len(raw))
        ids, counts = [], [np.zeros(1, np.int64)]
        for a in range(0, len(edges) - 1, GROUP_PIECES):
            pieces = _binary(edges[a : a + GROUP_PIECES + 1] + base, data).dictionary_encode()
            offsets, found = _parts(self._pieces(pieces.dictionary).take(pieces.indices))
            offsets = offsets // self.dtype.itemsize
            ids.append(np.frombuffer(found, self.dtype)[offsets[0] : offsets[-1]])
            counts.append(np.diff(offsets))
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))[np.searchsorted(edges, bounds)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.large_string()))[0]

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes(list(map(int, ids))).decode("utf-8")


@lru_cache(maxsize=1)
def loaded(path: str) -> Tokenizer:
    """The tokenizer of a Python worker, kept from task to task."""
    return Tokenizer(path)


def encoded(doc_ids: pa.Array, texts: pa.Array, tokenizer: Tokenizer) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids of its text) of a batch."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, SLICE_BYTES + (ends[a - 1] if a else 0), "right")))
        ids, at = tokenizer.encode_all(texts.slice(a, b - a))
        for k, doc_id in enumerate(doc_ids.slice(a, b - a).to_pylist()):
            yield doc_id, ids[at[k] : at[k + 1]]
        a = b


class FreeRows:
    """Open rows by free capacity, with search for the least capacity that suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[deque[int]] = [deque() for _ in range(capacity + 1)]

    def _add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, row: int, capacity: int) -> None:
        if capacity:
            self.rows[capacity].append(row)
            self._add(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(row, its capacity): the row that is fullest with ``size`` places free, the oldest of such; None if there is none."""
        at = size + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return self.rows[capacity].popleft(), capacity


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers, by best-fit decreasing; equal sizes go in the order given.  Sizes are 1 to ``capacity``."""
    free, rows = FreeRows(capacity), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = free.take(sizes[piece])
        if found is None:
            found = len(rows), capacity
            rows.append([])
        row, left = found
        rows[row].append(piece)
        free.put(row, left - sizes[piece])
    return rows


def split(ids: np.ndarray, length: int) -> list[np.ndarray]:
    return [ids[a : a + length] for a in range(0, len(ids), length)]


def pack(docs: DataFrame, row_length: int = ROW_LENGTH, tokenizer: str | None = None, end_id: int | None = None) -> DataFrame:
    """Packed rows: doc_ids, starts, cu_seqlens, n_tokens, ids, positions.

    ``ids`` is a matrix row in binary, ``row_length`` little-endian unsigned integers (16 bits if the vocabulary allows) of
    which the first n_tokens hold, the rest being 0; ``positions`` likewise, counting from 0 again in each segment.
    cu_seqlens are cumulative segment lengths from 0.  Segment k holds tokens of document doc_ids[k] from token starts[k].
    ``end_id``: a token to append to each document; by default the file's size where it is free (50256), as documented there.

    Each task packs its rows block by block (BLOCK_TOKENS), without a shuffle; results follow the order in which the input is
    split, and a lost task is computed again from its input.  A null or empty text gives its end token alone; a repeated row
    is packed each time; a null doc_id stays null.  Longer documents give several pieces in full.  Other columns are not
    read; an empty table gives an empty result.
    """
    path = tokenizer or default_tokenizer()

    def rows(batches):
        encoder = loaded(path)
        end = np.array([encoder.size if end_id is None else end_id], encoder.dtype)
        block: list[tuple[int | None, int, np.ndarray]] = []
        tokens = 0

        def close() -> Iterator[dict]:
            bins = best_fit([len(x[2]) for x in block], row_length)
            for a in range(0, len(bins), 256):
                out = {k: [] for k in ("doc_ids", "starts", "cu_seqlens", "n_tokens", "ids", "positions")}
                for members in bins[a : a + 256]:
                    parts = [block[i] for i in members]
                    lengths = [len(p[2]) for p in parts]
                    matrix = np.zeros((2, row_length), encoder.dtype)
                    matrix[0, : sum(lengths)] = np.concatenate([p[2] for p in parts])
                    matrix[1, : sum(lengths)] = np.concatenate([np.arange(n) for n in lengths])
                    for k, v in (("doc_ids", [p[0] for p in parts]), ("starts", [p[1] for p in parts]), ("cu_seqlens", [0, *np.cumsum(lengths).tolist()]), ("n_tokens", sum(lengths)), ("ids", matrix[0].tobytes()), ("positions", matrix[1].tobytes())):
                        out[k].append(v)
                yield out

        for b in batches:
            for doc_id, ids in encoded(b.column(0), b.column(1), encoder):
                start = 0
                for piece in split(np.concatenate([ids, end]), row_length):
                    block.append((doc_id, start, piece))
                    start += len(piece)
                tokens += start
                if tokens >= BLOCK_TOKENS or len(block) >= BLOCK_PIECES:
                    yield from close()
                    block, tokens = [], 0
        if block:
            yield from close()

    return arrow_map(id_text(docs), rows, "doc_ids array<long>, starts array<long>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary")


def digest(packed: DataFrame) -> DataFrame:
    """doc_ids, starts, cu_seqlens, n_tokens and SHA-256 of both matrix rows."""
    return packed.select("doc_ids", "starts", "cu_seqlens", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def write(packed: DataFrame, path: str) -> None:
    """Parquet whose column chunks are the matrices' rows one after another, with cumulative lengths and positions beside them.

    A write that fails leaves no readable table, and a lost task is written again.
    """
    packed.write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """What ``write`` wrote."""
    return spark.read.parquet(path)


def matrices(rows: Iterable, row_length: int = ROW_LENGTH, dtype: str = "<u2") -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, positions, cumulative lengths) of packed rows that have been fetched: two matrices, and one array for each row."""
    fetched = list(rows)
    ids, positions = (np.frombuffer(b"".join(r[name] for r in fetched), dtype).reshape(len(fetched), row_length) for name in ("ids", "positions"))
    return ids, positions, [np.asarray(r["cu_seqlens"], np.int32) for r in fetched]


def documents(rows: Iterable, tokenizer: Tokenizer, row_length: int = ROW_LENGTH) -> dict:
    """Texts by doc_id, read back from packed rows: segments in the order of their starts, without end tokens.

    Of rows that repeat a doc_id one text is left.
    """
    fetched = list(rows)
    ids, _, lengths = matrices(fetched, row_length, tokenizer.dtype.str)
    segments: dict = {}
    for r, row, cu in zip(fetched, ids, lengths, strict=True):
        for doc_id, start, a, b in zip(r["doc_ids"], r["starts"], cu[:-1], cu[1:], strict=True):
            segments.setdefault(doc_id, {})[start] = row[a:b]
    return {d: tokenizer.decode([x for start in sorted(parts) for x in parts[start] if x < tokenizer.size]) for d, parts in segments.items()}
