"""Byte-level BPE encoding and decoding by a monoid tree reduction.

Encodings of byte strings form a monoid under ``join``: a long piece is cut into halves, each half is
encoded, and neighbours are joined by re-encoding a window of tokens around the seam. The window doubles
until the tokens next to it provably stay: a token sequence is the encoding of its bytes if and only if
each pair of neighbours is the encoding of its own bytes, and every pair outside the seam is one already.
Decoding is the free monoid: the tokens' bytes are concatenated.

Texts are cut by the tokenizer's pattern first and each match is encoded by itself, as public rank files
expect. A null text counts as empty: no tokens, empty bytes. Repeated rows and ties need no rule, because
each row's result depends on its own text alone; other columns are kept whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, table, text_batches, utf8
from .merging import Merges, splits

LEAF_BYTES = 6
#: Bytes of a window that is merged along with others.
LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a ``.tiktoken`` file (base64 of the token, space, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes pieces (byte strings) to ids by merge ranks, and ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        most = max(self.token, default=-1) + 1
        self.merges = Merges(splits(ranks, lambda i: i), most)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.vocabulary = pa.array([self.token.get(i) for i in range(most)], pa.large_binary())
        self.size = np.array([len(self.token.get(i, b"")) for i in range(most)], np.int64)

    def _merge(self, data: bytes) -> list[int]:
        """Merges the pair of lowest rank, the leftmost of equals, until none is left."""
        return self._merge_short(data) if len(data) <= 24 else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        """By looking at all pairs again after each merge."""
        rank, none = self.ranks.get, len(self.ranks)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """By a heap of pairs: O(n log n)."""
        n, ranks = len(data), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heappop(heap)
            if not alive[i] or end[i] >= stop or end[end[i]] != stop:
                continue  # one of the two parts has been merged otherwise
            gone = end[i]
            alive[gone] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := ranks.get(data[j:stop])) is not None:
                heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Is [a, b] the encoding of its bytes?"""
        return self._merge(self.token[a] + self.token[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            seam = self._merge(self.decode(left[a:] + right[:b]))
            if (a == 0 or self.stable(left[a - 1], seam[0])) and (b == len(right) or self.stable(seam[-1], right[b])):
                return left[:a] + seam + right[b:]
            width *= 2

    def encode(self, data: bytes) -> list[int]:
        """The encoding of one piece: that of its halves, joined. :meth:`encode_all` does the same for many pieces."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) <= LEAF_BYTES:
            return self._merge(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def _merged(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their windows, of the windows ``[start, end)`` of ``data``, in order."""
        size = end - start
        short = np.flatnonzero(size <= LONG)
        at = np.repeat(start[short] - (np.cumsum(size[short]) - size[short]), size[short]) + np.arange(size[short].sum())
        ids, run = self.merges(self.byte[data[at]], np.repeat(short, size[short]))
        if len(short) == len(size):
            return ids, run
        parts, where = [ids], [run]
        for k in np.flatnonzero(size > LONG).tolist():
            parts.append(np.array(self._merge(data[start[k] : end[k]].tobytes()), np.int32))
            where.append(np.full(len(parts[-1]), k))
        ids, run = np.concatenate(parts), np.concatenate(where)
        by = np.argsort(run, kind="stable")
        return ids[by], run[by]

    def _stable_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`stable` of many pairs, each different one tried once."""
        pair, back = np.unique(a.astype(np.int64) * len(self.size) + b, return_inverse=True)
        a, b = pair // len(self.size), pair % len(self.size)
        _, at, body = self.vocabulary.take(pa.array(np.stack([a, b], axis=1).ravel())).buffers()
        ends = np.frombuffer(at, np.int64, 2 * len(pair) + 1)[::2]
        ids, run = self._merged(np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8), ends[:-1], ends[1:])
        first = np.searchsorted(run, np.arange(len(pair)))
        two = np.diff(np.append(first, len(run))) == 2
        out = two.copy()
        out[two] = (ids[first[two]] == a[two]) & (ids[first[two] + 1] == b[two])
        return out[back]

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each piece has, and the ids of all.

        The trees of all pieces are reduced level by level: their leaves are merged at the same time, then the seams of a
        level are joined, those that are stable as they are, the others through windows that double until they are.
        """
        data = np.frombuffer(b"".join(pieces), np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        levels = [np.unique(edges)]
        while True:  # halve what is too long for a leaf
            low, high = levels[-1][:-1], levels[-1][1:]
            cut = (low + (high - low) // 2)[high - low > LEAF_BYTES]
            if not len(cut):
                break
            levels.append(np.union1d(levels[-1], cut))
        ids, run = self._merged(data, levels[-1][:-1], levels[-1][1:])
        for coarse, fine in zip(levels[-2::-1], levels[:0:-1]):
            ids = self._joined(data, ids, np.setdiff1d(fine, coarse, assume_unique=True), coarse)
        place = np.concatenate([[0], np.cumsum(self.size[ids])])[: len(ids)]
        return np.diff(np.searchsorted(place, edges)), ids

    def _joined(self, data: np.ndarray, ids: np.ndarray, seams: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Tokens after joining at ``seams`` (places in ``data``), one in each of some of the ``nodes``."""
        width = 1
        while len(seams):
            place = np.concatenate([[0], np.cumsum(self.size[ids])])
            at = np.searchsorted(place, seams)
            if width == 1:
                loose = ~self._stable_all(ids[at - 1], ids[at])
                seams, at = seams[loose], at[loose]
                if not len(seams):
                    break
            node = np.searchsorted(nodes, seams, side="right") - 1
            low, high = np.searchsorted(place, nodes[node]), np.searchsorted(place, nodes[node + 1])
            a, b = np.maximum(low, at - width), np.minimum(high, at + width)
            new, run = self._merged(data, place[a], place[b])
            first = np.searchsorted(run, np.arange(len(seams)))
            last = np.append(first[1:], len(run)) - 1
            held = np.ones(len(seams), bool)
            left, right = a > low, b < high
            held[left] &= self._stable_all(ids[a[left] - 1], new[first[left]])
            held[right] &= self._stable_all(new[last[right]], ids[b[right]])
            # windows that hold take the place of what they were made from
            gone = np.zeros(len(ids) + 1, np.int64)
            np.add.at(gone, a[held], 1)
            np.add.at(gone, b[held], -1)
            stay = np.cumsum(gone[:-1]) == 0
            mine = held[run]
            order = np.argsort(np.concatenate([np.flatnonzero(stay), a[run[mine]]]), kind="stable")
            ids = np.concatenate([ids[stay], new[mine]])[order]
            seams = seams[~held]
            width *= 2
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(read_ranks(path))


class _Chunks:
    """Ids of chunks of text, remembered within a bound of bytes."""

    def __init__(self, codec: Codec, pattern: str, blanks: str):
        import regex

        self.codec, self.split, self.blanks = codec, regex.compile(pattern).findall, blanks
        self.known = Remembered(self.encoded)
        self.other = re.compile(f"[^\\S{blanks}]").search
        self.cut = re.compile(f"[{blanks}]*[^{blanks}]+|[{blanks}]+").findall if blanks else None

    def encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each chunk has, and the ids of all; different pieces are encoded once."""
        split, number, at, many = self.split, {}, [], []
        for c in chunks:
            pieces = split(c)
            many.append(len(pieces))
            at += [number.setdefault(p, len(number)) for p in pieces]
        counts, ids = self.codec.encode_all([p.encode("utf-8", "replace") for p in number])
        at = np.array(at, np.int64)
        end = np.cumsum(counts)
        size = counts[at] if len(at) else np.zeros(0, np.int64)
        flat = np.repeat(end[at] - size - (np.cumsum(size) - size), size) + np.arange(size.sum()) if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(many)]).astype(np.int64)]
        return np.diff(ends), ids[flat]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each text has, and the ids of all."""
        parts, many = [], []
        for t in texts:
            # a chunk of over a thousand characters is not likely to come again, but no harm: the memory is bounded
            cut = self.cut(t) if self.cut and not self.other(t) else [t] if t else []
            many.append(len(cut))
            parts += cut
        counts, ids = self.known(parts)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(many)]).astype(np.int64)]
        return np.diff(ends), ids


@lru_cache(maxsize=2)
def _chunks(path: str, pattern: str, blanks: str) -> _Chunks:
    return _Chunks(_codec(path), pattern, blanks)


def _lists(counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))


def _bytes(path: str, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    """The bytes of consecutive runs of ids."""
    flat = _codec(path).vocabulary.take(pa.array(ids, pa.int64()))
    if flat.null_count:
        raise ValueError("a token id has no bytes in this vocabulary")
    # the tokens' bytes lie one after the other already: a row's end is its last token's end
    _, at, body = flat.buffers()
    ends = np.concatenate([[0], np.cumsum(counts)])
    cut = np.frombuffer(at, np.int64, len(flat) + 1)[ends] if len(flat) else np.zeros(len(ends), np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(cut.tobytes()), body or pa.py_buffer(b"")]).cast(pa.binary())


def _groups(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[str]]:
    """Some texts at a time, about ``size`` characters of them."""
    out, held = [], 0
    for t in texts:
        out.append(t.as_py().decode("utf-8", "replace"))
        held += len(out[-1])
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def encode(text: Column, path: str, pattern: str, blanks: str = " \n") -> Column:
    """Text to ``array<int>`` of token ids. ``path``: a rank file that every worker can open.

    ``blanks``: characters at which matches of ``pattern`` may begin but not go on after others, so that the text
    may be cut between a non-space and one of them, and what lies between two cuts be remembered. A text with other
    white space is not cut. Empty: never cut.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        parts = [_lists(*_chunks(path, pattern, blanks)(group)) for group in _groups(texts)]
        return pa.concat_arrays(parts) if parts else _lists(np.zeros(0), np.zeros(0))

    return ids(utf8(text))


def decode(tokens: Column, path: str) -> Column:
    """``array<int>`` of token ids to the bytes they stand for (null counts as no tokens)."""

    @F.arrow_udf("binary")
    def data(ids: pa.Array) -> pa.Array:
        ends = np.asarray(ids.offsets)
        return _bytes(path, np.diff(ends), np.asarray(ids.values.slice(ends[0], ends[-1] - ends[0])))

    return data(F.coalesce(tokens, F.array().cast("array<int>")))


def encode_decode(text: Column, path: str, pattern: str, blanks: str = " \n") -> Column:
    """``struct<tokens, decoded>``: the ids of a text and the bytes that they stand for, by one worker in one pass."""

    @F.arrow_udf("tokens array<int>, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        lists, back = [_lists(np.zeros(0), np.zeros(0))], [pa.array([], pa.binary())]
        for group in _groups(texts):
            found = _chunks(path, pattern, blanks)(group)
            lists.append(_lists(*found))
            back.append(_bytes(path, *found))
        return pa.StructArray.from_arrays([pa.concat_arrays(lists), pa.concat_arrays(back)], ["tokens", "decoded"])

    return both(utf8(text))


def with_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """``docs`` and a column of token ids."""
    text_batches(docs.sparkSession)
    return docs.withColumn(tokens, encode(F.col(f"`{text}`"), path, pattern))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    import public_tokenizers as public

    path = public.path("byte_bpe_50k.tiktoken")
    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", encode_decode(F.col("text"), path, public.PATTERN).alias("both")).select("doc_id", "both.tokens", "both.decoded")
    listed = F.array_join(F.col("tokens").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
