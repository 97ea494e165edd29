"""SentencePiece encoding (BPE models with byte fallback) that keeps source offsets, and decoding.

A text is normalised by longest prefixes: at each place the compiled character map of the model (a double-array trie over
UTF-8) is walked as far as it goes, the longest entry found is replaced, and each character that comes out records the byte
of the source where its entry began. Blanks become the model's blank sign, a text gets one in front, and a model may drop
repeated blanks. The normalised characters are merged by the pieces' scores, and every piece is projected through the
recorded offsets to the bytes of the source that it stands for. Characters that no piece has become byte pieces: the last
of them spans the character, those before it nothing.

No piece holds a blank sign after another character, so a text may be cut in front of blanks; what lies between two cuts is
encoded by itself and remembered within a bound of bytes. A null text counts as empty: no pieces. Repeated rows and ties need no rule, since a row's result depends on its own
text alone; other columns are kept whatever their names, and an empty table gives an empty result. Bytes that are not
UTF-8 count as U+FFFD. Models with user-defined or unused pieces, or of another kind than BPE, are refused.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, table, text_batches, utf8
from .merging import Merges, splits

BLANK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of a run that is merged along with others.
LONG = 64
SPAN = "array<struct<id:int,begin:int,end:int>>"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            c = data[at]
            at += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Normaliser:
    """Longest-prefix normalisation that records where each character came from."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, remove_extra: bool = True, escape: bool = True):
        self.dummy_prefix, self.remove_extra, self.blank = dummy_prefix, remove_extra, BLANK if escape else " "
        size = struct.unpack_from("<I", charsmap)[0] if charsmap else 0
        self.trie, self.texts = array("I", charsmap[4 : 4 + size]), charsmap[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[str, int]:
        """What the longest entry that begins at byte ``at`` becomes, and its bytes; without an entry one character as it is."""
        trie, found, node = self.trie, None, 0
        if trie:
            node = _offset(trie[0])
            for i in range(at, len(data)):
                node ^= data[i]
                unit = trie[node]
                if unit & 0x800000FF != data[i]:
                    break
                node ^= _offset(unit)
                if unit >> 8 & 1:
                    found = trie[node] & 0x7FFFFFFF, i + 1 - at
        if found:
            start, size = found
            return self.texts[start : self.texts.index(0, start)].decode(), size
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + size].decode(), size

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """The normalised characters, and for each the byte of the text where its source begins; one more for the end."""
        data, out, source, at = text.encode(), [], [], 0
        if self.remove_extra:
            while at < len(data) and (step := self.longest(data, at))[0] == " ":
                at += step[1]
        if at == len(data):
            return "", [0]
        if self.dummy_prefix:
            out.append(self.blank)
            source.append(at)
        after_blank = self.remove_extra
        while at < len(data):
            new, size = self.longest(data, at)
            if after_blank:
                new = new.lstrip(" ")
            out.extend(new.replace(" ", self.blank))
            source.extend([at] * len(new))
            if new:
                after_blank = new.endswith(" ")
            at += size
            after_blank = after_blank and self.remove_extra
        if self.remove_extra:
            while out and out[-1] == self.blank:
                out.pop()
                at = source.pop()
        return "".join(out), [*source, at]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 512) >> 6)


class Model:
    """Pieces, their scores and the normaliser of a model file."""

    def __init__(self, data: bytes):
        self.piece, self.score, self.kind = [], {}, []
        norm, trainer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                text, kind = one[1].decode(), one.get(3, NORMAL)
                if kind == NORMAL:
                    self.score.setdefault(text, (-struct.unpack("<f", one.get(2, bytes(4)))[0], len(self.piece)))
                self.piece.append(text)
                self.kind.append(kind)
            elif number in (2, 3):
                (trainer if number == 2 else norm).update(_fields(value))
        if trainer.get(3, 1) != 2 or {USER_DEFINED, UNUSED} & set(self.kind) or trainer.get(24):
            raise ValueError("only BPE models without user-defined and unused pieces are supported")
        self.normalise = Normaliser(norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))
        self.unknown = self.kind.index(UNKNOWN)
        self.byte = [i for i, k in enumerate(self.kind) if k == BYTE] if trainer.get(35) else []
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.id = {p: i for p, (_, i) in self.score.items()}
        self._ready()
        # characters and bytes of what each piece stands for, once its blanks are blanks; byte pieces: see ``taken``
        kind = np.array(self.kind)
        self.chars = np.where(kind == NORMAL, [len(p) for p in self.piece], 1)
        self.bytes = np.where(kind == NORMAL, [len(p.replace(BLANK, " ").encode()) for p in self.piece], 1)
        self.code = np.array([int(p[3:5], 16) if k == BYTE else -1 for p, k in zip(self.piece, self.kind)])
        if any(BLANK in p.lstrip(BLANK) for p in self.score):
            raise ValueError("a piece goes on over a blank")
        self.plain = not self.normalise.trie and not self.normalise.remove_extra and self.normalise.blank == BLANK

    # -------------------------------------------------------------- merging

    def _ready(self) -> None:
        """What two neighbours merge to and when; symbols of single characters by code point (unknown ones are beyond the ids)."""
        rank = {s: r for r, s in enumerate(sorted({s for s, _ in self.score.values()}))}
        of = {i: rank[s] for s, i in self.score.values()}
        self.merges = Merges(splits(self.id, of.__getitem__), len(self.piece) + 0x110000)
        self._char = np.arange(len(self.piece), len(self.piece) + 0x110000, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self._char[ord(p)] = i

    def pieces(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many pieces each run of normalised characters has, and the ids of all. Runs of over ``LONG`` characters are
        merged one by one, the others at the same time."""
        size = np.array([len(c) if len(c) <= LONG else 0 for c in chunks], np.int64)
        text = "".join(c for c in chunks if len(c) <= LONG)
        ids, run = self.merges(self._char[np.frombuffer(text.encode("utf-32-le"), np.uint32)], np.repeat(np.arange(len(chunks)), size))
        parts, where = [ids], [run]
        for k, c in enumerate(chunks):
            if len(c) > LONG:
                parts.append(np.array([self.id[p] if p in self.id else self._char[ord(p)] for p in self._long(c)], np.int32))
                where.append(np.full(len(parts[-1]), k))
        ids, run = np.concatenate(parts), np.concatenate(where)
        if len(parts) > 1:
            by = np.argsort(run, kind="stable")
            ids, run = ids[by], run[by]
        odd = ids >= len(self.piece)  # a character that no piece has
        if odd.any():
            codes = [self._unknown(chr(c)) for c in (ids[odd] - len(self.piece)).tolist()]
            count = np.ones(len(ids), np.int64)
            count[odd] = list(map(len, codes))
            ids, run, odd = np.repeat(ids, count), np.repeat(run, count), np.repeat(odd, count)
            ids[odd] = [i for c in codes for i in c]
        return np.bincount(run, minlength=len(chunks)), ids

    def _unknown(self, char: str) -> list[int]:
        """Byte pieces if there are any."""
        return [self.byte[c] for c in char.encode()] if self.byte else [self.unknown]

    def taken(self, ids: np.ndarray, sizes: np.ndarray, of_bytes: bool) -> np.ndarray:
        """What each piece takes, by ``sizes`` of ids; of a character's byte pieces the last takes all, the others nothing."""
        out, code = sizes[ids], self.code[ids]
        lead = np.flatnonzero((code >= 0) & (code & 0xC0 != 0x80))
        if len(lead):
            out[code >= 0] = 0
            size = np.array([1, 2, 3, 4])[(code[lead] >= 0xC0).astype(int) + (code[lead] >= 0xE0) + (code[lead] >= 0xF0)]
            out[lead + size - 1] = size if of_bytes else 1
        return out

    def _long(self, chars: str) -> list[str]:
        """The pieces of a long run, by a heap of pairs: O(n log n)."""
        n, score = len(chars), self.score
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i
        heap = [(s[0], i, i + 2) for i in range(n - 1) if (s := score.get(chars[i : i + 2])) is not None]
        heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heappop(heap)
            if not alive[i] or end[i] >= stop or end[end[i]] != stop:
                continue  # one of the two parts has been merged otherwise
            alive[end[i]] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (s := score.get(chars[i : end[stop]])) is not None:
                    heappush(heap, (s[0], i, end[stop]))
            if (j := before[i]) >= 0 and (s := score.get(chars[j:stop])) is not None:
                heappush(heap, (s[0], j, stop))
        out, i = [], 0
        while i < n:
            out.append(chars[i : end[i]])
            i = end[i]
        return out

    # -------------------------------------------------------------- decoding

    def surface(self, i: int) -> bytes:
        """What an id adds to a decoded text."""
        kind = self.kind[i]
        if kind == BYTE:
            return bytes([int(self.piece[i][3:5], 16)])
        return {CONTROL: "", UNKNOWN: self.unknown_text}.get(kind, self.piece[i].replace(BLANK, " ")).encode()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: the first blank goes if encoding puts one in front; bytes that are not UTF-8 are U+FFFD."""
        out, raw, began = [], bytearray(), False

        def flush() -> None:
            at = 0
            while at < len(raw):
                size = next((k for k in (1, 2, 3, 4) if _is_char(raw[at : at + k])), 0)
                out.append(raw[at : at + size].decode() if size else "�")
                at += size or 1
            raw.clear()

        norm = self.normalise
        for i in ids:
            if self.kind[i] == BYTE:
                raw += self.surface(i)
                continue
            flush()
            text = self.surface(i).decode()
            if not began and not any(out) and (norm.dummy_prefix or norm.remove_extra) and self.kind[i] == NORMAL and text.startswith(" "):
                text, began = text[1:], not norm.remove_extra
            out.append(text)
        flush()
        return "".join(out)


def _is_char(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


class Encoder:
    """Texts to ids and source spans, remembering what lies between two cuts."""

    def __init__(self, path: str):
        self.model = model(path)
        self.known = Remembered(self.model.pieces)
        self.cut = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many pieces each text has, and all pieces' ids, begins and ends."""
        m, parts, chunks, sources = self.model, [], [], {}
        for k, t in enumerate(texts):
            # the source of a text whose characters all stay follows from its pieces; others record it
            if m.plain and BLANK not in t:
                chars = (BLANK if m.normalise.dummy_prefix and t else "") + t.replace(" ", BLANK)
            else:
                chars, sources[k] = m.normalise(t)
            cut = self.cut(chars)
            chunks.append(len(cut))
            parts += cut
        count, ids = self.known(parts)
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(chunks)]).astype(np.int64)]
        counts = np.diff(ends)
        size = m.taken(ids, m.bytes, True)
        some = ends[:-1][counts > 0]
        if m.normalise.dummy_prefix:
            size[some] -= 1  # the blank in front is not in the text
        begin, end = _running(size, ends)
        if sources:
            chars_begin, chars_end = _running(m.taken(ids, m.chars, False), ends)
            for k, source in sources.items():
                at, source = slice(ends[k], ends[k + 1]), np.array(source)
                begin[at], end[at] = source[chars_begin[at]], source[chars_end[at]]
        return counts, ids, begin, end


def _running(size: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of these sizes begin and end, in each run apart."""
    end = np.concatenate([[0], np.cumsum(size)])
    before = np.repeat(end[ends[:-1]], np.diff(ends))
    return end[:-1] - before, end[1:] - before


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def _surfaces(path: str) -> tuple[pa.Array, np.ndarray]:
    """What each id adds to a text, and whether it is a normal or a byte piece."""
    m = model(path)
    return pa.array(map(m.surface, range(len(m.piece))), pa.large_binary()), np.isin(m.kind, [NORMAL, BYTE])


def _groups(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[str]]:
    """Some texts at a time, about ``size`` bytes of them."""
    out, held = [], 0
    for t in texts:
        out.append(t.as_py().decode("utf-8", "replace"))
        held += len(out[-1])
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def _span_lists(counts: np.ndarray, *columns: np.ndarray) -> pa.Array:
    rows = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], ["id", "begin", "end"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), rows)


def encode(text: Column, path: str) -> Column:
    """Text to ``array<struct<id,begin,end>>``: each piece with the bytes ``[begin, end)`` of the text that it stands for.
    ``path``: a model file that every worker can open."""

    @F.arrow_udf(SPAN)
    def pieces(texts: pa.Array) -> pa.Array:
        parts = [_span_lists(*_encoder(path)(group)) for group in _groups(texts)]
        return pa.concat_arrays(parts) if parts else _span_lists(*[np.zeros(0, np.int64)] * 4)

    return pieces(utf8(text))


def _decoded(path: str, counts: np.ndarray, ids: np.ndarray) -> list[str]:
    """The texts of consecutive runs of ids."""
    m, (surface, usual) = model(path), _surfaces(path)
    flat = surface.take(pa.array(ids, pa.int64()))
    _, at, body = flat.buffers()
    at = np.frombuffer(at, np.int64, len(flat) + 1 + flat.offset)[flat.offset :] if len(flat) else np.zeros(1, np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    odd = np.concatenate([[0], np.cumsum(~usual[ids])])[ends]
    body, out, norm = memoryview(body or b""), [], m.normalise
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        try:
            if norm.remove_extra or odd[k] != odd[k + 1]:
                raise ValueError
            text = str(body[at[a] : at[b]], "utf-8")
            out.append(text[1:] if norm.dummy_prefix and a < b and m.kind[ids[a]] == NORMAL and text.startswith(" ") else text)
        except ValueError:  # ids that need a look at each, or bytes that are not UTF-8
            out.append(m.decode(ids[a:b].tolist()))
    return out


def decode(ids: Column, path: str) -> Column:
    """``array<int>`` of ids to their text (null counts as no ids)."""

    @F.arrow_udf("string")
    def texts(runs: pa.Array) -> pa.Array:
        ends = np.asarray(runs.offsets)
        flat = np.asarray(runs.values.slice(ends[0], ends[-1] - ends[0]))
        return pa.array(_decoded(path, np.diff(ends), flat), pa.string())

    return texts(F.coalesce(ids, F.array().cast("array<int>")))


def encode_decode(text: Column, path: str) -> Column:
    """``struct<pieces, decoded>``: the pieces of a text and the text that their ids decode to, in one pass."""

    @F.arrow_udf(f"pieces {SPAN}, decoded string")
    def both(texts: pa.Array) -> pa.Array:
        parts, back = [], []
        for group in _groups(texts):
            found = _encoder(path)(group)
            parts.append(_span_lists(*found))
            back += _decoded(path, *found[:2])
        lists = pa.concat_arrays(parts) if parts else _span_lists(*[np.zeros(0, np.int64)] * 4)
        return pa.StructArray.from_arrays([lists, pa.array(back, pa.string())], ["pieces", "decoded"])

    return both(utf8(text))


def with_pieces(docs: DataFrame, path: str, text: str = "text", out: str = "pieces") -> DataFrame:
    """``docs`` and a column of pieces with their source spans."""
    text_batches(docs.sparkSession)
    return docs.withColumn(out, encode(F.col(f"`{text}`"), path))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    import public_tokenizers as public

    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", encode_decode(F.col("text"), public.path("piece_bpe_32k.model")).alias("both"))
    ids = F.col("both.pieces.id")
    return coded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("both.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
