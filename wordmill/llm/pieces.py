"""SentencePiece encoding with the place of every piece in the source text, and decoding.

Normalisation walks the compiled character map of the model: at each place the longest prefix that the map holds is
replaced, otherwise one character is copied; blanks become the escape mark. Every byte of the normalised text knows the source
byte it came from, so every piece is a stretch of source bytes: piece i covers ``ends[i - 1]`` (0 for the first) to
``ends[i]``.

Where the map is empty, texts are cut where no piece of the vocabulary reaches across: before a blank that follows
another character, and around line breaks. Merges on the two sides of such a cut never meet, so the pieces of the parts
are the pieces of the whole. A task keeps the pieces of up to ``POOL`` distinct parts that the library has encoded, finds
them by hash and compares their bytes. Other models, and texts that hold the escape mark itself, are normalised by
the walk and encoded whole.

Defined cases: a null text counts as empty; an empty text has no pieces and decodes to an empty text; null ids decode
to an empty text; very long texts are held one at a time; repeated rows are encoded one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as protos

from wordmill.llm.common import arrow, fresh
from wordmill.llm.hashed import buffers, runs, stretches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
BPE = 2
#: Distinct parts that a task remembers before it starts anew.
POOL = 500_000


class CharMap:
    """Compiled character map: a double-array trie over UTF-8 bytes, then the replacements, each ended by a zero."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at a byte."""
        if not self.units:
            return None
        found, node = None, self._jump(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


class Codec:
    """One model, ready to encode and decode inside a task."""

    def __init__(self, blob: bytes) -> None:
        model = protos.ModelProto()
        model.ParseFromString(blob)
        spec = model.normalizer_spec
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.chars = CharMap(spec.precompiled_charsmap)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        plain = protos.ModelProto()
        plain.CopyFrom(model)
        plain.normalizer_spec.precompiled_charsmap = b""
        plain.normalizer_spec.add_dummy_prefix = plain.normalizer_spec.remove_extra_whitespaces = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=plain.SerializeToString())
        pieces, kinds = [p.piece for p in model.pieces], [p.type for p in model.pieces]
        self.special = np.array([k not in (NORMAL, BYTE) for k in kinds])
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() for p, k in zip(pieces, kinds, strict=True)]
        self.surface = [b if k == BYTE else p.replace(MARK, " ").encode() for p, k, b in zip(pieces, kinds, self.bytes_of, strict=True)]
        self.size = np.array([len(b) for b in self.bytes_of])
        self.source = np.array([len(b) for b in self.surface])
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.flat_at = np.cumsum(self.source) - self.source
        normal = [p for p, k in zip(pieces, kinds, strict=True) if k == NORMAL]
        apart = not any(MARK in p.lstrip(MARK) or "\n" in p for p in normal)
        bpe = model.trainer_spec.model_type == BPE and USER not in kinds and BYTE in kinds
        self.parts = apart and bpe and not self.chars.units and self.escape and not self.squeeze
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.keys, self.slot = np.zeros(0, np.uint64), none
        self.pool, self.first, self.count = np.zeros(0, np.int32), none, none
        self.known, self.known_at, self.known_size = np.zeros(0, np.uint8), none, none

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode new parts and remember them."""
        if len(self.keys) + len(keys) > POOL and len(self.keys):
            self._forget()
        order = np.argsort(start)
        keys, start, end = keys[order], start[order], end[order]
        raw = data[expand(start, end - start)].tobytes()
        to = np.cumsum(end - start)
        texts = [raw[a:b].decode().replace(" ", MARK) for a, b in zip((to - (end - start)).tolist(), to.tolist(), strict=True)]
        ids = self.inner.encode(texts, num_threads=1)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.slot = np.insert(self.slot, place, len(self.count) + order)
        self.keys = np.insert(self.keys, place, keys[order])
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))])
        self.known_at = np.concatenate([self.known_at, len(self.known) + to - (end - start)])
        self.known_size = np.concatenate([self.known_size, end - start])
        self.known = np.concatenate([self.known, np.frombuffer(raw, np.uint8)])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slot[at], -1)

    def _by_parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all texts one after the other and pieces per text; None if two parts share a hash."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        cut, line, blank = np.zeros(len(data), bool), data == 10, data == 32
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        cut |= line
        cut[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        keys, one, which = np.unique(stretches(data, start, end), return_index=True, return_inverse=True)
        slot = self._find(keys)
        if (slot < 0).any():
            self._learn(keys[slot < 0], data, start[one[slot < 0]], end[one[slot < 0]])
            slot = self._find(keys)
            if (slot < 0).any():  # the pool was started anew
                lost = slot < 0
                self._learn(keys[lost], data, start[one[lost]], end[one[lost]])
                slot = self._find(keys)
        slot = slot[which]
        if (self.known_size[slot] != end - start).any() or (self.known[expand(self.known_at[slot], end - start)] != data).any():
            return None
        count = self.count[slot]
        owner = np.searchsorted(offsets, start, "right") - 1
        return self.pool[expand(self.first[slot], count)], np.bincount(owner, count, n).astype(np.int64)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for every byte of it and its end the source byte."""
        data, out, at, align, i = text.encode(), bytearray(), 0, [], 0
        escaped = MARK.encode() if self.escape else b" "
        if self.squeeze:
            while i < len(data):
                hit = self.chars.longest(data, i)
                if (hit[1] if hit else data[i : i + 1]) not in (b" ",):
                    break
                i += hit[0] if hit else 1
        if self.prefix and i < len(data):
            out += escaped
            align += [i] * len(escaped)
        blank = bool(self.squeeze)
        while i < len(data):
            hit = self.chars.longest(data, i)
            length = hit[0] if hit else 1 if data[i] < 128 else 2 if data[i] < 224 else 3 if data[i] < 240 else 4
            new = hit[1] if hit else data[i : i + length]
            if self.squeeze and blank:
                new = new.lstrip(b" ")
            if new:
                new_out = new.replace(b" ", escaped)
                out += new_out
                align += [i] * len(new_out)
                if self.squeeze:
                    blank = new.endswith(b" ")
            i += length
            at = i
        end = at if data else 0
        if self.squeeze:
            while out.endswith(escaped) and len(out) > 0:
                end = align[len(out) - len(escaped)]
                del out[len(out) - len(escaped) :]
                del align[len(out) :]
        return out.decode(), np.array([*align, end], np.int64)

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and source ends of one text that is normalised by the walk."""
        made, align = self.normalise(text)
        ids = np.array(self.inner.encode(made), np.int32)
        if not self.special[ids].any():
            return ids, align[np.cumsum(self.size[ids])]
        said = self.inner.encode(made, return_type="proto")
        return ids, align[[len(made[: p.end].encode()) for p in said.pieces]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and source ends of all texts one after the other, and pieces per text."""
        texts = texts.fill_null("").cast(pa.large_string())
        if self.parts and not pc.any(pc.match_substring(texts, MARK)).as_py():
            padded = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))) if self.prefix else texts
            data, offsets = buffers(padded)
            found = self._by_parts(data[offsets[0] : offsets[-1]], offsets - offsets[0])
            if found is not None:
                ids, per = found
                return ids, running(self.source[ids], per) - int(self.prefix), per
        each = [self._whole(x) for x in texts.to_pylist()]
        none = [np.zeros(0, np.int64)]
        return np.concatenate([x for x, _ in each] or none), np.concatenate([x for _, x in each] or none), np.array([len(x) for x, _ in each], np.int64)

    def decode(self, ids: np.ndarray, per: np.ndarray) -> list[str]:
        out, first = [], np.cumsum(per) - per
        length = self.source[ids]
        data = self.flat[expand(self.flat_at[ids], length)].tobytes()
        to = np.concatenate([[0], np.cumsum(length)])
        odd = self.special[ids]
        drop = self.prefix or self.squeeze
        for at, n in zip(first, per, strict=True):
            said = data[to[at] : to[at + n]]
            if n and drop and self.bytes_of[ids[at]].startswith(MARK.encode()):
                said = said[1:]
            try:
                if odd[at : at + n].any():
                    raise ValueError
                out.append(said.decode())
            except ValueError:  # ids that no text encodes to: pieces of broken characters, control pieces
                out.append(self.library.decode(ids[at : at + n].tolist()))
        return out


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each count."""
    total = np.cumsum(count)
    return np.repeat(start - (total - count), count) + np.arange(total[-1] if len(total) else 0)


def running(sizes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Running sums that start anew for each text."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    first = np.cumsum(per) - per
    return total[1:] - np.repeat(total[first], per)


def listed(values: np.ndarray, per: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(values, kind))


def _with(docs: DataFrame, fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*docs.schema.fields, *fields])


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", ends: str = "ends") -> DataFrame:
    """The rows with the ids of their text and the source byte at which each piece ends.

    A column of the rows that has the name of a new one already keeps it; the new one gets an underscore.
    ``model`` is the path of a model file; its bytes go to the tasks, so executors need not have the file.
    """
    with open(model, "rb") as source:
        blob = source.read()
    ids, ends = fresh(docs, ids, ends)
    at, names = docs.columns.index(text), [*docs.columns, ids, ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(blob)
        for batch in batches:
            column = batch.column(at)
            for a, b, _, _ in runs(column, 1 << 19):
                part = batch.slice(a, b - a)
                found, stop, per = codec.encode(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, listed(found, per, pa.int32()), listed(stop.astype(np.int32), per, pa.int32())], names)

    kinds = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(ends, T.ArrayType(T.IntegerType(), False))]
    return arrow(docs, run, _with(docs, kinds))


def decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the text of their ids."""
    with open(model, "rb") as source:
        blob = source.read()
    at, names = docs.columns.index(ids), [*docs.columns, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(blob)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                column = part.column(at)
                per = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                said = codec.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), per)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string())], names)

    return arrow(docs, run, _with(docs, [T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of the decoded text, bytes that the pieces cover."""
    covered = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long")
    coded = encode(docs.select(F.col(key), F.col("text")), model).select(key, "ids", covered.alias("n_bytes"))
    both = decode(coded, model)
    return both.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_bytes",
    )
