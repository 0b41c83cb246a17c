"""SentencePiece encoding and decoding that keeps offsets.

The normaliser walks the text's bytes and takes at each place the longest prefix that the
model's compiled character map knows, or one character; it notes for every character of its
output where that came from. White space is escaped and a dummy prefix set as the model
says. Pairs are then merged by score (highest first, leftmost on ties), characters outside
the vocabulary fall back to bytes, and each piece is projected to the bytes of the original
text. Decoding joins the pieces' surfaces.

Between places where the map knows a prefix, a run of the text stays as it is, so a text
that it leaves alone is aligned by the lengths of its pieces. Merges never cross a place
whose two neighbours stand together in no piece: text is cut in chunks there, and what is
known of a chunk (ids, spans, surface) is kept in memory. Chunks are merged in compiled code.

Defined results: null text counts as empty, and an empty text has no pieces; a character
outside the vocabulary becomes its bytes, or, in a vocabulary without byte pieces, one
unknown piece for each run of such characters; very long texts and words are encoded whole;
repeated rows are encoded as often as they occur; extra columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
NONE = float("-inf")
#: From so many bytes on, chunks are cut further and merged from the left, in time that grows with their length alone.
LONG_CHUNK = 200
#: Fixed value: what an unknown piece is decoded to.
UNKNOWN = " \u2047 "


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif tag & 7 == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif tag & 7 == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            raise ValueError("not a model file")
        yield tag >> 3, value


class CharMap:
    """A compiled character map: a double-array trie over byte strings, then replacements that end in a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.out = blob[4 + size :]
        root = self._offset(self.units[0]) if self.units else 0
        first = [b for b in range(256) if root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b]
        #: Finds the places where a known prefix may start.
        self.starts = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in first) + b"]") if first else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:], and what it becomes."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units) or units[node] & 0x800000FF != data[end]:
                break
            has_leaf, node = units[node] >> 8 & 1, node ^ self._offset(units[node])
            if has_leaf:
                start = units[node] & 0x7FFFFFFF
                found = (end + 1 - at, self.out[start : self.out.index(b"\0", start)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


class Encoding(NamedTuple):
    """Pieces of a text: ids, the bytes of the text each stands for, the ids in decimal (a comma after each) and the decoded bytes."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    decimal: bytes
    decoded: bytes


class Encoder:
    def __init__(self, path: str, cache: int = 100_000):
        with open(path, "rb") as f:
            model = f.read()
        self.pieces: list[str] = []
        self.score: dict[str, tuple[float, int]] = {}
        self.byte_id: dict[int, int] = {}
        self.kind: list[int] = []
        charmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                text, kind = piece[1].decode(), piece.get(3, 1)
                if kind == 6:
                    self.byte_id[int(text[3:5], 16)] = len(self.pieces)
                elif kind in (1, 4):
                    self.score[text] = (piece.get(2, 0.0), len(self.pieces))
                self.pieces.append(text)
                self.kind.append(kind)
            elif number == 3:
                spec = dict(fields(value))
                charmap = spec.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self._prepare(CharMap(charmap), cache)

    def _prepare(self, charmap: CharMap, cache: int) -> None:
        self.map = charmap
        self.unknown = self.kind.index(2) if 2 in self.kind else 0
        self.only_score = {p: s for p, (s, _) in self.score.items()}
        inner = {c for p in self.score if len(p) > 1 for c in p} - {SPACE}
        mid = any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.byte_value = {i: b for b, i in self.byte_id.items()}
        cls = "".join(map(re.escape, sorted(inner)))
        # Chunks: a run of spaces with the word after it, or one character that no longer piece holds.
        self.chunks = re.compile(f"{SPACE}*[{cls}]+|{SPACE}+|." if inner and not mid else "(?:.|\n)+", re.S)
        self.together = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.cover = common.Cover(self.score, list, self._rank, NONE)
        self.compiled = self._merger()
        self.memo = common.Memo(self._chunk, cache)

    def _merger(self):
        """Merges in compiled code over a chunk's bytes, or None where a piece is to be kept from merging.

        Chunks that hold a piece whose score is not its own (`tied`) are not merged this way.

        The bytes of a character are put together before all else, in the order of its
        prefixes; then pairs merge by the score of what comes out. Pieces that merging their
        own characters does not give never come out of any merge and are left out.
        """
        import tiktoken

        merged = sorted((p for p in self.cover.tokens if len(p) > 1), key=lambda p: -self.only_score[p])
        times = Counter(self.only_score[p] for p in merged)
        tied = sorted((p for p in merged if times[self.only_score[p]] > 1), key=len)
        self.tied = re.compile("|".join(map(re.escape, tied)) or r"(?!)")
        if {4, 5} & {*self.kind} or len(self.byte_id) < 256:
            return None
        table = {bytes([b]): b for b in range(256)}
        for c in sorted({c for p in self.score for c in p}):
            raw = c.encode()
            for k in range(2, len(raw) + 1):
                table.setdefault(raw[:k], len(table))
        for p in merged:
            if p not in tied:
                table[p.encode()] = len(table)
        #: By rank: the id in decimal, as four bytes, its length in the text, its surface; None for what is no piece.
        self.parts: list[tuple[bytes, bytes, int, bytes] | None] = [None] * len(table)
        for raw, rank in table.items():
            found = self.score.get(raw.decode("utf-8", "replace"))
            if found:
                surface = self._surface([found[1]])
                self.parts[rank] = (b"%d," % found[1], struct.pack("=i", found[1]), len(surface), surface)
        return tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The text as pieces see it, and for each of its characters, and the end, the original byte it starts at.

        None for the places if every character is one of the text (or its escape) in turn, after the dummy prefix.
        """
        data = text.encode()
        out: list[str] = []
        origin: list[int] = []
        at = 0
        changed = self.squeeze

        def keep(part: str, at: int) -> None:
            out.extend(part)
            origin.extend(itertools.accumulate([len(c.encode()) for c in part[:-1]], initial=at) if part else ())

        while self.map.starts and (found := self.map.starts.search(data, at)):
            if found.start() > at:
                keep(data[at : found.start()].decode(), at)
            at = found.start()
            hit = self.map.longest(data, at)
            lead = data[at]
            n = hit[0] if hit else 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            new = hit[1].decode() if hit else data[at : at + n].decode()
            changed |= bool(hit)
            out.extend(new)
            origin.extend([at] * len(new))
            at += n
        if not changed:
            norm = text.replace(" ", SPACE) if self.escape else text
            return ((SPACE if self.escape else " ") + norm if self.dummy_prefix and norm else norm), None
        keep(data[at:].decode(), at)
        end = len(data)
        if self.squeeze:
            kept = [i for i, c in enumerate(out) if c != " " or (i and out[i - 1] != " ")]
            while kept and out[kept[0]] == " ":
                kept.pop(0)
            while kept and out[kept[-1]] == " ":
                end = origin[kept.pop()]
            out, origin = [out[i] for i in kept], [origin[i] for i in kept]
        if self.escape:
            out = [SPACE if c == " " else c for c in out]
        if self.dummy_prefix and out:
            out.insert(0, SPACE if self.escape else " ")
            origin.insert(0, origin[0])
        return "".join(out), [*origin, end]

    def merge(self, chunk: str) -> list[str]:
        """The chunk's symbols after all merges."""
        return self.cover(chunk)

    def _rank(self, left: str, right: str) -> float:
        return self.only_score.get(left + right, NONE)

    def ids_of(self, symbol: str) -> list[int]:
        found = self.score.get(symbol)
        return [found[1]] if found else [self.byte_id.get(b, self.unknown) for b in symbol.encode()] if self.byte_id else [self.unknown]

    def _chunk(self, chunk: str) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        """Of a chunk that stands for its own bytes: ids in decimal, ids, begins and ends as four bytes each, surface."""
        raw = chunk.encode()
        if len(raw) >= LONG_CHUNK:
            cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.together]
            if cuts:  # between such neighbours no merge happens
                return self._joined([self.memo[chunk[a:b]] for a, b in zip([0, *cuts], [*cuts, len(chunk)])], 0)
        elif self.compiled and not self.tied.search(chunk):
            found = [self.parts[r] for r in self.compiled(raw)]
            if None not in found:
                ends = list(itertools.accumulate([f[2] for f in found]))
                return b"".join([f[0] for f in found]), b"".join([f[1] for f in found]), array("i", [0, *ends[:-1]]).tobytes(), array("i", ends).tobytes(), b"".join([f[3] for f in found])
        ids, begins, ends, at = array("i"), array("i"), array("i"), 0
        for symbol in self.merge(chunk):
            own, n = self.ids_of(symbol), len(symbol.replace(SPACE, " ").encode())
            ids.extend(own)
            begins.extend([at] * len(own))
            at += n
            ends.extend([at] * len(own))
        return b"".join([b"%d," % i for i in ids]), ids.tobytes(), begins.tobytes(), ends.tobytes(), self._surface(ids)

    @staticmethod
    def _joined(found: list[tuple], at: int) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        """Chunks in a row as one, the first of which starts at byte `at` of the text."""
        decimal, ids, begins, ends, surfaces = zip(*found)
        sizes = np.fromiter(map(len, surfaces), np.int32, len(found))
        starts = np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes + np.int32(at), np.fromiter(map(len, ids), np.int32, len(found)) // 4)
        place = lambda x: np.maximum(np.frombuffer(b"".join(x), np.int32) + starts, 0).tobytes()
        return b"".join(decimal), b"".join(ids), place(begins), place(ends), b"".join(surfaces)

    def encode(self, text: str) -> Encoding:
        """Every piece with the bytes of the original text it stands for.

        The bytes that one character falls back to all carry that character's span.
        """
        norm, origin = self.normalise(text)
        if not norm:
            return Encoding(*[np.zeros(0, np.int32)] * 3, b"", b"")
        if origin is None and self.byte_id and self.escape and SPACE not in text:  # an escape that is the text's own has its own bytes
            decimal, ids, begins, ends, data = self._joined(list(map(self.memo.__getitem__, self.chunks.findall(norm))), -1 if self.dummy_prefix else 0)
            ids, begins, ends = (np.frombuffer(x, np.int32) for x in (ids, begins, ends))
        else:
            ids, begins, ends, at = self._aligned(norm, origin or self._own_places(norm, text))
            decimal, data = b"".join([b"%d," % i for i in ids]), self._surface(ids)
        return Encoding(ids, begins, ends, decimal, self._undone(data))

    def _own_places(self, norm: str, text: str) -> list[int]:
        own = list(itertools.accumulate([len(c.encode()) for c in text], initial=0))
        return [0] * (len(norm) - len(text)) + own

    def _aligned(self, norm: str, origin: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        rows: list[tuple[int, int, int]] = []
        at, open_ = 0, False
        for chunk in self.chunks.findall(norm):
            for symbol in self.merge(chunk):
                begin, end = origin[at], origin[at + len(symbol)]
                strange = symbol not in self.score and not self.byte_id
                if strange and open_:
                    rows[-1] = (self.unknown, rows[-1][1], end)
                else:
                    rows += [(i, begin, end) for i in self.ids_of(symbol)]
                open_ = strange
                at += len(symbol)
        ids, begins, ends = np.array(rows, np.int32).reshape(-1, 3).T
        return ids, begins, ends, at

    def _surface(self, ids) -> bytes:
        return b"".join(
            bytes([self.byte_value[i]]) if i in self.byte_value else b"" if self.kind[i] == 3 else UNKNOWN.encode() if self.kind[i] == 2 else self.pieces[i].replace(SPACE, " ").encode()
            for i in ids
        )

    def _undone(self, data: bytes) -> bytes:
        return data[1:] if self.dummy_prefix and data[:1] == b" " else data

    def decode(self, ids) -> str:
        """Text of the ids; the dummy prefix goes, bytes that are no UTF-8 become U+FFFD."""
        return self._undone(self._surface(ids)).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, pieces array<struct<id, begin, end>>): ids with byte spans of the original text."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = common.worker_state(("sp", model), lambda: Encoder(model))
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                found = [enc.encode(t or "") for t in part.column(1).to_pylist()]
                columns = [pa.array(np.concatenate([getattr(e, k) for e in found])) for k in ("ids", "begin", "end")]
                ends = np.cumsum([0, *(len(e.ids) for e in found)]).astype(np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["id", "begin", "end"]))
                yield pa.RecordBatch.from_arrays([part.column(0), pieces], ["doc_id", "pieces"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, pieces array<struct<id:int,begin:int,end:int>>"
    )


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered) of what `encode` gives; covered: where the last piece ends, in bytes."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = common.worker_state(("sp", model), lambda: Encoder(model))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            for text in common.each(b.column(1)):
                e = enc.encode(text or "")
                decoded = e.decoded if e.decoded.isascii() else e.decoded.decode("utf-8", "replace").encode()
                rows.append((len(e.ids), sha(e.decimal[:-1]), sha(decoded), int(e.end[-1]) if len(e.ids) else 0))
            n, ids, text, covered = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string()), pa.array(covered, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered long"
    )
