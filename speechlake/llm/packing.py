"""Best-fit packing of tokenised documents, certified by dual-feasible-function bounds.

Documents are cut into pieces of at most `capacity` ids. Pieces are dealt to partitions by a
hash of their id; each partition packs by best-fit decreasing and compares its bin count
with a lower bound from dual feasible functions. Partitions above their bound give the
pieces of their unfilled bins away: those are dealt anew, to partitions of PER_GROUP pieces
on average, and packed again, until no partition has a gap, one partition has seen all that
is left, or a round makes the sum of gaps no smaller.

Defined results: null text counts as empty and is one piece with the closing id alone; a
null doc_id is packed like any other; the literal of a special token in a text is that token,
as in the tokenizer's own reading; repeated rows are packed as often as they occur; extra
columns are left out; an empty table gives an empty result. Only ids' lengths and checksums
are kept, never the ids of all texts.
"""

from __future__ import annotations

import bisect
import json
import re
import sys
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
#: Pieces that a packing task gets on average.
PER_GROUP, MAX_ROUNDS = 16_384, 12
#: From so many bytes on, words are merged from the left, in time that grows with their length alone.
LONG_WORD = 200
NONE, END = float("-inf"), "\ue000"
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """The ids of a text as packed unsigned 32-bit integers.

    The vocabulary splits a text into words before it merges, so a word's ids can be kept.
    Words are found and merged here only in texts whose normalised form stays below U+0250;
    other texts go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        #: Literals that the tokenizer takes out before it looks at words: texts that hold one are left to it.
        self.special = re.compile("|".join(re.escape(t["content"].lower()) for t in spec.get("added_tokens", ())) or r"(?!)")
        suffix = model["end_of_word_suffix"]
        marked = lambda x: x.removesuffix(suffix) + END * x.endswith(suffix)
        self.vocab = {marked(t): i for t, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {f"{marked(a)} {marked(b)}": -i for i, (a, b) in enumerate(pairs)}
        # The byte-level alphabet: printable Latin-1 stands for itself, other bytes for what follows U+0100.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = iter(range(0x100, 0x200))
        self.letter = [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]
        kind = defaultdict(list)
        for c in map(chr, range(0x250)):
            kind[unicodedata.category(c)[0]].append(re.escape(c))
        letters, numbers, space = "".join(kind["L"]), "".join(kind["N"]), r"\t-\r \x85\xa0"
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        self.spaces, self.rare = re.compile(f"[{space}]+"), re.compile("[\x1c-\x1f]")  # str.split takes these four for spaces
        self.beyond = re.compile("[^\x00-ɏ]")
        self.cover = common.Cover(self.vocab, self._apart, self._rank, NONE, 50_000)
        self.merge = self._merger()
        self.word_ids = common.Memo(self._word, 50_000)
        self.memo = common.Memo(self._run, 100_000)

    def _rank(self, left: str, right: str) -> int:
        return self.ranks.get(f"{left} {right}", NONE)

    def _apart(self, letters: str) -> list[str]:
        return [*letters[:-2], letters[-2:]] if letters[-1:] == END else list(letters)

    def _merger(self):
        """Byte-pair merges in compiled code, over a word's bytes and a closing 0xFF, or None where ids do not ascend with the merges.

        It merges by the rank of what comes out, whatever the two parts. With tokens that
        merge to themselves alone, that changes nothing: merges inside a token's span run as
        they do on the token by itself, and reach it through its own pair.
        """
        import tiktoken

        byte = {c: bytes([b]) for b, c in enumerate(self.letter)} | {END: b"\xff"}
        made = [self.vocab.get(m.replace(" ", "", 1), -1) for m in self.ranks]
        closed = [self.vocab.get(c + END, -1) for c in self.letter]
        if min(closed) < 0 or made != sorted(made) or made[:1] <= [max(closed)] or not all(c in self.vocab for c in self.letter):
            return None
        table = {b"".join([byte[c] for c in t]): self.vocab[t] for t in self.cover.tokens if t != self.letter[0xFF] and all(c in byte for c in t)}
        table[b"\xff"] = max(self.vocab.values()) + 1
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        if self.merge and len(raw) < LONG_WORD:
            ids = array("I", self.merge(raw + b"\xff"))
        else:
            ids = array("I", [self.vocab[t] for t in self.cover("".join([self.letter[b] for b in raw]) + END)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _run(self, run: str) -> bytes:
        if run.isalpha():  # one word, kept as a run
            return self._word(run)
        return b"".join(map(self.word_ids.__getitem__, self.words.findall(run)))

    def _text(self, text: str) -> bytes:
        ids = array("I", self.lib.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, text: str) -> bytes:
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.beyond.search(low) or self.special.search(low):
            return self._text(text)
        return b"".join(map(self.memo.__getitem__, self.spaces.split(low) if self.rare.search(low) else low.split()))


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of documents (doc_id, text); copy tells repeated rows apart."""
    common.ship(docs.sparkSession)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = common.worker_state(("word", tokenizer), lambda: WordTokenizer(tokenizer))
        for b in batches:
            rows = ([], [], [], [], [], [])
            for doc_id, copy, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.each(b.column(2))):
                ids = memoryview(encode(text or "") + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for out, v in zip(rows, (doc_id, copy, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        out.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "copy", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), "text")
    return source.mapInArrow(run, PIECES)


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing needs: the best of the sum bound and of two families of dual feasible functions.

    For a threshold t up to half the capacity: lengths above capacity - t count as a whole bin,
    those below t as nothing, the rest as they are. For k: a length counts as
    floor((k + 1) * length / capacity) k-ths, or as itself where that is whole.
    """
    if not lengths:
        return 0
    counts = [0] * (capacity + 1)
    for n in lengths:
        counts[n] += 1
    ups, sums = [0] * (capacity + 2), [0] * (capacity + 2)
    for n in range(capacity, -1, -1):
        ups[n], sums[n] = ups[n + 1] + counts[n], sums[n + 1] + n * counts[n]
    best = -(-sums[0] // capacity)
    for t in range(1, capacity // 2 + 1):
        big = ups[capacity - t + 1]
        best = max(best, big - (-(sums[t] - sums[capacity - t + 1]) // capacity))
    for k in range(1, 21):
        total = 0  # in k * capacity-ths
        for n, c in enumerate(counts):
            if c:
                x = (k + 1) * n
                total += c * (k * n if x % capacity == 0 else (x // capacity) * capacity)
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in `lengths`: each piece, longest first, goes to the fullest bin it fits."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []  # sorted rooms of which there is a bin
    for i in order:
        n = lengths[i]
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[b].append(i)
        if left := room - n:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def pack_round(rows: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    """Packs rows in `groups` partitions; adds bin, offset, fill, and gap: bins above the partition's bound."""
    schema = "doc_id long, copy long, piece int, length long, grp int, bin int, offset long, fill long, gap int"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].tolist()
        bins = best_fit_decreasing(lengths, capacity)
        at, offset, fill = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        for k, own in enumerate(bins):
            used = sum(lengths[i] for i in own)
            place = 0
            for i in own:
                at[i], offset[i], fill[i] = k, place, used
                place += lengths[i]
        gap = len(bins) - lower_bound(lengths, capacity)
        return pdf.assign(bin=at, offset=offset, fill=fill, gap=gap)[["doc_id", "copy", "piece", "length", "grp", "bin", "offset", "fill", "gap"]]

    dealt = rows.select("doc_id", "copy", "piece", "length", F.pmod(F.xxhash64("doc_id", "copy", "piece", F.lit(salt)), F.lit(groups)).cast("int").alias("grp"))
    return dealt.groupBy("grp").applyInPandas(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece's place in a sequence.

    Sequence numbers are exact: a round's number, its partition and its bin side by side, and negative ones for whole pieces.
    """
    cut = common.Saved(pieces(docs, tokenizer, end_id, capacity), "pieces")
    whole = cut.df.where(F.col("length") == capacity)
    rest, n = cut.df.where(F.col("length") < capacity), cut.df.where(F.col("length") < capacity).count()
    placed = whole.select("copy", "piece", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    before = None
    for turn in range(MAX_ROUNDS if n else 0):
        groups = -(-n // PER_GROUP)
        done = common.Saved(pack_round(rest, groups, turn, capacity), f"round{turn}")
        gap = done.df.select("grp", "gap").distinct().agg(F.sum(F.greatest("gap", F.lit(0)))).first()[0] or 0
        # A partition at its bound is settled; of one above it only the filled bins are.
        last = groups == 1 or turn == MAX_ROUNDS - 1 or (before is not None and gap >= before)
        settled = F.lit(True) if last else (F.col("gap") <= 0) | (F.col("fill") == capacity)
        number = F.lit(turn << 58).cast("long").bitwiseOR(F.shiftleft(F.col("grp").cast("long"), 28)).bitwiseOR(F.col("bin").cast("long"))
        placed = placed.unionByName(done.df.where(settled).select("copy", "piece", number.alias("sequence_id"), "offset"))
        if last:
            break
        rest = done.df.where(~settled)
        n, before = rest.count(), gap
        if not n:
            break
    return cut.df.join(placed, ["copy", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
