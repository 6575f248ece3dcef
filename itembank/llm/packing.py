"""Best-fit packing of token sequences after a linear grouping of the long ones."""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itembank.llm import words
from itembank.llm.common import held, releasing, written

CAPACITY = 4096
#: Pieces of at least a sixteenth of a sequence are long; they form this many groups of equal cardinality.
LONG_SHARE, GROUPS = 16, 512
#: Pieces that one packing task takes, about; the last sequences of each task are its only loss against packing all at once.
SHARD_ROWS = 24_000
#: Distinct words that a worker remembers the ids of; the memory is emptied when full. Longer ones (bytes) are encoded each time.
CACHE_WORDS, CACHE_BYTES = 600_000, 256
#: Ids that the memory may hold; it is emptied when it has more, even if it has few words.
CACHE_IDS = 4_000_000
#: Marks that end a word and that the tokenizer always cuts off it.
TAIL = ".,;:!?%&$*#)(\"]["
#: Fixed value: Unicode's white space without the separators U+001C to U+001F, which str.split() takes for white space and tokenizers don't.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A chunk that stands between others when many are encoded in one call.
_MARK = "\x01"
#: Words that are normal and whole to the tokenizer but for their case: these go to its model alone.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: How a byte-level vocabulary writes bytes: printable Latin-1 characters as they are, the other bytes in turn from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) if b in _PRINTED else chr(256 + k) for k, b in enumerate([b for b in range(256) if b not in _PRINTED] + _PRINTED)}


#: By byte: a mark of TAIL, an ASCII letter, the second byte of a Latin-1 letter.
_TAIL_BYTES = np.array([chr(b) in TAIL for b in range(256)])
_LETTER_BYTES = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])
_LATIN_BYTES = np.array([0x80 <= b < 0xC0 and chr(b + 0x40).isalpha() for b in range(256)])


class Grown:
    """An array that grows at its end, in room that doubles."""

    def __init__(self, dtype: str) -> None:
        self.room, self.n = np.zeros(1024, dtype=dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            room = np.zeros(max(2 * len(self.room), self.n + len(more)), dtype=self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


class Encoder:
    """Token ids of text columns.

    Where the tokenizer drops white space and never joins across it, each distinct word between white space is encoded once and
    then looked up by a 64-bit hash of its bytes, for many texts at a time; a few probes tell, for each white-space character by
    itself: texts are split only where the tokenizer is shown to drop it. Marks at the end are words of their own, and capitals
    count as small letters, only where the tokenizer is shown to cut these marks off and to lower-case. Other tokenizers encode
    whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        self.model = self.tokenizer.model
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        probes = ("Word", "été", "don't", "x.")
        self.by_chunks = all(ids(f" {a}\n {b} ") == ids(a) + ids(b) for a in probes for b in probes)
        dropped = [c for c in SPACES if all(ids(f"{a}{c}{b}") == ids(a) + ids(b) and ids(f"{c}{a}{c}") == ids(a) for a in probes for b in probes)]
        self.by_chunks = self.by_chunks and " " in dropped
        self.narrow, self.leads, self.wide = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), []
        for c in dropped:
            code = c.encode()
            if len(code) == 1:
                self.narrow[code[0]] = True
            else:
                self.leads[code[0]] = True
                self.wide.append(code)
        lower = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else lambda t: t
        self.lowers = all(lower(c) == c.lower() for c in map(chr, range(0x21, 0x7F))) and ids("Hello") == ids("hello")
        tails = [*TAIL, *(m + n for m in TAIL for n in TAIL)]
        self.cuts_tails = all(ids(a + t) == ids(a) + ids(t) for a in ("word", "x", "été") for t in tails)
        self.by_letters = self.lowers and all(lower(c) == c.lower() for c in map(chr, range(0xC0, 0x100)) if _LETTERS(c)) and all(ids(a) == [t.id for t in self.model.tokenize(self._spelled(a))] for a in probes[:2])
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _forget(self) -> None:
        """Chunks by number: where their ids begin in the pool, and how many there are."""
        self.seen, self.starts, self.sizes, self.pool = words.Seen(), Grown("int64"), Grown("int64"), Grown("<u4")

    @staticmethod
    def _spelled(word: str) -> str:
        word = word.lower()
        return word if word.isascii() else "".join(map(_BYTES.__getitem__, word.encode()))

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """The ids of words without white space: letters by the model, others many to a call."""
        out: list[bytes] = [b""] * len(chunks)
        alone, plain = [], []
        for i, c in enumerate(chunks):
            if self.by_letters and _LETTERS(c):
                ids = [t.id for t in self.model.tokenize(self._spelled(c))]
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                (alone if _MARK in c or self.mark is None else plain).append(i)
        for lo in range(0, len(plain), 2000):
            part = plain[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_MARK} ".join(chunks[i] for i in part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                alone += part
                continue
            data, at = ids.tobytes(), [-1, *cuts.tolist(), len(ids)]
            for i, a, b in zip(part, at, at[1:]):
                out[i] = data[4 * a + 4 : 4 * b]
        for i in alone:
            out[i] = np.array(self.tokenizer.encode(chunks[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out

    def _spaces(self, data: np.ndarray) -> np.ndarray:
        space = self.narrow[data]
        lead = np.flatnonzero(self.leads[data])
        for code in self.wide if len(lead) else ():
            hit = lead[lead + len(code) <= len(data)]
            for k, byte in enumerate(code):
                hit = hit[data[hit + k] == byte]
            for k in range(len(code)):
                space[hit + k] = True
        return space

    def _cut_tails(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words with the marks at their ends as words of their own, and whether each word's capitals count as small letters."""
        plain = np.ones(len(starts), dtype=bool)
        special = np.searchsorted(starts, np.flatnonzero(data == ord("<")), "right") - 1
        plain[special] = False  # it may hold a special token
        todo = np.flatnonzero(plain & (ends - starts <= CACHE_BYTES) & _TAIL_BYTES[data[ends - 1]]) if self.cuts_tails and len(starts) else np.zeros(0, dtype=np.int64)
        core, at = ends.copy(), todo
        while len(at):
            core[at] -= 1
            at = at[core[at] > starts[at]]
            at = at[_TAIL_BYTES[data[core[at] - 1]]]
        todo = todo[core[todo] > starts[todo]]
        last = data[core[todo] - 1]
        todo = todo[_LETTER_BYTES[last] | (data[np.maximum(core[todo] - 2, 0)] == 0xC3) & _LATIN_BYTES[last]]
        n = np.ones(len(starts), dtype=np.int64)
        n[todo] = 2
        of, tail = np.repeat(np.arange(len(starts)), n), np.cumsum(n) - 1
        a, b = starts[of], ends[of]
        b[tail[todo] - 1] = a[tail[todo]] = core[todo]
        return a, b, row[of], plain[of] & self.lowers

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: np.ndarray) -> np.ndarray:
        """Each word's number, -1 for long words; new short words are encoded, and the memory gets their ids."""
        if self.sizes.n > CACHE_WORDS or self.pool.n > CACHE_IDS:
            self._forget()
        hashes = words.word_hashes(data, starts, ends)
        if not folded.all():
            hashes = np.where(folded, hashes, words.mix64(words.word_hashes(data, starts, ends, words.CASED)))
        short = ends - starts <= CACHE_BYTES
        number = np.where(short, self.seen.find(hashes), -1)
        new = np.flatnonzero((number < 0) & short)
        if len(new):
            distinct, first, of = np.unique(hashes[new], return_index=True, return_inverse=True)
            found = self._encode([data[starts[i] : ends[i]].tobytes().decode() for i in new[first].tolist()])
            known, size = self.sizes.n, np.array([len(x) // 4 for x in found], dtype=np.int64)
            self.starts.add(self.pool.n + np.cumsum(size) - size)
            self.sizes.add(size)
            self.pool.add(np.frombuffer(b"".join(found), dtype="<u4"))
            self.seen.add(distinct, known)
            number[new] = known + of
        return number

    def _by_words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' rows, their sizes, and all their ids in turn. Long words are encoded here and kept nowhere."""
        starts, ends, row = words.runs(~self._spaces(data), at)
        starts, ends, row, folded = self._cut_tails(data, starts, ends, row)
        number = self._numbers(data, starts, ends, folded)
        kept, long = number >= 0, np.flatnonzero(number < 0)
        own = [np.frombuffer(self._encode([data[starts[i] : ends[i]].tobytes().decode()])[0], dtype="<u4") for i in long.tolist()]
        size, begin = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
        size[kept], begin[kept] = self.sizes.room[number[kept]], self.starts.room[number[kept]]
        size[long] = [len(ids) for ids in own]
        before = np.cumsum(size) - size
        from_pool = np.arange(int(size.sum())) + np.repeat(begin - before, size)
        if not len(long):
            return row, size, self.pool.room[from_pool]
        remembered, ids = np.repeat(kept, size), np.empty(int(size.sum()), dtype="<u4")
        ids[remembered] = self.pool.room[from_pool[remembered]]
        ids[~remembered] = np.concatenate(own)
        return row, size, ids

    def encoded(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, ids and the rows' offsets in them, for groups of rows of a text column; each text's ids are followed by end_id. Null texts are empty."""
        for first, data, at in words.row_groups(column):
            n = len(at) - 1
            if self.by_chunks:
                row, size, said = self._by_words(data, at)
            else:
                texts = [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])]
                parts = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                row, size, said = np.arange(n), np.array([len(p) for p in parts], dtype=np.int64), np.concatenate(parts)
            to = np.concatenate(([0], np.cumsum(np.bincount(row, size, n).astype(np.int64) + 1)))
            ids = np.full(to[-1], end_id, dtype="<u4")
            ids[np.arange(len(said)) + np.repeat(row, size)] = said
            yield first, ids, to

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian, without an end."""
        return [ids[a : b - 1].tobytes() for _, ids, to in self.encoded(pa.array(texts, pa.string()), 0) for a, b in zip(to.tolist(), to[1:].tolist())]


def encoder_of(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return held(("encoder", path), lambda: Encoder(path))


def cut(to: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number, first id and number of ids of each piece of texts with these offsets."""
    n = np.diff(to)
    pieces = -(-n // capacity)
    text = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return text, piece, piece * capacity, np.minimum(capacity, n[text] - piece * capacity)


@releasing
def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(path)
    for batch in batches:
        for first, ids, to in encoder.encoded(batch.column(1), end_id):
            text, piece, start, length = cut(to, capacity)
            data = memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((to[text] + start).tolist(), (to[text] + start + length).tolist())]
            doc = batch.column(0).slice(first, len(to) - 1).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([doc.cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc", "piece", "start", "length", "crc"])


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc, piece, start, length, crc: every document's ids and end_id, cut only where they are more than a sequence holds."""
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return texts.mapInArrow(lambda it: _pieces(it, tokenizer, end_id, capacity), "doc long, piece int, start long, length long, crc long")


def _fullest(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each size fill the room best, larger sizes first: a bounded subset-sum over all rooms at once."""
    from_size = np.full(room + 1, -1, dtype=np.int32)  # the size that was last added to reach a sum
    from_size[0] = len(sizes)
    for k, size in enumerate(sizes):
        if size > room:
            continue
        for _ in range(min(left[k], room // size)):
            reach = np.flatnonzero((from_size[:-size] >= 0) & (from_size[size:] < 0))
            if not len(reach):
                break
            from_size[reach + size] = k
        if from_size[room] >= 0:
            break
    total, counts = int(np.flatnonzero(from_size >= 0)[-1]), [0] * len(sizes)
    while total:
        k = int(from_size[total])
        counts[k] += 1
        total -= sizes[k]
    return counts


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns over few sizes and how often each is used, until all counts are met. sizes: descending.

    Each pattern holds the largest size left and fills the rest as well as the sizes left can; it is used as often as they last.
    """
    left, plan = list(counts), []
    while any(left):
        top = next(k for k, n in enumerate(left) if n)
        left[top] -= 1
        pattern = _fullest(sizes, left, capacity - sizes[top])
        left[top] += 1
        pattern[top] += 1
        times = min(left[k] // n for k, n in enumerate(pattern) if n)
        for k, n in enumerate(pattern):
            left[k] -= n * times
        plan.append((pattern, times))
    return plan


def pack(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """A sequence number for each length.

    Long pieces are sorted and cut into groups of equal cardinality, each rounded up to its longest; patterns over these few
    sizes are chosen; the pieces of a group take its places in the patterns. Then short pieces, longest first, each go where the
    least room is left that holds them.
    """
    order = np.argsort(-lengths, kind="stable")
    is_long = lengths[order] * LONG_SHARE >= capacity
    long, short = order[is_long], order[~is_long]
    sequence, free = np.full(len(lengths), -1, dtype=np.int64), []
    if len(long):
        step = max(1, -(-len(long) // groups))
        by_size: dict[int, list[np.ndarray]] = defaultdict(list)
        for lo in range(0, len(long), step):
            by_size[int(lengths[long[lo]])].append(long[lo : lo + step])
        sizes = sorted(by_size, reverse=True)
        pieces = [np.concatenate(by_size[s]) for s in sizes]
        taken = [0] * len(sizes)
        for pattern, times in configurations(sizes, [len(p) for p in pieces], capacity):
            first, room = len(free), np.full(times, capacity)
            for k, n in enumerate(pattern):
                for _ in range(n):
                    part = pieces[k][taken[k] : taken[k] + times]
                    taken[k] += times
                    sequence[part] = first + np.arange(times)
                    room -= lengths[part]
            free += room.tolist()
    where: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set while some sequence has room r
    for i, room in enumerate(free):
        where[room].append(i)
        rooms |= 1 << room
    for i in short:
        size = int(lengths[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            at = where[room].pop()
            if not where[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(free)
            free.append(capacity)
        sequence[i] = at
        where[room - size].append(at)
        rooms |= 1 << (room - size)
    return sequence


def _packed(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(["known", "doc", "piece", "crc"], kind="stable").reset_index(drop=True)
    sequence = pack(frame["length"].to_numpy(), capacity)
    frame["sequence_id"] = (frame["shard"].to_numpy(dtype=np.int64) << 32) + sequence
    frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
    return frame


def best_fit_packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents become their token ids and end_id; those longer than a sequence are cut into whole sequences and a rest. Pieces are
    dealt by hash over shards of about SHARD_ROWS, each packed on its own by pack(); pieces that fill a sequence have one to
    themselves. Texts are not shuffled, only the lengths are.

    Nulls: a null or empty text is end_id alone; a null id is kept and packed like any other. Ties (equal lengths) go by id, so
    reruns agree. Repeated rows are packed each. Empty table: no rows. Other columns are not read.
    """
    pieces = written(token_pieces(docs, tokenizer, id_col, text_col, end_id, capacity), "pack-pieces")
    shards = max(1, -(-pieces.count() // SHARD_ROWS))
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(-1).cast("long") - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("doc", "piece", "crc"), F.lit(shards)))
    rest = rest.withColumn("known", F.col("doc").isNotNull()).withColumn("doc", F.coalesce("doc", F.lit(0)))  # pandas would make longs with nulls doubles
    rest = rest.groupBy("shard").applyInPandas(lambda frame: _packed(frame, capacity), "doc long, piece int, start long, length long, crc long, shard long, known boolean, sequence_id long, offset long")
    out = rest.withColumn("doc", F.when(F.col("known"), F.col("doc"))).drop("known", "shard").unionByName(whole)
    return out.select(F.col("doc").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def default_tokenizer() -> str:
    """The place of the tokenizer file that the query names; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(docs: DataFrame) -> DataFrame:
    return best_fit_packing(docs, default_tokenizer())
