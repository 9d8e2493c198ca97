"""Token-ID output: a wavelet matrix per shard.

Texts become token ids with an end id after each document. A shard holds the ids of consecutive documents as bit-planes
in one file. Each plane is cut into blocks, which are compressed one by one behind a directory of their places and of the
ones before them, so that a token is read, counted or found by inflating a block or two a plane and nothing else. Spark
sorts documents into ranges of ids, encodes each range in its task and writes a file a shard; it looks tokens up by
sending queries to shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import TASK_MEMORY, _K, give_back, hash_spans, mix64, shared_dir, small_batches, text_buffers

#: Tokens after which a shard is closed; a document is never cut, so one with more has a shard for itself.
SHARD_TOKENS = 2_000_000
#: Bytes of a plane's block before compression.
BLOCK_BYTES = 4096
#: Bytes of text that a task encodes at once, bytes that a worker may remember pieces' ids in, and the longest piece remembered.
SLICE, REMEMBERED, LONGEST = 1_000_000, 24 << 20, 64
#: Pieces that the library encodes in one text, and texts that it encodes in one call: its results take a hundred bytes a token.
JOINED, CALL = 256, 16
END_ID = 0
#: Stands for a null id in shards.
NO_ID = -(2**63)
MAGIC = b"WVM2"


def _bytes(*ranges: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[b for r in ranges for b in r]] = True
    return table


#: Bytes that are white space, or begin a character that may be.
_MAYBE_WHITE = _bytes(range(0x09, 0x0E), range(0x1C, 0x21), (0xC2, 0xE1, 0xE2, 0xE3))
_ALNUM = _bytes(b"0123456789", range(0x41, 0x5B), range(0x61, 0x7B))
#: Bytes of the letters from A to U+017F, with U+00D7 and U+00F7, which are none; bytes of other characters begin with others.
_LETTER = _bytes(range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0xC0), (0xC3, 0xC4, 0xC5))
#: The character that stands for each byte in a byte-level vocabulary.
_SHOWN = np.arange(256, dtype="<u4")
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
_SHOWN[_HIDDEN] = 256 + np.arange(len(_HIDDEN))


# ---- the structure


def encode_matrix(ids: np.ndarray) -> bytes:
    """ids as a file: the number of ids and of planes, each plane's zeros, the blocks' directory, and the blocks."""
    rest = ids.astype(np.uint32 if len(ids) and int(ids.max()) > 0xFFFF else np.uint16)
    levels = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    zeros, ones_before, sizes, blocks = [], [], [], []
    pack = zstandard.ZstdCompressor(level=1)
    for bit in range(levels - 1, -1, -1):
        ones = (rest & rest.dtype.type(1 << bit)) != 0
        plane = np.packbits(ones, bitorder="little")
        starts = range(0, len(plane), BLOCK_BYTES)
        counts = np.add.reduceat(np.bitwise_count(plane), list(starts), dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
        ones_before.append(np.concatenate([[0], np.cumsum(counts)]))
        for a in starts:
            blocks.append(pack.compress(plane[a : a + BLOCK_BYTES].tobytes()))
            sizes.append(len(blocks[-1]))
        zeros.append(len(rest) - int(ones_before[-1][-1]))
        # places, as a mask that is as good as random is slow to select by
        rest = np.concatenate([rest.take(np.flatnonzero(~ones)), rest.take(np.flatnonzero(ones))])
    directory = np.concatenate([[len(ids), levels], zeros, *ones_before, np.cumsum([0, *sizes])]).astype("<i8")
    return MAGIC + directory.tobytes() + b"".join(blocks)


class WaveletMatrix:
    """Bit-planes of a sequence of ids, most significant bit first; each plane is ordered stably by the bits above it.

    Blocks stay compressed until something asks for them.
    """

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        self.blob = memoryview(blob)
        self.n, levels = (int(x) for x in np.frombuffer(blob, "<i8", 2, 4))
        self.zeros = np.frombuffer(blob, "<i8", levels, 20).tolist()
        self.blocks = -(-self.n // (8 * BLOCK_BYTES))
        at = 20 + 8 * levels
        self.ones_before = np.frombuffer(blob, "<i8", levels * (self.blocks + 1), at).reshape(levels, -1)
        at += self.ones_before.nbytes
        self.places = np.frombuffer(blob, "<i8", levels * self.blocks + 1, at)
        self.body = at + self.places.nbytes
        self.inflate = zstandard.ZstdDecompressor()

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        return cls(encode_matrix(ids))

    def block(self, level: int, number: int) -> np.ndarray:
        at = level * self.blocks + number
        return np.frombuffer(self.inflate.decompress(self.blob[self.body + int(self.places[at]) : self.body + int(self.places[at + 1])]), np.uint8)

    def _is_one(self, value: int, level: int) -> int:
        return value >> (len(self.zeros) - 1 - level) & 1

    def _ones(self, level: int, at: int) -> tuple[int, int]:
        """Ones among the first at bits of a plane, and the bit after them."""
        number, left = divmod(at, 8 * BLOCK_BYTES)
        count = int(self.ones_before[level, number])
        if number == self.blocks:
            return count, 0
        plane = self.block(level, number)
        full, bits = divmod(left, 8)
        count += int(np.bitwise_count(plane[:full]).sum())
        last = int(plane[full]) if full < len(plane) else 0
        return count + (last & ((1 << bits) - 1)).bit_count(), last >> bits & 1

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, zeros in enumerate(self.zeros):
            ones, bit = self._ones(level, at)
            value = value << 1 | bit
            at = zeros + ones if bit else at - ones
        return value

    def _range(self, value: int, at: int) -> tuple[int, int]:
        """Where the occurrences of an id among the first at ids stand in the order after the last plane."""
        if value < 0 or value >> len(self.zeros):
            return 0, 0
        start = 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, start)[0], self._ones(level, at)[0]
            start, at = (zeros + a, zeros + b) if self._is_one(value, level) else (start - a, at - b)
            if start == at:
                return 0, 0
        return start, at

    def rank(self, value: int, at: int) -> int:
        """How often an id stands among the first at ids."""
        start, end = self._range(value, at)
        return end - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The position of an id's k-th occurrence, from 0."""
        start, end = self._range(value, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        return int(self._up(value, np.array([start + k]))[0])

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of an id, ascending."""
        return self._up(value, np.arange(*self._range(value, self.n)))

    def _up(self, value: int, at: np.ndarray) -> np.ndarray:
        """Places in the order after the last plane as places in the sequence."""
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = self._is_one(value, level)
            at = self._select_bits(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _select_bits(self, level: int, bit: int, wanted: np.ndarray) -> np.ndarray:
        """The places in a plane of its wanted-th ones, or zeros; wanted ascends."""
        ones = self.ones_before[level]
        counts = ones if bit else np.arange(self.blocks + 1) * 8 * BLOCK_BYTES - ones
        number = np.searchsorted(counts, wanted, side="right") - 1
        out = np.empty_like(wanted)
        edges = np.flatnonzero(np.diff(number, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(wanted)], strict=False):
            own = int(number[a])
            held = np.flatnonzero(np.unpackbits(self.block(level, own), bitorder="little") == bit)
            out[a:b] = own * 8 * BLOCK_BYTES + held[wanted[a:b] - counts[own]]
        return out

    def decode(self) -> np.ndarray:
        """All ids: the stable orders of the planes undone from the last to the first."""
        values = np.zeros(self.n, np.uint32 if len(self.zeros) > 16 else np.uint16)
        for level in range(len(self.zeros) - 1, -1, -1):
            if not self.n:
                break
            plane = np.concatenate([self.block(level, k) for k in range(self.blocks)])
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            out = np.empty_like(values)
            out[np.flatnonzero(~ones)] = values[: self.zeros[level]]
            out[np.flatnonzero(ones)] = values[self.zeros[level] :] | values.dtype.type(1 << (len(self.zeros) - 1 - level))
            values = out
        return values


# ---- text to ids


class Memory:
    """The ids of pieces seen before, under two hashes of the piece, in a table of bounded size. A piece has two slots; who takes one stays."""

    #: Bytes of a slot and of the ids of a piece in it, about.
    ENTRY = 30

    def __init__(self):
        self.h1, self.h2, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.used = 0

    def _slots(self, h2: np.ndarray) -> Iterator[np.ndarray]:
        for shift in (0, 24):
            yield ((h2 >> np.uint64(shift)) & np.uint64(len(self.h1) - 1)).astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each piece's place here, or -1."""
        out = np.full(len(h1), -1)
        rest = np.arange(len(h1) if len(self.h1) else 0)
        for k in range(2):
            at = list(self._slots(h2[rest]))[k] if len(rest) else rest
            met = (self.h1[at] == h1[rest]) & (self.h2[at] == (h2[rest] >> np.uint64(32)))
            out[rest[met]] = at[met]
            rest = rest[~met]
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """New pieces, each once and none without ids; what finds no slot, or is over the bound, isn't taken."""
        if not len(self.h1):
            slots = 1 << max(0, (REMEMBERED // self.ENTRY).bit_length() - 1)
            self.h1, self.h2, self.start, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32), np.zeros(slots, np.int32), np.zeros(slots, np.uint8)
            self.ids = np.zeros((REMEMBERED - sum(x.nbytes for x in (self.h1, self.h2, self.start, self.size))) // ids.itemsize, ids.dtype)
        first = np.cumsum(size) - size
        for slot in self._slots(h2):
            new = np.flatnonzero((self.size[slot] == 0) & (size > 0))
            new = new[np.unique(slot[new], return_index=True)[1]]
            new = new[: np.searchsorted(np.cumsum(size[new]), len(self.ids) - self.used, side="right")]
            taken, at = size[new], slot[new]
            self.h1[at], self.h2[at], self.size[at] = h1[new], h2[new] >> np.uint64(32), taken
            self.start[at] = self.used + np.cumsum(taken) - taken
            self.ids[self.used : self.used + taken.sum()] = gather(first[new], taken, ids)
            self.used += int(taken.sum())
            size = size.copy()
            size[new] = 0


def gather(start: np.ndarray, size: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """The spans of pool one after the other."""
    ends = np.cumsum(size)
    width = np.int32 if len(pool) < 2**31 and (not len(ends) or ends[-1] < 2**31) else np.int64
    places = np.repeat((start - (ends - size)).astype(width), size)
    places += np.arange(len(places), dtype=width)
    return pool[places]


def _in_order(came: np.ndarray, size: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """The spans of pool, which stand there in the order of came, by their numbers."""
    start = np.zeros(len(size), np.int64)
    start[came] = np.cumsum(size[came]) - size[came]
    return gather(start, size, pool)


def _white(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, bytes) of each white space character of UTF-8, of any script."""
    at = np.flatnonzero(_MAYBE_WHITE[raw])
    b, c, d = (np.concatenate([raw, np.zeros(2, np.uint8)])[at + k] for k in range(3))
    wide = ((b == 0xE2) & (((c == 0x80) & ((d <= 0x8A) | np.isin(d, (0xA8, 0xA9, 0xAF)))) | ((c == 0x81) & (d == 0x9F)))) | ((b == 0xE1) & (c == 0x9A) & (d == 0x80)) | ((b == 0xE3) & (c == 0x80) & (d == 0x80))
    width = np.where(b < 0x80, 1, 2 * ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) + 3 * wide)
    return at[width > 0], width[width > 0]


def _odd(words: pa.Array) -> np.ndarray:
    """Which words are empty or have white space, of any script, at an end."""
    raw, offsets = text_buffers(words)
    at, width = _white(raw)
    out = offsets[1:] == offsets[:-1]
    word = np.searchsorted(offsets, at, side="right") - 1
    out[word[(at == offsets[word]) | (at + width == offsets[word + 1])]] = True
    return out


class Encoder:
    """Ids of texts by the tokenizers library, which sees each different piece of a slice of texts once.

    A text is cut before a space between two other characters. A byte-level pre-tokenizer always parts there, with the
    space at the head of what follows, so the ids of the pieces are those of the text. For the same reason a piece may
    be cut around a single line feed, and between letters and a run of plain punctuation that ends it; and pieces can be
    encoded together with a line feed between them. A piece of Latin letters alone is one piece for the pre-tokenizer, too,
    so it goes to the library's model directly. Another kind of tokenizer is refused.
    """

    #: Punctuation that ends a piece; without the apostrophe, which can begin an ending of its own.
    MARKS = '.,;:!?%*&$#@|"()[]{}<>/+=~^_-'

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = made = Tokenizer.from_file(path)
        before = made.pre_tokenizer
        feed = made.encode("\n", add_special_tokens=False).ids
        added = made.get_added_tokens_decoder().values()
        apart = all(t.content and not any(c.isspace() for c in t.content) and not (t.lstrip or t.rstrip or t.single_word) for t in added)
        plain = made.normalizer is None and made.truncation is None and made.padding is None and len(feed) == 1 and apart
        if not plain or not isinstance(before, ByteLevel) or not before.use_regex or before.add_prefix_space:
            raise ValueError(f"{path}: texts can be cut for a plain byte-level tokenizer only")
        self.feed = feed[0]
        self.added = [t.content for t in added]
        self.dtype = np.uint16 if max(made.get_vocab().values()) <= 0xFFFF else np.uint32
        self._marks = _bytes(self.MARKS.encode())
        self.known = Memory()
        self._take_model()

    def _take_model(self) -> None:
        """The library's model without its pre-tokenizer, and a byte to part pieces that no longer entry of the vocabulary holds; None where there is none."""
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.bare, model, vocab = None, self.tokenizer.model, self.tokenizer.get_vocab(with_added_tokens=False)
        if not isinstance(model, BPE) or model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix:
            return
        used = set("".join(v for v in vocab if len(v) > 1))
        parting = [b for b in range(128) if not chr(b).isalpha() and b != 0x20 and chr(_SHOWN[b]) in vocab and chr(_SHOWN[b]) not in used]
        if parting:
            self.bare, self.parting, self.parting_id = Tokenizer(model), parting[0], vocab[chr(_SHOWN[parting[0]])]

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this process, so that a task finds what earlier tasks of a worker have seen; its memory is bounded."""
        import sys
        import types

        memory = vars(sys.modules.setdefault(TASK_MEMORY, types.ModuleType(TASK_MEMORY)))
        if memory.get("path") != path:
            memory.update(path=path, encoder=cls(path))
        return memory["encoder"]

    @staticmethod
    def pieces(text: str) -> list[str]:
        """A text cut where white space isn't a single space too: parts that touch more than one join their neighbours."""
        parts = text.split(" ")
        out, glue = [parts[0]], not parts[0] or parts[0][-1].isspace()
        for p in parts[1:]:
            if glue or not p or p[0].isspace():
                out[-1] += " " + p
            else:
                out.append(" " + p)
            glue = not p or p[-1].isspace()
        return out

    def _parts(self, word: str, spaced: bool) -> list[tuple[str, bool]]:
        """A word as pieces (text, whether a space goes before)."""
        if word[-1:].isalpha() and "\n" not in word:
            return [(word, spaced)]
        lines = word.split("\n") if "\n" in word and not any(c.isspace() for c in word.replace("\n", "")) and "\n\n" not in word else [word]
        out = []
        for i, line in enumerate(lines):
            if i:
                out.append(("\n", False))
            stem = line.rstrip(self.MARKS)
            cut = len(stem) < len(line) and stem.isalpha()
            out += [(stem, spaced and not i), (line[len(stem) :], False)] if cut else [(line, spaced and not i)]
        return out

    def _called(self, texts: list[str], tokenizer=None) -> Iterator[np.ndarray]:
        """The ids of each text, from the library."""
        for a in range(0, len(texts), CALL):
            for e in (tokenizer or self.tokenizer).encode_batch_fast(texts[a : a + CALL], add_special_tokens=False):
                yield np.array(e.ids, self.dtype)

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids), from the library, of pieces without white space but for a space before."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, self.dtype)
        ids = np.concatenate(list(self._called(["\n".join(pieces[a : a + JOINED]) + "\n" for a in range(0, len(pieces), JOINED)])))
        feeds = ids == self.feed
        return np.diff(np.flatnonzero(feeds), prepend=-1) - 1, ids[~feeds]

    def _letters(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids), from the library's model, of pieces of letters alone but for a space before."""
        ends = np.cumsum(lengths + spaced + 1)
        shown = np.full(ends[-1], self.parting, np.uint8)
        body = np.ones(len(shown), bool)
        body[ends - 1] = False
        heads = (ends - 1 - lengths - spaced)[spaced]
        shown[heads], body[heads] = 0x20, False
        shown[body] = gather(starts, lengths, raw)
        text = _SHOWN[shown].tobytes().decode("utf-32-le")
        cuts = [0, *ends[JOINED - 1 :: JOINED].tolist()]
        texts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if a < b]
        ids = np.concatenate(list(self._called(texts, self.bare)))
        parted = ids == self.parting_id
        return np.diff(np.flatnonzero(parted), prepend=-1) - 1, ids[~parted]

    def _fresh(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids), from the library."""
        single = [i for i, p in enumerate(pieces) if p.removeprefix(" ").split() != [p.removeprefix(" ")]]
        alone = set(single)
        order = [i for i in range(len(pieces)) if i not in alone]
        sizes = np.zeros(len(pieces), np.int64)
        sizes[order], joined = self._together([pieces[i] for i in order])
        found = [joined]
        for own, i in zip(self._called([pieces[i] for i in single]), single, strict=True):
            sizes[i] = len(own)
            found.append(own)
        return sizes, _in_order(np.array([*order, *single], np.int64), sizes, np.concatenate(found))

    def _looked_up(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, spaced: np.ndarray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, pool) of each span of the padded bytes: from memory, and what it lacks from make(spans' numbers), which it then learns."""
        h1, h2 = (mix64(hash_spans(raw, starts, lengths, k) + spaced.astype(np.uint64)) for k in (_K, _K ^ np.uint64(0x5DEECE66C)))
        at = self.known.find(h1, h2)
        new = np.flatnonzero(at < 0)
        start, size = self.known.start[at].astype(np.int64) if len(self.known.start) else np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        held = at >= 0
        size[held] = self.known.size[at[held]]
        pool = self.known.ids[: self.known.used]
        if len(new):
            _, first, same = np.unique(h1[new], return_index=True, return_inverse=True)
            if (h2[new] != h2[new[first]][same]).any():
                first = same = np.arange(len(new))
            once = new[first]
            sizes, ids = make(once)
            start[new], size[new] = (len(pool) + np.cumsum(sizes) - sizes)[same], sizes[same]
            pool = np.concatenate([pool, ids])
            short = lengths[once] <= LONGEST
            self.known.add(h1[once][short], h2[once][short], sizes[short], ids[np.repeat(short, sizes)])
        return start, size, pool

    def _by_arrays(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, feeds: np.ndarray, counts: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids) of words, from begin to end in the padded bytes, of counts lines with a line feed between each two and no other white space."""
        begins, ends = np.sort(np.concatenate([begin, feeds + 1])), np.sort(np.concatenate([end, feeds]))
        firsts = np.cumsum(counts) - counts
        first = np.zeros(len(begins), bool)
        first[firsts] = True
        # a line's punctuation is a piece of its own behind a letter or digit
        last = np.maximum.accumulate(np.where(self._marks[raw], 0, np.arange(1, len(raw) + 1, dtype=np.int32)))
        stems = np.maximum(last[ends - 1], begins)
        other = ~_LETTER[raw]
        cross = np.flatnonzero(raw[:-1] == 0xC3)
        other[cross] = (raw[cross + 1] == 0x97) | (raw[cross + 1] == 0xB7)
        tail, lead = raw[stems - 1], raw[stems - 2]
        letter = np.where(tail < 0x80, _ALNUM[tail], (lead >= 0xC3) & (lead <= 0xC5) & ~other[stems - 2])
        marked = (stems > begins) & (stems < ends) & letter
        stems = np.where(marked, stems, ends)
        others = np.concatenate([[0], np.cumsum(other, dtype=np.int32)])
        starts, stops = np.concatenate([begins, stems[marked]]), np.concatenate([stems, ends[marked]])
        space = np.concatenate([first & spaced, np.zeros(int(marked.sum()), bool)])

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            plain = (others[starts[new]] == others[stops[new]]) & (self.bare is not None)
            came, sizes, pools = [new[~plain]], np.zeros(len(starts), np.int64), []
            data = raw.tobytes()
            sizes[came[0]], ids = self._together([" " * s + data[a:b].decode() for a, b, s in zip(*(x[came[0]].tolist() for x in (starts, stops, space)), strict=True)])
            pools.append(ids)
            if plain.any():
                came.append(new[plain])
                sizes[came[1]], ids = self._letters(raw, starts[came[1]], (stops - starts)[came[1]], space[came[1]])
                pools.append(ids)
            place = np.zeros(len(starts), np.int64)
            place[new] = np.arange(len(new))
            return sizes[new], _in_order(place[np.concatenate(came)], sizes[new], np.concatenate(pools))

        a, n, pool = self._looked_up(raw, starts, stops - starts, space, make)
        # before each line but a word's first one a line feed, the last id of the pool
        start, size = np.zeros((len(begins), 3), np.int64), np.zeros((len(begins), 3), np.int64)
        start[:, 0], size[:, 0] = len(pool), ~first
        start[:, 1], size[:, 1] = a[: len(begins)], n[: len(begins)]
        start[marked, 2], size[marked, 2] = a[len(begins) :], n[len(begins) :]
        return np.add.reduceat(size.sum(axis=1), firsts), gather(start.ravel(), size.ravel(), np.append(pool, self.dtype(self.feed)))

    def _one_by_one(self, words: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids) of any words."""
        numbers: dict[tuple[str, bool], int] = {}
        used, counts = [], []
        for word in words:
            parts = self._parts(word, spaced)
            counts.append(len(parts))
            used += [numbers.setdefault(p, len(numbers)) for p in parts]
        pieces = list(numbers)
        raw, offsets = text_buffers(pa.array([p for p, _ in pieces], pa.string()))
        padded, flags = np.concatenate([raw, np.zeros(8, np.uint8)]), np.array([s for _, s in pieces], bool)
        start, size, pool = self._looked_up(padded, offsets[:-1], np.diff(offsets), flags, lambda new: self._fresh([" " * pieces[i][1] + pieces[i][0] for i in new.tolist()]))
        return np.add.reduceat(size[used], np.cumsum(counts) - counts), gather(start[used], size[used], pool)

    def resolve(self, words: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, pool): the span of ids of each of the different words, with or without a space before it."""
        raw, offsets = text_buffers(words)
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        at, _ = _white(raw)
        word = np.searchsorted(offsets, at, side="right") - 1
        feed = raw[at] == 0x0A
        odd = _odd(words)
        odd[word[~feed]] = True
        feeds, word = at[feed], word[feed]
        odd[word[1:][np.diff(feeds) == 1]] = True
        for content in self.added:
            odd |= pc.match_substring(words, content).to_numpy(zero_copy_only=False)
        size, came, pools = np.zeros(len(words), np.int64), [np.flatnonzero(~odd), np.flatnonzero(odd)], []
        if len(came[0]):
            own = ~odd[word]
            counts = 1 + np.bincount(word[own], minlength=len(words))[came[0]]
            size[came[0]], ids = self._by_arrays(padded, offsets[:-1][came[0]], offsets[1:][came[0]], feeds[own], counts, spaced)
            pools.append(ids)
        if len(came[1]):
            size[came[1]], ids = self._one_by_one(words.take(pa.array(came[1])).to_pylist(), spaced)
            pools.append(ids)
        order = np.concatenate(came)
        start = np.zeros(len(words), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return start, size, np.concatenate(pools) if pools else np.zeros(0, self.dtype)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text) of a string column without nulls."""
        if not len(column):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        lists = pc.split_pattern(column, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        index = coded.indices.to_numpy().astype(np.int64)
        odd = _odd(coded.dictionary)
        strange = np.add.reduceat(odd[index], offsets[:-1]) > 0
        # of each text the first word has no space before it; texts with odd white space are cut by pieces()
        own = [self.pieces(t) if s else None for s, t in zip(strange.tolist(), column.to_pylist() if strange.any() else [None] * len(column), strict=True)]
        heads = pa.array([p for ps in own if ps for p in ps], pa.string())
        ordinary = np.repeat(~strange, np.diff(offsets))
        begins = np.zeros(len(index), bool)
        begins[offsets[:-1]] = True
        firsts = pa.concat_arrays([coded.dictionary.take(pa.array(index[begins & ordinary])), heads]).dictionary_encode()
        a, n, pool = self.resolve(coded.dictionary, True)
        a2, n2, pool2 = self.resolve(firsts.dictionary, False)
        start, size, pool = np.concatenate([a, a2 + len(pool)]), np.concatenate([n, n2]), np.concatenate([pool, pool2])
        index[begins & ordinary] = len(a) + firsts.indices.to_numpy()[: int((~strange).sum())]
        if strange.any():
            pieces = iter((len(a) + firsts.indices.to_numpy()[int((~strange).sum()) :]).tolist())
            rows = [[next(pieces) for _ in ps] if ps else index[offsets[i] : offsets[i + 1]] for i, ps in enumerate(own)]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            index = np.concatenate([np.asarray(r, np.int64) for r in rows])
        each = size[index]
        before = np.concatenate([[0], np.cumsum(each)])
        return gather(start[index], each, pool), before[offsets[1:]] - before[offsets[:-1]]


def _sharded(path: str, shard_tokens: int):
    names = ["first_id", "doc_ids", "lengths", "n_docs", "n_tokens", "matrix"]

    def row(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        cols = [[int(keys[0])], [keys.tobytes()], [lengths.tobytes()], [len(keys)], [len(ids)], [encode_matrix(ids)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder.of(path)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, encoder.dtype))]
        waiting = 0
        try:
            for batch in _gathered(batches, SLICE):
                for part in _slices(batch, SLICE):
                    own, sizes = encoder.encode(part.column(1))
                    held.append((pc.fill_null(part.column(0), NO_ID).to_numpy(), sizes + 1, np.insert(own, np.cumsum(sizes), END_ID)))
                    waiting += len(held[-1][2])
                    if waiting <= shard_tokens:
                        continue
                    keys, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                    held = own = sizes = None
                    give_back(keep=True)
                    while len(ids) > shard_tokens and len(keys) > 1:
                        n = max(1, int(np.searchsorted(np.cumsum(lengths), shard_tokens, side="right")))
                        at = int(lengths[:n].sum())
                        yield row(keys[:n], lengths[:n], ids[:at])
                        keys, lengths, ids = keys[n:], lengths[n:], ids[at:]
                    held, waiting = [(keys.copy(), lengths.copy(), ids.copy())], len(ids)
            keys, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held = own = sizes = None
            give_back(keep=True)
            if len(keys):
                yield row(keys, lengths, ids)
        finally:
            batch = part = own = sizes = keys = lengths = ids = held = None
            give_back(keep=True)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have size bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about size bytes of text."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write docs' ids below path, one file for each shard, in ascending doc_id order over all shards.

    tokenizer is a file of a plain byte-level tokenizer; any other raises. A null or empty text has the end id alone.
    Null ids come first; rows that share an id stand next to each other, ordered by text. A text of any length is
    encoded whole and stands in one shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = slim.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards = ordered.mapInArrow(_sharded(tokenizer, shard_tokens), "first_id long, doc_ids binary, lengths binary, n_docs long, n_tokens long, matrix binary")
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard files below path: (file, start, first_id, doc_ids, lengths, n_docs, n_tokens, matrix); start counts the ids of all shards before."""
    shards = spark.read.parquet(path).withColumn("file", F.input_file_name())
    # a row a shard, that is, one for millions of tokens
    place = F.sum("n_tokens").over(Window.orderBy(F.col("first_id"), F.col("file")).rowsBetween(Window.unboundedPreceding, -1))
    starts = shards.select("file", "first_id", "n_tokens").select("file", F.coalesce(place, F.lit(0)).cast("long").alias("start"))
    return shards.join(starts, "file")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, keys, lengths, blob in zip(*(batch.column(k).to_pylist() for k in ("start", "doc_ids", "lengths", "matrix")), strict=True):
            ids = WaveletMatrix(blob).decode().astype("<u4")
            sizes = np.frombuffer(lengths, np.int64)
            ends = np.cumsum(sizes)
            known = np.frombuffer(keys, np.int64)
            raw = memoryview(ids).cast("B")
            crc = np.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(known, mask=known == NO_ID), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )
    give_back(keep=True)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the shard files below path."""
    return read_shards(spark, path).select("start", "doc_ids", "lengths", "matrix").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _per_shard(answer, schema: pa.Schema):
    """answer(matrix, start) gives columns of schema for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, blob in zip(batch.column("start").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(answer(WaveletMatrix(blob), start), schema, strict=True)], schema=schema)

    return run


def count_tokens(spark: SparkSession, path: str, tokens: Iterable[int]) -> DataFrame:
    """(token, n): how often each of the given tokens stands in the shards below path; zeros too. Repeated tokens count once."""
    asked = sorted(set(tokens))
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])
    found = read_shards(spark, path).select("start", "matrix").mapInArrow(_per_shard(lambda m, _: (asked, [m.count(t) for t in asked]), schema), "token long, n long")
    every = spark.createDataFrame([(t,) for t in asked], "token long")
    return every.join(found.groupBy("token").agg(F.sum("n").alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def find_tokens(spark: SparkSession, path: str, tokens: Iterable[int]) -> DataFrame:
    """(token, position): every occurrence of the given tokens in the shards below path, counted over all shards from 0."""
    asked = sorted(set(tokens))
    schema = pa.schema([("token", pa.int64()), ("position", pa.int64())])

    def answer(m: WaveletMatrix, start: int):
        places = [m.occurrences(t) for t in asked]
        return np.repeat(np.array(asked, np.int64), [len(p) for p in places]), start + np.concatenate(places) if places else []

    return read_shards(spark, path).select("start", "matrix").mapInArrow(_per_shard(answer, schema), "token long, position long")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token) of each row of positions (position) within the shards below path; others, and nulls, give nothing.

    Positions meet their shard by equality of ranges of SHARD_TOKENS ids, and go to it in sorted lists.
    """
    shards = read_shards(spark, path)
    spans = shards.select("file", "start", "n_tokens", F.explode(F.sequence(F.floor(F.col("start") / SHARD_TOKENS), F.floor((F.col("start") + F.col("n_tokens") - 1) / SHARD_TOKENS))).alias("range"))
    wanted = positions.select(F.col("position").cast("long").alias("position")).where("position is not null").withColumn("range", F.floor(F.col("position") / SHARD_TOKENS))
    inside = wanted.join(spans, "range").where("position >= start and position < start + n_tokens")
    # a shard's queries go to it in lists of bounded size
    asked = inside.groupBy("file", F.pmod(F.xxhash64("position"), F.lit(64)).alias("part")).agg(F.sort_array(F.collect_list(F.col("position") - F.col("start"))).alias("asked"))
    met = asked.join(shards.select("file", "start", "matrix"), "file").select("start", "asked", "matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, own, blob in zip(*(batch.column(k).to_pylist() for k in ("start", "asked", "matrix")), strict=True):
                m = WaveletMatrix(blob)
                yield pa.RecordBatch.from_arrays([pa.array([start + p for p in own], pa.int64()), pa.array([m.access(p) for p in own], pa.int64())], names=["position", "token"])

    return met.mapInArrow(run, "position long, token long")


def tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs to shards in the shared folder and return read_documents() of them."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer)
    return read_documents(spark, path)
