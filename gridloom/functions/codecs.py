"""Lossless byte codecs as pure functions bytes -> bytes; operators.codecs runs them on blocks inside Arrow functions."""

from __future__ import annotations

import bz2
import gzip
import heapq
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

# -- integers and bits ----------------------------------------------------------------------------------------------

#: 32-bit FNV-1a.
FNV_SEED, FNV_PRIME = 0x811C9DC5, 0x01000193


def fnv1a(data: bytes, value: int = FNV_SEED) -> int:
    for byte in data:
        value = ((value ^ byte) * FNV_PRIME) & 0xFFFFFFFF
    return value


def vlq(n: int) -> bytes:
    """Seven bits a byte, low bits first; the high bit says that more follow."""
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def unvlq(data: bytes, at: int) -> tuple[int, int]:
    """The number that starts at `at`, and where it ends."""
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("truncated number")
        byte = data[at]
        at += 1
        n |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return n, at


class BitWriter:
    """Bits, least significant first."""

    def __init__(self) -> None:
        self.value, self.held, self.out = 0, 0, bytearray()

    def put(self, value: int, width: int) -> None:
        self.value |= value << self.held
        self.held += width
        while self.held >= 8:
            self.out.append(self.value & 0xFF)
            self.value >>= 8
            self.held -= 8

    def align(self) -> None:
        if self.held:
            self.put(0, 8 - self.held)

    @property
    def bits(self) -> int:
        return 8 * len(self.out) + self.held

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.value & 0xFF]) if self.held else b"")


class BitReader:
    def __init__(self, data: bytes, bits: int | None = None) -> None:
        self.data, self.at, self.bits = data, 0, 8 * len(data) if bits is None else bits

    def left(self) -> int:
        return self.bits - self.at

    def take(self, width: int) -> int:
        if self.at + width > self.bits:
            raise ValueError("truncated bit stream")
        first, last = self.at >> 3, (self.at + width + 7) >> 3
        value = int.from_bytes(self.data[first:last], "little") >> (self.at & 7)
        self.at += width
        return value & ((1 << width) - 1)

    def align(self) -> None:
        self.at = (self.at + 7) & ~7


def used_bits(bits: int) -> int:
    """The header's count of used bits in the last byte; 0 stands for all eight."""
    return bits % 8


# -- runs -----------------------------------------------------------------------------------------------------------


def rle_encode(data: bytes, width: int = 2) -> bytes:
    """Pairs of a one-byte count and a little-endian word of two or four bytes."""
    if width not in (2, 4):
        raise ValueError("run lengths need words of 2 or 4 bytes")
    if len(data) % width:
        raise ValueError("length is no multiple of the word")
    words = np.frombuffer(data, f"<u{width}")
    if not words.size:
        return b""
    heads = np.r_[0, np.flatnonzero(words[1:] != words[:-1]) + 1]
    sizes = np.diff(np.r_[heads, words.size])
    pieces = -(-sizes // 255)
    counts = np.full(pieces.sum(), 255)
    counts[np.cumsum(pieces) - 1] = sizes - 255 * (pieces - 1)
    out = np.zeros(counts.size, np.dtype([("n", "u1"), ("word", f"<u{width}")]))
    out["n"], out["word"] = counts, np.repeat(words[heads], pieces)
    return out.tobytes()


def rle_decode(data: bytes, width: int = 2) -> bytes:
    pairs = np.frombuffer(data, np.dtype([("n", "u1"), ("word", f"<u{width}")]))
    return np.repeat(pairs["word"], pairs["n"]).tobytes()


# -- move to front, Burrows-Wheeler ----------------------------------------------------------------------------------


def mtf_encode(data: bytes) -> tuple[bytes, int, int]:
    """Indices in the list of symbols min..max, each moved to its front; and min and max."""
    if not data:
        return b"", 0, 0
    low, high = min(data), max(data)
    table, out = list(range(low, high + 1)), bytearray()
    for byte in data:
        i = table.index(byte)
        out.append(i)
        if i:
            table.insert(0, table.pop(i))
    return bytes(out), low, high


def mtf_decode(data: bytes, low: int, high: int) -> bytes:
    table, out = list(range(low, high + 1)), bytearray()
    for i in data:
        if i >= len(table):
            raise ValueError("index beyond the alphabet")
        byte = table.pop(i)
        table.insert(0, byte)
        out.append(byte)
    return bytes(out)


def suffix_array(data: bytes) -> np.ndarray:
    """Start of each suffix in order, by doubling ranks."""
    n = len(data)
    rank = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:]
        key = rank * (n + 257) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[1, ordered[1:] != ordered[:-1]])
        if n == 0 or new[order[-1]] == n:
            return order
        rank, step = new, 2 * step


def bwt_encode(data: bytes) -> tuple[bytes, int]:
    """Last column without the row of the whole text, and that row's number (1-based; 0 for no data)."""
    if not data:
        return b"", 0
    order = suffix_array(data)
    symbols = np.frombuffer(data, np.uint8)
    row = int(np.flatnonzero(order == 0)[0])
    before = symbols[order - 1]
    # the empty suffix comes first and ends with the last symbol; the whole text's row is left out
    return np.r_[symbols[-1:], before[:row], before[row + 1 :]].astype(np.uint8).tobytes(), row + 1


def bwt_rows(data: bytes) -> tuple[bytes, int]:
    """The last column of all n + 1 sorted rotations, and the row of the whole string.

    That row has no byte before it and repeats the one above it. Bytes that are all equal are n + 1 times that byte, row 0.
    """
    if len(set(data)) <= 1:
        return data + data[:1], 0
    order = np.concatenate([[len(data)], suffix_array(data)])
    row = int(np.flatnonzero(order == 0)[0])
    last = np.frombuffer(data, np.uint8)[order - 1].copy()
    last[row] = last[row - 1]
    return last.tobytes(), row


def bwt_decode(data: bytes, primary: int) -> bytes:
    n = len(data)
    if not n:
        return b""
    if not 1 <= primary <= n:
        raise ValueError("primary index beyond the block")
    column = np.frombuffer(data, np.uint8)
    rows = np.r_[np.arange(primary), np.arange(primary + 1, n + 1)]
    order = np.argsort(column, kind="stable")
    before = np.empty(n + 1, np.int64)
    before[rows[order]] = np.arange(1, n + 1)
    last = np.zeros(n + 1, np.uint8)
    last[rows] = column
    steps, row, out = before.tolist(), 0, bytearray(n)
    lasts = last.tobytes()
    for i in range(n - 1, -1, -1):
        out[i] = lasts[row]
        row = steps[row]
    return bytes(out)


# -- dictionary codes ------------------------------------------------------------------------------------------------

#: Shortest match, entries kept for each hash, number of hashes.
MIN_RUN, RING, BUCKETS = 5, 12, 1 << 16


def _gain(run: int, offset: int) -> int:
    cost = len(vlq(offset << 4)) + (len(vlq(run - 4)) if run >= 8 else 0)
    return max(0, run - cost)


def _same(data: bytes, i: int, j: int) -> int:
    """Length of the common run from i and, later, j."""
    n, size = 0, len(data)
    step = 64
    while j + n < size:
        a, b = data[i + n : i + n + step], data[j + n : j + n + step]
        a = a[: len(b)]
        if a == b:
            n += len(b)
            step = min(2 * step, 65536)
            continue
        while data[i + n] == data[j + n]:
            n += 1
        return n
    return n


def lz77_encode(data: bytes) -> bytes:
    """Greedy matches of five bytes or more; the newest of equal gain wins."""
    out, literals, i = bytearray(vlq(len(data))), bytearray(), 0
    seen: dict[int, deque[int]] = {}

    def flush() -> None:
        if literals:
            out.extend(vlq(len(literals) << 1 | 1))
            out.extend(literals)
            literals.clear()

    while i < len(data):
        best = run = offset = 0
        if i + MIN_RUN <= len(data):
            ring = seen.setdefault(fnv1a(data[i : i + MIN_RUN]) % BUCKETS, deque(maxlen=RING))
            for at in reversed(ring):
                length = _same(data, at, i)
                gain = _gain(length, i - at) if length >= MIN_RUN else 0
                if gain > best:
                    best, run, offset = gain, length, i - at
            ring.append(i)
        if best:
            flush()
            rest = run - 4
            out.extend(vlq(((offset << 3) | rest) << 1) if rest < 8 else vlq(offset << 4) + vlq(rest))
            i += run
        else:
            literals.append(data[i])
            i += 1
    flush()
    return bytes(out)


class Lz77Decoder:
    """Incremental decoder: feed() takes pieces of any length and is true once a message is complete.

    What follows the message is left in `remaining`; a message longer than max_size raises.
    """

    def __init__(self, max_size: int | None = None) -> None:
        self.max_size, self.size, self.out, self.pending, self.remaining = max_size, None, bytearray(), b"", b""

    def _packet(self, data: bytes, at: int) -> int:
        head, at = unvlq(data, at)
        if head & 1:
            n = head >> 1
            if at + n > len(data):
                raise ValueError("truncated number")
            self.out += data[at : at + n]
            return at + n
        head >>= 1
        if head & 7:
            offset, run = head >> 3, (head & 7) + 4
        else:
            run, at = unvlq(data, at)
            offset, run = head >> 3, run + 4
        if not 0 < offset <= len(self.out):
            raise LookupError("match before the start")
        while run:
            piece = self.out[-offset:][:run] if run < offset else self.out[-offset:]
            self.out += piece
            run -= len(piece)
        return at

    def feed(self, piece: bytes) -> bool:
        data, at = self.pending + piece, 0
        try:
            if self.size is None:
                self.size, at = unvlq(data, 0)
                if self.max_size is not None and self.size > self.max_size:
                    raise LookupError("message too long")
            while len(self.out) < self.size:
                at = self._packet(data, at)
        except ValueError:
            self.pending = data[at:]
            return False
        self.pending, self.remaining = b"", data[at:]
        return True


def lz77_decode(data: bytes) -> bytes:
    decoder = Lz77Decoder()
    if not decoder.feed(data):
        raise ValueError("truncated message")
    return bytes(decoder.out)


#: Widths of LZW codes.
LZW_FIRST, LZW_LAST = 9, 12


def lzw_encode(data: bytes) -> tuple[bytes, int]:
    """Codes of 9 to 12 bits; and the number of bits. A full dictionary starts anew."""
    bits = BitWriter()
    table, width = {bytes([i]): i for i in range(256)}, LZW_FIRST
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        bits.put(table[word], width)
        if len(table) == 1 << LZW_LAST:
            table, width = {bytes([j]): j for j in range(256)}, LZW_FIRST
        else:
            if len(table) == 1 << width:
                width += 1
            table[longer] = len(table)
        word = data[i : i + 1]
    if word:
        bits.put(table[word], width)
    return bits.done(), bits.bits


def lzw_decode(data: bytes, bits: int | None = None) -> bytes:
    reader, out = BitReader(data, bits), bytearray()
    table, width, before = [bytes([i]) for i in range(256)], LZW_FIRST, b""
    size = 256  # entries that the writer has when it writes the next code
    while reader.left() >= width:
        code = reader.take(width)
        if before:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = before + before[:1]
            else:
                raise ValueError("unknown code")
            if len(table) < 1 << LZW_LAST:
                table.append(before + word[:1])
        else:
            word = table[code]
        out += word
        before = word
        if size == 1 << LZW_LAST:
            table, width, before, size = [bytes([i]) for i in range(256)], LZW_FIRST, b"", 256
        else:
            if size == 1 << width:
                width += 1
            size += 1
    return bytes(out)


# -- Huffman ---------------------------------------------------------------------------------------------------------


def huffman_codes(data: bytes) -> dict[int, tuple[int, int]]:
    """Code and length of each byte; every code starts with the root's 0. Ties go by the age of the node."""
    counts = Counter(data)
    heap: list[tuple[int, int, object]] = [(n, byte, byte) for byte, n in sorted(counts.items())]
    heapq.heapify(heap)
    age = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], age, (a[2], b[2])))
        age += 1
    codes: dict[int, tuple[int, int]] = {}
    stack = [(heap[0][2], 0, 1)] if heap else []
    while stack:
        node, code, length = stack.pop()
        if isinstance(node, tuple):
            stack += [(node[0], code, length + 1), (node[1], code | 1 << length, length + 1)]
        else:
            codes[node] = (code, length)
    return codes


def huffman_encode(data: bytes) -> tuple[bytes, int]:
    """Table (number of entries, width of lengths, 256 lengths and codes), then the codes; and the number of bits."""
    codes, bits = huffman_codes(data), BitWriter()
    width = max((length for _, length in codes.values()), default=0).bit_length()
    bits.put(256, 16)
    bits.put(width, 16)
    for byte in range(256):
        code, length = codes.get(byte, (0, 0))
        bits.put(length, width)
        bits.put(code, length)
    bits.align()
    for byte in data:
        bits.put(*codes[byte])
    return bits.done(), bits.bits


def huffman_decode(data: bytes, bits: int | None = None) -> bytes:
    reader = BitReader(data, bits)
    entries, width = reader.take(16), reader.take(16)
    table: dict[tuple[int, int], int] = {}
    for byte in range(entries):
        length = reader.take(width)
        if length:
            table[reader.take(length), length] = byte
    reader.align()
    out, code, length = bytearray(), 0, 0
    while reader.left() > 0:
        code |= reader.take(1) << length
        length += 1
        if (code, length) in table:
            out.append(table[code, length])
            code = length = 0
    if length:
        raise ValueError("truncated code")
    return bytes(out)


# -- block pipeline --------------------------------------------------------------------------------------------------

BLOCK = 1 << 20


def bzip_block(block: bytes, post: str) -> bytes:
    """Burrows-Wheeler, move to front, then lz77, lzw or none; with the block's own header."""
    moved, low, high = mtf_encode((turned := bwt_encode(block))[0])
    primary = turned[1]
    if post == "lzw":
        body, bits = lzw_encode(moved)
        head = len(body).to_bytes(4, "little") + bytes([used_bits(bits)])
    else:
        body = lz77_encode(moved) if post == "lz77" else moved
        head = len(body).to_bytes(4, "little")
    return head + bytes([low, high]) + primary.to_bytes(4, "little") + body


def bzip_unblock(data: bytes, at: int, post: str) -> tuple[bytes, int]:
    size = int.from_bytes(data[at : at + 4], "little")
    at += 4
    pad = 0
    if post == "lzw":
        pad, at = data[at], at + 1
    low, high, primary = data[at], data[at + 1], int.from_bytes(data[at + 2 : at + 6], "little")
    body = data[at + 6 : at + 6 + size]
    if len(body) != size:
        raise ValueError("truncated block")
    if post == "lzw":
        body = lzw_decode(body, 8 * size - (8 - pad) % 8)
    elif post == "lz77":
        body = lz77_decode(body)
    return bwt_decode(mtf_decode(body, low, high), primary), at + 6 + size


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """All of the data, the last block as short as need be."""
    for at in range(0, len(data), size):
        yield data[at : at + size]


def bzip_encode(data: bytes, post: str, size: int = BLOCK) -> bytes:
    return b"".join(bzip_block(b, post) for b in blocks(data, size))


def bzip_decode(data: bytes, post: str) -> bytes:
    out, at = [], 0
    while at < len(data):
        block, at = bzip_unblock(data, at, post)
        out.append(block)
    return b"".join(out)


# -- registry --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Codec:
    """encode gives bytes and the number of used bits in the last byte, or None where a header has no such field."""

    encode: Callable[[bytes, int], tuple[bytes, int | None]]
    decode: Callable[[bytes, int, int | None], bytes]
    code: int | None = None


def _bits(data: bytes, pad: int | None) -> int:
    return 8 * len(data) - (8 - (pad or 0)) % 8 if data else 0


def _padded(pair: tuple[bytes, int]) -> tuple[bytes, int]:
    return pair[0], used_bits(pair[1])


#: Codes of the codecs in array files.
CODECS: dict[str, Codec] = {
    "none": Codec(lambda b, w: (b, None), lambda b, w, p: b, 0),
    "rle": Codec(lambda b, w: (rle_encode(b, w), None), lambda b, w, p: rle_decode(b, w), 1),
    "huffman": Codec(lambda b, w: _padded(huffman_encode(b)), lambda b, w, p: huffman_decode(b, _bits(b, p)), 2),
    "lz77": Codec(lambda b, w: (lz77_encode(b), None), lambda b, w, p: lz77_decode(b), 3),
    "lzw": Codec(lambda b, w: _padded(lzw_encode(b)), lambda b, w, p: lzw_decode(b, _bits(b, p)), 5),
    "bzip_lz77": Codec(lambda b, w: (bzip_encode(b, "lz77"), None), lambda b, w, p: bzip_decode(b, "lz77"), 7),
    "bzip_lzw": Codec(lambda b, w: (bzip_encode(b, "lzw"), 0), lambda b, w, p: bzip_decode(b, "lzw"), 8),
    "bwt": Codec(lambda b, w: (bzip_encode(b, "none"), None), lambda b, w, p: bzip_decode(b, "none"), 9),
    "gzip": Codec(lambda b, w: (gzip.compress(b, 9, mtime=0), None), lambda b, w, p: gzip.decompress(b)),
    "bzip2": Codec(lambda b, w: (bz2.compress(b, 9), None), lambda b, w, p: bz2.decompress(b)),
}


def codec(name: str) -> Codec:
    """A codec by name; names without an algorithm (lz78, deflate, lz4, lzo) raise."""
    key = name.lower()
    if key not in CODECS:
        raise ValueError(f"unsupported codec: {name}")
    return CODECS[key]
