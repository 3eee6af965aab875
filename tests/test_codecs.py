import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.functions import codecs as C


@pytest.mark.parametrize(("data", "coded"), [(b"ab", "02056162"), (b"a" * 12, "0c03611e"), (b"a" * 100, "640361105f"), (b"abcde" * 4, "140b6162636465500b")])
def test_lz77_bytes(data, coded):
    assert C.lz77_encode(data).hex() == coded


def test_lzw_bytes():
    assert (C.lzw_encode(b"aaa")[0].hex(), C.lzw_encode(b"aaa")[1]) == ("610002", 18)
    coded, bits = C.lzw_encode(b"TOBEORNOTTOBEORTOBEORNOT")
    assert (coded.hex(), bits) == ("549e0829f2448a932754000a24987060c183", 144)


def test_huffman_sizes():
    coded, bits = C.huffman_encode(b"AA")
    assert (len(coded), bits, coded[:13].hex()) == (38, 298, "00010100000000000000000002")
    coded, bits = C.huffman_encode(b"AAAB")
    assert (len(coded), bits) == (70, 560)


def test_mtf_bwt_rle_goldens():
    assert C.mtf_encode(b"EFGACAAAGE") == (bytes([4, 5, 6, 3, 5, 1, 0, 0, 2, 4]), 65, 71)
    assert C.bwt_encode(b"BANANAICECREAMSUNDAY") == (b"YNENBDIENRCAAAAUCMSA", 6)
    assert list(C.mtf_encode(b"YNENBDIENRCAAAAUCMSA")[0]) == [24, 14, 6, 1, 4, 6, 10, 4, 4, 18, 8, 8, 0, 0, 0, 21, 2, 16, 20, 4]
    assert C.rle_encode(bytes([5, 0] * 3 + [7, 0])).hex() == "030500010700"
    assert C.rle_encode(bytes([9, 0]) * 256).hex() == "ff0900010900"


def test_fnv_and_vlq():
    assert C.fnv1a(b"") == 0x811C9DC5
    for n in (0, 127, 128, 16383, 16384, 1 << 40):
        assert C.unvlq(C.vlq(n), 0) == (n, len(C.vlq(n)))


@pytest.mark.parametrize("name", sorted(C.CODECS))
@pytest.mark.parametrize("size", [0, 1, 4, 5, 255, 256, 65535])
def test_round_trip_lengths(name, size):
    rnd = random.Random(size)
    for data in (bytes([7]) * size, rnd.randbytes(size), (b"the quick brown fox jumps over " * (size // 31 + 1))[:size]):
        if name == "rle" and size % 2:
            continue
        coded, pad = C.CODECS[name].encode(data, 2)
        assert C.CODECS[name].decode(coded, 2, pad) == data


@given(st.binary(max_size=600))
@settings(max_examples=40, deadline=None)
def test_round_trip_any(data):
    for name, codec in C.CODECS.items():
        if name != "rle":
            coded, pad = codec.encode(data, 2)
            assert codec.decode(coded, 2, pad) == data


def test_short_last_block():
    data = random.Random(3).randbytes(70_001)
    for post in ("lz77", "lzw", "none"):
        assert C.bzip_decode(C.bzip_encode(data, post, 1 << 15), post) == data


def test_incremental_decoder():
    one, two = b"hello hello hello hello", b"another"
    stream = C.lz77_encode(one) + C.lz77_encode(two)
    decoder = C.Lz77Decoder()
    done = [decoder.feed(stream[i : i + 1]) for i in range(len(C.lz77_encode(one)))]
    assert done[-1] and not any(done[:-1]) and bytes(decoder.out) == one
    decoder = C.Lz77Decoder()
    assert decoder.feed(stream) and decoder.remaining == C.lz77_encode(two)
    with pytest.raises(LookupError):
        C.Lz77Decoder(max_size=3).feed(stream)


@pytest.mark.parametrize("name", ["lz78", "deflate", "lz4", "lzo"])
def test_unsupported(name):
    with pytest.raises(ValueError, match="unsupported"):
        C.codec(name)


def test_errors():
    with pytest.raises(ValueError):
        C.rle_encode(b"abc", 2)
    with pytest.raises(ValueError):
        C.rle_encode(b"abc", 3)
    with pytest.raises(ValueError):
        C.mtf_decode(bytes([9]), 65, 66)


def test_bwt_rows():
    """Golden rows of the n + 1 form; constant and empty data."""
    assert C.bwt_rows(b"BANANAICECREAMSUNDAY") == (b"YNENBDDIENRCAAAAUCMSA", 6)
    turned, row = C.bwt_rows(bytes([2, 7, 1, 8, 2, 8, 1, 8, 2, 8, 4, 5, 9, 0, 1]))
    assert list(turned) == [1, 9, 0, 7, 8, 8, 8, 8, 8, 4, 2, 2, 1, 1, 2, 5] and row == 5
    assert C.bwt_rows(b"") == (b"", 0) and C.bwt_rows(b"aaa") == (b"aaaa", 0)
