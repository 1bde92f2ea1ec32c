"""Streams of other layers, versions, tags and tables, made by hand, through the MPEG audio reader."""

import struct

import pytest

from corpusloom.llm import mpeg_audio as mp


def crc16(bits):
    """A second way to the checksum: long division of the bits, after all ones, by the polynomial."""
    value = [b ^ 1 for b in bits[:16]] + list(bits[16:]) + [0] * 16
    for k in range(len(bits)):
        if value[k]:
            for j, p in enumerate(f"{0x18005:017b}"):
                value[k + j] ^= int(p)
    return int("".join(map(str, value[-16:])), 2)


def frame(version, layer, kbps, rate, mode, body_bits, extension=0):
    """A guarded frame whose first bits after the checksum are given: all of them are covered."""
    table = mp.BITRATES[version == 3, layer]
    head = bytes((0xFF, 0xE0 | version << 3 | (4 - layer) << 1, table.index(kbps) << 4 | mp.RATES[version].index(rate) << 2, mode << 6 | extension << 4))
    h = mp.header(head)
    bits = [int(b) for b in f"{int.from_bytes(head[2:]):016b}"] + [int(b) for b in body_bits]
    body = int(body_bits.ljust(-(-len(body_bits) // 8) * 8, "0"), 2).to_bytes(-(-len(body_bits) // 8))
    return (head + crc16(bits).to_bytes(2) + body).ljust(h["size"], b"\0")


def pairs(used, width, rest):
    """Allocations: the first subbands' given values, zeros for the rest."""
    return "".join(f"{u:0{w}b}" for u, w in zip(used, width, strict=True)) + rest


CASES = [
    (3, 1, 128, 44100, 3, "1010" + "0000" * 31, 0, 384),  # layer I, mono
    (3, 1, 256, 44100, 0, "1010" + "0000" * 63, 0, 384),  # layer I, stereo
    (3, 1, 256, 44100, 1, "1010" + "0000" * (7 + 28), 0, 384),  # layer I, joint from subband 4 on
    (3, 2, 64, 44100, 3, "0101" + "0000" * 10 + "000" * 12 + "00" * 4 + "10", 0, 1152),  # layer II, 27 subbands, one choice
    (3, 2, 192, 44100, 0, "0101" + "0000" * 21 + "000" * 24 + "00" * 14 + "10", 0, 1152),  # 30 subbands
    (3, 2, 64, 44100, 0, "0101" * 2 + "0000" * 2 + "000" * 12 + "1011", 0, 1152),  # 8 subbands, two choices
    (3, 2, 64, 32000, 0, "0000" * 4 + "000" * 20, 0, 1152),  # 12 subbands
    (2, 2, 64, 22050, 3, "0001" + "0000" * 3 + "000" * 7 + "00" * 19 + "11", 0, 1152),  # MPEG-2
    (3, 2, 192, 44100, 1, "0101" * 2 + "0000" * 6 + "0001" + "0000" * 6 + "000" * 12 + "00" * 7 + "11" * 4, 0, 1152),  # joint: a shared subband has two choices
    (2, 3, 64, 24000, 0, "1" * 17 * 8, 0, 576),
    (0, 3, 32, 11025, 3, "01" * 9 * 4, 0, 576),
]


@pytest.mark.parametrize("case", CASES)
def test_checksums_of_all_layers(case):
    *args, extension, samples = case
    media = frame(*args, extension) * 3
    seen = mp.parse(media)
    assert (len(seen["frames"]), seen["checked"], seen["bad"], seen["skipped"]) == (3, 3, 0, 0)
    assert seen["samples"] == 3 * samples
    assert seen["seconds"] == mp.Fraction(3 * samples, args[3])
    at = seen["frames"][1][0]
    for k in (6, 6 + (len(args[5]) - 1) // 8):  # the first and the last byte that the checksum covers
        broken = bytearray(media)
        broken[at + k] ^= 0x80 >> ((len(args[5]) - 1) % 8 if k > 6 else 0)
        assert mp.parse(bytes(broken))["bad"] == 1, k


def test_vbri_table():
    first = bytearray(frame(3, 3, 128, 44100, 0, "0" * 256))
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 1000, 2, 3, 2, 2, 1) + struct.pack(">HHH", 10, 20, 30)
    first[36 : 36 + len(table)] = table
    seen = mp.parse(bytes(first) + frame(3, 3, 128, 44100, 0, "0" * 256) * 2)
    assert seen["vbr"] == {"kind": "VBRI", "frames": 2, "bytes": 1000, "toc": [20, 40, 60], "per": 1}
    assert len(seen["frames"]) == 2


def tag(major, flags, body):
    return b"ID3" + bytes((major, 0, flags)) + mp.from_syncsafe(len(body)) + body


@pytest.mark.parametrize(("media", "expected"), [
    (tag(2, 0, b"TT2\0\0\5\0abcdTT2\0\0\2\0e"), {"TT2": b"\0abcd", "TT2#2": b"\0e"}),
    (tag(3, 0, b"TIT2\0\0\0\5\0\0\0abcd" + b"\0" * 20), {"TIT2": b"\0abcd"}),
    (tag(3, 64, b"\0\0\0\6\0\0\0\0\0\0TIT2\0\0\0\2\0\0\0a"), {"TIT2": b"\0a"}),
    (tag(4, 64, b"\0\0\0\6\1\0TIT2\0\0\0\2\0\0\0a"), {"TIT2": b"\0a"}),
    (tag(3, 128, b"PRIV\0\0\0\3\0\0a\xff\0\xe0"), {"PRIV": b"a\xff\xe0"}),
    (tag(4, 0, b"PRIV\0\0\0\4\0\2a\xff\0\xe0"), {"PRIV": b"a\xff\xe0"}),
])
def test_tags(media, expected):
    found, start, end = mp.tags(media + b"xyz")
    assert found == expected
    assert media + b"xyz" == (media + b"xyz")[:start] + b"xyz"
    assert end == len(media) + 3
