import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from nodeloom.llm import flac


def payload(b):
    return b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))


def trip(blobs):
    data = np.frombuffer(b"".join(blobs), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
    return flac.encode_chunk(*flac.payloads(data, offsets))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=2000), st.text(max_size=1500).map(str.encode), st.integers(0, 255).map(lambda v: bytes([v]) * 700)), min_size=1, max_size=6))
def test_round_trip(blobs):
    streams = trip(blobs)
    for b, (pcm, offsets, bad, _) in zip(blobs, flac.decode_chunk(streams)):
        assert pcm == payload(b) and bad == 0
        assert offsets == list(range(0, len(pcm), flac.BLOCK))


def test_equal_texts_equal_streams():
    a, b, c = trip([b"hello" * 400, b"other", b"hello" * 400])
    assert a == c != b


def test_damage_is_noticed_and_ends_nothing():
    text = b"The quick brown fox jumps over the lazy dog. " * 40
    whole = trip([text])[0]
    streams = []
    for at in range(len(whole)):
        stream = bytearray(whole)
        stream[at] ^= 1 << at % 8
        streams.append(bytes(stream))
    unnoticed = 0
    for pcm, _, bad, _ in flac.decode_chunk(streams):
        assert bad > 0 or pcm == payload(text)
        unnoticed += not bad
    assert unnoticed <= 16  # sizes and rate in STREAMINFO, which decoding does not need
    assert flac.decode_chunk([b"", b"fLaC", whole[:50], whole[:-3], whole])[-1][2] == 0
    assert all(x[2] > 0 for x in flac.decode_chunk([b"", b"fLaC", whole[:50], whole[:-3]]))


def test_a_bad_frame_is_silence():
    text = b"".join(b"%d " % i for i in range(700))
    stream = bytearray(trip([text])[0])
    stream[-40] ^= 1
    pcm, offsets, bad, _ = flac.decode_chunk([bytes(stream)])[0]
    assert bad == 1 and pcm[: offsets[-1]] == payload(text)[: offsets[-1]] and set(pcm[offsets[-1] :]) == {128} and len(pcm) == len(payload(text))


def rice(values, k):
    out = ""
    for v in values:
        u = (v << 1) ^ (v >> 63)
        out += "0" * (u >> k) + "1" + (format(u & ((1 << k) - 1), f"0{k}b") if k else "")
    return out


def frame(body, n):
    head = bytes([0xFF, 0xF8, 0x64, 0x02, 0, n - 1])
    arr = np.frombuffer(head, np.uint8)
    head += flac.CRC8(arr, np.array([0]), np.array([len(head)])).tobytes()
    body += "0" * (-len(body) % 8)
    data = head + int(body, 2).to_bytes(len(body) // 8, "big")
    arr = np.frombuffer(data, np.uint8)
    return data + int(flac.CRC16(arr, np.array([0]), np.array([len(data)]))[0]).to_bytes(2, "big")


def decode(data, n):
    s, size, good = flac.decode_frames(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))
    assert good.all() and size[0] == n
    return s[:n, 0].tolist()


@pytest.mark.parametrize("order", [0, 1, 2, 3, 4])
def test_fixed_predictors(order):
    x = [(i * i * 7 + i * 13) % 61 - 30 for i in range(32)]
    res = x[:]
    for _ in range(order):
        res = [res[0]] + [b - a for a, b in zip(res, res[1:])]
    body = format(8 + order, "06b").rjust(7, "0") + "0" + "".join(format(v & 255, "08b") for v in x[:order]) + "00" + "0000" + "0101" + rice(res[order:], 5)
    assert decode(frame(body, 32), 32) == x


def test_lpc_partitions_and_escape():
    x = [(i * 29) % 50 - 25 for i in range(32)]
    coefs, shift = [5, -3], 2
    res = [x[i] - ((coefs[0] * x[i - 1] + coefs[1] * x[i - 2]) >> shift) for i in range(2, 32)]
    body = "0" + format(33, "06b") + "0" + "".join(format(v & 255, "08b") for v in x[:2]) + "0100" + "00010" + "".join(format(c & 31, "05b") for c in coefs)
    body += "00" + "0001" + "0011" + rice(res[:14], 3) + "1111" + format(9, "05b") + "".join(format(v & 511, "09b") for v in res[14:])
    assert decode(frame(body, 32), 32) == x


def test_query_digests(spark, make_docs, edge_docs, no_docs):
    docs = make_docs(["hello world " * 100, None, ""])
    decoded = flac.decode(flac.encode(docs, ["doc_id"]), ["doc_id"])
    got = {r.doc_id: r for r in decoded.collect()}
    want = payload(b"hello world " * 100)
    assert bytes(got[0].pcm) == want and hashlib.sha256(got[0].pcm).digest() == hashlib.sha256(want).digest()
    assert bytes(got[1].pcm) == bytes(got[2].pcm) == bytes(64) and zlib.crc32(bytes(got[1].pcm)) == zlib.crc32(bytes(64))
    blocks = flac.pcm_blocks(decoded, ["doc_id"]).filter("doc_id = 0").orderBy("block").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == want and [b.sample_offset for b in blocks] == [0, 576, 1152]
    assert flac.decode(flac.encode(edge_docs, ["doc_id"]), ["doc_id"]).filter("bad_frames > 0").count() == 0
    assert flac.decode(flac.encode(no_docs, ["doc_id"]), ["doc_id"]).count() == 0
