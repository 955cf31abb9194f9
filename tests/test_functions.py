import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cairn.functions import ciphers as C, codecs as K, scalars as S
from cairn.functions.paths import ancestors, extension, is_safe, normalized, parent
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(K.COMPRESS))
@given(data=st.one_of(st.binary(max_size=400), st.lists(st.sampled_from([b"a", b"ab", b"\0" * 40]), max_size=60).map(b"".join)))
@settings(max_examples=60, deadline=None)
def test_codec_round_trip(name, data):
    assert K.DECOMPRESS[name](K.COMPRESS[name](data), len(data)) == data


@pytest.mark.parametrize("n", [0, 1, 2, 3, 127, 128, 129, 256, 260])
def test_run_boundaries(n):
    data = b"A" * n + b"BC" + b"D" * n
    out = K.rle_compress(data)
    assert K.rle_decompress(out) == data
    assert n < 127 or len(out) < 30


def test_lz77_known_streams():
    head = b"LZ77" + struct.pack("<Q", 10)
    tokens = bytes([0x25]) + b"ab" + b"\x02\x00"
    assert K.lz77_decode_block(tokens, 10) == b"ababababab"
    assert K.lz77_decompress(head + struct.pack("<BII", 0, 10, len(tokens)) + tokens) == b"ababababab"
    stored = b"LZ77" + struct.pack("<Q", 5) + struct.pack("<BII", 1, 5, 5) + b"hello"
    assert K.lz77_decompress(stored) == b"hello"
    assert K.lz77_decompress(K.lz77_compress(b"A" * 4096)) == b"A" * 4096
    big = bytes(range(256)) * 5000
    assert K.lz77_decompress(K.lz77_compress(big)) == big


def test_malformed_streams():
    good = {"rle": K.rle_compress(b"AAAABCD"), "huffman": K.huffman_compress(b"hello world"), "lz77": K.lz77_compress(b"abcabcabcabcabc" * 9)}
    for name, stream in good.items():
        for bad in (stream[:-1], stream + b"\0", b"XXXX" + stream[4:], stream[:4] + struct.pack("<Q", 1 << 40) + stream[12:], b""):
            with pytest.raises(K.Malformed):
                K.DECOMPRESS[name](bad)
    for tokens, size in ((b"\x05ab", 9), (b"\x20ab\x00\x00", 9), (b"\x20ab\x03\x00", 9), (b"\xf0\xff\xff", 20), (b"\x20ab\x01\x00\x00", 5)):
        with pytest.raises(K.Malformed):
            K.lz77_decode_block(tokens, size)


def test_huffman_lengths():
    assert K.huffman_lengths(np.bincount([65] * 9, minlength=256))[65] == 1
    lengths = K.huffman_lengths(np.bincount([1] * 8 + [2] * 4 + [3] * 2 + [4], minlength=256))
    assert [int(lengths[k]) for k in (1, 2, 3, 4)] == [1, 2, 3, 3]
    with pytest.raises(K.Malformed):
        K.canonical_codes([1, 1, 1])


def test_cipher_vectors():
    key, nonce = bytes(range(32)), bytes.fromhex("000000090000004a00000000")
    stream = C.chacha20_xor(key, nonce, 64, bytes(64))
    assert stream.hex().startswith("10f1e7e4d13b5915500fdd1fa32071c4c7d1f4c733c068030422aa9ac3d46c4e")
    assert C.aes256_blocks(key, np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8).reshape(1, 16)).tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert C.hmac_sha256(b"\x0b" * 20, b"Hi There").hex() == "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"


def test_ciphers_seek():
    rng = random.Random(5)
    data, key, salt = rng.randbytes(5000), rng.randbytes(32), b"\xff" * 15 + b"\xfe"
    for f, iv in ((C.chacha20_xor, salt[:12]), (C.aes256_ctr_xor, salt)):
        whole = f(key, iv, 0, data)
        assert f(key, iv, 0, whole) == data
        for at in (1, 5, 16, 63, 64, 1000):
            assert f(key, iv, at, data[at : at + 333]) == whole[at : at + 333]


def test_key_derivation_is_the_same_in_sql(spark):
    salt = bytes(range(16))
    row = spark.range(1).select(S.derived_key(F.lit("secret"), F.lit(salt), 3).alias("k")).first()
    assert row.k == C.derive_key("secret", salt, 3).hex()


def test_scalars(spark):
    sizes = [0, 1023, 1024, 102_400, 1 << 20, 100 << 20, 5 << 30, 3 << 40, 2000 << 40]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select(S.format_bytes("n").alias("t"))
    assert [r.t for r in df.collect()] == ["0 B", "1023 B", "1.0 KiB", "100 KiB", "1.0 MiB", "100 MiB", "5.0 GiB", "3.0 TiB", "2000 TiB"]
    servers = ["h:1", "[::1]:65535", "h:0", "h:65536", "h", ":5", "a:b:7", "h:99999"]
    df = spark.createDataFrame([(x,) for x in servers], "x string").select(S.parse_server("x").alias("s"))
    assert [r.s and (r.s.host, r.s.port) for r in df.collect()] == [("h", 1), ("::1", 65535), None, None, None, None, ("a:b", 7), None]
    addresses = {"1.2.3.4": True, "256.1.1.1": False, "1.2.3": False, "01.2.3.4": False, "1.2.3.4\n": False}
    df = spark.createDataFrame([(x,) for x in addresses], "x string").select(S.is_ipv4("x").alias("v"))
    assert [r.v for r in df.collect()] == list(addresses.values())
    modes = spark.createDataFrame([(0o100644,), (0o040755,), (0o140000,)], "m int").select(S.entry_type_name(S.type_of_mode("m")).alias("t"))
    assert [r.t for r in modes.collect()] == ["file", "directory", "unix-socket"]
    with pytest.raises(Exception, match="unknown"):
        spark.range(1).select(S.algorithm_number(F.lit("zip"), S.COMPRESSIONS)).collect()


def test_paths(spark):
    paths = ["a", "a/b", "/".join("abcdefghi"), "ü/ß.TXT", ".config"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(ancestors("p").alias("a"), parent("p").alias("u"), extension("p").alias("e"), is_safe("p").alias("s")).collect()
    assert [list(r.a) for r in rows] == [["/".join(p.split("/")[:k]) for k in range(1, p.count("/") + 1)] for p in paths]
    assert [r.u for r in rows] == ["", "a", "/".join("abcdefgh"), "ü", ""]
    assert [r.e for r in rows] == ["", "", "", "txt", ""] and all(r.s for r in rows)
    unsafe = spark.createDataFrame([(p,) for p in ("", "/a", "a//b", "a/./b", "../a", "a/")], "p string").select(is_safe("p").alias("s"))
    assert not any(r.s for r in unsafe.collect())
    fine = spark.createDataFrame([("./docs//manual/guide.txt",), ("src/",)], "p string").select(normalized("p").alias("n"))
    assert [r.n for r in fine.collect()] == ["docs/manual/guide.txt", "src"]
    for bad in ("", ".", "/etc/passwd", "../outside", "docs/manual/../readme.md"):
        with pytest.raises(Exception, match="selected"):
            spark.createDataFrame([(bad,)], "p string").select(normalized("p")).collect()


def test_codecs_a_piece_at_a_time():
    import io
    import random

    from cairn.functions.codecs import COMPRESS, PIECES, UNPACKED

    rng = random.Random(4)
    skewed, a, b = b"", 1, 1
    for k in range(20):  # code lengths beyond the tables' width
        skewed, a, b = skewed + bytes([k]) * a, b, a + b
    for data in (b"", b"a", bytes(5000), skewed, bytes(rng.randrange(256) for _ in range(3000)), b"abc" * 900 + bytes(130) + b"xy" * 3, b"".join(bytes([rng.randrange(3)]) * rng.randrange(1, 300) for _ in range(60))):
        for name in COMPRESS:
            for step in (1, 5, 128, 129, 4096):
                stream = b"".join(PIECES[name](lambda: (data[k : k + step] for k in range(0, len(data), step)), len(data)))
                assert stream == COMPRESS[name](data)
                assert b"".join(UNPACKED[name](io.BytesIO(stream).read, len(data))) == data


def test_options():
    from cairn import options as O
    from cairn.operators.validate import Invalid

    o = O.parsed(["backup", "src", "-o", "x.bak", "--include", "a", "--include", "b", "--compress", "lz77"])
    assert o.operands == ["src"] and o.required("-o") == "x.bak" and o.repeated == {"--include": ["a", "b"]} and o.values["--compress"] == "lz77" and not o.flags
    assert O.parsed(["restore", "x", "-d", "to", "--overwrite"]).flags == {"--overwrite"}
    for bad in ([], ["fly"], ["backup", "--overwrite"], ["backup", "-o"], ["backup", "-o", "--pack"], ["backup", "-o", "x", "-o", "y"], ["restore", "--overwrite", "--overwrite"], ["inspect", "--include", "x"], ["user", "extra"]):
        with pytest.raises(Invalid):
            O.parsed(bad)
    with pytest.raises(Invalid):
        o.required("--key-file")
    assert O.check_algorithms("index", "none", "none", incremental=True) and not O.check_algorithms("index", "none", "aes256", "pw", incremental=True)
    for bad in (("zip", "none", "none", ""), ("index", "gz", "none", ""), ("index", "none", "aes256", "")):
        with pytest.raises(Invalid):
            O.check_algorithms(*bad)
    assert O.settled({"port": 1, "host": None}, {"host": "h", "port": 2}, {"host": "d", "keep": 5}) == {"port": 1, "host": "h", "keep": 5}


def test_file_secrets(tmp_path):
    from cairn.operators.validate import Invalid
    from cairn.options import file_secret

    (tmp_path / "a").write_bytes(b"pass word\r\n\n")
    (tmp_path / "b").write_bytes(b"\n")
    assert file_secret(str(tmp_path / "a")) == "pass word"
    with pytest.raises(Invalid):
        file_secret(str(tmp_path / "b"))
