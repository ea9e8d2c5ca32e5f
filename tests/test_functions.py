import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfold.functions.codecs import compress, delta, delta_decode, delta_encode, expand, lz4, patch, unlz4
from sparkfold.functions.scalars import byte_sum, container_name, decrypt, encrypt, fingerprint, keyed_token, name_hash, sketch_positions
from sparkfold.functions.superfeatures import FEATURES, MODULUS, WINDOW, features, super_feature, super_features


def hash_of(window):
    h = 0
    for b in window:
        h = (h * 37 + b) % MODULUS
    return h


def test_features_are_the_largest_window_hashes():
    data = random.Random(3).randbytes(900)
    for i, f in enumerate(features(data)):
        part = data[i * 900 // FEATURES : (i + 1) * 900 // FEATURES]
        assert f == max(hash_of(part[k : k + WINDOW]) for k in range(len(part) - WINDOW + 1))


@pytest.mark.parametrize("n", [0, 1, 47, 48, 564])
def test_tiny_chunks_have_the_digest_of_zeros(n):
    assert super_features(b"x" * n) == [hashlib.sha256(bytes(32)).hexdigest()] * 3


def test_larger_chunks_differ_and_a_local_edit_keeps_a_super_feature():
    data = random.Random(5).randbytes(8000)
    edited = data[:100] + b"Z" * 20 + data[120:]
    assert features(b"y" * 576) != [0] * 12 and len(set(super_features(data))) == 3
    assert set(super_features(data)) & set(super_features(edited))


@settings(max_examples=200)
@given(st.binary(max_size=400), st.binary(max_size=400), st.binary(max_size=100))
def test_delta_round_trip(a, b, c):
    for target, base in ((a, b), (a + c + b, a + b), (a + b, a + c + b), (a, a), (b"", a), (a, b""), (b + a, a + b)):
        assert delta_decode(delta_encode(target, base), base) == target


def test_delta_sizes():
    base = random.Random(1).randbytes(6000)
    assert len(delta_encode(base, base)) == 8
    assert len(delta_encode(base[:3000] + b"inserted" + base[3000:], base)) <= 8 + 4 + 8 + 8
    moved = base[3000:] + base[:3000]
    assert len(delta_encode(moved, base)) < 200
    other = random.Random(2).randbytes(100)
    assert len(delta_encode(other, base)) == 104


@settings(max_examples=100)
@given(st.binary(max_size=2000))
def test_lz4_round_trip_and_never_longer(data):
    stored = compress(data)
    assert len(stored) <= len(data) and expand(stored, len(data)) == data


def test_codecs_as_columns(spark):
    rows = [(bytearray(b"abc" * 500), bytearray(b"abc" * 490)), (bytearray(random.Random(1).randbytes(300)), bytearray(b"")), (bytearray(b""), bytearray(b"x")), (None, bytearray(b"x")), (bytearray(b"x"), None)]
    df = spark.createDataFrame(rows, "a binary, b binary")
    out = df.select("a", "b", unlz4(lz4("a"), F.length("a")).alias("z"), patch(delta(F.col("a"), F.col("b")), F.col("b")).alias("d")).collect()
    for r in out:
        assert r.z == r.a and r.d == (r.a if r.b is not None else None)


def test_scalars(spark):
    df = spark.createDataFrame([(bytearray(b"hello"), "p", 7)], "a binary, path string, n int")
    r = df.select(
        *[fingerprint(F.col("a"), m).alias(m) for m in ("sha256", "sha1", "md5")], name_hash(F.col("path"), F.col("n")).alias("name"), container_name(F.lit(36 * 36 + 35)).alias("c"), byte_sum(F.col("a")).alias("s"),
        sketch_positions(fingerprint(F.col("a"))).alias("p"), keyed_token(F.lit("ab"), "k").alias("t"), decrypt(encrypt(F.col("a"), b"k" * 16), b"k" * 16).alias("g"), decrypt(encrypt(F.col("a"), b"k" * 32, "CBC"), b"k" * 32, "CBC").alias("b"),
    ).first()
    digest = hashlib.sha256(b"hello").digest()
    assert (r.sha256, r.sha1, r.md5) == tuple(hashlib.new(m, b"hello").hexdigest() for m in ("sha256", "sha1", "md5"))
    assert r.name == hashlib.sha256(b"p7").hexdigest() and r.c == "000010z" and r.s == sum(b"hello")
    assert r.p == [int.from_bytes(digest[4 * i : 4 * i + 4], "little") % 262144 for i in range(4)]
    assert r.t == hashlib.sha256(b"kab").hexdigest() and bytes(r.g) == bytes(r.b) == b"hello"
    two = spark.createDataFrame([(bytearray(b"same"),), (bytearray(b"same"),)], "a binary")
    assert two.select(encrypt(F.col("a"), b"k" * 16).alias("e")).distinct().count() == 2


def test_super_feature_column(spark):
    df = spark.createDataFrame([(bytearray(b"a" * 1000),), (None,)], "a binary")
    assert [r[0] for r in df.select(super_feature(F.col("a"))).collect()] == [super_features(b"a" * 1000), None]
