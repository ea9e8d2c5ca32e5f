"""Scalar functions on binary columns that Spark's own expressions cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def fingerprint(payload: Column, method: str = "sha256") -> Column:
    """Lower-case hex digest: sha256 (default), sha1 or md5."""
    return {"sha256": lambda: F.sha2(payload, 256), "sha1": lambda: F.sha1(payload), "md5": lambda: F.md5(payload)}[method]()


def name_hash(path: Column, client: Column) -> Column:
    """Key of a backup: digest of its path followed by the client's number."""
    return F.sha2(F.concat(as_bytes(path), as_bytes(client.cast("string"))), 256)


def container_name(number: Column) -> Column:
    """A container's number in base 36, seven digits, most significant first."""
    return F.lower(F.lpad(F.conv(number.cast("string"), 10, 36), 7, "0"))


def byte_values(payload: Column) -> Column:
    """Array of the byte values, 0 to 255."""
    return F.transform(F.filter(F.split(F.decode(payload, "ISO-8859-1"), ""), lambda c: c != ""), lambda c: F.ascii(c))


def byte_sum(payload: Column) -> Column:
    """Sum of the byte values modulo 2**32."""
    return F.aggregate(byte_values(payload), F.lit(0).cast("long"), lambda a, x: a + x) % F.lit(1 << 32)


def word_at(digest: Column, word: int) -> Column:
    """The little-endian unsigned 32-bit word of a hex digest, as long."""
    digits = [F.substring(digest, word * 8 + 2 * i + 1, 2) for i in (3, 2, 1, 0)]
    return F.conv(F.concat(*digits), 16, 10).cast("long")


def sketch_positions(digest: Column, depth: int = 4, width: int = 262_144) -> Column:
    """Positions of a fingerprint in the rows of a count-min sketch: word i modulo the width."""
    return F.array(*[word_at(digest, i) % width for i in range(depth)])


def keyed_token(digest: Column, key: str) -> Column:
    """A deterministic keyed stand-in for a fingerprint: equal fingerprints keep equal tokens, so joins work."""
    return F.sha2(F.concat(F.lit(key.encode()), as_bytes(digest)), 256)


def encrypt(payload: Column, key: bytes, mode: str = "GCM") -> Column:
    """Encryption under a 16- or 32-byte key with a fresh random vector per value, which it carries along."""
    return F.aes_encrypt(payload, F.lit(key), F.lit(mode), F.lit("DEFAULT" if mode == "GCM" else "PKCS"))


def decrypt(payload: Column, key: bytes, mode: str = "GCM") -> Column:
    return F.aes_decrypt(payload, F.lit(key), F.lit(mode), F.lit("DEFAULT" if mode == "GCM" else "PKCS"))
