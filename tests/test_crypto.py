"""Ciphers against published vectors, and the keyed column functions."""

import hashlib
import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe import derive_key, derive_tweak, mask_pii, mask_pii_fpe, register_keyed, rekey_pii_fpe, validate_key, validate_tweak
from cloakframe.operators.crypto import Aes256, Ff1, Ff3, by_length, cipher
from cloakframe.operators.kernel import replaced
from cloakframe.families import REGISTRY
from cloakframe.keys import hkdf
from cloakframe.plans.queries import VECTOR_KEYS, VECTORS

KEY, TWEAK = bytes(range(32)), bytes.fromhex("00010203040506")
NEW_KEY, NEW_TWEAK = bytes(range(1, 33)), bytes.fromhex("10111213141516")
FF1_KEY = bytes.fromhex("2B7E151628AED2A6ABF7158809CF4F3CEF4359D8D580AA4F7F036D6F04FC6A94")


def test_aes_vector():
    import numpy as np

    block = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)[None]
    assert Aes256(bytes(range(32))).encrypt(block).tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"


def test_ff3_vectors():
    for which, plain, sealed in VECTORS:
        c = Ff3(*VECTOR_KEYS[which])
        assert c.run([plain]) == [sealed] and c.run([sealed], backwards=True) == [plain]


def test_vectors_through_the_columns(spark):
    """Phone numbers of 6 digits and more behind a country code of one: all but the code is encrypted."""
    key, tweak = VECTOR_KEYS["a"]
    rows = [(p, c) for w, p, c in VECTORS if w == "a" and 7 <= len(p) <= 13]
    df = spark.createDataFrame([("+7" + p, "+7" + c) for p, c in rows], "s string, want string")
    assert df.filter(mask_pii_fpe(F.col("s"), key, tweak, ["phone"]) != F.col("want")).count() == 0 and len(rows) == 2


def test_hkdf_vector():
    """RFC 5869, test cases 1 and 3."""
    out = hkdf(b"\x0b" * 22, bytes(range(13)), bytes(range(0xF0, 0xFA)), 42)
    assert out.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    assert hkdf(b"\x0b" * 22, b"", b"", 42).hex() == "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"
    assert derive_key(b"m", "a", b"s") == hkdf(b"m", b"s", b"key:a") != derive_key(b"m", "a")


def test_ff1_vectors():
    assert Ff1(FF1_KEY, b"").run(["0123456789"]) == ["6657667009"]
    assert Ff1(FF1_KEY, bytes.fromhex("39383736353433323130")).run(["0123456789"]) == ["1001623463"]


@settings(deadline=None)
@given(st.lists(st.text("0123456789", min_size=6, max_size=30), min_size=1, max_size=5), st.sampled_from(["ff3", "ff1"]))
def test_round_trip(texts, mode):
    c = cipher(KEY, TWEAK, mode)
    there = by_length(c.run)(texts)
    assert [len(t) for t in there] == [len(t) for t in texts]
    assert by_length(lambda x: c.run(x, backwards=True))(there) == texts


def test_domain():
    assert by_length(Ff3(KEY, TWEAK).run)(["12345", "1" * 31, "123456"])[:2] == [None, None]


def test_keys():
    for bad in (b"short", b"\1" * 32):
        with pytest.raises(ValueError):
            validate_key(bad)
    with pytest.raises(TypeError):
        validate_key("x" * 32)
    with pytest.raises(ValueError):
        validate_tweak(b"123456")
    assert derive_key(b"m", "a") == derive_key(b"m", "a") != derive_key(b"m", "b") and len(derive_key(b"m", "a")) == 32
    assert derive_tweak(b"m", "a") == hmac.new(b"m", b"tweak:a", hashlib.sha256).digest()[:7]


def test_claims_keep_tokens_from_a_second_round():
    """A card's digits hold candidates of other families, before and after encryption."""
    c = by_length(Ff3(KEY, TWEAK).run)
    assert replaced(["4111111111111111"], REGISTRY, c) == ["1064960767628711"]


def test_token_outside_the_domain_stays():
    c = by_length(Ff3(KEY, TWEAK).run)
    assert replaced(["+354 12345"], REGISTRY, c) == ["+354 12345"]
    with pytest.raises(ValueError):
        replaced(["+351 12345"], REGISTRY, c, strict=True)


def test_columns(spark):
    df = spark.createDataFrame([(1, "card 4111 1111 1111 1111, a.b@c.org"), (2, None), (3, "clean"), (4, "fe80::a:b")], "i int, s string")
    got = {r["i"]: r for r in df.select("i", mask_pii_fpe(F.col("s"), KEY, TWEAK).alias("f"), mask_pii(F.col("s"), mode="consistent", salt="x").alias("c")).collect()}
    assert got[1]["f"] == "card 1064 9607 6762 8711, ***@c.org"
    digest = hmac.new(b"x", b"4" + b"1" * 15, hashlib.sha256).digest()
    flat = "".join(str(b % 10) for b in digest[:16])
    assert got[1]["c"] == f"card {flat[:4]} {flat[4:8]} {flat[8:12]} {flat[12:]}, ***@c.org"
    assert got[2]["f"] is None and got[2]["c"] is None and got[3]["f"] == "clean"
    assert got[4]["f"] == "fe80:0:0:0" + ":****" * 4


def test_keys_stay_out_of_plans(spark, capsys):
    df = spark.createDataFrame([("4111111111111111",)], "s string")
    df.select(mask_pii_fpe("s", KEY, TWEAK)).explain(True)
    shown = capsys.readouterr().out
    assert KEY.hex() not in shown and "AAECAwQFBg" not in shown and str(list(KEY))[1:20] not in shown


@pytest.mark.parametrize("mode", ("ff3", "ff1"))
@pytest.mark.parametrize("pattern,cell", [("credit_card", "4111-1111-1111-1111"), ("phone", "+49 151 23456789"), ("rut", "76.354.771-K"), ("co_nit", "900123456-8"), (None, "529.982.247-25")])
def test_rekey(spark, mode, pattern, cell):
    family = pattern or "cpf"
    df = spark.createDataFrame([(cell,), (None,), ("none",)], "s string")
    old = df.select(mask_pii_fpe("s", KEY, TWEAK, [family], mode=mode))
    turned = [r[0] for r in old.select(rekey_pii_fpe("s", KEY, TWEAK, NEW_KEY, NEW_TWEAK, mode, pattern)).collect()]
    assert turned == [r[0] for r in df.select(mask_pii_fpe("s", NEW_KEY, NEW_TWEAK, [family], mode=mode)).collect()]
    assert turned[1:] == [None, "none"] and turned[0] != cell


def test_rekey_refuses_and_keeps_the_cell_secret(spark):
    df = spark.createDataFrame([("98765",)], "s string")
    with pytest.raises(Exception) as e:
        df.select(rekey_pii_fpe("s", KEY, TWEAK, NEW_KEY, NEW_TWEAK)).collect()
    assert "can't be rotated" in str(e.value) and "98765" not in str(e.value)
    with pytest.raises(ValueError):
        rekey_pii_fpe("s", KEY, TWEAK, NEW_KEY, NEW_TWEAK, pattern="email")
    with pytest.raises(ValueError):
        mask_pii_fpe("s", KEY, TWEAK, mode="rot13")


def test_sql_function(spark):
    register_keyed(spark, "seal", KEY, TWEAK, ["credit_card"])
    assert spark.sql("SELECT seal('4111111111111111')").first()[0] == "1064960767628711"
