"""Every family: golden values, and native expressions against the Python kernel."""

import random

import pytest
from pyspark.sql import functions as F

from cloakframe import contains_pii, extract_pii, mask_pii, mask_pii_audit
from cloakframe.families import BY_NAME, FIELDS, REGISTRY, REVERSIBLE, chosen
from cloakframe.operators import kernel

#: (family, valid token, masked token)
GOLDEN = [
    ("iban", "DE89370400440532013000", "DE89" + "*" * 18),
    ("iban", "DE89 3704 0044 0532 0130 00", "DE89" + " ****" * 4 + " **"),
    ("iban", "LC55HEMM000100010012001200023015", "LC55" + "*" * 28),
    ("vat", "ATU12345678", "AT*********"),
    ("vat", "IE1A23456B", "IE********"),
    ("email", "jane.doe@example.co.uk", "********@example.co.uk"),
    ("ip", "192.168.10.20", "192.168.*.*"),
    ("ip", "2001:db8::1", "2001:db8:0:0" + ":****" * 4),
    ("ip", "::ffff:1.2.3.4", "0:0:0:0" + ":****" * 4),
    ("curp", "BADD110313HCMLNS09", "*" * 18),
    ("dni", "12345678Z", "********Z"),
    ("nie", "X1234567L", "********L"),
    ("nin", "AB 12 34 56 C", "************C"),
    ("personalausweis", "L01X00T471", "*" * 10),
    ("us_passport", "C12345678", "*" * 9),
    ("mbi", "1EG4TE5MK73", "*" * 11),
    ("codice_fiscale", "RSSMRA85T10A562S", "*" * 16),
    ("phone", "+49 151 2345678", "+49 *** *******"),
    ("phone", "+351 912345678", "+351 *********"),
    ("rut", "76.354.771-K", "**********-K"),
    ("rut", "12.345.678-5", "**********-5"),
    ("cpf", "529.982.247-25", "*********-25"),
    ("cpf", "52998224725", "*********-25"),
    ("cnpj", "11.222.333/0001-81", "************-81"),
    ("credit_card", "4111 1111 1111 1111", "411111******1111"),
    ("credit_card", "378282246310005", "378282*****0005"),
    ("ssn", "123-45-6789", "***-**-****"),
    ("arg_dni", "12.345.678", "**.***.***"),
    ("co_cc", "1.012.345.678", "*.***.***.***"),
    ("co_nit", "900123456-8", "*********-8"),
    ("personnummer", "811218-9876", "******-****"),
    ("personnummer", "19811218-9876", "********-****"),
    ("ec_cedula", "1710034065", "*" * 10),
    ("npi", "1234567893", "*" * 10),
    ("nhs", "943 476 5919", "*** *** ****"),
    ("uy_ci", "1.234.567-2", "*" * 11),
    ("sin", "046-454-286", None),
    ("sin", "130-692-544", "*" * 11),
    ("tfn", "123 456 782", "*** *** ***"),
    ("pesel", "44051401359", "*" * 11),
    ("bsn", "111222333", "*" * 9),
    ("my_number", "1234-5678-9018", "****-****-****"),
    ("rrn", "900101-5009086", "*" * 14),
    ("za_id", "8507158001087", "*" * 13),
    ("il_id", "012345674", "*" * 9),
]

#: Texts that a family must leave alone.
NEGATIVE = [
    ("iban", "DE89370400440532013001"), ("ip", "12:30:45"), ("ip", "00:1A:2B:3C:4D:5E"), ("ip", "std::env"), ("ip", "1.2.3"), ("ip", "256.1.1.1"), ("ip", "x2001:db8::1"),
    ("rut", "12.345.678-0"), ("cpf", "111.111.111-11"), ("cnpj", "11.222.333/0001-99"), ("ssn", "078-05-1120"), ("ssn", "000-12-3456"), ("ssn", "666-12-3456"),
    ("ssn", "912-12-3456"), ("co_nit", "900123456-0"), ("mbi", "1EG4TE51273"), ("mbi", "1SG4TE5MK72"), ("za_id", "9013015009081"), ("za_id", "-8507158001087"),
    ("il_id", "012345670"), ("il_id", "012345674-"), ("nin", "BG 12 34 56 C"), ("arg_dni", "12.345.678-5"), ("arg_dni", "11.222.333/0001-81"), ("phone", "+1 (743) 555-3824"),
    ("credit_card", "4111 1111 1111 1112"), ("sin", "130692544-1"), ("dni", "12345678A"),
]


@pytest.mark.parametrize("name,token,masked", GOLDEN)
def test_golden_values(name, token, masked):
    text = f"see {token} there"
    family = BY_NAME[name]
    if masked is None:
        assert kernel.mask(text, [family]) == text
    else:
        assert kernel.mask(text, [family]) == f"see {masked} there"
        assert kernel.first(text, family) == token.removeprefix("::ffff:")


@pytest.mark.parametrize("name,text", NEGATIVE)
def test_left_alone(name, text):
    assert kernel.mask(text, [BY_NAME[name]]) == text and not kernel.contains(text, [BY_NAME[name]])


def _noise(seed: int, n: int) -> list[str]:
    """Random strings of digits, separators and letters around golden tokens."""
    rng = random.Random(seed)
    tokens = [t for _, t, _ in GOLDEN] + [t for _, t in NEGATIVE]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.5:
                parts.append(rng.choice(tokens))
            elif kind < 0.8:
                parts.append("".join(rng.choice("0123456789") for _ in range(rng.randint(1, 16))))
            else:
                parts.append("".join(rng.choice("aZé9٣-./:+@ _") for _ in range(rng.randint(1, 8))))
        out.append(rng.choice(["", "-", ".", " ", ":"]).join(parts) if rng.random() < 0.3 else " ".join(parts))
    return out


FIXED = [None, "", "clean text", "fe80::a:b", "only : one", "٣٣٣.٣٣٣.٣٣٣", "dni 12345678 12345679", "documento nacional de identidad nº 12345678", "fecha 20250630",
         "é" * 20 + " dni " + "é" * 12 + "12345678", "1:2:3:4:5:6:7:8 1::2:3:4:5:6:7:8 fe80::1. ::1.2.3.04", "9001015009086 8507158001087"]


def test_email_search_in_linear_time_finds_the_same():
    import regex

    form = BY_NAME["email"].forms[0]
    plain, rng = regex.compile(form.pattern), random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a.@é-_9 +٣cx") if rng.random() < 0.7 else rng.choice(["a@b.cc", "@b.co", ".org"]) for _ in range(rng.randint(1, 14)))
        assert [(m.span(), m[0]) for m in plain.finditer(t)] == [(m.span(), m[0]) for m in form.regex.finditer(t)], t


@pytest.mark.parametrize("text", ["a." * 500_000 + " @", "a." * 500_000 + "@", "x@" * 500_000])
def test_email_takes_linear_time(spark, text):
    import time

    df = spark.createDataFrame([(text,)], "s string")
    contained = df.select(contains_pii("s", ["email"]))
    t = time.perf_counter()
    assert contained.first()[0] is False and time.perf_counter() - t < 10


@pytest.fixture(scope="module")
def rows(spark):
    values = FIXED + _noise(1, 400) + ["é.a@b.org a@b.com.x@y.com", "éabc.def@x.org", "..abc@x.org,-+a@b.cc", "a@b.cc@d.ee"]
    return values, spark.createDataFrame(list(enumerate(values)), "i int, s string").coalesce(1)


def _collect(rows, *columns):
    return [r for r in rows[1].select("i", *columns).orderBy("i").collect()]


def test_native_single_families(rows):
    """Each family alone, in one query for a kind."""
    values, _ = rows
    masked = _collect(rows, *[mask_pii(F.col("s"), [f]).alias(f) for f in FIELDS])
    for f in FIELDS:
        [family] = chosen([f])
        for v, r in zip(values, masked):
            assert r[f] == kernel.mask(v, [family]), (f, v)


def test_native_contains_and_extract(rows):
    values, _ = rows
    for patterns in (None, FIELDS):
        got = _collect(rows, extract_pii(F.col("s"), patterns).alias("e"), contains_pii(F.col("s"), patterns).alias("c"))
        for v, r in zip(values, got):
            want = {f.name: kernel.first(v, f) for f in chosen(patterns)}
            assert r["e"].asDict() == want, v
            assert r["c"] == kernel.contains(v, chosen(patterns)), v


def test_native_cascade_and_audit(rows):
    values, _ = rows
    got = _collect(rows, mask_pii(F.col("s")).alias("m"), mask_pii_audit(F.col("s")).alias("a"))
    for v, r in zip(values, got):
        text, counts = kernel.audit(v, REGISTRY)
        assert (r["m"], r["a"]["masked"]) == (text, text), v
        assert r["a"]["counts"].asDict() == {f: counts.get(f, 0) for f in FIELDS}, v


def test_selection_runs_in_callers_order(spark):
    df = spark.createDataFrame([("id 111222333",)], "s string")
    one = df.select(mask_pii("s", ["bsn", "sin"]), mask_pii_audit("s", ["sin", "bsn"]).alias("a")).first()
    assert one["s"] == "id *********" and one["a"]["counts"]["bsn"] == 1


def test_fields_and_nulls(spark):
    df = spark.createDataFrame([(None,)], "s string")
    r = df.select(mask_pii(F.col("s")).alias("m"), contains_pii(F.col("s")).alias("c"), extract_pii(F.col("s")).alias("e"), mask_pii_audit(F.col("s")).alias("a")).first()
    assert r["m"] is None and r["c"] is None
    assert list(r["e"].asDict()) == FIELDS and not any(r["e"])
    assert r["a"]["masked"] is None and set(r["a"]["counts"].asDict().values()) == {0}
    assert len(FIELDS) == 36 and len(REVERSIBLE) == 23


@pytest.mark.parametrize("bad", [[], ["nope"], "email"])
def test_patterns_are_checked(spark, bad):
    with pytest.raises(ValueError):
        contains_pii("s", bad)


def test_modes_are_checked(spark):
    for more in ({"mode": "other"}, {"salt": "x"}, {"mode": "consistent"}):
        with pytest.raises(ValueError):
            mask_pii("s", **more)


def test_gates_let_every_candidate_through(spark):
    """Where a stage's pattern finds a candidate, the shape of the text doesn't rule the stage out; no stage is without a gate."""
    from cloakframe.families import unconditional
    from cloakframe.functions import native
    from cloakframe.plans.derived import CASES, MORE
    from cloakframe.plans.queries import CASCADE

    made = [c.made for c in CASES.values()] + [c.made for _, c in MORE.values()]
    keys = spark.range(60).selectExpr("id AS o_orderkey").selectExpr(*[f"{m} AS t{i}" for i, m in enumerate(made)])
    tokens = [t for row in keys.collect() for t in row] + [t for t, *_ in CASCADE]
    tokens += ["IE1A23456B", "RO12", "AB 12 34 56 C", "1EG4TE5MK72", "120032A00000000", "4111\t1111\n1111 1111", "529982.247-25", "1234 567890", "1234-5678 9012", "+4930 12.34-567"]
    rng = random.Random(7)
    texts = tokens + [rng.choice(["", "x", "É", "_", "-", " "]).join(rng.choice(tokens) for _ in range(3)) for _ in range(3000)] + [f"{rng.choice(' .-_(é')}{t}{rng.choice(' .-_)é')}" for t in tokens]
    families = [*REGISTRY, unconditional(next(f for f in REGISTRY if f.name == "pe_dni"))]
    stages = [n for _, n, _ in native._stages(families)]
    assert set(stages) == set(native.GATES)
    patterns = {}
    for f in families:
        bare = "_bare" if f.name == "pe_dni" and not f.forms[0].around else ""
        patterns |= {f"{f.name}{bare}_{k}": p for k, (p, _, _) in enumerate(native._forms(f))}
    shaped = spark.createDataFrame([(t,) for t in texts], "x string").selectExpr(f"{native._let(native._state('x'), 'o', native._shaped())} AS o").cache()
    found = shaped.selectExpr(*[f"count_if(o.x rlike {native._raw(p)}) AS {n}" for n, p in patterns.items()]).first()
    missed = shaped.selectExpr(*[f"count_if(o.x rlike {native._raw(p)} AND NOT {native.GATES[n]}) AS {n}" for n, p in patterns.items()]).first()
    assert not any(missed), {n: missed[n] for n in patterns if missed[n]}
    assert all(found), [n for n in patterns if not found[n]]
    assert shaped.filter(f"NOT {native.GATES['ip_v6']} AND {native._has_v6('o.x')}").count() == 0


def test_short_rows_are_spread(spark, tmp_path):
    from cloakframe.plans.queries import _spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = _spread(spark, spark.read.parquet(str(tmp_path / "one")))
    assert rows.count() == 1000 and rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
