"""The queries of the masking engine, each over whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..families import FIELDS
from ..functions import contains_pii, extract_pii, mask_pii, mask_pii_audit, mask_pii_fpe, register, rekey_pii_fpe
from ..keys import derive_key, derive_tweak
from .derived import CASES, MORE, n, oracle
from .manifest import masking_manifest
from .policy import Policy

SOME = ["email", "ip", "credit_card"]
SALT = "pepper"
OLD = (derive_key(b"master secret of the tests", "old"), derive_tweak(b"master secret of the tests", "old"))
NEW = (derive_key(b"master secret of the tests", "new"), derive_tweak(b"master secret of the tests", "new"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows over all cores: a file is read by as many tasks as it has row groups, a table of short rows by one or few."""
    return df.repartition(4 * spark.sparkContext.defaultParallelism)


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.filter(contains_pii("text", SOME)).select("doc_id", mask_pii("text", SOME))


def contains_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", *[contains_pii(F.col("text"), [f]).alias(f) for f in SOME])


def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", extract_pii("text", SOME))
    return docs.select("doc_id", *[F.col(f"text.{f}").alias(f) for f in SOME]).filter(" OR ".join(f"{f} IS NOT NULL" for f in SOME))


def audit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", mask_pii_audit("text", SOME))
    return docs.select("doc_id", *[F.col(f"text.counts.{f}").alias(f) for f in SOME])


def family(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection, extraction, masking and counting of one family."""
    name, case = MORE.get(name) or (name, CASES[name])
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("ref "), F.expr(case.made), F.lit(" end")).alias("t"))
    audited = rows.select("o_orderkey", contains_pii("t", [name]).alias("contained"), extract_pii("t", [name]).alias("e"), mask_pii("t", [name]).alias("masked"), mask_pii_audit("t", [name]).alias("a"))
    return audited.select("o_orderkey", "contained", F.col(f"e.{name}").alias("found"), "masked", F.col(f"a.counts.{name}").alias("n"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.expr(CASES["pesel"].made).alias("pesel"))


def consistent_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("o_orderkey", mask_pii("pesel", ["pesel"], mode="consistent", salt=SALT))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.expr(CASES["credit_card"].made).alias("card"))


def fpe_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ciphers keep the format, change what is valid and leave the rest alone; ``fpe_cards`` has what they give."""
    out = _cards(spark, sf_dir)
    for mode in ("ff3", "ff1"):
        c = mask_pii_fpe(F.col("card"), *OLD, patterns=["credit_card"], mode=mode)
        out = out.withColumn(mode, c)
    blank = lambda c: F.regexp_replace(c, "[0-9]", "#")
    return out.select("o_orderkey", *[(blank(m) == blank("card")).alias(f"{m}_format") for m in ("ff3", "ff1")], *[(F.col(m) != F.col("card")).alias(f"{m}_changed") for m in ("ff3", "ff1")])


def rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotating a cell gives what the new key gives directly; rotating back gives the cell again."""
    rows = _cards(spark, sf_dir).filter(contains_pii(F.col("card"), ["credit_card"]))
    direct = [mask_pii_fpe(F.col("card"), *k, patterns=["credit_card"]) for k in (OLD, NEW)]
    rows = rows.select("o_orderkey", direct[0].alias("old"), direct[1].alias("new"))
    turned = rows.select("o_orderkey", "old", "new", rekey_pii_fpe(F.col("old"), *OLD, *NEW, pattern="credit_card").alias("turned"))
    back = rekey_pii_fpe(F.col("turned"), *NEW, *OLD, pattern="credit_card")
    return turned.select("o_orderkey", (F.col("turned") == F.col("new")).alias("as_direct"), (back == F.col("old")).alias("full_circle"))


#: (mode of the keys, digits, their ciphertext), as published for FF3-1 with 256-bit keys.
VECTORS = [
    ("a", "890121234567890000", "828619517847699900"), ("a", "4111111111111111", "1064960767628711"), ("a", "123456789", "607331705"), ("a", "14155552671", "34780551212"),
    ("a", "12345678901234567890123456", "80998387094033638262634220"), ("a", "000000", "706154"), ("b", "890121234567890000", "321377551284055879"), ("b", "0123456789", "8177437935"),
]
VECTOR_KEYS = {"a": (bytes(range(32)), bytes(range(7))), "b": (b"\xef" * 32, bytes.fromhex("fedcba98765432"))}


def fpe_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card with a published ciphertext in many formats around the orders' keys: encrypted, and rotated back to itself."""
    key, tweak = VECTOR_KEYS["a"]
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.expr("concat('card ', CASE o_orderkey % 3 WHEN 0 THEN '4111 1111 1111 1111' WHEN 1 THEN '4111-1111-1111-1111' ELSE '4111111111111111' END, ' of ', o_orderpriority)").alias("t"))
    sealed = rows.select("o_orderkey", mask_pii_fpe(F.col("t"), key, tweak, ["credit_card"]).alias("sealed"))
    cell = F.regexp_replace(F.regexp_replace("sealed", "^card ", ""), " of .*", "")
    return sealed.select("o_orderkey", "sealed", rekey_pii_fpe(cell, key, tweak, *NEW, pattern="credit_card").alias("turned")).select(
        "o_orderkey", "sealed", rekey_pii_fpe(F.col("turned"), *NEW, key, tweak, pattern="credit_card").alias("back"), (F.col("turned") != cell).alias("rotated")
    )


#: Texts of several identifiers, what the whole cascade makes of them, and how often it counts the family named.
CASCADE = [
    ("8507158001087 and 9001015009086", "************* and *************", "za_id", 1),
    ("9001015009086", "*************", "rrn", 1),
    ("ID 8507158001087 on file", "ID ************* on file", "za_id", 1),
    ("x 9013015009081 y", "x 9013015009081 y", "za_id", 0),
    ("850715800108", "850715800108", "za_id", 0),
    ("123-45-6789, 078-05-1120 and 666-45-6789", "***-**-****, 078-05-1120 and 666-45-6789", "ssn", 1),
    ("fecha 20250630", "fecha 20250630", "pe_dni", 0),
    ("DNI 12345678", "DNI ********", "pe_dni", 1),
    ("id 012345674", "id *********", "il_id", 1),
    ("fe80::1. and 12:30:45", "fe80:0:0:0:****:****:****:****. and 12:30:45", "ip", 1),
    ("RUT 76.354.771-K, CPF 529.982.247-25", "RUT **********-K, CPF *********-25", "rut", 1),
    ("11.222.333/0001-81", "************-81", "cnpj", 1),
]


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a text each by turns, through the whole cascade."""
    texts = F.array(*[F.lit(t) for t, *_ in CASCADE])
    rows = _spread(spark, _read(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", F.get(texts, (F.col("o_orderkey") % len(CASCADE)).cast("int")).alias("t"))
    audited = rows.select("o_orderkey", mask_pii("t"), mask_pii_audit("t").alias("a"))
    count = F.expr("CASE o_orderkey % " + str(len(CASCADE)) + " " + " ".join(f"WHEN {k} THEN a.counts.{f}" for k, (_, _, f, _) in enumerate(CASCADE)) + " END")
    return audited.select("o_orderkey", F.col("t").alias("masked"), F.col("a.masked").alias("audited"), count.alias("n"))


def pe_dni_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight digits with and without a word that makes them a DNI, by the whole cascade."""
    around = F.expr(f"CASE o_orderkey % 3 WHEN 0 THEN concat('su DNI es ', {n(8)}) WHEN 1 THEN concat('order ', {n(8)}, ' shipped') ELSE concat({n(8)}, ' (documento nacional de identidad)') END")
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", around.alias("t"))
    return rows.select("o_orderkey", mask_pii("t").alias("masked"), extract_pii("t").getField("pe_dni").alias("found"))


def join_on_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides that were pseudonymised apart still join: customers and their orders on an equally encrypted key.

    Encryption maps different keys to different pseudonyms; the ten digits of a salted one don't: 36 pairs of 900,000 keys share theirs.
    """

    def alias(c: str) -> Column:
        # All 19 digits of a key, in two numbers of ten; a sign stays in front.
        k = F.lpad(F.ltrim(F.col(c).cast("string"), F.lit("-")), 20, "0")
        text = F.concat(F.when(F.col(c) < 0, "minus ").otherwise(""), F.lit("+49 "), F.substring(k, 1, 10), F.lit(" +49 "), F.substring(k, 11, 10))
        return mask_pii_fpe(text, *OLD, patterns=["phone"]).alias("alias")

    customers = _read(spark, sf_dir, "customer").select(alias("c_custkey"), "c_mktsegment")
    # Orders are summed by customer first, so that a key is encrypted once and not for each order.
    orders = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    joined = orders.select(alias("o_custkey"), "n", "total").join(customers, "alias")
    return joined.groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents with personal data by source and language, with subtotals."""
    docs = _read(spark, sf_dir, "documents").select("source", "lang", contains_pii("text", SOME).alias("hit"))
    return docs.rollup("source", "lang").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sources with the most matches, by rank."""
    docs = _read(spark, sf_dir, "documents").select("source", mask_pii_audit("text", SOME).getField("counts").alias("c"))
    sums = docs.groupBy("source").agg(F.sum(F.col("c.email") + F.col("c.ip") + F.col("c.credit_card")).alias("matches"))
    ranked = sums.withColumn("place", F.row_number().over(Window.orderBy(F.desc("matches"), "source")))
    return ranked.filter("place <= 3")


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without personal data, by an anti-join on those with some."""
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang").join(docs.filter(contains_pii("text", SOME)).select("doc_id"), "doc_id", "left_anti")


def distinct_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select(mask_pii(F.expr(CASES["credit_card"].made), ["credit_card"]).alias("masked"))
    return rows.distinct()


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over a table with several kinds of columns finds."""
    rows = _spread(spark, _read(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", F.expr(CASES["pesel"].made).alias("pesel"), F.expr(CASES["ssn"].made).alias("ssn"), F.expr(CASES["email"].made).alias("contact"))
    return masking_manifest(rows, ["ssn", "contact"], mode="fpe")


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.expr(CASES["pesel"].made).alias("pesel"), F.expr(CASES["email"].made).alias("contact"))
    rules = {"columns": {"pesel": {"patterns": ["pesel"]}, "contact": {"mode": "consistent", "salt": SALT, "patterns": ["email"]}}}
    return Policy.from_dict(rules).apply(rows)


def sql_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from SQL, with all families."""
    register(spark)
    _spread(spark, _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).createOrReplaceTempView("cloakframe_customer")
    return spark.sql(
        "SELECT c_custkey, mask_pii(concat('card 4111 1111 1111 1111, ', c_mktsegment)) AS masked, contains_pii(c_mktsegment) AS hit, "
        "extract_pii(concat('mail a', cast(c_custkey AS string), '@b.org')).email AS mail, mask_pii_audit(concat('ip 10.0.0.', cast(c_custkey % 300 AS string))).counts.ip AS ips FROM cloakframe_customer"
    )


def all_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each family is found in the documents, with the whole cascade."""
    docs = _read(spark, sf_dir, "documents").select(mask_pii_audit("text").getField("counts").alias("c"))
    sums = docs.agg(*[F.sum(f"c.{f}").alias(f) for f in FIELDS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("n")) for f in FIELDS])).alias("r")).select("r.*").filter("n > 0")


def stream_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, masked as a stream."""
    from ..streaming import masked_once

    return masked_once(spark, f"{sf_dir}/documents.parquet", ["text"], ["doc_id", "lang"], SOME)


def queries() -> dict:
    named = [
        mask_documents, contains_documents, extract_documents, audit_documents, consistent_mask, fpe_format, rekey, join_on_pseudonyms, rates, top_sources,
        clean_documents, distinct_masked, manifest, policy, sql_mask, all_families, stream_mask, fpe_cards, cascade, pe_dni_context,
    ]
    return {q.__name__: q for q in named} | {f"family_{f}": partial(family, f) for f in [*CASES, *MORE]}


# ---- SQL ----

_RX = {"email": r"[-+%._0-9a-zA-Z]+@[-.0-9a-zA-Z]+\.[a-zA-Z][a-zA-Z]+", "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"}
_G = r"(?:[\s\-]?\d{4}){3}"
_CARD = rf"(?:3[47]\d\d[\s\-]?\d{{6}}[\s\-]?\d{{5}}|4\d\d\d{_G}|(?:5[1-5]\d\d|22[2-9][1-9]|2[3-6]\d\d|27[01]\d|2720){_G}|(?:6011|65\d\d|64[4-9]\d){_G}|(?:6304|6759|676[123])\d{{12}})"
_OK = {"email": "true", "ip": "list_max(list_transform(string_split(k, '.'), lambda p: p::int)) <= 255"}
_DIGITS = "regexp_replace(k, '[^0-9]', '', 'g')"
_LUHN_OF = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 1 THEN (2 * ({_DIGITS})[i]::int) // 10 + (2 * ({_DIGITS})[i]::int) % 10 ELSE ({_DIGITS})[i]::int END)) % 10 = 0"
_OK["credit_card"] = _LUHN_OF
_RX["credit_card"] = _CARD
_STAR = {
    "email": "concat(repeat('*', instr(k, '@') - 1), k[instr(k, '@'):])",
    "ip": "concat(string_split(k, '.')[1], '.', string_split(k, '.')[2], '.*.*')",
    "credit_card": f"concat(left({_DIGITS}, 6), repeat('*', length({_DIGITS}) - 10), right({_DIGITS}, 4))",
}


def _tokens(f: str, x: str) -> str:
    return rf"list_filter(regexp_extract_all({x}, '\b{_RX[f]}\b'), lambda k: {_OK[f]})"


def _masked(f: str, x: str) -> str:
    rx = rf"\b{_RX[f]}\b"
    all_ = rf"regexp_extract_all({x}, '{rx}')"
    gaps = rf"string_split_regex({x}, '{rx}')"
    put = f"list_transform({all_}, lambda k: CASE WHEN {_OK[f]} THEN {_STAR[f]} ELSE k END)"
    return f"array_to_string(list_transform(range(1, len({gaps}) + 1), lambda j: concat(({gaps})[j], coalesce(({put})[j], ''))), '')"


_HITS = "SELECT *, " + ", ".join(f"{_tokens(f, 'text')} AS {f}_" for f in SOME) + " FROM documents"
_HIT = " OR ".join(f"len({f}_) > 0" for f in SOME)


def _hmac(x: str) -> str:
    key = SALT.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in key) for p in (0x36, 0x5C))
    blob = lambda b: "'" + "".join(f"\\x{c:02X}" for c in b) + "'::BLOB"
    return f"sha256({blob(outer)} || unhex(sha256({blob(inner)} || encode({x}))))"


def _keyed(x: str) -> str:
    """The digits of x, keyed, as text."""
    return f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: ('0x' || ({_hmac(x)})[2 * i - 1 : 2 * i])::int % 10), '')"


_PESEL = oracle("pesel")


def oracle_sql() -> dict[str, str]:
    out = {f"family_{f}": oracle(f) for f in [*CASES, *MORE]}
    out["mask_documents"] = f"SELECT doc_id, x AS text FROM (SELECT doc_id, {_masked('credit_card', 'y')} AS x FROM (SELECT doc_id, {_masked('ip', 'z')} AS y FROM (SELECT doc_id, {_masked('email', 'text')} AS z FROM ({_HITS}) WHERE {_HIT})))"
    out["contains_documents"] = f"SELECT doc_id, {', '.join(f'len({f}_) > 0 AS {f}' for f in SOME)} FROM ({_HITS})"
    out["extract_documents"] = f"SELECT doc_id, {', '.join(f'{f}_[1] AS {f}' for f in SOME)} FROM ({_HITS}) WHERE {_HIT}"
    out["audit_documents"] = f"SELECT doc_id, {', '.join(f'len({f}_)::int AS {f}' for f in SOME)} FROM ({_HITS})"
    out["consistent_mask"] = f"SELECT o_orderkey, CASE WHEN n = 1 THEN {_keyed('t')} ELSE t END AS pesel FROM (SELECT o_orderkey, n, masked[5:15] AS u, found, t FROM ({_PESEL}) JOIN (SELECT o_orderkey, {CASES['pesel'].made} AS t FROM orders) USING (o_orderkey))"
    card = oracle("credit_card")
    out["fpe_format"] = f"SELECT o_orderkey, true AS ff3_format, true AS ff1_format, contained AS ff3_changed, contained AS ff1_changed FROM ({card})"
    out["rekey"] = f"SELECT o_orderkey, true AS as_direct, true AS full_circle FROM ({card}) WHERE contained"
    out["join_on_pseudonyms"] = "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"
    out["rates"] = f"SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE {_HIT}) AS hits FROM ({_HITS}) GROUP BY ROLLUP (source, lang)"
    total = " + ".join(f"len({f}_)" for f in SOME)
    out["top_sources"] = f"SELECT source, matches, place FROM (SELECT source, sum({total})::bigint AS matches, row_number() OVER (ORDER BY sum({total}) DESC, source)::int AS place FROM ({_HITS}) GROUP BY source) WHERE place <= 3"
    out["clean_documents"] = f"SELECT doc_id, lang FROM ({_HITS}) WHERE NOT ({_HIT})"
    out["distinct_masked"] = f"SELECT DISTINCT masked[5:length(masked) - 4] AS masked FROM ({card})"
    laws = {"ssn": "US — GLBA / state privacy laws", "email": "General personal data (cross-jurisdiction)"}
    out["manifest"] = (
        f"SELECT 'ssn' AS column, 'ssn' AS pii_family, sum(n)::bigint AS match_count, '{laws['ssn']}' AS regulation, 'fpe' AS mask_mode FROM ({oracle('ssn')}) "
        f"UNION ALL SELECT 'contact', 'email', count(*), '{laws['email']}', 'asterisk' FROM orders"
    )
    out["policy"] = f"SELECT p.o_orderkey, p.masked[5:15] AS pesel, e.masked[5:length(e.masked) - 4] AS contact FROM ({_PESEL}) p JOIN ({oracle('email')}) e USING (o_orderkey)"
    out["sql_mask"] = "SELECT c_custkey, concat('card 411111******1111, ', c_mktsegment) AS masked, false AS hit, concat('a', c_custkey, '@b.org') AS mail, (c_custkey % 300 < 256)::int AS ips FROM customer"
    # The documents hold identifiers of these three families only.
    sums = " UNION ALL ".join(f"SELECT '{f}' AS family, sum(len({f}_))::bigint AS n FROM ({_HITS})" for f in SOME)
    out["all_families"] = f"SELECT family, n FROM ({sums}) WHERE n > 0"
    out["stream_mask"] = f"SELECT doc_id, lang, {_masked('credit_card', 'y')} AS text FROM (SELECT doc_id, lang, {_masked('ip', 'z')} AS y FROM (SELECT doc_id, lang, {_masked('email', 'text')} AS z FROM documents))"
    by_turns = lambda parts: f"CASE o_orderkey % {len(parts)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(parts)) + " END"
    cells = by_turns(["'1064 9607 6762 8711'", "'1064-9607-6762-8711'", "'1064960767628711'"])
    out["fpe_cards"] = f"SELECT o_orderkey, concat('card ', {cells}, ' of ', o_orderpriority) AS sealed, {cells} AS back, true AS rotated FROM orders"
    masked = by_turns([f"'{m}'" for _, m, _, _ in CASCADE])
    out["cascade"] = f"SELECT o_orderkey, {masked} AS masked, {masked} AS audited, {by_turns([c for *_, c in CASCADE])} AS n FROM orders"
    dni = n(8)
    out["pe_dni_context"] = (
        f"SELECT o_orderkey, {by_turns([chr(39) + 'su DNI es ********' + chr(39), f'concat({chr(39)}order {chr(39)}, {dni}, {chr(39)} shipped{chr(39)})', chr(39) + '******** (documento nacional de identidad)' + chr(39)])} AS masked, "
        f"{by_turns([dni, 'NULL', dni])} AS found FROM orders"
    )
    return out
