"""Column functions for personal data. All arguments are checked when a column is built.

Detection and asterisk masking are native expressions; the keyed modes are Arrow functions that close over
their keys, so that no plan, log or page of the user interface shows one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..families import REVERSIBLE, chosen
from ..keys import validate_key, validate_tweak
from ..operators import crypto, kernel
from .native import sql_function

MODES = ("asterisk", "consistent")


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _named(column: Column | str, out: Column) -> Column:
    """Results take the place of their input: under ``withColumn`` or ``select`` they bear its name."""
    return out.alias(column) if isinstance(column, str) else out


def _session() -> SparkSession:
    spark = SparkSession.active()
    if spark is None:
        raise RuntimeError("a column function needs an active Spark session")
    return spark


def _native(kind: str, column: Column | str, patterns: Sequence[str] | None) -> Column:
    families = chosen(patterns)
    return _named(column, F.call_function(sql_function(_session(), kind, families), _col(column)))


def mask_pii(column: Column | str, patterns: Sequence[str] | None = None, mode: str = "asterisk", salt: str | None = None) -> Column:
    """The text with its identifiers masked: by asterisks, or with ``mode="consistent"`` the digits of reversible families by
    digits that depend on the salt and the value alone. ``patterns`` selects families, applied in their order; None is null."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, valid modes: {', '.join(MODES)}")
    if mode == "asterisk":
        if salt is not None:
            raise ValueError("salt is only used with mode='consistent'")
        return _native("mask", column, patterns)
    if not salt:
        raise ValueError("mode='consistent' needs a salt")
    return _named(column, _gated(column, patterns, crypto.keyed_digits(salt)))


def contains_pii(column: Column | str, patterns: Sequence[str] | None = None) -> Column:
    """Whether the text has an identifier of any of the families; null for null."""
    return _native("contains", column, patterns)


def extract_pii(column: Column | str, patterns: Sequence[str] | None = None) -> Column:
    """A struct with the first identifier of each of the 36 families in the original text."""
    return _native("extract", column, patterns)


def mask_pii_audit(column: Column | str, patterns: Sequence[str] | None = None) -> Column:
    """A struct of the ``masked`` text and the ``counts`` of replacements by family, which are 0 for null. Families are
    always applied in the order of the cascade."""
    families = chosen(patterns)
    if patterns is not None:
        order = {f.name: k for k, f in enumerate(chosen(None))}
        families = sorted({f.name: f for f in families}.values(), key=lambda f: order[f.name])
    return _named(column, F.call_function(sql_function(_session(), "audit", families), _col(column)))


def mask_pii_fpe(column: Column | str, key: bytes, tweak: bytes, patterns: Sequence[str] | None = None, mode: str = "ff3", on_error: str = "keep") -> Column:
    """The text with the digits of reversible families encrypted in their format, and other families masked by asterisks.

    A token outside the cipher's domain of 6 to 30 digits stays in clear with ``on_error="keep"``, and fails the query with ``"raise"``.
    """
    if on_error not in ("keep", "raise"):
        raise ValueError("on_error must be 'keep' or 'raise'")
    cipher = crypto.cipher(validate_key(key), validate_tweak(tweak), mode)
    return _named(column, _gated(column, patterns, crypto.by_length(cipher.run), on_error == "raise"))


def _gated(column: Column | str, patterns: Sequence[str] | None, encrypt: crypto.Many, strict: bool = False) -> Column:
    """Only values with a candidate travel to Python; the others are taken as they are."""
    c = _col(column)
    families = chosen(patterns)
    names = None if patterns is None else list(patterns)

    @F.arrow_udf("string")
    def protect(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        families = chosen(names)
        for values in columns:
            yield pa.array(kernel.replaced(values.to_pylist(), families, encrypt, strict), pa.string())

    candidate = c.rlike("[0-9@]")
    if any(f.name == "ip" for f in families):
        candidate |= c.rlike("(?s):.*:")
    return F.coalesce(protect(F.when(candidate, c)), c)


def rekey_pii_fpe(
    column: Column | str,
    old_key: bytes, old_tweak: bytes | bytearray,
    new_key: bytes, new_tweak: bytes | bytearray,
    mode: str = "ff3",
    pattern: str | None = None,
) -> Column:
    """Cells that hold one encrypted identifier each, decrypted with the old key and encrypted with the new one.

    A cell that can't be rotated fails the query; the error doesn't show the cell. ``pattern`` names the family
    whose format a cell has: phones keep their country code, RUTs and NITs their check digit.
    """
    if pattern is not None and pattern not in REVERSIBLE:
        raise ValueError(f"unknown pattern {pattern!r}, valid patterns: {', '.join(sorted(REVERSIBLE))}")
    old = crypto.cipher(validate_key(old_key), validate_tweak(old_tweak), mode)
    new = crypto.cipher(validate_key(new_key), validate_tweak(new_tweak), mode)
    c = _col(column)

    @F.arrow_udf("string")
    def rotate(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        many = crypto.by_length(lambda texts: new.run(old.run(texts, backwards=True)))
        for values in columns:
            cells = values.to_pylist()
            parts = [kernel.rekey(x, pattern) for x in cells]
            at = [i for i, p in enumerate(parts) if p]
            for i, turned in zip(at, many([parts[i][2] for i in at])):
                if turned is None:
                    raise ValueError(f"a cell of {len(parts[i][2])} digits can't be rotated, the cipher takes {crypto.LEAST} to {crypto.MOST}")
                a, b, _ = parts[i]
                cells[i] = cells[i][:a] + kernel.refill(cells[i][a:b], turned) + cells[i][b:]
            yield pa.array(cells, pa.string())

    return _named(column, F.coalesce(rotate(F.when(c.rlike("[0-9]"), c)), c))


def register(spark: SparkSession) -> None:
    """Make ``mask_pii``, ``contains_pii``, ``extract_pii`` and ``mask_pii_audit`` callable from SQL in this session."""
    for name, kind in (("mask_pii", "mask"), ("contains_pii", "contains"), ("extract_pii", "extract"), ("mask_pii_audit", "audit")):
        sql_function(spark, kind, chosen(None), name)


def register_keyed(spark: SparkSession, name: str, key: bytes, tweak: bytes, patterns: Sequence[str] | None = None, mode: str = "ff3") -> None:
    """Make a function of one argument that encrypts with this key callable from SQL under ``name``."""
    encrypt = crypto.by_length(crypto.cipher(validate_key(key), validate_tweak(tweak), mode).run)
    chosen(patterns)
    names = None if patterns is None else list(patterns)

    @F.arrow_udf("string")
    def protect(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        families = chosen(names)
        for values in columns:
            yield pa.array(kernel.replaced(values.to_pylist(), families, encrypt), pa.string())

    spark.udf.register(name, protect)
