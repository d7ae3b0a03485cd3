"""Exact deduplication by deterministic block naming.

Each text is cut into blocks of ``block_chars`` characters. Equal blocks meet in one partition,
where the distinct ones are sorted; a block's name is the integer of its partition and rank. Then
adjacent names of a document form pairs, equal pairs get a new name in the same way, and so on,
half as many each time, until one integer is left: the document's identity. Names come from
comparing whole blocks and whole pairs, so two documents share an identity only if their
texts are equal character for character.

The places of a block travel with it as a list. Blocks that more than ``HOT`` places may have, such as those of empty texts or of a page
that a third of the corpus repeats, are counted beforehand by a hash, which only says which way they go: their places are
split at random into parts of about ``HOT``, the parts named, and each block gets the least name of its parts, so that no
list grows with the corpus.

Defined cases: a null text has no identity, is nobody's copy and stays; empty texts are copies
of each other; repeated rows are copies; where ``doc_id`` ties or is null, the earliest row
counts as first (null ids last); an empty table gives an empty one; texts of any length are compared whole; extra columns,
whatever their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, small_enough, with_row_id, without_rows, write_table

BLOCK_CHARS = 4096

#: Places of a block in one list, about; documented bound of what a task holds for one block.
HOT = 100_000

#: Names of level k end in these low bits, hot ones in the odd number, so that names of two levels never meet.
_LEVELS = 64


def _listed(rows: DataFrame, content: list[str], low: int) -> DataFrame:
    """(name, *content, at) for rows (rid, pos, *content): the sorted distinct contents with their places."""
    name = F.monotonically_increasing_id() * _LEVELS + low
    return rows.groupBy(*content).agg(F.collect_list(F.struct("rid", "pos")).alias("at")).sortWithinPartitions(*content).select(name.alias("name"), "*")


def _named(rows: DataFrame, content: list[str], level: int) -> DataFrame:
    """(rid, pos, name) for rows (rid, pos, *content), as a written table."""
    put = lambda named: named.select("name", F.explode("at").alias("at")).select("at.rid", "at.pos", "name")
    way = F.xxhash64(*content)
    hot = write_table(rows.groupBy(way.alias("way")).agg(F.count("*").alias("n")).filter(F.col("n") > HOT))
    if hot.isEmpty():
        out = write_table(put(_listed(rows, content, 2 * level)))
        drop_tables(hot)
        return out
    side = F.broadcast(hot) if small_enough(hot, 16) else hot
    rows = rows.withColumn("way", way)
    cool = _listed(rows.join(side, "way", "left_anti"), content, 2 * level)
    part = F.pmod(F.xxhash64("rid", "pos"), F.ceil(F.col("n") / HOT)).cast("int")
    parts = write_table(_listed(rows.join(side, "way").withColumn("part", part), [*content, "part"], 2 * level + 1))
    least = parts.groupBy(*content).agg(F.min("name").alias("name"))
    one = parts.drop("name", "part").join(least, content)
    out = write_table(put(cool.select("name", "at")).unionByName(put(one)))
    drop_tables(hot, parts)
    return out


def identities(rows: DataFrame, rid: str, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(rid, identity) of each row whose text isn't null, as a written table."""
    cut = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    blocks = (
        rows.filter(F.col(text_col).isNotNull())
        .select(F.col(rid).alias("rid"), cut.alias("b"))
        .select("rid", F.posexplode(F.when(F.size("b") == 0, F.array(F.lit(""))).otherwise(F.col("b"))).alias("pos", "block"))
    )
    level = 0
    names = _named(blocks, ["block"], level)
    written = [names]
    most = names.agg(F.max("pos")).first()[0] or 0
    # Only documents of several blocks go on; rows with pos > 0 say which.
    longer = names.filter("pos > 0").select("rid").distinct()
    done = [names.join(longer, "rid", "left_anti").select("rid", F.col("name").alias("identity"))]
    todo = names.join(longer, "rid", "left_semi") if most else None
    while most:
        level += 1
        pairs = todo.groupBy("rid", F.expr("pos div 2").cast("int").alias("half")).agg(
            F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = write_table(pairs.withColumnRenamed("half", "pos"))
        todo = _named(pairs, ["left", "right"], level)
        written += [pairs, todo]
        most //= 2
    if todo is not None:
        done.append(todo.select("rid", F.col("name").alias("identity")))
    out = write_table(done[0] if len(done) == 1 else done[0].unionByName(done[1]))
    drop_tables(*written)
    return out


def _ranked(docs: DataFrame, id_col: str, text_col: str, block_chars: int) -> tuple[DataFrame, str, DataFrame, DataFrame]:
    rows, rid = with_row_id(docs)
    ids = identities(rows, rid, text_col, block_chars)
    keys = rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("doc"), F.col(text_col).isNull().alias("blank"))
    named = keys.join(ids, "rid", "left")
    firsts = (
        named.filter("identity IS NOT NULL")
        .groupBy("identity")
        .agg(F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "rid")).alias("first"), F.count("*").alias("n"))
    )
    return rows, rid, named, firsts


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document: ``doc_id``, ``first_doc_id`` (the id that stands for its
    identity), ``n_copies`` (rows that share it) and ``is_copy`` (false for the row to keep)."""
    _, _, named, firsts = _ranked(docs, id_col, text_col, block_chars)
    known = named.filter("identity IS NOT NULL").join(firsts, "identity").select(
        F.col("doc").alias("doc_id"), F.col("first.doc").alias("first_doc_id"), F.col("n").alias("n_copies"), (F.col("rid") != F.col("first.rid")).alias("is_copy")
    )
    blank = named.filter("identity IS NULL").select(F.col("doc").alias("doc_id"), F.col("doc").alias("first_doc_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(False).alias("is_copy"))
    return known.unionByName(blank)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the copies; one row of each identity stays, with all its columns."""
    rows, rid, named, firsts = _ranked(docs, id_col, text_col, block_chars)
    twice = firsts.filter("n > 1")
    removed = named.join(twice, "identity").filter(F.col("rid") != F.col("first.rid"))
    return without_rows(rows, rid, write_table(removed.select(F.col("rid").alias(rid))))
