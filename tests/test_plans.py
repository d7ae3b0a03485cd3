"""Policies, manifests, command line, streams and compositions."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cloakframe import Policy, contains_pii, load_policy, mask_pii, masking_manifest, register, write_manifest
from cloakframe.sources import read_table
from cloakframe.streaming import hit_rates

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture
def table(spark):
    return spark.createDataFrame([("12.345.678-5 a@b.org", "4111 1111 1111 1111", 1), ("11.222.333/0001-81", None, 2), ("clean", "529.982.247-25", 3)], "notes string, card string, amount long")


def test_policy_rules(table):
    got = Policy({"card": {"patterns": ["credit_card"]}, "notes": dict(mode="consistent", salt="s")}).apply(table).collect()
    assert got[0]["card"] == "411111******1111" and got[2]["card"] == "529.982.247-25" and got[0]["notes"].endswith("*@b.org")
    assert Policy({}).apply(table).columns == table.columns
    with pytest.raises(ValueError):
        Policy({"nope": {}}).apply(table)
    for rule in ({"mode": "fpe"}, {"mode": "consistent"}, {"patterns": ["nope"]}):
        with pytest.raises(ValueError):
            Policy({"card": rule})
    with pytest.raises(ValueError):
        Policy.from_dict({"columns": [{"name": "card"}]})


def test_policy_files(tmp_path, monkeypatch):
    monkeypatch.setenv("PEPPER", "hot")
    (tmp_path / "a.yaml").write_text("columns:\n  card:\n    mode: consistent\n    salt: ${PEPPER}\n    patterns: [credit_card]\n")
    (tmp_path / "b.toml").write_text('[columns.card]\nmode = "consistent"\nsalt = "${PEPPER}"\npatterns = ["credit_card"]\n')
    (tmp_path / "c.toml").write_text('[[columns]]\nname = "card"\nmode = "consistent"\nsalt = "${PEPPER}"\npatterns = ["credit_card"]\n')
    rules = [load_policy(tmp_path / n).rules for n in ("a.yaml", "b.toml", "c.toml")]
    assert rules[0] == rules[1] == rules[2] == {"card": dict(mode="consistent", salt="hot", patterns=["credit_card"])}
    (tmp_path / "d.yml").write_text("columns:\n  card: {mode: consistent, salt: '${NOT_SET_ANYWHERE}'}\n")
    with pytest.raises(KeyError):
        load_policy(tmp_path / "d.yml")
    with pytest.raises(FileNotFoundError):
        load_policy(tmp_path / "none.yaml")
    (tmp_path / "e.ini").write_text("")
    with pytest.raises(ValueError) as refused:
        load_policy(tmp_path / "e.ini")
    assert "unsupported" in str(refused.value)


def test_manifest(table, tmp_path):
    m = masking_manifest(table, mode="fpe")
    rows = [(r["column"], r["pii_family"], r["match_count"], r["mask_mode"]) for r in m.collect()]
    assert rows == [("notes", "email", 1, "asterisk"), ("notes", "rut", 1, "fpe"), ("notes", "cnpj", 1, "fpe"), ("card", "credit_card", 1, "fpe"), ("card", "cpf", 1, "fpe")]
    write_manifest(m, tmp_path / "m.json", source="table")
    document = json.loads((tmp_path / "m.json").read_text())
    assert document["record_count"] == 5 and document["source"] == "table" and document["records"][0]["regulation"]
    assert masking_manifest(table, []).count() == 0 and masking_manifest(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        masking_manifest(table, ["nope"])
    with pytest.raises(ValueError):
        masking_manifest(table, mode="nope")


def test_clean_rows_dont_travel(spark):
    """The keyed modes hand Python null for values without a candidate."""
    plan = spark.range(1).select(F.lit("x").alias("s")).select(mask_pii("s", mode="consistent", salt="x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_native_plan_has_no_python(spark, table):
    plan = table.select(mask_pii("notes"), contains_pii("card"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_sql(spark):
    register(spark)
    assert spark.sql("SELECT mask_pii('mail a.b@c.org'), contains_pii('x'), extract_pii('1.2.3.4').ip").first()[:] == ("mail ***@c.org", False, "1.2.3.4")


def test_command_line(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "in"))
    (tmp_path / "p.toml").write_text('[columns.card]\npatterns = ["credit_card"]\n')
    run = lambda *a: subprocess.run([sys.executable, "-m", "cloakframe", "run", *map(str, a)], cwd=ROOT, capture_output=True, text=True, timeout=200)
    done = run(tmp_path / "p.toml", tmp_path / "in", tmp_path / "out")
    assert done.returncode == 0 and "wrote 3 rows" in done.stdout
    assert sorted(r["card"] or "" for r in spark.read.parquet(str(tmp_path / "out")).collect())[1] == "411111******1111"
    failed = run(tmp_path / "none.toml", tmp_path / "in", tmp_path / "out")
    assert failed.returncode == 1 and failed.stderr.startswith("error:") and "Traceback" not in failed.stderr


def test_read_table(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n")
    assert read_table(spark, str(tmp_path / "x.csv")).first()[:] == ("1", "x")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "x.xls"))


def test_stream_of_hit_rates(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a@b.org"), ("2024-01-01 00:01:00", "clean"), ("2024-01-01 00:07:00", "1.2.3.4")]
    spark.createDataFrame(rows, "t string, s string").selectExpr("cast(t as timestamp) ts", "s").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, s string").parquet(str(tmp_path / "in"))
    q = hit_rates(stream, "ts", "s", patterns=["email", "ip"]).writeStream.format("memory").queryName("rates_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("rates_test").orderBy("window.start").select("n", "hits").collect()
    assert [tuple(r) for r in got] == [(2, 1), (1, 1)]


def test_extra_columns_pass_through(table):
    assert table.withColumn("notes", mask_pii("notes", ["email"])).columns == ["notes", "card", "amount"]


def test_entry(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert "mask_documents" in names and set(e.oracle_sql()) <= set(names)
    assert e.entry(spark).count() >= 0


def test_join_on_pseudonyms_without_collisions(spark, tmp_path):
    """Keys whose salted pseudonyms are equal, keys longer than ten digits, negative ones and nulls join with their own only."""
    from cloakframe.plans.queries import SALT, join_on_pseudonyms

    keys = [79591, 94410, 12345678901, 12345678902, 2**63 - 1, 5, -5]
    salted = spark.createDataFrame([("+49 0000079591",), ("+49 0000094410",)], "t string").select(mask_pii("t", ["phone"], mode="consistent", salt=SALT))
    assert salted.distinct().count() == 1
    spark.createDataFrame([(k, f"s{i}") for i, k in enumerate(keys)] + [(None, "none")], "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k, float(i)) for i, k in enumerate(keys)] + [(None, 1.0), (7, 1.0)], "o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in join_on_pseudonyms(spark, str(tmp_path)).collect())
    assert got == [(f"s{i}", 1, float(i)) for i in range(len(keys))]
