"""Times profiles of short texts and the headline queries over the tables in $BENCH_SF_DIR; prints one JSON line.

A profile is $BENCH_ROWS cached rows of one text column: clean (no identifier), dense (one in each row) or mixed (both by turns),
masked and tested for the families of its group alone. Everything runs once before it is timed, profiles over few rows, so that
what is timed is work; what the analysis of a query takes the first time stands apart, under "build".
"""

from __future__ import annotations

import json
import os
import re
import signal
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import contains_pii, extract_pii, mask_pii, mask_pii_audit, mask_pii_fpe
from cloakframe.plans.queries import OLD, queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROWS = int(os.environ.get("BENCH_ROWS", 1_000_000))
#: No query is begun after so many seconds in all, and then it isn't listed; a full run takes less.
SECONDS = float(os.environ.get("BENCH_SECONDS", 900))
CLEAN = ["the quick brown fox jumps over the lazy dog", "nothing to see in this line of text", "an order was shipped to the customer", "please call back when there is time"]
SAMPLES = {
    "eu": ("iban vat email phone".split(), ["pay to DE89370400440532013000 now", "vat id DE123456789 given", "write to jane.doe@example.com", "call +49 151 23456789 today"]),
    "card": (["credit_card"], ["card 4111 1111 1111 1111 used", "card 378282246310005 used"]),
    "us": (["ssn", "us_passport"], ["ssn 123-45-6789 on file", "passport C12345678 shown"]),
    "latam": (["rut", "cpf", "curp"], ["rut 12.345.678-5 on file", "cpf 529.982.247-25 on file", "curp BADD110313HCMLNS09 on file"]),
    "network": (["ip"], ["from 192.168.10.20 to host", "from 2001:db8::1 to host"]),
    "eu_id": (["dni", "nie", "nin", "personalausweis"], ["dni 12345678Z on file", "nie X1234567L on file", "nin AB123456C on file", "ausweis T220001293 shown"]),
}
SAMPLES["all15"] = ([p for patterns, _ in SAMPLES.values() for p in patterns], [s for _, samples in SAMPLES.values() for s in samples])
KINDS = {"dense": lambda s: s, "mixed": lambda s: [x for p in zip(s, CLEAN * len(s)) for x in p], "clean": lambda s: CLEAN}
HEADLINE = "mask_documents contains_documents audit_documents extract_documents rates top_sources join_on_pseudonyms consistent_mask fpe_cards rekey family_iban family_credit_card all_families".split()


def profile(spark: SparkSession, texts: list[str], rows: int) -> DataFrame:
    pick = F.get(F.array(*map(F.lit, texts)), (F.col("id") % len(texts)).cast("int"))
    return spark.range(0, rows, 1, int(CPUS)).select(F.concat(pick, F.lit(" ")).alias("text"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    build: dict[str, float] = {}
    began = time.perf_counter()

    def report(*_) -> None:
        sf = re.search(r"sf([0-9.]+)", SF_DIR)
        print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "build": build, "rows": ROWS, "sf": float(sf[1]) if sf else None}), flush=True)

    signal.signal(signal.SIGTERM, lambda *_: (report(), sys.stdout.flush(), os._exit(0)))

    def sink(df: DataFrame) -> float:
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t, 3)

    def run(name: str, make, warm) -> None:
        if time.perf_counter() - began > SECONDS:
            return
        t = time.perf_counter()
        small = warm()
        build[name] = round(time.perf_counter() - t, 3)
        sink(small)
        times[name] = sink(make())

    for group, (patterns, samples) in SAMPLES.items():
        for kind, texts in KINDS.items():
            few, many = (profile(spark, texts(samples), n) for n in (1000, ROWS))
            many = many.cache()
            sink(many)
            for what, f in (("mask", mask_pii), ("contains", contains_pii)):
                run(f"{group}_{kind}_{what}", lambda: many.select(f("text", patterns)), lambda: few.select(f("text", patterns)))  # noqa: B023
            if (group, kind) == ("card", "dense"):
                run("card_dense_fpe", lambda: many.select(mask_pii_fpe("text", *OLD, patterns=["credit_card"])), lambda: few.select(mask_pii_fpe("text", *OLD, patterns=["credit_card"])))  # noqa: B023
            if (group, kind) == ("eu", "dense"):
                run("eu_dense_extract", lambda: many.select(extract_pii("text", patterns)), lambda: few.select(extract_pii("text", patterns)))  # noqa: B023
                run("eu_dense_audit", lambda: many.select(mask_pii_audit("text", patterns)), lambda: few.select(mask_pii_audit("text", patterns)))  # noqa: B023
            many.unpersist()
    named = queries()
    for q in HEADLINE:
        run(q, lambda: named[q](spark, SF_DIR), lambda: named[q](spark, SF_DIR))  # noqa: B023
    report()


if __name__ == "__main__":
    main()
