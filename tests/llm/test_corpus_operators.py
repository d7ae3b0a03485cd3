"""Operators that compare rows, and classifiers: against brute force and held-out accuracy, and on awkward rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import decontaminate, exact_dedup, jaccard_join, quality, toxicity
from cloakframe.llm.common import WORD, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, identity long, node long"


def frame(spark, rows):
    """Rows of (doc_id, text), with columns whose names clash with those used within."""
    return spark.createDataFrame([(i, t, "en", None, None, 1, 2, 3) for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n))


LONG = "very long text " * 30_000
ODD = [(1, None), (2, ""), (2, ""), (3, "one"), (4, "one"), (None, "one"), (5, LONG), (6, LONG), (7, LONG + "x"), (None, None), (8, "é" * 9000), (9, " "), (9, " ")]


# ---- exact dedup ----


@pytest.mark.parametrize("block,hot", [(3, 100_000), (7, 100_000), (4096, 100_000), (3, 4), (4096, 4)])
def test_exact_dedup_against_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9 if block < 9 else 2))) for _ in range(120)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["first_doc_id"], r["n_copies"], r["is_copy"]) for r in exact_dedup.exact_dedup(frame(spark, rows), block_chars=block).collect()}
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        assert got[i] == (same[0], len(same), i != same[0])


def test_exact_dedup_odd_rows(spark):
    df = frame(spark, ODD)
    got = [(str(r["doc_id"]), r["first_doc_id"], r["n_copies"], r["is_copy"]) for r in exact_dedup.exact_dedup(df).collect()]
    assert ("None", 3, 3, True) in got and ("6", 5, 2, True) in got and ("7", 7, 1, False) in got and ("1", 1, 1, False) in got
    assert len(got) == len(ODD)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "5", "7", "8", "9", "None"]
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0 and exact_dedup.exact_dedup(df.limit(0)).count() == 0


# ---- n-gram Jaccard join ----


def near_corpus(seed, n):
    rng, rows = random.Random(seed), []
    for g in range(n):
        base = prose(rng, rng.randint(5, 120)).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((len(rows), " ".join(w)))
    return rows


def brute_pairs(rows, n=jaccard_join.NGRAM, threshold=jaccard_join.THRESHOLD):
    sets = []
    for i, t in rows:
        w = WORD.findall(t.lower()) if t else []
        m = min(n, len(w))
        sets.append((i, {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()))
    out = {}
    for a, (i, s) in enumerate(sets):
        for j, u in sets[a + 1 :]:
            if s and u and (x := len(s & u) / len(s | u)) >= threshold:
                out[(i, j)] = round(x, 9)
    return out


def joined_pairs(spark, rows, **more):
    """All pairs of rows that the join found, from its sets and their members; each pair of sets comes once."""
    pairs, named = jaccard_join.similar_sets(frame(spark, rows), **more)
    rows_of = defaultdict(list)
    for r in named.collect():
        rows_of[r["set_id"]].append(r["doc_id"])
    found = [(r["set_a"], r["set_b"], r["jaccard"]) for r in pairs.collect()]
    assert len(found) == len({(a, b) for a, b, _ in found})
    out = {(min(i, j), max(i, j)): round(x, 9) for a, b, x in found for i in rows_of[a] for j in rows_of[b]}
    return out | {(i, j): 1.0 for ids in rows_of.values() for i in ids for j in ids if i < j}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_jaccard_join_recall(spark, threshold):
    rows = near_corpus(1, 150)
    want = brute_pairs(rows, threshold=threshold)
    got = joined_pairs(spark, rows, threshold=threshold)
    assert all(want.get(p) == j for p, j in got.items())
    assert len(got) >= 0.98 * len(want) > 80


def test_jaccard_join_recall_where_nodes_stay_large(spark, monkeypatch):
    """Pairs just over the threshold that get down to the last level of splitting."""
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    rng, rows = random.Random(12), []
    for g in range(200):
        base = prose(rng, 60).split()
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:43] + prose(rng, 17).split()))]
    want = brute_pairs(rows)
    got = joined_pairs(spark, rows)
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 150


def test_jaccard_draws_are_independent():
    """The share of runs in which a pair gets down to the last level is what ``runs`` counts on."""
    plan, rng = jaccard_join.Plan(0.3, 0.99), np.random.default_rng(4)
    assert plan.runs == jaccard_join.runs(0.3, 0.99) and plan.size >= plan.runs * jaccard_join.DEPTH * jaccard_join.BRANCHES
    met = []
    for _ in range(60):
        s = rng.integers(0, 1 << 63, 170).astype(np.uint64)
        same = plan.signature(s[:130]) == plan.signature(np.concatenate([s[:90], s[130:]]))  # 90 of 170
        first = same[: plan.first].reshape(plan.runs, -1).any(axis=1)
        deeper = same[plan.first : plan.first * jaccard_join.DEPTH].reshape(plan.runs, jaccard_join.DEPTH - 1, -1).any(axis=2).all(axis=1)
        met.append((first & deeper).mean())
    q = (1 - (1 - 90 / 170) ** jaccard_join.BRANCHES) ** jaccard_join.DEPTH
    assert abs(np.mean(met) - q) < 0.06


def classes_of(pairs, rows):
    """doc_id -> (class, links) by brute force."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(root, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: (find(i), links[i]) for i in root}


def test_jaccard_classes_and_links(spark):
    rows = near_corpus(3, 100)
    rows += [(5000 + i, rows[i % 7][1]) for i in range(20)] + [(6000, None), (6001, "")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()}
    assert got == classes_of(joined_pairs(spark, rows), rows)
    want = classes_of(brute_pairs(rows), rows)
    assert len(got) == len(rows) and sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_jaccard_join_dense_nodes(spark, monkeypatch):
    """A crowd of near copies, beside sets that share one passage, with small nodes and tiles."""
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    rng = random.Random(4)
    base, passage = prose(rng, 100).split(), prose(rng, 12)
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(100)] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(rng, 30) + " " + passage) for i in range(40)]
    want = brute_pairs(rows)
    got = joined_pairs(spark, rows)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)


def crowd_rows(k):
    rng = random.Random(k)
    base, other, rows = prose(rng, 100).split(), prose(rng, 100).split(), []
    for i in range(k + k // 4):
        w = list(base if i < k else other)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(100)] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    return rows + [(k + 1000 + i, rows[i % 3][1]) for i in range(9)] + [(k + 2000 + i, prose(rng, 30)) for i in range(20)]


def test_jaccard_crowds_are_exact(spark, monkeypatch):
    """Links and classes of crowds in many tiles, with copies, pairs under the threshold and sets that are in no crowd."""
    monkeypatch.setattr(jaccard_join, "CROWD", 12)
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    rows = crowd_rows(80)
    brute = brute_pairs(rows)
    assert joined_pairs(spark, rows) == brute and 3000 < len(brute) < 79 * 80 // 2 + 19 * 20 // 2 + 9 * 80
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()}
    assert got == classes_of(brute, rows)
    kept = {r["doc_id"] for r in jaccard_join.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == groups(brute, [i for i, _ in rows])


def test_jaccard_pairs_of_crowds_are_never_rows(spark, monkeypatch):
    """600 near copies have 179,700 links; what the join writes stays in proportion to the sets."""
    rows, written, write = crowd_rows(600), [], jaccard_join.write_table

    def counted(df):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "write_table", counted)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()}
    want = classes_of(brute_pairs(rows), rows)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want) and sum(n for _, n in want.values()) > 200_000
    assert max(written) < 40 * len(rows)


def test_jaccard_overlaps():
    """Matrix products and single additions together are the sizes of the intersections; parts are those of the graph."""
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, 25), rng.integers(100, 4000, rng.integers(0, 90))])).astype(np.uint64) for _ in range(70)]
    got = jaccard_join._overlaps(sets[:30], sets[30:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[30:]] for a in sets[:30]]
    hits = np.zeros((4, 3), bool)
    hits[[0, 2, 2, 3], [1, 1, 0, 2]] = True
    assert jaccard_join._parts(hits).tolist() == [0, 1, 0, 3, 0, 0, 3]


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {find(i) for i in ids}


def test_near_duplicates_keep_one_of_each_group(spark):
    rows = near_corpus(2, 80)
    kept = {r["doc_id"] for r in jaccard_join.drop_near_duplicates(frame(spark, rows)).collect()}
    want = groups(brute_pairs(rows), [i for i, _ in rows])
    assert want <= kept and len(kept - want) <= 0.02 * len(rows)


def test_jaccard_odd_rows(spark):
    df = frame(spark, ODD)
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard_join.jaccard_join(df).collect())
    alone = [("1", "1", 0), ("2", "2", 0), ("2", "2", 0), ("8", "8", 0), ("9", "9", 0), ("9", "9", 0), ("None", "None", 0)]
    assert got == sorted(alone + [(x, "3", 2) for x in ("3", "4", "None")] + [(x, "5", 2) for x in "567"])
    kept = jaccard_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "2", "3", "5", "8", "9", "9", "None"]
    assert jaccard_join.jaccard_join(df.limit(0)).count() == 0 and jaccard_join.drop_near_duplicates(df.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert jaccard_join.runs(0.5, 0.99) >= 3 and jaccard_join.runs(1.0, 0.99) == 1
    q = (1 - 0.5**jaccard_join.BRANCHES) ** jaccard_join.DEPTH
    assert (1 - q) ** jaccard_join.runs(0.5, 0.99) <= 0.01 + 1e-9
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            jaccard_join.runs(bad, 0.99)


# ---- decontamination ----


def brute_containment(docs, items, n=decontaminate.NGRAM, threshold=decontaminate.THRESHOLD):
    out = []
    for j, item in items:
        w = WORD.findall(item.lower()) if item else []
        m = min(n, len(w))
        s = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
        for i, text in docs:
            v = WORD.findall(text.lower()) if text else []
            u = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else set()
            if s and len(s & u) / len(s) >= threshold:
                out.append((j, i, round(len(s & u) / len(s), 9)))
    return sorted(out)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    items = [(j, prose(rng, rng.choice([1, 3, 8, 20, 60, 130]))) for j in range(60)]
    docs = []
    for i in range(80):
        words = prose(rng, rng.randint(0, 600)).split()
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(items)[1].split()
            part = passage[: max(1, int(len(passage) * rng.choice([0.4, 0.7, 1.0])))]
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((i, " ".join(words)))
    want = brute_containment(docs, items)
    df = frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["item_id"], r["doc_id"], round(r["containment"], 9)) for r in decontaminate.contaminated(df, bench).collect())
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) > 50
    # The index in parts finds the same.
    parts = sorted((r["item_id"], r["doc_id"], round(r["containment"], 9)) for r in decontaminate.contaminated(df, bench, index_items=25).collect())
    assert parts == got
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for _, i, _ in got}


def test_bands_are_as_many_as_the_recall_needs():
    for threshold in (0.03, 0.1, 0.5, 1.0):
        s = threshold * 0.5 / (2.0 - threshold * 0.5)
        assert (1 - s) ** decontaminate.bands(threshold, 0.99) <= 0.01 + 1e-9
    assert len(decontaminate.Index([(1, "a b c d e f")], 5, 0.03, 0.99).orders) == decontaminate.bands(0.03, 0.99) > 512
    with pytest.raises(ValueError):
        decontaminate.bands(0, 0.99)


def test_decontamination_odd_rows(spark):
    df = frame(spark, ODD)
    items = spark.createDataFrame([(1, "one"), (1, "one"), (None, None), (2, ""), (3, "very long text very long text")], "item_id long, text string")
    got = sorted((r["item_id"], str(r["doc_id"])) for r in decontaminate.contaminated(df, items).collect())
    assert got == [(1, "3"), (1, "3"), (1, "4"), (1, "4"), (1, "None"), (1, "None"), (3, "5"), (3, "6"), (3, "7")]
    kept = decontaminate.drop_contaminated(df, items)
    assert kept.columns == df.columns and kept.count() == len(ODD) - 6
    assert decontaminate.contaminated(df, items.limit(0)).count() == 0 and decontaminate.drop_contaminated(df, items.limit(0)).count() == len(ODD)
    assert decontaminate.contaminated(df.limit(0), items).count() == 0


# ---- classifiers ----


def labelled(spark, sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    fit = labels.filter(F.xxhash64("doc_id") % 2 == 0)
    got = toxicity.score(docs, fit).join(labels.subtract(fit), "doc_id").select("is_toxic", "toxic").collect()
    hits = sum(r["is_toxic"] and r["toxic"] for r in got)
    assert hits >= 0.85 * sum(r["toxic"] for r in got) > 0
    assert sum(r["is_toxic"] and not r["toxic"] for r in got) <= 0.03 * len(got)


def test_toxicity_of_unseen_misspellings(spark):
    rng = random.Random(1)
    texts = [prose(rng, 60) for _ in range(300)]
    y = np.array([i % 2 for i in range(300)])
    texts = [t + " scoundrel " * 3 if k else t for t, k in zip(texts, y)]
    model = toxicity.Model.train(texts, y, 0.5)
    clean = [prose(rng, 60) for _ in range(50)]
    assert np.mean(np.array(model.margins([t + " scoundrell scoundrels sc0undrel scoundrel_" for t in clean])) > model.cut) > 0.9
    assert np.mean(np.array(model.margins(clean)) > model.cut) < 0.1


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    fit = labels.filter(F.xxhash64("doc_id") % 2 == 0)
    got = quality.score(docs, fit).drop("quality").join(labels.subtract(fit), "doc_id").select("is_low", F.col("quality").alias("y")).collect()
    right = sum(r["is_low"] == (r["y"] == 0) for r in got)
    assert right >= 0.9 * len(got)


def test_sum_of_squares_identity():
    """Linear-time scores equal the sum over all pairs."""
    rng = np.random.default_rng(3)
    w, v = rng.normal(size=50), rng.normal(size=(50, 4)).astype(np.float32)
    m = quality.Machine(0.3, w, v)
    col, val = np.array([1, 7, 20, 33]), rng.normal(size=4)
    pairs = sum(float(v[col[a]] @ v[col[b]]) * val[a] * val[b] for a in range(4) for b in range(a + 1, 4))
    assert m.score(col, val) == pytest.approx(0.3 + w[col] @ val + pairs, rel=1e-5)


@pytest.mark.parametrize("module,label,result", [(toxicity, "toxic", "is_toxic"), (quality, "quality", "is_low")])
@pytest.mark.parametrize("n", [0, 2, 10, 40, 200])
def test_classifiers_with_few_labels(spark, module, label, result, n):
    """Whatever the number of labels, clean documents are left alone; with 200 the others are found."""
    rng = random.Random(n)
    text = lambda bad: prose(rng, 40) + (" vile wretch" * 4 if bad else "")
    rows = [(i, text(i % 2)) for i in range(n)] + [(1000 + i, text(0)) for i in range(50)] + [(2000 + i, text(1)) for i in range(50)]
    bad = (lambda i: i % 2) if module is toxicity else (lambda i: 1 - i % 2)
    labels = spark.createDataFrame([(i, bad(i)) for i in range(n)], f"doc_id long, {label} int")
    got = {r["doc_id"]: r[result] for r in module.score(frame(spark, rows), labels).collect()}
    assert sum(got[1000 + i] for i in range(50)) <= 2
    assert n < 200 or sum(got[2000 + i] for i in range(50)) >= 45


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_without_any_difference(spark, module, label):
    rng = random.Random(2)
    rows = [(i, prose(rng, 40)) for i in range(300)]
    labels = spark.createDataFrame([(i, rng.randint(0, 1)) for i in range(300)], f"doc_id long, {label} int")
    assert not any(r[2] for r in module.score(frame(spark, rows), labels).collect())


def test_classifiers_take_other_columns(spark):
    """The text's column by name, metadata of other types and in other cases, alike in training and scoring."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 30) + (" vile wretch" * 4 if i % 2 else ""), i % 2, f"2024-01-0{1 + i % 2}") for i in range(200)]
    df = spark.createDataFrame(rows, "key long, body string, SOURCE long, lang string").withColumn("lang", F.to_date("lang")).withColumn("text", F.lit(1))
    labels = df.select("key", F.col("SOURCE").cast("int").alias("toxic"), (1 - F.col("SOURCE")).cast("int").alias("quality"))
    toxic = {r["doc_id"]: r["is_toxic"] for r in toxicity.score(df, labels, id_col="key", text_col="body").collect()}
    low = {r["doc_id"]: r["is_low"] for r in quality.score(df, labels, id_col="key", text_col="body").collect()}
    assert sum(toxic[i] == bool(i % 2) for i in toxic) >= 195 and sum(low[i] == bool(i % 2) for i in low) >= 195
    assert {r["key"] for r in toxicity.drop_toxic(df, labels, id_col="key", text_col="body").collect()} == {i for i in toxic if not toxic[i]}


def test_margins_are_those_of_the_mean_embedding():
    """Scores by word equal the definition: the mean over words of the mean over n-grams, through the margins of the table."""
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.25, 0.0)
    for t in ["One two, two!", "naïve 中文 words", "", None, "a"]:
        w = toxicity.words(t)
        grams = [dict.fromkeys([f"<{x}>"[i : i + k] for k in toxicity.GRAMS for i in range(len(x) + 3 - k)] + [f"<{x}>"]) for x in w]
        assert [len(toxicity.buckets(x)) for x in w] == [len(g) for g in grams]
        want = 0.25 + (sum(float(np.mean(model.margin[toxicity.buckets(x)].astype(float))) for x in w) / len(w) if w else 0)
        assert model.margins([t])[0] == pytest.approx(want)


@pytest.mark.parametrize("module,label,result", [(toxicity, "toxic", "is_toxic"), (quality, "quality", "is_low")])
def test_classifier_odd_rows(spark, module, label, result):
    rng = random.Random(6)
    texts = [(i, prose(rng, 30) + (" vile" * 5 if i % 2 else "")) for i in range(100, 160)]
    df = frame(spark, ODD + texts)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts] + [(1, 1), (1, 0), (None, 1), (3, None)], f"doc_id long, {label} int")
    got = module.score(df, labels).collect()
    assert len(got) == len(ODD) + len(texts) and all(r[result] is not None for r in got)
    if module is toxicity:
        assert not any(r[result] for r in got if r["doc_id"] in (1, 2, 9))
        kept = toxicity.drop_toxic(df, labels)
        assert kept.columns == df.columns and {1, 2, 3, 9} <= {r["doc_id"] for r in kept.collect()}
    assert module.score(df.limit(0), labels).count() == 0
    none = module.score(df, labels.limit(0)).collect()
    assert len(none) == len(ODD) + len(texts) and not any(r[result] for r in none)


# ---- pipeline ----


def test_pipeline_against_brute_force(spark, tmp_path):
    """The whole run, with brute force for every stage but the trained one."""
    import corpus_pipeline

    rng = random.Random(9)
    rows = near_corpus(3, 40)
    rows += [(1000 + i, rows[i][1]) for i in range(10)]
    items = [(j, prose(rng, 25)) for j in range(5)]
    rows += [(2000 + j, prose(rng, 40) + " " + t + " " + prose(rng, 40)) for j, t in items]
    toxic = [(3000 + i, prose(rng, 30) + " vile wretch" * 4) for i in range(40)]
    rows += toxic + [(4000, None), (4001, "")]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    marks = [(i, 1, 1) for i, _ in toxic[:30]] + [(i, 1, 0) for i, _ in rows[:60]]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t in rows if not 3000 <= i < 4000]
    firsts = {}
    for i, t in left:
        firsts.setdefault(t if t is not None else i, (i, t))
    left = list(firsts.values())
    kept = groups(brute_pairs(left), [i for i, _ in left])
    dirty = {i for _, i, _ in brute_containment([r for r in left if r[0] in kept], items)}
    want = kept - dirty
    assert len(want ^ set(got)) <= 2 and {4000, 4001} <= set(got)
    assert len(corpus_pipeline.STAGES) == 5 and all(r["round_trip"] is not False for r in got.values())


@pytest.mark.parametrize("rows", [[], [(None, "one two three four"), (None, None), (7, "word " * 60_000), (7, "word " * 60_000), (8, "")]])
def test_pipeline_odd_tables(spark, tmp_path, rows):
    """Empty tables; null and repeated ids, very long texts, and columns that bear the names of the operators' own."""
    import corpus_pipeline

    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.selectExpr("*", "1 AS rid", "2 AS _rid", "'x' AS root", "'y' AS toxic", "3 AS token_ids_").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == ([] if not rows else [(False, 7), (False, 8), (True, 0), (True, 0)])


def test_stages_leave_no_tables(spark, tmp_path):
    from cloakframe.llm import common, exact_dedup

    docs = frame(spark, [(1, "a b"), (2, "a b"), (3, "c")])
    folder = scratch_folder(spark)
    before = set(folder.iterdir()) if folder.exists() else set()
    out = common.finished(lambda: exact_dedup.drop_copies(docs))
    assert {p.name for p in set(folder.iterdir()) - before} == {out._scratch.rsplit("/", 1)[1]}
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def scratch_folder(spark):
    from pathlib import Path

    from cloakframe.llm import common

    return Path(common.scratch_root(spark).removeprefix("file://")) / "cloakframe"


def test_stages_keep_their_columns(spark):
    import corpus_pipeline

    docs, _ = labelled(spark, "/root/testdata/sf0.001")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_shingles_of_short_texts():
    cache = defaultdict(int)
    from cloakframe.llm.common import WordHashes

    c = WordHashes()
    assert len(shingles("a b", 3, c)) == 1 and len(shingles(None, 3, c)) == 0 and len(shingles("a b c d", 3, c)) == 2 and not cache
