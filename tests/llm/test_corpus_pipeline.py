"""The pipeline on a small corpus, each stage judged on its own input."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_corpus_operators import lowered, near_brute, packed_ok

import corpus_pipeline as p


def test_stages(spark, tmp_path):
    r = random.Random(8)
    plain = ["".join(r.choices("abcdefghij", k=5)) for _ in range(300)]
    rows = []
    for i in range(400):
        kind = r.random()
        w = r.choice(rows)[1].split() if i and kind < 0.25 else r.choices(plain, k=r.randrange(30, 300))
        if kind < 0.1:
            w[r.randrange(len(w))] = r.choice(plain)
        if kind > 0.9:
            w[r.randrange(len(w))] = "zzork"
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.filter("doc_id < 300").select("doc_id", F.lit(1).alias("quality"), F.contains("text", F.lit("zzork")).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    read = lambda: spark.read.parquet(f"{tmp_path}/documents.parquet")
    at, outs = read(), {}
    for name, stage in p.STAGES:
        df = stage(spark, at, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        outs[name] = at.collect()
        if name != "packing":
            assert at.columns == docs.columns
    clean = {i: t for i, t, *_ in rows if "zzork" not in t}
    assert {x["doc_id"] for x in outs["toxicity"]} == set(clean)
    keep = {}
    for i, t in clean.items():
        keep[lowered(t)] = i
    assert sorted(x["doc_id"] for x in outs["exact_dedup"]) == sorted(keep.values())
    comps = near_brute([(i, clean[i]) for i in keep.values()], 80)
    assert sorted(x["doc_id"] for x in outs["near_dedup"]) == sorted({c for _, c in comps.values()})
    copies = Counter(x["doc_id"] for x in outs["mixing"])
    assert max(copies.values()) <= 3 and {x["text"] for x in outs["mixing"]} <= set(clean.values())
    packed_ok(outs["packing"], [(x["doc_id"], x["text"]) for x in outs["mixing"]])
    assert len(outs["packing"]) >= len(outs["mixing"])
    key = lambda xs: Counter((x["doc_id"], x["piece"], x["ids_crc32"], x["length"]) for x in xs)
    assert key(p.run(spark, str(tmp_path)).collect()) == key(outs["packing"])


def test_near_copies_at_80_percent(spark, tmp_path):
    """One word changed in the middle of 52: 43 of 53 shingles shared, 81 %."""
    base = [f"word{i}" for i in range(52)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:26], "other", *base[27:]])), (2, " ".join(f"else{i}" for i in range(52)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [x["doc_id"] for x in p.drop_near_copies(spark, docs, str(tmp_path)).orderBy("doc_id").collect()] == [0, 2]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, bucket int, row string, norm int, component string"


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, no id, and columns that clash with ours."""
    end = ("h", 1, "r", 2, "c")
    long_ = "many words " * 60_000
    rows = [
        (1, None, None, None, None, *end), (2, "", "en", "a", 0, *end), (3, " \t\n", "en", "a", 3, *end), (4, long_, "en", "a", 1, *end), (4, long_, "en", "a", 1, *end),
        (5, "Same text here", "en", "b", 1, *end), (6, "same TEXT here", None, "b", 1, *end), (None, "no id at all", "en", "b", 1, *end), (None, None, None, None, None, *[None] * 5),
        (7, "é Ünïcode ok", "de", None, 1, None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (None, 1, 1), (5, None, 0), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole, none = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.limit(0)
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
        assert stage(spark, whole, str(tmp_path)).columns == docs.columns, name
    assert p.drop_toxic(spark, whole, str(tmp_path)).count() == len(rows)  # no labelled row is toxic
    kept = [tuple(x) for x in p.drop_copies(spark, whole, str(tmp_path)).collect()]
    assert sorted((x[0] or 0, x[1] or "") for x in kept) == sorted([(0, "no id at all"), (2, ""), (3, " \t\n"), (4, long_), (6, "same TEXT here"), (7, "é Ünïcode ok")])
    near = p.drop_near_copies(spark, whole, str(tmp_path)).collect()
    assert {x["doc_id"] for x in near} == {None, 1, 2, 3, 4, 5, 7} and sum(x["doc_id"] is None for x in near) == 2
    mixed = p.mix_sources(spark, whole, str(tmp_path)).collect()
    assert {x["doc_id"] for x in mixed} <= {4, 5, 6, 7, None} and 4 in {x["doc_id"] for x in mixed}
    packed = p.pack_sequences(spark, whole, str(tmp_path)).collect()
    packed_ok(packed, [(r[0], r[1]) for r in rows])
    assert p.pack_sequences(spark, none, str(tmp_path)).count() == 0
