"""The pipeline's stages keep the columns, take effect, and leave clean documents alone."""

import random

import corpus_pipeline as cp
from pyspark.sql import functions as F
from strandframe.llm.common import Scratch

from .test_corpus import DOCS, plain_components, prose, split, water


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    clean = ["\n".join(prose(rng, 30) for _ in range(6)) for _ in range(60)]
    leak = prose(rng, 25)
    block = "\n".join(prose(rng, 8) for _ in range(20))
    texts = [*clean, clean[0], clean[1].replace(split(clean[1])[50], "zzz", 1), f"{prose(rng, 40)} {leak} {prose(rng, 40)}", "12345 !!! 678", None, f"{prose(rng, 30)}\n{block}", f"{prose(rng, 30)}\n{block}"]
    rows = [(i, t, "xx", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    scratch = Scratch(spark, "test")
    for name, stage in cp.STAGES:
        docs = scratch.put(stage(spark, docs, str(tmp_path)))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "source_mix":
            assert docs.columns == cp.COLUMNS
    n = len(clean)
    assert set(seen["language_id"]) == set(range(n + 7)) - {n + 3, n + 4}
    assert len(seen["line_dedup"][n + 6]["text"]) < len(texts[n + 6]) and seen["line_dedup"][n + 5]["text"] == texts[n + 5]
    kept = seen["line_dedup"]
    ids = sorted(kept)
    groups = plain_components([kept[i]["text"] for i in ids], 5, 80)
    assert set(seen["near_dedup"]) == {ids[c] for _, c in groups}
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {n + 2}
    assert set(range(2, n)) <= set(seen["decontamination"])
    sizes: dict = {}
    for r in seen["decontamination"].values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(split(r["text"]))
    want, taken = water(sizes), {}
    for r in docs.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"]
    # Nearer than half a document (180 words) no whole copies can come.
    assert all(abs(taken[s] - want[s]) <= 91 for s in sizes)


def test_stages_of_nothing_and_of_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = "bababa dedede mimimi lololo papapa nenene sisisi rororo tututu gagaga " * 3
    rows = [(1, words, "xx", "s", 5), (1, words, "xx", "s", 5), (None, words + " kakaka fefefe", "xx", None, None), (2, None, None, None, None), (3, "", "xx", "s", 0), (1, "lililo bebebe dududu " * 9, "xx", None, 3)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "th": F.lit("x"), "Copies": F.lit(None).cast("int")})
    for name, stage in cp.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, str(tmp_path))
            n = out.count()
            assert n == 0 if df is not docs else n > 0
            assert name == "source_mix" or out.columns == cp.COLUMNS
    # One doc_id with two texts: each row follows its own text.
    two = spark.createDataFrame([(5, words, "xx", "s", 5), (9, words, "xx", "s", 5), (9, "other words " + "lililo bebebe dududu " * 9, "xx", "s", 3)], DOCS)
    got = {(r["doc_id"], r["text"][:5]) for r in cp.dedup_documents(spark, two, str(tmp_path)).collect()}
    assert got == {(5, "babab"), (9, "other")}
