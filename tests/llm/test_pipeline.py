import os
import random

import corpus_pipeline
from lexloom.llm import suffix_dedup
from tests.llm.helpers import documents


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    clean = [prose(rng.randint(40, 120)) for _ in range(80)]
    toxic = [f"{prose(20)} zorgblat {prose(10)} zorgmek {prose(9)} zorgfen" for _ in range(40)]
    item, passage = prose(30), prose(60)
    near = clean[0].split()
    near[5] = "edited"
    leak = f"{prose(20)} {item} {prose(20)}"
    shared = [f"{prose(30)}\n{passage}\n{prose(30)}" for _ in range(2)]
    texts = [*clean, *toxic, clean[1], leak, *shared]
    docs = documents(spark, texts, [f"s{i % 4}" for i in range(len(texts))])
    labels = [(i, 1, int(80 <= i < 120)) for i in range(120)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        if name != "mixing":
            assert kept.columns == docs.columns
        at = os.path.join(tmp_path, name)
        kept.write.parquet(at)
        kept = spark.read.parquet(at)
        seen[name] = {r.doc_id: r.text for r in kept.collect()}
    assert set(seen["toxicity"]) == set(range(80)) | {120, 121, 122, 123}
    assert set(seen["near_dedup"]) == set(seen["toxicity"]) - {120}
    assert all(passage not in t for t in seen["suffix_dedup"].values())
    assert all(seen["suffix_dedup"][i] == t for i, t in enumerate(clean))
    assert set(seen["decontamination"]) == set(seen["suffix_dedup"]) - {121}
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and len(seen["mixing"]) > 40


def test_cut_repeats(spark):
    long = "v" * 210
    docs = documents(spark, ["k" * 30 + long, long[:200], "solo", None])
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.cut_repeats(docs).collect()}
    assert got == {0: ("k" * 30, 30), 2: ("solo", 4), 3: (None, 0)}
    assert suffix_dedup.cut_repeats(docs).columns == docs.columns
