"""The pipeline stage by stage, each on what the one before kept, against plain versions."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm import plain


def test_stages(spark, base, tmp_path):
    at = base.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = docs.collect(), out.collect()
        texts = {r["doc_id"]: r["text"] for r in before}
        if i < 4:
            assert out.columns == columns
        ids = Counter(r["doc_id"] for r in after)
        assert all(texts[r["doc_id"]] == r["text"] for r in after)
        if name == "quality":
            counts = {i: plain.text_counts(t) for i, t in texts.items()}
            assert all(counts[i][0] >= 50 and 2 * counts[i][4] <= counts[i][0] for i in ids)
            good = {r["doc_id"] for r in spark.read.parquet(f"{at}/labels.parquet").where("quality = 1").collect()}
            passing = {i for i in good & set(texts) if counts[i][0] >= 50 and 2 * counts[i][4] <= counts[i][0]}
            assert len(passing - set(ids)) <= 0.01 * len(passing)
        elif name == "near_dedup":
            assert set(ids) == {i for i, (_, c) in plain.components(texts.items(), size=5).items() if i == c} and max(ids.values()) == 1
        elif name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
            assert set(ids) == {w[0] for w in plain.contamination(texts.items(), items) if not w[2]}
        elif name == "mix":
            size = {r["doc_id"]: len(plain.words(r["text"])) for r in before}
            source = {r["doc_id"]: r["source"] for r in before}
            total, taken = defaultdict(int), defaultdict(int)
            for d in size:
                total[source[d]] += size[d]
                taken[source[d]] += size[d] * ids[d]
            assert max(ids.values()) <= 2
            assert all(abs(taken[s] - t) <= max(size.values()) for s, t in plain.targets(total).items())
        else:
            assert ids == Counter(r["doc_id"] for r in before) and set(columns) <= set(out.columns)
            slots = defaultdict(list)
            for r in after:
                slots[r["shard"]].append(r["slot"])
            assert len(slots) == 16 and all(sorted(s) == list(range(len(s))) for s in slots.values())
        docs = out
    assert corpus_pipeline.run(spark, at).count() == docs.count()
