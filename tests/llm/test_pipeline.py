"""The pipeline's stages one after the other on a small corpus."""

from collections import Counter

import corpus_pipeline
from cairn.llm import quality


def test_stages(spark, sf_dir, tmp_path):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # at 200 documents there are too few bad ones of each sort to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf_dir)
        assert k == 3 or made.columns == columns
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/0").collect()}
    assert sum((k in kept) == bool(q) for k, q in labels.items()) >= 0.97 * len(labels)
    assert sizes[1] > sizes[2] == sizes[3] and sizes[4] >= sizes[3]
    same = corpus_pipeline.run(spark, sf_dir)
    pieces = lambda d: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in d.collect())
    assert pieces(same) == pieces(docs)


def test_stages_on_awkward_and_empty_rows(spark, awkward, empty, sf_dir):
    assert quality.keep_good(awkward, quality.fit(awkward)).columns == awkward.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
    quality_, near_, personal, packed = (stage(spark, awkward, sf_dir) for _, stage in corpus_pipeline.STAGES)
    given = Counter(r.doc_id for r in awkward.collect())
    assert Counter(r.doc_id for r in quality_.collect()) <= given
    kept = Counter(r.doc_id for r in near_.collect())
    assert kept <= given and {1, 6, 8, 10} <= set(kept) and not {2, 3} & set(kept)
    assert Counter(r.doc_id for r in personal.collect()) == given and personal.columns == awkward.columns
    pieces = Counter(r.doc_id for r in packed.filter("start = 0").collect())
    assert pieces == given  # also a null text has a piece: its end
