"""The whole pipeline as it is run, on the smallest tables."""

import glob

import corpus_pipeline
from marlstone.llm.common import read_table, shared_dir

SF = "/root/testdata/sf0.001"


def test_run_is_its_stages_in_turn(spark):
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/pipeline-*"))
    found = corpus_pipeline.run(spark, SF)
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert rows.columns == columns, name
            assert {r.doc_id for r in rows.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}, name
        docs = rows.cache()
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, found.select(pieces).collect())) == sorted(map(tuple, docs.select(pieces).collect())) and found.count() > 50
    (folder,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/pipeline-*")) - before
    assert [f.rsplit("/", 1)[-1] for f in glob.glob(f"{folder}/*")] == ["best_fit_packing"]
