import collections

import plain
import pytest

import corpus_pipeline


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path, docs):
    from veilframe.llm import line_dedup, secret_scan

    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, sf_dir).write.parquet(path)
        seen[name] = after = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert after.columns == columns
        old, new = ({r.doc_id: r.text for r in x.collect()} if name != "best_fit_packing" else {} for x in (before, after))
        if name == "quality_rules":
            failed = {i for i, t in old.items() for n, _, _, _, rep in [plain.base_stats(t)] if n < 20 or 100 * rep > 30 * n}
            assert not failed & set(new) and len(new) > 0.8 * len(old)
        elif name == "line_dedup":
            ids = sorted(old)
            for i, gone in zip(ids, plain.line_runs([old[i] for i in ids], line_dedup.MIN_WORDS)):
                left = "\n".join(x for k, x in enumerate(old[i].split("\n")) if k not in gone)
                assert new.get(i, "") == left if plain.words(left) or not gone else i not in new
        elif name == "ngram_join":
            ids = sorted(old)
            cls = plain.classes(len(ids), plain.jaccard_links([old[i] for i in ids]))
            assert set(new) == {ids[c] for c in cls}
        elif name == "secret_scans":
            assert set(new) == set(old)
            for i, t in new.items():
                assert (t == old[i]) == (not plain.secrets(old[i], secret_scan.KINDS))
        else:
            rows = after.collect()
            fill = collections.Counter()
            for r in rows:
                fill[r.sequence_id] += r.length
            assert max(fill.values()) <= 1024 and {r.doc_id for r in rows} == {r.doc_id for r in before.collect()}
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == seen["best_fit_packing"].count()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from veilframe.llm.util import shared_dir

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("spark://host:7077", "hdfs://a/b/")) == "hdfs://a/b"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master, None))
    assert shared_dir(session("local[4]", None)) == shared_dir(session("local", None))
