"""The pipeline's stages on a small folder: each decision takes effect, columns stay."""

from __future__ import annotations

import corpus_pipeline
from test_corpus_operators import near_by_force


def test_stages(spark, make, prose, tmp_path):
    item = " ".join(f"bench{k}" for k in range(25))
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, prose(k, 80)) for k in range(120)]
    rows += [(200 + k, " ".join(f"{w}###" for w in prose(500 + k, 80).split())) for k in range(30)]
    rows += [(300 + k, f"{prose(600 + k, 60)}\n{passage}\n{prose(700 + k, 60)}") for k in range(6)]
    one = prose(900, 120).split()
    rows += [(400 + k, " ".join([*one[:k], f"edit{k}", *one[k + 1 :]])) for k in range(5)]
    rows += [(410 + k, f"{prose(950 + k, 60)} {item} {prose(960 + k, 30)}") for k in range(3)] + [(420, None), (421, "")]
    labels = [(i, int(not 200 <= i < 230), 0) for i, _ in rows if i < 230]
    docs = make(rows, extra=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, seen[-1], str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    assert all(x.columns == columns for x in seen[1:-1])
    good, lines, single, clean, packed = ({r.doc_id: r for r in x.collect()} for x in seen[1:])
    assert set(range(120)) <= set(good) and not any(200 <= i < 230 for i in good)
    assert set(lines) == set(good) and sum(passage in (r.text or "") for r in lines.values()) == 1
    assert all(r.n_chars == len(r.text) for r in lines.values() if r.text is not None)
    force = near_by_force([(i, r.text) for i, r in lines.items()], 5, 80)
    assert set(single) == {i for i, (_, x) in force.items() if i == x} and sum(400 <= i < 405 for i in single) == 1
    assert set(clean) == set(single) and not any("bench3" in (r.text or "") for r in clean.values())
    assert all(clean[i].text == single[i].text for i in single if not 410 <= i < 413)
    assert set(packed) == set(clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1].count()


def test_a_stage_called_by_itself_starts_tidy(spark, monkeypatch):
    done = []
    monkeypatch.setattr(corpus_pipeline, "take_back", lambda: done.append("lent"))
    monkeypatch.setattr(corpus_pipeline, "tidy_workers", lambda spark: done.append("workers"))
    monkeypatch.setattr(corpus_pipeline, "small_batches", lambda spark: done.append("batches"))
    for module, step in [
        (corpus_pipeline.quality_fm, "keep_good"), (corpus_pipeline.line_dedup, "remove_repeats"),
        (corpus_pipeline.neardup, "drop_near_duplicates"), (corpus_pipeline.decontaminate, "remove_spans"),
        (corpus_pipeline.packing, "pack"),
    ]:
        monkeypatch.setattr(module, step, lambda docs, *more: done.append("stage") or docs)
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES:
        done.clear()
        assert stage(spark, docs, "/root/testdata/sf0.001") is not None
        assert done == ["batches", "lent", "workers", "stage"]
