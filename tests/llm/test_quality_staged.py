"""The pipeline's quality stage writes what it learns from and nothing else."""

from gridlark.llm import quality


def test_only_rows_to_learn_from_are_written(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    written, stage = {}, quality.staged

    def staged(df, name, **options):
        out = stage(df, name, **options)
        written[name] = out.count()
        return out

    monkeypatch.setattr(quality, "staged", staged)
    kept = sorted(r["doc_id"] for r in quality.keep_documents(docs, labels).collect())
    learned = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").join(labels.where("quality is not null"), "doc_id").count()
    assert written == {"quality-train": learned}
    monkeypatch.undo()
    assert kept == sorted(r["doc_id"] for r in quality.score_documents(docs, labels).where("predicted = 1").collect())
