import glob
import os

import duckdb
import pytest
from deltaspan.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and len(df.columns) == len(set(df.columns))
    if sql := registry.oracle_sql().get(name):
        c = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        want = c.sql(sql)
        order = sorted(df.columns)
        assert sorted(want.columns) == order
        assert sorted(tuple(r[x] for x in order) for r in rows) == sorted(tuple(r[want.columns.index(x)] for x in order) for r in want.fetchall())


def test_stages(spark, tmp_path):
    """Each stage on what the one before it wrote; decisions as the operators alone make them."""
    import corpus_pipeline as P
    from deltaspan.llm import decontaminate, near_duplicates, pii, quality
    from deltaspan.llm.common import table

    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        if name == "quality_rules":
            want = [r["doc_id"] for r in quality.verdicts(docs).where("kept").collect()]
        elif name == "near_dedup":
            want = [r["class_id"] for r in near_duplicates.assign(docs).select("class_id").distinct().collect()]
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.found(docs, table(spark, SF, "benchmark")).collect()}
            want = [r["doc_id"] for r in docs.collect() if r["doc_id"] not in bad]
        else:
            want = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert ids == sorted(want) and ids
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
        if name == "pii":
            assert pii.scan(out).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
        docs = out
    assert docs.count() == P.run(spark, SF).count()


def test_stages_odd(spark, odd, none):
    """Every stage on nulls, empty and very long texts, ties, repeated rows, an empty table and columns with clashing names."""
    import corpus_pipeline as P

    clash = odd.withColumn("mix_rate", odd["score"]).withColumn("posterior", odd["score"])
    for docs in (odd, clash, none):
        n = docs.count()
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            if name == "mixing":
                assert out.columns[-2:] == ["mix_rate", "mix_copies"] and [c for c in docs.columns if not c.startswith("mix_")] == out.columns[:-2]
                assert len(rows) == n and all(r["mix_rate"] >= 0 for r in rows)
                continue
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            if name == "pii":
                assert len(rows) == n and sum(r["text"] is None for r in rows) == docs.where("text is null").count()
            elif name == "quality_rules":
                assert len(rows) <= n and all(r["text"] for r in rows)
            elif name == "near_dedup":
                assert len({(r["doc_id"], r["text"]) for r in rows}) == len(rows) and (not n or rows)
            else:
                assert len(rows) == n  # no text here holds a benchmark item


def test_shared_folder(spark, tmp_path):
    from deltaspan.llm.common import shared_folder

    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Session.sparkContext.master = "local[2]"
    assert os.path.isdir(shared_folder(Session()))
