"""The rounds of the near dedup's groups leave few files, however many shuffle partitions there are."""

from caselight.llm import jaccard


def test_rounds_write_few_files(spark, monkeypatch):
    written, write = [], jaccard.checkpointed

    def noted(df):
        written.append(df.rdd.getNumPartitions())
        return write(df)

    monkeypatch.setattr(jaccard, "checkpointed", noted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        links = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(50, 51)], "x long, y long")
        found = {r.node: r.part for r in jaccard.components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {**dict.fromkeys(range(7), 0), 50: 50, 51: 50}
    assert written and max(written) <= jaccard.FILES * spark.sparkContext.defaultParallelism < 61
