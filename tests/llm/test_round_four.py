"""What the fourth review found: disk that grows with the square of a cluster, shuffle files that stay."""

import random
import time

from saltmarsh.llm import jaccard_join
from saltmarsh.sources.work import drop, materialize


def test_large_clusters_are_bounded_before_texts_are_sent_to_blocks(spark, monkeypatch):
    r = random.Random(4)
    texts = [[f"w{r.randrange(5000)}" for _ in range(300)] for _ in range(45)]
    for k in range(5):  # a word differs, so 5 of 296 shingles do
        texts.append([*texts[k][:150], "other", *texts[k][151:]])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)

    def one_cluster(met, nodes, num, den):
        low = nodes.agg({"h": "min"}).first()[0]
        return materialize(nodes.selectExpr("h AS src", f"{low}L AS dst"), "candidates")

    sent = []
    compare = jaccard_join._compare
    monkeypatch.setattr(jaccard_join, "_compare", lambda rows, *a: (sent.append(rows.count()), compare(rows, *a))[1])
    monkeypatch.setattr(jaccard_join, "candidates", one_cluster)
    monkeypatch.setattr(jaccard_join, "CLUSTER", 3000)
    for tile in (4000, 1 << 30):
        monkeypatch.setattr(jaccard_join, "TILE", tile, raising=False)
        sent.clear()
        found = {x["doc_id"]: x["component_id"] for x in jaccard_join.components_of_rows(docs, 5, 80, 100).collect()}
        assert found == {k: k - 45 if k >= 45 else k for k in range(50)}
        assert sum(sent) <= 20  # of 50 documents ten have a link; all went to all five blocks


def test_work_tables_leave_no_shuffle_files(spark):
    files = lambda: {x.rsplit("/", 1)[-1] for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = files()
    t = materialize(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counts")
    for _ in range(20):
        left = files() - before
        if not left:
            break
        time.sleep(0.25)
    assert not left and t.count() == 7
    drop(t)
