"""What a snapshot takes on disk, and how often it computes its parts."""

from pyspark.sql import functions as F

from sagaframe.plans import graph_queries
from sagaframe.sources import files

TYPES = "src string, rel_type string, tgt string, chapter int"


def test_a_snapshot_is_gzipped_and_counts_while_it_writes(spark, tmp_path):
    nodes = spark.createDataFrame([("Item", f"n{k}") for k in range(40)], "label string, name string").repartition(3)
    edges, seen = spark.createDataFrame([(f"n{k}", "R", f"n{k + 1}", None) for k in range(2000)], TYPES), spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return True

    path = f"file://{tmp_path}/snapshot"
    files.export_snapshot(nodes, edges.filter(F.udf(look, "boolean")("src")), nodes.filter("name = ''"), path)
    assert seen.value == 2000  # nothing is computed twice
    parts = {p: [f for f in (tmp_path / "snapshot" / p).iterdir() if f.name.startswith("part-")] for p in ("nodes", "relationships")}
    assert all(f.name.endswith(".json.gz") for fs in parts.values() for f in fs) and sum(f.stat().st_size for f in parts["relationships"]) < 2000 * 20
    back = files.import_snapshot(spark, path, {"nodes": nodes.schema, "relationships": edges.schema, "points": nodes.schema})
    assert {r.part: r.n for r in back["manifest"].collect()} == {"nodes": 40, "relationships": 2000, "points": 0} and back["points"].isEmpty()
    assert sorted(map(tuple, back["nodes"].collect())) == sorted(map(tuple, nodes.collect())) and back["relationships"].exceptAll(edges).isEmpty()


def test_the_manifest_of_the_query_counts_the_lines_of_its_files(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_queries, "shared_dir", lambda spark: f"file://{tmp_path}")
    row, (where,) = graph_queries.snapshot_manifest(spark, sf_dir).first(), tmp_path.glob("snapshot-*")
    for part in ("nodes", "relationships", "points"):
        assert row[part] == spark.read.text(f"file://{where}/{part}").count() > 0
        assert all(f.name.endswith(".json.gz") for f in (where / part).iterdir() if f.name.startswith("part-"))
