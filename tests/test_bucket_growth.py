from strandline import shared
from strandline.plans import shortest_path as SP


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "BUCKET_ROWS", 10)
    assert shared.Tables(spark, 95).buckets == 10 and shared.Tables(spark).buckets == int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = spark.range(60).selectExpr("concat('v', id) AS src", "concat('v', id + 1) AS dst", "1L AS cost")
    vertices = spark.range(61).selectExpr("concat('v', id) AS id")
    found = SP.shortest_paths(vertices, edges.where("src in ('v0', 'v1', 'v2')").union(edges.where("src >= 'v9'")), "v0")
    assert {r.id: (r.cost, r.path) for r in found.where("cost is not null").collect()} == {f"v{i}": (i, [f"v{j}" for j in range(i + 1)]) for i in range(4)}
