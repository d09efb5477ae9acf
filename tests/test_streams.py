"""Streams over several batches and over a restart: state goes on, late operations change nothing that is newer."""

from pyspark.sql import functions as F

from orrery.streaming import log

OPS = "item long, clock long, nonce string, priority long"
ROWS = [
    [(1, 5, "b", 50), (1, 2, "a", 20), (2, 1, "a", 7)],
    [(1, 3, "z", 30), (2, 9, "a", 90)],  # item 1: late, changes only the count
    [(1, 5, "c", 51), (3, 1, "x", 1)],  # the same clock: the larger nonce wins
    [(2, 9, "a", 90), (3, 0, "y", 2)],  # a repeat counts, and doesn't win
]


def folded(rows):
    best, n = {}, {}
    for item, clock, nonce, priority in rows:
        n[item] = n.get(item, 0) + 1
        best[item] = max(best.get(item, (-1, "", 0)), (clock, nonce, priority))
    return {item: (best[item][2], n[item]) for item in best}


def test_fold_over_batches_and_a_restart(spark, tmp_path):
    source, folder = tmp_path / "source", str(tmp_path / "fold")

    def add(k):
        spark.createDataFrame(ROWS[k], OPS).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        out = log.run_to_table(log.fold_stream(log.event_stream(spark, str(source), OPS, 1)), folder, "update")
        last = out.groupBy("item").agg(F.max_by("priority", "batch").alias("p"), F.max_by("n", "batch").alias("n"), F.count_distinct("batch").alias("batches"))
        return {r.item: (r.p, r.n) for r in last.collect()}, max(r.batches for r in last.collect())

    add(0), add(1)
    got, batches = run()
    assert got == folded(ROWS[0] + ROWS[1]) and batches == 2
    add(2), add(3)
    got, batches = run()  # goes on from the stored state
    assert got == folded(sum(ROWS, [])) and batches == 3


def test_evidence_counts_once_over_batches(spark, tmp_path):
    source, folder = str(tmp_path / "source"), str(tmp_path / "evidence")
    schema = "ts string, sha string, observation long"
    for rows in ([("2024-01-01 10:00:00", "a", 1), ("2024-01-01 11:00:00", "a", 2)], [("2024-01-01 12:00:00", "a", 1), ("2024-01-02 01:00:00", "b", 3)], [("2024-01-01 13:00:00", "a", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    out = log.run_to_table(log.evidence_stream(log.event_stream(spark, source, schema, 1)), folder, "update")
    got = {(r.sha, str(r.day)): r.n for r in out.groupBy("sha", "day").agg(F.max("n").alias("n")).collect()}
    assert got == {("a", "2024-01-01"): 3, ("b", "2024-01-02"): 1}
