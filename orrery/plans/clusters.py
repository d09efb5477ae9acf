"""Queries of neighbours, clusters and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import closure, corpus, vectors
from orrery.sources.tables import load

from .register import query

_V = r"""WITH RECURSIVE t AS (SELECT conv_id * 100 + turn AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM conversations), n AS (SELECT count(*) AS n FROM conversations), c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), i AS (SELECT term, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM f, n WHERE df >= 2 AND df <= 0.8 * n), w AS (SELECT id, term, (1 + ln(tf)) * idf AS raw FROM c JOIN i USING (term)), v AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM w),
s AS (SELECT a.id, b.id AS other, round(sum(a.w * b.w), 9) AS cosine FROM v a JOIN v b USING (term) WHERE a.id <> b.id GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS rank FROM s QUALIFY rank <= 6) """
_L = _V + ", m AS (SELECT x.id AS a, x.other AS b FROM k x JOIN k y ON y.id = x.other AND y.other = x.id WHERE x.id < x.other AND (SELECT count(*) FROM k p JOIN k q ON p.other = q.other WHERE p.id = x.id AND q.id = x.other) >= 3) "
_P = _L + ", both_ AS (SELECT a, b FROM m UNION SELECT b, a FROM m), r(id, c) AS (SELECT a, a FROM both_ UNION SELECT b, c FROM r JOIN both_ ON a = r.id), parts AS (SELECT id, min(c) AS component FROM r GROUP BY id) "


def _vectors(spark, d):
    docs = load(spark, d, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    counts = closure.cut(corpus.term_counts(docs, "id", text.tokens(F.col("text"))))
    return closure.cut(corpus.tfidf(counts, corpus.idf(counts, docs.count())))


def _parts(near):
    return closure.components(corpus.mutual_edges(near, 3))


def _scores(v, parts):
    # The mean over all pairs of a cluster from its sums: (|sum of vectors|^2 - members) / 2 is the sum of all pairs' cosines.
    members = parts.groupBy("component").agg(F.count("*").alias("n"))
    sums = v.join(parts, "id").groupBy("component", "term").agg(F.sum("w").alias("w")).groupBy("component").agg(F.sum(F.col("w") * F.col("w")).alias("q"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sums.join(members, "component").select("component", pairs.cast("long").alias("pairs"), F.round((F.col("q") - F.col("n")) / 2 / pairs, 6).alias("mean_similarity"))


@query("nearest_texts", "W10", sql=_V + "SELECT id, other, round(cosine, 6) AS cosine, rank FROM k")
def nearest_texts(spark, d):
    return corpus.neighbours(_vectors(spark, d), 6).select("id", "other", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query("mutual_neighbour_clusters", "G11", sql=_P + "SELECT id, component FROM parts")
def mutual_neighbour_clusters(spark, d):
    return _parts(closure.cut(corpus.neighbours(_vectors(spark, d), 6)))


@query("cluster_scores", "G12", sql=_P + "SELECT p.component, count(*) AS pairs, round(sum(coalesce(least(1, cosine), 0)) / count(*), 6) AS mean_similarity FROM parts p JOIN parts q ON p.component = q.component AND p.id < q.id LEFT JOIN s ON s.id = p.id AND s.other = q.id GROUP BY 1")
def cluster_scores(spark, d):
    v = _vectors(spark, d)
    return _scores(v, closure.cut(_parts(closure.cut(corpus.neighbours(v, 6)))))


@query("vector_cosine", "X6", sql="SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine(spark, d):
    e = load(spark, d, "embeddings")
    j = e.select("vec_id", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return j.select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query("semantic_tags", "X13", sql="""
SELECT a.vec_id AS id, list_sort(coalesce(list(concat('probe', p.vec_id)) FILTER (list_cosine_similarity(a.embedding::DOUBLE[], p.embedding::DOUBLE[]) >= 0.3), [])) AS tags FROM embeddings a JOIN (SELECT * FROM embeddings WHERE vec_id < 8) p ON true GROUP BY 1""")
def semantic_tags(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.tag(e, e.where("id < 8").select(F.concat(F.lit("probe"), "id").alias("name"), "v"), 0.3)


@query("embedding_duplicates", "X14", sql="""
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
v AS (FROM e UNION ALL SELECT id + 1000000, v FROM e WHERE id % 3 = 0 UNION ALL SELECT id + 2000000, list_transform(v, lambda x: x * 2) FROM e WHERE id % 5 = 0
      UNION ALL SELECT id + 3000000, list_transform(v, lambda x, i: x + 0.5 * v[i % len(v) + 1]) FROM e WHERE id % 7 = 0),
c AS (SELECT v, min(id) AS rep FROM v GROUP BY v)
SELECT p.rep AS a, q.rep AS b, round(list_cosine_similarity(p.v, q.v), 6) AS cosine FROM c p JOIN c q ON p.rep < q.rep AND list_cosine_similarity(p.v, q.v) >= 0.85
UNION ALL SELECT rep, id, 1.0::DOUBLE FROM v JOIN c USING (v) WHERE id <> rep""")
def embedding_duplicates(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    copies = e.where("id % 3 = 0").select(F.col("id") + 1_000_000, "v")
    doubled = e.where("id % 5 = 0").select(F.col("id") + 2_000_000, F.transform("v", lambda x: x * 2))
    near = e.where("id % 7 = 0").select(F.col("id") + 3_000_000, F.transform("v", lambda x, i: x + 0.5 * F.get("v", (i + 1) % F.size("v"))))
    return vectors.duplicates(e.union(copies).union(doubled).union(near), 0.85)
