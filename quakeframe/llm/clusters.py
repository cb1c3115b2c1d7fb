"""Centroid clustering of integer vectors, over distinct vectors with weights.

Components become floor(``scale`` * x). Equal vectors are grouped first (partial counts before the
shuffle), so that Lloyd's rounds see each distinct vector once with its multiplicity. A round is one
pass over the distinct vectors: a task keeps one weighted integer sum a cluster, and Spark adds these;
k rows reach the driver. Assignments are joined back to the rows by digest, with frequent vectors
broadcast, so that a vector that a third of the rows share is no task of its own.

Defined results: vectors that are null, of another length, or with null or non-finite components are
left out; components beyond 2 ** 27 after scaling are held there, so that every distance fits a long,
and an inertia beyond a long's range is given as its end; rows that repeat a vec_id are rows of their
own; of starts with equal hashes the smaller vector comes first, rows with a null vec_id start last;
with fewer kept rows than k there are so many centroids; equal distances go to the smaller number; an
empty cluster stays where it is; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import checkpointed, table
from quakeframe.llm.graph import join_frequent
from quakeframe.llm.integer_vectors import exact_products, integer_rows
from quakeframe.llm.vectors import binary, matrix

HOLD = 1 << 27
LONG_MAX = (1 << 63) - 1


def quantised(embeddings: DataFrame, width: int, scale: int) -> DataFrame:
    """vec_id and q (little-endian 32-bit integers) of the vectors that take part."""

    def run(batches):
        for batch in batches:
            rows, taken = integer_rows(batch.column(1), width, scale, HOLD)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(taken)), binary(rows)], ["vec_id", "q"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, q binary")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid, and its squared distance."""
    d2 = (x.astype(np.int64) ** 2).sum(1)[:, None] - 2 * exact_products(x, centroids) + (centroids**2).sum(1)
    best = d2.argmin(1)
    return best, d2[np.arange(len(x)), best]


def starts(rows: DataFrame, k: int, salt: int, width: int) -> np.ndarray:
    """The vectors of the k rows with the smallest hashes."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(name.alias("name"), "q").orderBy(F.col("name").asc_nulls_last(), "q").limit(k).collect()
    return np.array([np.frombuffer(r.q, "<i4") for r in first], np.int64).reshape(-1, width)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floors of the weighted means of what is nearest to each."""
    k, width = centroids.shape

    def sums(batches):
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, n = matrix(batch.column(0), "<i4", width), batch.column(1).to_numpy(zero_copy_only=False)
            best = nearest(x, centroids)[0]
            for c in np.unique(best):
                own = best == c
                total[c] += (x[own] * n[own, None]).sum(0)
                count[c] += n[own].sum()
        full = np.c_[count, total][count > 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.flatnonzero(count), width + 1), pa.int32()), pa.array(np.tile(np.arange(width + 1), len(full)), pa.int32()), pa.array(full.ravel(), pa.int64())],
            ["cluster", "part", "total"],
        )

    added = distinct.mapInArrow(sums, "cluster int, part int, total long").groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect()
    whole = np.zeros((k, width + 1), np.int64)
    for r in added:
        whole[r.cluster, r.part] = r.total
    out, full = centroids.copy(), whole[:, 0] > 0
    out[full] = whole[full, 1:] // whole[full, :1]
    return out


def weighted_clusters(embeddings: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each row kept."""
    spark = embeddings.sparkSession
    rows = checkpointed(quantised(embeddings, width, scale))
    centroids = starts(rows, k, salt, width)
    if not len(centroids):
        return rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    distinct = checkpointed(rows.groupBy("q").agg(F.count("*").alias("n")))
    for _ in range(rounds):
        after = moved(distinct, centroids)
        if (after == centroids).all():
            break  # further rounds change nothing
        centroids = after

    def assigned(batches):
        for batch in batches:
            best, d2 = nearest(matrix(batch.column(0), "<i4", width), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32()), pa.array(d2)], ["q", "n", "cluster", "distance"])

    digest = F.unhex(F.sha2("q", 256)).alias("digest")
    lookup = checkpointed(distinct.mapInArrow(assigned, "q binary, n long, cluster int, distance long").select(digest, "n", "cluster", "distance"))
    spent = {r[0]: int(r[1]) for r in lookup.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n"))).collect()}
    facts = [
        (c, min(inertia, LONG_MAX), min(sum(spent.values()), LONG_MAX), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, inertia in sorted(spent.items())
    ]
    few = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
    found = join_frequent(rows.select("vec_id", digest), lookup, "digest")
    return found.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: int = 3) -> str:
    """The same in DuckDB's SQL: one row a component, a pair of tables a round."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {width} AND len([x FOR x IN embedding IF isfinite(x)]) = {width})",
        f"part AS MATERIALIZED (SELECT vec_id, unnest(range({width})) AS i, CAST(floor({scale} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS c FROM kept ORDER BY c LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN part USING (vec_id))",
    ]
    near = "SELECT vec_id, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT p.vec_id, m.c, sum((p.x - m.x) * (p.x - m.x))::BIGINT AS d FROM part p JOIN c{0} m USING (i) GROUP BY ALL) GROUP BY vec_id"
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        steps.append(
            f"c{r + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce(s.x, m.x) AS x FROM c{r} m LEFT JOIN (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM part JOIN a{r} USING (vec_id) GROUP BY c, i) s USING (c, i))"
        )
    steps += [
        f"final AS MATERIALIZED ({near.format(rounds)})",
        f"named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)",
    ]
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,"
        " CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM final JOIN named USING (c)"
    )


OP13_SQL = clusters_sql()


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_clusters(table(spark, sf_dir, "embeddings"))
