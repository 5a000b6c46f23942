"""The registered queries, each with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import catalog, chunking, dialogue, tasks
from ..operators import vector_index as X
from ..operators.cells import Cells
from ..operators.graph_index import GraphIndex
from ..operators.two_level import TwoLevelIndex
from ..sources import readers, sinks
from ..streaming import events as stream
from ..streaming.kept import KeptTable
from . import advisor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """The query vectors of the retrieval queries."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding")


_UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
_PAIRS = f"""
u AS (SELECT vec_id, label, {_UNIT} AS e, embedding::DOUBLE[] AS raw FROM embeddings),
q AS (SELECT vec_id AS query_id, e AS qe, raw AS qraw FROM u WHERE vec_id % 20 = 0),
p AS (SELECT query_id, vec_id, label, round(list_dot_product(e, qe), 6) AS score FROM u, q),
l AS (SELECT query_id, vec_id, label, round(list_sum(list_transform(range(1, len(raw) + 1), lambda i: (raw[i] - qraw[i]) * (raw[i] - qraw[i]))), 6) AS score FROM u, q)"""

# vectors


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10")
def knn_topk(spark, sf):
    return X.top_k(_vectors(spark, sf), _queries(spark, sf), 10)


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM l) WHERE rank <= 10")
def knn_l2_topk(spark, sf):
    return X.top_k(_vectors(spark, sf), _queries(spark, sf), 10, "l2")


@query(f"""WITH {_PAIRS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS n FROM p) WHERE n <= 5)
SELECT query_id, vec_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def knn_segment_merge(spark, sf):
    return X.merge_segments(X.top_k(_vectors(spark, sf), _queries(spark, sf), 5, by=["label"]), 10)


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, label, score FROM l WHERE score <= 1.2")
def knn_range(spark, sf):
    return X.within(_vectors(spark, sf), _queries(spark, sf), 1.2)


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p WHERE label <> 3) WHERE rank <= 10")
def knn_with_tombstones(spark, sf):
    dead = table(spark, sf, "embeddings").where("label = 3")
    return X.top_k(X.without(_vectors(spark, sf), dead), _queries(spark, sf), 10)


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10 AND label <> 3")
def knn_postfilter_delete(spark, sf):
    dead = table(spark, sf, "embeddings").where("label = 3")
    return X.without(X.top_k(_vectors(spark, sf), _queries(spark, sf), 10), dead).select("query_id", "vec_id", "label", "score", "rank")


@query(f"""WITH u AS (SELECT vec_id, {_UNIT} AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM u WHERE vec_id % 20 = 0),
p AS (SELECT query_id, vec_id, round(list_dot_product(e, qe), 6) AS score FROM u, q)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""")
def knn_batch(spark, sf):
    """A list of queries against all vectors."""
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return X.top_k(table(spark, sf, "embeddings").select("vec_id", "embedding"), asked, 5)


@query(f"""WITH {_PAIRS} SELECT query_id, label AS project, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 3""")
def knn_cross_project(spark, sf):
    """The results of all projects side by side, each ranked for itself."""
    return X.top_k(_vectors(spark, sf), _queries(spark, sf), 3, by=["label"]).withColumnRenamed("label", "project")


@query(f"""WITH {_PAIRS}, h AS (SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10)
SELECT query_id, vec_id, score, sqrt(greatest(0.0, 2 * (1 - score))) AS distance, d.source AS file, d.text AS content FROM h LEFT JOIN documents d ON d.doc_id = h.vec_id""")
def hit_enrichment(spark, sf):
    """Hits with the document they come from and the distance of older replies."""
    hits = X.top_k(_vectors(spark, sf), _queries(spark, sf), 10)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("file"), F.col("text").alias("content"))
    return hits.join(docs, "vec_id", "left").select("query_id", "vec_id", "score", V.similarity_to_distance(F.col("score")).alias("distance"), "file", "content")


@query(f"SELECT vec_id, list_transform({_UNIT}, lambda x: round(x, 6)) AS unit FROM embeddings")
def vector_normalise(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(V.normalise(F.col("embedding")), lambda x: V.rounded(x, 6)).alias("unit"))


@query("""WITH p AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN embedding[1:32] ELSE embedding END::DOUBLE[] AS a, list_reverse(embedding)::DOUBLE[] AS b FROM embeddings)
SELECT vec_id, CASE WHEN len(a) <> len(b) THEN 3.4028234663852886e38 ELSE round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i])))), 6) END AS l2,
CASE WHEN len(a) <> len(b) THEN 3.4028234663852886e38 ELSE round(-list_dot_product(a, b), 6) END AS inner_product,
CASE WHEN len(a) <> len(b) THEN 3.4028234663852886e38 ELSE round(1 - list_dot_product(a, b), 6) END AS cosine FROM p""")
def pairwise_distance(spark, sf):
    """Each vector against its mirror image in every metric; some have another length."""
    short = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    pairs = table(spark, sf, "embeddings").select("vec_id", short.alias("a"), F.reverse("embedding").alias("b"))
    rounded = lambda m: F.when(F.size("a") != F.size("b"), V.distance(F.col("a"), F.col("b"), m)).otherwise(V.rounded(V.distance(F.col("a"), F.col("b"), m), 6)).alias(m)
    return pairs.select("vec_id", *map(rounded, ("l2", "inner_product", "cosine")))


@query("SELECT vec_id, len(embedding) > 0 AND len(embedding) <= 4096 AND len(embedding) = 64 AS valid FROM embeddings")
def dim_validate(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.valid(F.col("embedding"), 64).alias("valid"))


@query("""SELECT label, count(*) AS vectors, max(len(embedding))::INT AS dimension, min(vec_id) AS first_id, max(vec_id) AS last_id,
(count(*) * max(len(embedding)) * 4 + count(*) * 8)::BIGINT AS memory_bytes FROM embeddings GROUP BY label""")
def index_stats(spark, sf):
    return X.statistics(table(spark, sf, "embeddings"))


@query("SELECT label, min(len(embedding)) = max(len(embedding)) AND min(len(embedding)) > 0 AND count(*) = count(DISTINCT vec_id) AS consistent FROM embeddings GROUP BY label")
def index_consistency(spark, sf):
    return X.consistent(table(spark, sf, "embeddings"))


@query("""WITH r AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 2 = 0 THEN 512 ELSE 768 END AS d FROM orders),
c AS (SELECT n, d, n * 37 AS cnt FROM r),
t AS (SELECT *, CASE WHEN cnt < 1000 THEN 'Flat' WHEN cnt < 100000 THEN 'HNSW' WHEN d > 512 THEN 'IVFPQ' ELSE 'IVF' END AS index_type FROM c)
SELECT n, index_type, CASE WHEN index_type IN ('IVF', 'IVFPQ') THEN least(4096, cnt // 39)::INT END AS nlist,
CASE WHEN index_type = 'HNSW' THEN 16 WHEN index_type = 'IVFPQ' THEN d // 8 END AS m,
CASE WHEN index_type = 'HNSW' THEN 200 END AS ef_construction, CASE WHEN index_type = 'IVFPQ' THEN 8 END AS nbits FROM t""")
def index_advisor(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), (F.col("o_orderkey") * 37).alias("cnt"), F.when(F.col("o_orderkey") % 2 == 0, 512).otherwise(768).alias("d"))
    kind = advisor.index_type(F.col("cnt"), F.col("d"))
    typed = rows.withColumn("index_type", kind)
    return typed.select("n", "index_type", advisor.index_parameters(F.col("index_type"), F.col("cnt"), F.col("d")).alias("p")).select("n", "index_type", "p.*")


@query("""SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM
(SELECT vec_id, label, embedding FROM embeddings WHERE label <> 3 UNION ALL
 SELECT vec_id, label + 100, list_transform(embedding, lambda x: -x) FROM embeddings WHERE label = 3)""")
def vector_upsert(spark, sf):
    """Changed vectors replace those with their id."""
    rows = _vectors(spark, sf)
    changes = rows.where("label = 3").select("vec_id", (F.col("label") + 100).alias("label"), F.transform("embedding", lambda x: -x).alias("embedding"))
    out = X.upsert(rows, changes)
    return out.select("vec_id", "label", V.rounded(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query(f"""SELECT vec_id, label, round(list_sum({_UNIT}), 4) AS total FROM embeddings WHERE label >= 5 UNION ALL SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) FROM embeddings WHERE label < 5""")
def vector_add(spark, sf):
    """A batch added to an index: known ids and wrong widths are left out, the rest is normalised."""
    rows = _vectors(spark, sf)
    out = X.added(rows.where("label < 5"), rows.unionByName(rows.select((-F.col("vec_id") - 1).alias("vec_id"), "label", F.slice("embedding", 1, 3).alias("embedding"))), 64)
    return out.select("vec_id", "label", V.rounded(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query(f"""WITH {_PAIRS}, c AS (SELECT query_id, vec_id, score AS distance, 1 AS source_rank, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM l WHERE label < 5),
d AS (SELECT query_id, vec_id, score AS distance, 0 AS source_rank, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM l WHERE label >= 5),
b AS (SELECT * FROM c WHERE n <= 5 UNION ALL SELECT * FROM d WHERE n <= 5)
SELECT query_id, vec_id, distance, source_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, source_rank, vec_id) AS rank FROM b) WHERE rank <= 5""")
def two_way_merge(spark, sf):
    """The cache's and the stored segments' hits merged by distance."""
    near = lambda cond: X.top_k(_vectors(spark, sf).where(cond), _queries(spark, sf), 5, "l2").select("query_id", "vec_id", F.col("score").alias("distance"))
    return X.merge_two_way(near("label < 5"), near("label >= 5"), 5)


@query()
def ann_ivf(spark, sf):
    """Approximate search by cells; recall is tested against the exact one."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    index = X.InvertedIndex(cells=8).fit(vectors)
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return index.search(index.assign(vectors), asked, 10, probes=6)


@query()
def ann_lsh(spark, sf):
    """Approximate search by sign-projection buckets; recall is tested against the exact one."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return X.lsh_search(vectors, vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)


@query()
def ann_pq(spark, sf):
    """Approximate search by codes of vector parts, scored again exactly; recall is tested."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    index = X.ProductQuantizer().fit(vectors)
    return index.search(index.encode(vectors), vectors, vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)


@query()
def ann_ivfpq(spark, sf):
    """Codes within the probed cells, scored again exactly; recall is tested."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return X.search_by("IVFPQ", vectors, vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)


@query()
def ann_graph(spark, sf):
    """Approximate search along a graph of nearest neighbours; recall and the share read are tested."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return GraphIndex().fit(vectors).search(vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)


@query()
def ann_cells(spark, sf):
    """Approximate search by cells trained on all vectors: the advisor gives their number, a
    search of a sample the probes; recall is tested."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    index = Cells(advisor.advised(vectors)["nlist"]).fit(vectors).tuned()
    return index.search(vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)


def _two_level(spark, sf):
    """An index of labels below 5 to which the others are added; every seventh id is then
    deleted, and every fourteenth comes back turned round."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    index = TwoLevelIndex(rows.where("label < 5"))
    index.add(rows.where("label >= 3 OR label IS NULL"))  # those that are there already are left out
    index.delete(rows.where("vec_id % 7 = 0").select("vec_id"))
    index.add(rows.where("vec_id % 14 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding")))
    return index


_LEVELS = f"""
u AS (SELECT vec_id, label, {_UNIT} AS e FROM embeddings),
q AS (SELECT vec_id AS query_id, e AS qe FROM u WHERE vec_id % 20 = 0),
r AS (SELECT vec_id, e, 0 AS batch FROM u WHERE label < 5 UNION ALL SELECT vec_id, e, 1 FROM u WHERE label >= 5 OR label IS NULL
 UNION ALL SELECT vec_id, list_transform(e, lambda x: -x), 2 FROM u WHERE vec_id % 14 = 0),
v AS (SELECT * FROM (SELECT vec_id, e, batch, CASE batch WHEN 0 THEN 'main' ELSE 'delta' END AS level, row_number() OVER (ORDER BY batch, vec_id) - 1 AS position FROM r) WHERE batch = 2 OR vec_id % 7 <> 0)"""


@query(f"""WITH {_LEVELS} SELECT query_id, vec_id, position, level, score, rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, position, level, round(list_dot_product(e, qe), 6) AS score FROM v, q)) WHERE rank <= 10""")
def delta_search(spark, sf):
    """The main index and its delta after adding, deleting and adding again, searched and merged."""
    return _two_level(spark, sf).search(_queries(spark, sf), 10)


@query(f"WITH {_LEVELS} SELECT vec_id, row_number() OVER (ORDER BY position) - 1 AS position, round(list_sum(e), 4) AS total FROM v")
def delta_compact(spark, sf):
    """The same index as one level, with dense positions."""
    index = _two_level(spark, sf)
    index.compact()
    return index.live().select("vec_id", "position", V.rounded(F.aggregate(V.normalise(F.col("embedding")), F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


# chunks

_BREAK = r"[\p{P}\p{Z}\x09-\x0D\x{85}]"
_TRIM = r"regexp_replace({0}, '^[\p{{Z}}\s\x{{85}}]+|[\p{{Z}}\s\x{{85}}]+$', '', 'g')"
_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"


@query(f"""WITH RECURSIVE s AS (
SELECT doc_id, text, length(text) AS n, 0 AS start, 0 AS k FROM documents WHERE length(text) > 0
UNION ALL SELECT doc_id, text, n, nxt, k + 1 FROM (
  SELECT *, CASE WHEN e - 50 > start THEN e - 50 ELSE start + 462 END AS nxt FROM (
    SELECT doc_id, text, n, start, k, CASE WHEN e0 - start < 50 AND e0 < n THEN least(start + 50, n) ELSE e0 END AS e FROM (
      SELECT doc_id, text, n, start, k, CASE WHEN start + 512 >= n THEN n ELSE start + (CASE WHEN c > 0 THEN c + 1 ELSE 512 END) END AS e0 FROM (
        SELECT *, length(regexp_extract(substring(text, start + 2, 511), '(?s)^.*{_BREAK}')) AS c FROM s)))) WHERE nxt < n),
f AS (SELECT doc_id, k, start, CASE WHEN e0 - start < 50 AND e0 < n THEN least(start + 50, n) ELSE e0 END AS stop, text FROM (
      SELECT doc_id, text, n, start, k, CASE WHEN start + 512 >= n THEN n ELSE start + (CASE WHEN c > 0 THEN c + 1 ELSE 512 END) END AS e0 FROM (
        SELECT *, length(regexp_extract(substring(text, start + 2, 511), '(?s)^.*{_BREAK}')) AS c FROM s))),
t AS (SELECT doc_id, k, start, stop, {_TRIM.format("substring(text, start + 1, stop - start)")} AS content FROM f)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index, start, stop AS "end", content FROM t WHERE content <> ''""")
def chunk_fixed(spark, sf):
    return chunking.chunk_fixed(table(spark, sf, "documents"))


@query(SQL["chunk_fixed"])
def chunk_lateral(spark, sf):
    """The fixed-size chunker as a table function of SQL."""
    chunking.register_table_functions(spark)
    return spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL fixed_chunks(d.text) c", docs=table(spark, sf, "documents"))


@query(f"""WITH s AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 462)) AS start FROM documents),
c AS (SELECT *, CASE WHEN start + 512 >= n THEN n ELSE start + (CASE WHEN length(regexp_extract(substring(text, start + 2, 511), '(?s)^.*{_BREAK}')) > 0
  THEN length(regexp_extract(substring(text, start + 2, 511), '(?s)^.*{_BREAK}')) + 1 ELSE 512 END) END AS stop FROM s),
t AS (SELECT doc_id, start::INT AS start, stop::INT AS "end", {_TRIM.format("substring(text, start + 1, stop - start)")} AS content FROM c)
SELECT * FROM t WHERE length(content) >= 50""")
def chunk_sliding(spark, sf):
    return chunking.chunk_sliding(table(spark, sf, "documents"), chunking.PIPELINE)


def _packing(split: str, glue: str, size: int) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform({split}, lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS p FROM documents),
r AS (SELECT doc_id, p, 1 AS i, 0 AS k, p[1] AS cur, NULL::VARCHAR AS done FROM d WHERE len(p) > 0
UNION ALL SELECT doc_id, p, i + 1, CASE WHEN f THEN k + 1 ELSE k END, CASE WHEN f THEN p[i + 1] ELSE j END, CASE WHEN f THEN cur END FROM (
  SELECT *, cur || {glue} || p[i + 1] AS j, length(cur || {glue} || p[i + 1]) > {size} AS f FROM r WHERE i < len(p))),
c AS (SELECT doc_id, k - 1 AS chunk_index, done AS content FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, k, cur FROM r WHERE i = len(p))
SELECT doc_id, chunk_index, content, length(content)::INT AS length, {_WORDS.format("content")}::INT AS word_count FROM c"""


@query(_packing(r"regexp_split_to_array(text, '[.!?]+[\s\p{Z}]+')", "' '", 512))
def chunk_sentence(spark, sf):
    return chunking.chunk_sentences(table(spark, sf, "documents"), chunking.PIPELINE)


@query(_packing(r"string_split(text, chr(10))", "chr(10)", 512))
def chunk_paragraph(spark, sf):
    return chunking.chunk_paragraphs(table(spark, sf, "documents"), chunking.ChunkConfig(512, 50, 50, "\n"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, 'document of ' || source AS name, list_filter(regexp_split_to_array(
  translate(regexp_replace(text, '[\s\p{Z}\x{85}\x{200B}]+', ' ', 'g'), chr(39), '"'), '[\n，；。,.]'), lambda x: x <> '') AS p FROM documents),
r AS (SELECT doc_id, name, p, 0 AS i, '' AS over, []::VARCHAR[] AS done FROM d
UNION ALL SELECT doc_id, name, p, i + 1, CASE WHEN n > 300 THEN substring(t, (n // 300) * 300 + 1) WHEN n > 200 AND n < 300 THEN '' ELSE t END,
  CASE WHEN n > 300 THEN list_concat(done, list_transform(range(0, n // 300), lambda k: substring(t, k * 300 + 1, 300))) WHEN n > 200 AND n < 300 THEN list_append(done, t) ELSE done END
  FROM (SELECT *, over || p[i + 1] AS t, length(over || p[i + 1]) AS n FROM r WHERE i < len(p))),
f AS (SELECT doc_id, list_concat(CASE WHEN octet_length(encode(name)) > 14 THEN [name] ELSE []::VARCHAR[] END,
  CASE WHEN length(over) > 200 OR len(done) = 0 THEN list_append(done, over) ELSE list_concat(done[1:len(done) - 1], [done[len(done)] || over]) END)[1:100] AS c FROM r WHERE i = len(p)),
u AS (SELECT doc_id, unnest(range(1, len(c) + 1)) AS k, c FROM f)
SELECT doc_id, (k - 1)::INT AS chunk_index, c[k] AS content FROM u WHERE c[k] <> ''""")
def chunk_legacy(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("document of "), "source").alias("name"))
    return chunking.chunk_legacy(docs, name=F.col("name"))


@query(rf"""SELECT doc_id, length(text)::INT AS length, ((length(text) + 461) // 462)::INT AS estimate,
len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+[\s\p{{Z}}]+'), lambda x: {_TRIM.format("x")}), lambda x: x <> ''))::INT AS sentences,
len(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format("x")}), lambda x: x <> ''))::INT AS paragraphs, {_WORDS.format("text")}::INT AS words FROM documents""")
def chunk_stats(spark, sf):
    return table(spark, sf, "documents").select("doc_id", chunking.chunk_statistics(F.col("text"), chunking.ChunkConfig(512, 50, 50, "\n")).alias("s")).select("doc_id", "s.*")


@query("SELECT count(*) AS documents, sum((length(text) + 461) // 462)::BIGINT AS chunks, round(avg((length(text) + 461) // 462), 6) AS average, count(*) FILTER (WHERE length(text) = 0) AS skipped FROM documents")
def chunk_totals(spark, sf):
    return chunking.chunk_totals(table(spark, sf, "documents"), chunking.PIPELINE).withColumn("average", F.round("average", 6))


# catalog

_STATUS = "CASE WHEN l.doc_id IS NULL THEN 0 WHEN l.quality = 0 THEN 1 WHEN l.toxic = 1 THEN 2 ELSE 3 END"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a processing status taken from their labels."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("seen"))
    status = F.when(F.col("seen").isNull(), 0).when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).otherwise(3)
    return docs.join(labels, "doc_id", "left").withColumn("status", status).drop("quality", "toxic", "seen")


@query(f"SELECT {_STATUS} AS status, count(*) AS documents FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def doc_status_counts(spark, sf):
    return _documents(spark, sf).groupBy("status").agg(F.count("*").alias("documents"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE {_STATUS} > 1) AS processed, count(*) FILTER (WHERE {_STATUS} = 1) AS failed FROM documents d LEFT JOIN labels l USING (doc_id)")
def doc_stats(spark, sf):
    return catalog.document_totals(_documents(spark, sf), F.col("status") == catalog.PARSED)


@query(f"SELECT doc_id, d.source || '/documents/' || doc_id AS file_path, {_STATUS} AS status, round({_STATUS} * 100.0 / 3, 2)::DOUBLE AS progress, CASE WHEN {_STATUS} = 3 THEN 1 ELSE 0 END AS legacy_status FROM documents d LEFT JOIN labels l USING (doc_id)")
def doc_status_projection(spark, sf):
    return catalog.processing_states(_documents(spark, sf), "doc_id", F.col("source"), F.col("doc_id").cast("string"))


@query(f"SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE {_STATUS} = 0")
def doc_ready(spark, sf):
    return catalog.with_status(_documents(spark, sf), catalog.UNPROCESSED, "doc_id", "doc_id").select("doc_id")


@query(f"SELECT doc_id, source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE {_STATUS} = 2")
def doc_by_status(spark, sf):
    """The documents in a state, the newest first."""
    return catalog.with_status(_documents(spark, sf), catalog.CHUNKED, "doc_id", "doc_id").select("doc_id", "source")


@query(f"SELECT doc_id, greatest({_STATUS}, CASE WHEN quality = 1 THEN 2 ELSE 0 END) AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def status_advance(spark, sf):
    """Documents whose chunks were stored are at least chunked; none goes back."""
    return catalog.advanced(_documents(spark, sf), table(spark, sf, "labels").where("quality = 1"), "doc_id", catalog.CHUNKED).select("doc_id", "status")


@query("SELECT l.doc_id, min(d.source) AS source FROM (SELECT DISTINCT doc_id + 100 AS doc_id FROM labels) l LEFT JOIN documents d USING (doc_id) GROUP BY 1")
def doc_owner(spark, sf):
    """The project of each document that is asked for."""
    return catalog.owners(table(spark, sf, "documents"), table(spark, sf, "labels").select((F.col("doc_id") + 100).alias("doc_id")), "doc_id", "source")


@query("""WITH s AS (SELECT doc_id::VARCHAR AS file, quality AS status FROM labels), l AS (SELECT conv_id::VARCHAR AS file, arg_min(text, turn) AS content FROM conversations GROUP BY 1),
c AS (SELECT doc_id::VARCHAR AS file, lang AS content FROM documents)
SELECT file, status, CASE WHEN status = 1 THEN coalesce(l.content, c.content) END AS content FROM s LEFT JOIN l USING (file) LEFT JOIN c USING (file)""")
def doc_list(spark, sf):
    """All files with the first content line of those that succeeded."""
    name = lambda t, key: table(spark, sf, t).withColumn("file", F.col(key).cast("string"))
    lines = name("conversations", "conv_id").select("file", F.col("turn").alias("id"), F.col("text").alias("content"))
    cached = name("documents", "doc_id").select("file", F.lit(0).alias("id"), F.col("lang").alias("content"))
    return catalog.document_list(name("labels", "doc_id").select("file", F.col("quality").alias("status")), lines, cached)


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role IS NULL OR length(role) NOT BETWEEN 1 AND 6 OR text IS NULL OR text = '')")
def chunk_gate(spark, sf):
    """Batches in which every record is valid."""
    return catalog.accepted_chunks(table(spark, sf, "conversations"), "conv_id", "role", "text", 6).select("conv_id", "turn")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chunk_index, text AS content FROM conversations")
def chunk_insert(spark, sf):
    """Lists of chunks as rows, in the order of the list."""
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("parts"))
    return catalog.inserted_chunks(lists, "conv_id", "parts")


@query("SELECT (SELECT count(*) FROM supplier) AS entries, (SELECT sum(s_nationkey) FROM supplier)::BIGINT AS size, (SELECT round(avg(CASE WHEN o_custkey IN (SELECT s_suppkey FROM supplier) THEN 1 ELSE 0 END), 9) FROM orders) AS hit_rate")
def cache_stats(spark, sf):
    cache = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("index_id"), F.col("s_nationkey").alias("size"))
    return catalog.cache_statistics(cache, table(spark, sf, "orders").select(F.col("o_custkey").alias("index_id"))).withColumn("hit_rate", F.round("hit_rate", 9))


@query("""WITH p AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS path FROM pages) SELECT page_id FROM p WHERE path NOT LIKE '%/a%' AND path NOT LIKE '%.de/%_%1'""")
def delete_wildcards(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)).alias("path"))
    return catalog.delete_matching(rows, ["*/a*", "*.de/*?*1"]).select("page_id")


@query("""WITH e AS (SELECT user_id AS doc_id, arg_max(event_type, ts + INTERVAL (event_id) MICROSECOND) AS kind FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'error')) GROUP BY 1)
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM e) UNION ALL SELECT doc_id, kind FROM e WHERE kind = 'purchase'""")
def index_upkeep(spark, sf):
    """An index after file events: the last one of a file decides."""
    kind = F.when(F.col("event_type") == "purchase", "new").when(F.col("event_type") == "error", "delete")
    changes = stream.route(table(spark, sf, "events"), kind).select(F.col("user_id").alias("doc_id"), "action", F.col("event_type").alias("lang"), (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("event_id") / 1e6)).alias("at"))
    return catalog.upkeep(table(spark, sf, "documents").select("doc_id", "lang"), changes, "doc_id", [F.desc("at")])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def abort_list(spark, sf):
    """Files under way without those that were deleted meanwhile."""
    return catalog.without_gone(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").where("toxic = 1"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%license%'")
def doc_search_like(spark, sf):
    return catalog.search_names(table(spark, sf, "documents"), "license", ["text", "source"], "doc_id", "doc_id").select("doc_id", "source")


@query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def doc_dedup_hash(spark, sf):
    """Documents whose content hash occurs more than once."""
    return catalog.copies(table(spark, sf, "documents"), "doc_id", "text")


@query("""SELECT page_id, name, CASE WHEN n = 0 THEN name ELSE name || '_' || n END AS unique_name FROM
(SELECT page_id, lang AS name, row_number() OVER (PARTITION BY lang ORDER BY page_id) - 1 AS n FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1) AS lang FROM pages))""")
def name_collision(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)", 1).alias("name"))
    return catalog.collision_names(rows, "name", ["page_id"])


@query("""SELECT page_id, CASE WHEN e = 'html' THEN 'html' ELSE 'text' END AS kind, CASE WHEN e = 'html' THEN 'html' ELSE NULL END AS parser
FROM (SELECT page_id, lower(regexp_extract(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]*)$', 1), '\\.([^.]*)$', 1)) AS e FROM pages)""")
def doc_type_detect(spark, sf):
    """Document type and parser by the suffix of a page's path."""
    path = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", S.document_type(path).alias("kind"), readers.default_registry().choose(path).alias("parser"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' WHEN 3 THEN 'office' ELSE 'image' END AS parser FROM part""")
def parser_select(spark, sf):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("TXT", "htm", "pdf", "docx", "png")]), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", readers.default_registry().choose(F.concat(F.lit("/a.b/file."), ext)).alias("parser"))


@query("SELECT source AS project, count(*) AS documents, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_id FROM documents WHERE source <> 'src3' GROUP BY 1")
def project_rollup(spark, sf):
    """Totals of projects that aren't deleted."""
    docs = table(spark, sf, "documents")
    projects = docs.select(F.col("source").alias("project_id"), F.when(F.col("source") == "src3", catalog.DELETED).otherwise(catalog.ACTIVE).alias("status")).distinct()
    live = catalog.projects_of(projects).select(F.col("project_id").alias("source"))
    return catalog.project_totals(docs.join(live, "source", "left_semi"), "source", "n_chars", "doc_id")


@query("SELECT n_name AS project_id, n_regionkey AS app_id, coalesce(c, 0) AS total_documents FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def project_update(spark, sf):
    """Projects with their current totals."""
    nations = table(spark, sf, "nation")
    projects = nations.select(F.col("n_name").alias("project_id"), F.col("n_regionkey").alias("app_id"), F.lit(-1).cast("long").alias("total_documents"))
    held = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return catalog.project_updated(projects, catalog.project_totals(held, "n_name", "s_acctbal", "s_suppkey"))


@query("""WITH gone AS (SELECT doc_id FROM labels WHERE quality = 0), c AS (SELECT doc_id, unnest(range(0, (length(text) + 461) // 462)) AS k FROM documents)
SELECT 'documents' AS kind, count(*) AS rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'chunks', count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM gone)""")
def cascade_delete(spark, sf):
    docs = table(spark, sf, "documents")
    chunks = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.ceil(F.length("text") / 462).cast("int"))).alias("k"))
    kept, parts = catalog.delete_cascade(docs, chunks, table(spark, sf, "labels").where("quality = 0"), "doc_id")
    return kept.agg(F.lit("documents").alias("kind"), F.count("*").alias("rows")).unionByName(parts.agg(F.lit("chunks").alias("kind"), F.count("*").alias("rows")))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_state(spark, sf):
    return catalog.latest(table(spark, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type IN ('view', 'click')) WHERE n = 1""")
def status_upsert(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return catalog.upsert(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), ["user_id"], "event_id").select("user_id", "event_id")


@query("""WITH s AS (SELECT doc_id::VARCHAR AS file, quality AS status FROM labels), d AS (SELECT page_id::VARCHAR AS file FROM pages)
SELECT file, CASE WHEN status = 0 THEN 3 ELSE status END AS status FROM s WHERE NOT (status = 1 AND file NOT IN (SELECT file FROM d))
UNION ALL SELECT file, 1 FROM d WHERE file NOT IN (SELECT file FROM s)""")
def status_reconcile(spark, sf):
    statuses = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("file"), F.col("quality").alias("status"))
    return catalog.reconcile(statuses, table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("file")))


@query("""WITH a AS (SELECT page_id AS id, length(html) % 2 AS m FROM pages), b AS (SELECT doc_id + 100 AS id, n_chars % 2 AS m FROM documents)
SELECT coalesce(a.id, b.id) AS file_id, CASE WHEN b.id IS NULL THEN 'create' WHEN a.id IS NULL THEN 'delete' WHEN a.m <> b.m THEN 'update' ELSE 'skip' END AS action FROM a FULL JOIN b ON a.id = b.id""")
def stale_detect(spark, sf):
    listing = table(spark, sf, "pages").select(F.col("page_id").alias("file_id"), (F.length("html") % 2).cast("long").alias("m"))
    return catalog.stale(listing, table(spark, sf, "documents").select((F.col("doc_id") + 100).alias("file_id"), (F.col("n_chars") % 2).alias("m")), "file_id", "m")


@query("SELECT count(*) AS missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def integrity_check(spark, sf):
    """Catalogued documents without a stored row."""
    return catalog.missing(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").agg(F.count("*").alias("missing"))


@query("SELECT doc_id, coalesce(quality, n_chars)::BIGINT AS n_chars, source FROM documents LEFT JOIN labels USING (doc_id)")
def catalog_patch(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    return catalog.patched(rows, table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars")), "doc_id")


@query("SELECT page_id FROM pages WHERE NOT starts_with(url, 'http://th') AND NOT contains(url, '/.') AND length(url) <= 4095 AND length(url) - length(replace(url, '/', '')) <= 20")
def blacklist_filter(spark, sf):
    return table(spark, sf, "pages").where(S.path_allowed(F.col("url"), ["http://th"])).select("page_id")


@query("""WITH p AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS path FROM pages), g AS (SELECT path FROM p WHERE page_id IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT page_id FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE p.path = g.path OR starts_with(p.path, g.path || '/'))""")
def delete_paths(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)).alias("path"))
    gone = rows.join(table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    return catalog.delete_paths(rows, gone).select("page_id")


@query("""SELECT key, coalesce(r.value, s.value, d.value) AS value FROM (SELECT n_name AS key, 'd' || n_nationkey AS value FROM nation) d
LEFT JOIN (SELECT n_name AS key, 's' AS value FROM nation WHERE n_regionkey = 1) s USING (key) LEFT JOIN (SELECT n_name AS key, 'r' AS value FROM nation WHERE n_nationkey % 4 = 0) r USING (key)""")
def config_layers(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_name", "key")
    return catalog.config_layers(
        n.select("key", F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("value")), n.where("n_regionkey = 1").select("key", F.lit("s").alias("value")), n.where("n_nationkey % 4 = 0").select("key", F.lit("r").alias("value"))
    )


@query("""SELECT doc_id, length(source) > 0 AND length(source) <= 64 AS id_ok, length(source) <= 128 AS app_ok, regexp_full_match(source, '.{1,255}') AS name_ok FROM documents""")
def id_predicates(spark, sf):
    s = F.col("source")
    return table(spark, sf, "documents").select("doc_id", S.id_valid(s).alias("id_ok"), S.id_valid(s, 128).alias("app_ok"), S.id_valid(s, 255).alias("name_ok"))


@query("""SELECT index_id FROM (SELECT s_suppkey AS index_id, sum(s_nationkey + 1) OVER (ORDER BY s_acctbal DESC, s_suppkey) AS held FROM supplier) WHERE held > 100""")
def lru_evict(spark, sf):
    cache = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("index_id"), (F.col("s_nationkey") + 1).alias("size"), F.col("s_acctbal").alias("last_access"))
    return catalog.evict(cache, 100).select("index_id")


@query("SELECT coalesce(max(doc_id) + 1, 0) AS next_id FROM documents")
def next_id(spark, sf):
    return catalog.next_id(table(spark, sf, "documents"), "doc_id")


@query("""SELECT doc_id, text FROM documents WHERE lang = 'fr'""")
def newest_first(spark, sf):
    """The documents of a kind, the newest first."""
    return table(spark, sf, "documents").where("lang = 'fr'").orderBy(F.desc("doc_id")).select("doc_id", "text")


@query("""WITH p AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS page FROM documents)
SELECT source, page, '{"results":[' || string_agg('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}', ',' ORDER BY doc_id) || ']}' AS reply FROM p GROUP BY source, page""")
def json_reply(spark, sf):
    """Pages of a hundred results."""
    return sinks.paged_reply(table(spark, sf, "documents"), ["source"], ["doc_id", "lang"], "doc_id", [])


# tasks and events


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'create' WHEN 'error' THEN 'delete' END AS action FROM events WHERE event_type IN ('signup', 'purchase', 'error')""")
def event_route(spark, sf):
    rows = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "purchase", "rename_to").when(F.col("event_type") == "error", "delete")
    return stream.route(rows, kind).select("event_id", "action")


@query("""SELECT event_id, round(avg(value) OVER w, 9) AS rolling_avg, round(sum(value) OVER w, 4) AS rolling_sum FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def rolling_avg_100(spark, sf):
    return tasks.rolling(table(spark, sf, "events"), "event_type", "value").select("event_id", F.round("rolling_avg", 9).alias("rolling_avg"), F.round("rolling_sum", 4).alias("rolling_sum"))


@query("SELECT user_id, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS success_rate FROM events GROUP BY user_id")
def success_rate(spark, sf):
    return tasks.success_rate(table(spark, sf, "events").withColumn("ok", F.col("event_type") != "error"), "user_id", "ok")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_ms(ts) RANGE BETWEEN 60999 PRECEDING AND CURRENT ROW) AS recent FROM events")
def request_rate_60s(spark, sf):
    return tasks.request_rate(table(spark, sf, "events"), "event_type").select("event_id", "recent")


@query("""SELECT event_type, count(*) AS events, count(*) FILTER (WHERE value < 10) AS pending, round(sum(value), 4) AS total_time FROM events GROUP BY event_type""")
def type_counts(spark, sf):
    return tasks.kind_counts(table(spark, sf, "events"), "event_type", "value", F.col("value") < 10).withColumn("total_time", F.round("total_time", 4))


@query("""SELECT event_type, round(sum(value), 4) AS total_time FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100 GROUP BY 1""")
def total_exec_time(spark, sf):
    """Execution time over the samples that are retained, the last hundred."""
    return tasks.retained_time(table(spark, sf, "events"), "event_type", "value").withColumn("total_time", F.round("total_time", 4))


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 100 AS segment FROM events")
def segment_flush(spark, sf):
    """The segment that each row is written to when a buffer is flushed at a hundred."""
    return tasks.flushed(table(spark, sf, "events"), "event_type", "ts", ["event_id"]).select("event_id", "segment")


@query("""SELECT o_orderpriority AS stage, count(*) FILTER (WHERE o_orderstatus = 'O') AS queued, count(*) FILTER (WHERE o_orderstatus = 'P') AS running,
CASE WHEN o_orderpriority LIKE '1%' THEN 8 ELSE 4 END AS "limit", round(count(*) FILTER (WHERE o_orderstatus = 'P') * 100.0 / CASE WHEN o_orderpriority LIKE '1%' THEN 8 ELSE 4 END, 6) AS usage FROM orders GROUP BY 1""")
def stage_stats(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stage"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").alias("state"))
    return tasks.stage_statistics(rows, {"1-URGENT": 8}).withColumn("usage", F.round("usage", 6))


@query("""WITH t AS (SELECT *, count(*) FILTER (WHERE o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS busy, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM t WHERE o_orderstatus = 'O' AND n <= 4 - busy""")
def admission(spark, sf):
    """Queued tasks that the free slots of their kind take."""
    rows = table(spark, sf, "orders").withColumn("kind", F.col("o_custkey").cast("string")).withColumn("state", F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running"))
    return tasks.admit(rows, order=["o_orderpriority", "o_orderdate", "o_orderkey"]).where("admitted").select("o_custkey", "o_orderkey")


@query()
def session_cap(spark, sf):
    """Requests of applications to hosts that hold a bounded number of sessions."""
    rows = table(spark, sf, "events").withColumn("host", F.col("event_type"))
    return tasks.session_requests(rows, "host", "user_id")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY 1, 2""")
def session_idle(spark, sf):
    return tasks.sessions(table(spark, sf, "events"), "user_id")


@query()
def adaptive_throttle(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "ts", "event_id", (F.col("value") < 80).alias("ok"), F.when(F.col("value") < 95, 429).otherwise(500).alias("code"))
    return tasks.throttled(rows, "event_type")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 WHEN o_orderpriority LIKE '3%' THEN 2 ELSE 3 END AS priority_rank
FROM orders """)
def priority_dispatch(spark, sf):
    """The tasks in the order of dispatch."""
    p = F.col("o_orderpriority")
    named = table(spark, sf, "orders").withColumn("priority", F.when(p.startswith("1"), "critical").when(p.startswith("2"), "high").when(p.startswith("3"), "normal").otherwise("low"))
    return tasks.dispatch_order(named, "priority", "o_orderdate", "o_orderkey").select("o_orderkey", "priority_rank")


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events")
def fmt_time(spark, sf):
    return table(spark, sf, "events").select("event_id", S.compact_time(F.col("ts")).alias("stamp"))


@query("""SELECT event_id, lpad((ms // 3600000)::VARCHAR, greatest(2, length((ms // 3600000)::VARCHAR))::INT, '0') || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') AS clock
FROM (SELECT event_id, event_id * 7919 AS ms FROM events)""")
def fmt_duration(spark, sf):
    return table(spark, sf, "events").select("event_id", S.clock(F.col("event_id") * 7919).alias("clock"))


@query("SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS seconds FROM events")
def parse_duration(spark, sf):
    return table(spark, sf, "events").select("event_id", S.duration_seconds(F.date_format("ts", "H:m:s")).alias("seconds"))


@query("""SELECT event_id, (props::JSON->>'k')::INT AS k FROM events""")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT resource, sum(v)::BIGINT AS used FROM (SELECT o_orderpriority AS resource, o_custkey AS v FROM orders UNION ALL SELECT 'all', o_orderkey FROM orders) GROUP BY 1""")
def map_merge_usage(spark, sf):
    """Requirement maps of tasks summed key by key."""
    maps = table(spark, sf, "orders").select(F.create_map(F.lit("all"), F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_custkey")).alias("needs"))
    return tasks.needs(maps, "needs")


@query("SELECT r_regionkey, round(r_regionkey * 100.0 / 4, 6) AS percent, r_regionkey + 2 <= 4 AS admitted, r_regionkey * 30 <= 90 AND r_regionkey * 24 <= 95 AS healthy FROM region")
def resources(spark, sf):
    k = F.col("r_regionkey")
    return table(spark, sf, "region").select("r_regionkey", F.round(S.percent_of(k, F.lit(4)), 6).alias("percent"), S.admits(k, F.lit(2), F.lit(4)).alias("admitted"), S.healthy(k * 30, k * 24, F.lit(0)).alias("healthy"))


# dialogue


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE role IN ('system', 'user', 'assistant') AND length(text) > 0),
o AS (SELECT conv_id, role, text, CASE WHEN role = 'system' THEN -1 ELSE turn END AS ord FROM k WHERE role <> 'system' OR n = 1)
SELECT conv_id, '[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY ord) || ']' AS messages FROM o GROUP BY conv_id""")
def chat_history(spark, sf):
    return dialogue.history(table(spark, sf, "conversations"))


@query("SELECT conv_id, CASE WHEN arg_max(role, turn) = 'user' THEN arg_max(text, turn) ELSE '' END AS text FROM conversations GROUP BY conv_id")
def chat_last_user(spark, sf):
    return dialogue.last_message(table(spark, sf, "conversations"), "user")


@query("SELECT conv_id, CASE WHEN arg_max(role, turn) = 'assistant' THEN arg_max(text, turn) ELSE '' END AS text FROM conversations GROUP BY conv_id")
def chat_last_assistant(spark, sf):
    return dialogue.last_message(table(spark, sf, "conversations"), "assistant")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def sse_reassemble(spark, sf):
    """Texts sent as event streams, one body a turn, put together again."""
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    bodies = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("data: "), delta, F.lit("\n\ndata: [DONE]\n\n")).alias("body"))
    return dialogue.ordered_concat(dialogue.sse_deltas(bodies, ["conv_id"], "body", "turn"), ["conv_id"], "seq", "delta", "text")


@query("""SELECT conv_id, (turn % 2)::BIGINT AS "index", arg_max('id' || turn, turn) AS id, arg_max(role, turn) AS kind, string_agg(role, '' ORDER BY turn) AS name, string_agg(text, '' ORDER BY turn) AS arguments FROM conversations GROUP BY 1, 2""")
def tool_call_merge(spark, sf):
    parts = table(spark, sf, "conversations").select(
        "conv_id", (F.col("turn") % 2).alias("index"), F.col("turn").alias("seq"), F.concat(F.lit("id"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("kind"),
        F.col("role").alias("name"), F.col("text").alias("arguments"),
    )
    return dialogue.merge_tool_calls(parts)


@query("""WITH t AS (SELECT conv_id, turn, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM conversations)
SELECT conv_id, turn, length(t) AS chars, md5(t) AS digest FROM t""")
def transcript_running(spark, sf):
    """The transcript after each part, as its length and digest."""
    return dialogue.running_digest(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "chars", "digest")


@query("SELECT conv_id, turn, text || role AS words FROM conversations")
def speech_words(spark, sf):
    w = lambda c: F.struct(F.array(F.struct(c.alias("w"))).alias("cw"))
    body = F.to_json(F.struct(F.array(w(F.col("text")), w(F.col("role"))).alias("ws")))
    return table(spark, sf, "conversations").select("conv_id", "turn", dialogue.speech_text(body).alias("words"))


@query("""WITH e AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'assistant') AS last FROM conversations GROUP BY 1)
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS audio, any_value(last) IS NOT NULL AS complete FROM conversations JOIN e USING (conv_id) WHERE last IS NULL OR turn <= last GROUP BY conv_id""")
def audio_join(spark, sf):
    """Base64 parts joined up to the last frame."""
    parts = table(spark, sf, "conversations").select("conv_id", "turn", F.lit(0).alias("code"), F.when(F.col("role") == "assistant", 2).otherwise(1).alias("status"), F.base64(F.col("text").cast("binary")).alias("audio"))
    return dialogue.joined_audio(parts, "conv_id", "turn").withColumn("audio", F.col("audio").cast("string"))


@query("""WITH e AS (SELECT conv_id, min(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT c.conv_id, turn, text FROM conversations c LEFT JOIN e USING (conv_id) WHERE last IS NULL OR turn < last""")
def chat_until_abort(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return dialogue.until_abort(rows.drop("role"), rows.where("role = 'assistant'"), "conv_id", "turn")


def _registry(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT map('Chat', 'alpha', 'OCR', 'beta') AS defaults, map('alpha', map('Chat', 'a-1', 'Embedding', 'a-2'), 'beta', map('Chat', 'b-1', 'OCR', 'b-2')) AS providers"
    )


_MODELS = "(VALUES ('Chat', 'alpha', 'a-1', true), ('Embedding', 'alpha', 'a-2', false), ('Chat', 'beta', 'b-1', false), ('OCR', 'beta', 'b-2', true)) AS t(kind, provider, model, enabled)"


@query(f"SELECT kind, provider, model, enabled FROM {_MODELS}")
def capability_explode(spark, sf):
    return dialogue.registry_models(_registry(spark))


@query(f"SELECT kind, string_agg(provider, ',' ORDER BY provider) AS providers FROM {_MODELS} GROUP BY kind")
def capabilities(spark, sf):
    """Capabilities over all providers, with who has them."""
    return dialogue.capabilities(_registry(spark)).withColumn("providers", F.array_join("providers", ","))


@query(f"SELECT kind, provider, model, enabled FROM {_MODELS} WHERE kind = 'Chat' AND provider = 'alpha'")
def model_info(spark, sf):
    return dialogue.models_where(_registry(spark), kind="Chat", provider="alpha")


@query("""SELECT n_name AS provider, '{' || string_agg('"' || s_name || '":"m' || s_suppkey || '"', ',' ORDER BY s_name) || '}' AS models FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def config_writer(spark, sf):
    """Models regrouped by provider, as they are written."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    nested = dialogue.registry_nested(rows.select(F.col("n_name").alias("provider"), F.col("s_name").alias("kind"), F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("model")))
    return nested.select("provider", F.to_json("models").alias("models"))


@query("SELECT s_name AS model, s_nationkey % 2 = 0 AS is_embedding, s_suppkey AS size FROM supplier")
def installed_models(spark, sf):
    """The catalogue of a local model tool."""
    arch = F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("bert"), F.lit("Embedding"))).otherwise(F.array(F.lit("llm")))
    body = F.to_json(F.create_map("s_name", F.struct(arch.alias("architectures"), F.col("s_suppkey").alias("size"))))
    return readers.installed_models(table(spark, sf, "supplier").select(body.alias("body")), "body").select("model", "is_embedding", "size")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'OCR' WHEN 'click' THEN 'TextToSpeech' ELSE 'Chat' END AS kind, CASE event_type WHEN 'view' THEN 'Vision' WHEN 'click' THEN 'Speech' ELSE 'NLP' END AS service_group FROM events")
def enum_map(spark, sf):
    name = F.when(F.col("event_type") == "view", "OCR").when(F.col("event_type") == "click", "text_to_speech").otherwise("bogus")
    return table(spark, sf, "events").select("event_id", S.service_type(name).alias("kind"), S.service_group(S.service_type(name)).alias("service_group"))


# texts


def _replaced(column: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        column = f"replace({column}, '{a}', {b})"
    return column


_SIMPLE = r"regexp_replace(regexp_replace({0}, '^[\p{{Z}}\s\x{{85}}]+|[\p{{Z}}\s\x{{85}}]+$', '', 'g'), '[\p{{Z}}\s\x{{85}}]+', ' ', 'g')"
_STRIPPED = r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_ENTITIES = [("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")]


@query(f"SELECT page_id, {_SIMPLE.format(_replaced(_STRIPPED, *_ENTITIES))} AS text FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.html_to_text(F.col("html")).alias("text"))


@query("SELECT doc_id, ceil(octet_length(encode(text)) / 8000.0)::INT AS frames, (octet_length(encode(text)) - 8000 * (ceil(octet_length(encode(text)) / 8000.0) - 1))::INT AS last_size FROM documents")
def audio_frames(spark, sf):
    parts = S.frames(F.col("text").cast("binary"))
    return table(spark, sf, "documents").select("doc_id", parts.alias("p")).select("doc_id", F.size("p").alias("frames"), F.length(F.element_at("p", -1)).alias("last_size"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 0 THEN p_partkey ELSE least(p_partkey, p_size) END::INT AS x, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 0 THEN 2 ELSE 2 END::INT AS y,
CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 0 THEN p_size ELSE abs(p_size - p_partkey) END::INT AS width, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 0 THEN 4 ELSE 3 END::INT AS height FROM part""")
def region_parse(spark, sf):
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    s = F.when(F.col("p_partkey") % 3 == 0, F.concat(k, F.lit(", 2 ,"), z, F.lit(",4"))).when(F.col("p_partkey") % 3 == 1, F.concat(k, F.lit(",5;"), z, F.lit(",2"))).otherwise(F.concat(k, F.lit(",x,"), z, F.lit(",4")))
    return table(spark, sf, "part").select("p_partkey", S.region(s).alias("r")).select("p_partkey", "r.x", "r.y", "r.width", "r.height")


@query("""SELECT n_nationkey, upper(n_name[1]) || lower(replace(n_name[2:], '_', '')) || 'Model' AS pascal, 'p' || n_nationkey AS provider, n_name || '/x' AS model, replace(n_name, ' ', '') || '_a_' AS file FROM nation""")
def name_functions(spark, sf):
    n = F.col("n_name")
    split = S.provider_and_model(F.concat(F.lit("p"), F.col("n_nationkey").cast("string"), F.lit("/"), n, F.lit("/x")))
    return table(spark, sf, "nation").select(
        "n_nationkey", S.pascal_case(F.concat(F.replace(n, F.lit(" "), F.lit("-")), F.lit("_model"))).alias("pascal"), split["provider"].alias("provider"), split["model"].alias("model"),
        S.sanitise_file_name(F.concat(F.replace(n, F.lit(" "), F.lit("")), F.lit("?a:"))).alias("file"),
    )


@query("SELECT doc_id, regexp_matches(text, '[\\x{4E00}-\\x{9FBF}]') AS cjk, CASE WHEN length(text) > 10 THEN substring(text, 11, 5) ELSE '' END AS part FROM documents")
def text_functions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.has_cjk(F.col("text")).alias("cjk"), S.text_range(F.col("text"), 10, 5).alias("part"))


@query("SELECT doc_id, text AS utf8, text AS utf16 FROM documents")
def decode_text(spark, sf):
    """Bytes in two encodings as text again."""
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    return table(spark, sf, "documents").select("doc_id", S.decoded(F.col("text").cast("binary")).alias("utf8"), S.decoded(wide).alias("utf16"))


@query("""SELECT p_partkey, CASE WHEN greatest(w, h) > 1024 THEN greatest(round(w * 1024.0 / greatest(w, h)), 1) ELSE w END::INT AS width, CASE WHEN greatest(w, h) > 1024 THEN greatest(round(h * 1024.0 / greatest(w, h)), 1) ELSE h END::INT AS height
FROM (SELECT p_partkey, p_partkey * 3 AS w, p_size * 40 AS h FROM part)""")
def image_fit(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.fitted_size(F.col("p_partkey") * 3, F.col("p_size") * 40).alias("s")).select("p_partkey", "s.*")


@query("SELECT doc_id, sha256(length(source) || ':' || source || length(text) || ':' || text)[1:32] AS id FROM documents")
def stable_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.stable_id(F.col("source"), F.col("text")).alias("id"))


@query("""SELECT s_suppkey, s_name || '.' || n_name || '.' || CASE WHEN n_regionkey = 1 THEN 'docx' WHEN n_regionkey = 2 THEN 'PDF' WHEN n_regionkey = 3 THEN 'dps' ELSE 'md' END AS file, n_regionkey IN (1, 3) AS indexable, n_name <= 'F' AS below
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def file_predicates(spark, sf):
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ext = F.element_at(F.create_map(*[F.lit(x) for x in (0, "md", 1, "docx", 2, "PDF", 3, "dps", 4, "md")]), F.col("n_regionkey"))
    file = F.concat("s_name", F.lit("."), "n_name", F.lit("."), ext)
    home = F.concat(F.when(F.col("n_name") <= "F", "/home/a/").otherwise("/home/ab/"), file)
    return rows.select("s_suppkey", file.alias("file"), S.indexable(file).alias("indexable"), S.below(home, "/home/a").alias("below"))


@query("SELECT event_id, epoch_us(ts) // 1000 - (SELECT min(epoch_us(ts) // 1000) FROM events) AS elapsed FROM events")
def elapsed(spark, sf):
    rows = table(spark, sf, "events")
    return rows.join(rows.agg(F.min("ts").alias("began"))).select("event_id", S.elapsed_ms(F.col("began"), F.col("ts")).alias("elapsed"))


@query("""SELECT conv_id, turn, '{"data":{"status":' || turn || ',"audio":"' || base64(encode(text)) || '"}}' AS message FROM conversations""")
def audio_messages(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.audio_message(F.col("text").cast("binary"), F.col("turn")).alias("message"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '/home/' || n_name ELSE '/data/' || n_name END AS path FROM nation")
def mount_rewrite(spark, sf):
    path = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "/mnt/home/").otherwise("/data/"), F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", S.rewrite_mount(path, {"/mnt/home": "/home"}).alias("path"))


@query("""SELECT n_nationkey, '{"error":true,"error_code":' || n_nationkey || ',"error_message":"' || n_name || '"}' AS error, n_nationkey % 2 = 0 AS valid FROM nation""")
def json_builders(spark, sf):
    bodies = F.when(F.col("n_nationkey") % 2 == 0, F.lit('[{"name":"f"}]')).otherwise('[{"other":1}]')
    return table(spark, sf, "nation").select("n_nationkey", S.error_object(F.col("n_nationkey"), F.col("n_name")).alias("error"), S.functions_valid(bodies).alias("valid"))


@query("""SELECT n_nationkey, '{"role":"user","content":[' || CASE WHEN n_nationkey % 2 = 0 THEN '{"type":"text","text":"look"},' ELSE '' END || '{"type":"image_url","image_url":{"url":"data:image/png;base64,' || base64(encode(n_name)) || '"}}]}' AS message FROM nation""")
def vision_message(spark, sf):
    text = F.when(F.col("n_nationkey") % 2 == 0, "look").otherwise("")
    return table(spark, sf, "nation").select("n_nationkey", S.multimodal_message(F.lit("user"), text, F.lit(None).cast("string"), F.lit("png"), F.col("n_name").cast("binary")).alias("message"))


# streams, drained into tables


@query("SELECT event_type, time_bucket(INTERVAL 60 SECOND, ts) AS start, count(*) AS events FROM events GROUP BY 1, 2")
def stream_rate(spark, sf):
    """Requests a minute; the memory sink is read when all input is through."""
    rows = stream.windowed_counts(stream.read_stream(spark, sf, "events"), "event_type")
    return stream.drain(rows, f"stream_rate_{abs(hash(sf))}", "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query(SQL["session_idle"].replace("SELECT user_id, session::BIGINT AS session, min(ts) AS first_ts, max(ts) AS last_ts,", 'SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end",').replace("GROUP BY 1, 2", "GROUP BY user_id, session").replace("ts > lag(ts) OVER w + INTERVAL 30 MINUTE", "ts >= lag(ts) OVER w + INTERVAL 30 MINUTE"))
def stream_sessions(spark, sf):
    rows = stream.session_counts(stream.read_stream(spark, sf, "events"), "user_id")
    out = stream.drain(rows, f"stream_sessions_{abs(hash(sf))}", "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'create' ELSE 'delete' END AS action FROM events WHERE event_type IN ('signup', 'error')")
def stream_route(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "error", "rename_from")
    routed = stream.route(stream.deduplicated(stream.read_stream(spark, sf, "events")), kind)
    return stream.drain(routed.select("event_id", "action"), f"stream_route_{abs(hash(sf))}")


@query("""SELECT change_id, client_id, seq, op, valid_at, source, segment, city, balance FROM (SELECT *, row_number() OVER (PARTITION BY client_id
ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST, op DESC NULLS LAST, valid_at DESC NULLS LAST, source DESC NULLS LAST, segment DESC NULLS LAST, city DESC NULLS LAST, balance DESC NULLS LAST) AS n
FROM client_changes WHERE client_id IS NOT NULL) WHERE n = 1 AND op IS DISTINCT FROM 'D'""")
def stream_keep(spark, sf):
    """Clients as a stream of their changes leaves them: the last by number, deleted ones gone."""
    schema = table(spark, sf, "client_changes").schema
    kept = KeptTable(stream.table_folder(spark, "kept"), schema, "client_id", ["seq", "change_id"], "op = 'D'")
    kept.keep(stream.read_stream(spark, sf, "client_changes"))
    return kept.rows(spark)


@query()
def stream_throttle(spark, sf):
    rows = stream.read_stream(spark, sf, "events").select("event_type", "ts", "event_id", (F.col("value") < 80).alias("ok"), F.when(F.col("value") < 95, 429).otherwise(500).alias("code"))
    return stream.drain(stream.throttled(rows, "event_type"), f"stream_throttle_{abs(hash(sf))}")
