"""Knowledge-base operators bound to ``documents``, ``benchmark`` and
``embeddings`` (K1–K7, S18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge as K
from ..session import scratch_path
from ..sources.documents import read_documents, write_documents
from .bindings import ClinicalTables
from .catalog import register

_WS = r"[ \t\n\x0B\f\r]+"
_SPLIT_SQL = f"""
WITH b AS (SELECT doc_id, blocks, generate_subscripts(blocks, 1) AS block_no
           FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '\\n#', chr(10) || chr(10) || '#', 'g'),
                                                   '\\n[ \\t\\x0B\\f\\r]*\\n') AS blocks
                 FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || ' ' || chr(10))
                                      ELSE replace(text, chr(10), chr(10) || '# ') END AS text FROM documents) m) d),
w AS (SELECT doc_id, block_no, list_filter(string_split_regex(blocks[block_no], '{_WS}'), lambda x: x <> '') AS w
      FROM b),
c AS (SELECT doc_id, block_no, w, unnest(range(0, CAST(ceil(len(w) / 200) AS BIGINT))) AS chunk_no
      FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_no, chunk_no) AS INTEGER) AS passage_no,
  array_to_string(w[chunk_no * 200 + 1 : chunk_no * 200 + 200], ' ') AS text,
  CAST(len(w[chunk_no * 200 + 1 : chunk_no * 200 + 200]) AS INTEGER) AS word_count
FROM c"""


def passages(t: ClinicalTables) -> DataFrame:
    """Passages of the documents, whose lines are set apart by blank lines (even ids) or
    begin with headings (odd ids)."""
    d = t.raw("documents")
    marked = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n \n"))).otherwise(
        F.replace("text", F.lit("\n"), F.lit("\n# ")))
    return K.split_passages(d.withColumn("text", marked))


@register("split_passages", _SPLIT_SQL)
def q_split_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(ClinicalTables(spark, sf_dir))


@register("dedupe_passages", f"""
WITH p AS ({_SPLIT_SQL}),
h AS (SELECT *, sha256(trim(regexp_replace(lower(text), '{_WS}', ' ', 'g'))) AS content_hash FROM p)
SELECT doc_id, passage_no, text, word_count, copies, content_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id, passage_no) AS rn,
         count(*) OVER (PARTITION BY content_hash) AS copies FROM h) x
WHERE rn = 1""")
def q_dedupe_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dedupe_passages(passages(ClinicalTables(spark, sf_dir)))


@register("near_copies", f"""
WITH p AS ({_SPLIT_SQL}),
n AS (SELECT doc_id, passage_no, list_filter(string_split_regex(lower(text), '{_WS}'), lambda x: x <> '') AS w FROM p),
s AS (SELECT doc_id, passage_no, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
        lambda i: array_to_string(w[i : i + 4], ' ')))) AS items FROM n),
c AS (SELECT items, min((doc_id, passage_no)) AS first, count(*) AS copies, row_number() OVER () AS id FROM s GROUP BY items),
e AS (SELECT id, len(items) AS m, unnest(items) AS item FROM c),
j AS (SELECT x.id AS a, y.id AS b, x.m + y.m - count(*) AS whole, count(*) AS common
      FROM e x JOIN e y ON x.item = y.item AND x.id <> y.id AND 5 * x.m >= 4 * y.m AND 5 * y.m >= 4 * x.m
      GROUP BY x.id, y.id, x.m, y.m HAVING 5 * count(*) >= 4 * (x.m + y.m - count(*))),
l AS (SELECT a, count(*) AS links, max(common / whole) AS best, bool_or(d.first < k.first) AS later
      FROM j JOIN c k ON a = k.id JOIN c d ON b = d.id GROUP BY a)
SELECT s.doc_id, s.passage_no, c.first[1] AS first_doc_id, c.first[2] AS first_passage_no, c.copies, coalesce(links, 0) AS links,
  round(best, 6) AS best, (s.doc_id = c.first[1] AND s.passage_no = c.first[2] AND NOT coalesce(later, false)) AS kept
FROM s JOIN c ON s.items = c.items LEFT JOIN l ON c.id = l.a""")
def q_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.near_copies(passages(ClinicalTables(spark, sf_dir)))


@register("repair_text", """
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN text || ' 5 \u00b0C ' || chr(CAST(161 + doc_id % 700 AS INTEGER)) || chr(CAST(161 + doc_id * 31 % 700 AS INTEGER))
  ELSE text END AS text, doc_id % 3 <> 0 AS repaired
FROM documents""")
def q_repair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three documents get a degree sign and a pair of the 700 characters from
    U+00A1 on, and are damaged as a whole; the repair must give back what they were."""
    d = ClinicalTables(spark, sf_dir).raw("documents")
    letters = F.lit("".join(map(chr, range(161, 861))))

    def letter(n):
        return F.substring(letters, n.cast("int") + 1, F.lit(1))
    marked = F.concat("text", F.lit(" 5 \u00b0C "), letter(F.col("doc_id") % 700), letter(F.col("doc_id") * 31 % 700))
    rows = d.select("doc_id", F.when(F.col("doc_id") % 3 != 0, K.damage_text(marked)).otherwise(F.col("text")).alias("before"))
    fixed = rows.select("doc_id", "before", K.repair_text("before").alias("text"))
    return fixed.select("doc_id", "text", (F.col("text") != F.col("before")).alias("repaired"))


_BM25_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda x: x <> '') AS toks
           FROM documents),
dl AS (SELECT doc_id, len(toks) AS dl FROM d),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT DISTINCT item_id AS qid,
        unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda x: x <> '')) AS term
      FROM benchmark),
t AS (SELECT doc_id, unnest(toks) AS term FROM d),
tf AS (SELECT term, t.doc_id, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY term, t.doc_id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.term, tf.doc_id,
        ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2
          / (tf.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl)) AS w
      FROM tf JOIN df ON tf.term = df.term JOIN dl ON tf.doc_id = dl.doc_id, st),
s AS (SELECT qid, doc_id, round(sum(w), 6) AS score FROM q JOIN w ON q.term = w.term GROUP BY qid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id ASC) AS rank,
        max(score) OVER (PARTITION BY qid) AS best FROM s)
SELECT qid AS question_id, rank, doc_id, score,
  round(CASE WHEN best > 0 THEN score / best ELSE 0.0 END, 6) AS relevance_score
FROM r WHERE rank <= 3"""


def lexical_hits(t: ClinicalTables) -> DataFrame:
    qs = t.raw("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return K.retrieve_lexical(qs, t.raw("documents"), k=3)


@register("retrieve_lexical", _BM25_SQL)
def q_retrieve_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_hits(ClinicalTables(spark, sf_dir))


@register("citations_for_answers", f"""
WITH hits AS ({_BM25_SQL})
SELECT h.question_id AS query_id, h.rank - 1 AS citation_pos, 0 AS reference_pos,
  'doc-' || CAST(h.doc_id AS VARCHAR) || '.md' AS source_document,
  CASE WHEN coalesce(d.text, '') = '' THEN NULL ELSE substring(d.text, 1, 1000) END AS excerpt_text,
  h.relevance_score
FROM hits h JOIN documents d ON h.doc_id = d.doc_id""")
def q_citations_for_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return K.citations_for_answers(lexical_hits(t), t.raw("documents"))


@register("retrieve_dense", """
SELECT qid, CAST(rank AS INTEGER) AS rank, vid, cosine FROM (
  SELECT q.vec_id AS qid, c.vec_id AS vid,
    round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS cosine,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY
      round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) DESC,
      c.vec_id ASC) AS rank
  FROM embeddings q, embeddings c) x
WHERE rank <= 5""")
def q_retrieve_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, ClinicalTables(spark, sf_dir).raw("embeddings"))


def _dense(spark: SparkSession, e: DataFrame) -> DataFrame:
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    c = e.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"))
    out = K.retrieve_dense(spark, q, c, k=5)
    return out.select("qid", F.col("rank").cast("int").alias("rank"), "vid", "cosine")


@register("retrieve_dense_approx")
def q_retrieve_dense_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows-only check here; recall against the exact K5 is tested separately."""
    e = ClinicalTables(spark, sf_dir).raw("embeddings")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    c = e.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"))
    return K.retrieve_dense_approx(q, c, k=5).withColumn("rank", F.col("rank").cast("int"))


@register("document_source", """
SELECT 'doc-' || CAST(doc_id AS VARCHAR) || '.md' AS document_name, text || chr(10) AS text FROM documents""")
def q_document_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown file per document in a folder, read back whole.
    (Each file ends with a newline, as Spark's text writer ends it.)"""
    d = ClinicalTables(spark, sf_dir).raw("documents")
    root = scratch_path(spark, "kb_docs")
    write_documents(d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("document_name"), "text"), root)
    return read_documents(spark, root).select("document_name", "text")
