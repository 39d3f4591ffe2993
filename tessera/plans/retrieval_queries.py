"""Retrieval queries: vector, keyword and hybrid top-k, facts, change feed, index sync."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as rv
from ..functions.numeric import pct_truncated_sql
from ..operators.chunking import chunk_documents
from ..operators.finance import prev_day_change, qoq_growth
from ..operators.joins import numbered
from ..session import write_once
from ..sources.tables import load_table
from .catalog import register
from .doc_inputs import DOCS_SQL, chunks_sql, document_files
from .finance_inputs import MARKET_SQL, daily_prices, financials

TOPK_KEYWORD = 10


def _chunks(spark, sf_dir):
    return chunk_documents(document_files(spark, sf_dir))


def _bench(spark, sf_dir):
    return load_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


@register("vector_topk", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT label, unnest(v) AS val, unnest(generate_series(1, len(v))) AS i FROM e),
c AS (SELECT label AS qid, list(m ORDER BY i) AS q
      FROM (SELECT label, i, avg(val) AS m FROM x GROUP BY label, i) GROUP BY label),
r AS (SELECT qid, vec_id AS id,
             row_number() OVER (PARTITION BY qid ORDER BY list_cosine_similarity(q, v) DESC, vec_id) AS rank
      FROM c, e)
SELECT qid, id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 2""")
def q_vector_topk(spark, sf_dir):
    emb = load_table(spark, sf_dir, "embeddings")
    queries = rv.centroids(emb, "label").withColumnRenamed("label", "qid")
    return rv.vector_topk(queries, emb, k=2, vid="vec_id").select(
        "qid", F.col("vec_id").alias("id"), "rank")


_TOK = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 0)"

_BM25_SQL = "WITH " + DOCS_SQL + "," + chunks_sql() + f"""
, toks AS (SELECT id AS doc, {_TOK.format(c='content')} AS t FROM chunks),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS (SELECT doc, term, len(t) AS dl, count(*) AS tf FROM (SELECT doc, t, unnest(t) AS term FROM toks)
         GROUP BY doc, term, dl),
dfreq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT DISTINCT item_id AS qid, unnest({_TOK.format(c='text')}) AS term FROM benchmark),
sc AS (SELECT qt.qid, post.doc,
              sum(ln(1 + (stats.n - dfreq.df + 0.5) / (dfreq.df + 0.5)) * post.tf * 2.2
                  / (post.tf + 1.2 * (1 - 0.75 + 0.75 * post.dl / stats.avgdl))) AS score
       FROM qt JOIN dfreq USING (term) JOIN post USING (term), stats GROUP BY qt.qid, post.doc),
rk AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM sc)
"""


@register("keyword_topk", _BM25_SQL + f"SELECT qid, doc, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= {TOPK_KEYWORD}")
def q_keyword_topk(spark, sf_dir):
    return rv.keyword_topk(_bench(spark, sf_dir), _chunks(spark, sf_dir), k=TOPK_KEYWORD).select("qid", "doc", "rank")


@register("retrieve_facts", _BM25_SQL + """
, hits AS (SELECT rk.qid, rk.rank, c.content FROM rk JOIN chunks c ON c.id = rk.doc WHERE rk.rank <= 2)
SELECT b.item_id AS qid,
       CASE WHEN count(h.content) = 0 THEN '{}'
            ELSE '{' || chr(10) || '  ' || string_agg('"fact_' || h.rank || '": ' || CAST(to_json(h.content) AS VARCHAR),
                                                     ',' || chr(10) || '  ' ORDER BY h.rank) || chr(10) || '}' END AS facts,
       CAST(count(h.content) AS BIGINT) AS n_facts
FROM benchmark b LEFT JOIN hits h ON h.qid = b.item_id GROUP BY b.item_id""")
def q_retrieve_facts(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    q = _bench(spark, sf_dir)
    hits = rv.keyword_topk(q, chunks, k=2)
    return rv.facts_json(rv.retrieve_facts(hits, chunks), queries=q)


_BUCKET = "CAST(('0x' || substr(md5({t}), 1, 8)) AS UBIGINT) % 256"

_HYBRID_SQL = _BM25_SQL + f"""
, dv AS (SELECT doc, {_BUCKET.format(t="term")} AS b, sum(tf) AS n FROM post GROUP BY doc, b),
dn AS (SELECT doc, sqrt(sum(n * n)) AS norm FROM dv GROUP BY doc),
qtok AS (SELECT item_id AS qid, unnest({_TOK.format(c='text')}) AS term FROM benchmark),
qv AS (SELECT qid, {_BUCKET.format(t="term")} AS b, count(*) AS n FROM qtok GROUP BY qid, b),
qn AS (SELECT qid, sqrt(sum(n * n)) AS norm FROM qv GROUP BY qid),
dot AS (SELECT qid, doc, sum(qv.n * dv.n) AS d FROM qv JOIN dv USING (b) GROUP BY qid, doc),
vr AS (SELECT b.item_id AS qid, c.id AS doc, row_number() OVER (
         PARTITION BY b.item_id ORDER BY round(coalesce(d / (qn.norm * dn.norm), 0), 9) DESC, c.id) AS rank_v
       FROM benchmark b CROSS JOIN chunks c LEFT JOIN dot ON dot.qid = b.item_id AND dot.doc = c.id
       LEFT JOIN qn ON qn.qid = b.item_id LEFT JOIN dn ON dn.doc = c.id),
fz AS (SELECT vr.qid, vr.doc, rank_v, rk.rank AS rank_k,
              1.0::DOUBLE / (60 + rank_v) + coalesce(1.0::DOUBLE / (60 + rk.rank), 0) AS fused
       FROM vr LEFT JOIN rk ON rk.qid = vr.qid AND rk.doc = vr.doc),
hy AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 12) DESC, doc) AS rank FROM fz)
"""


def _hybrid(spark, sf_dir, chunks, queries):
    """Hybrid hits over chunks embedded by token buckets (as the queries are)."""
    docs = rv.embed(chunks.select("id", "content"), "content", rv.bucket_counts)
    return rv.hybrid_topk(rv.embed(queries, "text", rv.bucket_counts, out_col="qvec"), docs, k=2)


@register("hybrid_topk", _HYBRID_SQL + """
SELECT qid, doc, CAST(rank AS BIGINT) AS rank, CAST(rank_v AS BIGINT) AS rank_v, CAST(rank_k AS BIGINT) AS rank_k
FROM hy WHERE rank <= 2""")
def q_hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, _chunks(spark, sf_dir), _bench(spark, sf_dir)).select("qid", "doc", "rank", "rank_v", "rank_k")


def embedding_sql(chunks):
    """CTE ``embedded``: all columns of ``chunks`` and the token counts of the 256 buckets as text."""
    return f"""
, tk AS (SELECT id, unnest({_TOK.format(c='content')}) AS term FROM {chunks}),
v AS (SELECT id, {_BUCKET.format(t="term")} AS b, count(*) AS n FROM tk GROUP BY id, b),
g AS (SELECT c.id, s.b FROM {chunks} c CROSS JOIN range(256) s(b)),
em AS (SELECT g.id, string_agg(CAST(coalesce(v.n, 0) AS VARCHAR), ',' ORDER BY g.b) AS embedding
       FROM g LEFT JOIN v ON v.id = g.id AND v.b = g.b GROUP BY g.id),
embedded AS (SELECT c.*, em.embedding FROM {chunks} c JOIN em USING (id))
"""


def embedding_text(col):
    """Token counts as text, as :func:`embedding_sql` has them."""
    return F.array_join(F.transform(col, lambda x: x.cast("int").cast("string")), ",")


@register("embed_documents", "WITH " + DOCS_SQL + "," + chunks_sql() + embedding_sql("chunks") + "SELECT id, embedding FROM embedded")
def q_embed_documents(spark, sf_dir):
    e = rv.embed(_chunks(spark, sf_dir).select("id", "content"), "content", rv.bucket_counts)
    return e.select("id", embedding_text("embedding").alias("embedding"))


def _docs_with_lang(spark, sf_dir):
    return document_files(spark, sf_dir, "lang", "source")


def before_after(spark, sf_dir):
    """Two versions of the chunk table: before lacks the German documents; after
    lacks source src19 and appends a sentence to every src7 document."""
    d = _docs_with_lang(spark, sf_dir)
    before = chunk_documents(d.filter(F.col("lang") != "de"))
    after_docs = (d.filter(F.col("source") != "src19")
                  .withColumn("text", F.when(F.col("source") == "src7", F.concat("text", F.lit(" Revised.")))
                              .otherwise(F.col("text"))))
    after_docs = after_docs.withColumn("size", F.octet_length("text").cast("bigint"))
    return before, chunk_documents(after_docs)


_SNAP_SQL = "WITH " + DOCS_SQL.replace("FROM documents)", "FROM documents WHERE lang <> 'de')").replace(
    "docs AS", "docs_b AS") + "," + DOCS_SQL.replace(
    "CAST(strlen(text) AS BIGINT) AS size, text",
    "CAST(strlen(CASE WHEN source = 'src7' THEN text || ' Revised.' ELSE text END) AS BIGINT) AS size, "
    "CASE WHEN source = 'src7' THEN text || ' Revised.' ELSE text END AS text").replace(
    "FROM documents)", "FROM documents WHERE source <> 'src19')").replace("docs AS", "docs_a AS") + "," + \
    chunks_sql("docs_b").replace("normed AS", "normed_b AS").replace("chunks AS", "cb AS").replace(
        "FROM normed,", "FROM normed_b,") + "," + \
    chunks_sql("docs_a").replace("normed AS", "normed_a AS").replace("chunks AS", "ca AS").replace(
        "FROM normed,", "FROM normed_a,") + """
, j AS (SELECT coalesce(cb.id, ca.id) AS id, cb.id AS bid, ca.id AS aid,
               cb.doc_uri AS b_uri, cb.size AS b_size, cb.content AS b_content,
               ca.doc_uri AS a_uri, ca.size AS a_size, ca.content AS a_content,
               (cb.doc_name IS NOT DISTINCT FROM ca.doc_name AND cb.doc_uri IS NOT DISTINCT FROM ca.doc_uri
                AND cb.size IS NOT DISTINCT FROM ca.size AND cb.content IS NOT DISTINCT FROM ca.content
                AND cb.metadata IS NOT DISTINCT FROM ca.metadata
                AND cb.chunk_index IS NOT DISTINCT FROM ca.chunk_index) AS same
        FROM cb FULL OUTER JOIN ca ON cb.id = ca.id),
feed AS (
  SELECT id, 'insert' AS _change_type, a_uri AS doc_uri, a_size AS size, a_content AS content FROM j WHERE bid IS NULL
  UNION ALL SELECT id, 'delete', b_uri, b_size, b_content FROM j WHERE aid IS NULL
  UNION ALL SELECT id, 'update_preimage', b_uri, b_size, b_content FROM j WHERE bid IS NOT NULL AND aid IS NOT NULL AND NOT same
  UNION ALL SELECT id, 'update_postimage', a_uri, a_size, a_content FROM j WHERE bid IS NOT NULL AND aid IS NOT NULL AND NOT same)
"""


@register("change_feed", _SNAP_SQL + "SELECT * FROM feed")
def q_change_feed(spark, sf_dir):
    before, after = before_after(spark, sf_dir)
    return rv.snapshot_diff(before, after, "id").select("id", "_change_type", "doc_uri", "size", "content")


@register("index_sync", _SNAP_SQL + embedding_sql("ca") + """
SELECT id, doc_uri, content, embedding,
       id IN (SELECT id FROM feed WHERE _change_type IN ('insert', 'update_postimage')) AS synced
FROM embedded""")
def q_index_sync(spark, sf_dir):
    """The index of the older version, brought up to the newer one by the change feed."""
    before, after = before_after(spark, sf_dir)
    emb = lambda df: rv.embed(df, "content", rv.bucket_counts)
    index = numbered(rv.sync_index(None, before, embed_with=emb), "index")
    columns, after = after.columns, numbered(after, "snapshot")
    # the index has all columns of the older version
    changes = write_once(rv.changed_keys(index, after, "id", columns[1:]), "changes")
    return rv.sync_index(index, after, changes, embed_with=emb, row_col="_r").select(
        "id", "doc_uri", "content", embedding_text("embedding").alias("embedding"), "synced")


# Each question asks about one ticker (by its id): its last close, that day's change
# to the day before, and its last quarter's growth are looked up in the tables.
_STRUCTURED_SQL = MARKET_SQL + f"""
, pd AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM px),
lastp AS (SELECT ticker, close, {pct_truncated_sql('close - prev', 'prev')} AS day_pct FROM pd
          QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
gq AS (SELECT *, lag(revenue_m) OVER (PARTITION BY ticker ORDER BY fiscal_year, fiscal_quarter) AS prev FROM fin),
lastg AS (SELECT ticker, {pct_truncated_sql('revenue_m - prev', 'prev')} AS growth_pct FROM gq
          QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC, fiscal_quarter DESC) = 1),
st AS (SELECT p.ticker, 'close ' || CAST(close AS VARCHAR) || ', day ' || coalesce(CAST(day_pct AS VARCHAR), 'none')
              || ', quarter ' || coalesce(CAST(growth_pct AS VARCHAR), 'none') AS data FROM lastp p JOIN lastg USING (ticker))
"""


def _structured(spark, sf_dir, questions):
    px = prev_day_change(daily_prices(spark, sf_dir))
    last = px.groupBy("ticker").agg(F.max_by(F.struct("close", "pct_change"), "date").alias("p"))
    growth = qoq_growth(financials(spark, sf_dir)).groupBy("ticker").agg(
        F.max_by(F.struct("growth_pct"), F.struct("fiscal_year", "fiscal_quarter")).alias("g"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    data = last.join(growth, "ticker").select("ticker", F.concat(
        F.lit("close "), text("p.close"), F.lit(", day "), text("p.pct_change"), F.lit(", quarter "), text("g.growth_pct")).alias("data"))
    ticker = F.concat(F.lit("N"), F.lpad((F.col("qid") % 25).cast("string"), 2, "0"))
    return questions.select("qid", ticker.alias("ticker")).join(data, "ticker").select("qid", "data")


@register("answer_questions", _HYBRID_SQL + "," + _STRUCTURED_SQL + """
, hits AS (SELECT hy.qid, hy.rank, c.content FROM hy JOIN chunks c ON c.id = hy.doc WHERE hy.rank <= 2),
fj AS (SELECT b.item_id AS qid, b.text, CASE WHEN count(h.content) = 0 THEN '{}'
              ELSE '{' || chr(10) || '  ' || string_agg('"fact_' || h.rank || '": ' || CAST(to_json(h.content) AS VARCHAR),
                                                       ',' || chr(10) || '  ' ORDER BY h.rank) || chr(10) || '}' END AS facts
       FROM benchmark b LEFT JOIN hits h ON h.qid = b.item_id GROUP BY b.item_id, b.text)
SELECT fj.qid, fj.text AS question, fj.facts,
       '<name>Response Agent</name>' || chr(10) || 'Echo: ' || fj.text || chr(10) || fj.facts
       || coalesce(chr(10) || '<name>Structured Agent</name>' || chr(10) || st.data, '') AS answer
FROM fj LEFT JOIN st ON st.ticker = 'N' || lpad(CAST(fj.qid % 25 AS VARCHAR), 2, '0')""")
def q_answer_questions(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    q = _bench(spark, sf_dir)
    facts = rv.facts_json(rv.retrieve_facts(_hybrid(spark, sf_dir, chunks, q), chunks), queries=q)
    return rv.answer_questions(q, facts, structured=_structured(spark, sf_dir, q))


@register("facts_json", _BM25_SQL + f"""
, hits AS (SELECT rk.qid, rk.rank, c.content FROM rk JOIN chunks c ON c.id = rk.doc WHERE rk.rank <= {TOPK_KEYWORD})
SELECT b.item_id AS qid,
       CASE WHEN count(h.content) = 0 THEN '{{}}'
            ELSE '{{' || chr(10) || '  ' || string_agg('"fact_' || h.rank || '": ' || CAST(to_json(h.content) AS VARCHAR),
                                                     ',' || chr(10) || '  ' ORDER BY h.rank) || chr(10) || '}}' END AS facts,
       CAST(count(h.content) AS BIGINT) AS n_facts
FROM benchmark b LEFT JOIN hits h ON h.qid = b.item_id GROUP BY b.item_id""")
def q_facts_json(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    q = _bench(spark, sf_dir)
    hits = rv.keyword_topk(q, chunks, k=TOPK_KEYWORD)
    return rv.facts_json(rv.retrieve_facts(hits, chunks), queries=q)
