"""Every query of the engine by name, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions import pieces, text
from quire.functions.stem import stems_sql
from quire.operators import chunker, evaluation, fulltext, hybrid, lookups, vectors
from quire.plans import ingest
from quire.plans.storage import kept, staged, table
from quire.sources import markup, pdf, route
from quire.sources.files import verify_manifest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: A point in time the lease queries take as now.
NOW = "2025-06-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def chunks_of(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_chunks")


def docs_of(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def embeddings_of(s: SparkSession, d: str) -> DataFrame:
    return vectors.usable(table(s, d, "vec_chunks")).withColumnRenamed("chunk_rowid", "id")


def _per_text(rows: DataFrame, key: str, f: Callable, name: str, kind: str) -> DataFrame:
    """(key, name) with a Python function of every text that is not null, in Arrow batches."""
    from pyspark.sql.types import StructType

    def run(batches):
        for b in batches:
            got = [f(t) for t in b.column(1).to_pylist()]
            if kind.startswith("struct"):
                got = [dict(zip(fields, g)) for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, want)], [key, name])

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {name} {kind}"
    inner = rows.sparkSession.createDataFrame([], schema).schema[name].dataType
    fields = inner.fieldNames() if isinstance(inner, StructType) else []
    want = to_arrow_type(inner)
    return rows.filter("text is not null").select(key, "text").mapInArrow(run, schema)


# --- text measures ---------------------------------------------------------------------------------------------

_CJK = "len(regexp_extract_all(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}]'))"
_U16 = "(len(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))"
_EST = f"(ceil(({_U16} - {_CJK}) / 4.0) + {_CJK})::INT"


@query(f"SELECT id, {_U16}::INT AS units, {_CJK}::INT AS cjk, {_EST} AS tokens FROM document_chunks")
def token_estimate(s, d):
    t = F.col("text")
    return chunks_of(s, d).select("id", text.utf16_length(t).alias("units"), text.cjk_count(t).alias("cjk"), text.estimate_tokens(t).alias("tokens"))


@query(f"""SELECT id, CASE WHEN {_U16} <= 160 THEN text ELSE regexp_replace(CASE WHEN strpos(tail, '. ') BETWEEN 1 AND 80 THEN substr(tail, strpos(tail, '. ') + 2) WHEN strpos(tail, ' ') > 0 THEN substr(tail, strpos(tail, ' ') + 1) ELSE tail END, '^[\\s\\x{{85}}\\p{{Z}}]+', '') END AS tail FROM (SELECT id, text, right(text, 160) AS tail FROM document_chunks WHERE text IS NOT NULL) z""")
def take_last_tokens(s, d):
    return _per_text(chunks_of(s, d), "id", lambda t: pieces.take_last(t, 40), "tail", "string")


@query(f"""WITH p AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^.!?]+(?:[.!?]+["'')\\]]*\\s*|$)')) AS s FROM documents WHERE text IS NOT NULL AND {_EST} > 100)
SELECT doc_id, 0 AS parts_over, true AS in_order FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM p WHERE {_EST.replace('text', 's')} > 100)""")
def split_prose_laws(s, d):
    """Of texts without a long sentence: parts beyond the budget, and whether the parts are the text in its order, but for
    runs of . ! ? that no sentence takes."""

    def laws(text: str) -> tuple[bool, int, bool]:
        parts = pieces.split_prose(text, 100)
        letters = lambda t: "".join(c for c in t if c.isalnum())
        over = pieces.estimate(text) > 100 and any(pieces.estimate(m) > 100 for m in pieces._SENTENCE.findall(text))
        return over, sum(pieces.estimate(p) > 100 for p in parts), letters("".join(parts)) == letters(text)

    rows = _per_text(docs_of(s, d), "doc_id", laws, "l", "struct<long:boolean,parts_over:int,in_order:boolean>")
    return rows.filter("not l.long").select("doc_id", "l.parts_over", "l.in_order")


@query()
def split_prose(s, d):
    return _per_text(docs_of(s, d), "doc_id", lambda t: pieces.split_prose(t, 100), "parts", "array<string>").select("doc_id", F.posexplode("parts").alias("part", "text"))


@query("SELECT kind, count(*) AS chunks, min(token_count) AS least, max(token_count) AS most, round(avg(token_count), 6) AS mean, count(DISTINCT locator_value) AS locators FROM document_chunks GROUP BY kind")
def chunk_stats(s, d):
    return chunks_of(s, d).groupBy("kind").agg(F.count("*").alias("chunks"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.round(F.avg("token_count"), 6).alias("mean"), F.countDistinct("locator_value").alias("locators"))


@query("""SELECT id, coalesce(lag(locator_value) OVER w IS NOT DISTINCT FROM locator_value AND lag(section_path) OVER w IS NOT DISTINCT FROM section_path AND lag(id) OVER w IS NOT NULL, false) AS continues,
  CASE WHEN lag(locator_value) OVER w IS NOT DISTINCT FROM locator_value AND lag(section_path) OVER w IS NOT DISTINCT FROM section_path AND lag(id) OVER w IS NOT NULL THEN lag(text) OVER w END AS previous
  FROM document_chunks WINDOW w AS (PARTITION BY document_id ORDER BY seq)""")
def chunk_overlap(s, d):
    return chunker.overlaps(chunks_of(s, d))


@query("""SELECT c.id, concat_ws(chr(10) || chr(10), nullif(d.title, ''), nullif(array_to_string(c.section_path, ' › '), ''), nullif(c.text, '')) AS passage FROM document_chunks c JOIN documents d USING (document_id)""")
def embed_input(s, d):
    rows = chunks_of(s, d).join(docs_of(s, d).select("document_id", "title"), "document_id")
    return rows.select("id", vectors.embed_input(F.col("title"), F.col("section_path"), F.lit(None).cast("string"), F.col("text")).alias("passage"))


@query("""SELECT id, CASE WHEN coalesce(len(section_path), 0) > 0 THEN array_to_string(section_path, ' › ') ELSE '(no section)' END || ' — ' || locator_type || ' ' || locator_value || CASE WHEN printed_label IS NOT NULL AND printed_label <> locator_value THEN ' (printed ' || printed_label || ')' ELSE '' END AS location FROM document_chunks""")
def describe_location(s, d):
    return chunker.describe_location(chunks_of(s, d))


# --- full text -------------------------------------------------------------------------------------------------

_FOLD = f"translate(lower(@), '{fulltext._FROM}', '{fulltext._TO}')"
_TOK = f"regexp_extract_all(regexp_replace({_FOLD.replace('@', 'text')}, '\\p{{Mn}}+', '', 'g'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"
_P = f"p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TOK}) AS term FROM document_chunks) z GROUP BY 1, 2)"
_DL = f"dl AS (SELECT id, coalesce(len({_TOK}), 0) AS dl FROM document_chunks)"
_Q = f"""q AS (SELECT question_id, phrase, count(*) AS times FROM (SELECT question_id, {_TOK.replace('lower(text)', 'lower(t)')} AS phrase FROM (SELECT question_id, unnest(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''-]*')) AS t FROM questions) y) z WHERE len(phrase) > 0 GROUP BY 1, 2)"""
_TF = f"""tk AS (SELECT id, {_TOK} AS a FROM document_chunks WHERE text IS NOT NULL), tx AS (SELECT id, a, unnest(a) AS term, generate_subscripts(a, 1) AS i FROM tk),
dp AS (SELECT DISTINCT phrase FROM q), tf AS (SELECT phrase, id, count(*) AS tf FROM tx JOIN dp ON term = phrase[1] WHERE a[i:i + len(phrase) - 1] = phrase GROUP BY 1, 2)"""
_BM25 = f"""WITH {_DL}, {_Q}, {_TF}, st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT phrase, avgdl, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, st),
sc AS (SELECT question_id, id, -sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN dl USING (id) JOIN w USING (phrase) JOIN q USING (phrase) WHERE @where GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9), id) AS rank FROM sc)
SELECT question_id, id, round(score, 8) AS score, rank FROM r WHERE rank <= 10"""


_TERMS = f"words AS (SELECT DISTINCT w FROM (SELECT unnest({_TOK}) AS w FROM document_chunks UNION ALL SELECT unnest({_TOK.replace('lower(text)', 'lower(question)')}) FROM questions) z)"
_Q_STEM = f"""q AS (SELECT question_id, phrase, count(*) AS times FROM (SELECT question_id, n, list(s ORDER BY i) AS phrase FROM (SELECT question_id, n, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT question_id, n, {_TOK.replace('lower(text)', 'lower(t)')} AS a FROM (SELECT question_id, unnest(x) AS t, generate_subscripts(x, 1) AS n FROM (SELECT question_id, regexp_extract_all(question, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''-]*') AS x FROM questions) v) u) y) z JOIN stems USING (w) GROUP BY 1, 2) o GROUP BY 1, 2)"""
_TF_STEM = _TF.replace(_TF[: _TF.index(", tx AS")], f"tk AS (SELECT id, list(s ORDER BY i) AS a FROM (SELECT id, unnest({_TOK}) AS w, generate_subscripts({_TOK}, 1) AS i FROM document_chunks WHERE text IS NOT NULL) z JOIN stems USING (w) GROUP BY 1)")
_BM25_STEM = _BM25.replace(f"WITH {_DL}, {_Q}, {_TF}", f"WITH {_TERMS}, {stems_sql('words')}, {_DL}, {_Q_STEM}, {_TF_STEM}")


@query(f"WITH {_P} SELECT id, term, tf FROM p")
def postings(s, d):
    return fulltext.postings(chunks_of(s, d)).select("id", "term", "tf")


@query(f"WITH {_P} SELECT term, count(*) AS chunks, sum(tf)::BIGINT AS n FROM p GROUP BY 1")
def doc_freq(s, d):
    return fulltext.postings(chunks_of(s, d)).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("n"))


@query(f"WITH {_DL} SELECT id, dl::INT AS dl FROM dl")
def doc_lengths(s, d):
    return fulltext.doc_lengths(chunks_of(s, d))


@query(f"WITH {_DL} SELECT count(*) AS n, sum(dl)::BIGINT AS total, round(avg(dl), 9) AS avgdl FROM dl")
def corpus_stats(s, d):
    return fulltext.corpus_stats(chunks_of(s, d)).withColumn("avgdl", F.round("avgdl", 9))


@query("SELECT question_id, array_to_string(list_transform(regexp_extract_all(question, '[\\p{L}\\p{N}][\\p{L}\\p{N}''-]*'), lambda t: '\"' || t || '\"'), ' OR ') AS expression FROM questions")
def match_expressions(s, d):
    return table(s, d, "questions").select("question_id", fulltext.match_expression(F.col("question")).alias("expression"))


def _bm25(s, d, only=None, stem=False):
    best = fulltext.bm25(fulltext.index_of(chunks_of(s, d).select("id", "text"), stem), table(s, d, "questions"), only, 10)
    return best.select("question_id", "id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_BM25.replace("@where", "true"))
def bm25_topk(s, d):
    return _bm25(s, d)


@query(_BM25.replace("@where", "id IN (SELECT id FROM document_chunks JOIN documents USING (document_id) WHERE kind = 'text' AND ingest_status = 'ready')"))
def bm25_filtered(s, d):
    ready = docs_of(s, d).filter("ingest_status = 'ready'").select("document_id")
    return _bm25(s, d, chunks_of(s, d).filter("kind = 'text'").join(ready, "document_id", "left_semi"))


@query(_BM25_STEM.replace("@where", "true"))
def bm25_porter(s, d):
    return _bm25(s, d, stem=True)


@query()
def fts_snippets(s, d):
    """Snippets of each question's ten best chunks."""
    phrases = fulltext.query_phrases(table(s, d, "questions")).groupBy("question_id").agg(F.sort_array(F.collect_list("phrase")).alias("phrases"))
    best = _bm25(s, d).join(chunks_of(s, d).select("id", "text"), "id").join(phrases, "question_id").select("question_id", "id", "text", "phrases")

    def run(batches):
        for b in batches:
            cut = [fulltext.snippet(t or "", p) for t, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.string())], ["question_id", "id", "snippet"])

    return best.mapInArrow(run, "question_id long, id long, snippet string")


# --- vectors ---------------------------------------------------------------------------------------------------

_V = "v AS (SELECT chunk_rowid AS id, min(document_id) AS document_id, min(embedding)::DOUBLE[] AS e FROM vec_chunks WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"
_KNN = "WITH {v}, n AS (SELECT q.id AS question_id, v.id, list_distance(q.e, v.e) AS d FROM v q JOIN v ON {on} WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(d, 9), id) AS rank FROM n) SELECT question_id, id, round(d, 6) AS distance, rank FROM r"


def _query_vectors(e):
    return e.filter("id % 100 = 0").withColumnRenamed("id", "question_id")


def _shown(df):
    return df.select("question_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(_KNN.format(v=_V, on="true") + " WHERE rank <= 10")
def knn_l2_topk(s, d):
    e = embeddings_of(s, d)
    return _shown(vectors.knn(_query_vectors(e), e, 10))


@query(_KNN.format(v=_V, on="q.document_id = v.document_id") + " WHERE rank <= 10")
def knn_partitioned(s, d):
    e = embeddings_of(s, d)
    return _shown(vectors.knn(_query_vectors(e), e, 10, within="document_id"))


@query(_KNN.format(v=_V, on="true") + " WHERE rank <= 50 AND id IN (SELECT id FROM document_chunks WHERE kind = 'text')")
def knn_postfilter_rank(s, d):
    """Ranks among all vectors, then only text chunks: the ranks keep their gaps."""
    e = embeddings_of(s, d)
    return _shown(vectors.knn(_query_vectors(e), e, 50).join(chunks_of(s, d).filter("kind = 'text'").select("id"), "id", "left_semi"))


_STUB = """w AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {of}) z GROUP BY 1, 2),
h AS (SELECT w, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(w, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295) % 384)::INT AS bucket FROM (SELECT DISTINCT w FROM w) y),
b AS (SELECT {key}, bucket, sum(n)::BIGINT AS n FROM w JOIN h USING (w) GROUP BY 1, 2)"""


@query("WITH " + _STUB.format(key="id", text="text", of="document_chunks") + " SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 9) AS weight FROM b")
def stub_embedding(s, d):
    return vectors.stub_buckets(chunks_of(s, d), "id", "text").select("id", "bucket", F.round("weight", 9).alias("weight"))


# --- fusion and search -----------------------------------------------------------------------------------------

_LEGS = """l AS (SELECT question_id, chunk_rowid AS id, leg, score, row_number() OVER (PARTITION BY question_id, chunk_rowid, leg ORDER BY logged_at DESC NULLS LAST, hit_id DESC, score DESC) AS nth FROM hits WHERE leg IN ('lexical', 'semantic') AND score IS NOT NULL AND NOT isnan(score)),
k AS (SELECT question_id, id, leg, row_number() OVER (PARTITION BY question_id, leg ORDER BY score, id) AS rank FROM l WHERE nth = 1)"""


@query(f"""WITH {_LEGS}, f AS (SELECT question_id, id, sum(CASE leg WHEN 'lexical' THEN 1.0 ELSE 1.5 END::DOUBLE / (2 + rank)) AS score FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, id) AS rank FROM f) SELECT question_id, id, round(score, 9) AS score, rank FROM r WHERE rank <= 10""")
def hybrid_rrf(s, d):
    top = hybrid.fused_top(evaluation.leg_ranks(table(s, d, "hits")), 10)
    return top.select("question_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def _question_vectors(s, d):
    q = table(s, d, "questions").select("question_id", "question")
    return q.join(vectors.stub_embed(q, "question_id", "question"), "question_id")


def _chunk_vectors(s, d):
    chunks = chunks_of(s, d).select("id", "text")
    return kept(chunks, "vectors", lambda: vectors.stub_embed(chunks, "id", "text"))


def _search(s, d, **how):
    hits = hybrid.hybrid_search(chunks_of(s, d), docs_of(s, d), _chunk_vectors(s, d), _question_vectors(s, d), **how)
    return hits.select("question_id", "rank", "id", F.round("score", 9).alias("score"), "round")


_WEIGHTS = {side: _STUB.format(key=key, text=text_, of=of).replace("w AS", f"w{side} AS").replace("FROM w ", f"FROM w{side} ").replace("FROM w)", f"FROM w{side})").replace("h AS", f"h{side} AS").replace("JOIN h ", f"JOIN h{side} ").replace("b AS", f"b{side} AS") for side, key, text_, of in (("q", "question_id", "question", "questions"), ("c", "id", "text", "document_chunks"))}
_SEM = f"""{_WEIGHTS['q']}, {_WEIGHTS['c']}, vq AS (SELECT question_id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY question_id)))::FLOAT::DOUBLE AS w FROM bq), vc AS (SELECT id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS w FROM bc),
nq AS (SELECT question_id, sum(w * w) AS s FROM vq GROUP BY 1), nc AS (SELECT c.id, coalesce(sum(w * w), 0) AS s FROM document_chunks c LEFT JOIN vc USING (id) GROUP BY 1),
dots AS (SELECT question_id, id, sum(vq.w * vc.w) AS dot FROM vq JOIN vc USING (bucket) GROUP BY 1, 2),
sem AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY round(sqrt(greatest(nq.s + nc.s - 2 * coalesce(dot, 0), 0)), 9), id) AS rank FROM nq CROSS JOIN nc LEFT JOIN dots USING (question_id, id))"""
_READY = "ready AS (SELECT id FROM document_chunks JOIN documents USING (document_id) WHERE ingest_status = 'ready')"
_FUSED = """f AS (SELECT question_id, id, sum(w / (2 + rank)) AS score FROM legs GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, id) AS rank FROM f WHERE id IN (SELECT id FROM ready))
SELECT question_id, rank::INT AS rank, id, round(score, 9) AS score, 0 AS round FROM o WHERE rank <= 10"""
_LEX = _BM25.replace("@where", "id IN (SELECT id FROM ready)").split("\nSELECT question_id, id, round(score, 8)")[0].replace("WITH ", f"WITH {_READY}, ", 1)


_LEX_STEM = _BM25_STEM.replace("@where", "id IN (SELECT id FROM @pushed)").split("\nSELECT question_id, id, round(score, 8)")[0].replace("WITH ", f"WITH {_READY}, @allowed", 1)
_BOTH = f", {_SEM}, legs AS (SELECT question_id, id, rank, 1.0::DOUBLE AS w FROM r WHERE rank <= 20 UNION ALL SELECT question_id, id, rank, 1.5::DOUBLE FROM sem WHERE rank <= 20), {_FUSED}"
_STEMMED = _LEX_STEM.replace("@pushed", "ready").replace("@allowed", "")
#: Rounds of escalation: the semantic leg, filtered after it ranks, doubles its limit while it was full and hits are missing.
_ROUNDS = f""", {_SEM}, legs AS (SELECT question_id, id, rank, 1.0::DOUBLE AS w, 'lexical' AS leg FROM r WHERE rank <= @k * 2 UNION ALL SELECT question_id, id, rank, 1.5::DOUBLE, 'semantic' FROM sem WHERE rank <= @k * 256),
g AS (SELECT unnest(range(4)) AS round), cut AS (SELECT * FROM legs, g WHERE leg = 'lexical' OR rank <= @k * 32 * (1 << round)),
fu AS (SELECT question_id, round, id, sum(w / (2 + rank)) AS score FROM cut GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id, round ORDER BY round(score, 12) DESC, id) AS place FROM fu WHERE id IN (SELECT id FROM allowed)),
sat AS (SELECT question_id, round, count(*) FILTER (leg = 'semantic') = @k * 32 * (1 << round) AS full_ FROM cut GROUP BY 1, 2),
ends AS (SELECT question_id, min(round) AS round FROM sat WHERE round = 3 OR NOT full_ OR (SELECT count(*) FROM o WHERE o.question_id = sat.question_id AND o.round = sat.round AND place <= @k) >= @k GROUP BY 1)
SELECT question_id, place::INT AS rank, id, round(score, 9) AS score, round::INT AS round FROM o JOIN ends USING (question_id, round) WHERE place <= @k"""


@query(_STEMMED + _BOTH)
def hybrid_search(s, d):
    """Every question against every chunk, both legs, ten hits each."""
    return _search(s, d)


@query(_LEX + _BOTH)
def hybrid_unstemmed(s, d):
    """As hybrid_search, with plain tokens."""
    return _search(s, d, stem=False)


def _escalated(k: int, where: str) -> str:
    allowed = f"allowed AS (SELECT id FROM document_chunks WHERE {where} AND id IN (SELECT id FROM ready)), "
    return (_LEX_STEM.replace("@pushed", "allowed").replace("@allowed", allowed) + _ROUNDS).replace("@k", str(k))


@query(_escalated(10, "kind = 'table'"))
def hybrid_filtered(s, d):
    """Only tables: the semantic leg is filtered after it ranks and escalates until it has ten."""
    return _search(s, d, filters=hybrid.Filters(kind="table"))


@query(_escalated(5, "page_number BETWEEN 1 AND 2"))
def hybrid_pages(s, d):
    return _search(s, d, filters=hybrid.Filters(pages=(1, 2)), k=5)


@query(f"WITH {_READY}, {_SEM}, legs AS (SELECT question_id, id, rank, 1.0::DOUBLE AS w FROM sem WHERE rank <= 20), {_FUSED}")
def semantic_search(s, d):
    return _search(s, d, mode="semantic")


@query(_STEMMED + f", legs AS (SELECT question_id, id, rank, 1.0::DOUBLE AS w FROM r WHERE rank <= 20), {_FUSED}")
def lexical_search(s, d):
    return _search(s, d, mode="lexical")


@query()
def semantic_snippets(s, d):
    best = _search(s, d, k=3).join(chunks_of(s, d).select("id", "text"), "id").join(table(s, d, "questions").select("question_id", "question"), "question_id")

    def run(batches):
        for b in batches:
            cut = [hybrid.semantic_snippet(t or "", q or "") for t, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.string())], ["question_id", "id", "snippet"])

    return best.select("question_id", "id", "text", "question").mapInArrow(run, "question_id long, id long, snippet string")


@query("""SELECT c.id FROM document_chunks c WHERE len(section_path) >= 1 AND (lower(section_path[1]) LIKE 'review%') AND NOT regexp_matches(substr(lower(section_path[1]), 7, 1), '[\\p{L}\\p{N}]')""")
def section_prefix(s, d):
    return chunks_of(s, d).filter(hybrid.section_matches(F.col("section_path"), F.lit(" Review "))).select("id")


# --- evaluation ------------------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(lower({c}), '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
_TRUTH = f"""t AS (SELECT DISTINCT question_id, c.id FROM questions q JOIN documents d ON d.source_path = q.source_path AND d.ingest_status = 'ready' JOIN document_chunks c USING (document_id)
  WHERE {_NORM.format(c='q.anchor')} <> '' AND contains({_NORM.format(c='c.text')}, {_NORM.format(c='q.anchor')}))"""
_BEST = "rs AS (SELECT question_id, qtype FROM questions WHERE question_id IN (SELECT question_id FROM t))"
_MET = "count(*) AS questions, round(avg(coalesce((best <= 1)::INT, 0)), 9) AS recall_1, round(avg(coalesce((best <= 3)::INT, 0)), 9) AS recall_3, round(avg(coalesce((best <= 5)::INT, 0)), 9) AS recall_5, round(avg(coalesce(1.0::DOUBLE / best, 0)), 9) AS mrr"
_MODES = f"""{_LEGS}, {_TRUTH}, {_BEST}, fu AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY round(s, 12) DESC, id) AS rank FROM (SELECT question_id, id, sum(CASE leg WHEN 'lexical' THEN 1.0 ELSE 1.5 END::DOUBLE / (2 + rank)) AS s FROM k GROUP BY 1, 2) z),
m AS (SELECT question_id, id, leg AS mode, rank FROM k WHERE rank <= 10 UNION ALL SELECT question_id, id, 'hybrid', rank FROM fu WHERE rank <= 10),
b AS (SELECT rs.question_id, qtype, x.mode, (SELECT min(rank) FROM m JOIN t ON t.question_id = m.question_id AND t.id = m.id WHERE m.question_id = rs.question_id AND m.mode = x.mode) AS best FROM rs, (SELECT DISTINCT mode FROM m) x)"""


def _truth(s, d):
    return staged(evaluation.ground_truth(table(s, d, "questions"), docs_of(s, d), chunks_of(s, d)), "truth")


@query(f"WITH {_TRUTH} SELECT question_id, id FROM t")
def ground_truth(s, d):
    return _truth(s, d)


@query(f"""WITH {_TRUTH} SELECT question_id, CASE WHEN anchor IS NULL THEN 'no anchor' WHEN source_path IS NULL OR source_path NOT IN (SELECT source_path FROM documents WHERE ingest_status = 'ready' AND source_path IS NOT NULL) THEN 'no ready document at the path' ELSE 'anchor not found' END AS reason FROM questions WHERE question_id NOT IN (SELECT question_id FROM t)""")
def unresolvable(s, d):
    return evaluation.unresolvable(table(s, d, "questions"), docs_of(s, d), _truth(s, d))


def _modes(s, d):
    ranked = staged(evaluation.modes(staged(evaluation.leg_ranks(table(s, d, "hits")), "ranks")), "modes")
    return evaluation.first_ranks(ranked, _truth(s, d), table(s, d, "questions"), ("mode",))


@query(f"WITH {_MODES} SELECT mode, {_MET} FROM b GROUP BY mode")
def recall_mrr(s, d):
    return evaluation.metrics(_modes(s, d), ("mode",))


@query(f"WITH {_MODES} SELECT qtype, round(avg(CASE WHEN mode = 'hybrid' THEN coalesce((best <= 3)::INT, 0) END), 9) AS hybrid, round(avg(CASE WHEN mode = 'lexical' THEN coalesce((best <= 3)::INT, 0) END), 9) AS lexical, round(avg(CASE WHEN mode = 'semantic' THEN coalesce((best <= 3)::INT, 0) END), 9) AS semantic FROM b GROUP BY qtype")
def recall_by_type(s, d):
    hit = F.round(F.avg(F.coalesce((F.col("best") <= 3).cast("double"), F.lit(0.0))), 9)
    return _modes(s, d).groupBy("qtype").pivot("mode", ["hybrid", "lexical", "semantic"]).agg(hit)


@query(f"""WITH {_LEGS}, {_TRUTH}, {_BEST}, g AS (SELECT a.a::DOUBLE AS fusion_k, w.x::DOUBLE AS w_lexical, w.y::DOUBLE AS w_semantic FROM (VALUES (0), (2), (5), (10), (20), (60)) a(a), (VALUES (1.0, 1.0), (1.0, 1.5), (1.0, 2.0), (0.5, 1.0)) w(x, y)),
fu AS (SELECT fusion_k, w_lexical, w_semantic, question_id, id, sum(CASE leg WHEN 'lexical' THEN w_lexical ELSE w_semantic END / (fusion_k + rank)) AS s FROM k, g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fusion_k, w_lexical, w_semantic, question_id ORDER BY round(s, 12) DESC, id) AS rank FROM fu),
x AS (SELECT fusion_k, w_lexical, w_semantic, r.question_id, min(rank) AS best FROM r JOIN t USING (question_id, id) WHERE rank <= 10 GROUP BY ALL),
b AS (SELECT g.*, rs.question_id, best FROM rs CROSS JOIN g LEFT JOIN x ON x.question_id = rs.question_id AND x.fusion_k = g.fusion_k AND x.w_lexical = g.w_lexical AND x.w_semantic = g.w_semantic)
SELECT fusion_k, w_lexical, w_semantic, {_MET} FROM b GROUP BY 1, 2, 3""")
def rrf_sweep(s, d):
    by = ("fusion_k", "w_lexical", "w_semantic")
    return evaluation.metrics(evaluation.first_ranks(evaluation.sweep(evaluation.leg_ranks(table(s, d, "hits"))), _truth(s, d), table(s, d, "questions"), by), by)


@query(f"""WITH {_MODES}, v AS (SELECT mode, avg(coalesce((best <= 1)::INT, 0)) AS a, avg(coalesce((best <= 3)::INT, 0)) AS c FROM b GROUP BY 1)
SELECT round(h.a - s.a, 9) AS delta_1, round(h.c - s.c, 9) AS delta_3, h.a >= s.a AND h.c >= s.c AS hybrid_holds FROM v h, v s WHERE h.mode = 'hybrid' AND s.mode = 'semantic'""")
def hybrid_verdict(s, d):
    m = staged(evaluation.metrics(_modes(s, d), ("mode",)), "metrics")
    h, x = m.filter("mode = 'hybrid'").alias("h"), m.filter("mode = 'semantic'").alias("x")
    return h.crossJoin(x).select(F.round(F.col("h.recall_1") - F.col("x.recall_1"), 9).alias("delta_1"), F.round(F.col("h.recall_3") - F.col("x.recall_3"), 9).alias("delta_3"), ((F.col("h.recall_1") >= F.col("x.recall_1")) & (F.col("h.recall_3") >= F.col("x.recall_3"))).alias("hybrid_holds"))


@query("SELECT id, document_id, nth FROM (SELECT id, document_id, row_number() OVER w AS nth, count(*) OVER (PARTITION BY document_id) AS n FROM document_chunks WHERE len(text) >= 200 WINDOW w AS (PARTITION BY document_id ORDER BY seq)) z WHERE (nth - 1) % greatest(1, n // 3) = 0")
def eval_sample(s, d):
    """An even stride of long chunks of every document."""
    from quire.plans.prefix import prefix_sums

    long = chunks_of(s, d).filter(F.length("text") >= 200).select("id", "document_id", "seq", F.lit(1).alias("one"))
    rows = prefix_sums(long, ["document_id"], ["seq"], "one", "nth").join(long.groupBy("document_id").agg(F.count("*").alias("n")), "document_id")
    return rows.filter((F.col("nth") - 1) % F.greatest(F.lit(1), F.floor(F.col("n") / 3)) == 0).select("id", "document_id", F.col("nth").cast("long").alias("nth"))


# --- lookups, windows, outlines --------------------------------------------------------------------------------

@query("""SELECT a.id AS anchor_id, c.id, c.seq, a.seq > 0 AND (SELECT min(seq) FROM document_chunks x WHERE x.document_id = a.document_id AND x.seq BETWEEN a.seq - 1 AND a.seq + 1) > 0 AS has_more_before,
 EXISTS (SELECT 1 FROM document_chunks x WHERE x.document_id = a.document_id AND x.seq = a.seq + 2) AS has_more_after
 FROM document_chunks a JOIN document_chunks c ON c.document_id = a.document_id AND c.seq BETWEEN a.seq - 1 AND a.seq + 1 WHERE a.id % 100 = 0""")
def context_window(s, d):
    c = chunks_of(s, d)
    return chunker.context(c, c.filter("id % 100 = 0")).drop("text")


@query(f"""WITH a AS (SELECT id AS anchor_id, document_id, seq AS place FROM document_chunks WHERE id % 100 = 0),
w AS (SELECT a.*, c.id, c.seq, coalesce({_U16.replace('text', 'c.text')}, 0) AS size FROM a JOIN document_chunks c ON c.document_id = a.document_id AND c.seq BETWEEN place - 5 AND place + 5),
f AS (SELECT *, sum(size) OVER (PARTITION BY anchor_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down, sum(CASE WHEN seq >= place THEN size ELSE 0 END) OVER (PARTITION BY anchor_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS up FROM w),
k AS (SELECT * FROM f WHERE seq = place OR seq < place AND down <= 2000 OR seq > place AND up <= 2000)
SELECT anchor_id, id, seq, min(seq) OVER (PARTITION BY anchor_id) > 0 AS has_more_before,
 (SELECT count(*) FROM document_chunks x WHERE x.document_id = k.document_id AND x.seq > k.place AND x.seq <= k.place + 6) > count(*) FILTER (seq > place) OVER (PARTITION BY anchor_id) AS has_more_after FROM k""")
def context_capped(s, d):
    """Windows of five chunks either side that hold at most 2,000 units."""
    c = chunks_of(s, d)
    return chunker.context(c, c.filter("id % 100 = 0"), 5, 5, 2000).drop("text")


@query("""WITH x AS (SELECT document_id, seq, locator_value, coalesce(section_path, []) AS path, coalesce(lag(section_path) OVER (PARTITION BY document_id ORDER BY seq), []) AS before FROM document_chunks),
e AS (SELECT *, unnest(range(1, least(len(path), 6) + 1)) AS level FROM x), f AS (SELECT *, (path[1:level] <> before[1:level])::INT AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY document_id, level ORDER BY seq) AS node FROM f)
SELECT document_id, level::INT AS level, arg_min(path[level], seq) AS title, min(seq) AS seq_start, max(seq) AS seq_end, arg_min(locator_value, seq) AS locator FROM g GROUP BY document_id, level, node""")
def outline_nodes(s, d):
    return chunker.outline(chunks_of(s, d))


@query("""WITH x AS (SELECT document_id, seq, coalesce(section_path, []) AS path, coalesce(lag(section_path) OVER (PARTITION BY document_id ORDER BY seq), []) AS before FROM document_chunks)
SELECT document_id, sum(CASE WHEN len(path) > 0 AND path[1:1] <> before[1:1] THEN 1 ELSE 0 END)::BIGINT AS nodes FROM x GROUP BY 1 HAVING nodes > 0""")
def outline_pruned(s, d):
    return chunker.outline(chunks_of(s, d), 1).groupBy("document_id").agg(F.count("*").alias("nodes"))


@query("SELECT document_id, id, seq FROM document_chunks WHERE seq BETWEEN 2 AND 4")
def seq_range(s, d):
    return chunks_of(s, d).filter(F.col("seq").between(2, 4)).select("document_id", "id", "seq")


@query("SELECT c.id, c.kind, c.page_number, d.title, d.source_path FROM document_chunks c JOIN documents d USING (document_id) WHERE d.ingest_status = 'ready' AND c.kind = 'table'")
def hydrate(s, d):
    docs = docs_of(s, d).filter("ingest_status = 'ready'").select("document_id", "title", "source_path")
    return chunks_of(s, d).filter("kind = 'table'").join(docs, "document_id").select("id", "kind", "page_number", "title", "source_path")


@query("SELECT id FROM document_chunks WHERE page_number BETWEEN 2 AND 3")
def page_range(s, d):
    return chunks_of(s, d).filter(F.col("page_number").between(2, 3)).select("id")


@query("SELECT document_id, title, ingest_status, row_number() OVER (ORDER BY created_at DESC, document_id) AS place FROM documents")
def list_documents(s, d):
    from quire.plans.prefix import prefix_sums

    rows = docs_of(s, d).select("document_id", "title", "ingest_status", (-F.unix_micros("created_at")).alias("age"), F.lit(1).alias("one"), F.lit(0).alias("g"))
    return prefix_sums(rows, ["g"], ["age", "document_id"], "one", "place").select("document_id", "title", "ingest_status", "place")


@query("SELECT (SELECT count(*) FROM document_chunks) AS chunks, (SELECT count(*) FROM document_chunks WHERE text IS NOT NULL) AS indexed, (SELECT count(DISTINCT chunk_rowid) FROM vec_chunks WHERE chunk_rowid IS NOT NULL) AS vectors")
def index_counts(s, d):
    c = chunks_of(s, d).agg(F.count("*").alias("chunks"), F.count("text").alias("indexed"))
    return c.crossJoin(table(s, d, "vec_chunks").agg(F.countDistinct("chunk_rowid").alias("vectors")))


@query("SELECT DISTINCT embedding_model FROM documents")
def distinct_models(s, d):
    return docs_of(s, d).select("embedding_model").distinct()


@query("SELECT document_id, count(DISTINCT locator_value) AS locators, max(locator_ordinal) AS last FROM document_chunks GROUP BY 1")
def locator_counts(s, d):
    return chunks_of(s, d).groupBy("document_id").agg(F.countDistinct("locator_value").alias("locators"), F.max("locator_ordinal").alias("last"))


@query()
def random_tables(s, d):
    """Eight table chunks in a random order."""
    return lookups.random_sample(chunks_of(s, d).filter("kind = 'table'"), 8).select("id", "document_id")


@query("SELECT c.id, d.title AS document_title, d.source_path FROM document_chunks c JOIN documents d USING (document_id) WHERE d.ingest_status = 'ready' AND c.id IN (SELECT chunk_rowid FROM hits)")
def hydrate_hits(s, d):
    ids = table(s, d, "hits").select(F.col("chunk_rowid").alias("id"))
    return lookups.hydrate(ids, chunks_of(s, d), docs_of(s, d)).select("id", "document_title", "source_path")


@query("SELECT document_id, title FROM documents WHERE lower(sha256) = (SELECT min(lower(sha256)) FROM documents)")
def find_by_sha256(s, d):
    """The documents of one content; hashes are compared without case."""
    some = docs_of(s, d).agg(F.min(F.lower("sha256"))).first()[0] or ""
    return lookups.by_sha256(docs_of(s, d), some.upper()).select("document_id", "title")


@query("SELECT id, document_id, seq, text FROM document_chunks WHERE chunk_id = (SELECT max(chunk_id) FROM document_chunks)")
def chunk_by_id(s, d):
    some = chunks_of(s, d).agg(F.max("chunk_id")).first()[0] or ""
    return lookups.by_chunk_id(chunks_of(s, d), some).select("id", "document_id", "seq", "text")


@query("SELECT id, chunk_id, text FROM document_chunks WHERE seq = 0 AND document_id = (SELECT min(document_id) FROM document_chunks)")
def chunk_by_seq(s, d):
    some = chunks_of(s, d).agg(F.min("document_id")).first()[0] or ""
    return lookups.by_seq(chunks_of(s, d), some, 0).select("id", "chunk_id", "text")


@query("SELECT seq, EXISTS (SELECT 1 FROM document_chunks c WHERE c.seq = x.seq AND document_id = (SELECT min(document_id) FROM document_chunks)) AS there FROM (VALUES (0), (1), (1000000)) x(seq)")
def chunk_exists(s, d):
    some = chunks_of(s, d).agg(F.min("document_id")).first()[0] or ""
    return s.createDataFrame([(n, lookups.chunk_exists(chunks_of(s, d), some, n)) for n in (0, 1, 1_000_000)], "seq int, there boolean")


@query("SELECT c.chunk_id, c.document_id, c.seq, c.kind, c.locator_type, c.locator_value, c.page_number, c.printed_label, c.section_path, c.token_count FROM document_chunks c")
def chunk_refs(s, d):
    """References to all chunks, without their texts."""
    return lookups.references(chunks_of(s, d))


@query("SELECT doc_id, regexp_matches(lower(source_path), '[.](pdf|docx|doc|md|markdown|html|htm|txt)$') AND NOT source_path LIKE '/%' AND NOT regexp_matches(source_path, '(^|/)[.][.](/|$)') AND trim(source_path) <> '' AS ok FROM documents WHERE source_path IS NOT NULL")
def addressable_paths(s, d):
    from quire.sources import paths

    return docs_of(s, d).filter("source_path is not null").select("doc_id", paths.addressable(F.col("source_path")).alias("ok"))


@query("SELECT doc_id, len(text)::INT AS size, false AS changed FROM documents WHERE text IS NOT NULL")
def text_decode(s, d):
    """Texts as bytes with a mark at their start, read back."""
    from quire.sources.files import decode

    def both(t: str) -> tuple[int, bool]:
        got = decode(b"\xef\xbb\xbf" + t.encode())
        return len(got), got != t

    return _per_text(docs_of(s, d), "doc_id", both, "l", "struct<size:int,changed:boolean>").select("doc_id", "l.size", "l.changed")


# --- routing ---------------------------------------------------------------------------------------------------

@query("""SELECT doc_id, CASE WHEN text LIKE '\\%PDF-%' ESCAPE '\\' THEN 'pdf' WHEN regexp_matches(lower(ltrim(text)), '^(<!doctype html|<html)') OR regexp_matches(lower(source_path), '\\.html?$') THEN 'html' WHEN regexp_matches(lower(source_path), '\\.(md|markdown)$') OR text LIKE '---' || chr(10) || '%' THEN 'md' ELSE 'txt' END AS format FROM documents WHERE text IS NOT NULL""")
def sniff_format(s, d):
    rows = docs_of(s, d).filter("text is not null").withColumn("content", F.encode("text", "UTF-8"))
    return rows.select("doc_id", route.sniff(F.col("content"), F.coalesce("source_path", F.lit(""))).alias("format"))


@query("""SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(text, '(?i)/(?:g|uni|c|cid|i)\\d+'), lambda x: len(x))), 0) / greatest(len(text), 1) <= 0.1 AND len(regexp_replace(text, '[^\\p{L}\\p{N}\\p{P}\\p{S}\\s]', '', 'g')) / greatest(len(text), 1) >= 0.6 AND len(regexp_extract_all(text, '\\x{FFFD}')) / greatest(len(text), 1) <= 0.02 AS usable FROM documents WHERE text IS NOT NULL""")
def usable_text_layer(s, d):
    return docs_of(s, d).filter("text is not null").select("doc_id", route.usable_text_layer(F.col("text")).alias("usable"))


_SPACES = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
_BARE = f"regexp_replace(regexp_replace(title, '^{_SPACES}+', ''), '{_SPACES}+$', '')"
_LEFT = _BARE
for _parts, _after in ((route.PRODUCTS, "\\b"), (route.GENERIC, "\\d*\\b"), (route.FILLERS, "\\b")):
    _LEFT = f"regexp_replace({_LEFT}, '(?i)\\b({'|'.join(_parts)}){_after}', ' ', 'g')"


@query(f"SELECT doc_id, CASE WHEN regexp_matches({_BARE}, '(?i){route.PRINT_DRIVER}') OR regexp_matches({_BARE}, '(?i)\\.[a-z0-9]{{2,4}}$') OR regexp_replace({_LEFT}, '[^\\p{{L}}\\p{{N}}]+|[0-9]+', '', 'g') = '' THEN NULL ELSE {_BARE} END AS title FROM documents")
def usable_title(s, d):
    return docs_of(s, d).select("doc_id", route.usable_title(F.col("title")).alias("title"))


@query("SELECT doc_id, coalesce(nullif(trim(title), '') IS NOT NULL, false) AS own FROM documents")
def titled(s, d):
    return docs_of(s, d).select("doc_id", (route.chosen_title(F.lit(None).cast("string"), F.col("title"), F.lit("x/ ")) != " ").alias("own"))


_SPACE = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
_ROMAN = "m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})"


@query(f"""SELECT id, count(*) AS lines FROM (SELECT id, unnest(string_split(text, chr(10))) AS l FROM document_chunks WHERE page_number IS NOT NULL) z
WHERE regexp_full_match(l, '{_SPACE}*({_ROMAN}|{_ROMAN.upper()}|[0-9]{{1,4}}|[Pp]age{_SPACE}+[0-9]{{1,4}})({_SPACE}|[.])*') AND NOT regexp_full_match(l, '{_SPACE}*I({_SPACE}|[.])*') AND NOT regexp_full_match(l, '{_SPACE}*') GROUP BY 1""")
def page_number_lines(s, d):
    lines = chunks_of(s, d).filter("page_number is not null").select("id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.filter(route.page_number_line(F.col("l"))).groupBy("id").agg(F.count("*").alias("lines"))


@query("""SELECT doc_id, page FROM (SELECT doc_id, unnest(list_distinct(list_append(list_transform(range(0, greatest(least(8, greatest(1, least(locator_count, greatest(1, ceil(locator_count / 40.0)::INT)))), least(locator_count, 3))), lambda i: (floor(i * locator_count / greatest(least(8, greatest(1, least(locator_count, greatest(1, ceil(locator_count / 40.0)::INT)))), least(locator_count, 3))) + 1)::INT), locator_count))) AS page FROM documents WHERE locator_count >= 1) z""")
def sample_pages(s, d):
    return docs_of(s, d).filter("locator_count >= 1").select("doc_id", F.explode(route.sample_pages(F.col("locator_count"))).alias("page"))


_USABLE = "coalesce(list_sum(list_transform(regexp_extract_all(text, '(?i)/(?:g|uni|c|cid|i)\\d+'), lambda x: len(x))), 0) / greatest(len(text), 1) <= 0.1 AND len(regexp_replace(text, '[^\\p{L}\\p{N}\\p{P}\\p{S}\\s]', '', 'g')) / greatest(len(text), 1) >= 0.6 AND len(regexp_extract_all(text, '\\x{FFFD}')) / greatest(len(text), 1) <= 0.02"


@query(f"""SELECT document_id, count(*) AS sampled, count(*) FILTER (t) AS textual, false AS image_only, count(*) FILTER (t) > 0 AND count(*) FILTER (t AND NOT u) >= 0.5 * count(*) FILTER (t) AS garbled, CASE WHEN garbled THEN 'ts-ocr' ELSE 'ts-fast' END AS engine
FROM (SELECT document_id, len(trim(coalesce(text, ''))) >= 20 AS t, coalesce({_USABLE}, false) AS u FROM document_chunks WHERE page_number IS NOT NULL) z GROUP BY 1""")
def probe_documents(s, d):
    """Whether page documents need recognition, from all their pages."""
    pages = chunks_of(s, d).filter("page_number is not null").select("document_id", "text", F.lit(False).alias("has_image"))
    return route.probe(pages)


# --- parsing and chunking --------------------------------------------------------------------------------------

def _blocks(s, d, format_):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(i, n, x.kind, x.level, x.locator, x.path, x.text) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, x in enumerate(markup.parse_text(format_, "", t))]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "block", "kind", "level", "locator", "path", "text"])

    docs = docs_of(s, d).filter((F.col("format") == format_) & F.col("text").isNotNull()).select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, block int, kind string, level int, locator string, path array<string>, text string")


_LINES = "(SELECT doc_id, regexp_replace(trim(unnest(string_split(text, chr(10)))), '[\\s\\x{85}\\p{Z}]+', ' ', 'g') AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE format = 'docx' AND text IS NOT NULL)"


@query(f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS block, 'paragraph' AS kind, trim(l) AS text FROM {_LINES} z WHERE trim(l) <> ''")
def docx_blocks(s, d):
    """Every text of a Word document put into an archive, a paragraph a line, and read back."""
    return _in_archives(docs_of(s, d).filter("format = 'docx'")).filter("kind is not null").select("doc_id", "block", "kind", "text")


def _in_archives(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(key, n, x.kind, x.text) for n, x in enumerate(markup.docx_blocks(content))]
                except ValueError:  # an empty document has no blocks
                    rows.append((key, 0, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], ["doc_id", "block", "kind", "text"])

    return _per_text(docs, "doc_id", markup.as_docx, "content", "binary").mapInArrow(run, "doc_id long, block int, kind string, text string")


@query("""SELECT doc_id, CASE WHEN format = 'docx' THEN 'docx' WHEN regexp_matches(lower(ltrim(text)), '^(<!doctype html|<html)') OR regexp_matches(lower(source_path), '\\.html?$') THEN 'html' WHEN regexp_matches(lower(source_path), '\\.(md|markdown)$') OR text LIKE '---' || chr(10) || '%' THEN 'md' ELSE 'txt' END AS format,
CASE WHEN format = 'docx' THEN 'ts-fast' WHEN regexp_matches(lower(ltrim(text)), '^(<!doctype html|<html)') OR regexp_matches(lower(source_path), '\\.html?$') THEN NULL ELSE 'ts-fast' END AS engine FROM documents WHERE text IS NOT NULL AND text NOT LIKE '%PDF-%'""")
def route_files(s, d):
    """Every document as a file: Word documents as archives, the others as text, told apart by their content."""
    docs = docs_of(s, d).filter("text is not null and text not like '%PDF-%'")
    words = _per_text(docs.filter("format = 'docx'"), "doc_id", markup.as_docx, "content", "binary")
    plain = docs.filter("format <> 'docx' or format is null").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    files = words.unionByName(plain).join(docs.select("doc_id", "source_path"), "doc_id")
    key = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.coalesce("source_path", F.lit("")))
    return route.route(files.select(key.alias("path"), "content")).select(F.substring_index("path", "/", 1).cast("long").alias("doc_id"), "format", "engine")


@query("""SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS line, l AS text FROM (SELECT id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[\\s\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+', ' ', 'g')) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM document_chunks WHERE page_number IS NOT NULL AND text IS NOT NULL) z WHERE l <> ''""")
def pdf_lines(s, d):
    """Every page's lines set as text runs, the halves of a line apart and in any order, and put together again."""

    def lines(text: str) -> list[str]:
        runs = []
        for n, line in enumerate(text.split("\n")):
            words = line.split()
            x = 50.0
            for w in words:
                runs.append(pdf.Run(w, x, 10_000_000 - 14.0 * n, 5.0 * len(w), 11.0))
                x += 5.0 * len(w) + 4.0
        return [x.text for x in pdf.assemble_lines(reversed(runs), columns=False)]

    rows = _per_text(chunks_of(s, d).filter("page_number is not null"), "id", lines, "lines", "array<string>")
    return rows.select("id", F.posexplode("lines").alias("line", "text")).select("id", F.col("line").cast("long").alias("line"), "text")


_BLANKS = "[\\s\\x{1C}-\\x{1F}\\x{85}\\p{Z}]"
_STRIP = f"regexp_replace(regexp_replace(@, '^{_BLANKS}+', ''), '{_BLANKS}+$', '')"


@query(f"""WITH x AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line, unnest(a) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE format = 'txt' AND text IS NOT NULL) z),
y AS (SELECT doc_id, line, l, {_STRIP.replace('@', 'l')} AS b, {_STRIP.replace('@', "coalesce(lead(l) OVER (PARTITION BY doc_id ORDER BY line), '')")} AS f FROM x),
n AS (SELECT *, regexp_extract(b, '^(\\d+(?:[.]\\d+)*)[.]?\\s+\\S', 1) AS num, right(b, 1) IN ('.', '!', '?') AS closed FROM y)
SELECT doc_id, line::INT AS line, level::INT AS level FROM (SELECT doc_id, line, CASE WHEN b = '' OR len(b) > 90 THEN NULL
 WHEN regexp_matches(l, '^\\s*(?:[-*+•]|\\d+[.)])\\s+\\S') AND NOT (num <> '' AND NOT contains(num, '.') AND f = '') THEN NULL
 WHEN regexp_full_match(f, '={{3,}}') THEN 1 WHEN regexp_full_match(f, '-{{3,}}') THEN 2
 WHEN num <> '' AND NOT closed THEN least(6, len(num) - len(replace(num, '.', '')) + 1)
 WHEN regexp_matches(b, '(?i)^(chapter|part|section|appendix|book)\\b') THEN 1
 WHEN NOT closed AND b = upper(b) AND regexp_matches(b, '\\p{{Lu}}') THEN 2 END AS level FROM n) z WHERE level IS NOT NULL""")
def txt_headings(s, d):
    """Lines of plain text that are headings, with their level."""

    def levels(text: str) -> list[int | None]:
        lines = text.split("\n")
        return [markup.heading_level(x, lines[n + 1] if n + 1 < len(lines) else None) for n, x in enumerate(lines)]

    rows = _per_text(docs_of(s, d).filter("format = 'txt'"), "doc_id", levels, "levels", "array<int>")
    return rows.select("doc_id", F.posexplode("levels").alias("line", "level")).filter("level is not null")


@query()
def md_blocks(s, d):
    return _blocks(s, d, "md")


@query()
def txt_blocks(s, d):
    return _blocks(s, d, "txt")


@query("SELECT doc_id, true AS in_order, 0 AS mixed FROM documents WHERE format = 'txt' AND regexp_matches(text, '\\S')")
def rechunk_laws(s, d):
    """Of plain text: whether the chunks hold all its letters and numbers in order, and how many hold more than a place."""

    def laws(text: str) -> tuple[bool, bool, int]:
        letters = lambda t: "".join(c for c in t if c.isalnum())
        blocks = list(markup.text_blocks(text))
        chunks = list(chunker.chunk_blocks(blocks))
        starts = {b.text: b.locator for b in blocks if b.kind == "heading" and (b.level or 9) <= 2}
        mixed = sum(any(line in starts and starts[line] != c.locator and sum(b.text == line for b in blocks) == 1 for line in c.text.split("\n\n")) for c in chunks)
        return bool(text.strip()), letters("".join(c.text for c in chunks)) == letters(text), mixed

    rows = _per_text(docs_of(s, d).filter("format = 'txt'"), "doc_id", laws, "l", "struct<filled:boolean,in_order:boolean,mixed:int>")
    return rows.filter("l.filled").select("doc_id", "l.in_order", "l.mixed")


@query()
def rechunk(s, d):
    """Every document parsed and chunked anew."""
    return chunker.chunk_documents(docs_of(s, d), markup.parse_text)


# --- ingest ----------------------------------------------------------------------------------------------------

@query("SELECT document_id, CASE WHEN sha256 IS NULL THEN 'MISSING' WHEN lower(sha256) = sha256(text) THEN 'OK' ELSE 'ALTERED' END AS state FROM documents WHERE text IS NOT NULL")
def sha256_identity(s, d):
    got = F.sha2("text", 256)
    return docs_of(s, d).filter("text is not null").select("document_id", F.when(F.col("sha256").isNull(), "MISSING").when(F.lower("sha256") == got, "OK").otherwise("ALTERED").alias("state"))


@query("SELECT d.document_id AS file, CASE WHEN lower(d.sha256) IS NOT DISTINCT FROM sha256(text) THEN 'OK' ELSE 'ALTERED' END AS state FROM documents d WHERE ingest_status = 'ready' AND text IS NOT NULL UNION ALL SELECT document_id, 'UNLISTED' FROM documents WHERE ingest_status IS DISTINCT FROM 'ready' AND text IS NOT NULL")
def manifest_verify(s, d):
    docs = docs_of(s, d).filter("text is not null")
    return verify_manifest(docs.filter("ingest_status = 'ready'").select(F.col("document_id").alias("file"), "sha256"), docs.select(F.col("document_id").alias("file"), F.sha2("text", 256).alias("sha256")))


@query("SELECT sha256(text) AS content, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dedupe_identical(s, d):
    return docs_of(s, d).filter("text is not null").groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")


@query(f"SELECT document_id, ingest_status, updated_at > TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE AS live FROM documents WHERE updated_at IS NOT NULL")
def lease_state(s, d):
    rows = docs_of(s, d).filter("updated_at is not null")
    return rows.select("document_id", "ingest_status", ingest.lease_live(F.col("updated_at"), F.lit(NOW).cast("timestamp")).alias("live"))


@query(f"SELECT ingest_status, count(*) AS n FROM (SELECT CASE WHEN ingest_status = 'processing' AND NOT coalesce(updated_at > TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE, false) THEN 'failed' ELSE ingest_status END AS ingest_status FROM documents) z GROUP BY 1")
def recover_interrupted(s, d):
    return ingest.recover_interrupted(docs_of(s, d), F.lit(NOW).cast("timestamp")).groupBy("ingest_status").agg(F.count("*").alias("n"))


@query("SELECT a.document_id, b.document_id AS stale_id FROM documents a JOIN documents b ON lower(a.source_path) = lower(b.source_path) AND lower(a.sha256) <> lower(b.sha256)")
def stale_at_path(s, d):
    docs = docs_of(s, d).filter("source_path is not null and sha256 is not null").select("document_id", F.lower("source_path").alias("p"), F.lower("sha256").alias("h"))
    return docs.alias("a").join(docs.alias("b"), "p").filter("a.h <> b.h").select(F.col("a.document_id").alias("document_id"), F.col("b.document_id").alias("stale_id"))


@query(f"""WITH f AS (SELECT DISTINCT sha256, source_path, lower(sha256) AS k, lower(source_path) AS p FROM ingest_log WHERE sha256 IS NOT NULL AND source_path IS NOT NULL),
dd AS (SELECT *, lower(sha256) AS k, lower(source_path) AS p, ingest_status = 'processing' AND coalesce(updated_at > TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE, false) AS live FROM documents WHERE sha256 IS NOT NULL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY updated_at DESC NULLS LAST, document_id DESC) AS n FROM dd) z WHERE n = 1),
st AS (SELECT f.k, f.p, bool_or(live) AS blocked, list_sort(list_distinct(list(document_id))) AS stale FROM (SELECT DISTINCT k, p FROM f) f JOIN dd ON dd.p = f.p AND dd.k <> f.k GROUP BY 1, 2),
x AS (SELECT f.sha256, f.source_path, CASE WHEN o.live THEN 'joined' WHEN st.blocked THEN 'error' WHEN o.ingest_status = 'ready' THEN 'reused' ELSE 'started' END AS outcome, coalesce(st.stale, []) AS stale FROM f LEFT JOIN o ON o.k = f.k LEFT JOIN st ON st.k = f.k AND st.p = f.p)
SELECT sha256, source_path, outcome, CASE WHEN outcome IN ('reused', 'started') THEN stale ELSE [] END AS supersede FROM x""")
def claim_outcomes(s, d):
    files = table(s, d, "ingest_log").filter("sha256 is not null and source_path is not null").select("sha256", "source_path")
    return ingest.claims(files, docs_of(s, d), F.lit(NOW).cast("timestamp"))


@query("SELECT outcome, count(*) AS attempts, count(DISTINCT source_path) AS paths, sum(CASE WHEN error_message IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS failed FROM (SELECT DISTINCT * FROM ingest_log) z GROUP BY 1")
def ingest_totals(s, d):
    return table(s, d, "ingest_log").distinct().groupBy("outcome").agg(F.count("*").alias("attempts"), F.countDistinct("source_path").alias("paths"), F.count("error_message").alias("failed"))


@query("WITH gone AS (SELECT document_id FROM documents WHERE ingest_status = 'failed') SELECT (SELECT count(*) FROM documents WHERE document_id NOT IN (SELECT document_id FROM gone)) AS documents, (SELECT count(*) FROM document_chunks WHERE document_id NOT IN (SELECT document_id FROM gone)) AS chunks, (SELECT count(*) FROM vec_chunks WHERE document_id NOT IN (SELECT document_id FROM gone)) AS vectors")
def delete_cascade(s, d):
    tables = {"documents": docs_of(s, d), "chunks": chunks_of(s, d), "vectors": table(s, d, "vec_chunks").filter("document_id is not null")}
    left = ingest.without_documents(tables, docs_of(s, d).filter("ingest_status = 'failed'"))
    out = None
    for name, df in left.items():
        n = df.agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(n)
    return out


@query("SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, logged_at)) AS start_us, document_id, count(*) AS n, epoch_us(max(logged_at)) AS renewed_us FROM ingest_log GROUP BY 1, 2")
def stream_renewals(s, d):
    """Claim renewals per five minutes, by a stream over the whole log that ends when all of it is read."""
    import uuid

    from quire.plans.storage import shared_folder
    from quire.streaming.watch import lease_timeouts

    log = table(s, d, "ingest_log")
    stream = s.readStream.schema(log.schema).parquet(f"{d}/ingest_log.parquet*")
    out = f"{shared_folder(s)}/quire/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.select(F.unix_micros("window.start").alias("start_us"), "document_id", "n", F.unix_micros("renewed_at").alias("renewed_us")).write.mode("overwrite").parquet(f"{out}/rows")

    q = lease_timeouts(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{out}/rows")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return _QUERIES["hybrid_search"](spark, folder)
